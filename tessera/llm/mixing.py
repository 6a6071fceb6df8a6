"""Mixing of sources to target weights by hash thresholds, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.text import free_name, n_words
from tessera.storage import materialize

#: Sources by code point, null last, get these weights in turn.
WEIGHTS, MOST_REPEATS = (5, 2, 1), 3
#: Bits of the hash, and of one histogram level. Two levels of 2**10 buckets narrow a threshold to 2**-20 of a source.
HASH_BITS, LEVEL_BITS = 60, 10
#: Source tables of at most this many rows are broadcast; larger ones are joined by shuffle.
SMALL = 10_000


def row_hash(id_: Column, text: Column) -> Column:
    """60 bits of MD5 of the id, or of the text where the id is null; other engines can compute it too."""
    key = F.coalesce(id_.cast("string"), F.concat(F.lit("text:"), text), F.lit("none"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """``sizes(source, source_size)`` to ``(source, source_size, target)``.

    All sizes together are shared by weight; a target stops at ``most`` times its source's size and the excess is
    shared again until none is above. That fixed point is a water level: sources in the order of cap / weight are
    capped as long as the level of the rest reaches their cap. One row a source, so the ordered windows are small.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sizes.withColumn("w", F.element_at(w, (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") < F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)["level"]
    return ranked.select("source", "source_size", F.when(F.col("free"), level * F.col("w")).otherwise(F.col("cap")).alias("target"))


def thresholds(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """``sized(source, size, h)`` to ``(source, source_size, target, repeats, bound)``: the mix takes each document
    ``repeats`` times, and once more if its ``h`` is below ``bound``.

    Sizes are summed by source and hash bucket (combined before the shuffle); the bucket in which the running sum
    crosses the budget is the only one that is refined, by the next bits of its documents; what is left, 2**-20 of a
    source, is resolved by single hash values. Documents with the same hash are taken together. Nothing is sorted but buckets.
    """
    top, mid = HASH_BITS - LEVEL_BITS, HASH_BITS - 2 * LEVEL_BITS
    level1 = materialize(sized.groupBy("source", F.shiftright("h", top).alias("b")).agg(F.sum("size").alias("s")), "histogram")
    goal = targets(level1.groupBy("source").agg(F.sum("s").alias("source_size")), weights, most)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = materialize(goal.withColumn("repeats", repeats).withColumn("left", F.col("target") - F.col("repeats") * F.col("source_size")), "targets")
    small = goal.count() <= SMALL

    def by_source(df: DataFrame, other: DataFrame) -> DataFrame:
        other = other.withColumnRenamed("source", "source_")
        return df.join(F.broadcast(other) if small else other, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")

    def crossing(df: DataFrame, unit: str) -> DataFrame:
        """The first unit of each source whose running sum is over what is left, and what is left before it."""
        run = F.sum("s").over(Window.partitionBy("source").orderBy(unit).rowsBetween(Window.unboundedPreceding, 0))
        over = df.withColumn("run", run).where(F.col("run") > F.col("left"))
        return over.groupBy("source").agg(F.min(F.struct(unit, (F.col("left") - F.col("run") + F.col("s")).alias("left"))).alias("x")).select("source", f"x.{unit}", "x.left")

    edge1 = crossing(by_source(level1, goal.select("source", "left")), "b")
    inner = by_source(sized, edge1.withColumnRenamed("b", "b1")).where(F.shiftright("h", top) == F.col("b1"))
    inner = materialize(inner.groupBy("source", "left", "h").agg(F.sum("size").alias("s")), "boundary")
    level2 = inner.groupBy("source", "left", F.shiftright("h", mid).alias("b")).agg(F.sum("s").alias("s"))
    edge2 = crossing(level2, "b")
    last = by_source(inner.drop("left"), edge2.withColumnRenamed("b", "b2")).where(F.shiftright("h", mid) == F.col("b2"))
    bound = crossing(last, "h").select("source", F.col("h").alias("bound"))
    found = by_source_left(goal, bound)
    return found.select("source", "source_size", "target", "repeats", F.when(F.col("left") > 0, F.coalesce("bound", F.lit(1 << HASH_BITS))).otherwise(0).cast("long").alias("bound"))


def by_source_left(goal: DataFrame, bound: DataFrame) -> DataFrame:
    return goal.join(bound.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, size, h)``: words of the whole text and the hash that thresholds compare."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col)).alias("h"))


def _joined(rows: DataFrame, source: str, found: DataFrame, name: str) -> DataFrame:
    found = found.withColumnRenamed("source", name)
    return rows.join(F.broadcast(found) if found.count() <= SMALL else found, F.col(source).eqNullSafe(F.col(name))).drop(name)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """One row a document: ``id, source, size, source_size, target, taken``, with ``taken`` the words that the mix takes of it.

    Null texts have size 0, null sources are one source, repeated rows count each, a source without words has target 0,
    an empty table gives an empty result; other columns are ignored.
    """
    rows = materialize(sized(docs, id_col=id_col, text_col=text_col, source_col=source_col), "sized")
    found = materialize(thresholds(rows.select("source", "size", "h"), weights, most), "thresholds")
    taken = F.col("size") * (F.col("repeats") + (F.col("h") < F.col("bound")).cast("long"))
    return _joined(rows, "source", found, "source_").select("id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """The mix itself: ``docs`` with each row as many times as the mix takes it, which may be none."""
    rows = materialize(sized(docs, id_col=id_col, text_col=text_col, source_col=source_col), "sized")
    found = materialize(thresholds(rows.select("source", "size", "h"), weights, most), "thresholds")
    key, copies, copy, src = (free_name(docs.columns, f"_{x}") for x in ("h", "copies", "copy", "src"))
    found = found.select("source", F.col("repeats").alias(copies), F.col("bound").alias(copy))
    out = _joined(docs.withColumn(key, row_hash(F.col(id_col), F.col(text_col))).withColumn(src, F.col(source_col).cast("string")), src, found, free_name(docs.columns, "_of"))
    out = out.withColumn(copies, F.col(copies) + (F.col(key) < F.col(copy)).cast("long")).where(F.col(copies) > 0)
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copy)).select(*docs.columns)
