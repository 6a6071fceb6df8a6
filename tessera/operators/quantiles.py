"""Exact quantiles of groups of any size by refined histograms: no task ever holds a group's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import missing
from tessera.storage import materialize

#: Groups of at most so many values are left to one aggregate. Buckets of a histogram; bounds of buckets that are broadcast.
FEW, BUCKETS, SMALL = 1 << 16, 1024, 10_000


def _exponent(v: Column) -> Column:
    """A whole number that never falls as v grows: the power of two of v, negative for negative values, 0 for 0."""
    power = F.floor(F.log2(F.least(F.abs(v), F.lit(1.7976931348623157e308)))) + F.when(F.abs(v) == float("inf"), 1102).otherwise(1100)
    return F.when(v > 0, power).when(v < 0, -power).otherwise(0).cast("long")


def _share(v: Column, low: Column, high: Column) -> Column:
    """Which of BUCKETS equal parts of [low, high] holds v; halves keep the width finite."""
    width = high / 2 - low / 2
    return F.when(width > 0, F.least(F.lit(BUCKETS - 1), F.floor((v / 2 - low / 2) / width * BUCKETS))).otherwise(0).cast("long")


def _matched(rows: DataFrame, bounds: DataFrame, keys: list[str], within: bool = False) -> DataFrame:
    """Rows with the bounds of their group; ``within``: only those between ``low`` and ``high``."""
    names = {k: f"_{k}" for k in keys}
    bounds = bounds.withColumnsRenamed(names)
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    if within:
        on = on & F.col("_v").between(F.col("low"), F.col("high"))
    return rows.join(F.broadcast(bounds) if bounds.count() <= SMALL else bounds, on).drop(*names.values())


def order_statistics(rows: DataFrame, keys: list[str], wanted: DataFrame, few: int = FEW) -> DataFrame:
    """``rows(*keys, _v)`` and ``wanted(*keys, rank)``, ranks from 0, to ``(*keys, rank, value)``.

    The first histogram counts powers of two, further ones equal parts of the bucket that holds a wanted rank, between
    its least and its largest value. A bucket is an interval of values, so lower buckets' counts are all that is carried on.
    Refining ends when the bucket holds one value or at most ``few`` rows, which are then ranked. A power of two has
    fewer than 2**53 values and a part of a bucket is a 1024th of its width, so that takes seven rounds at most.
    """
    rows = materialize(rows.select(*keys, "_v"), "valued")
    span = [*keys, "low", "high"]

    def narrowed(counted: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
        before = F.sum("n").over(Window.partitionBy(*by).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        found = _matched(counted.withColumn("before", before), state, by)
        rank = F.col("rank") - F.col("base")
        found = found.where((rank >= F.col("before")) & (rank < F.col("before") + F.col("n")))
        return materialize(found.select(*keys, "rank", (F.col("base") + F.col("before")).alias("base"), F.col("least").alias("low"), F.col("most").alias("high"), F.col("n").alias("size")), "buckets")

    measures = F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most")
    counted = rows.groupBy(*keys, _exponent(F.col("_v")).alias("digit")).agg(*measures)
    state = narrowed(counted, wanted.withColumn("base", F.lit(0).cast("long")), keys)
    done = []
    while True:
        single = (F.col("low") == F.col("high")) | (F.col("size") <= few)
        done.append(state.where(single))
        state = state.where(~single)
        if not state.limit(1).count():
            break
        inner = _matched(rows, state.select(*span).distinct(), keys, within=True)
        counted = inner.groupBy(*span, _share(F.col("_v"), F.col("low"), F.col("high")).alias("digit")).agg(*measures)
        state = narrowed(counted, state.drop("size"), span)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    found = materialize(found, "narrow")
    known = found.where("low = high").select(*keys, "rank", F.col("low").alias("value"))
    rest = found.where("low < high")
    order = Window.partitionBy(*span).orderBy("_v")
    inner = _matched(rows, rest.select(*span).distinct(), keys, within=True).withColumn("nth", F.row_number().over(order) - 1)
    placed = rest.withColumn("nth", (F.col("rank") - F.col("base")).cast("int"))
    placed = _matched(inner.withColumnRenamed("_v", "value"), placed.drop("base", "size"), [*span, "nth"])
    return known.unionByName(placed.select(*keys, "rank", "value"))


def quantiles(rows: DataFrame, keys: list[str], value: Column | str, probabilities: Sequence[float], few: int = FEW) -> DataFrame:
    """``*keys, quantiles``: exact quantiles by linear interpolation, as ``percentile`` gives them, in the order of ``probabilities``.

    ``rows`` is read several times, so it should be a stored table. Nulls and NaN don't count; a group without a value has null
    for its quantiles, and so has a table without rows if there are no keys. Where no group has more than ``few`` values, one
    ``percentile`` does it: its buffers are bounded by that then. Otherwise order statistics are selected by refined histograms.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = rows.select(*keys, missing(v.cast("double")).alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count("_v").alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= few:
        return rows.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probabilities])).alias("quantiles"))
    sizes = materialize(sizes, "sizes")
    at = [(F.col("_n") - 1) * F.lit(float(p)) for p in probabilities]
    ranks = [F.floor(x).cast("long") for x in at] + [F.ceil(x).cast("long") for x in at]
    wanted = sizes.where("_n > 0").select(*keys, F.explode(F.array_distinct(F.array(*ranks))).alias("rank"))
    found = order_statistics(rows.where("_v IS NOT NULL"), keys, wanted, few)
    of = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("of"))
    known = _matched(of, sizes.where("_n > 0"), keys).select(*keys, F.array(*[_between(x) for x in at]).alias("quantiles"))
    return known.unionByName(sizes.where("_n = 0").select(*keys, F.lit(None).cast("array<double>").alias("quantiles")))


def _between(at: Column) -> Column:
    low, high = F.floor(at).cast("long"), F.ceil(at).cast("long")
    a, b = F.element_at("of", low), F.element_at("of", high)
    return F.when((low == high) | (a == b), a).otherwise((high - at) * a + (at - low) * b)


def quantile(rows: DataFrame, keys: list[str], value: Column | str, probability: float, name: str) -> DataFrame:
    """``*keys, name``: one quantile of each group."""
    return quantiles(rows, keys, value, (probability,)).select(*keys, F.col("quantiles")[0].alias(name))
