"""Connected components of a graph given as an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(src, dst)`` of longs to ``(node, root)``: root is the smallest node reachable; nodes without edges are absent.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each step is a grouped minimum, which is
    combined before the shuffle, and an equi-join that adaptive execution may split, so a hub's edges never meet
    in one task. Every round is written to the shared folder, which also ends its lineage. Nulls and loops are ignored.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e, mark = materialize(e, "edges"), None
    while True:
        seen = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if seen["n"] == 0 or tuple(seen) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = tuple(seen)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
        small = small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        new = materialize(small, "edges")
        release(e)
        e = new
