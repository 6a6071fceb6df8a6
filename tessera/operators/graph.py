"""Neighbours of territories on an undirected graph with distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """Edges ``x, y, distance`` to ``src, dst, distance, rank``: both directions without loops, the k shortest of each node.

    Parallel edges are kept as they are; ties go to the smaller neighbour.
    """
    both = edges.select(F.col("x").alias("src"), F.col("y").alias("dst"), "distance").unionByName(edges.select(F.col("y").alias("src"), F.col("x").alias("dst"), "distance")).where("src <> dst")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbour_mean(rows: DataFrame, near: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``territory_id, *keys, nb_mean, nb_count``: mean of a value over neighbours at equal keys, without missing ones."""
    other = rows.select(F.col("territory_id").alias("dst"), *keys, F.col(value).alias("v"))
    joined = near.select(F.col("src").alias("territory_id"), "dst").join(other, "dst")
    return joined.groupBy("territory_id", *keys).agg(F.avg("v").alias("nb_mean"), F.count("*").alias("nb_count"))
