"""The panel: gap-free monthly series, completeness, and the split into a shared and a local component.

Columns: ``territory_id, category, cat_idx, t, month, y, ly, is_full``; ``t`` counts months from the start, ``ly`` is log y.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import DEFAULT, GridConfig, PanelConfig
from tessera.functions import missing
from tessera.operators.quantiles import quantile

SERIES = ("territory_id", "category")


def categories(spark: SparkSession, cfg: PanelConfig = DEFAULT.panel) -> DataFrame:
    names = F.array(*map(F.lit, cfg.categories))
    return spark.range(1).select(F.posexplode(names).alias("cat_idx", "category"))


def calendar(spark: SparkSession, cfg: PanelConfig = DEFAULT.panel) -> DataFrame:
    start = F.lit(cfg.start).cast("date")
    return spark.range(cfg.months).select(F.col("id").cast("int").alias("t"), F.add_months(start, F.col("id").cast("int")).alias("month"))


def panel(facts: DataFrame, cfg: PanelConfig = DEFAULT.panel) -> DataFrame:
    """Facts ``territory_id, category, month, y`` to the panel: every series has every month of the calendar.

    Missing values are NULL (NaN is made NULL); of repeated facts the largest stays. A territory is full if all
    of its categories have all months. Calendar and categories are broadcast: their sizes are settings.
    """
    spark = facts.sparkSession
    facts = facts.groupBy(*SERIES, "month").agg(F.max(missing(F.col("y"))).alias("y"))
    series = facts.select(*SERIES).distinct().join(F.broadcast(categories(spark, cfg)), "category")
    dense = series.crossJoin(F.broadcast(calendar(spark, cfg))).join(facts, [*SERIES, "month"], "left")
    complete = F.count("y").over(Window.partitionBy("territory_id")) == cfg.months * len(cfg.categories)
    return dense.select(*SERIES, "cat_idx", "t", "month", "y", F.when(F.col("y") > 0, F.log("y")).alias("ly"), complete.alias("is_full"))


def full(p: DataFrame) -> DataFrame:
    return p.where("is_full")


def national(p: DataFrame, require_full: bool = True) -> DataFrame:
    """``category, cat_idx, t, n``: the median of log values over (full) territories. One row a category and month."""
    rows = p.where("is_full") if require_full else p
    return quantile(rows, ["category", "cat_idx", "t"], "ly", 0.5, "n")


def decompose(p: DataFrame, require_full: bool = True) -> DataFrame:
    """The panel with ``n`` and the local deviation ``d = ly - n``."""
    n = national(p, require_full).drop("cat_idx")
    return p.join(F.broadcast(n), ["category", "t"], "left").withColumn("d", F.col("ly") - F.col("n"))


def grid(spark: SparkSession, cfg: GridConfig = DEFAULT.grid, months: int = DEFAULT.panel.months) -> DataFrame:
    """The backtest's spine ``o, h, t, split, h_group``: origins times horizons whose target lies in the evaluated months."""
    o = spark.range(cfg.first_origin, cfg.last_origin + 1).select(F.col("id").cast("int").alias("o"))
    h = spark.range(1, cfg.max_h + 1).select(F.col("id").cast("int").alias("h"))
    rows = o.crossJoin(h).withColumn("t", F.col("o") + F.col("h")).where((F.col("t") < months) & (F.col("t") >= cfg.val[0]) & (F.col("t") <= cfg.test[1]))
    group = F.lit(None).cast("int")
    for k, hs in enumerate(cfg.groups):
        group = F.when(F.col("h").isin(*hs), k).otherwise(group)
    split = F.when(F.col("t").between(*cfg.val), "val").when(F.col("t").between(*cfg.test), "test")
    return rows.select("o", "h", "t", split.alias("split"), group.alias("h_group"))
