"""Features of (origin, horizon) pairs from history up to the origin, in one set of windows over the series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.graph import neighbour_mean
from tessera.operators.panel import SERIES

FEATURES = (
    *(f"d_l{k}" for k in range(6)), "d_mean3", "d_mean6", "d_std6", "d_slope6", "d_seas", "d_t12", "d_yoy", "d_all0", "d_mo_mean0",
    "nb_mean0", "nb_gap0", "nb_chg3", "reg_mean0", "reg_chg3", "ly0", "nb_dist1", "region", "cat_idx", "h", "target_month", "origin_month",
    "artifact_in_window", "artifact_seas",
)


def features(d: DataFrame, near: DataFrame, regions: DataFrame, grid: DataFrame, artifact: int = 3) -> DataFrame:
    """``territory_id, category, o, h, t`` and FEATURES for panel rows with ``d``; ``y_target`` is d[t] - d[o]."""
    w = Window.partitionBy(*SERIES).orderBy("t")
    v = F.col("d")
    of = lambda a, b: F.avg(v).over(w.rowsBetween(a, b))
    unit, region = Window.partitionBy("territory_id", "t"), Window.partitionBy("region", "category", "t")
    rows = d.join(regions.select("territory_id", F.col("region_code").alias("region")), "territory_id", "left")
    rows = rows.join(neighbour_mean(d, near, "d", ["category", "t"]).drop("nb_count"), [*SERIES, "t"], "left")
    rows = rows.join(near.where("rank = 1").select(F.col("src").alias("territory_id"), F.col("distance").alias("nb_dist1")), "territory_id", "left")
    rows = rows.withColumns({"_all": F.max(F.when(F.col("cat_idx") == 0, v)).over(unit), "_mo": F.avg(v).over(unit), "_reg": F.avg(v).over(region)})
    state = rows.select(
        *SERIES, "cat_idx", "region", "nb_dist1", F.col("t").alias("o"), F.col("ly").alias("ly0"), F.month("month").alias("origin_month"),
        *[F.lag("d", k).over(w).alias(f"d_l{k}") for k in range(6)],
        of(-2, 0).alias("d_mean3"), of(-5, 0).alias("d_mean6"), F.stddev_pop(v).over(w.rowsBetween(-5, 0)).alias("d_std6"),
        ((of(-2, 0) - F.when(F.col("t") >= 3, of(-5, -3)).otherwise(F.first("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))) / 3).alias("d_slope6"),
        of(-11, 0).alias("_mean12"), F.array(*[F.lag("d", 11 - i).over(w) for i in range(12)]).alias("_season"), (v - F.lag("d", 12).over(w)).alias("d_yoy"),
        F.col("_all").alias("d_all0"), F.col("_mo").alias("d_mo_mean0"), F.col("nb_mean").alias("nb_mean0"), (v - F.col("nb_mean")).alias("nb_gap0"),
        (F.col("nb_mean") - F.coalesce(F.lag("nb_mean", 3).over(w), F.first("nb_mean").over(w.rowsBetween(Window.unboundedPreceding, 0)))).alias("nb_chg3"),
        F.col("_reg").alias("reg_mean0"), (F.col("_reg") - F.lag("_reg", 3).over(w)).alias("reg_chg3"),
        F.lit(artifact).between(F.col("t") - 5, F.col("t")).cast("int").alias("artifact_in_window"))
    out = state.join(F.broadcast(grid.select("o", "h", "t")), "o")
    out = out.withColumns({
        "d_t12": F.element_at("_season", F.col("h")), "target_month": ((F.col("origin_month") + F.col("h") - 1) % 12 + 1).cast("int"),
        "artifact_seas": (F.col("t") - 12 == artifact).cast("int")}).withColumn("d_seas", F.col("d_t12") - F.col("_mean12"))
    target = d.select(*SERIES, "t", v.alias("_dt"))
    out = out.join(target, [*SERIES, "t"], "left").withColumn("y_target", F.col("_dt") - F.col("d_l0"))
    return out.select(*SERIES, "o", "t", *FEATURES, "y_target")

