"""Shocks of known shape, size and scope put into real series. Draws are hashes, so that any engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import DEFAULT, DetectConfig
from tessera.functions import bernoulli, draw

SHAPES, SCOPES, MAGNITUDES = ("step", "dip", "ramp"), ("series", "mo", "cluster"), (0.03, 0.05, 0.10, 0.20)


def scenarios(spark: SparkSession, scopes=SCOPES, shapes=SHAPES, magnitudes=MAGNITUDES, seeds: int = 3) -> DataFrame:
    """``scenario, scope, shape, magnitude, seed``: a dimension table, crossed with the panel by the broadcast of its few rows."""
    lit = lambda values: F.explode(F.array(*map(F.lit, values)))
    rows = spark.range(1).select(lit(scopes).alias("scope")).withColumn("shape", lit(shapes)).withColumn("magnitude", lit(magnitudes)).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    return rows.withColumn("scenario", F.concat_ws("|", "scope", "shape", (F.col("magnitude") * 1000).cast("int"), "seed"))


def profile(shape: Column, t: Column, onset: Column) -> Column:
    """Share of the full shock in month t."""
    ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - onset + 1) / 3))
    on = (t >= onset).cast("double")
    return F.when(shape == "step", on).when(shape == "dip", F.when((t >= onset) & (t < onset + 2), 1.0).otherwise(0.0)).when(shape == "spike", (t == onset).cast("double")).otherwise(ramp)


def shocks(territories: DataFrame, scen: DataFrame, near: DataFrame | None = None, frac: float = 0.1, cfg: DetectConfig = DEFAULT.detect, n_categories: int = 6) -> DataFrame:
    """``scenario, territory_id, cat_idx, onset, delta``: one row for each shocked series.

    A share of territories are centres (smallest draws). A centre shocks one of its sub-categories, all of its series, or all
    series of itself and its neighbours; where clusters overlap, the centre with the smaller draw wins.
    """
    a = scen.crossJoin(territories).withColumn("u", draw(F.lit("centre"), F.col("scenario"), F.col("territory_id")))
    w = Window.partitionBy("scenario")
    rank = F.row_number().over(w.orderBy("u", "territory_id"))
    a = a.withColumns({"rank": rank, "n": F.count("*").over(w)}).where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * frac)))
    span = cfg.onset[1] - cfg.onset[0] + 1
    sign = 2 * (draw(F.lit("sign"), F.col("scenario"), F.col("territory_id")) % 2) - 1
    centres = a.select("scenario", "scope", "rank", F.col("territory_id").alias("centre"), (cfg.onset[0] + draw(F.lit("onset"), F.col("scenario"), F.col("territory_id")) % span).cast("int").alias("onset"), (F.log1p("magnitude") * sign).alias("delta"))
    cats = F.sequence(F.lit(0), F.lit(n_categories - 1))
    one = F.array((1 + draw(F.lit("category"), F.col("scenario"), F.col("centre")) % (n_categories - 1)).cast("int"))
    rows = centres.withColumn("cat_idx", F.explode(F.when(F.col("scope") == "series", one).otherwise(cats)))
    own = rows.withColumn("territory_id", F.col("centre"))
    if near is not None:
        around = rows.where("scope = 'cluster'").join(near.select(F.col("src").alias("centre"), F.col("dst").alias("territory_id")), "centre").join(territories, "territory_id", "left_semi")
        own = own.unionByName(around.select(*own.columns))
    best = F.min(F.struct("rank", "onset", "delta")).alias("b")
    return own.groupBy("scenario", "territory_id", "cat_idx").agg(best).select("scenario", "territory_id", "cat_idx", "b.onset", "b.delta")


def inject(d: DataFrame, scen: DataFrame, shocked: DataFrame) -> DataFrame:
    """Series ``territory_id, category, cat_idx, t, d`` for each scenario, with ``shocked`` and ``onset`` (null without a shock)."""
    rows = d.crossJoin(F.broadcast(scen)).join(shocked, ["scenario", "territory_id", "cat_idx"], "left")
    add = F.coalesce(profile(F.col("shape"), F.col("t"), F.col("onset")) * F.col("delta"), F.lit(0.0))
    return rows.withColumns({"d": F.col("d") + add, "shocked": F.col("onset").isNotNull()}).drop("delta")


def simulated_news(rows: DataFrame, recall: float = 0.6, false_rate: float = 0.03, mult: float = 8.0) -> DataFrame:
    """Rows of ``inject`` with ``mult``, what the news multiplies the hazard by: ``mult`` in the month in which a reported shock begins
    (a share ``recall`` of shocked series) and in a share ``false_rate`` of all months, else 1."""
    series = (F.col("scenario"), F.col("territory_id"), F.col("cat_idx"))
    told = F.coalesce(F.col("t") == F.col("onset"), F.lit(False)) & bernoulli(recall, F.lit("news"), *series)
    return rows.withColumn("mult", F.when(told | bernoulli(false_rate, F.lit("rumour"), *series, F.col("t")), mult).otherwise(1.0))
