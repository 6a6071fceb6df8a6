"""Accuracy of forecasts with actuals: rows ``y, yhat, ylag`` and any keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.quantiles import quantile


def usable(rows: DataFrame) -> DataFrame:
    return rows.where("y is not null and yhat is not null and not isnan(y) and not isnan(yhat)")


def with_all(rows: DataFrame) -> DataFrame:
    """Each row in its split and in ``all``."""
    return rows.withColumn("split", F.explode(F.array("split", F.lit("all"))))


def metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``MAE, R2, WAPE, sMAPE, n, R2_yoy`` by keys. Sums of squares are taken about the group's mean, which a first
    aggregate gives (a row for each group, so the join back is small)."""
    rows = usable(rows)
    err = F.col("y") - F.col("yhat")
    yoy, yoy_hat = F.log(F.col("y") / F.col("ylag")), F.log(F.col("yhat") / F.col("ylag"))
    rows = rows.withColumns({"err": err, "g": F.when(F.col("ylag") > 0, yoy), "ge": F.when(F.col("ylag") > 0, yoy - yoy_hat)})
    return rows.groupBy(*keys).agg(
        F.avg(F.abs("err")).alias("MAE"),
        (1 - F.sum(F.col("err") ** 2) / (F.var_pop("y") * F.count("y"))).alias("R2"),
        (F.sum(F.abs("err")) / F.sum(F.abs("y"))).alias("WAPE"),
        F.avg(2 * F.abs("err") / (F.abs("y") + F.abs("yhat"))).alias("sMAPE"),
        F.count("*").alias("n"),
        (1 - F.sum(F.col("ge") ** 2) / (F.var_pop("g") * F.count("g"))).alias("R2_yoy"),
    )


def extra_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``MdAPE, bias, WAPE, n_months`` by keys. ``rows`` is read twice."""
    rows = usable(rows)
    err = F.col("yhat") - F.col("y")
    middle = quantile(rows, keys, F.abs(err) / F.col("y"), 0.5, "MdAPE")
    return rows.groupBy(*keys).agg(
        (F.sum(err) / F.sum("y")).alias("bias"),
        (F.sum(F.abs(err)) / F.sum("y")).alias("WAPE"),
        F.countDistinct("t").alias("n_months"),
    ).join(middle, keys)


def ranked(scores: DataFrame, keys: list[str], by: str) -> DataFrame:
    return scores.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(by)))


def pivot(scores: DataFrame, row: str, column: str, values: list, metric: str, prefix: str = "") -> DataFrame:
    """One row for each ``row``, a column for each value of ``column``."""
    wide = scores.groupBy(row).pivot(column, values).agg(F.first(metric))
    return wide.select(row, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def monthly_loss(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``h, territory_id, t, diff``: mean difference of absolute errors of models a and b by territory and target month."""
    e = F.abs(F.col("y") - F.col("yhat"))
    both = usable(rows).where(F.col("model").isin(a, b)).groupBy("h", "territory_id", "category", "o", "t").agg(
        F.max(F.when(F.col("model") == a, e)).alias("ea"), F.max(F.when(F.col("model") == b, e)).alias("eb"))
    return both.where("ea is not null and eb is not null").groupBy("h", "territory_id", "t").agg(F.avg(F.col("ea") - F.col("eb")).alias("diff"))


def interval_scores(rows: DataFrame, lo: str, mid: str, hi: str, y: str = "y", level: float = 0.8) -> DataFrame:
    """Coverage of intervals by horizon on test targets, as they are and after conformal widening: the multiplier is the
    ``level`` quantile of |y - mid| / half width on validation targets."""
    half = (F.col(hi) - F.col(lo)) / 2
    s = F.abs(F.col(y) - F.col(mid)) / F.greatest(half, F.lit(1e-9))
    q = quantile(rows.where("split = 'val'"), ["h"], s, level, "q")
    hit: Column = F.col(y).between(F.col(lo), F.col(hi)).cast("double")
    test = rows.where("split = 'test'").join(F.broadcast(q), "h")
    return test.groupBy("h").agg(F.first("q").alias("q"), F.avg(hit).alias("raw_coverage"), F.avg((s <= F.col("q")).cast("double")).alias("conformal_coverage"), F.count("*").alias("n"))
