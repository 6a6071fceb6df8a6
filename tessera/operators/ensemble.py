"""Ensembles of log forecasts chosen greedily, for many pools of candidates at once; pools, horizon groups and weights are rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.panel import SERIES
from tessera.storage import materialize

#: Additions, and shares of equal weights that are tried afterwards.
ADDITIONS, SHRINKAGES = 30, (0.0, 0.25, 0.5, 0.75, 1.0)
#: Additions that one plan chains before its state is written.
CHAINED = 2
#: Errors are compared after rounding to so many decimals, so that any engine takes the same of two equal candidates.
PLACES = 9


def pools_table(like: DataFrame, pools: Mapping[str, tuple[str, Sequence[str]]], models: Sequence[str]) -> DataFrame:
    """``pool, variant, allowed``: which variant of the forecasts a pool takes, and which of ``models`` (an array of flags)."""
    rows = [(name, variant, [m in members for m in models]) for name, (variant, members) in pools.items()]
    return like.sparkSession.createDataFrame(rows, "pool string, variant string, allowed array<boolean>")


def cells(forecasts: DataFrame, pools: DataFrame, models: Sequence[str], split: str = "val") -> DataFrame:
    """``pool, h_group, h, y, p, allowed``: targets of a split for which a pool has all its members' log forecasts, ``p`` in the order of ``models``."""
    rows = forecasts.where((F.col("split") == split) & F.col("y").isNotNull()).groupBy("variant", "h_group", *SERIES, "o", "h", "y")
    rows = rows.agg(*[F.max(F.when(F.col("model") == m, F.col("lf"))).alias(f"_{i}") for i, m in enumerate(models)])
    rows = rows.join(F.broadcast(pools), "variant")
    complete = F.lit(True)
    for i in range(len(models)):
        complete = complete & (~F.col("allowed")[i] | F.col(f"_{i}").isNotNull())
    return rows.where(complete).select("pool", "h_group", "h", "y", F.array(*[F.coalesce(f"_{i}", F.lit(0.0)) for i in range(len(models))]).alias("p"), "allowed")


def _sum(weights: str, n: int) -> Column:
    total = F.lit(0.0)
    for i in range(n):
        total = total + F.col(weights)[i] * F.col("p")[i]
    return total


def _mean_error(log_forecast: Column) -> Column:
    return F.round(F.avg(F.abs(F.col("y") - F.exp(log_forecast))), PLACES)


def choose(forecasts: DataFrame, models: Sequence[str], pools: Mapping[str, tuple[str, Sequence[str]]], additions: int = ADDITIONS) -> DataFrame:
    """``pool, h_group, model, weight, shrinkage``: members and their weights in log space.

    ``forecasts`` has a ``variant``. Starting from nothing, each step adds (again) the member of the pool with which the mean
    has the least absolute error on validation targets, the first one of a tie; shares of members are then drawn
    towards equal weights by the shrinkage with the least error, the smallest of a tie. A step is one grouped aggregate for all
    candidates of all pools and groups; how often each was taken is a row of a table, which the next step joins, so nothing
    is collected and the driver decides nothing.
    """
    n = len(models)
    rows = materialize(cells(forecasts, pools_table(forecasts, pools, models), models), "cells")
    by = ["pool", "h_group"]
    state = rows.select(*by, "allowed").distinct().select(*by, "allowed", F.array(*[F.lit(0.0)] * n).alias("taken"), F.lit(1.0).alias("step"))
    rows = rows.drop("allowed")
    for step in range(1, additions + 1):
        errors = [_mean_error((_sum("taken", n) + F.col("p")[i]) / F.col("step")).alias(f"e{i}") for i in range(n)]
        scored = rows.join(F.broadcast(state), by).groupBy(*by).agg(*errors).join(F.broadcast(state), by)
        e = F.array(*[F.when(F.col("allowed")[i], F.col(f"e{i}")).otherwise(F.lit(float("inf"))) for i in range(n)])
        best = F.array_position(e, F.array_min(e))
        state = scored.select(*by, "allowed", F.array(*[F.col("taken")[i] + (best == i + 1).cast("double") for i in range(n)]).alias("taken"), F.col("step") + 1)
        state = state.toDF(*by, "allowed", "taken", "step")
        if step % CHAINED == 0 or step == additions:
            state = materialize(state, "ensemble-state")
    members = F.size(F.filter("allowed", lambda a: a))
    shrunk = lambda i, s: (1 - s) * F.col("taken")[i] / additions + F.when(F.col("allowed")[i], s / members).otherwise(0.0)
    tried = state.select(*by, *[F.array(*[shrunk(i, s) for i in range(n)]).alias(f"w{k}") for k, s in enumerate(SHRINKAGES)])
    scored = rows.join(F.broadcast(tried), by).groupBy(*by).agg(*[_mean_error(_sum(f"w{k}", n)).alias(f"e{k}") for k in range(len(SHRINKAGES))]).join(F.broadcast(tried), by)
    options = [F.struct(F.col(f"e{k}").alias("error"), F.lit(s).alias("shrinkage"), F.col(f"w{k}").alias("weights")) for k, s in enumerate(SHRINKAGES)]
    best = scored.select(*by, F.array_min(F.array(*options)).alias("b"))
    named = best.select("pool", "h_group", "b.shrinkage", F.posexplode("b.weights").alias("i", "weight")).where("weight > 0")
    return named.select("pool", "h_group", F.array(*map(F.lit, models))[F.col("i")].alias("model"), "weight", "shrinkage")


def apply(forecasts: DataFrame, weights: DataFrame, name: str = "ensemble") -> DataFrame:
    """The weighted sum of log forecasts by ``weights(h_group, model, weight)`` (with ``pool`` and ``variant``, for each pool); null where a model
    with weight has none."""
    by = [c for c in ("pool",) if c in weights.columns]
    on = [c for c in ("variant", "h_group", "model") if c in weights.columns]
    need = weights.groupBy(*by, "h_group").agg(F.count("*").alias("_need"))
    rows = forecasts.join(F.broadcast(weights), on).join(F.broadcast(need), [*by, "h_group"])
    out = rows.groupBy(*by, *SERIES, "o", "h", "t", "split", "h_group").agg(F.when(F.count("lf") == F.max("_need"), F.sum(F.col("weight") * F.col("lf"))).alias("lf"), F.first("y").alias("y"), F.first("ylag").alias("ylag"))
    return out.withColumns({"yhat": F.exp("lf"), "model": F.lit(name)})
