"""Panel forecasters. History up to an origin is summed up by windows in one pass (one shuffle for all models and origins);
forecasts follow by joining the backtest's grid to these states. No state looks past its origin."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import DEFAULT, NationalConfig
from tessera.operators.panel import SERIES


def _mean(a: Column) -> Column:
    """Mean of an array without its nulls; null if nothing is left."""
    some = F.filter(a, lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda s, x: s + x) / F.size(some))


def states(p: DataFrame, value: str = "d", alpha: float = 0.5, k: int = 3) -> DataFrame:
    """Of each series and month ``o`` what the models need of its history: ``last`` valid value, ``mean_k``, ``mean12``,
    ``season`` (the values 11, ..., 0 months back), yearly ``growth`` and exponentially smoothed ``level``."""
    w = Window.partitionBy(*SERIES).orderBy("t")
    v, past = F.col(value), w.rowsBetween(Window.unboundedPreceding, 0)
    rows = p.select(
        *SERIES, "cat_idx", F.col("t").alias("o"), v.alias("now"),
        F.last(v, ignorenulls=True).over(past).alias("last"),
        F.avg(v).over(w.rowsBetween(1 - k, 0)).alias("mean_k"),
        F.avg(v).over(w.rowsBetween(-11, 0)).alias("mean12"),
        F.array(*[F.lag(v, 11 - i).over(w) for i in range(12)]).alias("season"),
        F.lag(v, 12).over(w).alias("year_ago"),
        F.transform(F.collect_list(F.struct(v.alias("v"))).over(past), lambda s: s["v"]).alias("history"),
    )
    half = F.floor((F.col("o") + 1) / 2).cast("int")
    trend = 12 / half * (_mean(F.slice("history", F.col("o") + 2 - half, half)) - _mean(F.slice("history", F.lit(1), half)))
    smooth = F.aggregate("history", F.lit(None).cast("double"), lambda s, x: F.when(x.isNull(), s).when(s.isNull(), x).otherwise(alpha * x + (1 - alpha) * s))
    return rows.withColumns({
        "mean_k": F.coalesce("mean_k", "last"),
        "growth": F.when(F.col("o") >= 12, F.col("now") - F.col("year_ago")).when(half > 0, trend),
        "level": smooth,
    }).drop("history", "year_ago")


#: name -> expression over a state row and the horizon ``h``. ``register`` adds others.
MODELS: dict[str, Callable[[], Column]] = {
    "naive": lambda: F.col("last"),
    "mean3": lambda: F.col("mean_k"),
    "seasonal_naive": lambda: seasonal(),
    "snaive_growth": lambda: seasonal() + F.col("growth"),
    "ses": lambda: F.col("level"),
    "level_season": lambda: F.col("mean_k") + 0.3 * F.coalesce(seasonal() - F.col("mean12"), F.lit(0.0)),
}


def seasonal() -> Column:
    """The value 12 months before the target (horizons up to 12)."""
    return F.element_at("season", F.col("h"))


def register(name: str, expression: Callable[[], Column]) -> None:
    MODELS[name] = expression


def forecast(state: DataFrame, grid: DataFrame, models: Sequence[str]) -> DataFrame:
    """``model, territory_id, category, cat_idx, o, h, t, split, h_group, f``: one row for each model and target."""
    rows = state.join(F.broadcast(grid), "o")
    made = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), MODELS[m]().alias("f")) for m in models])).alias("m")
    rows = rows.select(*SERIES, "cat_idx", "o", "h", "t", "split", "h_group", made)
    return rows.select("m.model", *SERIES, "cat_idx", "o", "h", "t", "split", "h_group", "m.f")


def national_log(national: DataFrame, start: str) -> DataFrame:
    """Published series ``category, month, value`` to ``category, t, l``: logs, months counted from the panel's start (earlier ones are negative)."""
    t = F.round(F.months_between("month", F.lit(start).cast("date"))).cast("int")
    return national.select("category", t.alias("t"), F.log("value").alias("l"))


def national_forecast(n: DataFrame, published: DataFrame, grid: DataFrame, method: str, cfg: NationalConfig = DEFAULT.national) -> DataFrame:
    """``category, o, h, t, nhat``. Methods: ``snaive_own`` (last year plus own damped growth), ``snaive_nat`` (plus the published
    series' growth as of origin - lag), ``nat_profile`` (n at the origin plus the mean change from origin month to
    target month over past published years), ``nat_profile_g`` (with the typical growth replaced by the current one).

    Every joined month is at most origin - lag for published values and origin for own ones. All tables here have a
    row for each category and month.
    """
    cells = n.select("category").distinct().crossJoin(grid.select("o", "h", "t"))
    at = lambda df, name, month: df.select("category", F.col("t").alias(month), F.col(df.columns[-1]).alias(name))
    own, pub = n.select("category", "t", "n"), published.select("category", "t", "l")

    def with_(rows: DataFrame, df: DataFrame, name: str, month: Column) -> DataFrame:
        return rows.withColumn("_m", month).join(at(df, name, "_m"), ["category", "_m"], "left").drop("_m")

    if method == "snaive_own":
        w = Window.partitionBy("category").orderBy("t")
        history = F.collect_list("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
        k = F.floor((F.col("o") + 1) / 2).cast("int")
        state = n.select("category", F.col("t").alias("o"), F.col("n").alias("now"), F.lag("n", 12).over(w).alias("ago"), history.alias("hist"))
        trend = 12 / k * (_mean(F.slice("hist", F.col("o") + 2 - k, k)) - _mean(F.slice("hist", F.lit(1), k)))
        state = state.select("category", "o", F.when(F.col("o") >= 12, F.col("now") - F.col("ago")).when(k > 0, trend).alias("g"))
        rows = with_(cells.join(state, ["category", "o"]), own, "base", F.col("t") - 12)
        return rows.select("category", "o", "h", "t", (F.col("base") + cfg.damping * F.col("g")).alias("nhat"))
    if method == "snaive_nat":
        rows = with_(cells, own, "base", F.col("t") - 12)
        rows = with_(with_(rows, pub, "a", F.col("o") - cfg.lag), pub, "b", F.col("o") - cfg.lag - 12)
        return rows.select("category", "o", "h", "t", (F.col("base") + cfg.damping * (F.col("a") - F.col("b"))).alias("nhat"))
    if method not in ("nat_profile", "nat_profile_g"):
        raise ValueError(method)
    first = published.agg(F.min("t").alias("first"))
    past = cells.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(cfg.years + (1 if cfg.lag else 0))))).crossJoin(F.broadcast(first))
    past = past.where((F.col("t") - 12 * F.col("k") <= F.col("o") - cfg.lag) & (F.col("o") - 12 * F.col("k") - 12 >= F.col("first")))
    past = past.withColumn("r", F.row_number().over(Window.partitionBy("category", "o", "h").orderBy("k"))).where(F.col("r") <= cfg.years)
    for name, month in (("lt", F.col("t") - 12 * F.col("k")), ("lo", F.col("o") - 12 * F.col("k")), ("lp", F.col("o") - 12 * F.col("k") - 12)):
        past = with_(past, pub, name, month)
    rows = past.groupBy("category", "o", "h", "t").agg(F.avg(F.col("lt") - F.col("lo")).alias("delta"), F.avg(F.col("lo") - F.col("lp")).alias("growth"))
    rows = with_(rows, own, "base", F.col("o"))
    out = F.col("base") + F.col("delta")
    if method == "nat_profile_g":
        rows = with_(with_(rows, pub, "a", F.col("o") - cfg.lag), pub, "b", F.col("o") - cfg.lag - 12)
        out = out + F.col("h") / 12 * cfg.damping * (F.col("a") - F.col("b") - F.col("growth"))
    return rows.select("category", "o", "h", "t", out.alias("nhat"))


def average(*forecasts: DataFrame) -> DataFrame:
    """Mean of national forecasts (null if one is missing)."""
    every = forecasts[0]
    for f in forecasts[1:]:
        every = every.unionByName(f)
    return every.groupBy("category", "o", "h", "t").agg(F.when(F.count("nhat") == len(forecasts), F.avg("nhat")).alias("nhat"))


def compose(local: DataFrame, nhat: DataFrame) -> DataFrame:
    """``yhat = exp(nhat + f)`` and its log ``lf`` for local forecasts ``f``; nhat has a row for each category, origin and horizon."""
    rows = local.join(F.broadcast(nhat.select("category", "o", "h", "nhat")), ["category", "o", "h"], "left")
    return rows.withColumn("lf", F.col("nhat") + F.col("f")).withColumn("yhat", F.exp("lf"))


def with_actuals(forecasts: DataFrame, p: DataFrame) -> DataFrame:
    """Forecasts with ``y`` of the target month and ``ylag``, a year before it."""
    w = Window.partitionBy(*SERIES).orderBy("t")
    own = p.select(*SERIES, "t", "y", F.lag("y", 12).over(w).alias("ylag"))
    return forecasts.join(own, [*SERIES, "t"])


def guard(forecasts: DataFrame, p: DataFrame, factor: float = 3.0) -> DataFrame:
    """Log forecasts further than ``factor`` outside the history up to the origin become the last value; ``replaced`` tells."""
    w = Window.partitionBy(*SERIES).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    hist = p.select(*SERIES, F.col("t").alias("o"), F.min("ly").over(w).alias("lo"), F.max("ly").over(w).alias("hi"), F.last("ly", ignorenulls=True).over(w).alias("last_ly"))
    margin = F.log(F.lit(factor))
    bad = F.coalesce((F.col("lf") < F.col("lo") - margin) | (F.col("lf") > F.col("hi") + margin), F.lit(False))
    rows = forecasts.join(hist, [*SERIES, "o"]).withColumn("replaced", bad)
    return rows.withColumn("lf", F.when(F.col("replaced"), F.col("last_ly")).otherwise(F.col("lf"))).withColumn("yhat", F.exp("lf")).drop("lo", "hi", "last_ly")
