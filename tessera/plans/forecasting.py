"""Panel, forecast and accuracy queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT, NationalConfig
from tessera.functions import median, r6
from tessera.operators import forecast as fc
from tessera.operators import metrics as mt
from tessera.operators import panel as pn
from tessera.operators.quantiles import quantile
from tessera.plans import sql
from tessera.sources import tables as tb
from tessera.storage import materialize

MODELS = ("naive", "mean3", "seasonal_naive", "snaive_growth", "ses", "level_season")
QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def the_panel(spark: SparkSession, sf: str) -> DataFrame:
    return pn.panel(tb.monthly_sales(spark, sf))


def stored_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel as a small Parquet table (a row a series and month): what reads it several times scans the facts once."""
    return materialize(the_panel(spark, sf), "panel")


def decomposed(spark: SparkSession, sf: str, require_full: bool = True) -> DataFrame:
    return pn.decompose(stored_panel(spark, sf), require_full)


def published(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(fc.national_log(tb.national_sales(spark, sf), DEFAULT.panel.start), "published")


def local_forecasts(spark: SparkSession, sf: str, models=MODELS, p: DataFrame | None = None) -> DataFrame:
    d = pn.decompose(p) if p is not None else decomposed(spark, sf)
    return fc.forecast(fc.states(d), pn.grid(spark), models)


def national_average(spark: SparkSession, sf: str, cfg: NationalConfig = DEFAULT.national, p: DataFrame | None = None, pub: DataFrame | None = None) -> DataFrame:
    n = pn.national(p if p is not None else stored_panel(spark, sf))
    pub, grid = pub if pub is not None else published(spark, sf), pn.grid(spark)
    return fc.average(*[fc.national_forecast(n, pub, grid, m, cfg) for m in ("snaive_own", "snaive_nat", "nat_profile_g")])


def forecasts(spark: SparkSession, sf: str, models=MODELS) -> DataFrame:
    p = stored_panel(spark, sf)
    return fc.with_actuals(fc.compose(local_forecasts(spark, sf, models, p), national_average(spark, sf, p=p)), p)


@query("WITH " + sql.PANEL + " SELECT territory_id, category, cat_idx, t, CAST(month AS VARCHAR) AS month, y, round(ly, 6) + 0.0 AS ly, is_full FROM panel")
def panel_long(spark: SparkSession, sf: str) -> DataFrame:
    return the_panel(spark, sf).withColumns({"ly": r6(F.col("ly")), "month": F.col("month").cast("string")})


@query("WITH " + sql.PANEL + " SELECT territory_id, count(y) AS n_values, bool_and(is_full) AS is_full FROM panel GROUP BY territory_id")
def panel_full_mask(spark: SparkSession, sf: str) -> DataFrame:
    return the_panel(spark, sf).groupBy("territory_id").agg(F.count("y").alias("n_values"), F.bool_and("is_full").alias("is_full"))


@query("WITH " + sql.PANEL + " SELECT CAST(month AS VARCHAR) AS month, count(*) AS n_series, count(*) - count(y) AS n_missing FROM panel GROUP BY month")
def calendar_densify(spark: SparkSession, sf: str) -> DataFrame:
    return the_panel(spark, sf).groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n_series"), (F.count("*") - F.count("y")).alias("n_missing"))


@query("WITH " + sql.PANEL + " SELECT o, h, t, split, h_group FROM grid")
def grid_spine(spark: SparkSession, sf: str) -> DataFrame:
    return pn.grid(spark)


@query("WITH " + sql.PANEL + " SELECT territory_id, category, t, round(n, 6) + 0.0 AS n, round(d, 6) + 0.0 AS d FROM dec")
def decompose(spark: SparkSession, sf: str) -> DataFrame:
    return decomposed(spark, sf).select("territory_id", "category", "t", r6(F.col("n")).alias("n"), r6(F.col("d")).alias("d"))


@query("WITH " + sql.PANEL + " SELECT category, t, round(median(ly), 6) + 0.0 AS n FROM panel GROUP BY category, t")
def national_median_available(spark: SparkSession, sf: str) -> DataFrame:
    return pn.national(stored_panel(spark, sf), require_full=False).select("category", "t", r6(F.col("n")).alias("n"))


def _model(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return local_forecasts(spark, sf, (name,)).select("territory_id", "category", "o", "h", "t", r6(F.col("f")).alias("f"))

    run.__name__ = f"forecast_{name}"
    query("WITH " + sql.PANEL + "," + sql.LOCAL + f" SELECT territory_id, category, o, h, t, round(f, 6) + 0.0 AS f FROM local_f WHERE model = '{name}'")(run)


def _national(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = fc.national_forecast(pn.national(stored_panel(spark, sf)), published(spark, sf), pn.grid(spark), name)
        return out.select("category", "o", "h", "t", r6(F.col("nhat")).alias("nhat"))

    run.__name__ = f"national_{name}"
    query("WITH " + sql.PANEL + "," + sql.PUBLISHED + "," + sql.national(1) + f" SELECT category, o, h, t, round(nhat, 6) + 0.0 AS nhat FROM natf WHERE method = '{name}'")(run)


for _name in MODELS:
    _model(_name)
for _name in ("snaive_own", "snaive_nat", "nat_profile", "nat_profile_g"):
    _national(_name)


@query("WITH " + sql.PANEL + "," + sql.PUBLISHED + "," + sql.national(1) + " SELECT category, o, h, t, round(nhat, 6) + 0.0 AS nhat FROM avg3")
def national_avg3(spark: SparkSession, sf: str) -> DataFrame:
    return national_average(spark, sf).withColumn("nhat", r6(F.col("nhat")))


@query(
    " UNION ALL ".join(
        f"SELECT * FROM (WITH {sql.PANEL},{sql.PUBLISHED},{sql.national(lag)} SELECT {lag} AS lag, a.h, round(avg(abs(a.nhat - n.n)), 6) + 0.0 AS mae_log, count(a.nhat) AS n FROM avg3 a JOIN nat n ON n.category = a.category AND n.t = a.t GROUP BY a.h)"
        for lag in (0, 1, 2)
    )
)
def national_vintage_lags(spark: SparkSession, sf: str) -> DataFrame:
    """How much later publication costs: error of the national average for lags 0, 1 and 2."""
    p, pub = stored_panel(spark, sf), published(spark, sf)
    n = pn.national(p).select("category", "t", "n")
    parts = [national_average(spark, sf, NationalConfig(lag=lag), p, pub).join(n, ["category", "t"]).withColumn("lag", F.lit(lag)) for lag in (0, 1, 2)]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("lag", "h").agg(r6(F.avg(F.abs(F.col("nhat") - F.col("n")))).alias("mae_log"), F.count("nhat").alias("n"))


@query(sql.FORECASTS + " SELECT model, territory_id, category, o, h, t, round(yhat, 4) + 0.0 AS yhat, y FROM fc")
def forecast_composed(spark: SparkSession, sf: str) -> DataFrame:
    return forecasts(spark, sf).select("model", "territory_id", "category", "o", "h", "t", (F.round("yhat", 4) + 0.0).alias("yhat"), "y")


_SCORED = ", scored AS (SELECT * FROM fc WHERE y IS NOT NULL AND yhat IS NOT NULL), every AS (SELECT * EXCLUDE (split), unnest([split, 'all']) AS split FROM scored WHERE h IN (1, 3, 6, 12))"


def _scored(spark: SparkSession, sf: str, models=MODELS) -> DataFrame:
    return mt.with_all(mt.usable(forecasts(spark, sf, models)).where(F.col("h").isin(*DEFAULT.grid.horizons)))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in names})


@query(sql.FORECASTS + _SCORED + f" SELECT model, split, h, {sql.METRICS} FROM every GROUP BY model, split, h")
def metrics_by_split(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(mt.metrics(_scored(spark, sf), ["model", "split", "h"]), "MAE", "R2", "WAPE", "sMAPE", "R2_yoy")


@query(sql.FORECASTS + _SCORED + f" SELECT model, category, h, {sql.METRICS} FROM every WHERE split = 'test' GROUP BY model, category, h")
def metrics_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(mt.metrics(_scored(spark, sf).where("split = 'test'"), ["model", "category", "h"]), "MAE", "R2", "WAPE", "sMAPE", "R2_yoy")


@query(sql.FORECASTS + _SCORED + " SELECT model, h, round(median(abs(yhat - y) / y), 6) + 0.0 AS MdAPE, round(sum(yhat - y) / sum(y), 6) + 0.0 AS bias, round(sum(abs(yhat - y)) / sum(y), 6) + 0.0 AS WAPE, count(DISTINCT t) AS n_months FROM every WHERE split = 'test' GROUP BY model, h")
def extra_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(mt.extra_metrics(materialize(_scored(spark, sf).where("split = 'test'"), "scored"), ["model", "h"]), "MdAPE", "bias", "WAPE")


@query(sql.FORECASTS + _SCORED + ", m AS (SELECT model, split, h, round(avg(abs(y - yhat)), 6) AS MAE FROM every GROUP BY model, split, h) SELECT *, CAST(rank() OVER (PARTITION BY split, h ORDER BY MAE) AS INTEGER) AS rank FROM m")
def rank_models(spark: SparkSession, sf: str) -> DataFrame:
    scores = _scored(spark, sf).groupBy("model", "split", "h").agg(F.round(F.avg(F.abs(F.col("y") - F.col("yhat"))), 6).alias("MAE"))
    return mt.ranked(scores, ["split", "h"], "MAE")


@query(sql.FORECASTS + _SCORED + " SELECT model, " + ", ".join(f"round(avg(abs(y - yhat)) FILTER (WHERE h = {h}), 6) AS MAE_h{h}" for h in (1, 3, 6, 12)) + " FROM every WHERE split = 'test' GROUP BY model")
def pivot_metric(spark: SparkSession, sf: str) -> DataFrame:
    scores = _scored(spark, sf).where("split = 'test'").groupBy("model", "h").agg(F.round(F.avg(F.abs(F.col("y") - F.col("yhat"))), 6).alias("MAE"))
    return mt.pivot(scores, "model", "h", list(DEFAULT.grid.horizons), "MAE", "MAE_h")


_TRUE = " JOIN nat tn ON tn.category = every.category AND tn.t = every.t"


@query(sql.FORECASTS + _SCORED + ", e AS (SELECT every.model, every.split, every.h, avg(abs(y - yhat)) AS mae, avg(abs(y - exp(tn.n + f))) AS mae_true_n FROM every" + _TRUE + " GROUP BY ALL) SELECT model, split, h, round(mae, 6) AS mae, round(mae_true_n, 6) AS mae_true_n, round(1 - mae_true_n / mae, 6) + 0.0 AS national_share FROM e")
def error_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the error that the national component's forecast makes: the same local forecasts with its true values."""
    true = pn.national(stored_panel(spark, sf)).select("category", "t", F.col("n").alias("tn"))
    rows = _scored(spark, sf).join(F.broadcast(true), ["category", "t"])
    e = rows.groupBy("model", "split", "h").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"), F.avg(F.abs(F.col("y") - F.exp(F.col("tn") + F.col("f")))).alias("mae_true_n"))
    return e.select("model", "split", "h", F.round("mae", 6).alias("mae"), F.round("mae_true_n", 6).alias("mae_true_n"), r6(1 - F.col("mae_true_n") / F.col("mae")).alias("national_share"))


@query("WITH " + sql.PANEL + ", e AS (SELECT g.split, g.h, abs(p.y - exp(n.n + p.d)) AS e FROM grid g JOIN dec p ON p.t = g.t JOIN nat n ON n.category = p.category AND n.t = g.t WHERE p.y IS NOT NULL) SELECT split, h, round(max(e), 4) + 0.0 AS max_error, count(*) AS n FROM e GROUP BY split, h")
def oracle_true_components(spark: SparkSession, sf: str) -> DataFrame:
    """Plumbing check: true n and true d give back y."""
    p = decomposed(spark, sf).where("y is not null and d is not null")
    rows = p.join(F.broadcast(pn.grid(spark)), "t").withColumn("e", F.abs(F.col("y") - F.exp(F.col("n") + F.col("d"))))
    return rows.groupBy("split", "h").agg((F.round(F.max("e"), 4) + 0.0).alias("max_error"), F.count("*").alias("n"))


@query(
    sql.FORECASTS + """, sw AS (SELECT fc.split, fc.h, abs(fc.y - exp(fc.nhat + d.d)) AS true_d, abs(fc.y - exp(tn.n + fc.f)) AS true_n, abs(fc.y - fc.yhat) AS neither FROM fc
  JOIN dec d ON d.territory_id = fc.territory_id AND d.category = fc.category AND d.t = fc.t JOIN nat tn ON tn.category = fc.category AND tn.t = fc.t
  WHERE fc.model = 'level_season' AND fc.y IS NOT NULL AND fc.yhat IS NOT NULL AND d.d IS NOT NULL)
SELECT split, h, round(avg(true_d), 4) + 0.0 AS mae_true_d, round(avg(true_n), 4) + 0.0 AS mae_true_n, round(avg(neither), 4) + 0.0 AS mae, count(*) AS n FROM sw GROUP BY split, h"""
)
def swapped_components(spark: SparkSession, sf: str) -> DataFrame:
    """Which component the error comes from: true local deviations with the forecast shared component, and the reverse."""
    true = decomposed(spark, sf).where("d is not null").select(*pn.SERIES, "t", F.col("n").alias("tn"), "d")
    rows = mt.usable(forecasts(spark, sf, ("level_season",))).join(true, [*pn.SERIES, "t"])
    error = lambda log_forecast: (F.round(F.avg(F.abs(F.col("y") - F.exp(log_forecast))), 4) + 0.0)
    return rows.groupBy("split", "h").agg(error(F.col("nhat") + F.col("d")).alias("mae_true_d"), error(F.col("tn") + F.col("f")).alias("mae_true_n"), error(F.col("lf")).alias("mae"), F.count("*").alias("n"))


@query(
    "WITH " + sql.PANEL + "," + sql.PUBLISHED + "," + sql.national(1) + """,
last AS (SELECT a.territory_id, a.category, a.t AS o, arg_max(b.d, b.t) FILTER (WHERE b.d IS NOT NULL) AS d
  FROM dec a JOIN dec b ON a.territory_id = b.territory_id AND a.category = b.category AND b.t <= a.t WHERE NOT a.is_full GROUP BY ALL)
SELECT p.territory_id, p.category, v.o, v.h, round(exp(v.nhat + l.d), 4) + 0.0 AS yhat, p.y
FROM last l JOIN avg3 v ON v.category = l.category AND v.o = l.o JOIN panel p ON p.territory_id = l.territory_id AND p.category = l.category AND p.t = v.t
WHERE p.y IS NOT NULL"""
)
def partial_series_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Incomplete territories: the last local deviation on the national forecast."""
    d = decomposed(spark, sf).where("not is_full")
    f = fc.compose(fc.forecast(fc.states(d), pn.grid(spark), ("naive",)), national_average(spark, sf))
    return fc.with_actuals(f, the_panel(spark, sf)).where("y is not null and nhat is not null").select("territory_id", "category", "o", "h", (F.round("yhat", 4) + 0.0).alias("yhat"), "y")


@query(
    sql.FORECASTS + """,
bounds AS (SELECT a.territory_id, a.category, a.t AS o, min(b.ly) - ln(3.0) AS lo, max(b.ly) + ln(3.0) AS hi, arg_max(b.ly, b.t) FILTER (WHERE b.ly IS NOT NULL) AS last
  FROM panel a JOIN panel b ON a.territory_id = b.territory_id AND a.category = b.category AND b.t <= a.t GROUP BY a.territory_id, a.category, a.t),
g AS (SELECT f.*, coalesce(lf < lo OR lf > hi, false) AS replaced, last FROM fc f JOIN bounds b ON b.territory_id = f.territory_id AND b.category = f.category AND b.o = f.o)
SELECT model, h, count(*) FILTER (WHERE replaced) AS n_replaced, count(*) AS n, round(avg(CASE WHEN replaced THEN last ELSE lf END), 6) + 0.0 AS mean_lf FROM g GROUP BY model, h"""
)
def divergence_guard(spark: SparkSession, sf: str) -> DataFrame:
    rows = fc.guard(forecasts(spark, sf), the_panel(spark, sf))
    return rows.groupBy("model", "h").agg(F.count(F.when(F.col("replaced"), 1)).alias("n_replaced"), F.count("*").alias("n"), r6(F.avg("lf")).alias("mean_lf"))


@query("WITH " + sql.PANEL + ", s AS (SELECT category, territory_id, var_pop(ly) * count(ly) AS tot, var_pop(ly - n) * count(ly - n) AS rest FROM dec WHERE is_full GROUP BY category, territory_id) SELECT category, round(1 - sum(rest) / sum(tot), 6) + 0.0 AS shared_share FROM s GROUP BY category")
def variance_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the variance within series that the national component explains."""
    s = decomposed(spark, sf).where("is_full").groupBy("category", "territory_id").agg((F.var_pop("ly") * F.count("ly")).alias("tot"), (F.var_pop("d") * F.count("d")).alias("rest"))
    return s.groupBy("category").agg(r6(1 - F.sum("rest") / F.sum("tot")).alias("shared_share"))


@query("WITH " + sql.PANEL + ", s AS (SELECT territory_id, t, sum(y) FILTER (WHERE cat_idx > 0) / max(y) FILTER (WHERE cat_idx = 0) AS r FROM panel WHERE is_full GROUP BY territory_id, t), m AS (SELECT territory_id, median(r) AS r FROM s GROUP BY territory_id) SELECT round(median(r), 6) AS median_ratio, count(*) AS n FROM m")
def parts_to_total(spark: SparkSession, sf: str) -> DataFrame:
    s = the_panel(spark, sf).where("is_full").groupBy("territory_id", "t").agg((F.sum(F.when(F.col("cat_idx") > 0, F.col("y"))) / F.max(F.when(F.col("cat_idx") == 0, F.col("y")))).alias("r"))
    own = materialize(s.groupBy("territory_id").agg(median("r").alias("r")), "ratios")  # a territory has a ratio a month
    return quantile(own, [], "r", 0.5, "m").crossJoin(own.agg(F.count("*").alias("n"))).select(F.round("m", 6).alias("median_ratio"), "n")


@query("WITH " + sql.PANEL + ", g AS (SELECT category, territory_id, avg(ly) FILTER (WHERE t >= 12) - avg(ly) FILTER (WHERE t < 12) AS g FROM panel WHERE is_full GROUP BY category, territory_id) SELECT category, round(100 * (exp(avg(g)) - 1), 4) + 0.0 AS growth_pct FROM g GROUP BY category")
def mean_growth(spark: SparkSession, sf: str) -> DataFrame:
    g = the_panel(spark, sf).where("is_full").groupBy("category", "territory_id").agg((F.avg(F.when(F.col("t") >= 12, F.col("ly"))) - F.avg(F.when(F.col("t") < 12, F.col("ly")))).alias("g"))
    return g.groupBy("category").agg((F.round(100 * (F.exp(F.avg("g")) - 1), 4) + 0.0).alias("growth_pct"))


@query(
    "WITH " + sql.PANEL + "," + sql.PUBLISHED + """,
last AS (SELECT category, max(n) FILTER (WHERE t = 23) - max(n) FILTER (WHERE t = 11) AS g FROM nat GROUP BY category),
f AS (SELECT n.category, n.t + 12 AS t, n.n + 0.5 * l.g AS nhat FROM nat n JOIN last l USING (category) WHERE n.t BETWEEN 12 AND 23),
e AS (SELECT f.category, avg(f.nhat) - avg(n.n) AS fg, avg(p1.l) - avg(p0.l) AS ag FROM f JOIN nat n ON n.category = f.category AND n.t = f.t - 12
  JOIN pub p1 ON p1.category = f.category AND p1.t = f.t JOIN pub p0 ON p0.category = f.category AND p0.t = f.t - 12 GROUP BY f.category)
SELECT category, round(100 * (exp(fg) - 1), 4) + 0.0 AS forecast_growth_pct, round(100 * (exp(ag) - 1), 4) + 0.0 AS published_growth_pct FROM e"""
)
def external_check(spark: SparkSession, sf: str) -> DataFrame:
    """The year after the panel: national growth forecast at the last month against what the published series show."""
    n = pn.national(stored_panel(spark, sf)).select("category", "t", "n")
    g = n.groupBy("category").agg((F.max(F.when(F.col("t") == 23, F.col("n"))) - F.max(F.when(F.col("t") == 11, F.col("n")))).alias("g"))
    f = n.where("t between 12 and 23").join(g, "category").select("category", (F.col("t") + 12).alias("t"), F.col("n").alias("n0"), (F.col("n") + 0.5 * F.col("g")).alias("nhat"))
    pub = published(spark, sf)
    before = pub.select("category", (F.col("t") + 12).alias("t"), F.col("l").alias("l0"))
    e = f.join(pub, ["category", "t"]).join(before, ["category", "t"]).groupBy("category").agg((F.avg("nhat") - F.avg("n0")).alias("fg"), (F.avg("l") - F.avg("l0")).alias("ag"))
    return e.select("category", (F.round(100 * (F.exp("fg") - 1), 4) + 0.0).alias("forecast_growth_pct"), (F.round(100 * (F.exp("ag") - 1), 4) + 0.0).alias("published_growth_pct"))


@query(sql.FORECASTS + " SELECT h, territory_id, t, round(avg(ea - eb), 6) + 0.0 AS diff FROM (SELECT h, territory_id, category, o, t, max(abs(y - yhat)) FILTER (WHERE model = 'level_season') AS ea, max(abs(y - yhat)) FILTER (WHERE model = 'naive') AS eb FROM fc WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY ALL) WHERE ea IS NOT NULL AND eb IS NOT NULL GROUP BY h, territory_id, t")
def monthly_loss(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(mt.monthly_loss(forecasts(spark, sf, ("level_season", "naive")), "level_season", "naive"), "diff")


_Q = """, q AS (SELECT a.territory_id, a.category, a.t AS o, quantile_cont(b.d, 0.1) AS lo, quantile_cont(b.d, 0.5) AS mid, quantile_cont(b.d, 0.9) AS hi
  FROM dec a JOIN dec b ON a.territory_id = b.territory_id AND a.category = b.category AND b.t <= a.t WHERE a.d IS NOT NULL GROUP BY a.territory_id, a.category, a.t),
iv AS (SELECT g.split, g.h, p.d AS y, q.lo, q.mid, q.hi, abs(p.d - q.mid) / greatest((q.hi - q.lo) / 2, 1e-9) AS s
  FROM q JOIN grid g ON g.o = q.o JOIN dec p ON p.territory_id = q.territory_id AND p.category = q.category AND p.t = g.t WHERE p.d IS NOT NULL),
w AS (SELECT h, quantile_cont(s, 0.8) AS q FROM iv WHERE split = 'val' GROUP BY h)"""


@query("WITH " + sql.PANEL + _Q + " SELECT iv.h, round(max(w.q), 6) + 0.0 AS q, round(avg((y BETWEEN lo AND hi)::INT), 6) AS raw_coverage, round(avg((s <= w.q)::INT), 6) AS conformal_coverage, count(*) AS n FROM iv JOIN w USING (h) WHERE split = 'test' GROUP BY iv.h")
def conformal_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals from quantiles of the history (10, 50, 90 %), before and after conformal widening."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*pn.SERIES).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    d = decomposed(spark, sf).where("d is not null")
    q = d.select(*pn.SERIES, F.col("t").alias("o"), *[F.percentile("d", F.lit(p)).over(w).alias(c) for c, p in (("lo", 0.1), ("mid", 0.5), ("hi", 0.9))])
    rows = materialize(q.join(F.broadcast(pn.grid(spark)), "o").join(d.select(*pn.SERIES, "t", F.col("d").alias("y")), [*pn.SERIES, "t"]), "intervals")
    return _rounded(mt.interval_scores(rows, "lo", "mid", "hi"), "q", "raw_coverage", "conformal_coverage")
