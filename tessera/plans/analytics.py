"""Ensembles, features, retrospective change points, significance and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT, GridConfig
from tessera.functions import r6, stats
from tessera.operators import direct, ensemble, features, forecast, metrics, offline, plugins, synthetic
from tessera.operators import panel as pn
from tessera.plans import sql
from tessera.plans.sql import _U, _poisson_sql
from tessera.plans.detection import KEYS, NEAR, SRC, _cusum_w, _P, deviations, near, real_alarms, streams_sql
from tessera.plans.forecasting import MODELS, decomposed, forecasts, local_forecasts, national_average, published, stored_panel
from tessera.sources import tables as tb
from tessera.storage import materialize
from tessera.streaming import online

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


#: Pools of the ablations: with all members, with the three simplest, and on a national forecast without the published series.
POOLS = {"full": ("average", MODELS), "simple": ("average", ("naive", "mean3", "ses")), "own_only": ("own", MODELS)}


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """Local forecasts on the national average and on the national forecast that needs no published series."""
    p = stored_panel(spark, sf)
    local = materialize(local_forecasts(spark, sf, MODELS, p), "local")
    own = forecast.national_forecast(pn.national(p), published(spark, sf), pn.grid(spark), "snaive_own")
    made = {"average": national_average(spark, sf, p=p), "own": own}
    rows = [forecast.with_actuals(forecast.compose(local, n), p).withColumn("variant", F.lit(v)) for v, n in made.items()]
    return materialize(rows[0].unionByName(rows[1]), "variants")


_N = len(MODELS)
_SUM = " + ".join(f"taken[{i}] * p[{i}]" for i in range(1, _N + 1))
_ERR = ", ".join(f"CASE WHEN any_value(allowed)[{i}] THEN round(avg(abs(y - exp(({_SUM} + p[{i}]) / (step + 1)))), 9) ELSE CAST('inf' AS DOUBLE) END" for i in range(1, _N + 1))
_VARIANTS = sql.FORECASTS.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
vf AS (SELECT 'average' AS variant, model, territory_id, category, o, h, t, split, h_group, lf, y FROM fc
  UNION ALL SELECT 'own', f.model, f.territory_id, f.category, f.o, f.h, f.t, f.split, f.h_group, n.nhat + f.f, f.y FROM fc f LEFT JOIN natf n ON n.method = 'snaive_own' AND n.category = f.category AND n.o = f.o AND n.h = f.h),
pools AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}', [{', '.join(str(m in some).lower() for m in MODELS)}])" for k, (v, some) in POOLS.items())}) v(pool, variant, allowed)),
wide AS (SELECT variant, split, h_group, territory_id, category, o, h, t, max(y) AS y, [{", ".join(f"max(lf) FILTER (WHERE model = '{m}')" for m in MODELS)}] AS p FROM vf WHERE y IS NOT NULL GROUP BY ALL),
every AS (SELECT pool, split, h_group, h, y, list_transform(p, lambda v: coalesce(v, 0.0)) AS p, allowed FROM wide JOIN pools USING (variant)
  WHERE len(list_filter(range(1, {_N + 1}), lambda i: allowed[i] AND p[i] IS NULL)) = 0),
cel AS (SELECT * FROM every WHERE split = 'val'),
sel AS (SELECT DISTINCT pool, h_group, 0 AS step, [{", ".join(["CAST(0 AS DOUBLE)"] * _N)}] AS taken FROM cel
  UNION ALL SELECT pool, h_group, step + 1, list_transform(range(1, {_N + 1}), lambda i: taken[i] + (i = list_position(e, list_min(e)))::INT)
  FROM (SELECT c.pool, c.h_group, step, any_value(taken) AS taken, [{_ERR}] AS e FROM sel JOIN cel c USING (pool, h_group) WHERE step < {ensemble.ADDITIONS} GROUP BY c.pool, c.h_group, step)),
fin AS (SELECT * FROM sel WHERE step = {ensemble.ADDITIONS}),
opt AS (SELECT pool, h_group, allowed, s AS shrinkage, list_transform(range(1, {_N + 1}), lambda i: (1 - s) * taken[i] / {ensemble.ADDITIONS} + CASE WHEN allowed[i] THEN s / len(list_filter(allowed, lambda a: a)) ELSE 0 END) AS w
  FROM fin JOIN pools USING (pool) CROSS JOIN (SELECT CAST(unnest({list(ensemble.SHRINKAGES)}) AS DOUBLE) AS s)),
dot AS (SELECT o.pool, o.h_group, o.shrinkage, any_value(o.w) AS w, round(avg(abs(y - exp({" + ".join(f"w[{i}] * p[{i}]" for i in range(1, _N + 1))}))), 9) AS e FROM opt o JOIN cel USING (pool, h_group) GROUP BY ALL),
best AS (SELECT pool, h_group, arg_min(shrinkage, (e, shrinkage)) AS shrinkage, arg_min(w, (e, shrinkage)) AS w FROM dot GROUP BY pool, h_group)"""


@query(_VARIANTS + f" SELECT pool, h_group, [{', '.join(repr(m) for m in MODELS)}][i] AS model, round(w[i], 6) AS weight, shrinkage FROM best CROSS JOIN (SELECT unnest(range(1, {_N + 1})) AS i) WHERE w[i] > 0")
def ensemble_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy selection of three pools at once, by horizon group: weights as rows."""
    return ensemble.choose(variants(spark, sf), MODELS, POOLS).withColumn("weight", F.round("weight", 6))


@query(
    sql.FORECASTS + """, w AS (SELECT * FROM (VALUES ('naive', 0.5), ('level_season', 0.3), ('seasonal_naive', 0.2)) v(model, w)),
e AS (SELECT territory_id, category, o, h, t, split, max(y) AS y, CASE WHEN count(lf) = 3 THEN exp(sum(w * lf)) END AS yhat FROM fc JOIN w USING (model) GROUP BY ALL)
SELECT split, h, round(avg(abs(y - yhat)), 4) + 0.0 AS MAE, count(*) AS n FROM e WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY split, h"""
)
def ensemble_apply(spark: SparkSession, sf: str) -> DataFrame:
    fixed = {"naive": 0.5, "level_season": 0.3, "seasonal_naive": 0.2}
    weights = spark.createDataFrame([(g, m, w) for g in range(len(DEFAULT.grid.groups)) for m, w in fixed.items()], "h_group int, model string, weight double")
    e = metrics.usable(ensemble.apply(forecasts(spark, sf, tuple(fixed)), weights))
    return e.groupBy("split", "h").agg((F.round(F.avg(F.abs(F.col("y") - F.col("yhat"))), 4) + 0.0).alias("MAE"), F.count("*").alias("n"))


_TEST = _VARIANTS + f""",
ens AS (SELECT pool, h, round(avg(abs(y - exp({" + ".join(f"w[{i}] * coalesce(p[{i}], 0)" for i in range(1, _N + 1))}))), 6) AS MAE, count(*) AS n
  FROM wide JOIN pools USING (variant) JOIN best USING (pool, h_group) WHERE split = 'test' AND len(list_filter(range(1, {_N + 1}), lambda i: w[i] > 0 AND p[i] IS NULL)) = 0 GROUP BY pool, h),
one AS (SELECT model, h, round(avg(abs(y - exp(lf))), 6) AS MAE FROM vf WHERE variant = 'average' AND split = 'test' AND y IS NOT NULL AND lf IS NOT NULL GROUP BY model, h)"""


@query(_TEST + " SELECT 'ensemble' AS model, h, MAE FROM ens WHERE pool = 'full' UNION ALL SELECT model, h, MAE FROM one")
def ensemble_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """The selected ensemble against its members on test targets."""
    f = variants(spark, sf)
    w = ensemble.choose(f, MODELS, {"full": POOLS["full"]})
    f = f.where("variant = 'average'")
    e = ensemble.apply(f, w.drop("pool"))
    rows = metrics.usable(f.select("model", "split", "h", "y", "yhat").unionByName(e.select("model", "split", "h", "y", "yhat"))).where("split = 'test'")
    return rows.groupBy("model", "h").agg(r6(F.avg(F.abs(F.col("y") - F.col("yhat")))).alias("MAE"))


@query(_TEST + """, hind AS (SELECT h, arg_min(model, (MAE, model)) AS best_model, min(MAE) AS best_MAE FROM one GROUP BY h)
SELECT pool, h, ens.MAE, n, best_model, best_MAE, round(ens.MAE / best_MAE - 1, 6) + 0.0 AS over_best FROM ens JOIN hind USING (h)""")
def ensemble_ablations(spark: SparkSession, sf: str) -> DataFrame:
    """Each pool's ensemble on test targets, against the single model that is best there in hindsight."""
    f = variants(spark, sf)
    variant = ensemble.pools_table(f, POOLS, MODELS).select("pool", "variant")
    w = ensemble.choose(f, MODELS, POOLS).join(F.broadcast(variant), "pool")
    error = F.round(F.avg(F.abs(F.col("y") - F.col("yhat"))), 6).alias("MAE")
    e = metrics.usable(ensemble.apply(f, w)).where("split = 'test'").groupBy("pool", "h").agg(error, F.count("*").alias("n"))
    one = metrics.usable(f.where("variant = 'average' and split = 'test'")).groupBy("model", "h").agg(error)
    hind = one.groupBy("h").agg(F.min_by("model", F.struct("MAE", "model")).alias("best_model"), F.min("MAE").alias("best_MAE"))
    return e.join(hind, "h").withColumn("over_best", r6(F.col("MAE") / F.col("best_MAE") - 1))


@query(
    sql.FORECASTS + ", src AS (SELECT territory_id, category, cat_idx, t, d FROM dec WHERE is_full)" + streams_sql("src", "territory_id, category") + f""",
s AS (SELECT territory_id, category, t, {_cusum_w("c", _P)} AS score FROM st),
al AS (SELECT territory_id, category, t, round(score, 9) > round((SELECT quantile_cont(score, 0.95) FROM s WHERE t BETWEEN 12 AND 23), 9) AS alarm FROM s WHERE t BETWEEN 12 AND 23),
re AS (SELECT territory_id, category, t AS o FROM al WHERE alarm UNION SELECT territory_id, category, t + 1 FROM al WHERE alarm),
lk AS (SELECT w, f.split, f.h, f.y, exp(f.nhat + f.f + CASE WHEN re.o IS NOT NULL THEN w * (d.d - f.f) ELSE 0 END) AS yhat
  FROM fc f JOIN dec d ON d.territory_id = f.territory_id AND d.category = f.category AND d.t = f.o LEFT JOIN re ON re.territory_id = f.territory_id AND re.category = f.category AND re.o = f.o
  CROSS JOIN (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS w) WHERE f.model = 'mean3' AND d.is_full)
SELECT w, split, h, round(avg(abs(y - yhat)), 4) + 0.0 AS MAE, count(*) AS n FROM lk WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY w, split, h"""
)
def forecast_link(spark: SparkSession, sf: str) -> DataFrame:
    """After an alarm at the origin or the month before it, the local forecast moves by w towards the current value."""
    a = real_alarms(spark, sf).where("alarm").select(*KEYS, F.explode(F.array(F.col("t"), F.col("t") + 1)).alias("o")).distinct().withColumn("near_alarm", F.lit(True))
    now = decomposed(spark, sf).where("is_full").select(*KEYS, F.col("t").alias("o"), "d")
    f = forecasts(spark, sf, ("mean3",)).join(now, [*KEYS, "o"]).join(a, [*KEYS, "o"], "left")
    f = f.withColumn("w", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))))
    moved = F.col("f") + F.when(F.col("near_alarm"), F.col("w") * (F.col("d") - F.col("f"))).otherwise(F.lit(0.0))
    rows = metrics.usable(f.withColumn("yhat", F.exp(F.col("nhat") + moved)))
    return rows.groupBy("w", "split", "h").agg((F.round(F.avg(F.abs(F.col("y") - F.col("yhat"))), 4) + 0.0).alias("MAE"), F.count("*").alias("n"))


_SHOWN = ("d_l0", "d_l3", "d_l5", "d_mean3", "d_mean6", "d_std6", "d_slope6", "d_seas", "d_t12", "d_yoy", "d_all0", "d_mo_mean0", "nb_mean0", "nb_gap0", "nb_chg3", "reg_mean0", "reg_chg3")


@query(
    SRC.replace("cat_idx, t, d FROM", "cat_idx, t, month, ly, d FROM") + NEAR + """,
nb AS (SELECT n.src AS territory_id, s.category, s.t, avg(s.d) AS m FROM near n JOIN src s ON s.territory_id = n.dst GROUP BY n.src, s.category, s.t),
b AS (SELECT s.*, n_regionkey AS region, nb.m, max(CASE WHEN cat_idx = 0 THEN d END) OVER (PARTITION BY s.territory_id, s.t) AS da, avg(d) OVER (PARTITION BY s.territory_id, s.t) AS dm,
  avg(d) OVER (PARTITION BY n_regionkey, s.category, s.t) AS rm FROM src s JOIN nation ON n_nationkey = s.territory_id LEFT JOIN nb ON nb.territory_id = s.territory_id AND nb.category = s.category AND nb.t = s.t),
f AS (SELECT *, lag(d, 3) OVER w AS l3, lag(d, 5) OVER w AS l5, avg(d) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3, avg(d) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS m6,
  stddev_pop(d) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s6, avg(d) OVER (w ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS p3, avg(d) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS m12,
  lag(d, 12) OVER w AS l12, lag(m, 3) OVER w AS nb3, lag(rm, 3) OVER w AS rm3 FROM b WINDOW w AS (PARTITION BY territory_id, category ORDER BY t))
SELECT f.territory_id, f.category, g.o, g.h, round(f.d, 6) + 0.0 AS d_l0, round(l3, 6) + 0.0 AS d_l3, round(l5, 6) + 0.0 AS d_l5, round(m3, 6) + 0.0 AS d_mean3, round(m6, 6) + 0.0 AS d_mean6, round(s6, 6) + 0.0 AS d_std6,
  round((m3 - p3) / 3, 6) + 0.0 AS d_slope6, round(y.d - m12, 6) + 0.0 AS d_seas, round(y.d, 6) + 0.0 AS d_t12, round(f.d - l12, 6) + 0.0 AS d_yoy, round(da, 6) + 0.0 AS d_all0, round(dm, 6) + 0.0 AS d_mo_mean0,
  round(m, 6) + 0.0 AS nb_mean0, round(f.d - m, 6) + 0.0 AS nb_gap0, round(m - nb3, 6) + 0.0 AS nb_chg3, round(rm, 6) + 0.0 AS reg_mean0, round(rm - rm3, 6) + 0.0 AS reg_chg3
FROM f JOIN grid g ON g.o = f.t JOIN src y ON y.territory_id = f.territory_id AND y.category = f.category AND y.t = g.t - 12"""
)
def features_oh(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.features(decomposed(spark, sf).where("is_full"), near(spark, sf), tb.regions(spark, sf), pn.grid(spark))
    return rows.select("territory_id", "category", "o", "h", *[r6(F.col(c)).alias(c) for c in _SHOWN])


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Features of all pairs of origin and horizon from the third month on, also those that no forecast is scored for."""
    cfg = GridConfig(first_origin=2, last_origin=DEFAULT.panel.months - 1, val=(0, 0))
    rows = features.features(decomposed(spark, sf).where("is_full"), near(spark, sf), tb.regions(spark, sf), pn.grid(spark, cfg))
    return materialize(rows, "features")


ORIGINS = range(DEFAULT.grid.first_origin, DEFAULT.grid.last_origin + 1)


@query()
def boosted_direct(spark: SparkSession, sf: str) -> DataFrame:
    """The direct model at every origin, for every horizon."""
    rows = _pairs(spark, sf)
    out = direct.forecast(rows, materialize(direct.models(rows, ORIGINS), "models")).join(F.broadcast(pn.grid(spark).select("o", "h")), ["o", "h"])
    return out.select("territory_id", "category", "o", "h", r6(F.col("f")).alias("f"))


@query()
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Mean gain of each feature over the models of all origins."""
    return direct.importance(direct.models(_pairs(spark, sf), ORIGINS)).withColumn("gain", F.round("gain", 3))


@query()
def plugin_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """A registered batch model: quantile forecasts from one origin."""
    return plugins.forecast(deviations(spark, sf), "drift_quantiles", 17, 6)


def _joined(out: DataFrame) -> DataFrame:
    return out.withColumns({"n_points": F.size("points"), "points": F.array_join(F.col("points").cast("array<string>"), ",")})


@query()
def offline_changepoints(spark: SparkSession, sf: str) -> DataFrame:
    """Retrospective change points of the local deviations by five searches."""
    d = deviations(spark, sf)
    out = offline.detect(d, KEYS, "d", (8.0,), ("pelt", "binseg", "bottomup", "window")).unionByName(offline.detect(d, KEYS, "d", (1.5,), ("kernel",)))
    return _joined(out).select(*KEYS, "method", "n_points", "points")


@query(
    SRC.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ser AS (SELECT territory_id, category, list(coalesce(d, 0.0) ORDER BY t) AS v FROM src GROUP BY ALL),
med AS (SELECT *, list_median(v) AS m, list_median(list_transform(range(2, len(v) + 1), lambda i: abs(v[i] - v[i - 1]))) AS s FROM ser),
std AS (SELECT territory_id, category, list_transform(v, lambda q: (q - m) / (s * 1.4826 / sqrt(2.0) + 1e-6)) AS x FROM med),
cum AS (SELECT territory_id, category, len(x) AS n, list_transform(range(0, len(x) + 1), lambda i: coalesce(list_sum(x[1:i]), 0.0)) AS c1,
  list_transform(range(0, len(x) + 1), lambda i: coalesce(list_sum(list_transform(x[1:i], lambda q: q * q)), 0.0)) AS c2 FROM std),
rec AS (SELECT cum.*, penalty, CAST(0 AS BIGINT) AS t, [-penalty] AS f, [''] AS p FROM cum CROSS JOIN (SELECT CAST(unnest([{", ".join(map(str, offline.PENALTIES))}]) AS DOUBLE) AS penalty)
  UNION ALL SELECT territory_id, category, n, c1, c2, penalty, t + 1, list_append(f, coalesce(list_min(w), CAST('inf' AS DOUBLE))),
    list_append(p, CASE WHEN len(w) = 0 OR list_position(w, list_min(w)) = 1 THEN '' ELSE p[list_position(w, list_min(w))] || CASE WHEN p[list_position(w, list_min(w))] = '' THEN '' ELSE ',' END || (list_position(w, list_min(w)) - 1) END)
  FROM (SELECT *, list_transform(range(0, t), lambda k: f[k + 1] + c2[t + 2] - c2[k + 1] - pow(c1[t + 2] - c1[k + 1], 2) / (t + 1 - k) + penalty) AS w FROM rec WHERE t < n))
SELECT territory_id, category, penalty, p[n + 1] AS points, CASE WHEN p[n + 1] = '' THEN 0 ELSE len(string_split(p[n + 1], ',')) END AS n_points FROM rec WHERE t = n"""
)
def offline_optimal(spark: SparkSession, sf: str) -> DataFrame:
    """The segmentation with least cost at each of nine penalties, by dynamic programming."""
    out = _joined(offline.detect(deviations(spark, sf), KEYS, "d", methods=("pelt",)))
    return out.select(*KEYS, "penalty", "points", "n_points")


@query()
def offline_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Five searches on series half of which have a step put in, each at the penalty that gives three false points in 100 months."""
    d = materialize(deviations(spark, sf), "deviations")
    scen = synthetic.scenarios(spark, ("series",), ("step",), (0.1,), 1)
    rows = materialize(synthetic.inject(d, scen, synthetic.shocks(d.select("territory_id").distinct(), scen, frac=0.5)), "shocked")
    points = materialize(offline.detect(rows, KEYS, "d"), "points")
    out = offline.calibrated(points, rows.groupBy(*KEYS).agg(F.max("onset").alias("onset")), KEYS, DEFAULT.detect.monitor)
    return out.select("method", "penalty", *[r6(F.col(c)).alias(c) for c in ("recall", "precision", "F1", "false_per100")])


#: P(|T| > |s|) for n - 1 degrees of freedom, as in ``stats.student_two_sided``.
_DM_P = """1 - CASE WHEN (n - 1) % 2 = 1 THEN (atan(abs(s) / sqrt(n - 1)) + CASE WHEN n > 2 THEN list_sum(list_transform(range(0, (n - 4) // 2 + 1), lambda j:
    sn * sqrt(c2) * pow(c2, j) * coalesce(list_product(list_transform(range(1, j + 1), lambda k: 2 * k / (2 * k + 1.0))), 1.0))) ELSE 0 END) * 2 / pi()
  ELSE list_sum(list_transform(range(0, (n - 3) // 2 + 1), lambda j: sn * pow(c2, j) * coalesce(list_product(list_transform(range(1, j + 1), lambda k: (2 * k - 1) / (2.0 * k))), 1.0))) END"""
_SIGN_P = "least(1.0, 2 * list_sum(list_transform(range(0, least(k, n - k) + 1), lambda i: factorial(CAST(n AS INTEGER))::DOUBLE / factorial(CAST(i AS INTEGER)) / factorial(CAST(n - i AS INTEGER)))) / pow(2.0, n))"


@query(
    sql.FORECASTS + f""", pair AS (SELECT h, territory_id, category, o, t, max(abs(y - exp(lf))) FILTER (WHERE model = 'level_season') AS ea, max(abs(y - exp(lf))) FILTER (WHERE model = 'naive') AS eb
  FROM fc WHERE y IS NOT NULL AND lf IS NOT NULL AND split = 'test' AND h IN (1, 3, 6, 12) GROUP BY ALL),
loss AS (SELECT h, territory_id, t, avg(ea - eb) AS diff FROM pair WHERE ea IS NOT NULL AND eb IS NOT NULL GROUP BY ALL),
mon AS (SELECT h, t, avg(diff) AS m FROM loss GROUP BY ALL),
ser AS (SELECT h, list(m ORDER BY t) AS x, avg(m) AS mean, count(*) AS n, count(*) FILTER (WHERE m < 0) AS k FROM mon GROUP BY h),
dev AS (SELECT *, list_transform(x, lambda v: v - mean) AS e, greatest(1, least(h, n - 1)) AS lags FROM ser),
va AS (SELECT *, CASE WHEN n >= 3 THEN list_sum(list_transform(range(0, CAST(lags AS BIGINT)), lambda k: CASE WHEN k = 0 THEN 1.0 ELSE 2 * (1 - k / lags::DOUBLE) END
  * list_avg(list_transform(range(1, n - k + 1), lambda i: e[i] * e[i + k])))) / n END AS v FROM dev),
dm AS (SELECT *, CASE WHEN v > 0 THEN mean / sqrt(v) * sqrt(greatest((n + 1 - 2 * lags + lags * (lags - 1) / n::DOUBLE) / n, 1e-9)) END AS s FROM va),
dp AS (SELECT *, abs(s) / sqrt(n - 1 + s * s) AS sn, (n - 1) / (n - 1 + s * s) AS c2 FROM dm),
si AS (SELECT h, n, s, {_DM_P} AS p, {_SIGN_P} AS sign_p FROM dp),
ho AS (SELECT *, row_number() OVER (ORDER BY sign_p, h) AS r, (count(*) OVER () - row_number() OVER (ORDER BY sign_p, h) + 1) * sign_p AS sc FROM si),
bs AS (SELECT CAST(b AS INTEGER) AS b FROM range({stats.DRAWS}) r(b)),
wt AS (SELECT territory_id, b, {_poisson_sql(_U('territory', 'territory_id'))} AS wt FROM (SELECT DISTINCT territory_id FROM loss) CROSS JOIN bs),
wm AS (SELECT t, b, {_poisson_sql(_U('month', 't'))} AS wm FROM (SELECT DISTINCT t FROM loss) CROSS JOIN bs),
me AS (SELECT h, b, sum(wt * wm * diff) / nullif(sum(wt * wm), 0) AS m2, sum(wt * diff) / nullif(sum(wt), 0) AS m1 FROM loss JOIN wt USING (territory_id) JOIN wm USING (t, b) GROUP BY h, b),
ci AS (SELECT h, quantile_cont(m2, 0.025) AS ci_low, quantile_cont(m2, 0.975) AS ci_high, quantile_cont(m1, 0.025) AS ci1_low, quantile_cont(m1, 0.975) AS ci1_high FROM me GROUP BY h)
SELECT h, CAST(n AS INTEGER) AS n_months, round(s, 6) + 0.0 AS dm_stat, round(p, 6) + 0.0 AS dm_p, round(sign_p, 6) AS sign_p, round(least(1.0, max(sc) OVER (ORDER BY r)), 6) AS p_holm,
  round(ci_low, 4) + 0.0 AS ci_low, round(ci_high, 4) + 0.0 AS ci_high, round(ci1_low, 4) + 0.0 AS ci1_low, round(ci1_high, 4) + 0.0 AS ci1_high,
  (SELECT round(avg(diff), 4) + 0.0 FROM loss l WHERE l.h = ho.h) AS diff, (SELECT round(avg((diff < 0)::INT), 6) FROM loss l WHERE l.h = ho.h) AS share_better
FROM ho JOIN ci USING (h)"""
)
def significance(spark: SparkSession, sf: str) -> DataFrame:
    """Level and season against naive: bootstrap intervals, Diebold-Mariano and sign tests over target months, Holm's correction."""
    f = forecasts(spark, sf, ("level_season", "naive")).where(F.col("split") == "test").where(F.col("h").isin(*DEFAULT.grid.horizons))
    loss = materialize(metrics.monthly_loss(f, "level_season", "naive"), "loss")
    months = loss.groupBy("h", "t").agg(F.avg("diff").alias("m"))
    signs = months.groupBy("h").agg(stats.sign_test(F.count(F.when(F.col("m") < 0, 1)), F.count("*")).alias("sign_p"))
    tests = stats.diebold_mariano(months, ["h"], "t", "m", "h").withColumnRenamed("n_periods", "n_months").join(stats.holm(signs, "sign_p"), "h")
    out = tests.join(stats.bootstrap(loss, ["h"]), "h")
    fine, coarse = ("dm_stat", "dm_p", "sign_p", "p_holm", "share_better"), ("ci_low", "ci_high", "ci1_low", "ci1_high", "diff")
    return out.select("h", "n_months", *[r6(F.col(c)).alias(c) for c in fine], *[(F.round(c, 4) + 0.0).alias(c) for c in coarse])


_GRP = "WITH s AS (SELECT l_shipdate >= DATE '1998-01-01' AS late, l_extendedprice / l_quantity AS v, l_returnflag AS k FROM lineitem)"


@query(
    _GRP + """, r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY v) + (count(*) OVER (PARTITION BY k, v) - 1) / 2.0 AS r FROM s),
ti AS (SELECT k, sum(c * c * c - c) AS ties FROM (SELECT k, v, count(*)::DOUBLE AS c FROM s GROUP BY k, v) GROUP BY k),
a AS (SELECT k, sum(r) FILTER (WHERE late) AS rs, count(*) FILTER (WHERE late)::DOUBLE AS n1, count(*) FILTER (WHERE NOT late)::DOUBLE AS n2 FROM r GROUP BY k)
SELECT k, round(rs - n1 * (n1 + 1) / 2, 4) AS U, round((rs - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) + 0.0 AS z, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2
FROM a JOIN ti USING (k) WHERE n1 > 0 AND n2 > 0"""
)
def mann_whitney(spark: SparkSession, sf: str) -> DataFrame:
    line = tb.table(spark, sf, "lineitem")
    rows = line.select((F.col("l_shipdate") >= "1998-01-01").alias("late"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"), F.col("l_returnflag").alias("k"))
    return stats.mann_whitney(rows, ["k"], "late", "v").withColumns({"U": F.round("U", 4), "z": r6(F.col("z"))})


@query(
    "WITH " + sql.PANEL + """, s AS (SELECT category, round(max(d) FILTER (WHERE t = 23) - max(d) FILTER (WHERE t = 11), 9) AS v FROM dec WHERE is_full GROUP BY category, territory_id),
r AS (SELECT *, rank() OVER (PARTITION BY category ORDER BY abs(v)) + (count(*) OVER (PARTITION BY category, abs(v)) - 1) / 2.0 AS r FROM s WHERE v IS NOT NULL AND v <> 0)
SELECT category, coalesce(sum(r) FILTER (WHERE v > 0), 0) AS W, count(*) AS n, round((coalesce(sum(r) FILTER (WHERE v > 0), 0) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0), 6) + 0.0 AS z FROM r GROUP BY category"""
)
def wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    d = decomposed(spark, sf).where("is_full").groupBy("category", "territory_id").agg(F.round(F.max(F.when(F.col("t") == 23, F.col("d"))) - F.max(F.when(F.col("t") == 11, F.col("d"))), 9).alias("v"))
    return stats.wilcoxon(d, ["category"], "v").select("category", "W", "n", r6(F.col("z")).alias("z"))


@query(
    """WITH r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY c_mktsegment ORDER BY k) + (count(*) OVER (PARTITION BY c_mktsegment, k) - 1) / 2.0 AS b FROM (SELECT c.*, c_custkey % 97 AS k FROM customer c))
SELECT c_mktsegment, round(corr(a, b), 6) + 0.0 AS rho, count(*) AS n FROM r GROUP BY c_mktsegment"""
)
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    c = tb.table(spark, sf, "customer").withColumn("k", F.col("c_custkey") % 97)
    return stats.spearman(c, ["c_mktsegment"], "c_acctbal", "k").withColumn("rho", r6(F.col("rho")))


@query("WITH p AS (SELECT p_brand, round((count(*) % 37) / 500.0 + 0.001, 6) AS p FROM part GROUP BY p_brand), s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, p_brand) + 1) * p AS s, row_number() OVER (ORDER BY p, p_brand) AS r FROM p) SELECT p_brand, p, round(least(1.0, max(s) OVER (ORDER BY r)), 6) AS p_holm FROM s")
def holm(spark: SparkSession, sf: str) -> DataFrame:
    p = tb.table(spark, sf, "part").groupBy("p_brand").agg(F.round((F.count("*") % 37) / 500.0 + 0.001, 6).alias("p"))
    return stats.holm(p, "p").select("p_brand", "p", F.round("p_holm", 6).alias("p_holm"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily windows over the event stream, complete after the last batch."""
    return online.run_to_table(online.daily_counts(online.event_stream(spark, sf)), "daily", "complete").drop("batch")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""")
def stream_daily_closed(spark: SparkSession, sf: str) -> DataFrame:
    """Days that the watermark has closed: each is given once, and its state is dropped then."""
    return online.run_to_table(online.daily_counts(online.event_stream(spark, sf)), "daily", "append").drop("batch")


@query(
    """WITH m AS (SELECT 50.0 AS mu, 25.0 AS sd),
z AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, (coalesce(value, mu) - mu) / sd AS z FROM events CROSS JOIN m),
p AS (SELECT *, sum(z - 0.5) OVER w AS a, sum(-z - 0.5) OVER w AS b FROM z WINDOW w AS (PARTITION BY user_id ORDER BY i)),
c AS (SELECT user_id, i, a - least(0, min(a) OVER w) AS up, b - least(0, min(b) OVER w) AS dn FROM p WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, max(i) AS n, round(arg_max(up, i), 6) + 0.0 AS up, round(arg_max(dn, i), 6) + 0.0 AS down, round(greatest(0, max(greatest(up, dn))), 6) + 0.0 AS peak FROM c GROUP BY user_id"""
)
def stream_cusum(spark: SparkSession, sf: str) -> DataFrame:
    """A CUSUM per user with keyed state; the final state of each."""
    rows = online.run_to_table(online.cusum_stream(online.event_stream(spark, sf), 50.0, 25.0), "cusum", "update")
    out = online.latest_state(rows, "user_id")
    return out.select("user_id", "n", *[r6(F.col(c)).alias(c) for c in ("up", "down", "peak")])


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = tb.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return online.sessions(e).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("WITH " + sql.PANEL + " SELECT split, h, round(avg(abs(y.d - x.d)), 6) AS mae_d, count(*) AS n FROM grid g JOIN dec x ON x.t = g.o JOIN dec y ON y.t = g.t AND y.territory_id = x.territory_id AND y.category = x.category WHERE x.is_full GROUP BY split, h")
def lag_join(spark: SparkSession, sf: str) -> DataFrame:
    """Self-join at the horizon: how far d moves from origin to target."""
    d = decomposed(spark, sf).where("is_full").select(*KEYS, "t", "d")
    rows = d.join(F.broadcast(pn.grid(spark)), "t").join(d.select(*KEYS, F.col("t").alias("o"), F.col("d").alias("d0")), [*KEYS, "o"])
    return rows.groupBy("split", "h").agg(F.round(F.avg(F.abs(F.col("d") - F.col("d0"))), 6).alias("mae_d"), F.count("*").alias("n"))


