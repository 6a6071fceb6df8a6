"""Change-detection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import DEFAULT
from tessera.functions import draw, r6
from tessera.operators import detect as dt
from tessera.operators import graph
from tessera.operators import synthetic as sy
from tessera.plans import sql
from tessera.plans.forecasting import decomposed
from tessera.sources import tables as tb
from tessera.storage import materialize

QUERIES, ORACLE = {}, {}
KEYS = ["territory_id", "category"]
NEAREST = 5
FARS = (0.01, 0.03, 0.05)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def deviations(spark: SparkSession, sf: str) -> DataFrame:
    """Local deviations of full territories."""
    return decomposed(spark, sf).where("is_full").select(*KEYS, "cat_idx", "t", "d")


def the_streams(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(dt.streams(deviations(spark, sf), KEYS), "streams")


def near(spark: SparkSession, sf: str) -> DataFrame:
    return graph.nearest(tb.flows(spark, sf), NEAREST)


SRC = "WITH " + sql.PANEL + ", src AS (SELECT territory_id, category, cat_idx, t, d FROM dec WHERE is_full)"
NEAR = f""",
flow AS (SELECT c_nationkey AS x, s_nationkey AS y, 1.0 / count(*) AS distance FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
near AS (SELECT src, dst, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank
  FROM (SELECT x AS src, y AS dst, distance FROM flow UNION ALL SELECT y, x, distance FROM flow) WHERE src <> dst) WHERE rank <= {NEAREST})"""


def streams_sql(src: str, keys: str, scenario: str = "", rest: str = "cat_idx") -> str:
    """x, c and z over ``src`` (columns keys, rest, t, d)."""
    part = f"PARTITION BY {scenario}" if scenario else ""
    w = f"PARTITION BY {keys} ORDER BY t"
    return f""",
df AS (SELECT *, d - lag(d) OVER ({w}) AS dif,
    CASE WHEN t >= 3 AND count(d) OVER ({w} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 THEN d - avg(d) OVER ({w} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
      - CASE WHEN t >= 12 THEN 0.3 * (lag(d, 12) OVER ({w}) - avg(d) OVER ({w} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) ELSE 0 END END AS e FROM {src}),
m1 AS (SELECT {keys}, median(d) FILTER (WHERE t <= 11 AND t NOT IN (3, 4)) AS med, median(dif) FILTER (WHERE t <= 11 AND t NOT IN (3, 4, 5)) AS mid,
    median(e) FILTER (WHERE t BETWEEN 3 AND 11 AND t NOT IN (3, 4)) AS me FROM df GROUP BY {keys}),
m2 AS (SELECT df.*, med, mid, me FROM df JOIN m1 USING ({keys})),
m3 AS (SELECT {keys}, median(abs(dif - mid)) FILTER (WHERE t <= 11 AND t NOT IN (3, 4, 5)) * 1.4826 / sqrt(2.0) AS sig,
    median(abs(e - me)) FILTER (WHERE t BETWEEN 3 AND 11 AND t NOT IN (3, 4)) * 1.4826 AS mad FROM m2 GROUP BY {keys}),
m4 AS (SELECT {keys}, greatest(sig, quantile_cont(sig, 0.05) OVER ({part})) AS sig, greatest(mad, quantile_cont(mad, 0.05) OVER ({part})) AS mad FROM m3),
xs AS (SELECT m2.* EXCLUDE (dif, e, med, mid, me), (d - med) / sig AS x, (e - me) / mad AS z FROM m2 JOIN m4 USING ({keys})),
st AS (SELECT *, CASE WHEN t >= 4 THEN x - CASE WHEN t >= 7 THEN median(CASE WHEN t >= 3 THEN x END) OVER w ELSE median(x) OVER w END END AS c
  FROM xs WINDOW w AS ({w} ROWS BETWEEN 12 PRECEDING AND 4 PRECEDING))"""


STREAMS = SRC + streams_sql("src", "territory_id, category")
W = "PARTITION BY territory_id, category ORDER BY t"


def _cusum_w(v: str, part: str) -> str:
    terms = ["0.0"]
    for j in range(3):
        s, drift = f"sum(coalesce({v}, 0)) OVER ({part} ORDER BY t ROWS BETWEEN {j} PRECEDING AND CURRENT ROW)", f"(least({j}, t) + 1) * 0.5"
        terms += [f"{s} - {drift}", f"-{s} - {drift}"]
    return f"greatest({', '.join(terms)})"


def _glr(v: str, part: str) -> str:
    s = lambda n: f"sum(coalesce({v}, 0)) OVER ({part} ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    n = "least(8, t + 1)"
    terms = [f"CASE WHEN {n} - {m} >= 1 THEN ({n} - {m}) * {m} / {n}::DOUBLE * pow({s(m)} / {m} - ({s(8)} - {s(m)}) / ({n} - {m})::DOUBLE, 2) ELSE 0 END" for m in (1, 2, 3)]
    return f"greatest(0.0, {', '.join(terms)})"


_lse = lambda v: f"(list_max({v}) + ln(list_sum(list_transform({v}, lambda q: exp(q - list_max({v}))))))"
_fit = lambda mean, k: f"(-pow(x[t + 2] - {mean}, 2) / (2 * (1 + 1 / {k})) - ln(2 * pi() * (1 + 1 / {k})) / 2)"


def bocpd_sql(src: str, keys: str, hazard: str = "0.02", name: str = "bo") -> str:
    """CTE ``name`` (keys, t, score) over ``src`` (keys, t, x and what ``hazard`` reads): a recursion over months whose state is
    the list of log weights of the months in which the regime may have begun."""
    begin = "greatest(i - 2, 0)"
    k = f"(0.05 + t + 1 - {begin})"
    goes_on = f"list_transform(range(1, len(w) + 1), lambda i: w[i] + ln(1 - hz[t + 2]) + {_fit(f'((s[t + 2] - s[{begin} + 1]) / {k})', k)})"
    fresh = f"{_lse('w')} + ln(hz[t + 2]) + {_fit('0', '0.05')}"
    return f""",
{name}1 AS (SELECT {keys}, list(coalesce(x, 0.0) ORDER BY t) AS x, list(CAST({hazard} AS DOUBLE) ORDER BY t) AS hz FROM {src} GROUP BY {keys}),
{name}2 AS (SELECT *, list_transform(range(0, len(x) + 1), lambda i: coalesce(list_sum(x[1:i]), 0.0)) AS s FROM {name}1),
{name}3 AS (SELECT {keys}, x, hz, s, CAST(-1 AS BIGINT) AS t, [CAST(0 AS DOUBLE)] AS w FROM {name}2
  UNION ALL SELECT {keys}, x, hz, s, t + 1, list_transform(w2, lambda q: q - {_lse('w2')}) FROM (SELECT *, list_append({goes_on}, {fresh}) AS w2 FROM {name}3 WHERE t + 1 < len(x))),
{name} AS (SELECT {keys}, CAST(t AS INTEGER) AS t, CASE WHEN len(w) < 3 THEN CAST('inf' AS DOUBLE) ELSE {_lse('w[len(w) - 1:]')} - {_lse('w[1:len(w) - 2]')} END AS score FROM {name}3 WHERE t >= 0)"""


_P = "PARTITION BY territory_id, category"
SCORES = {
    "zscore": (STREAMS, "abs(z)"),
    "cusum_w": (STREAMS, _cusum_w("c", _P)),
    "glr": (STREAMS, _glr("x", _P)),
}


def _detector(name: str, oracle: str | None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = dt.DETECTORS[name](the_streams(spark, sf), dt.STREAM[name], KEYS)
        return out.select(*KEYS, "t", r6(F.col("score")).alias("score"))

    run.__name__ = f"detect_{name}"
    query(oracle)(run)


for _n, (_src, _e) in SCORES.items():
    _detector(_n, f"{_src} SELECT territory_id, category, t, round({_e}, 6) + 0.0 AS score FROM st")
_detector(
    "cusum",
    STREAMS + f""", p AS (SELECT *, sum(coalesce(z, 0) - 0.5) OVER ({W}) AS up, sum(-coalesce(z, 0) - 0.5) OVER ({W}) AS dn FROM st)
SELECT territory_id, category, t, round(greatest(up - least(0, min(up) OVER ({W})), dn - least(0, min(dn) OVER ({W}))), 6) + 0.0 AS score FROM p""",
)
_detector(
    "page_hinkley",
    STREAMS + f""", a AS (SELECT *, avg(coalesce(z, 0)) OVER ({W}) AS m FROM st),
p AS (SELECT *, sum(coalesce(z, 0) - m - 0.25) OVER ({W}) AS u, sum(coalesce(z, 0) - m + 0.25) OVER ({W}) AS v FROM a)
SELECT territory_id, category, t, round(greatest(u - least(0, min(u) OVER ({W})), greatest(0, max(v) OVER ({W})) - v), 6) + 0.0 AS score FROM p""",
)
_detector(
    "ewma",
    STREAMS + """ SELECT a.territory_id, a.category, a.t, round(abs(sum(0.4 * pow(0.6, a.t - b.t) * coalesce(b.z, 0))) / sqrt(0.4 / 1.6), 6) + 0.0 AS score
FROM st a JOIN st b ON a.territory_id = b.territory_id AND a.category = b.category AND b.t <= a.t GROUP BY a.territory_id, a.category, a.t""",
)
RECURSIVE = STREAMS.replace("WITH ", "WITH RECURSIVE ", 1)
_detector("bocpd", RECURSIVE + bocpd_sql("st", "territory_id, category") + " SELECT territory_id, category, t, round(score, 6) + 0.0 AS score FROM bo")
_detector(
    "stouffer",
    STREAMS + f""", s AS (SELECT territory_id, t, sum(coalesce(c, 0)) FILTER (WHERE cat_idx > 0) / sqrt(5.0) AS s FROM st GROUP BY territory_id, t),
q AS (SELECT territory_id, t, {_cusum_w("s", "PARTITION BY territory_id")} AS score FROM s)
SELECT territory_id, category, t, round(score, 6) + 0.0 AS score FROM st JOIN q USING (territory_id, t)""",
)


@query(STREAMS + " SELECT territory_id, category, t, round(x, 6) + 0.0 AS x, round(c, 6) + 0.0 AS c, round(z, 6) + 0.0 AS z FROM st")
def detection_streams(spark: SparkSession, sf: str) -> DataFrame:
    return dt.streams(deviations(spark, sf), KEYS).select(*KEYS, "t", *[r6(F.col(c)).alias(c) for c in "xcz"])


@query("WITH " + NEAR[2:] + " SELECT src, dst, round(distance, 9) AS distance, rank FROM near")
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    return near(spark, sf).withColumn("distance", F.round("distance", 9))


_SPATIAL = STREAMS + NEAR + """, nb AS (SELECT n.src AS territory_id, s.category, s.t, avg(s.c) AS m, count(*) AS k FROM near n JOIN st s ON s.territory_id = n.dst GROUP BY n.src, s.category, s.t)"""


@query(_SPATIAL + " SELECT s.territory_id, s.category, s.t, round(m, 6) + 0.0 AS nb_mean, k AS nb_count FROM st s JOIN nb USING (territory_id, category, t)")
def neighbor_mean(spark: SparkSession, sf: str) -> DataFrame:
    st = the_streams(spark, sf)
    nb = graph.neighbour_mean(st, near(spark, sf), "c", ["category", "t"])
    return st.join(nb, [*KEYS, "t"]).select(*KEYS, "t", r6(F.col("nb_mean")).alias("nb_mean"), "nb_count")


@query(
    _SPATIAL + f""", mx AS (SELECT s.territory_id, s.category, s.t, (0.5 * c + 0.5 * m) / sqrt(0.25 + 0.25 / greatest(coalesce(k, 0), 1)) AS mix FROM st s LEFT JOIN nb USING (territory_id, category, t))
SELECT territory_id, category, t, round({_cusum_w("mix", _P)}, 6) + 0.0 AS score FROM mx"""
)
def detect_spatial(spark: SparkSession, sf: str) -> DataFrame:
    return dt.spatial(the_streams(spark, sf), "c", KEYS, near(spark, sf)).select(*KEYS, "t", r6(F.col("score")).alias("score"))


@query(
    STREAMS + f""", s AS (SELECT territory_id, category, t, round({_cusum_w("c", _P)}, 9) AS a, round(abs(z), 9) AS b FROM st),
ra AS (SELECT *, (SELECT count(*) FROM s r WHERE r.t >= 12 AND r.a <= s.a) / (SELECT count(a) FROM s WHERE t >= 12)::DOUBLE AS ea,
  CASE WHEN b IS NOT NULL THEN (SELECT count(*) FROM s r WHERE r.t >= 12 AND r.b <= s.b) / (SELECT count(b) FROM s WHERE t >= 12)::DOUBLE END AS eb FROM s)
SELECT territory_id, category, t, round(greatest(ea, eb), 6) AS score FROM ra"""
)
def combo_ecdf(spark: SparkSession, sf: str) -> DataFrame:
    """Two detectors joined by OR: the larger of their ECDF ranks among monitored months."""
    s = the_streams(spark, sf).select(*KEYS, "t", "c", "z")
    s = s.select(*KEYS, "t", F.round(dt.cusum_w(s, "c", KEYS), 9).alias("a"), F.round(F.abs("z"), 9).alias("b"))
    ref = F.col("t").between(*DEFAULT.detect.monitor)
    s = dt.ecdf(dt.ecdf(materialize(s, "scores"), "a", ref, "ea"), "b", ref, "eb")
    return s.select(*KEYS, "t", F.round(F.greatest("ea", "eb"), 6).alias("score"))


# ---------------------------------------------------------------- semi-synthetic scenarios

_SCEN = """, scen AS (SELECT scope || '|' || shape || '|' || CAST(mag * 1000 AS INTEGER) || '|' || seed AS scenario, scope, shape, CAST(mag AS DOUBLE) AS magnitude, CAST(seed AS INTEGER) AS seed
  FROM (SELECT unnest({scopes}) AS scope) CROSS JOIN (SELECT unnest({shapes}) AS shape) CROSS JOIN (SELECT unnest({mags}) AS mag) CROSS JOIN range({seeds}) s(seed))"""


def _draw(*parts: str) -> str:
    return "CAST(('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 8)) AS BIGINT)"


def scenario_sql(scopes, shapes, mags, seeds: int) -> str:
    ls = lambda v: "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in v) + "]"
    return (
        SRC + NEAR + _SCEN.format(scopes=ls(scopes), shapes=ls(shapes), mags=ls(mags), seeds=seeds) + f""",
ter AS (SELECT DISTINCT territory_id FROM src),
cand AS (SELECT s.*, r.territory_id AS centre, row_number() OVER (PARTITION BY scenario ORDER BY {_draw("'centre'", "s.scenario", "r.territory_id")}, r.territory_id) AS rank,
  count(*) OVER (PARTITION BY scenario) AS n FROM scen s CROSS JOIN ter r),
cen AS (SELECT scenario, scope, rank, centre, CAST(13 + {_draw("'onset'", "scenario", "centre")} % 9 AS INTEGER) AS onset,
  ln(1 + magnitude) * (2 * ({_draw("'sign'", "scenario", "centre")} % 2) - 1) AS delta FROM cand WHERE rank <= greatest(1, floor(n * 0.1))),
crows AS (SELECT c.*, CAST(k AS INTEGER) AS cat_idx FROM cen c CROSS JOIN range(6) x(k) WHERE scope <> 'series' OR k = 1 + {_draw("'category'", "scenario", "centre")} % 5),
allr AS (SELECT scenario, rank, centre AS territory_id, cat_idx, onset, delta FROM crows
  UNION ALL SELECT c.scenario, c.rank, n.dst, c.cat_idx, c.onset, c.delta FROM crows c JOIN near n ON n.src = c.centre WHERE scope = 'cluster' AND n.dst IN (SELECT territory_id FROM ter)),
shk AS (SELECT scenario, territory_id, cat_idx, arg_min(onset, rank) AS onset, arg_min(delta, rank) AS delta FROM allr GROUP BY ALL),
inj AS (SELECT s.scenario, s.scope, s.shape, s.magnitude, d.territory_id, d.category, d.cat_idx, d.t, k.onset, k.onset IS NOT NULL AS shocked,
  d.d + coalesce(k.delta * CASE s.shape WHEN 'step' THEN (d.t >= k.onset)::INT WHEN 'dip' THEN (d.t >= k.onset AND d.t < k.onset + 2)::INT
    WHEN 'spike' THEN (d.t = k.onset)::INT ELSE least(1.0, greatest(0.0, (d.t - k.onset + 1) / 3.0)) END, 0) AS d,
  CASE WHEN coalesce(d.t = k.onset, false) AND {_draw("'news'", "s.scenario", "d.territory_id", "d.cat_idx")} % 10000 < 6000
    OR {_draw("'rumour'", "s.scenario", "d.territory_id", "d.cat_idx", "d.t")} % 10000 < 300 THEN 8.0 ELSE 1.0 END AS mult
  FROM src d CROSS JOIN scen s LEFT JOIN shk k ON k.scenario = s.scenario AND k.territory_id = d.territory_id AND k.cat_idx = d.cat_idx)"""
    )


def injected(spark: SparkSession, sf: str, scopes, shapes, mags, seeds: int) -> DataFrame:
    d = materialize(deviations(spark, sf), "deviations")
    scen = sy.scenarios(spark, scopes, shapes, mags, seeds)
    return sy.simulated_news(sy.inject(d, scen, sy.shocks(d.select("territory_id").distinct(), scen, near(spark, sf))))


@query(scenario_sql(sy.SCOPES, sy.SHAPES, (0.1,), 1) + " SELECT scenario, territory_id, category, t, coalesce(onset, -1) AS onset, shocked, round(d, 6) + 0.0 AS d FROM inj")
def inject_shocks(spark: SparkSession, sf: str) -> DataFrame:
    return injected(spark, sf, sy.SCOPES, sy.SHAPES, (0.1,), 1).select("scenario", *KEYS, "t", F.coalesce("onset", F.lit(-1)).alias("onset"), "shocked", r6(F.col("d")).alias("d"))


SKEYS = ["scenario", *KEYS]
_SP = "PARTITION BY scenario, territory_id, category"
_SW = f"{_SP} ORDER BY t"
_ST = "PARTITION BY scenario, territory_id"
_PLACE = "scenario, territory_id, category, t, onset, shocked"
_HAZARD = "greatest(1e-4, least(0.9, 0.02 * mult))"
_GRID_SCORES = bocpd_sql("st", "scenario, territory_id, category") + bocpd_sql("st", "scenario, territory_id, category", _HAZARD, "bn") + f""", cu AS (SELECT *, sum(coalesce(z, 0) - 0.5) OVER ({_SW}) AS up, sum(-coalesce(z, 0) - 0.5) OVER ({_SW}) AS dn, avg(coalesce(z, 0)) OVER ({_SW}) AS m FROM st),
ph AS (SELECT *, sum(coalesce(z, 0) - m - 0.25) OVER ({_SW}) AS u, sum(coalesce(z, 0) - m + 0.25) OVER ({_SW}) AS v FROM cu),
ew AS (SELECT a.scenario, a.territory_id, a.category, a.t, abs(sum(0.4 * pow(0.6, a.t - b.t) * coalesce(b.z, 0))) / sqrt(0.4 / 1.6) AS score
  FROM st a JOIN st b ON a.scenario = b.scenario AND a.territory_id = b.territory_id AND a.category = b.category AND b.t <= a.t GROUP BY ALL),
sf AS (SELECT scenario, territory_id, t, sum(coalesce(c, 0)) FILTER (WHERE cat_idx > 0) / sqrt(5.0) AS s FROM st GROUP BY ALL),
sq AS (SELECT scenario, territory_id, t, {_cusum_w("s", _ST)} AS score FROM sf),
nb AS (SELECT n.src AS territory_id, s.scenario, s.category, s.t, avg(s.c) AS m, count(*) AS k FROM near n JOIN st s ON s.territory_id = n.dst GROUP BY ALL),
mx AS (SELECT s.*, (0.5 * c + 0.5 * m) / sqrt(0.25 + 0.25 / greatest(coalesce(k, 0), 1)) AS mix FROM st s LEFT JOIN nb USING (scenario, territory_id, category, t)),
ss AS (
  SELECT {_PLACE}, 'zscore' AS detector, abs(z) AS score FROM st UNION ALL
  SELECT {_PLACE}, 'cusum_w', {_cusum_w("c", _SP)} FROM st UNION ALL
  SELECT {_PLACE}, 'glr', {_glr("x", _SP)} FROM st UNION ALL
  SELECT {_PLACE}, 'cusum', greatest(up - least(0, min(up) OVER ({_SW})), dn - least(0, min(dn) OVER ({_SW}))) FROM cu UNION ALL
  SELECT {_PLACE}, 'page_hinkley', greatest(u - least(0, min(u) OVER ({_SW})), greatest(0, max(v) OVER ({_SW})) - v) FROM ph UNION ALL
  SELECT {_PLACE}, 'ewma', ew.score FROM st JOIN ew USING (scenario, territory_id, category, t) UNION ALL
  SELECT {_PLACE}, 'stouffer', sq.score FROM st JOIN sq USING (scenario, territory_id, t) UNION ALL
  SELECT {_PLACE}, 'spatial', {_cusum_w("mix", _SP)} FROM mx UNION ALL
  SELECT {_PLACE}, 'bocpd', bo.score FROM st JOIN bo USING (scenario, territory_id, category, t) UNION ALL
  SELECT {_PLACE}, 'bocpd_news', bn.score FROM st JOIN bn USING (scenario, territory_id, category, t)),
er AS (SELECT *, count(*) OVER (PARTITION BY scenario, detector ORDER BY round(score, 9) RANGE UNBOUNDED PRECEDING) / (count(*) OVER (PARTITION BY scenario, detector))::DOUBLE AS rank
  FROM ss WHERE t BETWEEN 12 AND 23 AND detector IN ('bocpd', 'stouffer', 'cusum_w', 'spatial') AND isfinite(score)),
sc AS (SELECT * FROM ss UNION ALL
  SELECT {_PLACE}, 'bocpd_or_stouffer', max(rank) FROM er WHERE detector IN ('bocpd', 'stouffer') GROUP BY ALL HAVING count(*) = 2 UNION ALL
  SELECT {_PLACE}, 'window_or_stouffer_or_spatial', max(rank) FROM er WHERE detector <> 'bocpd' GROUP BY ALL HAVING count(*) = 3),
fr AS (SELECT unnest([{", ".join(map(str, FARS))}]) AS far),
th AS (SELECT scenario, detector, CAST(unnest([{", ".join(map(str, FARS))}]) AS DOUBLE) AS far, unnest(quantile_cont(score, [{", ".join(str(1 - f) for f in FARS)}])) AS threshold FROM sc
  WHERE NOT shocked AND t BETWEEN 12 AND 23 AND score IS NOT NULL GROUP BY scenario, detector),
al AS (SELECT sc.*, th.far, coalesce(round(score, 9) > round(threshold, 9), false) AS alarm FROM sc JOIN th USING (scenario, detector) WHERE t BETWEEN 12 AND 23),
per AS (SELECT scenario, detector, far, territory_id, category, any_value(shocked) AS shocked, sum((alarm AND shocked AND t BETWEEN onset AND onset + 2)::INT) AS hits,
  min(CASE WHEN alarm AND shocked AND t BETWEEN onset AND onset + 2 THEN t - onset END) AS first, sum(alarm::INT) AS alarms, count(*) AS months FROM al GROUP BY ALL),
ev AS (SELECT scenario, detector, far, avg((hits > 0)::INT) FILTER (WHERE shocked) AS recall, avg(coalesce((first = 0)::INT, 0)) FILTER (WHERE shocked) AS recall_at_onset,
  avg(first) AS delay, sum(hits) / greatest(sum(alarms), 1)::DOUBLE AS precision, 100.0 * sum(alarms) FILTER (WHERE NOT shocked) / greatest(sum(months) FILTER (WHERE NOT shocked), 1) AS far_per100 FROM per GROUP BY ALL)"""


def grid_scores(rows: DataFrame, around: DataFrame) -> DataFrame:
    """One row for each scenario, series, monitored month and detector: ten single ones and two combinations."""
    return dt.all_scores(dt.streams(rows, SKEYS), SKEYS, around, "mult")


def full_grid(spark: SparkSession, sf: str) -> DataFrame:
    """All 108 scenarios: three scopes, three shapes, four sizes and three seeds; twelve detectors, three false-alarm rates."""
    return materialize(evaluated(grid_scores(injected(spark, sf, sy.SCOPES, sy.SHAPES, sy.MAGNITUDES, 3), near(spark, sf))), "grid")


def evaluated(rows: DataFrame, fars=FARS) -> DataFrame:
    """All detectors of all scenarios at each false-alarm rate: thresholds, alarms, scores."""
    rows = materialize(rows, "scores")
    th = dt.thresholds(rows, ["scenario", "detector"], fars)
    alarm = F.coalesce(F.round("score", 9) > F.round("threshold", 9), F.lit(False))
    return dt.alarm_scores(rows.join(th, ["scenario", "detector"]).withColumn("alarm", alarm), ["scenario", "detector", "far"])


_R = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("recall", "recall_at_onset", "delay", "precision", "far_per100"))
_F1 = "round(2 * precision * recall / greatest(precision + recall, 1e-9), 6) + 0.0 AS F1"
_GRID = scenario_sql(sy.SCOPES, sy.SHAPES, sy.MAGNITUDES, 3).replace("WITH ", "WITH RECURSIVE ", 1) + streams_sql("inj", "scenario, territory_id, category", "scenario") + _GRID_SCORES


@query(_GRID + f" SELECT scenario, detector, far, {_R}, {_F1} FROM ev")
def alarm_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = full_grid(spark, sf)
    return out.withColumns({c: r6(F.col(c)) for c in ("recall", "recall_at_onset", "delay", "precision", "far_per100", "F1")})


@query(_GRID + " SELECT detector, split_part(scenario, '|', 1) AS scope, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, count(*) AS n_scenarios FROM ev WHERE far = 0.03 GROUP BY ALL")
def grid_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = full_grid(spark, sf).where("far = 0.03")
    scope = F.element_at(F.split("scenario", r"\|"), 1)
    return out.groupBy("detector", scope.alias("scope")).agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"), F.count("*").alias("n_scenarios"))


@query(_GRID + """ SELECT detector, far, round(avg(recall), 6) AS recall FROM ev GROUP BY ALL
UNION ALL SELECT 'random', CAST(far AS DOUBLE), round(1 - pow(1 - far, 3), 6) FROM fr""")
def far_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Recall by false-alarm rate, with what random alarms would reach."""
    out = full_grid(spark, sf)
    got = out.groupBy("detector", "far").agg(F.round(F.avg("recall"), 6).alias("recall"))
    rates = spark.range(1).select(F.explode(F.array(*map(F.lit, FARS))).alias("far"))
    return got.unionByName(rates.select(F.lit("random").alias("detector"), "far", F.round(1 - F.pow(1 - F.col("far"), F.lit(DEFAULT.detect.tolerance + 1)), 6).alias("recall")))


_OUT = scenario_sql(("series",), ("spike", "step"), (0.2,), 4).replace("WITH ", "WITH RECURSIVE ", 1) + streams_sql("inj", "scenario, territory_id, category", "scenario") + _GRID_SCORES


@query(_OUT + " SELECT detector, split_part(scenario, '|', 2) AS kind, round(avg(recall), 6) AS recall, count(*) AS n FROM ev WHERE far = 0.03 GROUP BY ALL")
def outlier_vs_shift(spark: SparkSession, sf: str) -> DataFrame:
    """How often a single outlier is taken for a shift of the same size."""
    out = evaluated(grid_scores(injected(spark, sf, ("series",), ("spike", "step"), (0.2,), 4), near(spark, sf))).where("far = 0.03")
    return out.groupBy("detector", F.element_at(F.split("scenario", r"\|"), 2).alias("kind")).agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("n"))


@query(_GRID + f" SELECT scenario, detector, far, {_R}, {_F1} FROM ev WHERE detector = 'bocpd'")
def bocpd_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The scenario grid for the Bayesian detector."""
    return full_grid(spark, sf).where("detector = 'bocpd'").withColumns({c: r6(F.col(c)) for c in ("recall", "recall_at_onset", "delay", "precision", "far_per100", "F1")})


#: Summaries of the grid: what is grouped by besides the detector, and which rows count.
_SUMMARIES = {"scope": (1, 0.03), "shape": (2, 0.03), "magnitude": (3, 0.03)}


@query(
    _GRID + " " + " UNION ALL ".join(f"SELECT '{k}' AS dimension, split_part(scenario, '|', {i}) AS level, detector, far, round(avg(recall), 6) AS recall, round(avg(recall_at_onset), 6) AS recall_at_onset, round(avg(delay), 6) AS delay, round(avg(precision), 6) AS precision, round(avg(2 * precision * recall / greatest(precision + recall, 1e-9)), 6) AS F1, count(*) AS n FROM ev WHERE far = 0.03 GROUP BY ALL" for k, (i, _) in _SUMMARIES.items())
    + " UNION ALL SELECT 'far', CAST(far AS VARCHAR), detector, far, round(avg(recall), 6), round(avg(recall_at_onset), 6), round(avg(delay), 6), round(avg(precision), 6), round(avg(2 * precision * recall / greatest(precision + recall, 1e-9)), 6), count(*) FROM ev GROUP BY ALL"
)
def grid_report(spark: SparkSession, sf: str) -> DataFrame:
    """Means of all figures by detector and scope, shape, size or false-alarm rate, from one pass over the grid."""
    out = full_grid(spark, sf)
    part = lambda i: F.element_at(F.split("scenario", r"\|"), i)
    at = F.array(*[F.when(F.col("far") == far, F.struct(F.lit(k).alias("dimension"), part(i).alias("level"))) for k, (i, far) in _SUMMARIES.items()], F.struct(F.lit("far").alias("dimension"), F.col("far").cast("string").alias("level")))
    rows = out.withColumn("e", F.explode(at)).where("e IS NOT NULL")
    means = [F.round(F.avg(c), 6).alias(c) for c in ("recall", "recall_at_onset", "delay", "precision", "F1")]
    return rows.groupBy("e.dimension", "e.level", "detector", "far").agg(*means, F.count("*").alias("n"))


#: Subsets of the grid that are comparable with other studies: name, false-alarm rate, least size, shape and scope (fixed values).
SETUPS = (("all", 0.03, 0.0, None, None), ("from_5", 0.03, 0.05, None, None), ("from_10", 0.03, 0.10, None, None), ("steps_from_5", 0.03, 0.05, "step", None), ("territory_from_5", 0.03, 0.05, None, "mo"), ("from_5_far_5", 0.05, 0.05, None, None))


def _setup_sql(name: str, far: float, least: float, shape: str | None, scope: str | None) -> str:
    more = "".join(f" AND split_part(scenario, '|', {i}) = '{v}'" for i, v in ((2, shape), (1, scope)) if v)
    return f"SELECT '{name}' AS setup, detector, round(avg(recall), 6) AS recall, round(avg(recall_at_onset), 6) AS recall_at_onset, round(avg(precision), 6) AS precision, round(avg(delay), 6) AS delay, count(*) AS n_scenarios FROM ev WHERE far = {far} AND CAST(split_part(scenario, '|', 3) AS INTEGER) >= {int(least * 1000)}{more} GROUP BY detector"


@query(_GRID + " " + " UNION ALL ".join(_setup_sql(*x) for x in SETUPS))
def comparable_setups(spark: SparkSession, sf: str) -> DataFrame:
    """Means by detector over six overlapping subsets of the grid, in one pass."""
    part = F.split("scenario", r"\|")
    tests = [
        (name, (F.col("far") == far) & (part[2].cast("int") >= int(least * 1000)) & (F.lit(True) if shape is None else part[1] == shape) & (F.lit(True) if scope is None else part[0] == scope))
        for name, far, least, shape, scope in SETUPS
    ]
    rows = full_grid(spark, sf).withColumn("setup", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))))
    return rows.groupBy("setup", "detector").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall", "recall_at_onset", "precision", "delay")], F.count("*").alias("n_scenarios"))


def real_alarms(spark: SparkSession, sf: str, far: float = 0.05) -> DataFrame:
    """Alarms of the windowed CUSUM on the series as they are, at the threshold that a share ``far`` of monitored scores exceeds."""
    s = the_streams(spark, sf)
    s = materialize(s.withColumns({"score": dt.cusum_w(s, "c", KEYS), "shocked": F.lit(False)}), "scores")
    th = dt.thresholds(s, [], (far,))
    return s.crossJoin(F.broadcast(th)).withColumn("alarm", F.round("score", 9) > F.round("threshold", 9)).where(F.col("t").between(*DEFAULT.detect.monitor))


REAL = STREAMS + f""", s AS (SELECT territory_id, category, cat_idx, t, {_cusum_w("c", _P)} AS score FROM st),
al AS (SELECT s.*, round(score, 9) > round((SELECT quantile_cont(score, 0.95) FROM s WHERE t BETWEEN 12 AND 23), 9) AS alarm FROM s WHERE t BETWEEN 12 AND 23)"""


@query(REAL + " SELECT t, category, round(avg(alarm::INT), 6) AS share, avg(alarm::INT) > 0.1 AS systemic FROM al GROUP BY t, category")
def alarm_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of alarms by month and category; a month is systemic above twice the false-alarm rate."""
    a = F.avg(F.col("alarm").cast("int"))
    return real_alarms(spark, sf).groupBy("t", "category").agg(F.round(a, 6).alias("share"), (a > 0.1).alias("systemic"))


@query(REAL + " SELECT territory_id, category, t, round(score, 6) AS score FROM (SELECT *, lag(alarm) OVER (PARTITION BY territory_id, category ORDER BY t) AS before FROM al) WHERE alarm AND before IS DISTINCT FROM true")
def first_alarms(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy("t")
    rows = real_alarms(spark, sf).withColumn("before", F.lag("alarm").over(w))
    return rows.where(F.col("alarm") & ~F.coalesce("before", F.lit(False))).select(*KEYS, "t", r6(F.col("score")).alias("score"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY " + _draw("'sample'", "l_orderkey", "l_linenumber") + ", l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 500")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A reproducible sample of 500 rows; a smaller one with the same seed is a subset of it."""
    rows = tb.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return rows.orderBy(draw(F.lit("sample"), F.col("l_orderkey"), F.col("l_linenumber")), "l_orderkey", "l_linenumber").limit(500)
