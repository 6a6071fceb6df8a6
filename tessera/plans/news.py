"""Event, exposure and hazard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import DEFAULT
from tessera.functions import draw, r6, stats
from tessera.operators import detect as dt
from tessera.operators import news as nw
from tessera.operators.quantiles import quantile
from tessera.plans import sql
from tessera.plans.sql import _U, _poisson_sql
from tessera.plans.detection import KEYS, REAL, RECURSIVE, STREAMS, _cusum_w, _draw, bocpd_sql, real_alarms, the_streams
from tessera.plans.forecasting import decomposed, forecasts, the_panel
from tessera.sources import tables as tb
from tessera.storage import materialize

QUERIES, ORACLE = {}, {}
#: Trigger words and phrases of each event type in the fixture texts.
RULES = {"emergency": ("was", "of the"), "utility": ("that", "in the"), "economy": ("with", "pour", "que")}
#: Fixture gazetteer: term, territory, region (a null territory names a region). ``at`` is a homonym.
GAZETTEER = (("er", 0, 0), ("on", 1, 1), ("an", 2, 1), ("at", 3, 1), ("at", 6, 3), ("this", None, 1), ("from", None, 3), ("es", None, 2))


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent and high orders as events; with status P only the customer's region is known, otherwise the nation."""
    o = tb.table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderdate") >= "1998-01-01") & (F.col("o_orderdate") < "2000-01-01"))
    c = tb.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("territory_id")).join(tb.regions(spark, sf), "territory_id")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    area = F.col("o_orderstatus") == "P"
    return rows.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("date").alias("date"),
        F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "emergency").otherwise("utility")).alias("types"),
        F.when(area, F.array().cast("array<int>")).otherwise(F.array("territory_id")).alias("territory_ids"),
        F.when(area, F.array("region_code")).otherwise(F.array().cast("array<int>")).alias("region_codes"))


EVENTS = """ev AS (SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderpriority = '1-URGENT' THEN 'emergency' ELSE 'utility' END AS type,
  c_nationkey AS territory_id, n_regionkey AS region_code, o_orderstatus = 'P' AS area
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '2000-01-01'),
expo AS (SELECT territory_id, type, month, sum(w) AS exposure FROM (
  SELECT m.territory_id, type, CAST(date_trunc('month', date) + to_months(CAST(lag AS INTEGER)) AS DATE) AS month,
    m.w * CASE WHEN lag = 0 THEN (day(last_day(date)) - day(date) + 1) / day(last_day(date))::DOUBLE ELSE pow(0.5, lag - 1) END AS w
  FROM (SELECT event_id, date, type, territory_id, 1.0 AS w FROM ev WHERE NOT area
        UNION ALL SELECT event_id, date, type, n_nationkey, 0.3 FROM ev JOIN nation ON n_regionkey = region_code WHERE area) m CROSS JOIN range(4) l(lag)) GROUP BY ALL)"""


@query("WITH " + EVENTS + " SELECT territory_id, type, CAST(month AS VARCHAR) AS month, round(exposure, 6) AS exposure FROM expo")
def monthly_exposure(spark: SparkSession, sf: str) -> DataFrame:
    out = nw.monthly_exposure(events(spark, sf), tb.regions(spark, sf))
    return out.withColumns({"month": F.col("month").cast("string"), "exposure": r6(F.col("exposure"))})


_BY_SOURCE = EVENTS[: EVENTS.index("expo AS (")].replace("n_regionkey AS region_code,", "n_regionkey AS region_code, CAST(o_custkey % 5 AS VARCHAR) AS source,") + EVENTS[EVENTS.index("expo AS (") :].replace("type", "source")


@query("WITH " + _BY_SOURCE + " SELECT territory_id, CAST(month AS VARCHAR) AS month, source, round(exposure, 6) AS exposure, round(sum(exposure) OVER (PARTITION BY territory_id, month) - exposure, 6) + 0.0 AS without FROM expo")
def exposure_leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    """Exposure with each source left out; a source is one of five groups of customers."""
    source = tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 5).cast("string").alias("source"))
    out = nw.exposure_without(events(spark, sf).join(source, "event_id"), tb.regions(spark, sf))
    return out.select("territory_id", F.col("month").cast("string").alias("month"), "source", r6(F.col("exposure")).alias("exposure"), r6(F.col("without")).alias("without"))


_HAZ = "WITH " + sql.PANEL + "," + EVENTS + """, hz AS (SELECT territory_id, month, sum(exposure) AS x FROM expo GROUP BY territory_id, month),
hm AS (SELECT p.*, 1 + 4.0 * least(coalesce(x, 0), 2.0) AS mult FROM panel p LEFT JOIN hz USING (territory_id, month))"""


@query(_HAZ + " SELECT territory_id, t, round(max(mult), 6) AS mult FROM hm GROUP BY territory_id, t")
def hazard_multiplier(spark: SparkSession, sf: str) -> DataFrame:
    out = nw.hazard_multiplier(the_panel(spark, sf), nw.monthly_exposure(events(spark, sf), tb.regions(spark, sf)))
    return out.groupBy("territory_id", "t").agg(r6(F.max("mult")).alias("mult"))


@query(
    RECURSIVE + "," + _HAZ[_HAZ.index(EVENTS) :] + ", sm AS (SELECT st.*, mult FROM st JOIN hm USING (territory_id, category, t))"
    + bocpd_sql("sm", "territory_id, category", "greatest(1e-4, least(0.9, 0.02 * mult))")
    + " SELECT territory_id, category, t, round(mult, 6) AS mult, round(score, 6) + 0.0 AS score FROM bo JOIN sm USING (territory_id, category, t)"
)
def bocpd_news(spark: SparkSession, sf: str) -> DataFrame:
    """Bayesian change points whose hazard follows the news."""
    months = the_panel(spark, sf).select(*KEYS, "t", "month")
    rows = the_streams(spark, sf).join(months, [*KEYS, "t"])
    rows = nw.hazard_multiplier(rows, nw.monthly_exposure(events(spark, sf), tb.regions(spark, sf)))
    return dt.bocpd(rows, "x", KEYS, mult="mult").select(*KEYS, "t", r6(F.col("mult")).alias("mult"), r6(F.col("score")).alias("score"))


def _rule_sql(kind: str) -> str:
    return f"CASE WHEN {' OR '.join(f"contains(p, ' {w} ')" for w in RULES[kind])} THEN '{kind}' END"


PADDED = "(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') || ' ')"


@query(f"SELECT doc_id, unnest(list_filter([{', '.join(map(_rule_sql, RULES))}], lambda x: x IS NOT NULL)) AS type FROM (SELECT doc_id, {PADDED} AS p FROM documents)")
def event_types(spark: SparkSession, sf: str) -> DataFrame:
    return tb.table(spark, sf, "documents").select("doc_id", F.explode(nw.typed(F.col("text"), RULES)).alias("type"))


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GAZETTEER), "term string, territory_id int, region_code int")


_GAZ = ", ".join(f"('{t}', {'NULL' if p is None else p}, {r})" for t, p, r in GAZETTEER)


@query(
    f"""WITH gaz AS (SELECT term, CAST(p AS INTEGER) AS territory_id, CAST(r AS INTEGER) AS region_code FROM (VALUES {_GAZ}) v(term, p, r)),
w AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents),
nm AS (SELECT DISTINCT id, term, territory_id, region_code FROM w JOIN gaz USING (term)),
ar AS (SELECT DISTINCT id, region_code FROM nm WHERE territory_id IS NULL),
pl AS (SELECT nm.*, (SELECT count(DISTINCT territory_id) FROM gaz g WHERE g.term = nm.term AND g.territory_id IS NOT NULL) AS k FROM nm WHERE territory_id IS NOT NULL),
ok AS (SELECT id, territory_id, region_code FROM pl WHERE k = 1 UNION SELECT p.id, p.territory_id, p.region_code FROM pl p JOIN ar USING (id, region_code) WHERE k > 1),
res AS (SELECT * FROM ok UNION SELECT id, NULL, region_code FROM ar WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.id = ar.id AND ok.region_code = ar.region_code))
SELECT id AS doc_id, coalesce(territory_id, -1) AS territory_id, region_code FROM res"""
)
def geocode_terms(spark: SparkSession, sf: str) -> DataFrame:
    out = nw.geocode(tb.table(spark, sf, "documents"), gazetteer(spark), "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("territory_id", F.lit(-1)).alias("territory_id"), "region_code")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """A report of each order: who it is for, and whose goods its first line holds. ``id, region_code`` (the customer's), ``text``."""
    place = tb.table(spark, sf, "nation").join(tb.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", "r_regionkey")
    buyer = tb.table(spark, sf, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("to_nation"), F.col("r_regionkey").alias("region_code"))
    seller = tb.table(spark, sf, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", F.col("r_name").alias("from_region"))
    line = tb.table(spark, sf, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", "Returned").otherwise("Delivered").alias("fate"))
    o = tb.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rows = o.join(buyer, F.col("o_custkey") == F.col("c_custkey")).join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(seller, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    second = F.concat(F.lit(" "), F.col("fate"), F.lit(" goods of "), F.col("s_name"), F.lit(" in "), F.col("from_region"), F.lit("!"))
    return rows.select(F.col("o_orderkey").alias("id"), "region_code", F.concat(F.col("o_orderpriority"), F.lit(" order for "), F.col("to_nation"), F.lit("."), F.coalesce(second, F.lit(""))).alias("text"))


#: Sentences that count, and names that don't: suppliers whose number ends in 7 (fixed values of the fixture).
URGENT = "(?i)urgent|high|returned"


def names(spark: SparkSession, sf: str) -> DataFrame:
    """The gazetteer of nations, suppliers (at their nation) and regions, less stop names."""
    nation = tb.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("territory_id"), F.col("n_regionkey").alias("region_code"))
    supplier = tb.table(spark, sf, "supplier").select("s_name", F.col("s_nationkey").alias("territory_id")).join(nation.drop("name"), "territory_id").select(F.col("s_name").alias("name"), "territory_id", "region_code")
    region = tb.table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region_code"))
    return nw.build_gazetteer(nation.unionByName(supplier), region, supplier.where(F.col("name").endswith("7")).select("name"))


_NAMES = """place AS (SELECT n_nationkey, n_name, r_name, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey),
rep AS (SELECT o_orderkey AS id, b.r_regionkey AS region_code, o_orderpriority || ' order for ' || b.n_name || '.' ||
    coalesce(' ' || CASE WHEN l_returnflag = 'R' THEN 'Returned' ELSE 'Delivered' END || ' goods of ' || s_name || ' in ' || q.r_name || '!', '') AS text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN place b ON c_nationkey = b.n_nationkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1
  LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN place q ON q.n_nationkey = s_nationkey),
nam AS (SELECT n_name AS name, n_nationkey AS territory_id, n_regionkey AS region_code FROM nation
  UNION SELECT s_name, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_name NOT LIKE '%7' UNION SELECT r_name, NULL, r_regionkey FROM region),
gaz AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(name), '[\\p{L}\\p{N}_#]+'), ' ') AS phrase, territory_id, region_code FROM nam),
sen AS (SELECT id, region_code, k, regexp_extract_all(lower(s), '[\\p{L}\\p{N}_#]+') AS w FROM (SELECT id, region_code, unnest(ss) AS s, generate_subscripts(ss, 1) AS k
  FROM (SELECT id, region_code, string_split(regexp_replace(text, '([.!?;])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM rep)) WHERE regexp_matches(s, '(?i)urgent|high|returned')),
gra AS (SELECT id, region_code, k, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM sen, range(1, 65) a(i), range(1, 3) b(n) WHERE i + n - 1 <= len(w)),
mat AS (SELECT g.*, z.territory_id, z.region_code AS named_region FROM gra g JOIN gaz z USING (phrase)),
kep AS (SELECT * FROM mat m WHERE NOT EXISTS (SELECT 1 FROM mat o WHERE o.id = m.id AND o.k = m.k AND o.n > m.n AND o.i <= m.i AND o.i + o.n >= m.i + m.n)),
hit AS (SELECT id, min(territory_id) AS territory_id FROM kep WHERE territory_id IS NOT NULL AND named_region = region_code GROUP BY id, k, i HAVING count(DISTINCT territory_id) = 1),
ter AS (SELECT id, array_to_string(list_sort(list(DISTINCT territory_id)), ',') AS territories FROM hit GROUP BY id)"""


@query("WITH " + _NAMES + " SELECT id, coalesce(territories, '') AS territories, CASE WHEN territories IS NULL THEN CAST(region_code AS VARCHAR) ELSE '' END AS regions FROM rep LEFT JOIN ter USING (id)")
def geocode_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Places that urgent sentences of reports name in their own region; the region where they name none."""
    out = nw.geocode_sentences(reports(spark, sf), names(spark, sf), URGENT)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("id", text("territory_ids").alias("territories"), text("region_codes").alias("regions"))


@query(
    """WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?;])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents)
SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (WHERE regexp_matches(lower(sentence), 'was|that')) AS n_matching FROM s GROUP BY doc_id"""
)
def sentence_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of each text and those that match the emergency pattern."""
    s = nw.sentences(tb.table(spark, sf, "documents"), "doc_id", "text")
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.count(F.when(F.col("sentence").rlike("(?i)was|that"), 1)).alias("n_matching"))


@query("SELECT o_orderkey AS act_id, o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_regime, CASE WHEN o_orderstatus = 'O' THEN 'introduce' WHEN o_orderstatus = 'F' THEN 'lift' ELSE 'other' END AS action FROM orders")
def act_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Acts by rules on their titles (here: priority and status as the title)."""
    title = F.concat_ws(" ", "o_orderpriority", "o_orderstatus")
    action = F.when(title.rlike(r" O$"), "introduce").when(title.rlike(r" F$"), "lift").otherwise("other")
    return tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("act_id"), title.rlike("^(1-URGENT|2-HIGH) ").alias("is_regime"), action.alias("action"))


_NEAR = REAL + "," + EVENTS + """,
am AS (SELECT territory_id, category, CAST(DATE '1998-01-01' + to_months(t) AS DATE) AS month FROM al WHERE alarm),
hit AS (SELECT a.territory_id, a.category, a.month, 2 AS lim, e.event_id, e.date FROM am a JOIN ev e ON e.territory_id = a.territory_id AND NOT e.area
    AND date_trunc('month', e.date) BETWEEN a.month - INTERVAL 1 MONTH AND a.month + INTERVAL 1 MONTH
  UNION ALL SELECT a.territory_id, a.category, a.month, 1, e.event_id, e.date FROM am a JOIN nation n ON n.n_nationkey = a.territory_id JOIN ev e ON e.area AND e.region_code = n.n_regionkey
    AND date_trunc('month', e.date) BETWEEN a.month - INTERVAL 1 MONTH AND a.month + INTERVAL 1 MONTH),
rk AS (SELECT *, row_number() OVER (PARTITION BY territory_id, category, month, lim ORDER BY date, event_id) AS r FROM hit)"""


@query(_NEAR + " SELECT territory_id, category, CAST(month AS VARCHAR) AS month, array_to_string(list_sort(list(DISTINCT CAST(event_id AS VARCHAR))), ' || ') AS events FROM rk WHERE r <= lim GROUP BY territory_id, category, month")
def alarm_news(spark: SparkSession, sf: str) -> DataFrame:
    a = real_alarms(spark, sf).where("alarm").select(*KEYS, F.add_months(F.lit(DEFAULT.panel.start).cast("date"), F.col("t")).alias("month"))
    return nw.near_alarms(a, events(spark, sf), tb.regions(spark, sf)).withColumn("month", F.col("month").cast("string"))


_WATCH = STREAMS + "," + EVENTS + """, x AS (SELECT territory_id, datediff('month', DATE '1998-01-01', month) AS t, sum(exposure) AS x FROM expo WHERE type = 'emergency' GROUP BY ALL),
zz AS (SELECT s.territory_id, s.t, z, coalesce(x.x, 0) AS x, quantile_cont(z, 0.1) OVER (PARTITION BY s.t) AS cut FROM st s LEFT JOIN x USING (territory_id, t) WHERE s.t >= 12)"""


@query(_WATCH + " SELECT t, count(*) FILTER (WHERE x > 0.5) AS n_watch, round(avg((z < cut)::INT) FILTER (WHERE x > 0.5), 6) AS precision, round(avg((z < cut)::INT), 6) AS base_rate FROM zz GROUP BY t")
def watchlist(spark: SparkSession, sf: str) -> DataFrame:
    """Series in exposed territories: how many fall to the month's worst tenth, against all series."""
    months = F.round(F.months_between("month", F.lit(DEFAULT.panel.start).cast("date"))).cast("int")
    x = nw.monthly_exposure(events(spark, sf), tb.regions(spark, sf)).where("type = 'emergency'").groupBy("territory_id", months.alias("t")).agg(F.sum("exposure").alias("x"))
    rows = the_streams(spark, sf).where("t >= 12").select(*KEYS, "t", "z").join(x, ["territory_id", "t"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    rows = materialize(rows, "exposed")
    rows = rows.join(quantile(rows, ["t"], "z", 0.1, "cut"), "t").withColumn("low", (F.col("z") < F.col("cut")).cast("int"))
    on = F.col("x") > 0.5
    return rows.groupBy("t").agg(F.count(F.when(on, 1)).alias("n_watch"), r6(F.avg(F.when(on, F.col("low")))).alias("precision"), r6(F.avg("low")).alias("base_rate"))


@query(
    STREAMS + "," + EVENTS + """, tr AS (SELECT DISTINCT territory_id, datediff('month', DATE '1998-01-01', date_trunc('month', date)) AS t FROM ev WHERE NOT area AND type = 'emergency'),
g AS (SELECT s.t, s.z, CASE WHEN EXISTS (SELECT 1 FROM tr WHERE tr.territory_id = s.territory_id AND tr.t = s.t) THEN 'named'
  WHEN EXISTS (SELECT 1 FROM tr JOIN nation m ON m.n_nationkey = tr.territory_id WHERE tr.t = s.t AND m.n_regionkey = n.n_regionkey) THEN 'same_region' ELSE 'rest' END AS grp
  FROM st s JOIN nation n ON n.n_nationkey = s.territory_id WHERE s.t >= 12)
SELECT t, grp, count(z) AS n, round(median(z), 6) + 0.0 AS median_z FROM g GROUP BY t, grp"""
)
def event_study(spark: SparkSession, sf: str) -> DataFrame:
    t = F.round(F.months_between(F.trunc("date", "MM"), F.lit(DEFAULT.panel.start).cast("date"))).cast("int")
    treated = events(spark, sf).where(F.array_contains("types", "emergency")).select(F.explode("territory_ids").alias("territory_id"), t.alias("t"))
    out = nw.event_study(the_streams(spark, sf).where("t >= 12").select("territory_id", "t", "z"), treated, tb.regions(spark, sf))
    return out.withColumn("median_z", r6(F.col("median_z")))


@query(
    sql.FORECASTS + "," + EVENTS + """, x AS (SELECT territory_id, datediff('month', DATE '1998-01-01', month) AS t, sum(exposure) AS x FROM expo GROUP BY ALL),
e AS (SELECT f.split, coalesce(x.x, 0) AS x, ln(f.y) - f.lf AS e FROM fc f LEFT JOIN x USING (territory_id, t) WHERE f.model = 'level_season' AND f.h = 1 AND f.y IS NOT NULL AND f.lf IS NOT NULL),
b AS (SELECT sum(x * e) / greatest(sum(x * x), 1e-9) AS beta FROM e WHERE split = 'val')
SELECT round(max(beta), 6) + 0.0 AS beta, round(avg(abs(e)), 6) AS mae_without, round(avg(abs(e - beta * x)), 6) AS mae_with, round(avg((x > 0)::INT), 6) AS share_exposed FROM e CROSS JOIN b WHERE split = 'test'"""
)
def exposure_correction(spark: SparkSession, sf: str) -> DataFrame:
    months = F.round(F.months_between("month", F.lit(DEFAULT.panel.start).cast("date"))).cast("int")
    x = nw.monthly_exposure(events(spark, sf), tb.regions(spark, sf)).groupBy("territory_id", months.alias("t")).agg(F.sum("exposure").alias("x"))
    f = forecasts(spark, sf, ("level_season",)).where("h = 1 and y is not null and lf is not null")
    rows = f.join(x, ["territory_id", "t"], "left").select("split", F.coalesce("x", F.lit(0.0)).alias("x"), (F.log("y") - F.col("lf")).alias("e"))
    b = nw.correction(rows.where("split = 'val'"))
    out = rows.where("split = 'test'").crossJoin(F.broadcast(b))
    return out.agg(r6(F.max("beta")).alias("beta"), r6(F.avg(F.abs("e"))).alias("mae_without"), r6(F.avg(F.abs(F.col("e") - F.col("beta") * F.col("x")))).alias("mae_with"), r6(F.avg((F.col("x") > 0).cast("int"))).alias("share_exposed"))


@query("WITH " + EVENTS + " SELECT type, strftime(date, '%Y-%m') AS month, count(*) AS n_events, count(*) FILTER (WHERE area) AS n_region_only, count(DISTINCT CASE WHEN NOT area THEN territory_id END) AS n_territories FROM ev GROUP BY ALL")
def event_coverage(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select(F.explode("types").alias("type"), F.date_format("date", "yyyy-MM").alias("month"), (F.size("region_codes") > 0).alias("area"), F.get("territory_ids", F.lit(0)).alias("territory_id"))
    return e.groupBy("type", "month").agg(F.count("*").alias("n_events"), F.count(F.when(F.col("area"), 1)).alias("n_region_only"), F.countDistinct("territory_id").alias("n_territories"))


@query("WITH " + sql.PANEL + "," + EVENTS + """, tr AS (SELECT DISTINCT e.territory_id, CAST(datediff('month', DATE '1998-01-01', date_trunc('month', e.date)) AS INTEGER) AS t FROM ev e WHERE NOT area AND type = 'emergency'),
dz AS (SELECT territory_id, category, t, d - lag(d) OVER (PARTITION BY territory_id, category ORDER BY t) AS dd FROM dec WHERE is_full),
own AS (SELECT tr.territory_id, tr.t, avg(dd) AS v FROM tr JOIN dz USING (territory_id, t) GROUP BY ALL),
ctl AS (SELECT o.territory_id, o.t, avg(z.dd) AS v FROM own o JOIN nation a ON a.n_nationkey = o.territory_id JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey <> o.territory_id
  JOIN dz z ON z.territory_id = b.n_nationkey AND z.t = o.t WHERE NOT EXISTS (SELECT 1 FROM tr x WHERE x.territory_id = b.n_nationkey AND x.t = o.t) GROUP BY o.territory_id, o.t)
SELECT o.territory_id, o.t, round(o.v - c.v, 6) + 0.0 AS effect FROM own o JOIN ctl c USING (territory_id, t)""")
def pooled_study(spark: SparkSession, sf: str) -> DataFrame:
    """Change of named territories less that of untreated territories of the same region and month: a treated territory is not
    among these, so one mean a region and month serves all."""
    t = F.round(F.months_between(F.trunc("date", "MM"), F.lit(DEFAULT.panel.start).cast("date"))).cast("int")
    treated = events(spark, sf).where(F.array_contains("types", "emergency")).select(F.explode("territory_ids").alias("territory_id"), t.alias("t")).distinct()
    d = decomposed(spark, sf).where("is_full").withColumn("dd", F.col("d") - F.lag("d").over(Window.partitionBy(*KEYS).orderBy("t"))).select("territory_id", "t", "dd")
    reg = tb.regions(spark, sf).select("territory_id", "region_code")
    own = treated.join(d, ["territory_id", "t"]).groupBy("territory_id", "t").agg(F.avg("dd").alias("v")).join(reg, "territory_id")
    free = d.join(treated, ["territory_id", "t"], "left_anti").join(reg, "territory_id")
    return own.join(free.groupBy("region_code", "t").agg(F.avg("dd").alias("c")), ["region_code", "t"]).select("territory_id", "t", r6(F.col("v") - F.col("c")).alias("effect"))


def with_alarm_soon(spark: SparkSession, sf: str) -> DataFrame:
    """Monitored months of series with ``z`` and ``soon``: an alarm in that month or the next."""
    rows = real_alarms(spark, sf, 0.03).select(*KEYS, "t", "z", "alarm")
    later = F.coalesce(F.lead("alarm").over(Window.partitionBy(*KEYS).orderBy("t")), F.lit(False))
    return materialize(rows.select(*KEYS, "t", "z", (F.col("alarm") | later).cast("int").alias("soon")), "soon")


def _month_of(date: str):
    return F.round(F.months_between(F.trunc(date, "MM"), F.lit(DEFAULT.panel.start).cast("date"))).cast("int")


_SOON = STREAMS + f""", sco AS (SELECT territory_id, category, t, z, {_cusum_w("c", "PARTITION BY territory_id, category")} AS score FROM st),
ala AS (SELECT territory_id, category, t, z, round(score, 9) > round((SELECT quantile_cont(score, 0.97) FROM sco WHERE t BETWEEN 12 AND 23), 9) AS alarm FROM sco WHERE t BETWEEN 12 AND 23),
soon AS (SELECT territory_id, category, t, z, (alarm OR coalesce(lead(alarm) OVER (PARTITION BY territory_id, category ORDER BY t), false))::INT AS soon FROM ala),""" + EVENTS


@query(
    _SOON + f""", tr AS (SELECT DISTINCT territory_id, CAST(datediff('month', DATE '1998-01-01', date_trunc('month', date)) AS INTEGER) AS t FROM ev WHERE NOT area AND type = 'emergency'),
ow AS (SELECT s.*, n_regionkey AS region FROM soon s JOIN tr USING (territory_id, t) JOIN nation ON n_nationkey = territory_id),
ct AS (SELECT n_regionkey AS region, category, t, avg(z) AS z, avg(soon) AS soon FROM soon s JOIN nation ON n_nationkey = s.territory_id WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.territory_id = s.territory_id AND tr.t = s.t) GROUP BY ALL),
dfe AS (SELECT o.region, unnest([o.category, 'every']) AS category, o.z - c.z AS dz, o.soon - c.soon AS dal FROM ow o JOIN ct c USING (region, category, t)),
lo AS (SELECT region, category, 'dz' AS measure, dz AS v FROM dfe UNION ALL SELECT region, category, 'alarm', dal FROM dfe),
su AS (SELECT category, measure, region, sum(v) AS s, count(v) AS c FROM lo WHERE v IS NOT NULL GROUP BY ALL),
wb AS (SELECT region, b, {_poisson_sql(_U('cluster', 'region'))} AS w FROM (SELECT DISTINCT region FROM su) CROSS JOIN range({stats.DRAWS}) r(b)),
mb AS (SELECT category, measure, b, sum(w * s) / sum(w * c) AS m FROM su JOIN wb USING (region) WHERE w > 0 GROUP BY ALL),
ci AS (SELECT category, measure, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high, least(1.0, 2 * least(avg((m <= 0)::INT), avg((m >= 0)::INT))) AS p FROM mb GROUP BY ALL)
SELECT category, measure, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_clusters, round(sum(s) / sum(c), 6) + 0.0 AS mean, round(any_value(ci_low), 6) + 0.0 AS ci_low, round(any_value(ci_high), 6) + 0.0 AS ci_high, round(any_value(p), 6) AS p
FROM su JOIN ci USING (category, measure) GROUP BY category, measure"""
)
def pooled_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised errors and alarms of named series less those of untreated ones of their region, category and month; intervals and p
    by resampling regions."""
    rows = with_alarm_soon(spark, sf).join(tb.regions(spark, sf).select("territory_id", "region_code"), "territory_id")
    treated = events(spark, sf).where(F.array_contains("types", "emergency")).select(F.explode("territory_ids").alias("territory_id"), _month_of("date").alias("t")).distinct()
    own = rows.join(treated, ["territory_id", "t"])
    free = rows.join(treated, ["territory_id", "t"], "left_anti").groupBy("region_code", "category", "t").agg(F.avg("z").alias("cz"), F.avg("soon").alias("cs"))
    both = own.join(free, ["region_code", "category", "t"])
    measures = F.explode(F.array(F.struct(F.lit("dz").alias("measure"), (F.col("z") - F.col("cz")).alias("v")), F.struct(F.lit("alarm").alias("measure"), (F.col("soon") - F.col("cs")).alias("v")))).alias("m")
    long = both.select("region_code", F.explode(F.array("category", F.lit("every"))).alias("category"), "z", "cz", "soon", "cs").select("region_code", "category", measures).select("region_code", "category", "m.*")
    out = stats.cluster_bootstrap(materialize(long, "effects"), ["category", "measure"], "region_code", "v")
    return out.select("category", "measure", "n", "n_clusters", *[r6(F.col(c)).alias(c) for c in ("mean", "ci_low", "ci_high", "p")])


#: Placebo months of an act, out of the monitored ones.
PLACEBOS = 5


@query(
    _SOON + f""", nam AS (SELECT DISTINCT territory_id, CAST(datediff('month', DATE '1998-01-01', date_trunc('month', date)) AS INTEGER) AS t FROM ev WHERE NOT area AND type = 'emergency'),
reg AS (SELECT DISTINCT n_regionkey AS region, t FROM nam JOIN nation ON n_nationkey = territory_id),
g AS (SELECT s.*, n.n_regionkey AS region, EXISTS (SELECT 1 FROM nam WHERE nam.territory_id = s.territory_id AND nam.t = s.t) AS named,
  EXISTS (SELECT 1 FROM reg WHERE reg.region = n.n_regionkey AND reg.t = s.t) AS inside FROM soon s JOIN nation n ON n.n_nationkey = s.territory_id),
k AS (SELECT t, count(*) FILTER (WHERE named AND soon = 1) AS a, count(*) FILTER (WHERE named AND soon = 0) AS b, count(*) FILTER (WHERE NOT inside AND soon = 1) AS c, count(*) FILTER (WHERE NOT inside AND soon = 0) AS d FROM g GROUP BY t),
lf AS (SELECT *, a + b + c + d AS n FROM k)
SELECT t, a + b AS n_named, c + d AS n_rest, round(a / nullif(a + b, 0)::DOUBLE, 6) AS share_named, round(c / nullif(c + d, 0)::DOUBLE, 6) AS share_rest,
  round(least(1.0, list_sum(list_transform(range(a, least(a + b, a + c) + 1), lambda x: exp(lgamma(a + b + 1) + lgamma(n - a - b + 1) + lgamma(a + c + 1) + lgamma(n - a - c + 1) - lgamma(n + 1)
    - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(n - a - b - a - c + x + 1))))), 6) AS p FROM lf"""
)
def named_against_rest(spark: SparkSession, sf: str) -> DataFrame:
    """Share of series with an alarm in the month or the next: those of named territories against regions without any, with an exact test."""
    reg = tb.regions(spark, sf).select("territory_id", "region_code")
    named = events(spark, sf).where(F.array_contains("types", "emergency")).select(F.explode("territory_ids").alias("territory_id"), _month_of("date").alias("t")).distinct()
    areas = named.join(reg, "territory_id").select("region_code", "t").distinct().withColumn("inside", F.lit(True))
    rows = with_alarm_soon(spark, sf).join(reg, "territory_id").join(named.withColumn("named", F.lit(True)), ["territory_id", "t"], "left").join(areas, ["region_code", "t"], "left")
    count = lambda who, v: F.count(F.when(who & (F.col("soon") == v), 1))
    own, rest = F.col("named").isNotNull(), F.col("inside").isNull()
    k = rows.groupBy("t").agg(count(own, 1).alias("a"), count(own, 0).alias("b"), count(rest, 1).alias("c"), count(rest, 0).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    share = lambda x, y: F.round(x / F.nullif(x + y, F.lit(0)), 6)
    return k.select("t", (a + b).alias("n_named"), (c + d).alias("n_rest"), share(a, b).alias("share_named"), share(c, d).alias("share_rest"), F.round(stats.fisher_greater(a, b, c, d), 6).alias("p"))


@query(
    _SOON + f""", act AS (SELECT DISTINCT region_code AS region, CAST(datediff('month', DATE '1998-01-01', date_trunc('month', date)) AS INTEGER) AS t FROM ev WHERE area),
sh AS (SELECT n_regionkey AS region, t, avg(soon) AS share FROM soon JOIN nation ON n_nationkey = territory_id GROUP BY ALL),
pl AS (SELECT act.region, act.t, p.t AS pt, row_number() OVER (PARTITION BY act.region, act.t ORDER BY {_draw("'placebo'", "act.region", "act.t", "p.t")}, p.t) AS r
  FROM act CROSS JOIN (SELECT CAST(unnest(range(12, 24)) AS INTEGER) AS t) p WHERE act.t BETWEEN 12 AND 23),
ps AS (SELECT pl.region, pl.t, avg(share) AS placebo FROM pl JOIN sh ON sh.region = pl.region AND sh.t = pl.pt WHERE r <= {PLACEBOS} GROUP BY ALL)
SELECT act.region AS region_code, count(*) AS n_acts, round(avg(share), 6) AS share_act, round(avg(placebo), 6) AS share_placebo, round(avg(share - placebo), 6) + 0.0 AS difference
FROM act JOIN sh USING (region, t) JOIN ps USING (region, t) GROUP BY act.region"""
)
def acts_against_placebos(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a region's series with an alarm in the month of an act or the next, against five months drawn for the act."""
    reg = tb.regions(spark, sf).select("territory_id", "region_code")
    first, last = DEFAULT.detect.monitor
    acts = events(spark, sf).select(F.explode("region_codes").alias("region_code"), _month_of("date").alias("t")).distinct().where(F.col("t").between(first, last))
    share = materialize(with_alarm_soon(spark, sf).join(reg, "territory_id").groupBy("region_code", "t").agg(F.avg("soon").alias("share")), "shares")
    months = F.array_sort(F.transform(F.sequence(F.lit(first), F.lit(last)), lambda m: F.struct(draw(F.lit("placebo"), F.col("region_code"), F.col("t"), m).alias("u"), m.alias("pt"))))
    drawn = acts.select("region_code", "t", F.explode(F.slice(months, 1, PLACEBOS)).alias("m")).select("region_code", "t", "m.pt")
    placebo = drawn.join(share.select("region_code", F.col("t").alias("pt"), "share"), ["region_code", "pt"]).groupBy("region_code", "t").agg(F.avg("share").alias("placebo"))
    rows = acts.join(share, ["region_code", "t"]).join(placebo, ["region_code", "t"])
    return rows.groupBy("region_code").agg(F.count("*").alias("n_acts"), F.round(F.avg("share"), 6).alias("share_act"), F.round(F.avg("placebo"), 6).alias("share_placebo"), r6(F.avg(F.col("share") - F.col("placebo"))).alias("difference"))
