"""Scans, sinks, reshaping, lookups and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import r6
from tessera.operators import panel as pn
from tessera.plans import sql
from tessera.plans.forecasting import forecasts, the_panel
from tessera.sources import envelope, portal
from tessera.sources import tables as tb
from tessera.storage import shared_dir

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def scan_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Predicate and columns reach the Parquet scan."""
    return tb.table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    tb.write_results(tb.table(spark, sf, "nation"), path)
    return tb.read_results(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, c_acctbal > 0 AS positive FROM customer")
def envelope_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as typed envelopes, decoded again."""
    c = tb.table(spark, sf, "customer")
    sent = c.select(*[envelope.encode(v, k).alias(n) for n, v, k in (
        ("id", F.col("c_custkey"), "number"), ("name", F.col("c_name"), "string"), ("bal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")), "number"), ("pos", F.col("c_acctbal") > 0, "boolean"))])
    return sent.select(*[envelope.decode_flat(F.col(n), t).alias(o) for n, t, o in (("id", "long", "c_custkey"), ("name", "string", "c_name"), ("bal", "double", "c_acctbal"), ("pos", "boolean", "positive"))])


@query("SELECT i AS id, 'row-' || i AS label FROM range(50) r(i)")
def portal_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset of five pages read by a partition each (built-in transport)."""
    return portal.dataset(spark, "data", 5)


@query("SELECT url, min(page_id) AS page_id FROM (SELECT * FROM pages UNION ALL SELECT * FROM pages) GROUP BY url")
def dedup_by_url(spark: SparkSession, sf: str) -> DataFrame:
    """Two crawls of the same pages: the first copy of each address stays."""
    p = tb.table(spark, sf, "pages").select("url", "page_id")
    return tb.latest(p.unionByName(p), ["url"], F.col("page_id").asc())


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def latest_record(spark: SparkSession, sf: str) -> DataFrame:
    c = tb.table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return tb.latest(c, ["c_mktsegment"], F.col("c_acctbal").desc(), F.col("c_custkey").asc())


@query("SELECT r_regionkey, CAST(to_json({'key': r_regionkey, 'name': r_name}) AS VARCHAR) AS js FROM region")
def json_sink(spark: SparkSession, sf: str) -> DataFrame:
    return tb.table(spark, sf, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))).alias("js"))


@query("SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def content_manifest(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("text").cast("binary")
    return tb.table(spark, sf, "documents").select("doc_id", F.sha2(b, 256).alias("sha256"), F.octet_length(b).cast("long").alias("bytes"))


@query(sql.FORECASTS + " SELECT model, count(*) AS n, count(DISTINCT o) AS n_origins FROM fc WHERE model IN ('naive', 'mean3') GROUP BY model")
def forecast_store(spark: SparkSession, sf: str) -> DataFrame:
    """A stopped run left half of the origins; the rerun adds the rest and nothing twice."""
    path = f"{shared_dir(spark)}/forecasts-{uuid.uuid4().hex}"
    f = forecasts(spark, sf, ("naive", "mean3")).select("model", "territory_id", "category", "o", "h", "yhat")
    tb.write_forecasts(f.where("o < 12"), path, spark)
    return tb.write_forecasts(f, path, spark).groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("o").alias("n_origins"))


@query("SELECT n_regionkey AS region_code, replace(format('{:,.2f}', sum(c_acctbal)), ',', ' ') AS shown FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def number_format(spark: SparkSession, sf: str) -> DataFrame:
    """Report numbers with spaces between thousands."""
    rows = tb.table(spark, sf, "customer").join(tb.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_regionkey").alias("region_code")).agg(F.translate(F.format_number(F.sum("c_acctbal"), 2), ",", " ").alias("shown"))


@query("WITH " + sql.SALES + " SELECT CAST(month AS VARCHAR) AS month, " + ", ".join(f"round(sum(y) FILTER (WHERE category = '{c}'), 2) AS {c}" for c in ("ALL", "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")).replace("AS ALL", 'AS "ALL"') + " FROM sales GROUP BY month")
def national_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Long published series to one column a category."""
    cats = ["ALL", "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return tb.national_sales(spark, sf).groupBy(F.col("month").cast("string").alias("month")).pivot("category", cats).agg(F.round(F.sum("value"), 2))


@query("WITH " + sql.PANEL + " SELECT territory_id, t, array_to_string(list(coalesce(CAST(y IS NOT NULL AS INTEGER), 0) ORDER BY cat_idx), ',') AS present, count(*) AS n FROM panel GROUP BY territory_id, t")
def multivariate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The categories of a territory and month as one ordered vector (here: which are present)."""
    v = F.array_sort(F.collect_list(F.struct("cat_idx", F.col("y").isNotNull().cast("int").alias("p"))))
    return the_panel(spark, sf).groupBy("territory_id", "t").agg(v.alias("v"), F.count("*").alias("n")).select("territory_id", "t", F.array_join(F.col("v.p").cast("array<string>"), ",").alias("present"), "n")


@query("WITH " + sql.PANEL + " SELECT territory_id, category, t, round(d - avg(d) OVER (PARTITION BY territory_id, t), 6) + 0.0 AS gap, round(max(CASE WHEN cat_idx = 0 THEN d END) OVER (PARTITION BY territory_id, t), 6) + 0.0 AS d_all FROM dec WHERE is_full")
def sibling_join(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("territory_id", "t")
    d = pn.decompose(the_panel(spark, sf)).where("is_full")
    return d.select("territory_id", "category", "t", r6(F.col("d") - F.avg("d").over(w)).alias("gap"), r6(F.max(F.when(F.col("cat_idx") == 0, F.col("d"))).over(w)).alias("d_all"))


@query("SELECT o.o_orderkey, coalesce(max(p.o_orderkey), -1) AS previous FROM orders o LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) p ON p.o_custkey = o.o_custkey AND p.r = (SELECT count(*) FROM orders q WHERE q.o_custkey = o.o_custkey AND (q.o_orderdate < o.o_orderdate)) WHERE o.o_orderpriority = '1-URGENT' GROUP BY o.o_orderkey")
def asof_previous(spark: SparkSession, sf: str) -> DataFrame:
    """As-of join: of each urgent order the customer's latest order before its day. One window over the union, no range join."""
    from pyspark.sql.window import Window

    o = tb.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    w = Window.partitionBy("o_custkey").orderBy(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    rows = o.withColumn("previous", F.coalesce(F.max(F.struct("o_orderdate", "o_orderkey")).over(w)["o_orderkey"], F.lit(-1)))
    return rows.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "previous")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey")
def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    o = tb.table(spark, sf, "orders").select("o_custkey", "o_orderpriority")
    rich = tb.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    calm = o.join(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"), "o_custkey", "left_anti")
    return calm.join(rich, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT territory, n FROM (SELECT c_nationkey AS territory FROM customer INTERSECT SELECT s_nationkey FROM supplier) CROSS JOIN (SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier))")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    c, s = tb.table(spark, sf, "customer").select(F.col("c_nationkey").alias("territory")), tb.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("territory"))
    return c.intersect(s).crossJoin(F.broadcast(c.subtract(s).agg(F.count("*").alias("n"))))


@query("SELECT n_regionkey AS region_code, event_type, count(*) AS n FROM nation CROSS JOIN (SELECT DISTINCT event_type FROM events) GROUP BY ALL")
def cross_small(spark: SparkSession, sf: str) -> DataFrame:
    kinds = tb.table(spark, sf, "events").select("event_type").distinct()
    return tb.regions(spark, sf).crossJoin(F.broadcast(kinds)).groupBy("region_code", "event_type").agg(F.count("*").alias("n"))
