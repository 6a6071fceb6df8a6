"""Tables and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import DEFAULT, PanelConfig


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly_sales(spark: SparkSession, sf_dir: str, cfg: PanelConfig | None = DEFAULT.panel) -> DataFrame:
    """Long facts ``territory_id, category, month, y``: sums of line prices by the customer's nation, segment and month,
    with the total over segments as category ``ALL``. ``cfg=None``: all months."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
    if cfg is not None:
        end = F.add_months(F.lit(cfg.start).cast("date"), cfg.months)
        line = line.where((F.col("l_shipdate") >= F.lit(cfg.start).cast("date")) & (F.col("l_shipdate") < end))
    rows = (
        line.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("c_nationkey").alias("territory_id"), F.col("c_mktsegment").alias("category"), F.trunc("l_shipdate", "MM").alias("month"), "l_extendedprice")
    )
    keys = [F.col("territory_id"), F.col("category"), F.col("month")]
    sums = rows.groupingSets([keys, [keys[0], keys[2]]], *keys).agg(F.round(F.sum("l_extendedprice"), 2).alias("y"))
    return sums.withColumn("category", F.coalesce("category", F.lit("ALL")))


def national_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-period ``category, month, value``, the published series of every category."""
    rows = monthly_sales(spark, sf_dir, None)
    return rows.groupBy("category", "month").agg(F.round(F.sum("y"), 2).alias("value"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("territory_id"), F.col("n_regionkey").alias("region_code"), F.col("n_name").alias("name"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges ``x, y, distance``: the reciprocal of the lines between a customer's and a supplier's nation."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    rows = (
        line.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return rows.groupBy(F.col("c_nationkey").alias("x"), F.col("s_nationkey").alias("y")).agg((1.0 / F.count("*")).alias("distance"))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in ``order`` (a dimension's newest record, a crawl's first copy)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_results(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or nothing where there is none yet."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """The forecasts of all (model, origin) pairs that were committed; what a stopped run left of others isn't seen."""
    rows, done = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/commits")
    return rows.join(done, ["model", "o"], "left_semi")


def write_forecasts(new: DataFrame, path: str, spark: SparkSession) -> DataFrame:
    """Store the forecasts of (model, origin) pairs that the store hasn't committed; returns the store.

    Each pair is a partition that is replaced as a whole, and is committed once all of its rows are there. A run that stopped
    in between leaves pairs without a commit, whose rows the rerun writes anew.
    """
    done = _stored(spark, f"{path}/commits")
    if done is not None:
        new = new.join(done, ["model", "o"], "left_anti")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "o").parquet(f"{path}/rows")
    new.select("model", "o").distinct().coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return read_forecasts(spark, path)


def rebase_forecasts(store: DataFrame, start: str, new_start: str, months: int) -> DataFrame:
    """Stored forecasts on a calendar that begins at ``new_start`` and has ``months`` months: origins ``o`` and targets ``t`` are counted from
    there; rows whose origin or target lies outside are left out."""
    moved = F.round(F.months_between(F.lit(start).cast("date"), F.lit(new_start).cast("date"))).cast("int")
    out = store.withColumns({c: (F.col(c) + moved).cast("int") for c in ("o", "t")})
    return out.where((F.col("o") >= 0) & (F.col("t") < months))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
