"""From raw documents to tokens: language ID, quality rules, near-dedup, mixing to target weights, BPE.

``run`` applies ``STAGES`` to the table ``documents``; each stage's rows are written as Parquet to the shared folder
and read again as the next one's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, mixing, neartext, quality
from tessera.llm.queries import byte_bpe_path
from tessera.storage import materialize

#: Rows that go to Python at once: whole texts of a default batch (10,000) take tens of MB in the JVM and again in each worker.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most ``BATCH_ROWS``: a stage's rows are read after it returns, so it stays set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language."""
    small_batches(spark)
    model = langid.train(docs)
    return langid.keep_known(docs, model, most=langid.worst_fit(docs, model))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or the forest rejects."""
    small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of texts that share 0.8 of their five-word shingles."""
    small_batches(spark)
    return neartext.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or repeated up to three times."""
    small_batches(spark)
    return mixing.mixed(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and a digest of the text that decoding them gives."""
    small_batches(spark)
    out = bpe.tokens(docs, byte_bpe_path())
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("simhash_neardup", simhash_neardup),
    ("mix_sources", mix_sources),
    ("bpe_tokens", bpe_tokens),
]

#: Fitted models and tokenizer automata have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
