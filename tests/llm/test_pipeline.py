from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, langid, mixing, neartext, quality, queries

SF = "/root/testdata/sf0.01"


def test_stages_equal_their_operators_and_the_whole(spark):
    """Each stage by what its operator says of the documents that are left, by plain Python sets."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.id for r in langid.identify(docs, langid.train(docs)).where("lang_pred <> 'und' and score >= 0.5").collect()}
    left = docs.where(F.col("doc_id").isin(list(known)))
    good = {r.id for r in quality.judge(left, labels).where("kept").collect()}
    left = docs.where(F.col("doc_id").isin(list(good)))
    one = {r.id for r in neartext.near_copies(left).where("id = component").collect()}
    left = docs.where(F.col("doc_id").isin(list(one)))
    copies = {r.id: r.taken // r.size for r in mixing.mix(left).collect() if r.taken}
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(copies)
    library = Tokenizer.from_file(queries.byte_bpe_path())
    texts = {r.doc_id: r.text for r in left.collect()}
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in out)


def test_clean_labelled_documents_pass_the_filters(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").where(F.size(F.split(F.trim("text"), r"\s+")) >= 20)
    n = good.count()
    kept = corpus_pipeline.quality_rules(spark, corpus_pipeline.language_id(spark, docs, SF), SF)
    assert kept.join(good.select("doc_id"), "doc_id", "left_semi").count() >= 0.97 * n


def test_stage_contract(spark, odd):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "simhash_neardup", "mix_sources", "bpe_tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
    assert bpe.tokens(odd, queries.byte_bpe_path()).count() == 12


def test_stages_send_small_batches_to_python(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    try:
        for given, want in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("7", 7)):
            spark.conf.set(key, given)
            corpus_pipeline.mix_sources(spark, docs, SF)
            assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)
