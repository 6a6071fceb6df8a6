import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, quality


def brute_bits(train, text, order):
    """PPM with escape method C and exclusion, context by context."""
    counts = {}
    for t in train:
        d = b"\n" * order + t
        for i in range(order, len(d)):
            for k in range(order + 1):
                counts.setdefault(d[i - k : i], Counter())[d[i]] += 1
    total, d = 0.0, b"\n" * order + text
    for i in range(order, len(d)):
        gone = set()
        for k in range(order, -1, -1):
            seen = counts.get(d[i - k : i])
            if seen is None:
                continue
            rest = {s: n for s, n in seen.items() if s not in gone}
            whole = sum(rest.values()) + len(rest)
            if d[i] in rest:
                total += np.log2(whole / rest[d[i]])
                break
            if rest:
                total += np.log2(whole / len(rest))
            gone |= set(seen)
        else:
            total += np.log2(256 - len(gone))
    return total


@pytest.mark.parametrize("order", [1, 2, 4])
def test_code_lengths_equal_brute_force(order):
    train = [b"abracadabra abra", b"cad abra", b"xyzzy"]
    g = np.concatenate([langid._grams(b"\n" * order + t, order) for t in train])
    grams, n = np.unique(g, return_counts=True)
    coder = langid.Coder([langid.context_tree(grams, n.astype(float), order)], order)
    texts = [b"abra cadabra", b"", b"qqq\xff\n", b"x", b"xyzzy abra " * 40]
    got = coder.lengths(texts)[:, 0] / langid.UNIT
    assert np.allclose(got, [brute_bits(train, t, order) for t in texts], atol=1e-3)
    assert (coder.lengths(texts)[:, 0] / langid.UNIT == got).all()


def test_windows_do_not_change_sums(monkeypatch):
    g, n = np.unique(langid._grams(b"\n\n" + b"hello world", 2), return_counts=True)
    tree = langid.context_tree(g, n.astype(float), 2)
    texts = [b"hello", b"", b"world hello " * 9]
    whole = langid.Coder([tree], 2).lengths(texts)
    monkeypatch.setattr(langid, "WINDOW", 7)
    assert (langid.Coder([tree], 2).lengths(texts) == whole).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.train(docs)).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").collect()
    held = [r for r in got if r.held_out]
    assert {r.id for r in held} == {r.id for r in got if zlib.crc32(str(r.id).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_prediction_does_not_read_labels(spark, docs):
    model = langid.train(docs)
    a = {r.id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    b = {r.id: (r.lang_pred, r.score) for r in langid.identify(docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q")}), model).collect()}
    assert a == b


def test_language_edges(odd, docs):
    model = langid.train(docs)
    got = {r.id: r for r in langid.identify(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5, 10)) and got[8].lang_pred != "und" and got[None].held_out is False
    kept = langid.keep_known(odd, model)
    assert kept.columns == odd.columns and {3, 4, 5, 10}.isdisjoint({r.doc_id for r in kept.collect()})
    assert langid.identify(odd.limit(0), model).count() == 0
    none = langid.train(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


def brute_base(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if win[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


def test_statistics_equal_brute_force(docs, odd):
    texts = [r.text for r in docs.collect()] + [r.text for r in odd.where("doc_id <> 8").collect()] + ["a " * 9, "a b c d e f g h i a b c d e f g h i", "x\nx\n \n \nx"]
    assert all(quality.statistics(t)[0] == brute_base(t) for t in texts)


def test_equal_hashes_are_compared(monkeypatch):
    """With all hashes equal, only windows of equal words count."""
    ids = np.array([*range(9), *range(20, 30), *range(9)], np.uint64)
    assert quality.repeated_words(ids) == 18
    at = np.arange(len(ids) - 7)
    same = np.concatenate(list(quality._equal_windows(ids, at, np.zeros(len(at), np.uint64), 8)))
    assert sorted(same) == [0, 1, 19, 20]


def test_forest_separates_labelled_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality.judge(docs, labels).join(labels.select(F.col("doc_id").alias("id"), "quality"), "id").where("not base_failed").collect()
    good, bad = [r.kept for r in out if r.quality == 1], [r.kept for r in out if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality.judge(docs, labels).where("kept").count()


def test_quality_edges(odd, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (8, 0)], "doc_id long, quality int")
    got = quality.judge(odd, labels).collect()
    assert len(got) == 12 and all(r.base_failed and not r.kept for r in got)
    assert quality.judge(odd.limit(0), labels).count() == 0
    none = quality.judge(odd.withColumn("text", F.lit("this is a perfectly plain text of more than twenty words so that the base rule has nothing at all to say against it here")), labels.limit(0))
    assert {r.kept for r in none.collect()} == {True}


def test_stage_drops_a_language_that_was_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(3)
    junk = " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(60))
    texts = ["это русский текст о погоде и о лесах вокруг большого озера", junk, "tämä on suomenkielinen teksti jota malli ei ole koskaan nähnyt ja se kertoo metsästä ja järvistä"]
    planted = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(planted, allowMissingColumns=True), "").select("doc_id").collect()}
    assert kept.isdisjoint({10**9 + i for i in range(len(texts))})
    assert kept == {r.doc_id for r in docs.collect() if langid.has_letter(r.text)}
