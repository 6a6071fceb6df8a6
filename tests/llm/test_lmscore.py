import math
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lmscore, queries
from tessera.storage import materialize
from tests import oracle


def brute(docs, order, alpha):
    """Stupid backoff by definition, with counts of all documents less the document's own."""
    words = [(t or "").encode().split() for _, t in docs]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    own = [{n: grams(w, n) for n in range(1, order + 1)} for w in words]
    total = {n: sum((o[n] for o in own), Counter()) for n in range(1, order + 1)}
    out = {}
    for (id_, _), w, o in zip(docs, words, own, strict=True):
        rest = lambda g: total[len(g)][g] - o[len(g)][g]
        others = max(1, sum(map(len, words)) - len(w))
        s, backed = 0.0, 0
        for i in range(len(w)):
            level = 0
            for n in range(order, 0, -1):
                if i < n - 1:
                    continue
                g = tuple(w[i - n + 1 : i + 1])
                if rest(g) > 0:
                    s += level * math.log10(alpha) + math.log10(rest(g) / (rest(g[:-1]) if n > 1 else others))
                    break
                level += 1
            else:
                s += level * math.log10(alpha) - math.log10(others)
            backed += level > 0
        out[id_] = (len(w), round(s, 6), backed)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_brute_force(spark, sf, order):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 150")
    got = {r[0]: (r[1], round(r[2], 6), r[3]) for r in lmscore.stupid_backoff(docs, order=order, block_bytes=40_000, bucket_bytes=60_000).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], order, lmscore.ALPHA)
    assert got.keys() == want.keys()
    for k, (n, s, b) in want.items():
        assert got[k][0] == n and got[k][2] == b and abs(got[k][1] - s) < 1e-4


def test_query_equals_its_sql(spark, sf):
    df = queries.op2_stupid_backoff(spark, sf)
    oracle.same(df.collect(), df.columns, oracle.connect(sf).sql(queries.BACKOFF_SQL))


def test_very_long_text(spark):
    """A text of many blocks' size, against another that shares its middle."""
    long = " ".join(f"w{i * i % 997}" for i in range(60_000))
    docs = [(1, long), (2, long[1000:3000]), (3, "w0 w1 w4")]
    got = {r[0]: (r[1], r[3]) for r in lmscore.stupid_backoff(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=10_000).collect()}
    assert got == {k: (n, b) for k, (n, _, b) in brute(docs, 3, lmscore.ALPHA).items()}


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b a b a", "x"), (3, "a b a b a", "x"), (None, " \n", None), (5, "only here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = sorted(((r[0], r[1], r[2], r[3]) for r in lmscore.stupid_backoff(docs).collect()), key=str)
    want = sorted(((k, *v) for k, v in [(1, (0, 0.0, 0)), (2, (0, 0.0, 0)), (None, (0, 0.0, 0))]), key=str)
    assert [g for g in got if g[1] == 0] == want
    assert len(got) == 6
    assert lmscore.stupid_backoff(docs.limit(0)).count() == 0


def test_query_scores_by_trigrams(spark, tmp_path):
    """Words whose bigram is known and whose trigram is not are backed off, which a bigram model can't tell."""
    rows = [(1, "a b c d"), (2, "x b c e"), (3, "a b c d"), (4, "y c d z"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.log10_score, r.backed_off) for r in queries.op2_stupid_backoff(spark, str(tmp_path)).collect()}
    want, lower = ({k: (n, round(s, 4), b) for k, (n, s, b) in brute(rows, order, lmscore.ALPHA).items()} for order in (3, 2))
    assert got == want and got != lower


def test_shuffles_of_a_written_table_leave_the_disk(spark):
    """Only one order's n-grams are on disk at a time: their shuffle ends with the query that wrote the counts."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in str(files.getAllFiles().mkString("\n")).split("\n") if "shuffle_" in f}
    rows = spark.range(10_000).selectExpr("id", "id % 7 as k")
    before = shuffles()
    out = materialize(rows.repartition(3, "k"), "dropped", drop_shuffles=True)
    end = time.time() + 30
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before and out.count() == 10_000
    materialize(rows.repartition(3, "k"), "held")
    assert shuffles() - before


def test_ngrams_are_counted_without_a_row_each(spark):
    """An n-gram that only passes the count is no row of Spark's: packed rows are dealt, and packed rows return."""
    texts = ["a b c a b", "b c a b c d", "a b", "x y", "c d a b a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    blocks = materialize(lmscore.blocks_of(docs, id_col="doc_id", text_col="text", block_bytes=1), "blocks-test")
    found = lmscore.counts_elsewhere(lmscore.block_grams(blocks, 2, lmscore.bucket_names(spark, 3, 3)), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    got = sorted(h << 7 | lo for r in found.collect() for lo, h in zip(r.low, r.high, strict=True))
    own = [Counter(zip(t.split(), t.split()[1:], strict=False)) for t in texts]
    total = sum(own, Counter())
    assert got == sorted(total[g] - o[g] for o in own for g in o if total[g] > o[g])


def test_equal_keys_are_grouped_as_they_came():
    """Also where keys differ in the lowest bits only, in which their places are sorted along."""
    rng = np.random.default_rng(3)
    for keys in (rng.integers(0, 2**64, 5000, np.uint64), rng.integers(0, 9, 5000, np.uint64), np.uint64(2**64 - 1) - rng.integers(0, 5000, 5000, np.uint64), np.zeros(0, np.uint64), np.array([7], np.uint64)):
        order, first = lmscore.grouped(keys)
        assert (order == np.argsort(keys, kind="stable")).all() and (keys[order][first] == np.unique(keys)).all()


def test_packed_ngrams_are_bytes(spark):
    """What is packed crosses Spark as bytes, not number by number: blocks, n-grams and their counts."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c d")], "doc_id long, text string")
    blocks = lmscore.blocks_of(docs, id_col="doc_id", text_col="text", block_bytes=1)
    grams = lmscore.block_grams(blocks, 2, lmscore.bucket_names(spark, 3, 3))
    kinds = [(t.schema[c].dataType.typeName(), c) for t, cs in ((blocks, "words low high"), (grams, "top mid low c"), (lmscore.counts_elsewhere(grams, 3), "at low high")) for c in cs.split()]
    assert {k for k, _ in kinds} == {"binary"}, kinds


def test_counts_of_any_size_return_to_their_places():
    """Pieces of several lengths, in any order, with counts beyond one and two bytes."""
    want = np.zeros(40, np.int64)
    want[[0, 8, 9, 20, 39]] = [1, 127, 128, 40_000, 2**40 + 5]
    start, found = np.array([0, 9, 10, 21]), [(3, [39]), (0, [0, 8]), (1, [9]), (2, [20])]
    sizes = {0: 9, 1: 1, 2: 11, 3: 19}
    bits = [np.packbits(np.isin(np.arange(start[p], start[p] + sizes[p]), at)) for p, at in found]
    counts, ends = want[[i for _, at in found for i in at]], np.cumsum([0, *(len(at) for _, at in found)])
    lists = ((counts & 127).astype(np.uint8), (counts >> 7).astype(np.uint8), (counts >> 15).astype(np.uint32))
    columns = [pa.array([p for p, _ in found]), lmscore.packed(np.concatenate(bits), np.cumsum([0, *map(len, bits)])), *(lmscore.packed(x, ends) for x in lists)]
    assert (lmscore.answered(pa.table(columns, names=["piece", "at", "low", "high", "rest"]), start, 40) == want).all()
