import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neartext


def brute(rows, least=0.8):
    """Smallest id reachable by links of that Jaccard similarity, over an index of plain string shingles."""
    sets, holders, root = {}, {}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        s = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {b""}
        shared = {}
        for g in s:
            for j in holders.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            holders[g].append(i)
        sets[i] = s
        for j, n in shared.items():
            if n >= least * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def test_classes_equal_brute_force_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()])
    got = {r.id: r.component for r in neartext.near_copies(docs).collect()}
    extra = {i for i in got if got[i] not in (want[i], i)}
    dropped, found = {i for i in want if want[i] != i}, {i for i in got if got[i] != i}
    assert not extra and found <= dropped
    assert len(found) >= 0.97 * len(dropped) > 0


@pytest.mark.parametrize("edits, least_found", [(1, 1.0), (4, 0.95), (6, 0.85)])
def test_recall_of_planted_edits(spark, edits, least_found):
    """Texts of 300 words with 1, 4 and 6 words replaced: similarities of about 0.97, 0.87 and 0.82."""
    rng = random.Random(edits)
    rows = []
    for k in range(150):
        w = [f"w{rng.randrange(5000)}" for _ in range(300)]
        v = list(w)
        for at in rng.sample(range(300), edits):
            v[at] = "edited"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    want = brute(rows)
    got = {r.id: r.component for r in neartext.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [i for i in want if want[i] != i]
    assert all(got[i] in (i, want[i]) for i in want)
    assert sum(got[i] == want[i] for i in linked) >= least_found * len(linked) and len(linked) > 100


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for k in range(300):
        v = list(base)
        v[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(v)))
    got = {r.component for r in neartext.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


@pytest.mark.parametrize("block, at_once", [(256, 32), (3, 1)])
def test_crowded_keys_lose_no_link(spark, monkeypatch, block, at_once):
    """Texts that drift apart step by step, and pairs beside them: classes are those of all pairs, however few a key compares at first."""
    monkeypatch.setattr(neartext, "BLOCK_NODES", block)
    monkeypatch.setattr(neartext, "BLOCKS_AT_ONCE", at_once)
    rng = random.Random(11)
    rows = []
    for _ in range(6):
        v = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(15):
            v = list(v)
            for at in rng.sample(range(200), 3):
                v[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).localCheckpoint()
    want = {r.id: r.component for r in neartext.near_copies(docs, crowded=10**6).collect()}
    got = {r.id: r.component for r in neartext.near_copies(docs, crowded=1).collect()}
    assert got == want and len(set(want.values())) < 20
    nodes = neartext.fingerprints(docs, "doc_id", "text").select(F.xxhash64("fp").alias("node"), "fp").distinct().localCheckpoint()
    chains = neartext.shared_chains(nodes)
    alone = nodes.select("node", F.col("node").alias("root")).where("false")
    every = {tuple(r) for r in neartext.candidates(chains, nodes, crowded=10**6).collect()}
    apart = [tuple(r) for r in neartext.between_classes(chains, nodes, alone, crowded=1).collect()]
    assert len(apart) == len(set(apart)) and set(apart) | {tuple(r) for r in neartext.candidates(chains, nodes, crowded=1).collect()} == every
    assert len(every) > neartext.candidates(chains, nodes, crowded=1).count()


def test_texts_of_a_crowded_key_that_are_no_copies_make_no_rows(spark):
    """Texts near one that is absent: most pairs share a key and are within the bits, and none is similar, however many there are."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for k in range(120):
        v = list(base)
        for at in rng.sample(range(300), 6):
            v[at] = f"x{k}-{at}"
        rows.append((k, " ".join(v)))
    sets = [neartext.shingles(t.encode()) for _, t in rows]
    alike = [(i, j) for j in range(120) for i in range(j) if neartext.similarity(sets[i], sets[j]) >= 0.8]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = neartext.fingerprints(docs, "doc_id", "text").withColumn("node", F.xxhash64("fp")).localCheckpoint()
    alone = nodes.select("node", F.col("node").alias("root")).where("false")
    apart = neartext.between_classes(neartext.shared_chains(nodes), nodes, alone, crowded=1)
    unbinned = neartext.between_classes(neartext.shared_chains(nodes), nodes.select("node", "fp"), alone, crowded=1)
    assert not alike and unbinned.count() > 10 * len(rows) and apart.count() <= len(rows)
    assert {r.id: r.component for r in neartext.near_copies(docs).collect()} == {k: k for k in range(120)}


@pytest.mark.parametrize("size", [0, 1, 7, 300, 90_000])
def test_bins_reject_no_similar_pair(size):
    rng = np.random.default_rng(size)
    a = np.unique(rng.integers(0, (1 << 64) - 1, size, np.uint64)) if size else np.empty(0, np.uint64)
    for share in (0.75, 0.8, 0.88, 0.889, 0.9, 1.0):
        kept = a[: round(share * len(a))]
        for b in (kept, np.unique(np.concatenate([kept, rng.integers(0, (1 << 64) - 1, len(a) - len(kept), np.uint64)]))):
            rows = (np.frombuffer(neartext.bins(h), np.uint8)[None, :] for h in (a, b))
            assert neartext.may_be_similar(*rows, 0.8)[0] or neartext.similarity(a, b) < 0.8


def test_shared_passages_are_no_copies(spark):
    rng = random.Random(5)
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(k, shared + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(60))) for k in range(100)]
    got = {r.id: r.component for r in neartext.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k for k in range(100)}


def test_edges(odd):
    got = {(r.id, r.component) for r in neartext.near_copies(odd).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (None, 7), (7, 7), (8, 8), (11, 11)} <= got
    kept = [r.doc_id for r in neartext.keep_one(odd).collect()]
    assert 2 not in kept and kept.count(1) == kept.count(3) == 1 and 4 not in kept and kept.count(None) == 1
    assert neartext.keep_one(odd).columns == odd.columns
    assert neartext.near_copies(odd.limit(0)).count() == 0
    assert neartext.keep_one(odd.where("doc_id is null")).count() == 1
    assert neartext.near_copies(odd.where(F.col("doc_id").isNull() | (F.col("doc_id") == 7))).count() == 2


def test_tables_beyond_the_broadcast_bound_are_joined_by_shuffle(spark, odd, monkeypatch):
    want = sorted(str(r) for r in neartext.keep_one(odd).collect())
    monkeypatch.setattr(neartext.beside_texts, "__defaults__", (0,))
    assert sorted(str(r) for r in neartext.keep_one(odd).collect()) == want
    ids = spark.createDataFrame([(str(i),) for i in range(3)], "doc_id string")
    assert neartext.beside_texts(ids) is ids


def test_one_id_with_different_texts(spark):
    """The text of a candidate pair is the one that was fingerprinted, whatever the order of rows."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    near, other = list(base), [f"w{rng.randrange(5000)}" for _ in range(120)]
    near[60] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (2, " ".join(other)), (3, " ".join(reversed(other)))]
    for k in range(4):
        order = rows[k:] + rows[:k]
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        assert sorted((r.id, r.component) for r in neartext.near_copies(df).collect()) == [(1, 1), (2, 1), (2, 2), (3, 3)]
