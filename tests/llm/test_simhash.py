import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.components import connected_components


def brute_fp(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in "\t\n\v\f\r"}).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def classes(fps):
    """Smallest id reachable by links of 2 bits or fewer, all pairs."""
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(fps):
        for b, y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= 2:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i, _ in fps}


def test_whole_table_equals_brute_force(docs):
    rows = docs.collect()
    fps = [(r.doc_id, brute_fp(r.text)) for r in rows]
    got = {r.id: (r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(docs).collect()}
    want = classes(fps)
    assert got == {i: (f, want[i]) for i, f in fps}


@pytest.mark.parametrize("crowded", [1, 3, 64])
def test_search_equals_all_pairs_for_crowded_and_sparse_keys(spark, crowded):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(150)}
    base = rng.getrandbits(64)
    for _ in range(150):
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.linked_fingerprints(df, crowded=crowded)).collect()}
    want = classes([(x, x % (1 << 64)) for x in sorted(signed)])
    groups, found = defaultdict(set), defaultdict(set)
    for x in signed:
        groups[want[x]].add(x)
        found[roots.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


@pytest.mark.parametrize("bits", [1, 3])
def test_other_thresholds_link_exactly_the_near_pairs(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(63) for _ in range(12)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(63), rng.randrange(bits + 3))) for b in base for _ in range(12)})
    got = {tuple(r) for r in simhash.linked_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long"), bits).distinct().collect()}
    assert got == {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= bits}


def test_edges(odd):
    got = {(r.id, r.component) for r in simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (None, 7), (7, 7)} <= got
    kept = [r.doc_id for r in simhash.keep_one(odd).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 3, 7, 8, 9, 10, 11] and kept.count(None) == 1
    assert simhash.keep_one(odd).columns == odd.columns
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_repeated_rows_of_a_kept_document_leave_one(odd):
    rows = odd.where("doc_id = 2")
    assert rows.count() == 2 and simhash.keep_one(rows).count() == 1


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(5, 5), (None, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(50)}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_long_texts_are_summed_in_blocks(monkeypatch):
    text = " ".join(str(i) for i in range(3000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text.encode()) == whole == brute_fp(text)


def test_hash_of_spark_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64("a b c", seed=42).intdigest()
