import os
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, queries, sharding
from tests import oracle


def test_matrix_has_exact_margins():
    rng = random.Random(1)
    for _ in range(50):
        counts = [rng.randrange(40) for _ in range(7)]
        n = sum(counts)
        sizes = [n // 5 + (s < n % 5) for s in range(5)]
        m = sharding.communication_matrix(counts, sizes, rng.randrange(99))
        assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m, strict=True)] == sizes
    assert sharding.communication_matrix([0, 5 * 10**10], [2 * 10**10, 3 * 10**10], 1)[1] == [2 * 10**10, 3 * 10**10]


def test_draws_are_hypergeometric():
    rng = random.Random(2)
    got = Counter(sharding.hypergeometric(rng, 6, 9, 5) for _ in range(20_000))
    from math import comb

    for k in range(6):
        assert abs(got[k] / 20_000 - comb(6, k) * comb(9, 5 - k) / comb(15, 5)) < 0.015
    big = [sharding.hypergeometric(rng, 10**9, 4 * 10**9, 10**6) for _ in range(50)]
    assert abs(np.mean(big) - 200_000) < 400


@pytest.mark.parametrize("rows", [40, 250_000])
def test_shards_have_exact_sizes_and_gapless_slots(docs, rows):
    got = sharding.shard(docs.select("doc_id"), 8, rows=rows).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len({r.doc_id for r in got}) == docs.count()
    again = {tuple(r) for r in sharding.shard(docs.select("doc_id").repartition(5), 8, rows=rows).collect()}
    assert again == {tuple(r) for r in got}


def test_shuffle_is_uniform(spark):
    """Over many seeds each row meets each shard equally often."""
    seen = Counter()
    ids = spark.range(16).select(F.col("id").alias("doc_id"))
    for seed in range(40):
        seen.update(r.shard for r in sharding.shard(ids, 4, seed=seed, rows=5).where("doc_id = 3").collect())
    assert all(2 <= seen[s] <= 20 for s in range(4))


def test_sharding_edges(odd):
    out = sharding.shard(odd, 3)
    assert sorted(Counter(r.shard for r in out.collect()).values()) == [4, 4, 4]
    assert set(out.columns) == set(odd.columns) and sharding.shard(odd.limit(0), 3).count() == 0


def test_mix_equals_its_sql(spark, sf):
    for d in (sf, "/root/testdata/sf0.01"):
        df = queries.op9_hash_threshold_mix(spark, d)
        oracle.same(df.collect(), df.columns, oracle.connect(d).sql(queries.MIX_SQL))


def by_hand(sizes, weights, most=3.0):
    """Share by weight, cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k:02d}": rng.choice([1, 5, 50, 900]) * rng.randrange(1, 9) for k in range(9)} | {None: 40}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = by_hand(sizes, mixing.WEIGHTS)
    assert all(got[s] == pytest.approx(want[s], rel=1e-9) for s in sizes)


def test_taken_words_come_near_the_targets(docs):
    rows = mixing.mix(docs).collect()
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    target = {r.source: r.target for r in rows}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    copies = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert all(copies[r.id] == r.taken // r.size for r in rows if r.size)


def test_mix_edges(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 12 and {r.size for r in rows if r.id in (3, 4, 5)} == {0}
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0


def test_sharding_query_deals_whole_documents(spark, sf, monkeypatch):
    """The operator gets every column of the table; the digests are those of the rows that it returns."""
    seen, shard = [], sharding.shard
    monkeypatch.setattr(sharding, "shard", lambda df, n, **k: seen.append(df.columns) or shard(df, n, **k))
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot) for r in queries.op5_hypergeometric_shards(spark, sf).collect()}
    assert seen == [table.columns]
    held = {r.doc_id: (r.text, r.shard, r.slot) for r in shard(table, queries.N_SHARDS).collect()}
    want = {i: (len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode()), s, n) for i, (t, s, n) in held.items()}
    assert got == want


def test_first_exchange_leaves_the_disk(spark):
    """Whole rows are exchanged twice; what the first exchange wrote is gone when its rows are dealt to shards."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = [f for f in str(files.getAllFiles().mkString("\n")).split("\n") if "shuffle_" in f]
        return {f: os.path.getsize(f) for f in found if os.path.exists(f)}

    rng, before = random.Random(5), shuffled()
    docs = spark.createDataFrame([(i, rng.randbytes(4000).hex()) for i in range(300)], "doc_id long, text string")
    out = sharding.shard(docs, 8)
    size = lambda: sum(n for f, n in shuffled().items() if f not in before)
    end = time.time() + 10
    while size() > 300_000 and time.time() < end:
        time.sleep(0.2)
    assert size() <= 300_000 and out.count() == 300


def test_exchanges_have_a_partition_a_group(docs):
    """With more groups than shuffle partitions (4 here) a sort gets no more rows as the table grows."""
    few, many = (sharding.shard(docs.select("doc_id", "text"), 2, rows=rows) for rows in (10_000, 20))
    cells = -(-docs.count() // 40)
    assert f"{2 * cells}), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.slot for r in many.where("shard = 0").collect()) == list(range(-(-docs.count() // 2)))
