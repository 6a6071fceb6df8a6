"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, in DataFrame operations only."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.text import free_name
from tessera.storage import materialize

#: Rows that one local permutation aims at. Beyond ``MOST`` source partitions (whose counts are what is collected) and as many
#: cells a shard, permutations grow instead; their sorts can spill.
ROWS, MOST = 16_384, 65_536


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` balls taken from ``good + bad`` are good: inversion that starts at the mode, for counts of any size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    k = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def lchoose(n: int, r: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    p = math.exp(lchoose(good, k) + lchoose(bad, draws - k) - lchoose(good + bad, draws))
    u, up, down, above, below = rng.random() - p, k, k, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            above *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            if (u := u - above) <= 0:
                return up
        if down > low:
            below *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            if (u := u - below) <= 0:
                return down
    return k


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows that each source partition sends to each shard in a uniform random shuffle: row sums are ``counts``, column sums ``sizes``."""
    rng, left, out = random.Random(seed), list(sizes), []
    for n in counts:
        row, rest = [], sum(left)
        for s, room in enumerate(left):
            rest -= room
            take = hypergeometric(rng, room, rest, n - sum(row)) if n > sum(row) else 0
            row.append(take)
            left[s] -= take
        out.append(row)
    return out


def shard(df: DataFrame, n_shards: int, *, seed: int = 17, rows: int = ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to ``n_shards - 1``, sizes at most one apart) and ``slot`` (gapless from 0 in each shard).

    Rows are dealt to source partitions by a hash of all their columns, at least one partition a core. The counts matrix is drawn on the driver from
    the partitions' counts (at most ``MOST`` of them); each partition permutes its rows by a second hash and gives
    its first rows to shard 0, the next to shard 1 and so on; each shard permutes again by a third hash, in cells
    whose offsets come from their counts, so no shard has to fit in one task. Rows are exchanged twice, and the first exchange leaves
    the disk before the second begins; where there are more groups than shuffle partitions, each exchange has a partition a group, so
    that sorts keep their size. Everything is a function of seed and
    rows: a rerun or a recomputed task gives the same answer. Rows equal in every column are interchangeable (and share a
    source partition: give a table that may repeat one row very often a column of ids). Texts of any length are moved whole; nulls
    are hashed like other values, an empty table stays empty, and columns named shard or slot are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = df.sparkSession
    own = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    part, cell, order, again, n, at, cuts, first = (free_name(df.columns, f"_{x}") for x in ("part", "cell", "order", "again", "n", "at", "cuts", "first"))

    def key(k: int) -> F.Column:
        return F.xxhash64(F.lit(seed), F.lit(k), *[F.col(f"`{c}`") for c in own])

    total = df.count()
    parts = max(2, spark.sparkContext.defaultParallelism, min(MOST, -(-total // rows)))
    cells = max(1, min(MOST, -(-total // (rows * n_shards))))
    dealt = df.select(*[F.col(f"`{c}`") for c in own], F.pmod(key(1), F.lit(parts)).cast("int").alias(part), key(2).alias(order), key(3).alias(again))
    counts = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    ids = sorted(counts)
    matrix = communication_matrix([counts[p] for p in ids], sizes, seed)
    text = json.dumps([{"p": p, "cuts": [sum(row[: s + 1]) for s in range(n_shards)]} for p, row in zip(ids, matrix, strict=True)])
    plan = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<p:int,cuts:array<bigint>>>")).alias("x")).select(F.col("x.p").alias(part), F.col("x.cuts").alias(cuts))

    def spread(x: DataFrame, groups: int, *by: str) -> DataFrame:
        return x.repartition(groups, *by) if groups > int(spark.conf.get("spark.sql.shuffle.partitions")) else x

    rank = F.row_number().over(Window.partitionBy(part).orderBy(order, again))
    to = F.size(F.filter(F.col(cuts), lambda c: c < F.col(at))).cast("int")
    sent = spread(dealt, parts, part).withColumn(at, rank).join(F.broadcast(plan), part).select(*[F.col(f"`{c}`") for c in own], order, again, to.alias("shard"))
    sent = materialize(sent.withColumn(cell, F.pmod(F.shiftright(F.col(again), 20), F.lit(cells)).cast("int")), "shards", drop_shuffles=True)

    held = sent.groupBy("shard", cell).agg(F.count("*").alias(n))
    start = held.select("shard", cell, (F.sum(n).over(Window.partitionBy("shard").orderBy(cell)) - F.col(n)).alias(first))
    place = F.row_number().over(Window.partitionBy("shard", cell).orderBy(again, order))
    return spread(sent, n_shards * cells, "shard", cell).withColumn(at, place).join(start, ["shard", cell]).select(*[F.col(f"`{c}`") for c in own], "shard", (F.col(first) + F.col(at) - 1).alias("slot"))
