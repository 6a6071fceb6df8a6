"""Near-duplicate text by SimHash fingerprints and a pigeonring search of the Hamming space."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.text import slices
from tessera.storage import materialize

SHINGLE_WORDS, SEED = 3, 42
#: Buckets of more fingerprints than this are searched through one-bit neighbours instead of pairs.
CROWDED = 64
#: Shingles whose bits are summed at once.
BLOCK = 1 << 16


def fingerprint(text: bytes | None, n: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of UTF-8 bytes; A-Z are lower-cased, words are runs of other than ASCII white space. No word: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else iter([b" ".join(words)])
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8")
    votes = sum(np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for i in range(0, len(h), BLOCK))
    return int(np.packbits(2 * votes > len(h)).view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``(id, fp)`` with the fingerprint as a long of the same 64 bits. A null or blank text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.fromiter((fingerprint(x, n, seed) for x in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def segments(count: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``count`` consecutive segments of 64 bits."""
    cut = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def mask(low: int, width: int) -> int:
    m = ((1 << width) - 1) << low
    return m - (1 << 64) if m >> 63 else m


def _any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def linked_fingerprints(fps: DataFrame, max_bits: int = 2, crowded: int = CROWDED) -> DataFrame:
    """Distinct fingerprints ``fp`` to edges ``(src, dst)`` that join exactly those within ``max_bits`` of each other
    into the same components.

    Pigeonring: with ``max_bits + 1`` segments on a ring, fingerprints within the threshold have a segment from which
    every chain of ``l`` consecutive segments differs in at most ``l * max_bits / (max_bits + 1)`` bits. So the chain's
    first segment is equal and the second differs in one bit at most: one of its halves is equal too. Segment and half
    are the join key (two keys a segment). A candidate pair must pass the budgets of all longer chains before
    the full Hamming check. Keys held by one fingerprint only are dropped before any join.

    A crowded key's fingerprints are not paired: within 2 bits, two fingerprints share a one-bit neighbour, so each is
    listed under its 64 neighbours and itself, and is linked with the smallest listed there. Such a list has 65
    members at most and all of them are within 2 bits. (For other thresholds, crowded keys are paired like the rest.)
    """
    if not 1 <= max_bits <= 7:
        raise ValueError("max_bits must be 1 to 7")
    seg = segments(max_bits + 1)
    m = len(seg)
    keys = []
    for i in range(m):
        low, width = seg[(i + 1) % m]
        for a, b in ((low, width // 2), (low + width // 2, width - width // 2)):
            keys.append(F.struct(F.lit(len(keys)).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(mask(*seg[i]) | mask(a, b))).alias("part")))
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.k", "key.part")
    held = keyed.groupBy("k", "part").agg(F.count("*").alias("n")).where("n > 1")
    rows = materialize(keyed.join(held, ["k", "part"]), "keys")

    small = rows.where(F.col("n") <= crowded) if max_bits == 2 else rows
    a, b = small.select("k", "part", F.col("fp").alias("src")), small.select("k", "part", F.col("fp").alias("dst"))
    x = F.col("src").bitwiseXOR(F.col("dst"))
    chains = []
    for i in range(m):
        at, ok = 0, F.floor(F.col("k") / 2) == i
        for step in range(1, m):
            at |= mask(*seg[(i + step) % m])
            ok = ok & (F.bit_count(x.bitwiseAND(F.lit(at))) <= (step + 1) * max_bits // m)
        chains.append(ok)
    edges = a.join(b, ["k", "part"]).where(F.col("src") < F.col("dst")).where(_any_of(chains)).where(F.bit_count(x) <= max_bits).select("src", "dst")
    if max_bits != 2:
        return edges
    flips = F.array(F.lit(0).cast("long"), *[F.lit(mask(i, 1)) for i in range(64)])
    near = rows.where(F.col("n") > crowded).select("fp").distinct().select("fp", F.explode(flips).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("centre"))
    first = near.groupBy("centre").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).where("n > 1").select("centre", "dst")
    return edges.unionByName(near.join(first, "centre").where("fp <> dst").select(F.col("fp").alias("src"), "dst"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2) -> DataFrame:
    """One row a document: ``id``, ``fp`` and ``component``, the smallest id of its class of linked fingerprints.

    Equal fingerprints are one node of the graph, so exact copies cost no pairs. Null, blank and repeated rows are
    documents like any other; ids that are null are skipped in the minimum (null if a class has no other). An empty
    table gives an empty result; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, id_col=id_col, text_col=text_col), "simhash")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    roots = connected_components(linked_fingerprints(nodes.select("fp"), max_bits))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component"))
    of = placed.join(lowest, "root").select("fp", "component")
    return rows.join(of, "fp", "left").select("id", "fp", "component")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id (of repeated rows with that id, one).

    Rows with a null id are kept: they can't be told apart.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, max_bits=max_bits)
    drop = found.where(F.col("id").isNotNull() & (F.col("id") != F.col("component"))).select(F.col("id").alias(id_col))
    kept = docs.join(drop.distinct(), id_col, "left_anti").select(*docs.columns)
    again = materialize(found.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias(id_col)), "repeated")
    if again.isEmpty():
        return kept
    rest = kept.join(again, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns)
    return kept.join(again, id_col, "left_anti").select(*docs.columns).unionByName(rest)
