"""Near-copies of texts: wide SimHash fingerprints, pigeonring chains, then the exact similarity of five-word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessera.llm.components import connected_components
from tessera.llm.simhash import BLOCK, SEED
from tessera.llm.text import slices
from tessera.storage import materialize

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: A fingerprint has 256 bits: a ring of 32 segments of a byte each.
SEGMENTS = 32
#: At a similarity of 0.8 fingerprints differ in 39 bits on average, with a deviation of 5.7.
MAX_BITS = 56
#: Each stride visits all segments, so it deals them to another ring.
STRIDES = (1, 3, 5, 9, 11, 13)
#: Segments of a chain that must be equal: keys of 24 bits suit up to some 1e8 texts.
RUN = 3
#: Keys of more fingerprints than this link each with the key's least one first, and compare the others only between classes. The
#: classes are the same for any value; a key of n fingerprints costs n - 1 pairs at first, or n * (n - 1) / 2 if it has no more than this.
CROWDED = 4
#: Fingerprints in a block of a crowded key, and blocks of one side that meet all others of the key in one group.
BLOCK_NODES, BLOCKS_AT_ONCE = 256, 32
#: Tables of up to this many rows of two numbers (32 MB) are broadcast to the scan of whole texts; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def shingles(text: bytes | None, n: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; A-Z are lower-cased; fewer than ``n`` words are one shingle, none give none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype="<u8"))


def fingerprint(h: np.ndarray) -> bytes:
    """SimHash of 256 bits over distinct shingles: four words, each of another finalizer of the same hashes."""
    votes = np.zeros(256, np.int64)
    for at in range(0, len(h), BLOCK):
        x = h[at : at + BLOCK, None] ^ (np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(len(x), 32), axis=1)
        votes += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(h)).tobytes()


def bins(h: np.ndarray) -> bytes:
    """How many of the shingles begin with each byte; a 255 may stand for more."""
    return np.minimum(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def may_be_similar(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Of rows of ``bins``, which may have that similarity: two sets share at most the lesser number in each bin."""
    both, sizes = np.minimum(a, b).sum(axis=1, dtype=np.int64), a.sum(axis=1, dtype=np.int64) + b.sum(axis=1, dtype=np.int64)
    return (both + 1e-6 >= least * (sizes - both)) | (a == 255).any(axis=1) | (b == 255).any(axis=1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of shingles; texts without words are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, fp, bins)``; ``fp`` is 32 bytes, ``bins`` 256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(x) for x in b.column(1).to_pylist()]
            cols = [pa.array([f(h) for h in sets], pa.binary()) for f in (fingerprint, bins)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "fp", "bins"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, fp binary, bins binary")


def _bytes(column: pa.Array, n: int = SEGMENTS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), n)


def chain_keys(nodes: DataFrame) -> DataFrame:
    """``(node, fp)`` to ``(key, node)``: for each ring and start the first ``RUN`` segments of the chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            fp, node = _bytes(b.column(1)).astype(np.int64), b.column(0).to_numpy()
            for ring, stride in enumerate(STRIDES):
                key = np.full(fp.shape, ring, np.int64) * SEGMENTS + np.arange(SEGMENTS)
                for step in range(RUN):
                    key = key << 8 | np.roll(fp, -step * stride, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(node, SEGMENTS))], names=["key", "node"])

    return nodes.select("node", "fp").mapInArrow(run, "key long, node long")


def _first_chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ring and start of the first chain that two rows of segments share."""
    equal = a == b
    rings = []
    for stride in STRIDES:
        chain = equal.copy()
        for step in range(1, RUN):
            chain &= np.roll(equal, -step * stride, axis=1)
        rings.append(chain)
    return np.concatenate(rings, axis=1).argmax(axis=1)


def within_bits(pairs: DataFrame, max_bits: int, least: float) -> DataFrame:
    """Pairs ``(src, dst, a, b, bins_a, bins_b)`` whose fingerprints differ in at most ``max_bits`` bits and whose bins leave room for the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            off = np.bitwise_count(_bytes(b.column(2)) ^ _bytes(b.column(3))).sum(axis=1, dtype=np.int64)
            keep = (off <= max_bits) & may_be_similar(_bytes(b.column(4), 256), _bytes(b.column(5), 256), least)
            yield b.select(["src", "dst"]).filter(pa.array(keep))

    return pairs.select("src", "dst", "a", "b", "bins_a", "bins_b").mapInArrow(run, "src long, dst long")


def beside_texts(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of ids that is joined to whole texts: broadcast if it is counted small, so that no text moves."""
    fixed = all(isinstance(f.dataType, NumericType) for f in ids.schema)
    return F.broadcast(ids) if fixed and ids.count() <= most else ids


def shared_chains(nodes: DataFrame) -> DataFrame:
    """``(key, node, first, n)``: the keys that more than one node holds, with the least of their nodes and how many there are."""
    keyed = chain_keys(nodes)
    # Keys are nearly unique on the map side, so rows are dealt before they are counted.
    held = keyed.repartition("key").groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    return materialize(keyed.join(held, "key"), "chains")


def binned(nodes: DataFrame) -> DataFrame:
    """``nodes`` with bins for each: where they are unknown, bins that leave room for any similarity."""
    unknown = F.lit(b"\xff" * 256)
    return nodes.withColumn("bins", F.coalesce("bins", unknown) if "bins" in nodes.columns else unknown)


def candidates(chains: DataFrame, nodes: DataFrame, max_bits: int = MAX_BITS, crowded: int = CROWDED, least: float = SIMILARITY) -> DataFrame:
    """Distinct pairs ``(src, dst)`` of nodes that share a chain of equal segments, differ in at most ``max_bits`` bits and whose
    bins leave room for a similarity of ``least``.

    A key of up to ``crowded`` nodes compares all of them; of more, each with the least one, and what these links leave in
    different classes is compared by ``between_classes``. Nodes are hashes, so the same few lead most keys of a large group.
    """
    few, many = chains.where(F.col("n") <= crowded), chains.where(F.col("n") > crowded)
    pairs = few.select("key", F.col("node").alias("src")).join(few.select("key", F.col("node").alias("dst")), "key").where("src < dst")
    star = many.where("node <> first").select(F.col("first").alias("src"), F.col("node").alias("dst"))
    once = pairs.select("src", "dst").unionByName(star).distinct()
    a, b = (binned(nodes).select(F.col("node").alias(end), F.col("fp").alias(x), F.col("bins").alias(f"bins_{x}")) for end, x in (("src", "a"), ("dst", "b")))
    return materialize(within_bits(once.join(a, "src").join(b, "dst"), max_bits, least), "candidates")


def between_classes(chains: DataFrame, nodes: DataFrame, roots: DataFrame, max_bits: int = MAX_BITS, crowded: int = CROWDED, least: float = SIMILARITY) -> DataFrame:
    """All pairs ``(src, dst)`` of nodes in different classes (``roots(node, root)``) that share a crowded key, differ in at most
    ``max_bits`` bits and whose bins leave room for a similarity of ``least``, each once; pairs that also share an earlier key which
    is not crowded are left to ``candidates``.

    A node meets its class and fingerprint once, in a row with all its crowded keys (192 at most). Keys whose nodes are all
    of one class are dropped. The others are cut into blocks, of one class where it is large, and blocks meet in groups of
    bounded size, so a key of any size is shared by tasks and two blocks of one class never meet. What a task compares in a
    block is not written out: only pairs that are left for the exact check are rows.
    """
    of = binned(nodes).join(roots, "node", "left").select("node", "fp", "bins", F.coalesce("root", "node").alias("root"))
    held = chains.where(F.col("n") > crowded).groupBy("node").agg(F.collect_list("key").alias("keys"))
    held = materialize(held.join(of, "node"), "crowded-nodes")
    split = held.select("root", F.explode("keys").alias("key")).groupBy("key", "root").agg(F.count("*").alias("c"))
    split = materialize(split, "classes-of-keys")
    mixed = split.groupBy("key").agg(F.count("*").alias("classes"), F.sum(F.when(F.col("c") < BLOCK_NODES, F.col("c"))).alias("rest")).where("classes > 1")
    member = F.struct("node", "root", "fp", "bins").alias("m")
    rows = held.select(F.explode("keys").alias("key"), "root", member).join(split.join(mixed, "key"), ["key", "root"])
    large = F.col("c") >= BLOCK_NODES
    parts = F.ceil(F.when(large, F.col("c")).otherwise(F.col("rest")) / BLOCK_NODES)
    rows = rows.select("key", F.when(large, F.col("root")).alias("own"), F.pmod(F.xxhash64("m.node"), parts).alias("part"), "m")
    blocks = materialize(rows.groupBy("key", "own", "part").agg(F.collect_list("m").alias("m")), "blocks-of-keys")
    turns = blocks.groupBy("key").agg(F.ceil(F.count("*") / BLOCKS_AT_ONCE).alias("turns"))
    fields = ("own", "part", "node", "root", "fp", "bins")
    blocks = blocks.join(turns, "key").select("key", "turns", *(F.col(c).alias(f"{c}_a") for c in fields[:2]), *(F.col(f"m.{c}").alias(f"{c}_a") for c in fields[2:]))
    other = blocks.withColumnsRenamed({f"{c}_a": f"{c}_b" for c in fields}).withColumn("turn", F.pmod(F.xxhash64("own_b", "part_b"), F.col("turns"))).drop("turns")
    meet = blocks.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).join(other, ["key", "turn"])
    meet = meet.where("(own_a is null and own_b is null and part_a <= part_b) or (own_a is null and own_b is not null) or own_a < own_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            key, (x, y) = b.column(0)[0].as_py(), [[np.asarray(b[f"{c}_{side}"][0].values) for c in ("node", "root")] for side in "ab"]
            (fx, fy), (bx, by) = ([_bytes(b[f"{c}_{side}"][0].values, n) for side in "ab"] for c, n in (("fp", SEGMENTS), ("bins", 256)))
            off = np.zeros((len(fx), len(fy)), np.int64)
            for p, q in zip(fx.view(np.uint64).T, fy.view(np.uint64).T, strict=True):
                off += np.bitwise_count(p[:, None] ^ q[None, :])
            i, j = np.nonzero((off <= max_bits) & (x[1][:, None] != y[1][None, :]))
            # A block meets itself with either order of a pair.
            if len(x[0]) == len(y[0]) and (x[0] == y[0]).all():
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 4096):
                p, q = i[at : at + 4096], j[at : at + 4096]
                keep = may_be_similar(bx[p], by[q], least)
                p, q = p[keep], q[keep]
                first = _first_chain(fx[p], fy[q]) == key >> (8 * RUN)
                u, v = x[0][p[first]], y[0][q[first]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["src", "dst"])

    columns = [f"{c}_{side}" for side in "ab" for c in fields[2:]]
    return meet.select("key", *columns).mapInArrow(run, "src long, dst long")


def similar(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs ``(src, dst)`` whose ``texts(node, t)`` have at least that similarity of five-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            sets: dict[int, np.ndarray] = {}
            keep = []
            for src, dst, x, y in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for node, t in ((src, x), (dst, y)):
                    if node not in sets:
                        sets[node] = shingles(t)
                keep.append(similarity(sets[src], sets[dst]) >= least)
            yield b.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    a = texts.select(F.col("node").alias("src"), F.col("t").alias("x"))
    b = texts.select(F.col("node").alias("dst"), F.col("t").alias("y"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "x", "y").mapInArrow(run, "src long, dst long")


def of_node(texts: DataFrame) -> DataFrame:
    """``texts(node, t, shared)`` without texts that are not of that node's fingerprint: where ids are ``shared`` by documents with
    different fingerprints, an id alone doesn't say which text is meant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            known = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            keep = [not shared or np.uint64(xxhash.xxh64_intdigest(fingerprint(shingles(t)), SEED)).astype(np.int64) == node for node, t, shared in known]
            yield b.select(["node", "t"]).filter(pa.array(keep, pa.bool_()))

    return texts.select("node", "t", "shared").mapInArrow(run, "node long, t binary")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, max_bits: int = MAX_BITS, crowded: int = CROWDED) -> DataFrame:
    """One row a document: ``id`` and ``component``, the smallest id of its class.

    Links join texts of at least ``least`` similarity (Jaccard, distinct five-word shingles) found by chains of their
    fingerprints; the exact check follows the Hamming check and one of bins, which loses none. Texts of equal 256-bit fingerprints are one node, so exact
    copies cost no pairs. Classes are those of all pairs that share a key, whatever its size: what the links through the
    least text of a crowded key leave apart is compared in a second round. Null and blank texts are alike. Null ids are
    skipped in the minimum (null if a class has no other). Repeated rows are documents like any other; very long texts are
    summed in blocks; an empty table gives an empty result; other columns are ignored. A chance to miss a pair remains: a
    pair must have one of 192 chains equal.
    """
    rows = materialize(fingerprints(docs, id_col, text_col).withColumn("node", F.xxhash64("fp")), "wide")
    nodes = materialize(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.min_by("bins", "id").alias("bins"), F.min("id").alias("low")), "nodes")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).where("id is not null")
    shared = rows.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("id", F.lit(1).alias("shared"))

    def links(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct()
        lead = nodes.join(asked, "node", "left_semi").where("low is not null").select("node", F.col("low").alias("id"))
        lead = materialize(lead.join(shared, "id", "left").select("id", "node", F.coalesce("shared", F.lit(0)).alias("shared")), "asked")
        one = materialize(of_node(texts.join(beside_texts(lead), "id")).groupBy("node").agg(F.first("t").alias("t")), "texts")
        return materialize(similar(pairs, one, least), "links")

    chains = shared_chains(nodes)
    pairs = candidates(chains, nodes, max_bits, crowded, least)
    found = links(pairs)
    roots = connected_components(found)
    if not chains.where(F.col("n") > crowded).isEmpty():
        roots = materialize(roots, "roots")
        apart = materialize(between_classes(chains, nodes, roots, max_bits, crowded, least).join(pairs, ["src", "dst"], "left_anti"), "apart")
        if not apart.isEmpty():
            # Members of a class are linked to its root already.
            roots = connected_components(roots.select(F.col("node").alias("src"), F.col("root").alias("dst")).unionByName(links(apart)))
    placed = nodes.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    of = placed.join(placed.groupBy("root").agg(F.min("low").alias("component")), "root").select("node", "component")
    return rows.join(of, "node").select("id", "component")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class of near-copies: the smallest id (of repeated rows with that id, one).

    Rows with a null id are kept: they can't be told apart.
    """
    found = materialize(near_copies(docs, id_col=id_col, text_col=text_col, least=least), "classes").where("id is not null")
    drop = materialize(found.where(F.col("id") != F.col("component")).select(F.col("id").alias(id_col)).distinct(), "dropped")
    kept = docs.join(beside_texts(drop), id_col, "left_anti").select(*docs.columns)
    again = materialize(found.groupBy("id").count().where("count > 1").select(F.col("id").alias(id_col)), "repeated")
    if again.isEmpty():
        return kept
    rest = kept.join(again, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns)
    return kept.join(again, id_col, "left_anti").select(*docs.columns).unionByName(rest)
