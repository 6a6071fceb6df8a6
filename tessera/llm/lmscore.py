"""Stupid-backoff language-model scores of documents under the n-gram counts of all other documents.

Documents are gathered in blocks, which count their own n-grams. One order after the other, the blocks' n-grams are dealt by
ranges of a hash and counted range by range; what other blocks have of them returns to the block,
whose documents sum their scores. Only one order's n-grams are on disk at a time. A frequent n-gram costs one row a block, so
hot ones need no salt; nothing is sampled, cut off or broadcast.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.text import slices
from tessera.storage import materialize

#: Backoff factor of the method (fixed value).
ALPHA = 0.4
#: Longest n-gram.
ORDER = 3
#: Bytes of text in a block of documents, and bytes of text whose n-grams one partition of the count tables holds.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
#: Most ranges of keys: with more data partitions grow, while 48 bits and the range still tell n-grams apart.
MOST_BUCKETS = 1 << 16
#: Most keys in a row of packed n-grams.
PIECE = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: spreads keys evenly over their range, so that buckets are ranges of keys."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_keys(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit keys of the n-grams that end at words n-1, n, ... of a sequence of word hashes."""
    m = max(0, len(words) - n + 1)
    key = np.full(m, np.uint64(n))
    for k in range(n):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + words[k : k + m])
    return key


def packed(values: np.ndarray, ends: np.ndarray | list[int]) -> pa.Array:
    """One binary value for each of the rows that end at ``ends[1:]``: bytes cross Spark as a whole, a list's numbers one by one."""
    offsets = (np.asarray(ends, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(rows: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows that ``packed`` made, and where rows begin and end among them."""
    x = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    _, offsets, data = x.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(x.type) else np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64) if len(x) else np.zeros(1, np.int64)
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return values.view(kind), (ends - ends[0]) // np.dtype(kind).itemsize


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts 64-bit keys, equal ones as they came, and where each different key begins in it.

    Places are sorted along in the keys' lowest bits, which is several times faster than sorting places by keys; where keys
    differ in those bits only, and so came out of order, they are sorted in full.
    """
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.uint64(len(keys).bit_length())
    both = keys >> bits << bits | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    held = keys[order]
    if (held[1:] < held[:-1]).any():
        order = np.argsort(keys, kind="stable")
        held = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))


class Block:
    """Documents as indices into a sorted table of word hashes; n-grams never reach from one document to the next."""

    def __init__(self, words: np.ndarray, index: np.ndarray, sizes: np.ndarray):
        self.words, self.index, self.sizes = words, index, sizes
        self.ends = np.cumsum(sizes)
        self.place = np.arange(len(index)) - np.repeat(self.ends - sizes, sizes)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which an n-gram of one document ends, and the keys."""
        at = np.flatnonzero(self.place >= n - 1)
        return at, ngram_keys(self.words[self.index], n)[at - (n - 1)]


def blocks_of(docs: DataFrame, *, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """``block, ids, sizes, words, low, mid, high``: of the documents of a block their ids and numbers of words, the hashes of all
    different words, frequent ones first, and each word's place among these (lowest byte, next byte, and the rest)."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, codes, seen, held = [], [], [], defaultdict(count().__next__), 0

        def emit() -> pa.RecordBatch:
            h = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen))
            tokens = np.concatenate(codes)
            order = np.argsort(-np.bincount(tokens, minlength=len(h)), kind="stable")
            place = np.empty(len(h), np.int32)
            place[order] = np.arange(len(h))
            tokens = place[tokens]
            lists = {"words": h[order], "low": tokens.astype(np.uint8), "mid": (tokens >> 8).astype(np.uint8), "high": (tokens >> 16).astype(np.uint16)}
            row = [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([ids], pa.list_(of)), pa.array([np.array(sizes, np.int32)]), *(packed(x, [0, len(x)]) for x in lists.values())]
            return pa.RecordBatch.from_arrays(row, names=["block", "ids", "sizes", *lists])

        for b in slices(batches):
            of = b.column(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (text or b"").split()
                ids.append(key)
                sizes.append(len(words))
                codes.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
                held += len(text or b"")
                if held >= block_bytes:
                    yield emit()
                    ids, sizes, codes, seen, held = [], [], [], defaultdict(count().__next__), 0
        if ids:
            yield emit()

    schema = f"block long, ids array<{kind.simpleString()}>, sizes array<int>, words binary, low binary, mid binary, high binary"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, schema)


def open_block(row: pa.RecordBatch | pa.Table) -> Block:
    """The block in a table of one row."""
    words, low, mid, high = (unpacked(row[c], kind)[0] for c, kind in (("words", np.uint64), ("low", np.uint8), ("mid", np.uint8), ("high", np.uint16)))
    return Block(words, high.astype(np.int64) << 16 | mid.astype(np.int64) << 8 | low, np.asarray(row["sizes"][0].values).astype(np.int64))


def pieces(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys in pieces of one bucket (of ``buckets`` equal ranges of keys) and at most ``PIECE`` keys: the bucket and the
    beginning of each piece."""
    edges = np.array([k * (1 << 64) // buckets for k in range(1, buckets)], np.uint64)
    cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    parts = -(-np.diff(cut) // PIECE)
    bucket = np.repeat(np.arange(buckets), parts)
    nth = np.arange(len(bucket)) - np.repeat(np.cumsum(parts) - parts, parts)
    return bucket, cut[bucket] + PIECE * nth


def bucket_names(spark: SparkSession, buckets: int, parts: int) -> np.ndarray:
    """Names of buckets that ``repartition(parts, bucket)`` deals evenly: the smallest numbers that hash to each partition."""
    ids = spark.range(32 * parts).select(F.col("id").cast("int").alias("id"))
    held = ids.groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("p")).agg(F.min("id").alias("id")).orderBy("p").limit(buckets)
    names = [r.id for r in held.select("id").collect()]
    return np.array(names + list(range(32 * parts, 32 * parts + buckets - len(names))), np.int32)


def block_grams(blocks: DataFrame, n: int, names: np.ndarray) -> DataFrame:
    """``bucket, block, piece, top, mid, low, c``: the different n-grams of each block in pieces (see ``pieces``), the lower
    48 bits of their keys (8, 32 and 8), and how often the block has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            keys, counts = np.unique(open_block(b).grams(n)[1], return_counts=True)
            bucket, start = pieces(keys, len(names))
            ends = np.append(start, len(keys))
            lists = ((keys >> np.uint64(40)).astype(np.uint8), (keys >> np.uint64(8)).astype(np.uint32), keys.astype(np.uint8), counts.astype(np.uint32))
            cols = [pa.array(names[bucket]), pa.array(np.full(len(bucket), b.column(0)[0].as_py(), np.int64)), pa.array(np.arange(len(bucket), dtype=np.int32))]
            yield from slices([pa.RecordBatch.from_arrays([*cols, *(packed(x, ends) for x in lists)], names=["bucket", "block", "piece", "top", "mid", "low", "c"])])

    return blocks.drop("ids").mapInArrow(run, "bucket int, block long, piece int, top binary, mid binary, low binary, c binary")


def counts_elsewhere(grams: DataFrame, parts: int) -> DataFrame:
    """``block, piece, at, low, high, rest``: which of a block's n-grams other blocks have too (a bit for each of the piece), and
    of these how often the other blocks have them (lowest seven bits, next eight, and the rest).

    N-grams are dealt to partitions by bucket while they are packed by block, and a bucket is counted in one sort. It is a
    range of hashes: their number grows with the text, so a bucket keeps its size, and a frequent n-gram has one row a
    block there, whatever the number of its occurrences.
    """

    def total(b: pa.Table) -> pa.Table:
        top, ends = unpacked(b["top"], np.uint8)
        mid, low, own = (unpacked(b[c], kind)[0] for c, kind in (("mid", np.uint32), ("low", np.uint8), ("c", np.uint32)))
        keys = top.astype(np.uint64) << np.uint64(56) | mid.astype(np.uint64) << np.uint64(24) | low.astype(np.uint64) << np.uint64(16)
        order, first = grouped(keys)
        own = own.astype(np.int64)[order]
        blocks = np.diff(first, append=len(keys))
        others, shared = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        others[order] = np.repeat(np.add.reduceat(own, first), blocks) - own if len(keys) else 0
        shared[order] = np.repeat(blocks > 1, blocks)
        found = np.flatnonzero(shared)
        others, row = others[found], np.repeat(np.arange(len(ends) - 1), np.diff(ends))[found]
        kept, n = np.unique(row, return_counts=True)
        # a kept piece's bits begin with a byte
        size = -(-np.diff(ends)[kept] // 8)
        bits, cut = np.zeros(8 * size.sum(), np.uint8), np.concatenate([[0], np.cumsum(size)])
        bits[found - np.repeat(ends[kept] - 8 * cut[:-1], n)] = 1
        lists = ((others & 127).astype(np.uint8), (others >> 7).astype(np.uint8), (others >> 15).astype(np.uint32))
        rows, ends = b.select(["block", "piece"]).take(pa.array(kept)), np.concatenate([[0], np.cumsum(n)])
        return pa.table([*rows.columns, packed(np.packbits(bits), cut), *(packed(x, ends) for x in lists)], names=["block", "piece", "at", "low", "high", "rest"])

    return grams.repartition(parts, "bucket").groupBy("bucket").applyInArrow(total, "block long, piece int, at binary, low binary, high binary, rest binary")


def answered(answers: pa.Table, start: np.ndarray, keys: int) -> np.ndarray:
    """How often other blocks have each of a block's n-grams of one order, whose pieces begin at ``start``."""
    out, bits = np.zeros(keys, np.int64), unpacked(answers["at"], np.uint8)
    low, high, rest = (unpacked(answers[c], kind)[0].astype(np.int64) for c, kind in (("low", np.uint8), ("high", np.uint8), ("rest", np.uint32)))
    place = np.repeat(start[answers["piece"].to_numpy()] - 8 * bits[1][:-1], 8 * np.diff(bits[1]))
    at = np.flatnonzero(np.unpackbits(bits[0]))
    out[place[at] + at] = rest << 15 | high << 7 | low
    return out


def score_block(block: Block, elsewhere: Callable[[int, np.ndarray], np.ndarray], words: int, order: int, alpha: float) -> tuple:
    """Sums of log10 scores of a block's documents, under counts less their own; ``elsewhere`` gets an order and its sorted keys
    and returns the counts in other blocks."""
    doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
    rest: list[np.ndarray] = []
    for n in range(1, order + 1):
        at, keys = block.grams(n)
        by, first = grouped(keys)
        here, at = np.diff(first, append=len(keys)), at[by]
        # a key's occurrences in one document are neighbours in this order
        run = np.concatenate([[True], doc[at[1:]] != doc[at[:-1]]])[: len(at)]
        run[first] = True
        own = np.flatnonzero(run)
        mine = np.diff(own, append=len(at))
        left = np.zeros(len(doc))
        left[at] = np.repeat(elsewhere(n, keys[by[first]]).astype(np.float64) + here, here) - np.repeat(mine, mine)
        rest.append(left)
    others = np.maximum(1.0, float(words) - block.sizes[doc])
    score, level, open_ = np.zeros(len(doc)), np.zeros(len(doc)), np.ones(len(doc), bool)
    for n in range(order, 0, -1):
        can = block.place >= n - 1
        hit = open_ & can & (rest[n - 1] > 0)
        if n > 1:
            context = np.concatenate([[0.0], rest[n - 2][:-1]])
            score[hit] = np.log10(rest[n - 1][hit] / np.maximum(context[hit], rest[n - 1][hit]))
        else:
            score[hit] = np.log10(rest[0][hit] / others[hit])
        score[hit] += level[hit] * math.log10(alpha)
        open_ &= ~hit
        level[open_ & can] += 1
    score[open_] = level[open_] * math.log10(alpha) - np.log10(others[open_])
    run = np.concatenate([[0.0], np.cumsum(score)])
    sums = run[block.ends] - run[block.ends - block.sizes]
    backed = np.concatenate([[0], np.cumsum(level > 0)])
    return block.sizes, sums, backed[block.ends] - backed[block.ends - block.sizes]


def stupid_backoff(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row a document: ``id, n_words, log10_score`` (sum over words), ``backed_off`` (words scored below the full order).

    A word's score is the count of the longest n-gram that ends at it and occurs in another document, divided by the count
    of that n-gram without the word, times ``alpha`` for each order that was given up; counts are those of all documents
    less the document's own. Words that no other document has get the share of one word of the others. At the start of a
    document orders that reach before it are skipped without a factor. Null and blank texts have score 0. Repeated rows
    are documents of their own; an empty table gives an empty result; other columns are ignored; a text of any length is
    scored whole (a block holds at least one document). N-grams are compared by 48 bits of hash within a bucket.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-size // bucket_bytes))
    # A table holds one order's n-grams.
    tables = max(least, -(-size // (order * bucket_bytes)))
    buckets = min(tables, MOST_BUCKETS)
    blocks = materialize(blocks_of(docs, id_col=id_col, text_col=text_col, block_bytes=block_bytes), "blocks", codec="zstd", buckets=(parts, "block"))
    names = bucket_names(spark, buckets, tables)
    each = [counts_elsewhere(block_grams(blocks, n, names), tables).withColumn("n", F.lit(n)) for n in range(1, order + 1)]
    found = reduce(DataFrame.unionByName, [materialize(x, "elsewhere", codec="zstd", drop_shuffles=True) for x in each])
    words = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    kind = docs.schema[id_col].dataType.simpleString()

    def score(b: pa.Table, answers: pa.Table) -> pa.Table:
        block = open_block(b)
        which = answers["n"].to_numpy()

        def elsewhere(n: int, keys: np.ndarray) -> np.ndarray:
            return answered(answers.filter(pa.array(which == n)), pieces(keys, buckets)[1], len(keys))

        n, sums, backed = score_block(block, elsewhere, words, order, alpha)
        ids = b["ids"][0].values
        return pa.table([ids, pa.array(n, pa.int64()), pa.array(np.round(sums, 9) + 0.0), pa.array(backed, pa.int64())], names=["id", "n_words", "log10_score", "backed_off"])

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, f"id {kind}, n_words long, log10_score double, backed_off long")
