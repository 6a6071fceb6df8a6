"""Best-fit packing of token pieces into sequences under several capacities, planned on counts of pieces by length."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import bpe
from tessera.llm.text import slices
from tessera.storage import materialize

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END = 1024, 2
#: Weights of the residual capacities (tokens, documents, attention cost) in a bin's score.
WEIGHTS = (1.0, 0.1, 0.1)


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """``(start, length, crc32)`` of each piece of a document's ids (little-endian unsigned 32-bit): one piece where it fits,
    else full pieces after a first one that holds the rest."""
    n = len(ids) // 4
    cuts = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(cuts, cuts[1:], strict=False)]


class _Bins:
    """Open bins as runs of neighbours in one state: what is left of each capacity, and who is next in each run."""

    def __init__(self, capacities: np.ndarray, weights: np.ndarray, score: str):
        self.capacities, self.weights, self.by_norm = capacities, weights, score == "norm"
        self.left, self.runs, self.at = np.zeros((0, len(capacities)), np.int64), [], {}

    def best(self, demand: np.ndarray) -> int | None:
        """The state with the least score of those that hold the demand within every capacity; the older one of a tie."""
        open_ = np.flatnonzero((self.left >= demand).all(axis=1) & self.held())
        if not len(open_):
            return None
        left, need = self.left[open_] / self.capacities, demand / self.capacities
        score = (self.weights * (left - need) ** 2).sum(axis=1) if self.by_norm else (self.weights * left * need).sum(axis=1)
        return int(open_[np.argmin(score)])

    def held(self) -> np.ndarray:
        return np.array([bool(r) for r in self.runs], bool)

    def take(self, state: int, n: int) -> tuple[int, int]:
        """Up to ``n`` neighbouring bins of a state: ``(first, how many)``; the rest stays."""
        first, many = self.runs[state].pop()
        if many > n:
            self.runs[state].append((first + n, many - n))
        return first, min(n, many)

    def put(self, left: np.ndarray, first: int, many: int) -> None:
        if (key := tuple(left.tolist())) not in self.at:
            self.at[key] = len(self.runs)
            self.left = np.vstack([self.left, left])
            self.runs.append([])
        self.runs[self.at[key]].append((first, many))


def plan(counts: Mapping[int, int], *, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS, score: str = "norm") -> tuple[np.ndarray, int]:
    """Vector best fit, decreasing, on counts of pieces by length: ``(rows, bins)``, with rows ``(length, rank, many, bin, offset)``.

    The ``many`` pieces of a length from the ``rank``-th on go to neighbouring bins from ``bin`` on, one each, behind
    ``offset`` tokens. A piece of length n needs n tokens, one document and n * n of attention cost. It goes to the open
    bin with the least score of those that hold it within all three capacities: the weighted norm of what is left then
    (``score="norm"``), or the weighted dot product of what is left before with the need (``"dot"``). All bins of a state
    take a piece in one step, so the work depends on lengths and states, not on the number of pieces.
    """
    caps = np.array([capacity, max_docs or capacity, max_cost or capacity * capacity], np.int64)
    bins, rows, made = _Bins(caps, np.array(weights), score), [], 0
    for n in sorted(counts, reverse=True):
        demand, rank, todo = np.array([n, 1, n * n], np.int64), 0, counts[n]
        if (demand > caps).any():
            raise ValueError(f"a piece of {n} tokens fits no sequence")
        while todo:
            if (state := bins.best(demand)) is None:
                # new bins take as many of these pieces as they hold, before an emptier one is opened
                each = int((caps // demand).min())
                many, left = max(1, todo // each), caps
                first, made = made, made + many
                for k in range(min(each, todo)):
                    rows.append((n, rank, many, first, k * n))
                    rank, todo, left = rank + many, todo - many, left - demand
                bins.put(left, first, many)
            else:
                left = bins.left[state]
                first, many = bins.take(state, todo)
                rows.append((n, rank, many, first, capacity - int(left[0])))
                rank, todo = rank + many, todo - many
                bins.put(left - demand, first, many)
    return np.array(rows, np.int64).reshape(-1, 5), made


def cut(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents: ``id, piece, start, length, crc, part, nth``; ``nth`` numbers the pieces of a length in task ``part``.

    One narrow pass: texts are encoded by the automaton of ``bpe`` and followed by ``end``; null texts are empty.
    """
    shared = bpe._broadcast(docs.sparkSession, path)
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = bpe._encoder(shared.value), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in slices(batches):
            found = [pieces_of(ids + tail, capacity) for ids in encoder.encode([x or "" for x in b.column(1).to_pylist()])]
            sizes = np.array([len(x) for x in found], np.int64)
            start, length, crc = np.array([p for x in found for p in x], np.int64).reshape(-1, 3).T
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], length[order], "left")
            nth = np.zeros(len(length), np.int64)
            nth[order] = seen[length[order]] + np.arange(len(length)) - first
            seen += np.bincount(length, minlength=capacity + 1)
            owner = np.repeat(np.arange(len(found)), sizes)
            piece = np.arange(len(length)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(length), part), pa.int32()), pa.array(nth)],
                names=["id", "piece", "start", "length", "crc", "part", "nth"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, piece int, start long, length long, crc long, part int, nth long")


def pack(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row a piece: ``id, piece, start, length, crc, sequence, offset``; each sequence holds at most ``capacity`` tokens.

    Pieces get their number within their length from counts by task and length, a running sum over tasks and the number in
    the task, without a sort. The driver sees one count a length (at most ``capacity``), from which ``plan`` lays out bins for
    all pieces at once; its rows, whose number depends on lengths and not on pieces, are broadcast. ``limits`` are those
    of ``plan``: ``max_docs`` and ``max_cost`` (neither binds unless given), ``weights``, ``score``.

    Null texts are empty documents (one piece of one token), repeated rows are documents of their own, an empty table gives
    an empty result, other columns are ignored.
    """
    cuts = materialize(cut(docs, path, capacity=capacity, end=end, id_col=id_col, text_col=text_col), "pieces")
    by_task = materialize(cuts.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(counts, capacity=capacity, **limits)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = by_task.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    shared = docs.sparkSession.sparkContext.broadcast(lookup(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        for b in batches:
            sequence, offset = place(where, b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "crc", "sequence", "offset"])

    ranked = cuts.join(base, ["part", "length"]).select("id", "piece", "start", "length", "crc", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, f"id {cuts.schema['id'].dataType.simpleString()}, piece int, start long, length long, crc long, sequence long, offset long")


def lookup(rows: np.ndarray) -> dict[int, np.ndarray]:
    """Plan rows by length, in the order of rank."""
    by = defaultdict(list)
    for n, *rest in rows.tolist():
        by[n].append(rest)
    return {n: np.array(sorted(x), np.int64) for n, x in by.items()}


def place(where: dict[int, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces, given their length and their number within it."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for n in np.unique(length).tolist():
        who = np.flatnonzero(length == n)
        first, _, bin_, at = where[n][np.searchsorted(where[n][:, 0], rank[who], "right") - 1].T
        sequence[who], offset[who] = bin_ + rank[who] - first, at
    return sequence, offset
