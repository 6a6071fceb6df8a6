"""Quality rules: statistics of each document, a base rule, and an isolation forest calibrated on labelled rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.text import slices, where_arrow
from tessera.storage import materialize

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
WINDOW, FEWEST_WORDS, MOST_REPEATED = 8, 20, 30
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the forest splits on.
STATS = ("symbols_per_word", "marks_per_word", "upper_share", "word_length", "dup_line_share", "repeat_share", "same_as_previous", "bare_words", "digit_share")
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
#: The forest is fitted on at most this many labelled rows; a tree on SUBSAMPLE of them.
SAMPLE_ROWS, TREES, SUBSAMPLE, SEED = 8_192, 128, 256, 7
#: What of a statistic lies outside these quantiles of the labelled good rows is its excess, on which trees split.
EDGES, ACCURACY = (0.0005, 0.9995), 50_000
#: The threshold may lose at most this share of labelled good rows. Bins of the calibration histogram.
GOOD_LOSS, BINS = 0.001, 4096


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in windows of ``width`` words found twice or more. Hashes rule most texts out; equal hashes are compared."""
    m = len(ids) - width + 1
    if m < 2:
        return 0
    h = np.zeros(m, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + m]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    again = np.sort(order[np.append(same, False) | np.insert(same, 0, False)])
    hit = np.zeros(m, bool)
    for at in _equal_windows(ids, again, h, width):
        hit[at] = True
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(hit)
    cover[at] += 1
    np.subtract.at(cover, at + width, 1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _equal_windows(ids: np.ndarray, at: np.ndarray, h: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Of the windows at ``at``, those with an equal one, by their words: sorted by hash and then words, neighbours compare."""
    words = np.stack([ids[at + k] for k in range(width)], axis=1)
    order = np.lexsort([*words.T, h[at]])
    same = (words[order][1:] == words[order][:-1]).all(axis=1)
    yield at[order[np.append(same, False) | np.insert(same, 0, False)]]


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """``BASE`` and ``STATS`` of a whole text; a null text has no words."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    if not n:
        return [0, 0, sum(map(text.count, SYMBOLS)), 0, 0], [0.0] * len(STATS)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dups, symbols, repeats = len(lines) - len(set(lines)), sum(map(text.count, SYMBOLS)), repeated_words(ids)
    chars = len(text) - sum(map(text.count, SPACES))
    upper, lower, digits = (len(data) - len(data.translate(None, x)) for x in (UPPER, LOWER, DIGITS))
    bare = sum(len(w) == 1 and not w.isalnum() for w in seen)
    bare_words = n and sum(1 for w in words if len(w) == 1 and not w.isalnum()) if bare else 0
    same = int((ids[1:] == ids[:-1]).sum())
    return [n, chars, symbols, dups, repeats], [symbols / n, text.count("!") / n, upper / max(1, upper + lower), chars / n, dups / max(1, len(lines)), repeats / n, same / n, bare_words / n, digits / max(1, chars)]


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < FEWEST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])


def all_statistics(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    rows = [statistics(t) for t in texts]
    return np.array([r[0] for r in rows], np.int64).reshape(-1, len(BASE)), np.array([r[1] for r in rows]).reshape(-1, len(STATS))


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of n rows, the depth that a leaf of n rows stands for."""
    n = np.asarray(n, np.float64)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def excess(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far each statistic is outside what labelled good rows show."""
    return np.maximum(0.0, np.maximum(x - high, low - x))


class Forest:
    """Isolation trees over excesses, as heaps: node ``i`` splits ``feature[i] < value[i]`` to ``2i+1`` or else ``2i+2``; leaves have feature -1."""

    def __init__(self, feature: np.ndarray, value: np.ndarray, path: np.ndarray, norm: float, low: np.ndarray, high: np.ndarray):
        self.feature, self.value, self.path, self.norm, self.low, self.high = feature, value, path, norm, low, high

    def parts(self) -> tuple:
        return self.feature, self.value, self.path, self.norm, self.low, self.high

    @classmethod
    def fit(cls, stats: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
        x = excess(stats, low, high)
        rng, size = np.random.default_rng(seed), min(subsample, len(x))
        depth = max(1, math.ceil(math.log2(max(2, size))))
        nodes = (1 << depth + 1) - 1
        feature, value, path = np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            held = {0: rng.choice(len(x), size, replace=False)}
            for i in range(nodes):
                if (rows := held.pop(i, None)) is None:
                    continue
                level = (i + 1).bit_length() - 1
                least, most = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
                if level == depth or len(rows) < 2 or not (spread := np.flatnonzero(most > least)).size:
                    path[t, i] = level + average_path(len(rows))
                    continue
                f = rng.choice(spread)
                cut = rng.uniform(least[f], most[f])
                left = x[rows, f] < cut
                feature[t, i], value[t, i] = f, cut
                held[2 * i + 1], held[2 * i + 2] = rows[left], rows[~left]
        return cls(feature, value, path, float(average_path(size)) or 1.0, low, high)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Anomaly score 2 ** -(mean path / normal path), 0 to 1."""
        x = excess(stats, self.low, self.high)
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for f, v, p in zip(self.feature, self.value, self.path, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                split = f[at]
                inner = split >= 0
                if not inner.any():
                    break
                at = np.where(inner, 2 * at + 2 - (x[rows, np.maximum(split, 0)] < v[at]), at)
            total += p[at]
        return np.exp2(-total / len(self.path) / self.norm)


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the columns of ``BASE`` (long) and ``stats`` (array of double in the order of ``STATS``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            base, stats = all_statistics(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(base[:, i]) for i in range(len(BASE))], pa.array(list(stats), pa.list_(pa.float64()))], names=["id", *BASE, "stats"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", stats array<double>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def failed_column() -> F.Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """``measured`` rows with ``score``."""
    held = rows.sparkSession.sparkContext.broadcast(forest.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Forest(*held.value)
        for b in batches:
            x = b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.score(x))], names=[*b.schema.names, "score"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def labelled(rows: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """Measured rows that the base rule passes and that have one label, 0 or 1 (ids with contradicting labels are left out)."""
    one = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("good")).where("id is not null and good in (0, 1)")
    one = one.groupBy("id").agg(F.min("good").alias("good"), F.max("good").alias("most")).where("good = most").drop("most")
    return rows.where(~failed_column()).join(one, "id")


def fit(rows: DataFrame, labels: DataFrame, *, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> tuple[Forest, float]:
    """Forest and threshold from measured rows.

    Bounds of each statistic are quantiles over all labelled good rows. The forest is fitted on ``sample_rows`` labelled rows, the first by a hash of the id
    among about twice as many that the hash draws (so that tasks send few rows). The threshold is found on all
    labelled rows from a histogram of their scores: the one that separates good from bad best (largest difference of
    the shares above it) of those that lose at most ``GOOD_LOSS`` of the good rows. Without labels of both kinds it is infinite.
    """
    known = materialize(labelled(rows, labels, label_col).select("id", "good", "stats"), "labelled")
    u = F.xxhash64(F.lit(SEED), "id")
    rate = min(1.0, 2.0 * sample_rows / max(1, known.count()))
    drawn = known.where(u.bitwiseAND(F.lit((1 << 53) - 1)) < int(rate * (1 << 53)))
    sample = drawn.orderBy(u, "id").limit(sample_rows).select("stats").toPandas()["stats"]
    sides = [F.percentile_approx(F.col("stats")[i], list(EDGES), ACCURACY).alias(c) for i, c in enumerate(STATS)]
    edges = known.where("good = 1").agg(*sides).first()
    if edges[0] is None:
        none = np.full(len(STATS), math.inf)
        return Forest.fit(np.zeros((2, len(STATS))), -none, none), math.inf
    forest = Forest.fit(np.stack(sample.to_list()), *np.array(edges, np.float64).T)
    bins = scored(known, forest).groupBy(F.floor(F.col("score") * BINS).alias("b")).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    found = np.zeros((BINS + 2, 2))
    for b, good, bad in bins.collect():
        found[b] = good, bad
    if not found.sum(0).all():
        return forest, math.inf
    above = found[::-1].cumsum(0)[::-1] / found.sum(0)
    gain = np.where(above[:, 0] <= GOOD_LOSS, above[:, 1] - above[:, 0], -1)
    best = gain.max()
    at = np.flatnonzero(gain == best)
    return forest, float(at[len(at) // 2]) / BINS if best > 0 else math.inf


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id``, ``BASE``, ``base_failed``, ``score`` and ``kept``: it passes the base rule and its score is below the threshold.

    Null and blank texts have no words and fail the base rule. Repeated rows count each; null ids are judged but never
    labelled; an empty table gives an empty result; other columns are ignored.
    """
    rows = materialize(measured(docs, id_col=id_col, text_col=text_col), "statistics")
    forest, limit = fit(rows, labels)
    return scored(rows, forest).select("id", *BASE, failed_column().alias("base_failed"), "score", (~failed_column() & (F.col("score") < F.lit(limit))).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that ``judge`` doesn't keep, with all their columns. The statistics are taken once to fit
    and once to filter, which moves less than joining verdicts to texts."""
    forest, limit = fit(materialize(measured(docs, id_col=id_col, text_col=text_col), "statistics"), labels)
    held = docs.sparkSession.sparkContext.broadcast(forest.parts())

    def tests():
        own = Forest(*held.value)

        def keep(text: pa.Array) -> np.ndarray:
            base, stats = all_statistics(text.to_pylist())
            return ~base_failed(base) & (own.score(stats) < limit)

        return keep

    return where_arrow(docs, [text_col], tests)
