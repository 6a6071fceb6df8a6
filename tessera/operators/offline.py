"""Retrospective change points of whole series: five searches over segment costs, for all penalties at once, and their calibration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("pelt", "binseg", "bottomup", "window", "kernel")
#: Penalties among which calibration chooses, and false points per 100 months that it aims at (fixed values).
PENALTIES = (0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 20.0, 35.0)
TARGET = 3.0
LEAST, WIDTH = 2, 6
#: Numbers in the cost table of the series that are searched together.
TABLE = 4_000_000


def standardized(x: np.ndarray) -> np.ndarray:
    """Series (rows) about their median, in units of the robust spread of their monthly steps."""
    middle = np.median(x, axis=1, keepdims=True)
    return (x - middle) / (np.median(np.abs(np.diff(x, axis=1)), axis=1, keepdims=True) * 1.4826 / np.sqrt(2) + 1e-6)


def segment_costs(x: np.ndarray, kernel: bool = False) -> np.ndarray:
    """``cost[row, i, j]`` of segment [i, j) of each row: sum of squares about its mean, in the data or in the feature space of a
    Gaussian kernel whose width is the median squared distance. Segments shorter than ``LEAST`` cost infinity."""
    rows, n = x.shape
    if kernel:
        apart = (x[:, :, None] - x[:, None]) ** 2
        upper = np.triu_indices(n, 1)
        gram = np.exp(-np.clip(apart / np.maximum(np.median(apart[:, upper[0], upper[1]], axis=1), 1e-12)[:, None, None], 0, 100))
    else:
        gram = x[:, :, None] * x[:, None]
    block = np.zeros((rows, n + 1, n + 1))
    block[:, 1:, 1:] = gram.cumsum(1).cumsum(2)
    own = np.zeros((rows, n + 1))
    own[:, 1:] = np.diagonal(gram, axis1=1, axis2=2).cumsum(1)
    whole = np.diagonal(block, axis1=1, axis2=2)
    size = np.arange(n + 1)[None, :] - np.arange(n + 1)[:, None]
    cost = own[:, None, :] - own[:, :, None] - (whole[:, None, :] - 2 * block + whole[:, :, None]) / np.maximum(size, 1)
    cost[:, size < LEAST] = np.inf
    return cost


def optimal(cost: np.ndarray, penalties: Sequence[float]) -> np.ndarray:
    """``marks[row, penalty, month]``: first months of segments of the segmentation with least cost plus a penalty for each segment.

    The least cost with exactly k segments, for every k, is found once by dynamic programming; whichever the penalty, the
    best segmentation is one of these. Ties go to fewer segments.
    """
    rows, n = len(cost), cost.shape[1] - 1
    most = max(1, n // LEAST)
    least, origin = [cost[:, 0, :]], [np.zeros((rows, n + 1), int)]
    for _ in range(1, most):
        value = least[-1][:, :, None] + cost
        origin.append(value.argmin(axis=1))
        least.append(value.min(axis=1))
    total = np.stack([v[:, n] for v in least], 1)
    marks, every = np.zeros((rows, len(penalties), n), bool), np.arange(rows)
    for p, penalty in enumerate(penalties):
        left = (total + penalty * np.arange(1, most + 1)).argmin(axis=1)
        at = np.full(rows, n)
        for k in range(most - 1, 0, -1):
            on = left >= k
            at = np.where(on, origin[k][every, at], at)
            marks[every[on], p, at[on]] = True
    return marks


def split_greedily(cost: np.ndarray, penalties: Sequence[float]) -> np.ndarray:
    """Binary segmentation: the split that saves most, anywhere, until it saves no more than the penalty."""
    rows, n = len(cost), cost.shape[1] - 1
    every, month = np.arange(rows)[:, None], np.arange(n)[None]
    low, high = np.zeros((rows, n), int), np.full((rows, n), n)
    marks, smallest = np.zeros((rows, len(penalties), n), bool), np.full(rows, np.inf)
    for _ in range(n // LEAST):
        with np.errstate(invalid="ignore"):
            gain = cost[every, low, high] - (cost[every, low, month] + cost[every, month, high])
        gain[np.isnan(gain)] = -np.inf
        at = gain.argmax(axis=1)
        smallest = np.minimum(smallest, gain[np.arange(rows), at])
        on = np.isfinite(smallest)
        marks[every[on], np.arange(len(penalties))[None], at[on, None]] |= smallest[on, None] > np.array(penalties)[None]
        inside = on[:, None] & (low == low[np.arange(rows), at][:, None])
        low, high = np.where(inside & (month >= at[:, None]), at[:, None], low), np.where(inside & (month < at[:, None]), at[:, None], high)
    return marks


def merge_greedily(cost: np.ndarray, penalties: Sequence[float]) -> np.ndarray:
    """Bottom-up: from segments of ``LEAST`` months, the merge that costs least, anywhere, until it costs the penalty or more."""
    rows, n = len(cost), cost.shape[1] - 1
    cuts = np.array([*range(0, n - LEAST + 1, LEAST), n])
    before, after = np.tile(np.arange(len(cuts)) - 1, (rows, 1)), np.tile(np.arange(len(cuts)) + 1, (rows, 1))
    marks, largest, every = np.zeros((rows, len(penalties), n), bool), np.full(rows, -np.inf), np.arange(rows)
    marks[:, :, cuts[1:-1]] = True
    alive = np.ones((rows, len(cuts)), bool)
    alive[:, [0, -1]] = False
    inner = np.arange(1, len(cuts) - 1)
    for _ in inner:
        a, b = cuts[before[:, inner]], cuts[after[:, inner]]
        r = every[:, None]
        loss = np.where(alive[:, inner], cost[r, a, b] - cost[r, a, cuts[inner]] - cost[r, cuts[inner], b], np.inf)
        at = inner[loss.argmin(axis=1)]
        largest = np.maximum(largest, loss.min(axis=1))
        p, q = before[every, at], after[every, at]
        after[every, p], before[every, q], alive[every, at] = q, p, False
        gone = largest[:, None] < np.array(penalties)[None]
        marks[every, :, cuts[at]] &= ~gone
    return marks


def peaks(cost: np.ndarray, penalties: Sequence[float], width: int = WIDTH) -> np.ndarray:
    """Sliding window: months at which two halves of a window differ by more than the penalty, the largest first, others half a window apart."""
    rows, n = len(cost), cost.shape[1] - 1
    half = width // 2
    marks, every, gain = np.zeros((rows, len(penalties), n), bool), np.arange(rows), np.full((rows, n), -np.inf)
    for t in range(half, n - half + 1):
        if t < n:
            gain[:, t] = cost[:, t - half, t + half] - cost[:, t - half, t] - cost[:, t, t + half]
    for _ in range(n):
        at = gain.argmax(axis=1)
        best = gain[every, at]
        if not np.isfinite(best).any():
            break
        marks[every, :, at] |= best[:, None] > np.array(penalties)[None]
        gain[np.abs(np.arange(n)[None] - at[:, None]) < half] = -np.inf
    return marks


SEARCHES = {"pelt": optimal, "kernel": optimal, "binseg": split_greedily, "bottomup": merge_greedily, "window": peaks}


def search(method: str, x: np.ndarray, penalties: Sequence[float]) -> np.ndarray:
    """Marks ``[row, penalty, month]`` of standardised series, which are the rows of ``x``."""
    return SEARCHES[method](segment_costs(x, method == "kernel"), penalties)


def detect(rows: DataFrame, keys: list[str], value: str, penalties: Sequence[float] = PENALTIES, methods: Sequence[str] = METHODS) -> DataFrame:
    """``*keys, method, penalty, points``: first months of new regimes by each search at each penalty.

    Series are the unit of work. A search runs once over all series of the same length in an Arrow batch and gives the
    result for every penalty. Missing values count as 0; series of fewer than ``2 * LEAST`` months have no points.
    """
    series = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", F.coalesce(F.col(value), F.lit(0.0)).alias("v")))).alias("s")).select(*keys, F.col("s.v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(len(keys))
            sizes = np.array([len(v) for v in values], np.int64)
            for n in np.unique(sizes).tolist():
                who = np.flatnonzero(sizes == n)
                step = max(1, TABLE // (n + 1) ** 2)
                for at in range(0, len(who), step):
                    some = who[at : at + step]
                    x = values.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                    for m in methods:
                        marks = search(m, standardized(x), penalties) if n >= 2 * LEAST else np.zeros((len(some), len(penalties), n), bool)
                        flat = marks.reshape(-1, n)
                        ends = np.concatenate([[0], flat.sum(1).cumsum()])
                        points = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(flat)[1], pa.int32()))
                        owner = pa.array(np.repeat(some, len(penalties)))
                        out = [b.column(i).take(owner) for i in range(len(keys))] + [pa.array([m] * len(flat)), pa.array(np.tile(np.array(penalties), len(some))), points]
                        yield pa.RecordBatch.from_arrays(out, names=[*keys, "method", "penalty", "points"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return series.mapInArrow(run, f"{kinds}, method string, penalty double, points array<int>")


def calibrated(points: DataFrame, truth: DataFrame, keys: list[str], monitor: tuple[int, int], target: float = TARGET, tolerance: int = 1) -> DataFrame:
    """``method, penalty, recall, precision, F1, false_per100``: each method at the penalty whose rate of false points on series
    without a shock (``truth(*keys, onset)``, null onset) in monitored months is nearest to ``target`` in 100 months; the smaller of two.

    A shocked series is found by a point at most ``tolerance`` months from its onset; precision counts such series
    among all points of monitored months.
    """
    rows = points.join(truth, keys)
    found = F.size(F.filter("points", lambda p: p.between(*monitor)))
    hit = F.exists("points", lambda p: F.abs(p - F.col("onset")) <= tolerance)
    clean, shocked, months = F.col("onset").isNull(), F.col("onset").isNotNull(), monitor[1] - monitor[0] + 1
    per = rows.groupBy("method", "penalty").agg(
        (100 * F.sum(F.when(clean, found)) / (F.count(F.when(clean, 1)) * months)).alias("false_per100"),
        F.avg(F.when(shocked, hit.cast("int"))).alias("recall"),
        (F.sum(F.when(shocked, hit.cast("int"))) / F.greatest(F.sum(found), F.lit(1))).alias("precision"),
    )
    per = per.withColumn("F1", 2 * F.col("recall") * F.col("precision") / F.greatest(F.col("recall") + F.col("precision"), F.lit(1e-9)))
    names = ("penalty", "recall", "precision", "F1", "false_per100")
    best = F.min_by(F.struct(*names), F.struct(F.abs(F.col("false_per100") - target), F.col("penalty"))).alias("b")
    return per.groupBy("method").agg(best).select("method", *[F.col(f"b.{c}").alias(c) for c in names])
