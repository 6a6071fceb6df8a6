"""A direct model of the change from origin to target, retrained at every origin on pairs whose target was known by then."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import draw
from tessera.operators.features import FEATURES
from tessera.operators.panel import SERIES

#: Bins of a feature, trees, levels of a tree, step, least weightless rows of a leaf, ridge on leaf scores.
BINS, ROUNDS, DEPTH, RATE, LEAF_ROWS, RIDGE = 32, 60, 4, 0.1, 20, 1.0
#: Training rows of an origin (about): a task holds no more, whatever the number of series.
MAX_ROWS = 1_000_000


def edges_of(x: np.ndarray) -> np.ndarray:
    """``edges[feature, BINS - 2]``: quantiles between bins; missing values have a bin of their own."""
    with np.errstate(all="ignore"):
        e = np.nanquantile(np.where(np.isnan(x).all(axis=0), 0.0, x), np.linspace(0, 1, BINS)[1:-1], axis=0).T
    return np.ascontiguousarray(e)


def codes_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, np.int64)
    for f in range(x.shape[1]):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(edges[f], x[:, f], "left"))
    return out


def weighted_medians(value: np.ndarray, weight: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The least value of each group at which half of the group's weight is reached; 0 for empty groups."""
    order = np.lexsort((value, group))
    total = np.bincount(group, weight, groups)
    reached = np.cumsum(weight[order]) - np.concatenate([[0.0], np.cumsum(total)[:-1]])[group[order]]
    half = np.flatnonzero(reached >= total[group[order]] / 2 - 1e-12 * total[group[order]])
    out = np.zeros(groups)
    found, first = np.unique(group[order][half], return_index=True)
    out[found] = value[order][half[first]]
    return out


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Boosted trees for weighted absolute errors, by histograms: splits by the signs of residuals, leaves by their weighted median.

    ``feature, cut`` have a row a tree and a node an entry, in the order of levels (feature -1: all go left); ``leaf`` a row
    a tree; ``gain`` sums what each feature's splits gained.
    """
    n, width = x.shape
    edges = edges_of(x)
    codes = codes_of(x, edges)
    base = weighted_medians(y, w, np.zeros(n, int), 1)[0]
    now, gain = np.full(n, base), np.zeros(width)
    feature, cut, leaf = np.full((rounds, 2**DEPTH - 1), -1), np.zeros((rounds, 2**DEPTH - 1), int), np.zeros((rounds, 2**DEPTH))
    for r in range(rounds):
        g, node = w * np.sign(y - now), np.zeros(n, int)
        for level in range(DEPTH):
            many, start = 2**level, 2**level - 1
            best, at = np.zeros(many), np.full((many, 2), -1)
            for f in range(width):
                place = node * BINS + codes[:, f]
                sums = [np.bincount(place, v, many * BINS).reshape(many, BINS).cumsum(axis=1) for v in (g, w, np.ones(n))]
                (gl, wl, nl), (gt, wt, nt) = [s[:, :-1] for s in sums], [s[:, -1:] for s in sums]
                score = gl**2 / (wl + RIDGE) + (gt - gl) ** 2 / (wt - wl + RIDGE) - gt**2 / (wt + RIDGE)
                score = np.where((nl >= LEAF_ROWS) & (nt - nl >= LEAF_ROWS), score, -np.inf)
                k = score.argmax(axis=1)
                top = score[np.arange(many), k]
                better = top > best + 1e-12
                best, at[better] = np.where(better, top, best), np.stack([np.full(many, f), k], 1)[better]
            feature[r, start : start + many], cut[r, start : start + many] = at[:, 0], at[:, 1]
            np.add.at(gain, at[at[:, 0] >= 0, 0], best[at[:, 0] >= 0])
            node = 2 * node + _goes_right(codes, at[node, 0], at[node, 1])
        leaf[r] = RATE * weighted_medians(y - now, w, node, 2**DEPTH)
        now += leaf[r][node]
    return {"edges": edges, "base": np.array(base), "feature": feature, "cut": cut, "leaf": leaf, "gain": gain}


def _goes_right(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return ((feature >= 0) & (codes[np.arange(len(codes)), np.maximum(feature, 0)] > cut)).astype(int)


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    codes, out = codes_of(x, model["edges"]), np.full(len(x), float(model["base"]))
    for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"], strict=True):
        node = np.zeros(len(x), int)
        for level in range(DEPTH):
            at = 2**level - 1 + node
            node = 2 * node + _goes_right(codes, feature[at], cut[at])
        out += leaf[node]
    return out


def models(rows: DataFrame, origins: Sequence[int], *, min_origin: int = 2, max_rows: int = MAX_ROWS, rounds: int = ROUNDS, columns: Sequence[str] = FEATURES) -> DataFrame:
    """``origin, n_rows, model, gain``: one model an origin, fitted in a task of its own.

    ``rows`` (of ``features``, stored: it is read twice) holds each pair (o', h') once. A pair teaches all origins from its target's month on;
    it is sent to those for which its draw is below the origin's share, so that an origin gets about ``max_rows`` of
    its pairs, the same ones in every run, and nothing else is shuffled. Weights are exp(ly0).
    """
    known = rows.where(F.col("y_target").isNotNull() & (F.col("o") >= min_origin) & (F.col("t") <= max(origins)))
    sizes = {r["t"]: r["n"] for r in known.groupBy("t").agg(F.count("*").alias("n")).collect()}  # a row a month
    share = {o: min(1.0, max_rows / max(1, sum(n for t, n in sizes.items() if t <= o))) for o in origins}
    shares = F.array(*[F.struct(F.lit(int(o)).alias("origin"), F.lit(int(share[o] * (1 << 32))).alias("bound")) for o in origins])
    luck = draw(F.lit("pair"), *[F.col(c) for c in (*SERIES, "o", "h")])
    named = [F.col(c).cast("double").alias(c) for c in columns]
    pairs = known.select("t", luck.alias("luck"), F.col("y_target").alias("y"), F.exp(F.coalesce("ly0", F.lit(0.0))).alias("w"), F.array(*named).alias("x"))
    taught = pairs.select(F.explode(F.filter(shares, lambda s: (s["origin"] >= F.col("t")) & (F.col("luck") < s["bound"]))).alias("s"), "luck", "y", "w", "x").select("s.origin", "luck", "y", "w", "x")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("luck", "ascending"), ("y", "ascending"), ("w", "ascending")])
        x = np.array(table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(table.num_rows, -1)
        model = fit(x, table["y"].to_numpy(), table["w"].to_numpy(), rounds)
        held = io.BytesIO()
        np.savez(held, **model)
        return pa.table({"origin": table["origin"][:1], "n_rows": pa.array([table.num_rows], pa.int64()), "model": pa.array([held.getvalue()], pa.binary()), "gain": pa.array([model["gain"].tolist()], pa.list_(pa.float64()))})

    return taught.repartition(len(origins), "origin").groupBy("origin").applyInArrow(run, "origin int, n_rows long, model binary, gain array<double>")


def forecast(rows: DataFrame, fitted: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """``territory_id, category, o, h, t, f``: d[o] plus the predicted change, for pairs whose origin has a model.

    Models are broadcast: their size depends on trees and origins only.
    """
    shared = rows.sparkSession.sparkContext.broadcast({r["origin"]: r["model"] for r in fitted.select("origin", "model").collect()})
    wanted = rows.where(F.col("o").isin(sorted(shared.value))).select(*SERIES, "o", "h", "t", "d_l0", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        for b in batches:
            o = b.column(2).to_numpy()
            x = np.array(b.column(6).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
            out = np.array(b.column(5).to_numpy(zero_copy_only=False), float)
            for origin in np.unique(o).tolist():
                if origin not in held:
                    held[origin] = dict(np.load(io.BytesIO(shared.value[origin])))
                who = np.flatnonzero(o == origin)
                out[who] += predict(held[origin], x[who])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(out, from_pandas=True)], names=[*SERIES, "o", "h", "t", "f"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in SERIES)
    return wanted.mapInArrow(run, f"{kinds}, o int, h int, t int, f double")


def importance(fitted: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """``feature, gain, rank``: mean gain of each feature over origins, largest first."""
    from pyspark.sql.window import Window

    named = fitted.select(F.explode(F.arrays_zip(F.array(*map(F.lit, columns)).alias("feature"), F.col("gain").alias("gain"))).alias("e"))
    means = named.groupBy("e.feature").agg(F.avg("e.gain").alias("gain"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gain"), "feature")))
