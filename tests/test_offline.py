import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import offline
from tessera.plans import analytics
from tests import oracle

SF = "/root/testdata/sf0.01"


def segmentations(n, least=offline.LEAST):
    """All ways to cut n months into segments of at least ``least``."""
    if n == 0:
        return [[]]
    return [[*rest, n] for k in range(least, n + 1) for rest in segmentations(n - k, least)] if n >= least else []


def plain_cost(x, kernel):
    n = len(x)
    d = (x[:, None] - x[None]) ** 2
    g = np.exp(-np.clip(d / max(np.median(d[np.triu_indices(n, 1)]), 1e-12), 0, 100)) if kernel else np.outer(x, x)
    return lambda a, b: np.trace(g[a:b, a:b]) - g[a:b, a:b].sum() / (b - a)


def plain_greedy(method, cost, n, pen):
    if method == "binseg":
        cuts = [0, n]
        while True:
            tries = [(cost(a, b) - cost(a, k) - cost(k, b), -k) for a, b in zip(cuts, cuts[1:]) for k in range(a + 2, b - 1)]
            if not tries or max(tries)[0] <= pen:
                return cuts[1:-1]
            cuts = sorted([*cuts, -max(tries)[1]])
    if method == "bottomup":
        cuts = [*range(0, n - 1, 2), n]
        while len(cuts) > 2:
            loss, k = min((cost(cuts[k - 1], cuts[k + 1]) - cost(cuts[k - 1], cuts[k]) - cost(cuts[k], cuts[k + 1]), k) for k in range(1, len(cuts) - 1))
            if loss >= pen:
                break
            cuts.pop(k)
        return cuts[1:-1]
    gain, out = {t: cost(t - 3, t + 3) - cost(t - 3, t) - cost(t, t + 3) for t in range(3, n - 2)}, []
    for t in sorted(gain, key=lambda t: (-gain[t], t)):
        if gain[t] > pen and all(abs(t - s) >= 3 for s in out):
            out.append(t)
    return sorted(out)


def series(rng, n):
    x = rng.normal(size=n) + sum(np.where(np.arange(n) >= rng.integers(1, n), rng.normal(0, 3), 0) for _ in range(2))
    return np.round(x, 1) if rng.random() < 0.3 else x


@pytest.mark.parametrize("method", ["pelt", "kernel"])
def test_optimal_search_equals_all_segmentations(method):
    """Thousands of series, every penalty: no segmentation costs less."""
    rng = np.random.default_rng(4)
    for n in (4, 5, 9, 13):
        x = np.stack([series(rng, n) for _ in range(400)])
        marks, cost = offline.search(method, x, offline.PENALTIES), offline.segment_costs(x, method == "kernel")
        ways = [[0, *w] for w in segmentations(n)]
        totals = np.stack([sum(cost[:, a, b] for a, b in zip(w, w[1:], strict=False)) for w in ways], 1)
        for p, pen in enumerate(offline.PENALTIES):
            best = (totals + pen * np.array([len(w) - 1 for w in ways])).min(axis=1)
            for i in range(len(x)):
                w = [0, *np.flatnonzero(marks[i, p]).tolist(), n]
                assert sum(cost[i, a, b] for a, b in zip(w, w[1:], strict=False)) + pen * (len(w) - 1) == pytest.approx(best[i], abs=1e-9)
        f = plain_cost(x[0], method == "kernel")
        assert all(cost[0, a, b] == pytest.approx(f(a, b), abs=1e-9) for a in range(n) for b in range(a + 2, n + 1))


@pytest.mark.parametrize("method", ["binseg", "bottomup", "window"])
def test_greedy_searches_equal_plain_loops(method):
    rng = np.random.default_rng(5)
    for n in (6, 7, 12, 24, 31):
        x = np.stack([rng.normal(size=n) + np.where(np.arange(n) >= rng.integers(1, n), 3, 0) for _ in range(150)])
        marks = offline.search(method, x, offline.PENALTIES)
        for i, row in enumerate(x):
            for p, pen in enumerate(offline.PENALTIES):
                assert np.flatnonzero(marks[i, p]).tolist() == plain_greedy(method, plain_cost(row, False), n, pen)


@pytest.mark.parametrize("method", offline.METHODS)
def test_all_searches_find_a_clear_break(method):
    x = np.concatenate([np.zeros(12), np.full(12, 6.0)]) + np.random.default_rng(0).normal(0, 0.3, 24)
    assert offline.search(method, x[None], [1.5 if method == "kernel" else 8.0])[0, 0, 12]


def test_series_of_all_lengths(spark, monkeypatch):
    monkeypatch.setattr(offline, "TABLE", 500)
    rows = [(k, t, None if t == 2 else float(t > n // 2) * 9) for k, n in enumerate([1, 3, 4, 10, 10, 11, 10]) for t in range(n)]
    got = offline.detect(spark.createDataFrame(rows, "k int, t int, v double"), ["k"], "v", (1.0, 3.0)).collect()
    assert len(got) == 7 * 2 * 5 and all(not r.points for r in got if r.k < 2)
    assert {tuple(r.points) for r in got if r.k in (3, 4, 6) and r.method == "pelt"} == {(6,)}


def test_calibration_of_the_query(spark):
    """Scores of the query, from its own points by plain loops, and the points of one search from all segmentations."""
    from tessera.operators import synthetic
    from tessera.plans.detection import KEYS, deviations

    d = deviations(spark, SF)
    scen = synthetic.scenarios(spark, ("series",), ("step",), (0.1,), 1)
    rows = synthetic.inject(d, scen, synthetic.shocks(d.select("territory_id").distinct(), scen, frac=0.5)).toPandas().sort_values([*KEYS, "t"])
    x, onset = zip(*((g["d"].fillna(0).to_numpy(), g["onset"].iloc[0]) for _, g in rows.groupby(KEYS)), strict=True)
    x, onset = offline.standardized(np.stack(x)), np.array([np.nan if o is None else o for o in onset], float)
    shocked = ~np.isnan(onset)
    assert 0 < shocked.sum() < len(onset)
    got = {r.method: r for r in analytics.offline_scores(spark, SF).collect()}
    assert set(got) == set(offline.METHODS)
    for m in offline.METHODS:
        best = None
        for p, pen in enumerate(offline.PENALTIES):
            points = [np.flatnonzero(v[p]) for v in offline.search(m, x, offline.PENALTIES)]
            late = np.array([((v >= 12) & (v <= 23)).sum() for v in points])
            rate = 100 * late[~shocked].sum() / ((~shocked).sum() * 12)
            hits = sum((np.abs(v - o) <= 1).any() for v, o in zip(points, onset, strict=True) if o == o)
            if best is None or abs(rate - 3) < abs(best[1] - 3):
                best = (pen, rate, hits / shocked.sum(), hits / max(late.sum(), 1))
        r = got[m]
        assert (r.penalty, r.false_per100, r.recall, r.precision) == pytest.approx(best, abs=1e-6)


def test_optimal_query_equals_recursive_sql(spark):
    df = analytics.offline_optimal(spark, SF)
    oracle.same(df.collect(), df.columns, oracle.connect(SF).sql(analytics.ORACLE["offline_optimal"]))
    assert df.where(F.col("n_points") > 0).count() > 0
