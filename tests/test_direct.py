import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import direct
from tessera.operators.features import FEATURES
from tessera.plans import analytics

SF = "/root/testdata/sf0.01"


def test_weighted_medians():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(1, 40)
        v, w, g = np.round(rng.normal(size=n), 1), rng.random(n) + 0.01, rng.integers(0, 4, n)
        got = direct.weighted_medians(v, w, g, 5)
        for k in range(5):
            own = sorted(zip(v[g == k], w[g == k]))
            run, want = 0.0, 0.0
            for x, y in own:
                run += y
                if run >= w[g == k].sum() / 2 - 1e-12:
                    want = x
                    break
            assert got[k] == pytest.approx(want)


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(2)
    x = np.where(rng.random((300, 3)) < 0.1, np.nan, rng.normal(size=(300, 3)))
    y, w = np.where(np.nan_to_num(x[:, 1]) > 0.3, 2.0, -1.0) + rng.normal(0, 0.1, 300), rng.random(300) + 0.5
    m = direct.fit(x, y, w, rounds=1)
    codes, g = direct.codes_of(x, m["edges"]), w * np.sign(y - m["base"])
    best = (-1.0,)
    for f in range(3):
        for k in range(direct.BINS - 1):
            left = codes[:, f] <= k
            if min(left.sum(), (~left).sum()) >= direct.LEAF_ROWS:
                part = lambda a: g[a].sum() ** 2 / (w[a].sum() + direct.RIDGE)
                score = part(left) + part(~left) - part(np.ones(300, bool))
                best = max(best, (score, f, k), key=lambda b: b[0])
    assert (m["feature"][0, 0], m["cut"][0, 0]) == best[1:]
    assert m["feature"][0, 0] == 1


def test_trees_reduce_the_absolute_error():
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(2000, 5)), np.ones(2000)
    y = np.abs(x[:, 0]) + np.where(x[:, 2] > 0, x[:, 3], 0) + rng.normal(0, 0.1, 2000)
    m = direct.fit(x[:1500], y[:1500], w[:1500])
    error = np.abs(direct.predict(m, x[1500:]) - y[1500:]).mean()
    assert error < 0.5 * np.abs(np.median(y[:1500]) - y[1500:]).mean()
    assert direct.fit(x[:3], y[:3], w[:3])["feature"].max() == -1


@pytest.fixture(scope="module")
def pairs(spark):
    return analytics._pairs(spark, SF)


def test_every_origin_equals_a_plain_fit(spark, pairs):
    """The query's forecasts of two origins, from a single fit on the pairs that were known by then."""
    got = {(r.territory_id, r.category, r.o, r.h): r.f for r in analytics.boosted_direct(spark, SF).collect()}
    assert {k[2] for k in got} == set(analytics.ORIGINS) and {k[3] for k in got} == set(range(1, 13))
    luck = direct.draw(F.lit("pair"), *[F.col(c) for c in ("territory_id", "category", "o", "h")])
    all_rows = pairs.withColumn("luck", luck).toPandas()
    for origin in (7, 18):
        some = all_rows[(all_rows["t"] <= origin) & (all_rows["o"] >= 2) & all_rows["y_target"].notna()].sort_values(["luck", "y_target"])
        assert (some["o"] + some["h"] <= origin).all() and len(some)
        pick = lambda d: d[list(FEATURES)].to_numpy(float)
        m = direct.fit(pick(some), some["y_target"].to_numpy(), np.exp(some["ly0"].to_numpy(float)))
        own = all_rows[(all_rows["o"] == origin)]
        for k, f in zip(own[["territory_id", "category", "o", "h"]].itertuples(index=False), own["d_l0"] + direct.predict(m, pick(own)), strict=True):
            if tuple(k) in got:
                assert got[tuple(k)] == pytest.approx(f, abs=1e-6)


def test_models_see_no_future_and_no_more_rows_than_asked(spark, pairs):
    held = lambda df, **k: {r.origin: (r.n_rows, {n: v.tolist() for n, v in np.load(io.BytesIO(r.model)).items()}) for r in direct.models(df, [9, 14], rounds=3, **k).collect()}
    changed = pairs.withColumn("y_target", F.when(F.col("t") <= 9, F.col("y_target")).otherwise(F.rand(1)))
    a, b = held(pairs), held(changed)
    assert a[9] == b[9] and a[14] != b[14]
    fewer = held(pairs, max_rows=500)
    assert all(350 < n < 650 for n, _ in fewer.values()) and held(pairs, max_rows=500)[9] == fewer[9]


def test_importance_is_the_mean_over_origins(spark):
    rows = spark.createDataFrame([(1, [2.0, 0.0]), (2, [4.0, 8.0])], "origin int, gain array<double>")
    assert [(r.feature, r.gain, r["rank"]) for r in direct.importance(rows, ("a", "b")).orderBy("rank").collect()] == [("b", 4.0, 1), ("a", 3.0, 2)]
