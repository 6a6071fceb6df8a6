import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.operators import ensemble, metrics
from tessera.operators import forecast as fc
from tessera.operators import panel as pn

MONTHS = 24


@pytest.fixture(scope="module")
def facts(spark):
    """Five full territories and one with gaps, six categories."""
    rng = np.random.default_rng(3)
    rows = []
    for s in range(6):
        for c, name in enumerate(DEFAULT.panel.categories):
            for t in range(MONTHS):
                if s == 5 and t % 7 == 3:
                    continue
                rows.append((s, name, f"{1998 + t // 12}-{t % 12 + 1:02d}-01", float(np.exp(10 + c + 0.02 * t + rng.normal(0, 0.1)))))
    return spark.createDataFrame(rows, "territory_id int, category string, month string, y double").withColumn("month", F.col("month").cast("date"))


def wide(df, value):
    p = df.toPandas().pivot(index=["territory_id", "cat_idx"], columns="t", values=value).sort_index()
    return p.index, p.to_numpy(float)


def test_panel_is_dense_and_knows_full_territories(facts):
    p = pn.panel(facts)
    assert p.count() == 6 * 6 * MONTHS
    assert {r[0] for r in p.where("is_full").select("territory_id").distinct().collect()} == set(range(5))
    assert p.where("y is null").count() == 6 * 3


def test_nan_is_missing(spark, facts):
    bad = facts.withColumn("y", F.when((F.col("territory_id") == 0) & (F.col("month") == "1998-05-01"), float("nan")).otherwise(F.col("y")))
    p = pn.panel(bad)
    assert p.where("territory_id = 0 and t = 4 and y is null").count() == 6
    assert p.where("isnan(y)").count() == 0


def test_decompose_is_the_cross_sectional_median_of_full_territories(facts):
    d = pn.decompose(pn.panel(facts)).cache()
    index, ly = wide(d, "ly")
    _, dev = wide(d, "d")
    full = np.array([i[0] < 5 for i in index])
    for c in range(6):
        rows = np.array([i[1] == c for i in index])
        n = np.median(ly[rows & full], axis=0)
        assert np.allclose(dev[rows], ly[rows] - n, equal_nan=True)


def by_hand(x, name):
    """Forecasters by definition; x is one series' history."""
    ok = x[np.isfinite(x)]
    last, m3, t = ok[-1], np.nanmean(x[-3:]) if np.isfinite(x[-3:]).any() else ok[-1], len(x)
    season = np.array([x[t - 1 + h - 12] if t - 1 + h - 12 >= 0 else np.nan for h in range(1, 13)])
    if name == "naive":
        return np.full(12, last)
    if name == "mean3":
        return np.full(12, m3)
    if name == "seasonal_naive":
        return season
    if name == "snaive_growth":
        k = t // 2
        g = x[-1] - x[-13] if t >= 13 else 12 / k * (np.nanmean(x[-k:]) - np.nanmean(x[:k]))
        return season + g
    if name == "ses":
        level = ok[0]
        for v in ok[1:]:
            level = 0.5 * v + 0.5 * level
        return np.full(12, level)
    return m3 + 0.3 * np.nan_to_num(season - np.nanmean(x[-12:]))


@pytest.mark.parametrize("name", ["naive", "mean3", "seasonal_naive", "snaive_growth", "ses", "level_season"])
def test_forecasters_match_their_definitions(spark, facts, name):
    d = pn.decompose(pn.panel(facts)).cache()
    index, x = wide(d, "d")
    at = {k: i for i, k in enumerate(index)}
    for r in fc.forecast(fc.states(d), pn.grid(spark), (name,)).collect():
        want = by_hand(x[at[r.territory_id, r.cat_idx]][: r.o + 1], name)[r.h - 1]
        assert (r.f is None and not np.isfinite(want)) or r.f == pytest.approx(want, abs=1e-9)


def test_no_forecast_sees_the_future(spark, facts):
    """Noise put on months after the origin changes nothing."""
    p = pn.panel(facts)
    d = pn.decompose(p).select("territory_id", "category", "cat_idx", "t", "d")
    noisy = d.withColumn("d", F.when(F.col("t") > 14, F.randn(1)).otherwise(F.col("d")))
    names = tuple(fc.MODELS)
    one, two = ({(r.model, r.territory_id, r.category, r.h): r.f for r in fc.forecast(fc.states(x), pn.grid(spark).where("o = 14"), names).collect()} for x in (d, noisy))
    assert one == two


def test_national_forecasts_respect_publication(spark, facts):
    n = pn.national(pn.panel(facts)).cache()
    pub = n.select("category", "t", F.col("n").alias("l")).unionByName(n.select("category", (F.col("t") - 24).alias("t"), F.col("n").alias("l")))
    grid = pn.grid(spark).where("o = 15")
    for method in ("snaive_own", "snaive_nat", "nat_profile", "nat_profile_g"):
        noisy = pub.withColumn("l", F.when(F.col("t") > 15 - DEFAULT.national.lag, F.randn(2)).otherwise(F.col("l")))
        late = n.withColumn("n", F.when(F.col("t") > 15, F.randn(2)).otherwise(F.col("n")))
        a = {(r.category, r.h): r.nhat for r in fc.national_forecast(n, pub, grid, method).collect()}
        b = {(r.category, r.h): r.nhat for r in fc.national_forecast(late, noisy, grid, method).collect()}
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([("a", 10.0, 12.0, 8.0), ("a", 20.0, 18.0, 10.0), ("a", 30.0, 33.0, 0.0), ("a", None, 1.0, 1.0)], "k string, y double, yhat double, ylag double")
    r = metrics.metrics(rows, ["k"]).first()
    y, f = np.array([10.0, 20, 30]), np.array([12.0, 18, 33])
    assert r.n == 3 and r.MAE == pytest.approx(7 / 3) and r.WAPE == pytest.approx(7 / 60)
    assert r.R2 == pytest.approx(1 - ((y - f) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    g, gp = np.log([10 / 8, 2.0]), np.log([12 / 8, 1.8])
    assert r.R2_yoy == pytest.approx(1 - ((g - gp) ** 2).sum() / ((g - g.mean()) ** 2).sum())


def test_ensemble_prefers_the_better_model_and_sums_to_one(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(60):
        for h in (1, 4, 8):
            ly = rng.normal(5, 1)
            for m, noise in (("good", 0.02), ("bad", 0.3)):
                rows.append((m, s, "c", 10, h, 10 + h, "val", {1: 0, 4: 1, 8: 2}[h], ly + rng.normal(0, noise), float(np.exp(ly)), None))
    f = spark.createDataFrame(rows, "model string, territory_id int, category string, o int, h int, t int, split string, h_group int, lf double, y double, ylag double")
    w = ensemble.choose(f.withColumn("variant", F.lit("v")), ["good", "bad"], {"both": ("v", ["good", "bad"]), "one": ("v", ["bad"])}, additions=8)
    got = {(r.pool, r.h_group, r.model): r.weight for r in w.collect()}
    for g in (0, 1, 2):
        assert got["both", g, "good"] + got.get(("both", g, "bad"), 0) == pytest.approx(1) and got["both", g, "good"] > 0.8
        assert got["one", g, "bad"] == 1 and ("one", g, "good") not in got
    assert ensemble.apply(f, w.where("pool = 'both'").drop("pool")).count() == 180


def test_ensemble_equals_a_plain_loop(spark):
    """Every step, pool and shrinkage by brute force; the cells of a pool need its own members only."""
    rng, models = np.random.default_rng(8), ["a", "b", "c", "d"]
    rows, held = [], {}
    for s in range(40):
        for h, g in ((1, 0), (4, 1)):
            ly = rng.normal(3, 1)
            p = [ly + rng.normal(b, 0.2) if rng.random() > 0.1 else None for b in (0.1, -0.1, 0.3, 0.02)]
            held[s, h] = (g, float(np.exp(ly)), p)
            rows += [("v", m, s, "c", 10, h, 10 + h, "val", g, v, float(np.exp(ly))) for m, v in zip(models, p, strict=True)]
    f = spark.createDataFrame(rows, "variant string, model string, territory_id int, category string, o int, h int, t int, split string, h_group int, lf double, y double")
    pools = {"all": ("v", models), "few": ("v", ["c", "a"])}
    got = {(r.pool, r.h_group, r.model): (r.weight, r.shrinkage) for r in ensemble.choose(f, models, pools, additions=7).collect()}
    want = {}
    for name, (_, members) in pools.items():
        on = [models.index(m) for m in models if m in members]
        for g in (0, 1):
            some = [(y, p) for k, y, p in held.values() if k == g and all(p[i] is not None for i in on)]
            error = lambda w: round(float(np.mean([abs(y - np.exp(sum(w[i] * p[i] for i in on))) for y, p in some])), 9)  # noqa: B023, E731
            taken = dict.fromkeys(on, 0)
            for r in range(1, 8):
                taken[min(on, key=lambda i: (error({j: (taken[j] + (i == j)) / r for j in on}), i))] += 1  # noqa: B023
            tried = {s: {i: (1 - s) * taken[i] / 7 + s / len(on) for i in on} for s in ensemble.SHRINKAGES}
            s = min(tried, key=lambda s: (error(tried[s]), s))  # noqa: B023
            want.update({(name, g, models[i]): (pytest.approx(x), s) for i, x in tried[s].items() if x > 0})
    assert got == want


def test_guard_replaces_only_what_leaves_the_history(spark, facts):
    p = pn.panel(facts).where("territory_id = 0 and cat_idx = 0")
    last = p.where("t = 15").first().ly
    f = spark.createDataFrame([(0, "ALL", 15, 1, last + 5.0), (0, "ALL", 15, 2, last)], "territory_id int, category string, o int, h int, lf double")
    out = {r.h: (r.replaced, r.lf) for r in fc.guard(f, p).collect()}
    assert out[1] == (True, pytest.approx(last)) and out[2] == (False, pytest.approx(last))
