import datetime as dt
import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.operators import news as nw
from tessera.operators import plugins
from tessera.sources import envelope, portal
from tessera.sources import tables as tb
from tessera.streaming import online

EVENTS = "event_id int, date date, types array<string>, territory_ids array<int>, region_codes array<int>"


@pytest.fixture(scope="module")
def regions(spark):
    return spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "territory_id int, region_code int")


def exposure(spark, regions, *events):
    df = spark.createDataFrame([(i, dt.date.fromisoformat(d), t, ids, reg) for i, (d, t, ids, reg) in enumerate(events)], EVENTS)
    return {(r.territory_id, r.type, str(r.month)[:7]): r.exposure for r in nw.monthly_exposure(df, regions).collect()}


def test_exposure_starts_at_publication_and_decays(spark, regions):
    x = exposure(spark, regions, ("2024-03-20", ["emergency"], [10], []))
    assert x == {(10, "emergency", m): pytest.approx(v) for m, v in (("2024-03", 12 / 31), ("2024-04", 1.0), ("2024-05", 0.5), ("2024-06", 0.25))}


def test_a_region_counts_less_for_each_of_its_territories(spark, regions):
    x = exposure(spark, regions, ("2024-03-20", ["emergency"], [], [1]))
    assert x[10, "emergency", "2024-04"] == x[11, "emergency", "2024-04"] == pytest.approx(0.3) and not any(k[0] == 20 for k in x)


def test_a_place_and_its_region_are_one_event(spark, regions):
    x = exposure(spark, regions, ("2024-03-20", ["emergency"], [10], [1]))
    assert x[10, "emergency", "2024-04"] == pytest.approx(1.0) and x[11, "emergency", "2024-04"] == pytest.approx(0.3)


def test_hazard_multiplier_is_capped(spark, regions):
    df = spark.createDataFrame([(i, dt.date(2024, 3, 1), ["emergency"], [10], []) for i in range(3)], EVENTS)
    panel = spark.createDataFrame([(10, dt.date(2024, m, 1)) for m in (2, 3, 4)] + [(20, dt.date(2024, 4, 1))], "territory_id int, month date")
    got = {(r.territory_id, r.month.month): r.mult for r in nw.hazard_multiplier(panel, nw.monthly_exposure(df, regions)).collect()}
    assert got == {(10, 2): 1.0, (10, 3): 9.0, (10, 4): 9.0, (20, 4): 1.0}
    other = spark.createDataFrame([(1, dt.date(2024, 3, 1), ["economy"], [10], [])], EVENTS)
    assert {r.mult for r in nw.hazard_multiplier(panel, nw.monthly_exposure(other, regions)).collect()} == {1.0}


def test_types_and_homonyms(spark):
    docs = spark.createDataFrame([(1, "A flood, and a power cut!"), (2, "Springfield in Ohio."), (3, "Springfield again"), (4, None)], "id int, text string")
    got = {r.id: r.t for r in docs.select("id", nw.typed(F.col("text"), {"emergency": ("flood",), "utility": ("power cut",)}).alias("t")).collect()}
    assert got[1] == ["emergency", "utility"] and got[2] == [] and not got[4]
    gaz = spark.createDataFrame([("springfield", 1, 5), ("springfield", 2, 6), ("ohio", None, 5)], "term string, territory_id int, region_code int")
    out = {tuple(r) for r in nw.geocode(docs, gaz, "id", "text").collect()}
    assert out == {(2, 1, 5)}


def test_tests_against_known_values(spark):
    assert stats.student_sf(2.0, 10) == pytest.approx(0.036694, abs=1e-6)
    signs = spark.createDataFrame([(6, 6), (3, 6), (0, 0), (0, 6), (9, 40)], "k long, n long")
    got = [r.p for r in signs.select(stats.sign_test(F.col("k"), F.col("n")).alias("p")).collect()]
    want = [2 * sum(math.comb(40, i) for i in range(10)) / 2**40]
    assert got == [pytest.approx(0.03125), 1.0, None, pytest.approx(0.03125), pytest.approx(want[0])]
    tails = spark.createDataFrame([(t, df) for t in (0.0, 0.7, -2.5, 9.0) for df in range(1, 13)], "t double, df int")
    for r in tails.withColumn("p", stats.student_two_sided(F.col("t"), F.col("df"))).collect():
        assert r.p == pytest.approx(2 * stats.student_sf(abs(r.t), r.df), abs=1e-9), r


def test_diebold_mariano(spark):
    """Against the formula written out; null for short or constant losses."""
    rng = np.random.default_rng(0)
    series = {1: (rng.normal(0, 1, 60), 1), 2: (rng.normal(1, 1, 60), 1), 3: (rng.normal(0.3, 1, 12), 3), 4: (rng.normal(0, 1, 4), 12), 5: (np.zeros(2), 1), 6: (np.zeros(9), 1)}
    rows = [(k, t, float(v), h) for k, (x, h) in series.items() for t, v in enumerate(x)]
    got = {r.k: r for r in stats.diebold_mariano(spark.createDataFrame(rows, "k int, t int, d double, h int"), ["k"], "t", "d", "h").collect()}
    for k, (x, h) in series.items():
        n = len(x)
        if n < 3 or not x.any():
            assert got[k].dm_stat is None and got[k].dm_p is None
            continue
        m = min(h, n - 1)
        gamma = [sum((x[i] - x.mean()) * (x[i + j] - x.mean()) for i in range(n - j)) / (n - j) for j in range(m)]
        var = (gamma[0] + sum(2 * (m - j) / m * gamma[j] for j in range(1, m))) / n
        if var <= 0:
            assert got[k].dm_stat is None
            continue
        stat = x.mean() / var**0.5 * max((n + 1 - 2 * m + m * (m - 1) / n) / n, 1e-9) ** 0.5
        assert got[k].dm_stat == pytest.approx(stat) and got[k].dm_p == pytest.approx(2 * stats.student_sf(abs(stat), n - 1), abs=1e-9)
    assert got[1].dm_p > 0.01 and got[2].dm_p < 0.001


def test_rank_tests(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=60), 1)
    rows = spark.createDataFrame([(i < 25, float(x)) for i, x in enumerate(v)], "a boolean, v double").withColumn("k", F.lit(1))
    u = sum((x > y) + 0.5 * (x == y) for x in v[:25] for y in v[25:])
    assert stats.mann_whitney(rows, ["k"], "a", "v").first().U == pytest.approx(u)
    w = stats.wilcoxon(rows, ["k"], "v").first()
    some = v[v != 0]
    rank = np.array([(np.abs(some) < abs(x)).sum() + ((np.abs(some) == abs(x)).sum() + 1) / 2 for x in some])
    assert w.W == pytest.approx(rank[some > 0].sum())
    adj = {r.p: r.p_holm for r in stats.holm(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p double"), "p").collect()}
    assert adj == {0.01: pytest.approx(0.04), 0.03: pytest.approx(0.09), 0.04: pytest.approx(0.09), 0.5: pytest.approx(0.5)}


def test_sums_over_lower_values_of_several_ranges(spark):
    """Rows are dealt to ranges by Spark, not compared with each range's border, so work grows with the rows alone."""
    rng = np.random.default_rng(4)
    rows = [(k, float(v), int(n)) for k in ("a", "b") for v, n in zip(rng.permutation(np.arange(-200, 200)) / 8, rng.integers(1, 9, 400))]
    rows.append(("c", 0.5, 3))
    got = stats.cumulative(spark.createDataFrame(rows, "k string, v double, n long"), ["k"], "v", "n", "below", per_range=50)
    assert {(r.k, r.v): r.below for r in got.collect()} == {(k, v): sum(m for j, u, m in rows if j == k and u < v) for k, v, _ in rows}
    assert got.count() == len(rows) and "NestedLoopJoin" not in got._jdf.queryExecution().toString()
    one = stats.cumulative(spark.createDataFrame(rows[:400], "k string, v double, n long"), [], "v", "n", "below", per_range=50)
    assert sum(r.below for r in one.collect()) == sum(m for _, v, _ in rows[:400] for _, u, m in rows[:400] if u < v)


def test_bootstrap_covers_the_mean(spark):
    rng = np.random.default_rng(2)
    loss = spark.createDataFrame([(1, s, t, float(rng.normal(-1, 1))) for s in range(40) for t in range(6)], "h int, territory_id int, t int, diff double")
    r = stats.bootstrap(loss, ["h"], draws=100).first()
    assert r.ci_low < r.diff < r.ci_high < 0


def test_envelopes(spark):
    df = spark.createDataFrame([("__string__w6k=", "__number__2.5", "__boolean__true", "__null__")], "a string, b string, c string, d string")
    r = df.select(*[envelope.decode_flat(F.col(c), t).alias(c) for c, t in (("a", "string"), ("b", "double"), ("c", "boolean"), ("d", "string"))]).first()
    assert tuple(r) == ("é", 2.5, True, None)
    nested = {"rows": [{"key": "__string__YQ==", "value": "__number__1"}], "x": ["__null__", "__string__w6k="]}
    assert envelope.decode(nested) == {"rows": {"a": 1.0}, "x": [None, "é"]}


def test_portal_pages_and_retries(spark):
    assert portal.dataset(spark, "d", 3).count() == 30
    calls = []

    def flaky(route):
        calls.append(route)
        if len(calls) < 3:
            raise OSError("busy")
        return [(1, "x")]

    assert portal.fetch(flaky, "r", pause=0) == [(1, "x")] and len(calls) == 3


def test_store_resumes(spark, tmp_path):
    f = spark.createDataFrame([("m", o, float(o)) for o in range(6)], "model string, o int, yhat double")
    path = str(tmp_path / "store")
    tb.write_forecasts(f.where("o < 3"), path, spark)
    assert tb.write_forecasts(f, path, spark).count() == 6


def test_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc")
    r = tb.manifest(spark, str(tmp_path)).first()
    assert r.bytes == 3 and r.sha256.startswith("ba7816bf")


def test_plugin(spark):
    plugins.register("zeros", lambda history, h: np.zeros((len(history), h, 3)))
    d = spark.createDataFrame([(1, "c", t, float(t)) for t in range(10)], "territory_id int, category string, t int, d double")
    assert plugins.forecast(d, "zeros", 9, 4).count() == 4


def test_streaming_state_equals_the_definition(spark, sf):
    rows = online.run_to_table(online.cusum_stream(online.event_stream(spark, sf), 50.0, 25.0), "cusum", "update")
    got = {r.user_id: (r.up, r.down, r.peak) for r in online.latest_state(rows, "user_id").collect()}
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("user_id", "ts", "event_id").toPandas()
    for user, g in events.groupby("user_id"):
        assert got[user] == pytest.approx(online.reference(g["value"].fillna(50.0).to_numpy(), 50.0, 25.0), abs=1e-9)


def test_fallback_folder_without_setting():
    """A local session without spark.checkpoint.dir, in a process of its own."""
    import os
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession
from tessera.storage import materialize, shared_dir
s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
assert s.conf.get('spark.checkpoint.dir', None) is None
a, b = materialize(s.range(3), 'a'), materialize(s.range(4), 'b')
print('rows', a.count() + b.count(), shared_dir(s) == shared_dir(s))
"""
    with tempfile.TemporaryDirectory() as conf:
        env = {**os.environ, "SPARK_CONF_DIR": conf, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
        out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "rows 7 True" in out.stdout, out.stderr[-2000:]


def test_gazetteer_phrases_and_sentence_scope(spark):
    """Stop names, the longest name, homonyms, the document's region, sentences that don't match, null texts."""
    places = spark.createDataFrame(
        [("New Town", 1, 10), ("New Town Hill", 2, 10), ("Hill", 3, 10), ("Ford", 4, 10), ("Ford", 5, 10), ("Ford", 6, 20), ("Stopham", 7, 10), ("!?", 8, 10), ("Hill", 3, 10)],
        "name string, territory_id int, region_code int",
    )
    regions = spark.createDataFrame([("Low Land", 10), ("High Land", 20)], "name string, region_code int")
    g = nw.build_gazetteer(places, regions, spark.createDataFrame([("STOPHAM",)], "name string"))
    assert {(r.phrase, r.n) for r in g.collect()} == {("new town", 2), ("new town hill", 3), ("hill", 1), ("ford", 1), ("low land", 2), ("high land", 2)}
    s = spark.createDataFrame([(1, "in new-town hill, hill and NEW TOWN"), (2, "low land"), (3, None), (4, "")], "k int, sentence string")
    got = {(r.k, r.start, r.phrase) for r in nw.phrase_matches(s, g, ["k"]).collect()}
    assert got == {(1, 1, "new town hill"), (1, 4, "hill"), (1, 6, "new town"), (2, 0, "low land")}
    docs = spark.createDataFrame(
        [(1, 10, "Fire in New Town Hill. Calm at Hill."), (2, 10, "Fire at Ford!  Fire near Stopham"), (3, 20, "fire at Ford; fire in Hill"), (4, 10, None), (5, 10, "Nothing. At Hill"), (6, 10, "FIRE Hill? fire New Town")],
        "id int, region_code int, text string",
    )
    out = {r.id: (r.territory_ids, r.region_codes) for r in nw.geocode_sentences(docs, g, "(?i)fire").collect()}
    assert out == {1: ([2], []), 2: ([], [10]), 3: ([6], []), 4: ([], [10]), 5: ([], [10]), 6: ([1, 3], [])}
    assert nw.geocode_sentences(docs, g.limit(0), "fire").where("size(territory_ids) > 0").count() == 0


def test_fisher_tail_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(map(int, rng.integers(0, 12, 4))) for _ in range(200)] + [(8, 2, 1, 5), (0, 0, 0, 0), (900, 100, 700, 300), (0, 7, 3, 0)]

    def plain(a, b, c, d):
        n, row, col = a + b + c + d, a + b, a + c
        return sum(math.comb(row, k) * math.comb(n - row, col - k) for k in range(a, min(row, col) + 1) if col - k <= n - row) / math.comb(n, col)

    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    got = df.select("*", stats.fisher_greater(*[F.col(x) for x in "abcd"]).alias("p")).collect()
    assert all(r.p == pytest.approx(plain(*r[:4]), rel=1e-9, abs=1e-12) for r in got)


def test_clusters_are_resampled_whole(spark):
    """Weights by hand: a cluster's draw holds for all of its rows; null values and all-zero draws don't count."""
    rng = np.random.default_rng(6)
    rows = [("k", int(c), float(rng.normal(0.2 * c, 1)) if rng.random() > 0.1 else None) for c in range(6) for _ in range(rng.integers(1, 9))]
    got = stats.cluster_bootstrap(spark.createDataFrame(rows, "g string, c int, v double"), ["g"], "c", "v", draws=300).first()
    weight = {}
    for r in spark.range(6).select(F.col("id").cast("int").alias("c")).transform(lambda d: stats._weights(d, "cluster", "c", 300)).collect():
        weight[r.b, r.c] = r._cluster
    means = []
    for b in range(300):
        w = [(weight[b, c], v) for _, c, v in rows if v is not None]
        if sum(x for x, _ in w):
            means.append(sum(x * v for x, v in w) / sum(x for x, _ in w))
    own = [v for *_, v in rows if v is not None]
    assert (got.n, got.n_clusters, got["mean"]) == (len(own), 6, pytest.approx(np.mean(own)))
    assert (got.ci_low, got.ci_high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))
    assert got.p == pytest.approx(min(1, 2 * min(np.mean(np.array(means) <= 0), np.mean(np.array(means) >= 0))))


def test_stopped_write_of_an_origin_is_repaired(spark):
    """Rows without a commit aren't seen, and the rerun replaces them."""
    path = tempfile.mkdtemp()
    f = spark.createDataFrame([(m, o, o + h, float(h)) for m in ("a", "b") for o in (1, 2) for h in (1, 2, 3)], "model string, o int, t int, yhat double")
    tb.write_forecasts(f.where("model = 'a' and o = 1"), path, spark)
    half = f.where("model = 'a' and o = 2 and t = 3").withColumn("yhat", F.lit(-1.0))
    half.write.mode("append").partitionBy("model", "o").parquet(f"{path}/rows")
    assert tb.read_forecasts(spark, path).count() == 3
    out = tb.write_forecasts(f, path, spark)
    assert out.count() == 12 and out.where("yhat < 0").count() == 0
    assert tb.write_forecasts(f, path, spark).count() == 12
    moved = tb.rebase_forecasts(out, "2023-03-01", "2023-01-01", 7)
    assert {(r.o, r.t) for r in moved.collect()} == {(3, 4), (3, 5), (3, 6), (4, 5), (4, 6)}


def test_late_rows_are_dropped_and_replays_write_nothing_twice(spark):
    """Batches by file: a row behind the watermark is left out and counted, a day is given once, state is evicted."""
    root = tempfile.mkdtemp()
    day = lambda d, h=1: dt.datetime(2024, 1, d, h)
    files = [[(1, day(1), "a", 1.0), (2, day(2), "a", 1.0), (3, day(5), "a", 1.0)], [(4, day(1), "a", 100.0), (5, day(4, 23), "a", 1.0), (6, day(9), "b", 1.0)], [(7, day(20), "b", 1.0)]]
    schema = "event_id long, ts timestamp, event_type string, value double"
    base, src = f"{root}/out", f"{root}/in"
    stream = lambda: online.daily_counts(spark.readStream.schema(schema).parquet(src))
    dropped = []
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        dropped.append(online.dropped_rows(stream(), "daily", base))
    assert dropped == [0, 1, 0]
    out = spark.read.parquet(f"{base}/rows")
    assert sorted((r.day, r.event_type, r.n, r.total) for r in out.collect()) == [("2024-01-01", "a", 1, 1.0), ("2024-01-02", "a", 1, 1.0), ("2024-01-04", "a", 1, 1.0), ("2024-01-05", "a", 1, 1.0), ("2024-01-09", "b", 1, 1.0)]
    first = out.where("batch = 1").drop("batch")
    again, many = spark.createDataFrame(first.collect(), first.schema), out.count()
    for _ in range(2):
        online.batch_sink(base)(again, 1)
    assert spark.read.parquet(f"{base}/rows").count() == many


def test_exposure_without_a_source_is_that_of_the_others(spark):
    """Leaving a source out equals the exposure of the events of all others."""
    ev = spark.createDataFrame(
        [(1, dt.date(2024, 1, 10), ["x"], [1], [], "a"), (2, dt.date(2024, 1, 20), ["y"], [1], [9], "b"), (3, dt.date(2024, 2, 1), ["x"], [], [9], "c"), (4, dt.date(2024, 2, 9), ["x"], [2], [], "a")],
        "event_id int, date date, types array<string>, territory_ids array<int>, region_codes array<int>, source string",
    )
    reg = spark.createDataFrame([(1, 9), (2, 9)], "territory_id int, region_code int")
    got = {(r.territory_id, r.month, r.source): r.without for r in nw.exposure_without(ev, reg).collect()}
    for s in "abc":
        rest = {(r.territory_id, r.month): r.e for r in nw.monthly_exposure(ev.where(F.col("source") != s), reg).groupBy("territory_id", "month").agg(F.sum("exposure").alias("e")).collect()}
        own = {k[:2]: v for k, v in got.items() if k[2] == s}
        assert own and all(v == pytest.approx(rest.get(k, 0.0)) for k, v in own.items())
