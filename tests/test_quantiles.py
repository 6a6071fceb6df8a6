import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import quantiles as qu

PROBS = (0.0, 0.05, 1 / 3, 0.5, 0.97, 1.0)


def shown(rows, keys):
    return sorted((tuple(str(r[k]) for k in keys), None if r.q is None else tuple(r.q)) for r in rows)


def both(df, keys, few):
    got = qu.quantiles(df, keys, "v", PROBS, few=few).select(*keys, F.col("quantiles").alias("q")).collect()
    clean = df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    want = clean.groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, PROBS))).alias("q")).collect()
    assert shown(got, keys) == shown(want, keys)


@pytest.mark.parametrize("few", [1, 7, 1 << 16])
def test_quantiles_equal_percentile(spark, few):
    """Null keys, missing values, ties, one distinct value, huge and tiny values, groups without values."""
    rng = random.Random(few)
    odd = [0.0, -0.0, 5e-324, 1.7e308, -1.7e308, 1.0, 1.0 + 2**-52, float("nan"), None]
    rows = [(rng.choice(["a", None, "b"]), rng.choice([1, 2, None]), rng.choice([rng.gauss(0, 1), rng.randrange(4) * 1.0, rng.choice(odd), 10 ** rng.uniform(-300, 300)])) for _ in range(1500)]
    rows += [("one", 1, 3.5)] * 90 + [("none", 1, None), ("none", 2, float("nan")), ("single", 1, -7.0)]
    df = spark.createDataFrame(rows, "a string, k int, v double").repartition(6)
    both(df, ["a", "k"], few)
    both(df, [], few)
    both(df.limit(0), ["a"], few)
    both(df.limit(0), [], few)


def test_infinite_values(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,), (2.0,), (float("inf"),)], "v double")
    got = qu.quantiles(df, [], "v", (0.0, 0.25, 0.5, 1.0), few=1).first()[0]
    assert got == [float("-inf"), 1.0, 2.0, float("inf")]


def test_one_group_of_a_million_values(spark):
    """No aggregate buffers values, and no window holds more than a few of them."""
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7.0).alias("v"))
    got = qu.quantiles(df, ["g"], "v", PROBS, few=1000)
    text = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile" not in text
    v = np.sort(np.array([r.v for r in df.select("v").collect()]))
    assert np.allclose(got.first()["quantiles"], np.quantile(v, PROBS), rtol=1e-12)


def test_each_refinement_narrows(spark):
    """Values within one power of two that differ in the last bits only."""
    df = spark.range(3000).select((1 + F.col("id") * F.lit(2.0**-52)).alias("v"))
    both(df.unionByName(df.where("v > 1")), [], 2)
