"""Streams of dated values: daily windows, and a CUSUM whose state lives with its key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.storage import shared_dir


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a file stream; times are UTC."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events.parque*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts and sums by day and type; rows later than the watermark (the publication lag) are dropped by append mode."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def cusum_stream(events: DataFrame, mean: float, std: float, k: float = 0.5) -> DataFrame:
    """``user_id, n, up, down, peak`` after each micro-batch: a two-sided CUSUM of standardised values in each key's state.

    A batch's rows of a key are folded in the order of their times with a running minimum, so NumPy does the loop.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, up, down, peak = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        p = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        z = (p["value"].fillna(mean).to_numpy() - mean) / std

        def run(start: float, x: np.ndarray) -> np.ndarray:
            total = start + np.cumsum(x)
            return total - np.minimum(0.0, np.minimum.accumulate(total))

        a, b = run(up, z - k), run(down, -z - k)
        n, up, down, peak = n + len(z), float(a[-1]), float(b[-1]), max(peak, float(a.max()), float(b.max()))
        state.update((n, up, down, peak))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "up": [up], "down": [down], "peak": [peak]})

    rows = events.select("user_id", "event_id", "ts", "value")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, up double, down double, peak double", "n long, up double, down double, peak double", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, tag: str, mode: str, base: str | None = None) -> DataFrame:
    """Run a stream over what there is now; each batch goes to its own folder of the shared one, with its number as ``batch``.

    A batch that is replayed after a failure overwrites what it wrote, so nothing is there twice. In complete mode only
    the last batch is read. With ``base``, a later call goes on from the state that is kept there.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(batch_sink(base)).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{stream_schema(stream)}, batch long").parquet(f"{base}/rows")
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]) if mode == "complete" else rows


def stream_schema(stream: DataFrame) -> str:
    return ", ".join(f"`{c}` {k}" for c, k in stream.dtypes)


def batch_sink(base: str):
    """What writes a numbered batch; the same number overwrites."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    return sink


def dropped_rows(stream: DataFrame, tag: str, base: str) -> int:
    """As ``run_to_table`` in append mode; how many rows came behind the watermark and were left out."""
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(batch_sink(base)).start()
    query.awaitTermination()
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])


def latest_state(rows: DataFrame, key: str) -> DataFrame:
    """The newest row of each key of an update-mode table."""
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(key, "s.*")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    w = events.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def reference(values: np.ndarray, mean: float, std: float, k: float = 0.5) -> tuple[Any, ...]:
    """The CUSUM of one key by its definition, for tests."""
    up = down = peak = 0.0
    for v in values:
        z = (v - mean) / std
        up, down = max(0.0, up + z - k), max(0.0, down - z - k)
        peak = max(peak, up, down)
    return up, down, peak
