"""Forecasters that run outside Spark's functions, a batch of whole series at a time: external model libraries plug in here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.panel import SERIES

#: name -> (history [series, months], horizons) -> quantiles [series, horizons, 3] at 10, 50 and 90 %.
REGISTRY: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {}


def register(name: str, model: Callable[[np.ndarray, int], np.ndarray]) -> None:
    REGISTRY[name] = model


def drift_quantiles(history: np.ndarray, horizons: int) -> np.ndarray:
    """Built-in example: the last value, spread by quantiles of the series' own h-step changes."""
    out = np.empty((len(history), horizons, 3))
    for h in range(1, horizons + 1):
        change = history[:, h:] - history[:, :-h] if history.shape[1] > h else np.zeros((len(history), 1))
        out[:, h - 1] = history[:, -1:] + np.quantile(change, [0.1, 0.5, 0.9], axis=1).T
    return out


register("drift_quantiles", drift_quantiles)


def forecast(d: DataFrame, name: str, origin: int, horizons: int) -> DataFrame:
    """``territory_id, category, o, h, q10, q50, q90`` of a registered model; missing history is 0."""
    model = REGISTRY[name]
    series = d.where(F.col("t") <= origin).groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("t", F.coalesce("d", F.lit(0.0)).alias("v")))).alias("s")).select(*SERIES, F.col("s.v").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, part in b.groupby(b["v"].map(len)):
                q = model(np.stack(part["v"].to_list()), horizons)
                n = len(part)
                yield pd.DataFrame({"territory_id": np.repeat(part["territory_id"], horizons), "category": np.repeat(part["category"], horizons), "o": origin, "h": np.tile(np.arange(1, horizons + 1), n), **{c: q[:, :, i].ravel() for i, c in enumerate(("q10", "q50", "q90"))}})

    return series.mapInPandas(run, "territory_id int, category string, o int, h int, q10 double, q50 double, q90 double")
