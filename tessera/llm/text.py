"""Text helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters that are none of space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(taken: list[str], stem: str) -> str:
    """A column name that none of ``taken`` clashes with, whatever the case."""
    return stem if stem.lower() not in {c.lower() for c in taken} else f"{stem}_{uuid.uuid4().hex[:12]}"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in pieces: only a piece's texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def where_arrow(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., np.ndarray]]) -> DataFrame:
    """Rows of ``df`` that a vectorised test keeps: ``make()`` is called once a task and returns a function from the Arrow
    arrays of ``columns`` to booleans. All columns pass through as they are."""
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for b in slices(batches):
            yield b.filter(pa.array(test(*[b.column(i) for i in at]), pa.bool_()))

    return df.mapInArrow(run, df.schema)
