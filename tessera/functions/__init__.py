"""Column helpers: missing values, rounding, robust aggregates, reproducible draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(c: Column) -> Column:
    """NaN to NULL: NumPy's missing value must not take part in Spark aggregates."""
    return F.when(~F.isnan(c), c)


def r6(c: Column) -> Column:
    """Rounded to 6 decimals, without negative zero: equal whatever the order of summation."""
    return F.round(c, 6) + F.lit(0.0)


def median(c: Column | str) -> Column:
    """Exact median that also works over a window frame."""
    return F.percentile(c, F.lit(0.5))


def draw(*parts: Column) -> Column:
    """Reproducible draw from 0 to 2**32 - 1 by MD5 of the parts joined with ``|``; other SQL engines can compute it too."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def bernoulli(p: float, *parts: Column) -> Column:
    return draw(*parts) % 10_000 < int(round(10_000 * p))
