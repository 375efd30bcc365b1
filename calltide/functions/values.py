"""Checks and exact conversions of measured values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x as double; null where it is null, NaN or infinite."""
    d = x.cast("double")
    return F.when(F.abs(d) < float("inf"), d)


def duration(start: Column, end: Column) -> Column:
    """end - start in double; null where either is missing or not finite, or the end comes before the start."""
    a, b = finite(start), finite(end)
    return F.when(b >= a, b - a)


def to_micros(seconds: Column) -> Column:
    """Whole microseconds, so that sums don't depend on the order of addition."""
    return F.floor(seconds * 1_000_000 + 0.5).cast("bigint")
