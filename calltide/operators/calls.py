"""Each call once: which of several stored rows of one call stands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def export_preference() -> list[Column]:
    """Order among the rows of one exported call: the most complete one, then the one that arrived first, then by content."""
    missing = F.col("func_id").isNull().cast("int") + F.col("tstart").isNull().cast("int") + F.coalesce(F.isnan("tend") | (F.col("tend") < F.col("tstart")), F.lit(True)).cast("int")
    return [missing.asc(), F.col("arrived_at").asc_nulls_last(), F.col("file_name").asc_nulls_last(), F.col("func_id").asc_nulls_last(), F.col("tstart").asc_nulls_last(), F.col("tend").asc_nulls_last()]


def distinct_rows(df: DataFrame, keys: Sequence[str], prefer: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``prefer``.

    The filter on row_number lets Spark drop later rows of a key before the shuffle (window group limit), so a key that
    is repeated very often doesn't reach one task whole. Null keys count as equal.
    """
    w = Window.partitionBy(*keys).orderBy(*prefer)
    nth = "_nth"
    while nth in df.columns:
        nth += "_"
    return df.withColumn(nth, F.row_number().over(w)).filter(F.col(nth) == 1).drop(nth)
