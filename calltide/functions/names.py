"""Function names as traces spell them, and one spelling for each function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_name(name: Column) -> Column:
    """A name without blanks, case and the profiling ``P`` of ``PMPI_``; null stays null."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"\s+", "")), "^pmpi_", "mpi_")


def plain_name_sql(name: str) -> str:
    """The same in DuckDB's SQL."""
    return f"regexp_replace(lower(regexp_replace({name}, '\\s+', '', 'g')), '^pmpi_', 'mpi_')"
