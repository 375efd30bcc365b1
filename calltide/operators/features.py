"""Problem 3: one wide row per entity, with counts, recency and totals for every event type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.functions.values import duration, finite, to_micros
from calltide.runtime import cut

#: A type list is a schema: more types than this are refused rather than dropped.
MAX_TYPES = 9_000


def partial_statistics(df: DataFrame, entity: str, event_type: Column, start: Column, end: Column, salt_by: Sequence[str], salts: int = 16) -> DataFrame:
    """(entity, _type) with n, last_us and total_us, summed in two stages.

    Stage one groups by entity, type and a salt taken from ``salt_by``, so that the rows of one heavy entity and type
    are spread over ``salts`` groups (after map-side sums); stage two adds up at most ``salts`` rows for each. Times are
    whole microseconds: the sums are exact and don't depend on the order of rows.
    """
    rows = df.select(
        F.col(entity).alias("_entity"),
        event_type.alias("_type"),
        F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int").alias("_salt"),
        to_micros(finite(start)).alias("_start"),
        to_micros(duration(start, end)).alias("_dur"),
    )
    first = rows.groupBy("_entity", "_type", "_salt").agg(F.count("*").alias("n"), F.max("_start").alias("last_us"), F.sum("_dur").alias("total_us"))
    return first.groupBy("_entity", "_type").agg(F.sum("n").alias("n"), F.max("last_us").alias("last_us"), F.coalesce(F.sum("total_us"), F.lit(0)).alias("total_us"))


def _listed(
    df: DataFrame, entity: str, event_type: Column, start: Column, end: Column, salt_by: Sequence[str], types: Sequence[str], as_of_us: int | None, salts: int
) -> tuple[DataFrame, list[str]]:
    """Statistics with recency for every entity and type that occur together, and the complete list of types."""
    stats = cut(partial_statistics(df, entity, F.coalesce(event_type, F.lit("unknown")), start, end, salt_by, salts), "type-statistics")
    found = [r[0] for r in stats.select("_type").distinct().limit(MAX_TYPES + 1).collect()]
    names = sorted({*types, *found})
    if len(names) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types")
    if as_of_us is None:
        as_of_us = stats.agg(F.max("last_us")).first()[0]
    return stats.withColumn("since_us", F.lit(as_of_us).cast("bigint") - F.col("last_us")), names


def entity_type_rows(
    df: DataFrame, entity: str, event_type: Column, start: Column, end: Column, salt_by: Sequence[str], types: Sequence[str] = (), as_of_us: int | None = None, salts: int = 16
) -> DataFrame:
    """The features of ``entity_features`` in long form: entity, type, n, since_us, total_us for every entity and every type of the list."""
    stats, names = _listed(df, entity, event_type, start, end, salt_by, types, as_of_us, salts)
    known = F.map_from_entries(F.collect_list(F.struct("_type", F.struct("n", "since_us", "total_us").alias("s"))))
    rows = stats.groupBy("_entity").agg(known.alias("_m")).withColumn("type", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")))
    s = F.try_element_at("_m", F.col("type"))
    return rows.select(F.col("_entity").alias(entity), "type", F.coalesce(s["n"], F.lit(0)).alias("n"), s["since_us"].alias("since_us"), F.coalesce(s["total_us"], F.lit(0)).alias("total_us"))


def entity_features(
    df: DataFrame,
    entity: str,
    event_type: Column,
    start: Column,
    end: Column,
    salt_by: Sequence[str],
    types: Sequence[str] = (),
    as_of_us: int | None = None,
    salts: int = 16,
) -> DataFrame:
    """One row per entity; for each type T the columns ``T_n``, ``T_since_us`` and ``T_total_us``.

    The list of types is ``types`` and every type in df, in alphabetical order. T_n and T_total_us are 0 for a type the
    entity doesn't have, T_since_us is null there and where no start is known. ``as_of_us`` is the moment recency is
    counted to; by default the latest start in df. Rows with a null type are counted under ``unknown``; a null entity
    has a row of its own; null, NaN or too early ends add nothing to the total. An empty table gives no rows.
    """
    stats, names = _listed(df, entity, event_type, start, end, salt_by, types, as_of_us, salts)
    wide = stats.groupBy("_entity").pivot("_type", names).agg(F.first("n").alias("n"), F.first("since_us").alias("since_us"), F.first("total_us").alias("total_us"))
    columns = [F.col("_entity").alias(entity)]
    for name in names:
        columns += [F.coalesce(F.col(f"`{name}_{x}`"), F.lit(0)).alias(f"{name}_{x}") if x != "since_us" else F.col(f"`{name}_{x}`") for x in ("n", "since_us", "total_us")]
    return wide.select(*columns)
