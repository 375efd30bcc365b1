"""Problem 5: overlapping and gapped ranges.

Byte ranges are read as sessions: a range's offset is its time in microseconds, its count the session's own gap
duration, and Spark's ``session_window`` merges what overlaps. A group with very many ranges is cut into blocks by
offset; sessions are merged inside each block, and what reaches beyond a block is carried to later blocks by a prefix
maximum over one summary row per block, so no task sees a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calltide.runtime import BROADCAST_ROWS, cut

#: A round cuts a hot group into up to so many blocks; what is still too large is cut again by the next.
BLOCKS_PER_ROUND = 1024
SALTS = 32


def _blocked(ranges: DataFrame, keys: list[str], rows_per_block: int) -> DataFrame:
    """ranges with a column _block which grows with the offset; 0 in all groups of up to rows_per_block offsets.

    A larger group is cut at quantiles of its offsets into blocks of about that many, so the number of blocks follows
    its size, and bounds are one number for rows_per_block rows. Repeats of one offset aren't cut; they become one row.
    """
    out = ranges.withColumn("_block", F.lit(0).cast("bigint"))
    by = [*keys, "_block"]
    while True:
        sizes = out.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows_per_block)
        if not sizes.take(1):
            return out
        large = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
        inside = out.alias("r").join(large.alias("h"), [F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in by], "left_semi")
        hot = inside.groupBy(*by, "_from").agg(F.lit(1).alias("_1")).groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows_per_block)
        hot = cut(hot, "hot-groups")
        n_hot = hot.count()
        if not n_hot:
            return out
        # quantiles of distinct offsets: every so-many-th of them, so that blocks hold about rows_per_block; at least the median
        each = F.least(F.ceil(F.lit(BLOCKS_PER_ROUND * rows_per_block) / F.col("h._n")), F.lit(BLOCKS_PER_ROUND // 2))
        steps = F.array(*[F.lit((i + 1) / BLOCKS_PER_ROUND) for i in range(BLOCKS_PER_ROUND - 1)])
        offsets = out.groupBy(*by, "_from").agg(F.lit(1).alias("_1"))
        few = n_hot <= BROADCAST_ROWS
        offsets = offsets.alias("r").join((F.broadcast(hot) if few else hot).alias("h"), [F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in by])
        quantiles = offsets.groupBy(*[F.col(f"r.{k}").alias(f"_b_{k}") for k in by]).agg(F.percentile_approx("r._from", steps, F.lit(10_000)).alias("_q"), F.max(each).alias("_each"))
        bounds = quantiles.select(*[f"_b_{k}" for k in by], F.array_distinct(F.filter("_q", lambda x, i: (i + 1) % F.col("_each") == 0)).alias("_bounds"))
        bounds = cut(bounds, "block-bounds")
        n_bounds = bounds.agg(F.sum(F.size("_bounds"))).first()[0] or 0
        same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in by]
        if few and n_bounds <= 10 * BROADCAST_ROWS:
            joined = out.join(F.broadcast(bounds), same, "left")
        else:
            salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
            salted = out.withColumn("_salt", F.pmod(F.xxhash64("_from"), F.lit(SALTS)))
            joined = salted.join(bounds.withColumn("_b_salt", F.explode(salts)), [*same, F.col("_salt") == F.col("_b_salt")], "left").drop("_salt", "_b_salt")
        within = F.coalesce(F.size(F.filter("_bounds", lambda x: x < F.col("_from"))), F.lit(0))
        number = F.col("_block") * BLOCKS_PER_ROUND + F.when(F.col("_bounds").isNull(), 0).otherwise(within)
        out = joined.withColumn("_block", number).drop("_bounds", *[f"_b_{k}" for k in by])


def merged_ranges(
    df: DataFrame,
    keys: Sequence[str] = ("filename", "rank"),
    offset: str = "offset",
    count: str = "count",
    time: str = "tstart",
    rows_per_block: int = 1_000_000,
) -> DataFrame:
    """Sessions of overlapping or touching ranges inside a block, with what was covered before.

    Result: keys, range_start, range_end, first_time, last_time, n_ranges, covered_to (the end of everything before,
    null for a group's first) and stretch (a number that grows by one at every gap of the group).

    Rows with null offset or count, or a count of zero or below, cover nothing. Null keys form a group of their own.
    Ends beyond 2^63 - 1 are cut to it. Repeated rows change only n_ranges; null or NaN times are left out of first and
    last. An empty table gives an empty result. Other columns of df are ignored, whatever their names.
    """
    keys = list(keys)
    t = F.col(time).cast("double")
    rows = df.select(*keys, F.col(offset).cast("bigint").alias("_from"), F.col(count).cast("bigint").alias("_len"), F.when(~F.isnan(t), t).alias("_time"))
    rows = rows.filter((F.col("_from").isNotNull()) & (F.col("_len") > 0))
    rows = rows.withColumn("_len", F.when(F.col("_from") > 0, F.least("_len", F.lit(2**63 - 1) - F.greatest("_from", F.lit(0)))).otherwise(F.col("_len")))
    rows = _blocked(rows, keys, rows_per_block)
    # ranges of one offset first become one, map-side: a repeated offset is no hot spot
    rows = rows.groupBy(*keys, "_block", "_from").agg(
        F.max("_len").alias("_len"), F.min("_time").alias("_first"), F.max("_time").alias("_last"), F.count("*").alias("_n")
    )
    session = F.session_window(F.timestamp_micros("_from"), F.concat(F.col("_len").cast("string"), F.lit(" microseconds")))
    merged = (
        rows.groupBy(*keys, "_block", session.alias("_s"))
        .agg(F.min("_first").alias("first_time"), F.max("_last").alias("last_time"), F.sum("_n").alias("n_ranges"))
        .select(*keys, "_block", F.unix_micros("_s.start").alias("range_start"), F.unix_micros("_s.end").alias("range_end"), "first_time", "last_time", "n_ranges")
    )
    merged = cut(merged, "merged-ranges")
    inside = Window.partitionBy(*keys, "_block").orderBy("range_start")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # one row a block: how far it reaches; then what reaches into it from all blocks before
    reach = merged.groupBy(*keys, "_block").agg(F.max("range_end").alias("_reach"))
    carry = reach.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_block").alias("_c_block"), F.max("_reach").over(blocks).alias("_carry"))
    on = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys] + [F.col("_block") == F.col("_c_block")]
    drop = [f"_c_{k}" for k in keys] + ["_c_block"]
    with_carry = merged.join(carry, on, "left").drop(*drop)
    covered = with_carry.withColumn("covered_to", F.greatest(F.max("range_end").over(before), F.col("_carry")))
    opens = covered.withColumn("_opens", (F.col("covered_to").isNull() | (F.col("range_start") > F.col("covered_to"))).cast("bigint"))
    opened = opens.groupBy(*keys, "_block").agg(F.sum("_opens").alias("_opened"))
    earlier = opened.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_block").alias("_c_block"), F.sum("_opened").over(blocks).alias("_earlier"))
    numbered = opens.join(earlier, on, "left").drop(*drop)
    stretch = F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_earlier", F.lit(0))
    return numbered.withColumn("stretch", stretch).select(*keys, "range_start", "range_end", "first_time", "last_time", "n_ranges", "covered_to", "stretch")


def stretches(merged: DataFrame, keys: Sequence[str] = ("filename", "rank")) -> DataFrame:
    """The continuous stretches of ``merged_ranges``: start, end, first and last time, number of ranges."""
    return merged.groupBy(*keys, "stretch").agg(
        F.min("range_start").alias("stretch_start"),
        F.max("range_end").alias("stretch_end"),
        F.min("first_time").alias("first_tstart"),
        F.max("last_time").alias("last_tstart"),
        F.sum("n_ranges").alias("n_ranges"),
    )


def gaps(merged: DataFrame, keys: Sequence[str] = ("filename", "rank")) -> DataFrame:
    """The uncovered runs between stretches: [gap_start, gap_end)."""
    return merged.filter(F.col("range_start") > F.col("covered_to")).select(*keys, F.col("covered_to").alias("gap_start"), F.col("range_start").alias("gap_end"))
