"""Problem 4: runs of repeated consecutive events, collapsed by pointer doubling.

Every event that continues its predecessor points to it; all others point to themselves and start a run. In each round
an event takes over the pointer of the event it points to, so the distance covered doubles, and a run of n events is
resolved after about log2(n) self-joins. Events that have reached a start leave the join: those that remain point to
different events, so no event is looked up by more than one, however long a run is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.functions.names import plain_name
from calltide.operators.sequence import dense_positions, neighbours
from calltide.runtime import cut, release


def run_starts(events: DataFrame, keys: Sequence[str], pos: str, continues: str) -> DataFrame:
    """keys, _at and _start for every event that continues a run: its position and that of the run's first event.

    ``continues`` (boolean) says that an event belongs to the run of the event one position before it; null counts as
    false. (keys, pos) must be unique and positions without holes, as ``dense_positions`` gives them.
    """
    keys = list(keys)

    def looked_up(asking: DataFrame, table: DataFrame, how: str) -> DataFrame:
        target = table.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("_at").alias("_t_at"), F.col("_to").alias("_next"), F.col("_done").alias("_next_done"))
        on = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys] + [F.col("_to") == F.col("_t_at")]
        return asking.join(target, on, how)

    linked = events.filter(F.col(continues) & (F.col(pos) > 0)).select(*keys, F.col(pos).alias("_at"), (F.col(pos) - 1).alias("_to"), F.lit(False).alias("_done"))
    linked = cut(linked, "links")
    # an event whose predecessor continues nothing points to a start
    first = cut(looked_up(linked, linked, "left").select(*keys, "_at", "_to", F.col("_next").isNull().alias("_done")), "pointers")
    release(linked)
    done, open_ = first.filter("_done"), first.filter("not _done")
    while open_.take(1):
        step = looked_up(open_, done.unionByName(open_), "inner").select(*keys, "_at", F.col("_next").alias("_to"), F.col("_next_done").alias("_done"))
        step = cut(step, "pointers")
        done, open_ = done.unionByName(step.filter("_done")), step.filter("not _done")
    return done.select(*keys, "_at", F.col("_to").alias("_start"))


def collapse_runs(events: DataFrame, keys: Sequence[str], order: str, event: Column, start: Column, end: Column, max_pause: int | None = None, block: int = 4096) -> DataFrame:
    """One row per run of consecutive equal events: keys, event, first_order, last_order, n, first_start, last_end, duration.

    The events of a sequence ``keys`` follow each other by the integer ``order``, which must be unique in it. An event
    continues the one right before it if both have the same non-null ``event`` and it starts at most ``max_pause`` after
    that one's end, or after its start where the end is null; a null start continues nothing where max_pause is given.
    Single events are runs of n = 1. Null keys form a sequence of their own. last_end is the latest known end, duration
    is last_end - first_start and null where either is. An empty table gives no rows.
    """
    keys = list(keys)
    rows = events.select(*keys, F.col(order).cast("bigint").alias("_order"), event.alias("_event"), start.alias("_start_at"), end.alias("_end_at"))
    rows = cut(dense_positions(rows, keys, "_order", block), "positions")
    until = F.coalesce("_end_at", "_start_at")
    seen = neighbours(
        rows,
        keys,
        "_pos",
        {"_last_event": (lambda w: F.lag("_event").over(w), 1, 0), "_last_until": (lambda w: F.lag(until).over(w), 1, 0)},
        block,
    )
    same = F.col("_event") == F.col("_last_event")
    if max_pause is not None:
        same = same & (F.col("_start_at") - F.col("_last_until") <= max_pause)
    starts = run_starts(seen.withColumn("_continues", F.coalesce(same, F.lit(False))), keys, "_pos", "_continues")
    starts = starts.select(*[F.col(k).alias(f"_m_{k}") for k in keys], "_at", "_start")
    on = [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys] + [F.col("_pos") == F.col("_at")]
    member = rows.join(starts, on, "left").withColumn("_run", F.coalesce("_start", "_pos"))
    runs = member.groupBy(*keys, "_run").agg(
        F.max("_event").alias("event"),
        F.min("_order").alias("first_order"),
        F.max("_order").alias("last_order"),
        F.count("*").alias("n"),
        F.min("_start_at").alias("first_start"),
        F.max("_end_at").alias("last_end"),
    )
    return runs.drop("_run").withColumn("duration", F.col("last_end") - F.col("first_start"))


def decoded_function(spark_functions: DataFrame, records: DataFrame) -> DataFrame:
    """records with ``_function``: one spelling of the called function.

    It is the name of func_id; where that is null or unlisted, the name in func. Blanks, case and the P of PMPI_ don't
    count, and a name ending in 64 is the name without it if the list has both. The list is a table of fixed size.
    """
    names = spark_functions.select(F.col("func_id").alias("_id"), plain_name(F.col("name")).alias("_name")).dropDuplicates(["_id"])
    plain = names.select(F.col("_name").alias("_short")).distinct()
    longer = names.select(F.col("_name").alias("_long")).distinct().filter(F.col("_long").endswith("64"))
    same = longer.join(plain, F.expr("substring(_long, 1, length(_long) - 2)") == F.col("_short"))
    out = records.join(F.broadcast(names), F.col("func_id") == F.col("_id"), "left")
    out = out.withColumn("_function", F.coalesce("_name", plain_name(F.col("func"))))
    out = out.join(F.broadcast(same), F.col("_function") == F.col("_long"), "left")
    return out.withColumn("_function", F.coalesce("_short", "_function")).drop("_id", "_name", "_long", "_short")
