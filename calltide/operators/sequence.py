"""Ordered sequences whose longest may hold a third of all rows: dense positions and neighbours without one task per sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_positions(df: DataFrame, keys: Sequence[str], order: str, block: int = 4096, to: str = "_pos") -> DataFrame:
    """df with the position (bigint from 0) of each row in its sequence ``keys`` by the integer ``order``.

    Rows are numbered inside blocks of ``order`` values; one summary row per block gives the number of rows before it.
    A sequence is thus spread over as many tasks as it has blocks. (keys, order) must be unique; null order comes first.
    """
    keys = list(keys)
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order)) - 1
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"))
    starts = sizes.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_block").alias("_s_block"), F.coalesce(before, F.lit(0)).alias("_before"))
    on = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys] + [F.col("_block").eqNullSafe(F.col("_s_block"))]
    out = rows.withColumn("_inside", inside).join(starts, on)
    return out.withColumn(to, F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_block", "_s_block", *[f"_s_{k}" for k in keys])


def neighbours(df: DataFrame, keys: Sequence[str], pos: str, columns: dict[str, Column], chunk: int = 4096) -> DataFrame:
    """df with window columns that look at most ``reach`` rows away, computed in chunks of positions.

    ``columns`` maps names to (function of a window, reach back, reach ahead). Rows near a chunk's edge are copied to the
    next chunk as context, so results equal those over the whole sequence.
    """
    keys = list(keys)
    back = max(b for _, b, _ in columns.values())
    ahead = max(a for _, _, a in columns.values())
    if max(back, ahead) > chunk:
        raise ValueError("the reach is longer than a chunk")
    own = F.floor(F.col(pos) / chunk)
    inside = F.pmod(F.col(pos), F.lit(chunk))
    homes = F.array_compact(F.array(own, F.when(inside < ahead, own - 1), F.when(inside >= chunk - back, own + 1)))
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    out = df.withColumn("_chunk", F.explode(homes))
    return out.select("*", *[f(w).alias(name) for name, (f, _, _) in columns.items()]).filter(F.col("_chunk") == own).drop("_chunk")


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, tuple[str, Column, bool]], width: int, descending: bool = False) -> DataFrame:
    """df with running values along each sequence ``keys`` in the total order ``order``.

    ``columns`` maps a new name to (kind, expression, inclusive). Kinds: ``sum`` (0 where nothing came before), ``max`` and
    ``last`` (the last non-null value; null where there is none). Without ``inclusive`` the row itself is left out, so
    ``last`` over a struct is the previous row. ``descending`` runs the sequence backwards.

    Rows are scanned inside blocks of ``width`` units of the first order column, an integer; one summary row per block
    carries values over, so a sequence of any length is spread over as many tasks as it has blocks.
    """
    keys, order = list(keys), list(order)
    towards = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    rows = df.withColumn("_block", F.floor(F.col(order[0]) / width))
    for name, (_, expr, _) in columns.items():
        rows = rows.withColumn(f"_v_{name}", expr)
    inside = Window.partitionBy(*keys, "_block").orderBy(*towards)
    far = Window.partitionBy(*keys).orderBy(F.col("_block").desc() if descending else F.col("_block").asc()).rowsBetween(Window.unboundedPreceding, -1)
    total = {"sum": F.sum, "max": F.max}
    ends = F.min_by if descending else F.max_by
    sums, carried, result = [], [], {}
    for name, (kind, _, inclusive) in columns.items():
        v = F.col(f"_v_{name}")
        w = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        here = F.last(v, ignorenulls=True).over(w) if kind == "last" else total[kind](v).over(w)
        rows = rows.withColumn(f"_h_{name}", here)
        sums.append((ends(v, F.when(v.isNotNull(), F.struct(*order))) if kind == "last" else total[kind](v)).alias(f"_t_{name}"))
        t = F.col(f"_t_{name}")
        carried.append((F.last(t, ignorenulls=True).over(far) if kind == "last" else total[kind](t).over(far)).alias(f"_c_{name}"))
        h, c = F.col(f"_h_{name}"), F.col(f"_c_{name}")
        result[name] = {"sum": F.coalesce(h, F.lit(0)) + F.coalesce(c, F.lit(0)), "max": F.greatest(h, c), "last": F.coalesce(h, c)}[kind]
    blocks = rows.groupBy(*keys, "_block").agg(*sums)
    before = blocks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_k_block"), *carried)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_block").eqNullSafe(F.col("_k_block"))]
    return rows.join(before, on, "left").select(*[F.col(c) for c in df.columns if c not in result], *[e.alias(n) for n, e in result.items()])
