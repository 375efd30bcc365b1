"""Byte ranges that calls touched, rebuilt from cursors, seeks and ends of files.

A cursor belongs to a rank and a file. Opening, closing and absolute seeks set it, relative seeks and sequential data
calls move it, so it is a base (set last) plus the moves since: two running values. Only files that are opened for
append or sought from their end need the end of file, which depends on earlier offsets; those are walked in time order,
row by row, by a task that holds the cursors of one file at a time and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.functions.facts import MPIIO, POSIX, feeds_intervals, is_data_name, number
from calltide.operators.sequence import scan
from calltide.runtime import cut, together

#: Blocks of ticks for running values.
TICK_BLOCK = 1 << 26
#: The flag that opens for append, by the constants of two systems.
APPEND_FLAG = {"linux": 0x400, "bsd": 0x8}
INTERVAL_SCHEMA = "filename string, rank int, seq_id bigint, tick bigint, offset bigint, count bigint, is_read boolean, mpifh string"


def attribute_handles(calls: DataFrame, width: int = TICK_BLOCK, per_rank: bool = True) -> DataFrame:
    """calls with ``mpifh``: the handle of the rank's last MPI-IO data call if that call is one level above, else ``-``.

    With per_rank false, the last such call of any rank counts. Needs levels; all-zero levels attribute nothing.
    """
    mpi = F.when((F.col("category") == MPIIO) & is_data_name(F.col("func")), F.struct(F.get("args", F.lit(0)).alias("fh"), F.col("level").alias("at")))
    rows = calls if per_rank else calls.withColumn("_whole", F.lit(0))
    out = scan(rows, ["rank"] if per_rank else ["_whole"], ["tick_start", "rank", "seq_id"], {"_mpi": ("last", mpi, False)}, width)
    hit = (F.col("category") == POSIX) & (F.col("level") == F.col("_mpi.at") + 1)
    return out.withColumn("mpifh", F.when(hit, F.coalesce("_mpi.fh", F.lit("-"))).otherwise("-")).drop("_mpi", *([] if per_rank else ["_whole"]))


def cursor_events(calls: DataFrame, flag_abi: str = "linux", count_fprintf: bool = False) -> DataFrame:
    """What each call does to a cursor: filename, kind (data, at, set, move, end, close), amount, offset.

    Calls without a file, and data calls without a readable count, are left out.
    """
    f, args = F.col("func"), F.col("args")
    printing = f.isin("fprintf", "vfprintf") & F.lit(count_fprintf)
    data = is_data_name(f) | printing
    positioned = f.isin("pread", "pread64", "pwrite", "pwrite64")
    stream = f.isin("fread", "fwrite")
    count = F.when(f.isin("readv", "writev") | printing, number(args, 1)).when(stream, number(args, 1) * number(args, 2)).otherwise(number(args, 2))
    opens = f.isin("open", "open64", "fopen", "fopen64", "fdopen")
    append = F.when(f.isin("open", "open64"), (number(args, 1).bitwiseAND(F.lit(APPEND_FLAG[flag_abi]))) != 0).otherwise(F.get(args, F.lit(1)).contains("a"))
    seeks = f.isin("lseek", "lseek64", "fseek", "fseeko")
    whence = number(args, 2)
    kind = (
        F.when(data & positioned, "at")
        .when(data, "data")
        .when(opens, F.when(F.coalesce(append, F.lit(False)), "end").otherwise("set"))
        .when(seeks & (whence == 0), "set")
        .when(seeks & (whence == 1), "move")
        .when(seeks & (whence == 2), "end")
        .when(f.contains("close"), "close")
    )
    amount = F.when(data, count).when(seeks & whence.isin(0, 1), F.coalesce(number(args, 1), F.lit(0))).otherwise(F.lit(0))
    rows = calls.filter(feeds_intervals(f, F.col("category")) & (F.col("category") == POSIX))
    rows = rows.select(
        F.when(stream, F.get(args, F.lit(3))).otherwise(F.get(args, F.lit(0))).alias("filename"),
        "rank", "seq_id", F.col("tick_start").alias("tick"), kind.alias("kind"), amount.alias("amount"),
        F.when(positioned, number(args, 3)).alias("at"), f.contains("read").alias("is_read"), "mpifh",
    )
    return rows.filter("filename is not null and kind is not null and amount is not null and tick is not null")


def _by_window(events: DataFrame, width: int) -> DataFrame:
    """Files without end-of-file dependence: offset = what the cursor was set to last + the moves since."""
    order = ["tick", "rank", "seq_id"]
    moves = F.when(F.col("kind").isin("data", "move"), F.col("amount")).otherwise(F.lit(0))
    moved = cut(scan(events, ["rank", "filename"], order, {"_moved": ("sum", moves, False)}, width), "moved")
    to = F.when(F.col("kind") == "set", F.col("amount")).when(F.col("kind") == "close", F.lit(0))
    based = scan(moved, ["rank", "filename"], order, {"_base": ("last", to - F.col("_moved"), False)}, width)
    return based.withColumn("offset", F.when(F.col("kind") == "at", F.col("at")).otherwise(F.coalesce("_base", F.lit(0)) + F.col("_moved")))


def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by filename and time; a file's end and its ranks' cursors are all that is held between rows."""
    name, end, cursors = None, 0, {}
    for b in batches:
        # what a row has no use for stays in the batch; only places of data calls are noted
        offsets, data = [], []
        for k, (file, rank, kind, amount, at) in enumerate(zip(b["filename"].tolist(), b["rank"].tolist(), b["kind"].tolist(), b["amount"].tolist(), b["at"].tolist())):
            if file != name:
                name, end, cursors = file, 0, {}
            if kind == "data":
                offset = cursors.get(rank, 0)
                cursors[rank] = offset + amount
            elif kind == "at":
                offset = at
            else:
                cursors[rank] = cursors.get(rank, 0) + amount if kind == "move" else amount if kind == "set" else end if kind == "end" else 0
                continue
            end = max(end, offset + amount)
            offsets.append(offset)
            data.append(k)
        out = b.iloc[data]
        yield pd.DataFrame({
            "filename": out["filename"], "rank": out["rank"], "seq_id": out["seq_id"], "tick": out["tick"], "offset": np.array(offsets, np.int64), "count": out["amount"], "is_read": out["is_read"], "mpifh": out["mpifh"],
        })


def intervals(calls: DataFrame, flag_abi: str = "linux", count_fprintf: bool = False, width: int = TICK_BLOCK, per_rank_handles: bool = True) -> DataFrame:
    """filename, rank, seq_id, tick, offset, count, is_read, mpifh of every POSIX data call.

    ``calls`` has rank, seq_id, tick_start, func, args, category and level, with (rank, seq_id) unique. Calls are
    ordered by (tick_start, rank, seq_id); calls without a start are left out. A cursor belongs to (rank, file) and starts at 0. An append or
    a seek from the end takes the highest byte that earlier data calls of any rank touched, reads included, and
    ignores the seek's own offset.
    """
    events = cut(cursor_events(attribute_handles(calls, width, per_rank_handles), flag_abi, count_fprintf), "cursor-events")
    dependent = events.filter("kind = 'end'").select(F.col("filename").alias("_f")).distinct()
    same = F.col("filename") == F.col("_f")
    plain = _by_window(events.join(dependent, same, "left_anti"), width).filter(F.col("kind").isin("data", "at") & F.col("offset").isNotNull())
    plain = plain.select("filename", "rank", "seq_id", "tick", "offset", F.col("amount").alias("count"), "is_read", "mpifh")
    walked = together(events.join(dependent, same, "left_semi").filter("kind <> 'at' or at is not null"), "filename").sortWithinPartitions("filename", "tick", "rank", "seq_id")
    walked = walked.select("filename", "rank", "seq_id", "tick", "kind", "amount", F.coalesce("at", F.lit(0)).alias("at"), "is_read", "mpifh").mapInPandas(walk, INTERVAL_SCHEMA)
    return plain.unionByName(walked)


def file_ends(found: DataFrame) -> DataFrame:
    """The highest byte touched in each file."""
    return found.groupBy("filename").agg(F.max(F.col("offset") + F.col("count")).alias("eof"))
