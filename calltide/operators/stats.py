"""Summaries of traces: signatures, layers, files, sizes and access patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.functions.facts import HDF5, MPIIO, POSIX, any_of, io_size, is_report_metadata_name, layer, path_accepted, path_of
from calltide.operators.offsets import TICK_BLOCK
from calltide.operators.sequence import scan

#: Bits of open flags, by the constants of two systems; linux has no lock flags.
OPEN_FLAGS = {
    "linux": {
        "O_WRONLY": 0x1, "O_RDWR": 0x2, "O_NONBLOCK": 0x800, "O_APPEND": 0x400, "O_ASYNC": 0x2000,
        "O_FSYNC": 0x100000, "O_CREAT": 0x40, "O_TRUNC": 0x200, "O_EXCL": 0x80,
    },
    "bsd": {
        "O_WRONLY": 0x1, "O_RDWR": 0x2, "O_NONBLOCK": 0x4, "O_APPEND": 0x8, "O_SHLOCK": 0x10, "O_EXLOCK": 0x20, "O_ASYNC": 0x40,
        "O_FSYNC": 0x80, "O_CREAT": 0x200, "O_TRUNC": 0x400, "O_EXCL": 0x800,
    },
}


def layer_totals(signatures: DataFrame) -> DataFrame:
    """Calls per layer (MPI-IO, HDF5, POSIX) and their total, from the counts of the signatures; nothing is decoded."""
    named = F.when(F.col("category") == MPIIO, "MPI-IO").when(F.col("category") == HDF5, "HDF5").when(F.col("category") == POSIX, "POSIX")
    # one pass: the layer and the total are two levels of one rollup
    per = signatures.filter(named.isNotNull()).select(named.alias("layer"), "count")
    return per.rollup("layer").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_calls")).select(F.coalesce("layer", F.lit("Total")).alias("layer"), "n_calls")


def function_counts(signatures: DataFrame) -> DataFrame:
    """Unique signatures and calls of every function."""
    return signatures.groupBy("func_id", "func").agg(F.count("*").alias("n_signatures"), F.sum("count").alias("n_calls"))


def signature_listing(signatures: DataFrame) -> DataFrame:
    """Each signature as text, with its count."""
    text = F.concat("func", F.lit("( "), F.concat_ws(" ", "args"), F.lit(" )"))
    return signatures.select("rank", "terminal_id", text.alias("signature"), F.col("count").alias("n_calls"))


def count_signatures(calls: DataFrame) -> DataFrame:
    """A signature table from calls: one row per rank, thread, function, level and arguments."""
    return calls.groupBy("rank", "tid", "func_id", "level", "args").agg(F.count("*").alias("count"), F.min("seq_id").alias("first_seq"))


def merge_signatures(signatures: DataFrame, width: int = 1) -> DataFrame:
    """Signatures of all ranks merged: counts added, the least rank and id kept, and numbered anew from 0 in that order."""
    key = ["tid", "func_id", "level", "args"]
    merged = signatures.groupBy(*key).agg(F.sum("count").alias("count"), F.min(F.struct("rank", "terminal_id")).alias("_first")).withColumn("_all", F.lit(0))
    merged = merged.withColumn("rank", F.col("_first.rank")).withColumn("_id", F.col("_first.terminal_id")).withColumn("_tie", F.xxhash64(*key))
    numbered = scan(merged, ["_all"], ["rank", "_id", "_tie"], {"terminal_id": ("sum", F.lit(1), False)}, width)
    return numbered.select("rank", "terminal_id", "count", *key)


def records_per_rank(calls: DataFrame) -> DataFrame:
    return calls.groupBy("rank").agg(F.count("*").alias("n_calls"))


def files_per_rank(calls: DataFrame, exclude: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Distinct files each rank touched with POSIX calls, without excluded prefixes."""
    path = path_of(F.col("func"), F.col("args"))
    rows = calls.filter(F.col("category") == POSIX).select("rank", path.alias("filename")).filter(path_accepted(F.col("filename"), exclude) & F.col("filename").startswith("/"))
    count = F.approx_count_distinct("filename") if approximate else F.count_distinct("filename")
    return rows.groupBy("rank").agg(count.alias("n_files"))


def file_modes(calls: DataFrame, ends: DataFrame | None = None, flag_abi: str = "linux") -> DataFrame:
    """Per file: its size, the open flags used, and whether it was read and written.

    The size is the highest byte that data calls touched (``offsets.file_ends``), null where there is none. Flags of a
    call are joined by `` | ``; a call without any is O_RDONLY. The modes of stream opens stand as they were given.
    """
    f, args = F.col("func"), F.col("args")
    rows = calls.filter((F.col("category") == POSIX) & ~any_of(f, ["dir", "MPI", "H5"])).select(path_of(f, args).alias("filename"), f.alias("func"), args.alias("args"))
    rows = rows.filter(F.col("filename").startswith("/"))
    number = F.when(F.col("func").isin("open", "open64"), F.get("args", F.lit(1)).try_cast("bigint"))
    names = F.filter(F.array(*[F.when(number.bitwiseAND(F.lit(v)) != 0, n) for n, v in OPEN_FLAGS[flag_abi].items()]), lambda x: x.isNotNull())
    flags = F.when(F.size(names) == 0, "O_RDONLY").otherwise(F.concat_ws(" | ", names))
    mode = F.when(F.col("func").isin("fopen", "fopen64", "fdopen"), F.get("args", F.lit(1))).when(number.isNotNull(), flags)
    rows = rows.select("filename", "func", mode.alias("mode"))
    out = rows.groupBy("filename").agg(
        F.concat_ws(", ", F.sort_array(F.collect_set("mode"))).alias("modes"),
        F.bool_or(F.col("func").contains("read")).alias("was_read"),
        F.bool_or(any_of(F.col("func"), ["write", "fprintf"])).alias("was_written"),
    )
    if ends is None:
        return out.withColumn("size", F.lit(None).cast("bigint"))
    return out.join(ends.select("filename", F.col("eof").alias("size")), "filename", "left")


def calls_per_layer(calls: DataFrame) -> DataFrame:
    return calls.groupBy(layer(F.col("func")).alias("layer")).agg(F.count("*").alias("n_calls"))


def metadata_counts(calls: DataFrame) -> DataFrame:
    return calls.filter(is_report_metadata_name(F.col("func"))).groupBy("func").agg(F.count("*").alias("n_calls"))


def size_histogram(calls: DataFrame) -> DataFrame:
    """Calls for each size of POSIX data calls."""
    size = io_size(F.col("func"), F.col("args"))
    return calls.select(size.alias("size")).filter("size is not null").groupBy("size").agg(F.count("*").alias("n_calls"))


def access_pattern(ranges: DataFrame, time: str = "tick", per_rank: bool = False, width: int = TICK_BLOCK) -> DataFrame:
    """Per file: consecutive, sequential and random steps between accesses that follow each other in time."""
    keys = ["filename", "rank"] if per_rank else ["filename"]
    rows = ranges.select("filename", "rank", "seq_id", time, F.col("offset").alias("a"), (F.col("offset") + F.col("count")).alias("z"))
    out = scan(rows, keys, [time, "rank", "seq_id"], {"_prev": ("last", F.col("z"), False)}, width).filter("_prev is not null")
    say = lambda c, n: F.sum(c.cast("bigint")).alias(n)
    p, a = F.col("_prev"), F.col("a")
    return out.groupBy(*keys).agg(say(p == a, "n_consecutive"), say(p < a, "n_sequential"), say(p > a, "n_random"))


def adjacent_overlaps(ranges: DataFrame, time: str = "tick", width: int = 1 << 24) -> DataFrame:
    """Overlaps between accesses that are neighbours by offset: filename, kind (RAR, RAW, WAR or WAW: later after earlier), same_rank."""
    rows = ranges.select("filename", "rank", "seq_id", F.col(time).alias("t"), F.col("offset").alias("a"), (F.col("offset") + F.col("count")).alias("z"), "is_read")
    me = F.struct("t", "rank", "seq_id", "z", "is_read")
    out = scan(rows, ["filename"], ["a", "t", "rank", "seq_id"], {"_p": ("last", me, False)}, width).filter(F.col("_p.z") > F.col("a"))
    later_me = F.struct("t", "rank", "seq_id") >= F.struct("_p.t", "_p.rank", "_p.seq_id")
    later, earlier = F.when(later_me, F.col("is_read")).otherwise(F.col("_p.is_read")), F.when(later_me, F.col("_p.is_read")).otherwise(F.col("is_read"))
    letter = lambda c: F.when(c, "R").otherwise("W")
    return out.select("filename", F.concat(letter(later), F.lit("A"), letter(earlier)).alias("kind"), (F.col("rank") == F.col("_p.rank")).alias("same_rank"))


def overlap_flags(overlaps: DataFrame) -> DataFrame:
    """Per file, eight flags: which kinds of neighbouring overlaps it has within one rank and between ranks."""
    flags = [
        F.bool_or((F.col("kind") == k) & (F.col("same_rank") == F.lit(same))).alias(f"{k.lower()}_{'same' if same else 'other'}")
        for k in ("RAR", "RAW", "WAR", "WAW")
        for same in (True, False)
    ]
    return overlaps.groupBy("filename").agg(*flags)


def sessions(calls: DataFrame, width: int = 4096) -> DataFrame:
    """POSIX calls on files with ``session``: how often the rank has opened the file up to the call."""
    f = F.col("func")
    rows = calls.filter(F.col("category") == POSIX).withColumn("filename", path_of(f, F.col("args"))).filter(F.col("filename").startswith("/"))
    opened = F.when(f.isin("open", "open64", "fopen", "fopen64", "fdopen"), 1).otherwise(0)
    return scan(rows, ["rank", "filename"], ["seq_id"], {"session": ("sum", opened, True)}, width)


def delta_times(calls: DataFrame, width: int = 4096) -> DataFrame:
    """Starts and ends as distances from the start of the rank's previous call, 0 before the first."""
    out = scan(calls, ["rank"], ["seq_id"], {"_prev": ("last", F.col("tick_start"), False)}, width)
    prev = F.coalesce("_prev", F.lit(0))
    return out.select("rank", "seq_id", (F.col("tick_start") - prev).alias("d_start"), (F.col("tick_end") - prev).alias("d_end"))


def absolute_times(deltas: DataFrame, resolution: float = 1e-7, width: int = 4096) -> DataFrame:
    """The reverse of ``delta_times``, with seconds."""
    out = scan(deltas, ["rank"], ["seq_id"], {"tick_start": ("sum", F.col("d_start"), True)}, width)
    end = F.col("tick_start") - F.col("d_start") + F.col("d_end")
    return out.select("rank", "seq_id", "tick_start", end.alias("tick_end"), (F.col("tick_start") * resolution).alias("tstart"), (end * resolution).alias("tend"))


def linear_offsets(signatures: DataFrame, min_ranks: int = 3) -> DataFrame:
    """Signatures of calls whose offset is a * r + b: the k-th signature of a function in each rank of a group is one series.

    ``signatures`` has rank, terminal_id, func and offset. The ranks with as many signatures of the function form a group,
    and r is a rank's place in its group, from 0; rank numbers may have holes. A series counts if its group has at least
    min_ranks ranks and all of them lie on the line through the first two. A null offset takes its place but lies on no
    line. Null ranks are left out. Each group gives rows of its own, so a function and k may occur more than once.
    """
    own = scan(signatures.filter("rank is not null").withColumn("_f", F.col("func")), ["rank", "_f"], ["terminal_id"], {"k": ("sum", F.lit(1), False)}, 1 << 20)
    per = own.groupBy("rank", "func").agg(F.count("*").alias("_n"))
    own = own.join(scan(per, ["func", "_n"], ["rank"], {"_r": ("sum", F.lit(1), False)}, 1 << 20), ["rank", "func"])
    series = ["func", "_n", "k"]
    at = lambda r: F.max(F.when(F.col("_r") == r, F.col("offset")))
    line = own.groupBy(*series).agg(F.try_subtract(at(1), at(0)).alias("a"), at(0).alias("b"), F.count("*").alias("n_ranks")).filter(F.col("n_ranks") >= min_ranks)
    on_line = F.col("offset") == F.try_add(F.try_multiply(F.col("a"), F.col("_r")), F.col("b"))
    fits = own.join(line, series).groupBy(*series, "a", "b", "n_ranks").agg(F.bool_and(F.coalesce(on_line, F.lit(False))).alias("_fits"))
    return fits.filter("_fits").select("func", "k", "a", "b", "n_ranks")


def offsets_over_ranks(ranges: DataFrame, first_files: int = 12) -> DataFrame:
    """The report's series of offsets: time, rank, offset and kind for the first files by name."""
    names = ranges.select("filename").distinct().orderBy("filename").limit(first_files)
    return ranges.join(F.broadcast(names), "filename", "left_semi").select("filename", "rank", "tick", "offset", "count", "is_read")


def io_activity(calls: DataFrame) -> DataFrame:
    """The report's time lines: begin and end of every read and write of a rank, MPI-IO and HDF5 left out."""
    f = F.col("func")
    kinds = F.array_compact(F.array(F.when(any_of(f, ["write", "fprintf"]), "write"), F.when(f.contains("read"), "read")))
    return calls.filter(~any_of(f, ["MPI", "H5"])).select("rank", "seq_id", F.explode(kinds).alias("kind"), "tick_start", "tick_end")


def offsets_over_time(found: DataFrame, calls: DataFrame, first_files: int = 12) -> DataFrame:
    """The report's series of offsets against time: where each access of the first files by name begins and ends, and when."""
    names = found.select("filename").distinct().orderBy("filename").limit(first_files)
    ends = calls.select("rank", "seq_id", "tick_end")
    rows = found.join(F.broadcast(names), "filename", "left_semi").join(ends, ["rank", "seq_id"])
    return rows.select("filename", "rank", "seq_id", F.col("tick").alias("from_tick"), F.col("tick_end").alias("to_tick"), F.col("offset").alias("from_byte"), (F.col("offset") + F.col("count")).alias("to_byte"))
