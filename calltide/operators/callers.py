"""Nesting of calls: levels, callers, and what kind of caller metadata operations have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.functions.facts import is_metadata_name
from calltide.operators.offsets import TICK_BLOCK
from calltide.operators.sequence import scan

#: The functions of the caller report, in its order.
CALLER_REPORT = (
    "__xstat", "__xstat64", "__lxstat", "__lxstat64", "__fxstat", "__fxstat64",
    "mmap", "getcwd", "mkdir", "chdir", "opendir", "readdir", "closedir",
    "umask", "unlink", "readlink", "access",
    "ftruncate", "fileno", "faccessat",
)


def derive_levels(calls: DataFrame, width: int = TICK_BLOCK) -> DataFrame:
    """calls with ``depth``: how many calls of the thread were entered and not yet left when the call began.

    Entering is +1 and leaving -1 in time order; a call that ends where another begins has been left. Calls without an
    end count as ending where they begin.
    """
    end = F.greatest(F.coalesce("tick_end", "tick_start"), F.col("tick_start"))
    moves = calls.select("rank", "tid", "seq_id", F.explode(F.array(F.struct(F.col("tick_start").alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d")))).alias("m"))
    # leaving comes before entering at one moment, but a call of no length is entered first
    moves = moves.select("rank", "tid", "seq_id", F.col("m.t").alias("t"), F.col("m.d").alias("d"))
    moves = moves.join(calls.select(F.col("rank").alias("_r"), F.col("seq_id").alias("_s"), (end == F.col("tick_start")).alias("_point")), (F.col("rank") == F.col("_r")) & (F.col("seq_id") == F.col("_s")))
    moves = moves.withColumn("o", F.when(F.col("_point"), F.when(F.col("d") > 0, 1).otherwise(2)).when(F.col("d") < 0, 0).otherwise(3))
    # point calls are entered and left between the leaving and the entering of others
    seq = F.when(F.col("o").isin(1, 2), F.col("seq_id") * 2 + F.col("o")).otherwise(F.col("seq_id"))
    moves = moves.withColumn("_g", F.when(F.col("o") == 0, 0).when(F.col("o") == 3, 2).otherwise(1)).withColumn("_q", seq)
    depth = scan(moves, ["rank", "tid"], ["t", "_g", "_q"], {"depth": ("sum", F.col("d"), False)}, width).filter("d > 0")
    return calls.join(depth.select("rank", "seq_id", "depth"), ["rank", "seq_id"], "left")


def with_caller(calls: DataFrame, width: int = 4096) -> DataFrame:
    """calls with ``caller``: the function of the last call one level up in its thread, null at level 0."""
    # each call stands in two lanes: as a callee in its own level's, as a possible caller in the next level's
    lanes = F.array(F.struct(F.col("level").alias("at"), F.lit(False).alias("up")), F.struct((F.col("level") + 1).alias("at"), F.lit(True).alias("up")))
    rows = calls.withColumn("_lane", F.explode(lanes)).withColumn("_at", F.col("_lane.at")).withColumn("_up", F.col("_lane.up")).drop("_lane")
    out = scan(rows, ["rank", "tid", "_at"], ["seq_id"], {"_p": ("last", F.when(F.col("_up"), F.struct(F.col("func").alias("f"))), False)}, width)
    return out.filter("not _up").withColumn("caller", F.when(F.col("level") > 0, F.col("_p.f"))).drop("_at", "_up", "_p")


def caller_codes(calls: DataFrame, width: int = 4096) -> DataFrame:
    """func and code of every metadata operation: 3 if the application ever called it, else 2 for HDF5, 1 for MPI, 0 for others."""
    caller = F.col("caller")
    code = F.when(caller.isNull(), 3).when(caller.contains("H5"), 2).when(caller.contains("MPI"), 1).otherwise(0)
    meta = with_caller(calls, width).filter(is_metadata_name(F.col("func")))
    return meta.groupBy("func").agg(F.max(code).alias("code"))


def caller_report(spark: SparkSession, codes: DataFrame, functions: tuple[str, ...] = CALLER_REPORT) -> DataFrame:
    """The codes of a fixed list of functions, in its order; 0 for those that don't occur."""
    listed = spark.createDataFrame(list(enumerate(functions)), "place int, func string")
    return listed.join(codes, "func", "left").select("place", "func", F.coalesce("code", F.lit(0)).alias("code"))


def tracks_levels(calls: DataFrame) -> bool:
    """Whether any call has a level above 0; without, callers have to come from ``derive_levels``."""
    return bool(calls.filter("level > 0").take(1))


