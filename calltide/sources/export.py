"""Traces as text, as Parquet tables and as timelines; reports as series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.functions.facts import USER_FUNCTION_ID, on_timeline
from calltide.runtime import together

#: Names of the categories on a timeline.
CATEGORY_NAMES = ("POSIX", "MPI-IO", "MPI", "HDF5", "USER")
MAX_ARGS = 10


def text_lines(records: DataFrame, resolution: float = 1e-7) -> DataFrame:
    """rank, seq_id and one line per call: start, end, name, level, category and arguments; those of user functions are left out."""
    digits = max(0, round(math.log10(1 / resolution)))
    number = lambda c: F.format_string(f"%.{digits}f", F.col(c))
    args = F.when(F.coalesce(F.col("func_id"), F.lit(0)) == USER_FUNCTION_ID, F.array().cast("array<string>")).otherwise(F.coalesce("args", F.array().cast("array<string>")))
    body = F.concat_ws("", F.transform(args, lambda a: F.concat(F.lit(" "), a)))
    line = F.concat(number("tstart"), F.lit(" "), number("tend"), F.lit(" "), "func", F.lit(" "), F.col("level").cast("string"), F.lit(" "), F.col("category").cast("string"), F.lit(" ("), body, F.lit(" )"))
    return records.select("rank", "seq_id", line.alias("line"))


def write_text(records: DataFrame, path: str, resolution: float = 1e-7) -> None:
    """One folder per rank, lines in order."""
    lines = text_lines(records, resolution)
    together(lines, "rank").sortWithinPartitions("rank", "seq_id").select("rank", "line").write.mode("overwrite").partitionBy("rank").text(path)


def parquet_columns(records: DataFrame) -> DataFrame:
    """The flat export: index, rank, thread_id, cat, tstart, tend, func_id (name), level, arg_count, args_1 to args_10.

    Missing arguments are empty, those after the tenth are left out, and user functions have none. index is the call's
    number in its rank, from 1.
    """
    user = F.coalesce(F.col("func_id"), F.lit(0)) == USER_FUNCTION_ID
    args = F.when(user, F.array().cast("array<string>")).otherwise(F.coalesce("args", F.array().cast("array<string>")))
    return records.select(
        (F.col("seq_id") + 1).alias("index"), "rank", F.col("tid").alias("thread_id"), F.col("category").alias("cat"), "tstart", "tend", F.col("func").alias("func_id"), "level",
        F.when(user, 0).otherwise(F.col("arg_count")).alias("arg_count"), *[F.coalesce(F.get(args, F.lit(i)), F.lit("")).alias(f"args_{i + 1}") for i in range(MAX_ARGS)],
    )


def write_parquet(records: DataFrame, path: str) -> None:
    parquet_columns(records).write.mode("overwrite").parquet(path)


def read_exported(spark: SparkSession, path: str) -> DataFrame:
    """A flat export back as records, with times in double and arguments as a list."""
    e = spark.read.parquet(path)
    args = F.slice(F.array(*[f"args_{i + 1}" for i in range(MAX_ARGS)]), 1, F.least(F.coalesce("arg_count", F.lit(0)), F.lit(MAX_ARGS)))
    return e.select("rank", (F.col("index") - 1).cast("bigint").alias("seq_id"), F.col("thread_id").cast("bigint").alias("tid"), F.col("func_id").alias("func"), F.col("cat").alias("category"), "level", F.col("tstart").cast("double").alias("tstart"), F.col("tend").cast("double").alias("tend"), "arg_count", args.alias("args"))


def timeline_events(records: DataFrame) -> DataFrame:
    """rank, seq_id and a JSON event for each call on the timeline: microseconds, with arguments by number."""
    name = F.get(F.array(*map(F.lit, CATEGORY_NAMES)), F.col("category"))
    event = F.struct(
        F.col("rank").alias("pid"), F.col("tid").alias("tid"), F.round(F.col("tstart") * 1e6, 3).alias("ts"), F.col("func").alias("name"), name.alias("cat"), F.lit("X").alias("ph"),
        F.round((F.col("tend") - F.col("tstart")) * 1e6, 3).alias("dur"), F.struct(F.coalesce("args", F.array().cast("array<string>")).alias("args")).alias("args"),
    )
    return records.filter(on_timeline(F.col("level"), F.col("category"))).select("rank", "seq_id", F.to_json(event).alias("event"))


def write_timeline(records: DataFrame, path: str) -> None:
    """One JSON document per rank folder: a header, comma-separated events and a footer, ready for trace viewers."""
    rows = timeline_events(records).withColumn("part", F.lit(1))
    ranks = rows.select("rank").distinct()
    head = ranks.select("rank", F.lit(-1).cast("bigint").alias("seq_id"), F.lit('{"traceEvents":[').alias("event"), F.lit(0).alias("part"))
    foot = ranks.select("rank", F.lit(2**62).alias("seq_id"), F.lit('{}],"displayTimeUnit":"ms"}').alias("event"), F.lit(2).alias("part"))
    line = F.when(F.col("part") == 1, F.concat("event", F.lit(","))).otherwise(F.col("event"))
    out = together(rows.unionByName(head).unionByName(foot), "rank").sortWithinPartitions("rank", "part", "seq_id")
    out.select("rank", line.alias("line")).write.mode("overwrite").partitionBy("rank").text(path)


def write_conflicts(lines: DataFrame, path: str) -> None:
    """Conflict lines under a header for each file."""
    head = lines.groupBy("file_idx", "filename").agg(F.lit(-1).cast("bigint").alias("seq1")).select("file_idx", F.lit(-1).alias("rank1"), "seq1", F.concat(F.lit("#"), "file_idx", F.lit(":"), "filename").alias("line"))
    out = head.unionByName(lines.select("file_idx", "rank1", "seq1", "line"))
    out.repartitionByRange("file_idx").sortWithinPartitions("file_idx", "rank1", "seq1").select("line").write.mode("overwrite").text(path)


def read_conflicts(spark: SparkSession, path: str) -> DataFrame:
    """filename index, both accesses of every pair of a conflict text; all partners of a line count."""
    raw = spark.read.text(path).filter(~F.col("value").startswith("#"))
    split = raw.select(F.split_part("value", F.lit(":"), F.lit(1)).alias("one"), F.explode(F.split(F.split_part("value", F.lit(":"), F.lit(2)), " ")).alias("two"))
    get = lambda c, i: F.split_part(c, F.lit(","), F.lit(i))
    return split.select(*[get(F.col(c), i + 1).cast(t).alias(f"{n}{k}") for k, c in ((1, "one"), (2, "two")) for i, (n, t) in enumerate((("rank", "int"), ("seq", "bigint"), ("rw", "string"), ("fh", "string")))])


def read_prefixes(spark: SparkSession, path: str) -> list[str]:
    """Path prefixes, one per line; blank lines are left out. A list is a setting and small."""
    return [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]
