"""Schemas of trace tables."""

from __future__ import annotations

from pyspark.sql import types as T

RECORDS = T.StructType(
    [
        T.StructField("rank", T.IntegerType()), T.StructField("seq_id", T.LongType()), T.StructField("tid", T.LongType()), T.StructField("terminal_id", T.IntegerType()),
        T.StructField("func_id", T.ShortType()), T.StructField("func", T.StringType()), T.StructField("category", T.IntegerType()), T.StructField("level", T.IntegerType()),
        T.StructField("tick_start", T.LongType()), T.StructField("tick_end", T.LongType()), T.StructField("tstart", T.DoubleType()), T.StructField("tend", T.DoubleType()),
        T.StructField("arg_count", T.IntegerType()), T.StructField("args", T.ArrayType(T.StringType())),
    ]
)
SIGNATURES = T.StructType(
    [
        T.StructField("rank", T.IntegerType()), T.StructField("terminal_id", T.IntegerType()), T.StructField("count", T.LongType()), T.StructField("tid", T.LongType()),
        T.StructField("func_id", T.ShortType()), T.StructField("level", T.IntegerType()), T.StructField("args", T.ArrayType(T.StringType())),
    ]
)
GRAMMAR = T.StructType([T.StructField("ug_id", T.IntegerType()), T.StructField("rule_id", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("val", T.IntegerType()), T.StructField("exp", T.IntegerType())])
GRAMMAR_OF_RANK = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("ug_id", T.IntegerType())])
FUNCTIONS = T.StructType([T.StructField("func_id", T.ShortType()), T.StructField("name", T.StringType()), T.StructField("category", T.IntegerType())])
METADATA = T.StructType(
    [
        T.StructField("total_ranks", T.IntegerType()), T.StructField("start_ts", T.DoubleType()), T.StructField("time_resolution", T.DoubleType()),
        T.StructField("ts_buffer_elements", T.IntegerType()), T.StructField("ts_compression_algo", T.IntegerType()), T.StructField("interprocess_compression", T.IntegerType()),
    ]
)
TABLES = {"records": RECORDS, "cst": SIGNATURES, "cfg": GRAMMAR, "ug": GRAMMAR_OF_RANK, "functions": FUNCTIONS, "meta": METADATA}
