"""Running summaries over live calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CURSOR_STATE = T.StructType([T.StructField("end", T.LongType()), T.StructField("ranks", T.ArrayType(T.IntegerType())), T.StructField("cursors", T.ArrayType(T.LongType()))])
CURSOR_OUT = "filename string, rank int, seq_id bigint, tick bigint, offset bigint, count bigint, is_read boolean"


def stream_folder(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream; a single file is the only one of its folder."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        reader, path = reader.option("pathGlobFilter", p.getName()), p.getParent().toString()
    return reader.parquet(path)


def function_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    """Running number of calls and microseconds by function, rank or layer."""
    return calls.groupBy(*by).agg(F.count("*").alias("n_calls"), F.coalesce(F.sum("duration_us"), F.lit(0)).alias("total_us"))


def rates(calls: DataFrame, time: str, by: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Calls and bytes per window of event time; in append mode rows later than ``late`` are left to ``quarantine``, in complete mode all count."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return calls.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n_calls"), F.sum("bytes").alias("bytes"))


def bursts(calls: DataFrame, time: str, by: list[str], pause: str, late: str = "1 hour") -> DataFrame:
    """Runs of calls without a pause longer than ``pause``."""
    return calls.withWatermark(time, late).groupBy(F.session_window(time, pause).alias("w"), *by).agg(F.count("*").alias("n_calls"))


def quarantine(batch: DataFrame, time: str, seen_up_to, late_seconds: int) -> tuple[DataFrame, DataFrame]:
    """A batch split into rows in time and late rows, for foreachBatch."""
    limit = F.lit(seen_up_to).cast("timestamp") - F.make_interval(secs=F.lit(late_seconds))
    late: Column = F.coalesce(F.col(time) < limit, F.lit(False))
    return batch.filter(~late), batch.filter(late)


def live_offsets(events: DataFrame) -> DataFrame:
    """Offsets of data calls from a stream of cursor events (``offsets.cursor_events``), which come in time order per file.

    The state of a file is its end and its ranks' cursors.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end, ranks, cursors = state.get if state.exists else (0, [], [])
        at = dict(zip(ranks or [], cursors or []))
        rows = pd.concat(list(batches)).sort_values(["tick", "rank", "seq_id"]).assign(filename=key[0])
        placed, moved = [], []
        for rank, kind, amount, place in zip(rows["rank"].tolist(), rows["kind"].tolist(), rows["amount"].tolist(), rows["at"].tolist()):
            offset = None
            if kind == "data":
                offset = at.get(rank, 0)
                at[rank] = offset + amount
            elif kind == "at":
                offset = None if place != place or place is None else int(place)
            else:
                at[rank] = at.get(rank, 0) + amount if kind == "move" else amount if kind == "set" else end if kind == "end" else 0
            if offset is not None:
                end = max(end, offset + amount)
                placed.append(offset)
            moved.append(offset is not None)
        state.update((end, list(at), list(at.values())))
        out = rows[np.array(moved, bool)]
        yield out.assign(offset=np.array(placed, np.int64), count=out["amount"])[["filename", "rank", "seq_id", "tick", "offset", "count", "is_read"]]

    return events.groupBy("filename").applyInPandasWithState(step, CURSOR_OUT, CURSOR_STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; complete results replace the table at path with every batch, appended ones add to it
    under their batch number, so a repeated batch replaces its rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
