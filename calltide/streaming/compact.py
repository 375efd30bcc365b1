"""Problem 7: very many small files become few, each call once.

A file stream discovers every file once: its checkpoint logs which files belong to which batch before the batch runs,
so a batch that is retried after a failure reads the same files under the same number. Each batch overwrites the folder
named after its number, so a retry replaces what a lost attempt left. ``finish`` then finds the keys stored more than
once, whichever batches they came in, and writes the well-sized files. Rows aren't moved for that: the places of rows with
a repeated key are listed per staged file, and the task that copies a file looks into that file's list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as afs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltide.runtime import cut, drop_path, new_path, qualified, release, together


#: A file is taken however late it arrives; Spark's default leaves out what is a week older than the newest file.
MAX_FILE_AGE = "36500d"


def stage(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int | None = None, bytes_per_batch: int = 64 << 30, schema=None) -> int:
    """Copy all files of source not yet taken into target/batch=N, and return the number of batches taken so far.

    Call it again to take files that arrived since, whatever their modification time. A batch has up to ``files_per_batch`` files where that is given,
    else about ``bytes_per_batch`` of files. Rows are copied as they stand.
    """
    reader = spark.readStream.schema(schema or spark.read.parquet(source).schema).option("maxFileAge", MAX_FILE_AGE)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader.option("maxBytesPerTrigger", bytes_per_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():  # a stream's source is a folder
        reader, source = reader.option("pathGlobFilter", path.getName()), path.getParent().toString()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = reader.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return (query.lastProgress or {}).get("batchId", -1) + 1


#: Listed rows in one file of the list.
MARKS_PER_FILE = 1_000_000


class Marks:
    """For each staged file, which of its rows have a repeated key, and for how many rows each of them stands (0: it is left out)."""

    def __init__(self, path: str, parts: int):
        self.path, self.parts, self.file, self.known = path, parts, None, (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def of(self, file: int) -> tuple[np.ndarray, np.ndarray]:
        if file != self.file:
            fs, base = afs.FileSystem.from_uri(self.path)
            folder = f"{base}/part={file % self.parts}"
            if fs.get_file_info(folder).type == afs.FileType.NotFound:
                self.known = np.zeros(0, np.int64), np.zeros(0, np.int64)
            else:
                t = pq.read_table(folder, columns=["row", "copies"], filters=pc.field("file") == file, filesystem=fs, partitioning=None)
                order = np.argsort(t["row"].to_numpy())
                self.known = t["row"].to_numpy()[order], t["copies"].to_numpy()[order]
            self.file = file
        return self.known


def _listed(path: str, parts: int):
    """Rows with _file and _row become rows with _copies, without those that are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(path, parts)
        for b in batches:
            files, rows = b.column("_file").to_numpy(), b.column("_row").to_numpy()
            copies = np.ones(len(rows), np.int64)
            for file in np.unique(files).tolist():
                row, n = marks.of(file)
                if len(row):
                    own = np.flatnonzero(files == file)
                    at = np.minimum(np.searchsorted(row, rows[own]), len(row) - 1)
                    copies[own] = np.where(row[at] == rows[own], n[at], 1)
            names = [c for c in b.schema.names if c not in ("_file", "_row")]
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(copies)], names=[*names, "_copies"])
            yield out.filter(pa.array(copies > 0))

    return run


def finish(spark: SparkSession, staged: str, target: str, keys: Sequence[str], prefer: Sequence[Column], schema, file_bytes: int = 256 << 20) -> None:
    """Write target from the staged batches: each key once, with its number of stored rows in ``_copies``.

    The row that stands is the least by ``prefer``, then by a hash of its content, then by its place in the staged files.
    Only keys are shuffled, summed before the shuffle; rows are compared only for keys that occur more than once, and
    stay where they were read, however many those are. The number of files follows from the staged bytes. Written with
    overwrite, so a repeated call replaces the result.
    """
    rows = spark.read.schema(schema).parquet(f"{staged}/batch=*")
    path = spark._jvm.org.apache.hadoop.fs.Path(staged)
    total = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def same(other: str) -> list[Column]:
        return [F.col(f"r.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in keys]

    place = rows.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    repeated = cut(rows.groupBy(*keys).agg(F.count("*").alias("_copies")).filter("_copies > 1"), "repeated-keys")
    order = F.struct(*[c.alias(f"_by{i}") for i, c in enumerate(prefer)], F.xxhash64(*schema.names).alias("_content"), "_file", "_row")
    candidates = cut(place.select(*keys, order.alias("_order")).alias("r").join(repeated.alias("k"), same("k")).select("r.*", "k._copies"), "repeated-rows")
    best = candidates.groupBy(*keys).agg(F.min("_order").alias("_best"))
    stands = (F.col("r._order._file") == F.col("b._best._file")) & (F.col("r._order._row") == F.col("b._best._row"))
    marks = candidates.alias("r").join(best.alias("b"), same("b"))
    marks = marks.select(F.col("r._order._file").alias("file"), F.col("r._order._row").alias("row"), F.when(stands, F.col("r._copies")).otherwise(0).alias("copies"))
    parts = max(1, -(-candidates.count() // MARKS_PER_FILE))
    listed = new_path(spark, "row-list")
    together(marks.withColumn("part", F.pmod("file", F.lit(parts))), "part").sortWithinPartitions("file", "row").write.partitionBy("part").parquet(listed)
    result = place.mapInArrow(_listed(qualified(spark, listed), parts), T.StructType([*schema.fields, T.StructField("_copies", T.LongType())]))
    result.coalesce(max(1, -(-total // file_bytes))).write.mode("overwrite").parquet(target)
    drop_path(spark, listed)
    release(repeated, candidates)


def compact(
    spark: SparkSession,
    source: str,
    keys: Sequence[str],
    prefer: Sequence[Column],
    target: str | None = None,
    files_per_batch: int | None = None,
    bytes_per_batch: int = 64 << 30,
    file_bytes: int = 256 << 20,
) -> DataFrame:
    """Consolidate all files of source; the result is the consolidated table with the column ``_copies``.

    A null in a key counts as a value. A source with a column named ``_copies`` is refused. An empty source table gives
    an empty table.
    """
    schema = spark.read.parquet(source).schema
    if "_copies" in schema.names:
        raise ValueError("the source has a column named _copies")
    work = new_path(spark, "compaction")
    target = target or f"{work}/table"
    stage(spark, source, f"{work}/staged", f"{work}/checkpoint", files_per_batch, bytes_per_batch, schema)
    finish(spark, f"{work}/staged", target, keys, prefer, schema, file_bytes)
    drop_path(spark, f"{work}/staged")
    return spark.read.parquet(target)
