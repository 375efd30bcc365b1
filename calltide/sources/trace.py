"""Spark source and sink of binary trace directories.

    spark.dataSource.register(TraceSource)
    spark.read.format("calltide").option("table", "records").load(folder)

Tables: records, cst, cfg, ug, functions and meta. Records are read with one partition per rank, or several where it has very many
calls; a filter on rank skips the other ranks' files.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from calltide.operators.sequence import scan
from calltide.operators.stats import merge_signatures
from calltide.runtime import cut, together
from calltide.schema import TABLES
from calltide.sources import layout as L


#: Ending of a rank's own grammar until equal ones are shared.
OWN_GRAMMAR = ".own"


#: Calls of a rank that one task decodes. Times are distances, so a later part first sums up those before it (8 bytes a call).
CALLS_PER_TASK = 1 << 26
TIME_BYTES = 8


#: Calls, and ranks or grammars, that a task reads one after another where each of them is short.
CALLS_TOGETHER, FILES_TOGETHER = 1 << 18, 1024


class RankPartition(InputPartition):
    """Parts (number, start, stop) that one task reads; the number is a rank or a grammar."""

    def __init__(self, parts: list[tuple[int, int, int | None]]):
        super().__init__(parts)


def _grouped(parts: list[tuple[int, int, int | None]], calls: int = CALLS_TOGETHER) -> list[RankPartition]:
    """Parts in tasks: neighbours share one up to so many calls and FILES_TOGETHER parts."""
    out, held = [], 0
    for p in parts:
        n = max(1, (p[2] or 0) - p[1])
        if out and held + n <= calls and len(out[-1]) < FILES_TOGETHER:
            out[-1].append(p)
            held += n
        else:
            out.append([p])
            held = n
    return [RankPartition(p) for p in out]


class TraceReader(DataSourceReader):
    def __init__(self, path: str, table: str, calls_per_task: int = CALLS_PER_TASK):
        self.path, self.table, self.calls_per_task, self.ranks = path, table, calls_per_task, None

    def pushFilters(self, filters):  # noqa: N802
        """Equality on rank prunes partitions; every filter is applied again by Spark."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("rank",) else set(f.value) if isinstance(f, In) and f.attribute == ("rank",) else None
            if wanted is not None:
                self.ranks = wanted if self.ranks is None else self.ranks & wanted
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        meta = L.read_metadata(L.Folder(self.path))
        if self.table in ("meta", "functions", "ug"):
            return [RankPartition([(0, 0, None)])]
        if self.table == "cst" and meta.interprocess_compression:
            return [RankPartition([(0, 0, None)])]
        if self.table == "cfg":
            return _grouped([(g, 0, None) for g in sorted(set(grammar_numbers(L.Folder(self.path), meta)))])
        wanted = [r for r in range(meta.total_ranks) if self.ranks is None or r in self.ranks]
        if self.table != "records":
            return _grouped([(r, 0, None) for r in wanted])
        sizes = L.Folder(self.path).sizes()
        parts = []
        for r in wanted:
            n = sizes.get(f"{r}.ts", 0) // TIME_BYTES
            parts += [(r, a, min(n, a + self.calls_per_task)) for a in range(0, max(n, 1), self.calls_per_task)]
        return _grouped(parts, min(self.calls_per_task, CALLS_TOGETHER))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        folder = L.Folder(self.path)
        meta = L.read_metadata(folder)
        schema = to_arrow_schema(TABLES[self.table])
        if self.table == "records":
            numbers = grammar_numbers(folder, meta)
            for rank, start, stop in partition.value:
                yield from decode(folder, meta, rank, numbers[rank], schema, start, stop)
            return
        rows = [row for n, _, _ in partition.value for row in self._rows(folder, meta, n)]
        columns = list(zip(*rows)) if rows else [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    def _rows(self, folder: L.Folder, meta: L.Metadata, n: int) -> list[tuple]:
        if self.table == "meta":
            return [meta.row()]
        if self.table == "functions":
            return [(i, name, meta.category(i)) for i, name in enumerate(meta.functions)]
        if self.table == "ug":
            return list(enumerate(grammar_numbers(folder, meta)))
        if self.table == "cst":
            return [(r if meta.interprocess_compression else n, t, c, tid, f, lv, args) for t, r, c, tid, f, lv, args in L.read_signatures(folder, f"{n}.cst")]
        return [(n, rule, k, int(v), int(e)) for rule, body in L.read_grammar(folder, f"{n}.cfg").items() for k, (v, e) in enumerate(body)]


def grammar_numbers(folder: L.Folder, meta: L.Metadata) -> list[int]:
    """The grammar of each rank: its own number, or what ug.mt says."""
    if not meta.interprocess_compression:
        return list(range(meta.total_ranks))
    return list(struct.unpack_from(f"<{meta.total_ranks}i", folder.read("ug.mt")))


def _time_before(ts: Any, calls: int) -> int:
    """The start of the last of the first ``calls`` calls; the file is then at the next."""
    total = 0
    while calls > 0:
        n = min(calls, 1 << 22)
        total += int(np.frombuffer(ts.read(TIME_BYTES * n), "<u4").reshape(-1, 2)[:, 0].sum(dtype=np.int64))
        calls -= n
    return total


#: The signatures read last by this process: ranks of a trace with merged signatures share them.
_KEPT: dict[tuple, tuple[dict[str, pa.Array], np.ndarray]] = {}


def _signature_columns(folder: L.Folder, name: str, meta: L.Metadata) -> tuple[dict[str, pa.Array], np.ndarray]:
    """The columns of a record that its signature gives, and each terminal id's place in them."""
    key = (folder.path, *folder.state(name))
    if key not in _KEPT:
        signatures = L.read_signatures(folder, name)
        table = {
            "tid": pa.array([s[3] for s in signatures], pa.int64()),
            "func_id": pa.array([s[4] for s in signatures], pa.int16()),
            "func": pa.array([(s[6][1] if len(s[6]) > 1 else None) if s[4] == L.USER_FUNCTION_ID else meta.functions[s[4]] for s in signatures], pa.string()),
            "category": pa.array([meta.category(s[4]) for s in signatures], pa.int32()),
            "level": pa.array([s[5] for s in signatures], pa.int32()),
            "arg_count": pa.array([len(s[6]) for s in signatures], pa.int32()),
            "args": pa.array([s[6] for s in signatures], pa.list_(pa.string())),
        }
        lookup = np.zeros(max((s[0] for s in signatures), default=0) + 1, np.int64)
        for k, s in enumerate(signatures):
            lookup[s[0]] = k
        _KEPT.clear()
        _KEPT[key] = table, lookup
    return _KEPT[key]


def decode(folder: L.Folder, meta: L.Metadata, rank: int, number: int, schema: pa.Schema, first: int = 0, stop: int | None = None) -> Iterator[pa.RecordBatch]:
    """The records of one rank from number ``first`` to ``stop``, in chunks. Times are those of the rank itself, with merged signatures too."""
    table, lookup = _signature_columns(folder, f"{0 if meta.interprocess_compression else rank}.cst", meta)
    rules, seq = L.read_grammar(folder, f"{number}.cfg"), first
    with folder.open(f"{rank}.ts") as ts:
        if ts.size() < TIME_BYTES * L.expanded_length(rules):
            raise ValueError(f"rank {rank} has fewer times than calls")
        base = _time_before(ts, first)
        for ids in L.expand(rules, start=first, stop=stop):
            n = len(ids)
            d = np.frombuffer(ts.read(TIME_BYTES * n), "<u4").reshape(-1, 2).astype(np.int64)
            start = base + np.cumsum(d[:, 0])
            end = start - d[:, 0] + d[:, 1]
            base = int(start[-1])
            rows = pa.array(lookup[ids])
            whole = {
                **{c: a.take(rows) for c, a in table.items()},
                "rank": pa.array(np.full(n, rank, np.int32)), "seq_id": pa.array(np.arange(seq, seq + n)), "terminal_id": pa.array(ids.astype(np.int32)),
                "tick_start": pa.array(start), "tick_end": pa.array(end),
                "tstart": pa.array(start * meta.time_resolution), "tend": pa.array(end * meta.time_resolution),
            }
            seq += n
            yield pa.RecordBatch.from_arrays([whole[f.name].cast(f.type) for f in schema], schema=schema)


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "calltide"

    def _table(self) -> str:
        table = self.options.get("table", "records")
        if table not in TABLES:
            raise ValueError(f"no table {table}")
        return table

    def schema(self):
        return TABLES[self._table()]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return TraceReader(self.options["path"], self._table(), int(self.options.get("callsPerTask", CALLS_PER_TASK)))


def read_trace(spark: SparkSession, path: str, table: str = "records") -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TraceSource)
    return spark.read.format("calltide").option("path", path).option("table", table).load()


def _encode(path: str, with_ids: bool):
    """Write .ts, .cfg and (without given ids) .cst of each rank from rows sorted by rank and seq_id. A rank's signatures and
    its grammar are held; rows aren't, and times go straight into their file."""

    class Rank:
        def __init__(self, rank: int):
            self.rank, self.calls, self.last = rank, 0, 0
            self.keys: dict[bytes, int] = {}
            self.counts: list[int] = []
            self.grammar = L.Sequence()
            self.times = L.Folder(path).create(f"{rank}.ts")

        def add(self, rows: pd.DataFrame) -> None:
            start, end = rows["tick_start"].to_numpy(np.int64), rows["tick_end"].to_numpy(np.int64)
            before = np.concatenate([[self.last], start[:-1]])
            d = np.stack([start - before, end - before], 1)
            if d.min() < 0 or d.max() >= 1 << 32:
                raise OverflowError(f"rank {self.rank}: a time is before the previous start, or too far from it for 32 bits")
            self.last = int(start[-1])
            self.times.write(d.astype("<u4").tobytes())
            self.calls += len(rows)
            for i in rows["_merged"].tolist() if with_ids else map(self.signature, rows["tid"], rows["func_id"], rows["level"], rows["args"]):
                self.grammar.append(i)

        def signature(self, tid: int, func_id: int, level: int, args: list | None) -> int:
            key = L.pack_key(int(tid), int(func_id), int(level), [] if args is None else list(args))
            i = self.keys.setdefault(key, len(self.counts))
            if i == len(self.counts):
                self.counts.append(0)
            self.counts[i] += 1
            return i

        def close(self) -> tuple[int, str, int]:
            self.times.close()
            folder, grammar = L.Folder(path), L.pack_grammar(self.grammar.rules())
            folder.write(f"{self.rank}{OWN_GRAMMAR}" if with_ids else f"{self.rank}.cfg", grammar)
            if not with_ids:
                folder.write(f"{self.rank}.cst", L.pack_signatures([(t, self.rank, self.counts[t], k) for k, t in self.keys.items()]))
            return self.rank, hashlib.sha256(grammar).hexdigest(), self.calls

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one: Rank | None = None
        table = lambda done: pd.DataFrame(done, columns=["rank", "grammar", "n_calls"])
        for b in batches:
            done = []
            for r, rows in b.groupby("rank", sort=False):
                if one is None or r != one.rank:
                    if one is not None:
                        done.append(one.close())
                    one = Rank(int(r))
                one.add(rows)
            if done:
                yield table(done)
        if one is not None:
            yield table([one.close()])

    return run


def _stream(rows: DataFrame, order: str, path: str, name: str, head: bytes, pack: Callable[[Any], bytes], foot: bytes = b"") -> None:
    """One file with the rows in order, written by one task that holds a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with L.Folder(path).create(name) as f:
            f.write(head)
            for b in batches:
                f.write(b"".join(pack(r) for r in b.to_dict("records")))
            f.write(foot)
        yield pd.DataFrame({"done": [True]})

    rows.repartition(1).sortWithinPartitions(order).mapInPandas(run, "done boolean").collect()


def _share_grammars(done: DataFrame, path: str) -> None:
    """Keep one file of each distinct grammar, under its number; ranks are given numbers by ug.mt.

    Numbers follow the lowest rank that has the grammar. Copies are made before anything is deleted, and again if a task
    is repeated, so no lost executor leaves a hole.
    """
    firsts = done.groupBy("grammar").agg(F.min("rank").alias("first")).withColumn("_all", F.lit(0))
    numbered = cut(scan(firsts, ["_all"], ["first"], {"number": ("sum", F.lit(1), False)}, 1 << 16).select("grammar", "first", F.col("number").cast("int").alias("number")), "grammars")

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = L.Folder(path)
        for b in batches:
            for first, number in zip(b["first"].tolist(), b["number"].tolist()):
                folder.write(f"{number}.cfg", folder.read(f"{first}{OWN_GRAMMAR}"))
            yield pd.DataFrame({"n": [len(b)]})

    def delete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = L.Folder(path)
        for b in batches:
            for r in b["rank"].tolist():
                if folder.exists(f"{r}{OWN_GRAMMAR}"):
                    folder.delete(f"{r}{OWN_GRAMMAR}")
            yield pd.DataFrame({"n": [len(b)]})

    # a small table is one task's, its files are many
    n_grammars = numbered.repartition(done.sparkSession.sparkContext.defaultParallelism).mapInPandas(copy, "n bigint").agg(F.sum("n")).first()[0] or 0
    ranks = done.join(numbered, "grammar").select("rank", "number")
    _stream(ranks, "rank", path, "ug.mt", b"", lambda r: struct.pack("<i", r["number"]), struct.pack("<i", n_grammars))
    done.select("rank").mapInPandas(delete, "n bigint").agg(F.sum("n")).first()


def write_trace(records: DataFrame, path: str, functions: Sequence[str], merge_ranks: bool = False, start_ts: float = 0.0, resolution: float = 1e-7, metadata_name: str = "trace.mt") -> DataFrame:
    """Write records (rank, seq_id, tid, func_id, level, args, tick_start, tick_end) as a trace directory in a shared folder.

    Ranks are numbered from 0; seq_id gives the order. With merge_ranks all ranks share one signature table and equal
    grammars are stored once. Returns rank, grammar (digest) and n_calls. Starts have to rise within a rank. Every rank's
    files are written whole under their own names, so a repeated task replaces them; all files are written by executors.
    """
    rows = records.select("rank", "seq_id", F.coalesce("tid", F.lit(0)).cast("bigint").alias("tid"), "func_id", F.coalesce("level", F.lit(0)).alias("level"), "args", "tick_start", F.coalesce("tick_end", "tick_start").alias("tick_end"))
    if merge_ranks:
        key = ["tid", "func_id", "level", "args"]
        own = rows.groupBy("rank", *key).agg(F.count("*").alias("count"), F.min("seq_id").cast("int").alias("terminal_id"))
        merged = cut(merge_signatures(own), "merged-signatures")
        on = [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in key]
        rows = rows.alias("r").join(merged.alias("m"), on).select("r.*", F.col("m.terminal_id").alias("_merged"))

        def packed(r: dict) -> bytes:
            args = r["args"] if r["args"] is not None else []
            return L.pack_signature(int(r["terminal_id"]), int(r["rank"]), int(r["count"]), L.pack_key(int(r["tid"]), int(r["func_id"]), int(r["level"]), list(args)))

        _stream(merged, "terminal_id", path, "0.cst", struct.pack("<i", merged.count()), packed)
    ordered = together(rows, "rank").sortWithinPartitions("rank", "seq_id")
    done = cut(ordered.mapInPandas(_encode(path, merge_ranks), "rank int, grammar string, n_calls bigint"), "written-ranks")
    n = (done.agg(F.max("rank")).first()[0] or 0) + 1 if done.take(1) else 0
    if merge_ranks:
        _share_grammars(done, path)
    L.write_metadata(L.Folder(path), L.Metadata(n, start_ts, resolution, 0, 0, int(merge_ranks), list(functions)), metadata_name)
    return done


def grammar_statistics(cfg: DataFrame, ug: DataFrame) -> DataFrame:
    """One row: ranks, distinct grammars, and numbers stored with and without sharing equal grammars."""
    size = cfg.groupBy("ug_id").agg((F.count("*") * 2 + F.count_distinct("rule_id") * 2 + 1).alias("ints"))
    per = ug.join(size, "ug_id")
    unique = per.groupBy("ug_id").agg(F.max("ints").alias("ints"), F.count("*").alias("n"))
    return unique.agg(F.sum("n").alias("n_ranks"), F.count("*").alias("n_grammars"), F.sum(F.col("ints") * F.col("n")).alias("ints_before"), F.sum("ints").alias("ints_after"))


def expanded_lengths(cfg: DataFrame) -> DataFrame:
    """ug_id and how many calls each grammar stands for, without expanding it.

    Repetitions are multiplied down from the root rule; one round per level of nesting. Grammars have no cycles.
    """
    body = cut(cfg.select("ug_id", "rule_id", "val", F.col("exp").cast("bigint").alias("exp")), "rules")  # read in every round
    at = body.select("ug_id").distinct().select("ug_id", F.lit(L.ROOT_RULE).alias("rule_id"), F.lit(1).cast("bigint").alias("times"))
    parts = []
    while True:
        used = cut(body.join(at, ["ug_id", "rule_id"]).select("ug_id", "val", (F.col("exp") * F.col("times")).alias("times")), "rule-uses")
        parts.append(used.filter("val >= 0").groupBy("ug_id").agg(F.sum("times").alias("n")))
        at = used.filter("val < 0").groupBy("ug_id", F.col("val").alias("rule_id")).agg(F.sum("times").alias("times"))
        if not at.take(1):
            break
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("ug_id").agg(F.sum("n").alias("n_calls"))
