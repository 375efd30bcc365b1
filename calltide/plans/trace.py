"""Queries of the trace operators over the tables of calls, signatures and byte ranges, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.functions import facts
from calltide.functions.names import plain_name, plain_name_sql
from calltide.operators import callers, conflicts, happens_before, mpi, offsets, stats
from calltide.operators.calls import distinct_rows
from calltide.operators.sequence import scan
from calltide.runtime import cut, new_path, qualified
from calltide.sources import export, trace
from calltide.streaming import live

EXCLUDED = ("/dev/", "/proc/", "/lus/mesh/halo")
_text = lambda c: F.concat_ws(",", c)


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/function_list.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded calls, each (rank, seq_id) once, with the function's listed name."""
    rows = spark.read.parquet(f"{sf_dir}/records.parquet")
    known = sum((F.col(c).isNotNull().cast("int") for c in ("terminal_id", "func_id", "func", "tick_end", "args")), F.lit(0))
    rows = distinct_rows(rows, ["rank", "seq_id"], [known.desc(), F.col("terminal_id"), F.col("func_id"), F.col("func"), F.col("tick_end")])
    f = functions(spark, sf_dir)
    ids = f.select(F.col("func_id").alias("_id"), F.col("name").alias("_name"))
    names = f.groupBy(plain_name(F.col("name")).alias("_plain")).agg(F.min("name").alias("_same"), F.min("func_id").alias("_same_id"))
    out = rows.join(F.broadcast(ids), F.col("func_id") == F.col("_id"), "left").join(F.broadcast(names), plain_name(F.col("func")) == F.col("_plain"), "left")
    out = out.withColumn("func", F.coalesce("_name", "_same", "func")).withColumn("func_id", F.coalesce("func_id", "_same_id"))
    return out.drop("_id", "_name", "_plain", "_same", "_same_id")


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures, each (rank, terminal_id) once, with the function's name and category."""
    rows = spark.read.parquet(f"{sf_dir}/cst.parquet")
    rows = distinct_rows(rows, ["rank", "terminal_id"], [F.col("count").desc_nulls_last(), F.col("func_id").asc_nulls_last(), F.col("level").asc_nulls_last()])
    f = functions(spark, sf_dir).select("func_id", F.col("name").alias("func"), "category")
    return rows.join(F.broadcast(f), "func_id", "left")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges with a whole-number time; those without offset, count or time, and repeated rows, are left out."""
    rows = spark.read.parquet(f"{sf_dir}/intervals.parquet").filter("`offset` is not null and `count` > 0 and tstart is not null and is_read is not null")
    return distinct_rows(rows, ["filename", "rank", "seq_id"], ["tstart", "offset", "count"]).withColumn("tick", F.floor(F.col("tstart") * 1e7 + 0.5).cast("bigint"))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges for conflicts, where neither time nor is_read has to be known; of repeated rows the one stands that ``ranges`` takes, if it takes any."""
    rows = spark.read.parquet(f"{sf_dir}/intervals.parquet").filter("`offset` is not null and `count` > 0")
    return distinct_rows(rows, ["filename", "rank", "seq_id"], [F.col("is_read").isNull() | F.col("tstart").isNull(), F.col("is_read").isNull(), F.col("tstart"), F.col("offset"), F.col("count")])


def a1_layer_totals(spark, d):
    return stats.layer_totals(signatures(spark, d))


def a1_layer_totals_rank0(spark, d):
    return stats.layer_totals(signatures(spark, d).filter("rank = 0"))


def a2_function_counts(spark, d):
    return stats.function_counts(signatures(spark, d))


def a3_signatures(spark, d):
    return stats.signature_listing(signatures(spark, d))


def a5_merged_signatures(spark, d):
    m = stats.merge_signatures(signatures(spark, d))
    return m.select("tid", "func_id", "level", _text("args").alias("args"), "count", "rank")


def a6_signature_counts(spark, d):
    return stats.count_signatures(calls(spark, d)).select("rank", "tid", "func_id", "level", _text("args").alias("args"), F.col("args").isNull().alias("no_args"), "count", "first_seq")


def a7_calls_per_rank(spark, d):
    return stats.records_per_rank(calls(spark, d))


def a8_files_per_rank(spark, d):
    return stats.files_per_rank(calls(spark, d), EXCLUDED)


def a9_file_modes(spark, d):
    c = calls(spark, d)
    return stats.file_modes(c, offsets.file_ends(offsets.intervals(c.filter("args is not null"))))


def a10_layers(spark, d):
    return stats.calls_per_layer(calls(spark, d))


def a11_metadata_counts(spark, d):
    return stats.metadata_counts(calls(spark, d))


def a12_sizes(spark, d):
    return stats.size_histogram(calls(spark, d))


def a13_overlap_flags(spark, d):
    return stats.overlap_flags(stats.adjacent_overlaps(ranges(spark, d)))


def a15_conflict_counts(spark, d):
    return conflicts.conflicts_per_access(conflicts.conflict_pairs(accesses(spark, d)))


def a18_function_signatures(spark, d):
    return signatures(spark, d).filter("func = 'pwrite'").groupBy("rank").agg(F.count_distinct("terminal_id").alias("n_signatures"))


def f1_accepted_paths(spark, d):
    return facts.filter_paths(calls(spark, d), EXCLUDED).select("rank", "seq_id", "func")


def f5_layers_on(spark, d):
    return facts.filter_layers(calls(spark, d), mpi=False, fcntl=False).select("rank", "seq_id", "func")


def f6_blanked(spark, d):
    c = facts.blank_out(calls(spark, d).filter("args is not null"), log_level=False)
    return c.select("rank", "seq_id", "tid", "level", _text("args").alias("args"))


def f7_function_flags(spark, d):
    n, c = F.col("name"), F.col("category")
    return functions(spark, d).select(
        "func_id", "name", facts.feeds_intervals(n, c).alias("feeds"), facts.is_data_name(n).alias("moves_data"), facts.is_metadata_name(n).alias("is_meta"),
        facts.is_report_metadata_name(n).alias("is_report_meta"), mpi.role(n).alias("role"), facts.layer(n).alias("layer"),
    )


def f10_timeline_calls(spark, d):
    return calls(spark, d).filter(facts.on_timeline(F.col("level"), F.col("category"))).select("rank", "seq_id")


def j1_named_calls(spark, d):
    """Calls joined with their signature and function."""
    s = signatures(spark, d).select("rank", "terminal_id", F.col("func").alias("sig_func"), F.col("count").alias("sig_count"))
    return calls(spark, d).filter("terminal_id is not null").select("rank", "seq_id", "terminal_id", "func").join(s, ["rank", "terminal_id"], "left")


def j2_conflicts(spark, d):
    return conflicts.conflict_pairs(accesses(spark, d))


def j3_collectives(spark, d):
    g = mpi.collectives(mpi.normalize(calls(spark, d)))
    return g.select("func", "comm", "handle", "k", F.size("members").cast("bigint").alias("n_members"), F.col("members")[0]["rank"].alias("first_rank"), F.col("members")[0]["seq_id"].alias("first_seq"))


def j6_completions(spark, d):
    return mpi.completions(mpi.normalize(calls(spark, d)))


def j7_communicators(spark, d):
    return mpi.communicators(calls(spark, d))


def j9_next_sync(spark, d):
    c = calls(spark, d)
    data = c.filter(facts.is_data_name(F.col("func")) & (F.col("category") == facts.POSIX)).select("rank", "seq_id")
    out = happens_before.nearest_calls(data, c, ("close", "fclose", "fsync"), True, "next_close")
    return happens_before.nearest_calls(out, c, ("open", "fopen"), False, "last_open")


def k1_depths(spark, d):
    return callers.derive_levels(calls(spark, d)).select("rank", "seq_id", "depth")


def k2_caller_codes(spark, d):
    return callers.caller_codes(calls(spark, d))


def k3_caller_report(spark, d):
    return callers.caller_report(spark, callers.caller_codes(calls(spark, d)))


def k10_text(spark, d):
    return export.text_lines(calls(spark, d))


def k11_export(spark, d):
    return export.parquet_columns(calls(spark, d))


def k12_timeline(spark, d):
    """Timeline events, written as JSON and read again."""
    event = F.from_json("event", "pid int, tid bigint, ts double, name string, cat string, ph string, dur double, args struct<args array<string>>")
    back = export.timeline_events(calls(spark, d)).select("rank", "seq_id", event.alias("e"))
    return back.select("rank", "seq_id", "e.pid", "e.tid", "e.ts", "e.name", "e.cat", "e.ph", "e.dur", _text("e.args.args").alias("args"))


def k13_conflict_lines(spark, d):
    return conflicts.conflict_lines(conflicts.conflict_pairs(accesses(spark, d))).drop("file_idx")


def k17_linear_offsets(spark, d):
    s = signatures(spark, d).filter(F.col("func").isin(*facts.OFFSET_ARGUMENTS)).withColumn("offset", facts.offset_of(F.col("func"), F.col("args")))
    return stats.linear_offsets(s.select("rank", "terminal_id", "func", "offset"))


def k17_order_lines(spark, d):
    """Lines among signatures made from orders: the k-th of eight ranks' orders each, shifted where one is urgent."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    at = F.col("o_orderkey") * 4096 + F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).otherwise(0)
    return stats.linear_offsets(o.select((F.col("o_orderkey") % 8).cast("int").alias("rank"), F.col("o_orderkey").alias("terminal_id"), F.lit("pwrite").alias("func"), at.alias("offset")))


def k18_offset_series(spark, d):
    return stats.offsets_over_ranks(ranges(spark, d))


def k18_io_activity(spark, d):
    return stats.io_activity(calls(spark, d))


def k18_offset_times(spark, d):
    return stats.offsets_over_time(o1_intervals(spark, d), calls(spark, d))


def m1_mpi_calls(spark, d):
    m = mpi.normalize(calls(spark, d))
    return m.withColumn("req", _text("req")).withColumn("tindx", _text("tindx"))


def o1_intervals(spark, d):
    """Byte ranges rebuilt from cursors, seeks and ends of files."""
    return offsets.intervals(calls(spark, d).filter("args is not null"))


def o2_handles(spark, d):
    c = offsets.attribute_handles(calls(spark, d).filter("args is not null"))
    return c.filter("category = 0").select("rank", "seq_id", "mpifh")


def o12_file_ends(spark, d):
    return offsets.file_ends(o1_intervals(spark, d))


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The calls as a binary trace with merged signatures; its folder.

    As the format wants, starts are raised where they fall, and calls without arguments have an empty list. A call without
    a start can't be written.
    """
    c = calls(spark, sf_dir).filter("tick_start is not null").withColumn("func_id", F.coalesce("func_id", F.lit(facts.USER_FUNCTION_ID))).withColumn("args", F.coalesce("args", F.array().cast("array<string>")))
    rising = scan(c, ["rank"], ["seq_id"], {"_prev": ("max", F.col("tick_start"), False)}, 4096)
    c = rising.withColumn("tick_start", F.greatest("tick_start", "_prev")).withColumn("tick_end", F.greatest("tick_end", "tick_start", "_prev")).drop("_prev")
    names = [r[0] for r in functions(spark, sf_dir).filter(f"func_id <> {facts.USER_FUNCTION_ID}").orderBy("func_id").select("name").collect()]
    path = qualified(spark, new_path(spark, "trace"))
    trace.write_trace(cut(c, "calls"), path, names, merge_ranks=True)
    return path


def s8_round_trip(spark, d):
    """Calls written as a binary trace and decoded again, row by row."""
    back = trace.read_trace(spark, _written(spark, d))
    return back.select("rank", "seq_id", "tid", "func_id", "category", "level", "tick_start", "tick_end", "arg_count", _text("args").alias("args"))


def s4_signature_table(spark, d):
    """The signature table of a written trace with merged signatures."""
    s = trace.read_trace(spark, _written(spark, d), "cst")
    return s.select("rank", "tid", "func_id", "level", _text("args").alias("args"), "count")


def a19_grammars(spark, d):
    """Ranks and distinct grammars of a written trace, and whether sharing them takes no more numbers."""
    path = _written(spark, d)
    g = trace.grammar_statistics(trace.read_trace(spark, path, "cfg"), trace.read_trace(spark, path, "ug"))
    return g.select("n_ranks", "n_grammars", (F.col("ints_after") <= F.col("ints_before")).alias("no_more"))


def s16_kernels(spark, d):
    """GPU kernels as calls, shown by their symbol; made from events, those of errors without an end."""
    e = spark.read.parquet(f"{d}/events.parquet")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1_704_067_200_000_000)) * 1000
    end = F.when(F.col("event_type") != "error", start + F.floor("value").cast("bigint") * 1000 + F.col("event_id") % 1000)
    k = e.select((F.col("user_id") % 8).cast("int").alias("rank"), F.col("event_id").alias("seq_id"), F.lit(0).cast("bigint").alias("tid"), F.concat(F.lit("kernel_"), "event_type").alias("name"), start.alias("start_ns"), end.alias("end_ns"))
    c = facts.kernel_calls(k)
    return c.select("rank", "seq_id", facts.function_name(F.col("func_id"), F.lit(None).cast("string"), F.col("args")).alias("func"), "category", "tick_start", "tick_end", "arg_count")


def s17_hdf5_names(spark, d):
    """Names behind the numbers of HDF5 datatype classes, property list classes and selection operators."""
    return facts.h5_names(calls(spark, d))


def x2_expanded_lengths(spark, d):
    """Calls of every rank, from the grammars alone."""
    path = _written(spark, d)
    return trace.read_trace(spark, path, "ug").join(trace.expanded_lengths(trace.read_trace(spark, path, "cfg")), "ug_id").select("rank", "n_calls")


def x4_absolute_times(spark, d):
    """Times after encoding as distances and decoding."""
    return stats.absolute_times(stats.delta_times(calls(spark, d)))


def st1_running_totals(spark, d):
    """Calls and time per function, computed as a stream over the exported rows."""
    rows = live.stream_folder(spark, f"{d}/export_records.parquet")
    from calltide.functions.values import duration, to_micros

    rows = rows.select("func_id", to_micros(duration(F.col("tstart"), F.col("tend"))).alias("duration_us"))
    path = new_path(spark, "stream")
    live.run_to_table(live.function_totals(rows, ["func_id"]), f"{path}/table", f"{path}/checkpoint", "complete")
    return spark.read.parquet(f"{path}/table")


def a2_rollup(spark, d):
    """Layers and functions in one pass."""
    return signatures(spark, d).rollup("category", "func").agg(F.sum("count").alias("n_calls"), F.count("*").alias("n_signatures"))


def w1_access_pattern(spark, d):
    return stats.access_pattern(ranges(spark, d))


def w1_access_pattern_per_rank(spark, d):
    return stats.access_pattern(ranges(spark, d), per_rank=True)


def w3_delta_times(spark, d):
    return stats.delta_times(calls(spark, d))


def w10_sessions(spark, d):
    return stats.sessions(calls(spark, d).filter("args is not null")).select("rank", "seq_id", "filename", "session")


def x6_categories(spark, d):
    f = functions(spark, d)
    firsts = f.agg(F.min(F.when(F.col("name").contains("MPI"), F.col("func_id"))), F.min(F.when(F.col("name").contains("H5"), F.col("func_id")))).first()
    return f.select("func_id", facts.category_of(F.col("func_id"), F.col("name"), firsts[0], firsts[1]).alias("category"))


_QUERIES = (
    a1_layer_totals, a1_layer_totals_rank0, a2_function_counts, a3_signatures, a5_merged_signatures, a6_signature_counts, a7_calls_per_rank,
    a8_files_per_rank, a9_file_modes, a10_layers, a11_metadata_counts, a12_sizes, a13_overlap_flags, a15_conflict_counts, a18_function_signatures,
    f1_accepted_paths, f5_layers_on, f6_blanked, f7_function_flags, f10_timeline_calls, j1_named_calls, j2_conflicts, j3_collectives, j6_completions,
    j7_communicators, j9_next_sync, k1_depths, k2_caller_codes, k3_caller_report, k10_text, k11_export, k12_timeline, k13_conflict_lines,
    k17_linear_offsets, k17_order_lines, k18_offset_series, k18_io_activity, k18_offset_times, m1_mpi_calls, o1_intervals, o2_handles, o12_file_ends,
    s4_signature_table, s8_round_trip, s16_kernels, s17_hdf5_names, a19_grammars, st1_running_totals, a2_rollup, w1_access_pattern,
    w1_access_pattern_per_rank, w3_delta_times, w10_sessions, x2_expanded_lengths, x4_absolute_times, x6_categories,
)


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


_CALLS = f"""
l as (select func_id, name, category from function_list),
ln as (select {plain_name_sql("name")} as plain, min(name) as name, min(func_id) as func_id from function_list group by 1),
d0 as (select *, row_number() over (partition by rank, seq_id order by ((terminal_id is not null)::int + (func_id is not null)::int + (func is not null)::int + (tick_end is not null)::int + (args is not null)::int) desc,
  terminal_id nulls first, func_id nulls first, func nulls first, tick_end nulls first) as nth from records),
calls as (select d0.rank, d0.seq_id, d0.tid, d0.terminal_id, coalesce(d0.func_id, ln.func_id) as func_id, coalesce(l.name, ln.name, d0.func) as func, d0.category, d0.level, d0.tick_start, d0.tick_end, d0.tstart, d0.tend, d0.arg_count, d0.args
  from d0 left join l on l.func_id = d0.func_id left join ln on ln.plain = {plain_name_sql("d0.func")} where nth = 1)
"""
_SIGNATURES = """
s0 as (select *, row_number() over (partition by rank, terminal_id order by count desc nulls last, func_id nulls last, level nulls last) as nth from cst),
signatures as (select s0.* exclude (nth), f.name as func, f.category from s0 left join function_list f on f.func_id = s0.func_id where nth = 1)
"""
_RANGES = """
r0 as (select *, row_number() over (partition by filename, rank, seq_id order by tstart, "offset", count) as nth from intervals where "offset" is not null and count > 0 and tstart is not null and is_read is not null),
ranges as (select *, floor(tstart * 1e7 + 0.5)::bigint as tick, "offset" as a, "offset" + count as z from r0 where nth = 1)
"""
_ACCESSES = """
r0 as (select *, row_number() over (partition by filename, rank, seq_id order by is_read is null or tstart is null, is_read is null, tstart nulls first, "offset", count) as nth from intervals where "offset" is not null and count > 0),
ranges as (select *, "offset" as a, "offset" + count as z, coalesce(is_read, false) as rd from r0 where nth = 1)
"""
_UNFILTERED = "('linkat','symlink','rename','readdir','closedir','rewinddir','getcwd','mknod','mknodat','pipe','umask','tmpfile','msync','dup','dup2')"
_PATH = f"""case when func in {_UNFILTERED} then null when func in ('fread','fwrite') then args[4] when func in ('mmap','mmap64') then args[5]
  when func in ('__xstat','__xstat64','__lxstat','__lxstat64','__fxstat','__fxstat64','symlinkat') then args[2] else args[1] end"""
_EXCLUDE = "(" + " or ".join(f"starts_with(p, '{p}')" for p in EXCLUDED) + ")"
_DATA = "(contains(func, 'read') or contains(func, 'write'))"
_LAYER = "case category when 1 then 'MPI-IO' when 3 then 'HDF5' when 0 then 'POSIX' end"
_OPENS = "('open','open64','fopen','fopen64','fdopen')"


def _num(i: int) -> str:
    return f"try_cast(args[{i + 1}] as bigint)"


def _totals(where: str) -> str:
    return f"""with {_SIGNATURES}, t as (select {_LAYER} as layer, count from signatures where category in (0, 1, 3) {where})
select layer, coalesce(sum(count), 0)::bigint as n_calls from t group by layer union all select 'Total', coalesce(sum(count), 0)::bigint from t"""


def _pattern(keys: str) -> str:
    return f"""with {_RANGES}, p as (select {keys}, a, lag(z) over (partition by {keys} order by tick, rank, seq_id) as b from ranges)
select {keys}, count(*) filter (where b = a)::bigint as n_consecutive, count(*) filter (where b < a)::bigint as n_sequential, count(*) filter (where b > a)::bigint as n_random from p where b is not null group by {keys}"""


_SIZE = f"""case when contains(func, 'dir') or contains(func, 'MPI') or contains(func, 'H5') then null when func in ('fread','fwrite') then {_num(1)} * {_num(2)}
  when func in ('readv','writev','fprintf','vfprintf') then {_num(1)} when {_DATA} then {_num(2)} end"""
_PAIRS = f"""with {_ACCESSES}, c as (
  select x.filename, (x.a, x.rank, x.seq_id) > (y.a, y.rank, y.seq_id) as swap, x.rank as r1, x.seq_id as s1, case when x.rd then 'read' else 'write' end as w1, coalesce(x.mpifh, '-') as f1, x.a as o1,
    y.rank as r2, y.seq_id as s2, case when y.rd then 'read' else 'write' end as w2, coalesce(y.mpifh, '-') as f2, y.a as o2
  from ranges x join ranges y on x.filename = y.filename and x.rank < y.rank and not (x.rd and y.rd) and x.z > y.a and y.z > x.a),
pairs as (select filename, case when swap then r2 else r1 end as rank1, case when swap then s2 else s1 end as seq1, case when swap then w2 else w1 end as rw1, case when swap then f2 else f1 end as fh1, case when swap then o2 else o1 end as offset1,
  case when swap then r1 else r2 end as rank2, case when swap then s1 else s2 end as seq2, case when swap then w1 else w2 end as rw2, case when swap then f1 else f2 end as fh2, case when swap then o1 else o2 end as offset2 from c)
"""


def _overlap_flags() -> str:
    flags = ", ".join(f"bool_or(kind = '{k}' and same = {s}) as {k.lower()}_{n}" for k in ("RAR", "RAW", "WAR", "WAW") for s, n in (("true", "same"), ("false", "other")))
    return f"""with {_RANGES}, p as (select filename, rank, a, is_read, (tick, rank, seq_id) as me, lag(z) over w as pz, lag(rank) over w as pr, lag(is_read) over w as pread, lag((tick, rank, seq_id)) over w as pme
  from ranges window w as (partition by filename order by a, tick, rank, seq_id)),
k as (select filename, rank = pr as same, case when me >= pme then case when is_read then 'R' else 'W' end || 'A' || case when pread then 'R' else 'W' end else case when pread then 'R' else 'W' end || 'A' || case when is_read then 'R' else 'W' end end as kind from p where pz > a)
select filename, {flags} from k group by filename"""


def _arg_sql(*fields: str) -> str:
    by: dict[int, list[str]] = {}
    for name, places in mpi.ARGUMENTS.items():
        for f in fields:
            if f in places:
                by.setdefault(places[f], []).append(name)
    return "case " + " ".join("when func in (" + ", ".join(f"'{n}'" for n in names) + f") then args[{i + 1}]" for i, names in sorted(by.items())) + " end"


def _list_sql(one: str, many: str) -> str:
    a, b = _arg_sql(many), _arg_sql(one)
    listed = ", ".join(f"'{n}'" for n, places in mpi.ARGUMENTS.items() if many in places)
    return f"(case when func in ({listed}) then case when length(regexp_extract({a}, '^\\[(.*)\\]$', 1)) > 0 then string_split(regexp_extract({a}, '^\\[(.*)\\]$', 1), ',') else [] end when {b} is not null then [{b}] else [] end)"


def _mpi_sql() -> str:
    x, s, u, f = _arg_sql("status"), _arg_sql("src"), _arg_sql("rtag"), _arg_sql("flag")
    src = f"try_cast(regexp_extract({x}, '^\\[(-?\\d+)_-?\\d+\\]$', 1) as int)"
    tag = f"try_cast(regexp_extract({x}, '^\\[-?\\d+_(-?\\d+)\\]$', 1) as int)"
    role = f"""case when func = 'MPI_Sendrecv' then 'sendrecv' when func in {mpi.SENDS} then 'send' when func in {mpi.RECEIVES} then 'recv' when func in {mpi.COMPLETIONS} then 'completion'
  when func in {mpi.ONE_TO_MANY} then 'one-to-many' when func in {mpi.MANY_TO_ONE} then 'many-to-one' else 'all-to-all' end"""
    names = ", ".join(f"'{n}'" for n in mpi.ARGUMENTS)
    return f"""m0 as (select *, {src} as xs, {tag} as xt, try_cast({s} as int) as s0, try_cast({u} as int) as u0 from calls where func in ({names})),
mpi as (select rank, seq_id, func, {role} as role, case when func in ('MPI_Wait','MPI_Test') then xs when s0 = -2 then coalesce(xs, s0) else s0 end as src, try_cast({_arg_sql("dst")} as int) as dst, try_cast({_arg_sql("stag")} as int) as stag,
  case when func in ('MPI_Wait','MPI_Test') then xt when u0 = -1 then coalesce(xt, u0) else u0 end as rtag, {_arg_sql("comm")} as comm, {_list_sql("req", "reqs")} as req, {_list_sql("tindx", "tindxs")} as tindx, coalesce(try_cast({f} as int), 1) <> 0 as done from m0)"""


_META = "(not (contains(func,'MPI') or contains(func,'H5')) and (contains(func,'dir') or contains(func,'link') or not (contains(func,'read') or contains(func,'write') or contains(func,'seek') or contains(func,'tell') or contains(func,'open') or contains(func,'close') or contains(func,'sync'))))"
_CODES = f"""codes as (with u as (select * from calls where {_META}),
 c as (select u.func, up.func as caller, u.level from u asof left join calls up on up.rank = u.rank and coalesce(up.tid, -1) = coalesce(u.tid, -1) and up.level = u.level - 1 and up.seq_id < u.seq_id)
 select func, max(case when level = 0 or caller is null then 3 when contains(caller, 'H5') then 2 when contains(caller, 'MPI') then 1 else 0 end) as code from c group by func)"""
_REPORT = "['__xstat','__xstat64','__lxstat','__lxstat64','__fxstat','__fxstat64','mmap','getcwd','mkdir','chdir','opendir','readdir','closedir','umask','unlink','readlink','access','ftruncate','fileno','faccessat']"
_OFFSET = f"""case when func in ('lseek','lseek64','fseek','fseeko','MPI_File_seek','MPI_File_seek_shared','MPI_File_read_at','MPI_File_read_at_all','MPI_File_read_at_all_begin','MPI_File_iread_at','MPI_File_write_at',
  'MPI_File_write_at_all','MPI_File_write_at_all_begin','MPI_File_iwrite_at') then {_num(1)} when func in ('pread','pread64','pwrite','pwrite64') then {_num(3)} when func in ('mmap','mmap64') then {_num(5)} end"""
#: Ranks with as many signatures of a function form a group; r is a rank's place in it, k a signature's place in its rank. Needs sig(rank, func, terminal_id, off).
_LINES = """
k as (select *, row_number() over (partition by rank, func order by terminal_id) - 1 as k, count(*) over (partition by rank, func) as n from sig),
r as (select *, dense_rank() over (partition by func, n order by rank) - 1 as r from k),
l as (select func, n, k, max(off) filter (where r = 1) - max(off) filter (where r = 0) as a, max(off) filter (where r = 0) as b, count(*) as n_ranks from r group by 1, 2, 3 having count(*) >= 3)
select l.func, l.k::bigint as k, l.a, l.b, l.n_ranks::bigint as n_ranks from l join r on r.func = l.func and r.n = l.n and r.k = l.k group by l.func, l.n, l.k, l.a, l.b, l.n_ranks having bool_and(coalesce(r.off = l.a * r.r + l.b, false))
"""
_LINUX_FLAGS = "[('O_WRONLY', 1), ('O_RDWR', 2), ('O_NONBLOCK', 2048), ('O_APPEND', 1024), ('O_ASYNC', 8192), ('O_FSYNC', 1048576), ('O_CREAT', 64), ('O_TRUNC', 512), ('O_EXCL', 128)]"
#: Cursors walked event by event, all files side by side: w has the ranges, and the end of the file and every rank's cursor after each.
_WALK = f"""
 h0 as (select *, last_value(case when category = 1 and {_DATA} then {{'fh': args[1], 'lv': level}} end ignore nulls) over (partition by rank order by tick_start, seq_id rows between unbounded preceding and 1 preceding) as m from calls where args is not null),
 e0 as (select rank, seq_id, tick_start as tick, func, args, case when func in ('fread','fwrite') then args[4] else args[1] end as filename, case when level = m.lv + 1 then coalesce(m.fh, '-') else '-' end as mpifh from h0
   where category = 0 and not contains(func, 'dir') and not contains(func, 'link') and tick_start is not null),
 e1 as (select *, case when func in ('pread','pread64','pwrite','pwrite64') then 'at' when {_DATA} then 'data'
     when func in {_OPENS} then case when (func in ('open','open64') and {_num(1)} & 1024 <> 0) or (func not in ('open','open64') and contains(args[2], 'a')) then 'end' else 'set' end
     when func in ('lseek','lseek64','fseek','fseeko') then case {_num(2)} when 0 then 'set' when 1 then 'move' when 2 then 'end' end when contains(func, 'close') then 'close' end as kind,
   case when func in ('readv','writev') then {_num(1)} when func in ('fread','fwrite') then {_num(1)} * {_num(2)} when {_DATA} then {_num(2)}
     when func in ('lseek','lseek64','fseek','fseeko') and {_num(2)} in (0, 1) then coalesce({_num(1)}, 0) else 0 end as amount, {_num(3)} as pos, contains(func, 'read') as is_read from e0 where filename is not null),
 e2 as (select *, row_number() over (partition by filename order by tick, rank, seq_id) as i, dense_rank() over (order by rank) as ri from e1 where kind is not null and amount is not null and not (kind = 'at' and pos is null)),
 w as (select filename, 0::bigint as i, 0 as rank, 0::bigint as seq_id, 0::bigint as tick, 0::bigint as off, 0::bigint as n, false as is_data, false as is_read, '' as mpifh, 0::bigint as eof, list_transform(range((select max(ri) from e2)), lambda x: 0::bigint) as cur from e2 group by filename
   union all
   select e.filename, e.i, e.rank, e.seq_id, e.tick, case when e.kind = 'at' then e.pos else w.cur[e.ri] end, e.amount, e.kind in ('at', 'data'), e.is_read, e.mpifh,
     case when e.kind = 'at' then greatest(w.eof, e.pos + e.amount) when e.kind = 'data' then greatest(w.eof, w.cur[e.ri] + e.amount) else w.eof end,
     case when e.kind = 'at' then w.cur else list_transform(w.cur, lambda c, j: case when j <> e.ri then c when e.kind in ('data', 'move') then c + e.amount when e.kind = 'set' then e.amount when e.kind = 'end' then w.eof else 0 end) end
   from w join e2 e on e.filename = w.filename and e.i = w.i + 1)
"""


#: What the format keeps of a call: starts never fall, blanks in arguments are underscores and missing ones question marks.
_WRITTEN = """
wr as (select rank, seq_id, coalesce(tid, 0) as tid, coalesce(func_id, 255)::smallint as func_id, coalesce(level, 0) as level, len(coalesce(args, []))::int as n_args,
  array_to_string(list_transform(coalesce(args, []), lambda x: coalesce(replace(x, ' ', '_'), '???')), ',') as args, tick_end,
  max(tick_start) over (partition by rank order by seq_id rows unbounded preceding) as tick_start from calls where tick_start is not null),
written as (select wr.* exclude (tick_end), greatest(tick_end, tick_start) as tick_end from wr)
"""


def oracle_sql() -> dict[str, str]:
    constructors = " union all ".join(f"select args[{a + 1}] as comm, try_cast(args[{b + 1}] as int) as local_rank, rank as world_rank from calls where func = '{f}'" for f, (a, b) in mpi.CONSTRUCTORS.items())
    return {
        "a1_layer_totals": _totals(""),
        "a1_layer_totals_rank0": _totals("and rank = 0"),
        "a2_function_counts": f"with {_SIGNATURES} select func_id, func, count(*)::bigint as n_signatures, sum(count)::bigint as n_calls from signatures group by 1, 2",
        "a3_signatures": f"with {_SIGNATURES} select rank, terminal_id, func || '( ' || array_to_string(args, ' ') || ' )' as signature, count as n_calls from signatures",
        "a5_merged_signatures": f"with {_SIGNATURES} select tid, func_id, level, array_to_string(args, ',') as args, sum(count)::bigint as count, min(rank) as rank from signatures group by 1, 2, 3, args",
        "a6_signature_counts": f"with {_CALLS} select rank, tid, func_id, level, coalesce(array_to_string(args, ','), '') as args, args is null as no_args, count(*)::bigint as count, min(seq_id) as first_seq from calls group by rank, tid, func_id, level, calls.args",
        "a7_calls_per_rank": f"with {_CALLS} select rank, count(*)::bigint as n_calls from calls group by 1",
        "a8_files_per_rank": f"with {_CALLS}, f as (select rank, {_PATH} as p from calls where category = 0) select rank, count(distinct p)::bigint as n_files from f where p is not null and not {_EXCLUDE} and starts_with(p, '/') group by 1",
        "a9_file_modes": f"""with recursive {_CALLS}, {_WALK}, f as (select {_PATH} as filename, func, args, case when func in ('open','open64') then {_num(1)} end as n from calls where category = 0 and not contains(func, 'dir')),
b as (select *, list_transform(list_filter({_LINUX_FLAGS}, lambda x: n & x[2] <> 0), lambda x: x[1]) as names from f where starts_with(filename, '/')),
g as (select filename, func, case when func in ('fopen','fopen64','fdopen') then args[2] when n is not null then case when len(names) = 0 then 'O_RDONLY' else array_to_string(names, ' | ') end end as mode from b),
s as (select filename, max(off + n) as size from w where is_data group by 1)
select g.filename, coalesce(array_to_string(list_sort(list(distinct mode) filter (where mode is not null)), ', '), '') as modes, bool_or(contains(func, 'read')) as was_read, bool_or(contains(func, 'write') or contains(func, 'fprintf')) as was_written, max(s.size) as size
from g left join s on s.filename = g.filename group by 1""",
        "a10_layers": f"with {_CALLS} select case when contains(func, 'H5') then 'hdf5' when contains(func, 'MPI') then 'mpi' else 'posix' end as layer, count(*)::bigint as n_calls from calls group by 1",
        "a11_metadata_counts": f"with {_CALLS} select func, count(*)::bigint as n_calls from calls where not ({' or '.join(f'''contains(func, '{p}')''' for p in ('MPI', 'H5', 'tell', 'write', 'read', 'open', 'close', 'seek'))}) group by 1",
        "a12_sizes": f"with {_CALLS}, s as (select {_SIZE} as size from calls) select size, count(*)::bigint as n_calls from s where size > 0 group by 1",
        "a13_overlap_flags": _overlap_flags(),
        "a15_conflict_counts": _PAIRS + "select filename, rank1, seq1, count(*)::bigint as n_conflicts from pairs group by 1, 2, 3",
        "a18_function_signatures": f"with {_SIGNATURES} select rank, count(distinct terminal_id)::bigint as n_signatures from signatures where func = 'pwrite' group by 1",
        "f1_accepted_paths": f"""with {_CALLS}, f as (select *, case when func = 'MPI_File_open' then args[2] else {_PATH} end as p from calls),
o as (select distinct rank, args[5] as h from f where func = 'MPI_File_open' and p is not null and not {_EXCLUDE} and args[5] is not null)
select rank, seq_id, func from f where case when category = 0 then func in {_UNFILTERED} or (p is not null and not {_EXCLUDE}) when category = 1 then func in ('MPI_File_open','MPI_File_close') or (rank, args[1]) in (select (rank, h) from o) else true end""",
        "f5_layers_on": f"with {_CALLS} select rank, seq_id, func from calls where category in (0, 1, 3, 4) and func <> 'fcntl'",
        "f6_blanked": f"with {_CALLS} select rank, seq_id, 0::bigint as tid, 0 as level, array_to_string(list_transform(args, lambda x: case when regexp_matches(x, '^0x[0-9a-fA-F]+$') then '%p' else x end), ',') as args from calls where args is not null",
        "f7_function_flags": f"""with f as (select func_id, name, name as func, category from function_list)
select func_id, name, not (contains(func,'dir') or contains(func,'link')) and (category = 0 or (category = 1 and (contains(func,'MPI_File_write') or contains(func,'MPI_File_read') or contains(func,'MPI_File_iread') or contains(func,'MPI_File_iwrite')))) as feeds,
 {_DATA} as moves_data, {_META} as is_meta, not (contains(func,'MPI') or contains(func,'H5') or contains(func,'tell') or contains(func,'write') or contains(func,'read') or contains(func,'open') or contains(func,'close') or contains(func,'seek')) as is_report_meta,
 case when func = 'MPI_Sendrecv' then 'sendrecv' when func in {mpi.SENDS} then 'send' when func in {mpi.RECEIVES} then 'recv' when func in {mpi.COMPLETIONS} then 'completion' when func in {mpi.ONE_TO_MANY} then 'one-to-many' when func in {mpi.MANY_TO_ONE} then 'many-to-one'
  when func in ({", ".join(f"'{n}'" for n in [*mpi.ARGUMENTS, *mpi.SYNCHRONIZING])}) then 'all-to-all' end as role,
 case when contains(func, 'H5') then 'hdf5' when contains(func, 'MPI') then 'mpi' else 'posix' end as layer from f""",
        "f10_timeline_calls": f"with {_CALLS} select rank, seq_id from calls where level = 0 or category in (0, 1, 3)",
        "j1_named_calls": f"with {_CALLS}, {_SIGNATURES} select c.rank, c.terminal_id, c.seq_id, c.func, s.func as sig_func, s.count as sig_count from calls c left join signatures s on s.rank = c.rank and s.terminal_id = c.terminal_id where c.terminal_id is not null",
        "j2_conflicts": _PAIRS + "select * from pairs",
        "j3_collectives": f"""with {_CALLS}, {_mpi_sql()},
n as (select rank, seq_id, func, coalesce(comm, '') as comm, coalesce(case when starts_with(func, 'MPI_File') then req[1] end, '') as handle from mpi where role in ('one-to-many','many-to-one','all-to-all')),
k as (select *, row_number() over (partition by rank, func, comm, handle order by seq_id) - 1 as k from n)
select func, comm, handle, k::bigint as k, count(*)::bigint as n_members, min(rank) as first_rank, arg_min(seq_id, rank) as first_seq from k group by func, comm, handle, k.k having count(*) > 1""",
        "j6_completions": f"""with {_CALLS}, {_mpi_sql()},
p as (select rank, seq_id, req[1] as handle from mpi where role <> 'completion' and starts_with(func, 'MPI_I') and len(req) > 0),
e as (select rank, seq_id, func, tindx, unnest(req) as handle, generate_subscripts(req, 1) - 1 as place from mpi where role = 'completion' and done),
d as (select distinct rank, seq_id, handle from e where func not in ('MPI_Waitany','MPI_Waitsome','MPI_Testany','MPI_Testsome') or list_contains(tindx, place::varchar)),
pn as (select *, row_number() over (partition by rank, handle order by seq_id) as k from p), dn as (select *, row_number() over (partition by rank, handle order by seq_id) as k from d)
select pn.rank, pn.seq_id as post_seq, dn.seq_id as done_seq from pn join dn on pn.rank = dn.rank and pn.handle = dn.handle and pn.k = dn.k""",
        "j7_communicators": f"with {_CALLS}, c as ({constructors}) select distinct * from c where comm is not null and comm not in {mpi.NULL_COMM + mpi.WORLD} and local_rank >= 0",
        "j9_next_sync": f"""with {_CALLS}, n as (select *, first_value(case when func in ('close','fclose','fsync') then seq_id end ignore nulls) over (partition by rank order by seq_id rows between 1 following and unbounded following) as next_close,
 last_value(case when func in ('open','fopen') then seq_id end ignore nulls) over (partition by rank order by seq_id rows between unbounded preceding and 1 preceding) as last_open from calls)
select rank, seq_id, next_close, last_open from n where {_DATA} and category = 0""",
        "k2_caller_codes": f"with {_CALLS}, {_CODES} select * from codes",
        "k3_caller_report": f"with {_CALLS}, {_CODES}, r as (select unnest(range(20))::int as place, unnest({_REPORT}) as func) select r.place, r.func, coalesce(codes.code, 0) as code from r left join codes on codes.func = r.func",
        "k11_export": f"""with {_CALLS} select seq_id + 1 as "index", rank, tid as thread_id, category as cat, tstart, tend, func as func_id, level, case when func_id = 255 then 0 else arg_count end as arg_count,
{", ".join(f"coalesce(case when coalesce(calls.func_id, 0) <> 255 then args[{i}] end, '') as args_{i}" for i in range(1, 11))} from calls""".replace("case when func_id = 255", "case when coalesce(calls.func_id, 0) = 255"),
        "k13_conflict_lines": _PAIRS
        + """, p as (select filename, rank1, seq1, concat_ws(',', rank1, seq1, rw1, fh1) as op, list_sort(list(distinct {'rank2': rank2, 'seq2': seq2, 't': concat_ws(',', rank2, seq2, rw2, fh2)})) as x from pairs group by filename, rank1, seq1, op)
select filename, rank1, seq1, op || ':' || array_to_string(list_transform(x, lambda y: y.t), ' ') as line from p""",
        "k17_linear_offsets": f"with {_SIGNATURES}, sig as (select rank, func, terminal_id, {_OFFSET} as off from signatures where rank is not null and ({_OFFSET} is not null or func in ('lseek','lseek64','fseek','fseeko','MPI_File_seek','MPI_File_seek_shared') or regexp_matches(func, '^MPI_File_(i?read_at|i?write_at)') or regexp_matches(func, '^p(read|write)(64)?$') or func in ('mmap','mmap64'))), {_LINES}",
        "k17_order_lines": f"with sig as (select (o_orderkey % 8)::int as rank, 'pwrite' as func, o_orderkey as terminal_id, o_orderkey * 4096 + case when o_orderpriority = '1-URGENT' then o_custkey else 0 end as off from orders), {_LINES}",
        "k1_depths": f"""with {_CALLS}, t as (select rank, seq_id, coalesce(tid, -1) as tid, tick_start as a, greatest(coalesce(tick_end, tick_start), tick_start) as z from calls),
n as (select c.rank, c.seq_id, count(*) as n from t c join t x on x.rank = c.rank and x.tid = c.tid and x.z > x.a and x.z > c.a and (x.a < c.a or (x.a = c.a and c.z > c.a and x.seq_id < c.seq_id)) group by 1, 2)
select t.rank, t.seq_id, coalesce(n.n, 0)::bigint as depth from t left join n on n.rank = t.rank and n.seq_id = t.seq_id""",
        "k12_timeline": f"""with {_CALLS} select rank, seq_id, rank as pid, tid, round(tstart * 1e6, 3) as ts, func as name, ['POSIX','MPI-IO','MPI','HDF5','USER'][category + 1] as cat, 'X' as ph, round((tend - tstart) * 1e6, 3) as dur, coalesce(array_to_string(args, ','), '') as args
from calls where level = 0 or category in (0, 1, 3)""",
        "o1_intervals": f'with recursive {_CALLS}, {_WALK} select filename, rank, seq_id, tick, off as "offset", n as count, is_read, mpifh from w where is_data',
        "o12_file_ends": f"with recursive {_CALLS}, {_WALK} select filename, max(off + n) as eof from w where is_data group by 1",
        "k18_offset_series": f'with {_RANGES} select filename, rank, tick, "offset", count, is_read from ranges where filename in (select distinct filename from ranges order by filename limit 12)',
        "k18_io_activity": f"""with {_CALLS}, k as (select *, unnest(case when contains(func, 'write') or contains(func, 'fprintf') then ['write'] else [] end || case when contains(func, 'read') then ['read'] else [] end) as kind from calls where not contains(func, 'MPI') and not contains(func, 'H5'))
select rank, seq_id, kind, tick_start, tick_end from k""",
        "k18_offset_times": f"""with recursive {_CALLS}, {_WALK} select w.filename, w.rank, w.seq_id, w.tick as from_tick, c.tick_end as to_tick, w.off as from_byte, w.off + w.n as to_byte from w join calls c on c.rank = w.rank and c.seq_id = w.seq_id
where w.is_data and w.filename in (select distinct filename from w where is_data order by filename limit 12)""",
        "m1_mpi_calls": f"with {_CALLS}, {_mpi_sql()} select rank, seq_id, func, role, src, dst, stag, rtag, comm, coalesce(array_to_string(req, ','), '') as req, coalesce(array_to_string(tindx, ','), '') as tindx, done from mpi",
        "o2_handles": f"""with {_CALLS}, h as (select rank, seq_id, category, level, last_value(case when category = 1 and {_DATA} then {{'fh': args[1], 'at': level}} end ignore nulls) over (partition by rank order by tick_start, seq_id rows between unbounded preceding and 1 preceding) as m from calls where args is not null)
select rank, seq_id, case when level = m.at + 1 then coalesce(m.fh, '-') else '-' end as mpifh from h where category = 0""",
        "st1_running_totals": "select func_id, count(*)::bigint as n_calls, coalesce(sum(floor((case when isfinite(tstart) and isfinite(tend) and tend >= tstart then tend::double - tstart::double end) * 1000000 + 0.5)::bigint), 0)::bigint as total_us from export_records group by 1",
        "a2_rollup": f"with {_SIGNATURES} select category, func, sum(count)::bigint as n_calls, count(*)::bigint as n_signatures from signatures group by rollup (category, func)",
        "w1_access_pattern": _pattern("filename"),
        "w1_access_pattern_per_rank": _pattern("filename, rank"),
        "w3_delta_times": f"with {_CALLS} select rank, seq_id, tick_start - coalesce(p, 0) as d_start, tick_end - coalesce(p, 0) as d_end from (select *, lag(tick_start) over (partition by rank order by seq_id) as p from calls)",
        "w10_sessions": f"""with {_CALLS}, f as (select rank, seq_id, func, {_PATH} as filename from calls where category = 0 and args is not null)
select rank, seq_id, filename, sum(case when func in {_OPENS} then 1 else 0 end) over (partition by rank, filename order by seq_id rows unbounded preceding)::bigint as session from f where starts_with(filename, '/')""",
        "k10_text": f"""with {_CALLS} select rank, seq_id, coalesce(printf('%.7f', tstart), 'null') || ' ' || coalesce(printf('%.7f', tend), 'null') || ' ' || func || ' ' || level || ' ' || category || ' (' ||
 case when coalesce(func_id, 0) = 255 then '' else coalesce(array_to_string(list_transform(args, lambda x: ' ' || x), ''), '') end || ' )' as line from calls""",
        "s8_round_trip": f"with {_CALLS}, {_WRITTEN} select rank, row_number() over (partition by rank order by seq_id) - 1 as seq_id, tid, func_id, case when func_id = 255 then 4 else (select any_value(category) from function_list f where f.func_id = written.func_id) end as category, level, tick_start, tick_end, n_args as arg_count, args from written",
        "x2_expanded_lengths": f"with {_CALLS} select rank, count(*)::bigint as n_calls from calls where tick_start is not null group by 1",
        "s4_signature_table": f"with {_CALLS}, {_WRITTEN} select min(rank) as rank, tid, func_id, level, args, count(*)::bigint as count from written group by tid, func_id, level, args",
        "a19_grammars": f"with {_CALLS}, {_WRITTEN}, g as (select rank, list((tid, func_id, level, args) order by seq_id) as s from written group by 1) select count(*)::bigint as n_ranks, count(distinct s)::bigint as n_grammars, true as no_more from g",
        "s16_kernels": """select (user_id % 8)::int as rank, event_id as seq_id, 'kernel_' || event_type as func, 4 as category, (epoch_us(ts) - 1704067200000000) * 10 as tick_start,
  case when event_type <> 'error' then ((epoch_us(ts) - 1704067200000000) * 1000 + floor(value)::bigint * 1000 + event_id % 1000) // 100 end as tick_end, 2 as arg_count from events""",
        "s17_hdf5_names": f"""with {_CALLS} select rank, seq_id, func, case func
  when 'H5Tcreate' then coalesce(['H5T_INTEGER','H5T_FLOAT','H5T_TIME','H5T_STRING','H5T_BITFIELD','H5T_OPAQUE','H5T_COMPOUND','H5T_REFERENCE','H5T_ENUM','H5T_VLEN','H5T_ARRAY'][try_cast(args[1] as int) + 1], args[1])
  when 'H5Pcreate' then coalesce(['H5P_ROOT','H5P_OBJECT_CREATE','H5P_FILE_CREATE','H5P_FILE_ACCESS','H5P_DATASET_CREATE','H5P_DATASET_ACCESS','H5P_DATASET_XFER','H5P_FILE_MOUNT','H5P_GROUP_CREATE','H5P_GROUP_ACCESS'][try_cast(args[1] as int) + 1], args[1])
  else coalesce(['H5S_SELECT_SET','H5S_SELECT_OR','H5S_SELECT_AND','H5S_SELECT_XOR','H5S_SELECT_NOTB','H5S_SELECT_NOTA','H5S_SELECT_APPEND','H5S_SELECT_PREPEND'][try_cast(args[2] as int) + 1], args[2]) end as name
from calls where func in ('H5Tcreate','H5Pcreate','H5Sselect_elements','H5Sselect_hyperslab')""",
        "x4_absolute_times": f"with {_CALLS} select rank, seq_id, tick_start, tick_end, tick_start * 1e-7::double as tstart, tick_end * 1e-7::double as tend from calls",
        "x6_categories": "select func_id, category from function_list",
    }
