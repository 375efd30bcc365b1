"""Queries over calls made from the events table: cursors, messages and rates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.operators import conflicts, mpi, offsets
from calltide.operators.sequence import scan
from calltide.runtime import cut, new_path
from calltide.streaming import live

RANKS = 8
EPOCH_US = 1_704_067_200_000_000


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.withColumn("rank", (F.col("user_id") % RANKS).cast("int")).withColumn("tick_start", F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US)
    e = scan(e, ["rank"], ["tick_start", "event_id"], {"seq_id": ("sum", F.lit(1), False)}, 1 << 32)
    other = F.get(F.array(*map(F.lit, ("open", "lseek", "close", "fsync"))), (F.col("event_id") % 4).cast("int"))
    kind = F.col("event_type")
    func = F.when(kind == "click", "pread").when(kind == "view", "read").when(kind == "purchase", "pwrite").when(kind == "signup", "write").otherwise(other)
    count = F.floor("value").cast("bigint")
    rows = e.select(
        "event_id", "rank", F.col("seq_id").cast("bigint").alias("seq_id"), "tick_start", (F.col("tick_start") + count).alias("tick_end"), F.concat(F.lit("/data/f"), (F.col("event_id") % 10).cast("string")).alias("filename"),
        func.alias("func"), (F.col("event_id") * 37 % 8192).alias("off"), (count + 1).alias("cnt"), F.when(F.col("event_id") % 5 == 0, 1).otherwise(0).alias("level"), "event_type", "user_id",
    )
    f, text = F.col("func"), lambda c: F.col(c).cast("string")
    args = (
        F.when(f.isin("pread", "pwrite"), F.array("filename", F.lit("%p"), text("cnt"), text("off")))
        .when(f.isin("read", "write"), F.array("filename", F.lit("%p"), text("cnt")))
        .when(f == "open", F.array("filename", F.lit("0")))
        .when(f == "lseek", F.array("filename", text("off"), F.lit("0")))
        .otherwise(F.array("filename"))
    )
    return cut(rows.withColumn("args", args).withColumn("category", F.lit(0)).withColumn("tid", F.lit(0).cast("bigint")), "event-calls")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = records(spark, sf_dir).withColumn("peer", ((F.col("user_id") + 1 + F.col("event_id") % 7) % RANKS).cast("int")).withColumn("tag", (F.col("event_id") % 3).cast("int")).withColumn("comm", F.lit("world"))
    pick = lambda t: r.filter(F.col("event_type") == t).select("rank", "peer", "tag", "comm", "seq_id", "tick_start")
    return pick("purchase"), pick("signup")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sends, receives = _sides(spark, sf_dir)
    pairs = mpi.fifo_pairs(sends, receives, "tick_start", 1 << 32)
    s = sends.select(F.col("rank").alias("src"), F.col("seq_id").alias("send_seq"), F.col("tick_start").alias("sent"))
    r = receives.select(F.col("rank").alias("dst"), F.col("seq_id").alias("recv_seq"), F.col("tick_start").alias("received"))
    return cut(pairs.join(s, ["src", "send_seq"]).join(r, ["dst", "recv_seq"]), "messages")


def j5_messages(spark, d):
    return _messages(spark, d).select("src", "dst", "tag", F.col("k").cast("bigint").alias("k"), "send_seq", "recv_seq")


def o6_cursor_intervals(spark, d):
    return offsets.intervals(records(spark, d)).drop("mpifh")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(conflicts.conflict_pairs(offsets.intervals(records(spark, sf_dir))), "conflicts")


def j2_event_conflicts(spark, d):
    return _pairs(spark, d).drop("fh1", "fh2")


def st2_rates(spark, d):
    """Calls per hour and type from a stream over the whole table: every window is given, also the last ones, and no call is late."""
    rows = live.stream_folder(spark, f"{d}/events.parquet").withColumn("bytes", F.floor("value").cast("bigint")).withColumn("at", F.col("ts").cast("timestamp"))
    path = new_path(spark, "rates")
    live.run_to_table(live.rates(rows, "at", ["event_type"], "1 hour"), f"{path}/table", f"{path}/checkpoint", "complete")
    return spark.read.parquet(f"{path}/table").select(F.unix_micros("w.start").alias("from_us"), "event_type", "n_calls", "bytes")


_QUERIES = (j5_messages, o6_cursor_intervals, j2_event_conflicts, st2_rates)


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


_RECORDS = f"""
r0 as (select event_id, (user_id % {RANKS})::int as rank, epoch_us(ts) - {EPOCH_US} as tick, event_type, user_id, floor(value)::bigint + 1 as cnt, (event_id * 37) % 8192 as off, '/data/f' || (event_id % 10) as filename,
  case event_type when 'click' then 'pread' when 'view' then 'read' when 'purchase' then 'pwrite' when 'signup' then 'write' else ['open','lseek','close','fsync'][event_id % 4 + 1] end as func from events),
records as (select *, row_number() over (partition by rank order by tick, event_id) - 1 as seq_id, ((user_id + 1 + event_id % 7) % {RANKS})::int as peer, (event_id % 3)::int as tag from r0)
"""
_MESSAGES = f"""{_RECORDS},
s as (select rank, peer, tag, tick, seq_id, row_number() over (partition by rank, peer, tag order by tick, event_id) - 1 as k from records where event_type = 'purchase'),
t as (select rank, peer, tag, tick, seq_id, row_number() over (partition by peer, rank, tag order by tick, event_id) - 1 as k from records where event_type = 'signup'),
m as (select s.rank as src, t.rank as dst, s.tag, s.k, s.seq_id as send_seq, t.seq_id as recv_seq, s.tick as sent, t.tick as received from s join t on s.rank = t.peer and s.peer = t.rank and s.tag = t.tag and s.k = t.k)
"""
_INTERVALS = f"""{_RECORDS},
c as (select *, sum(case when func in ('read','write') then cnt else 0 end) over (partition by rank, filename order by tick, seq_id rows between unbounded preceding and 1 preceding) as moved,
  sum(case when func in ('open','lseek','close') then 1 else 0 end) over (partition by rank, filename order by tick, seq_id) as grp from records where func <> 'fsync'),
g as (select *, first_value(case when func = 'lseek' then off else 0 end) over w as base, first_value(coalesce(moved, 0)) over w as at_base, first_value(func) over w as f0 from c window w as (partition by rank, filename, grp order by tick, seq_id)),
iv as (select filename, rank, seq_id, tick, case when func in ('pread','pwrite') then off else (case when grp = 0 then 0 else base end) + coalesce(moved, 0) - (case when grp = 0 then 0 else at_base end) end::bigint as "offset", cnt as count, contains(func, 'read') as is_read from g
  where func in ('read','write','pread','pwrite'))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "j5_messages": f"with {_MESSAGES} select src, dst, tag, k, send_seq, recv_seq from m",
        "st2_rates": "select epoch_us(date_trunc('hour', ts)) as from_us, event_type, count(*)::bigint as n_calls, sum(floor(value)::bigint)::bigint as bytes from events group by 1, 2",
        "o6_cursor_intervals": f"with {_INTERVALS} select * from iv",
        "j2_event_conflicts": f"""with {_INTERVALS}, v as (select *, "offset" as a, "offset" + count as z, case when is_read then 'read' else 'write' end as rw from iv),
cc as (select x.filename, (x.a, x.rank, x.seq_id) > (y.a, y.rank, y.seq_id) as swap, x.rank as r1, x.seq_id as s1, x.rw as w1, x.a as o1, y.rank as r2, y.seq_id as s2, y.rw as w2, y.a as o2
  from v x join v y on x.filename = y.filename and x.rank < y.rank and not (x.is_read and y.is_read) and x.z > y.a and y.z > x.a)
select filename, case when swap then r2 else r1 end as rank1, case when swap then s2 else s1 end as seq1, case when swap then w2 else w1 end as rw1, case when swap then o2 else o1 end as offset1,
 case when swap then r1 else r2 end as rank2, case when swap then s1 else s2 end as seq2, case when swap then w1 else w2 end as rw2, case when swap then o1 else o2 end as offset2 from cc""",
    }
