"""From calls to verdicts: a trace of eight ranks made from the events table, matched, ordered and verified, and its SQL.

Purchases and signups are messages: a send (blocking, or posted and waited for), and on another rank a receive that is
posted one and completed two hours later, so every message goes forward in time. Ranks of equal parity talk in a
communicator of their own with ranks of its own, every ninth blocking message goes through one whose receives take any
tag, and some receives name no source or no tag but have a status. Every fortieth message is never received. At the end of
each day all ranks meet in a collective call of one of five kinds. Clicks read and write files; views and errors open,
close and synchronize them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.operators import conflicts, happens_before, mpi, offsets
from calltide.operators.sequence import scan
from calltide.runtime import cut

RANKS = 8
EPOCH_US = 1_704_067_200_000_000
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Calls at the end of a day, by its number modulo 5: function, and microseconds before the end at which the root and the others make it.
COLLECTIVES = (("MPI_Barrier", 5, 5), ("MPI_Allreduce", 5, 5), ("MPI_Bcast", 6, 5), ("MPI_Reduce", 5, 6), ("MPI_Ibcast", 8, 8))
ROOTS = (0, 0, 3, 2, 1)
_ROW = "rank int, tick bigint, ord int, event_id bigint, func string, args array<string>"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace: rank, seq_id, tid, tick_start, tick_end, func, args, category, level."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US).alias("tick"), (F.col("user_id") % RANKS).cast("int").alias("rank"), "event_type",
        ((F.col("user_id") + 1 + F.col("event_id") % 7) % RANKS).cast("int").alias("dst"), (F.floor("value") + 1).cast("string").alias("cnt"),
    )
    i, text = F.col("event_id"), lambda c: c.cast("string")
    nth = lambda n, *of: F.get(F.array(*map(F.lit, of)), (i % n).cast("int"))
    file = F.concat(F.lit("/data/f"), text(i % 10))
    handle = F.concat(F.lit("fh"), text(F.col("rank")))
    row = lambda d, tick, order, func, args: d.select("rank", tick.alias("tick"), F.lit(order).alias("ord"), "event_id", func.alias("func"), args.alias("args"))
    tick = F.col("tick")
    data = row(e.filter("event_type = 'click'"), tick, 0, nth(4, "pwrite", "pread", "pread", "pread"), F.array(file, F.lit("%p"), F.col("cnt"), text(i * 37 % 8192)))
    view = nth(6, "open", "close", "fsync", "MPI_File_sync", "MPI_File_open", "MPI_File_close")
    opened = F.array(F.lit("MPI_COMM_SELF"), file, F.lit("2"), F.lit("%p"), handle)
    views = row(e.filter("event_type = 'view'"), tick, 0, view, F.when(i % 6 == 4, opened).when(i % 6 >= 3, F.array(handle)).when(i % 6 == 0, F.array(file, F.lit("2"))).otherwise(F.array(file)))
    errors = row(e.filter("event_type = 'error'"), tick, 0, nth(2, "fopen", "fclose"), F.when(i % 2 == 0, F.array(file, F.lit("r"))).otherwise(F.array(file)))

    m = e.filter("event_type in ('purchase', 'signup')").withColumn("own", F.col("dst") % 2 == F.col("rank") % 2)
    blocking, wild = F.col("event_type") == "purchase", (F.col("event_type") == "purchase") & (i % 9 == 3)
    comm = F.when(wild, "wild").when(F.col("own"), F.concat(F.lit("c"), text(F.col("rank") % 2))).otherwise("MPI_COMM_WORLD")
    local = lambda c: text(F.when(F.col("own") & ~wild, F.floor(F.col(c) / 2)).otherwise(F.col(c)))
    tag = text(i % 3)
    head = lambda peer, t: (F.lit("%p"), F.lit("1"), F.lit("BYTE"), peer, t, comm)
    request, awaited = text(i % 50), text(500 + i % 50)
    sends = row(m, tick, 0, F.when(blocking, "MPI_Send").otherwise("MPI_Isend"), F.when(blocking, F.array(*head(local("dst"), tag))).otherwise(F.array(*head(local("dst"), tag), request)))
    sent = row(m.filter(~blocking), tick, 1, F.lit("MPI_Wait"), F.array(request, F.lit("%p")))
    r = m.filter(i % 40 != 7)
    there = lambda d: d.withColumn("_src", F.col("rank")).withColumn("rank", F.col("dst"))
    src = lambda: text(F.when(F.col("own") & ~wild, F.floor(F.col("_src") / 2)).otherwise(F.col("_src")))
    status = F.concat(F.lit("["), src(), F.lit("_"), tag, F.lit("]"))
    asked = head(F.when(i % 9 == 1, F.lit("-2")).otherwise(src()), F.when(wild | (i % 9 == 2), F.lit("-1")).otherwise(tag))
    received = row(there(r.filter(blocking)), tick + 2 * HOUR, 2, F.lit("MPI_Recv"), F.array(*asked, F.when(wild, F.lit("%p")).otherwise(status)))
    posted = row(there(r.filter(~blocking)), tick + HOUR, 2, F.lit("MPI_Irecv"), F.array(*head(src(), tag), awaited))
    got = row(there(r.filter(~blocking)), tick + 2 * HOUR, 3, F.lit("MPI_Wait"), F.array(awaited, status))

    days = e.select(F.floor(tick / DAY).alias("d")).distinct().withColumn("rank", F.explode(F.array(*map(F.lit, range(RANKS)))))
    kind = (F.col("d") % 5).cast("int")
    pick = lambda n: F.get(F.array(*[F.lit(c[n]) for c in COLLECTIVES]), kind)
    root = F.get(F.array(*map(F.lit, ROOTS)), kind)
    half = F.concat(F.lit("c"), text(F.col("rank") % 2))
    p, world = F.lit("%p"), F.lit("MPI_COMM_WORLD")
    one, byte = F.lit("1"), F.lit("BYTE")
    arguments = (
        F.when(kind == 0, F.array(world)).when(kind == 1, F.array(p, p, one, byte, one, half)).when(kind == 2, F.array(p, one, byte, text(root), world))
        .when(kind == 3, F.array(p, p, one, byte, one, text(root), world)).otherwise(F.array(p, one, byte, text(root), world, F.lit("900")))
    )
    end = (F.col("d") + 1) * DAY
    days = days.withColumn("event_id", F.lit(-1).cast("bigint"))
    met = row(days, end - F.when(F.col("rank") == root, pick(1)).otherwise(pick(2)), 4, pick(0), arguments)
    waited = row(days.filter(kind == 4), end - F.when(F.col("rank") == root, 6).otherwise(5), 5, F.lit("MPI_Wait"), F.array(F.lit("900"), p))
    split = spark.range(RANKS).select(F.col("id").cast("int").alias("rank"), F.lit(-1).cast("bigint").alias("event_id"))
    split = row(split, F.lit(-100).cast("bigint"), 0, F.lit("MPI_Comm_split"), F.array(world, text(F.col("rank") % 2), text(F.col("rank")), half, text(F.floor(F.col("rank") / 2))))

    every = data
    for more in (views, errors, sends, sent, received, posted, got, met, waited, split):
        every = every.unionByName(more)
    every = scan(every, ["rank"], ["tick", "ord", "event_id"], {"seq_id": ("sum", F.lit(1), False)}, 1 << 36)
    category = F.when(F.col("func").startswith("MPI_File"), 1).when(F.col("func").startswith("MPI"), 2).otherwise(0)
    return cut(
        every.select("rank", F.col("seq_id").cast("bigint").alias("seq_id"), F.lit(0).cast("bigint").alias("tid"), F.col("tick").alias("tick_start"), F.col("tick").alias("tick_end"), "func", "args", category.alias("category"), F.lit(0).alias("level")),
        "flagship-calls",
    )


class Matched:
    """The message-passing calls of a trace, matched: messages, groups, completions, and the edges of the order."""

    def __init__(self, trace: DataFrame, strict: bool = False, like: Matched | None = None):
        """``like``: the same trace matched by the other rule for groups; messages don't depend on it."""
        if like is None:
            shapes = cut(mpi.normalize(trace), "mpi-calls")
            comms = cut(mpi.communicators(trace), "communicators")
            self.done = cut(mpi.completions(shapes), "completions")
            self.calls = cut(mpi.to_world(mpi.to_world(shapes, comms, "src"), comms, "dst"), "world-ranks")
            self.pairs = cut(mpi.point_to_point(self.calls, self.done), "messages")
        else:
            self.done, self.calls, self.pairs = like.done, like.calls, like.pairs
        self.groups = cut(mpi.collectives(self.calls, self.done, strict), "groups")
        self.edges = cut(happens_before.edges_of(self.pairs, self.groups), "edges")


def j5_matched_messages(spark, d):
    """Messages of all kinds of sends and receives; local ranks translated, any source and any tag resolved."""
    return Matched(calls(spark, d)).pairs


def j4_groups(spark, d):
    """Members of collective groups; non-blocking calls stand where they complete."""
    m = Matched(calls(spark, d))
    return m.groups.select("func", "comm", "k", F.explode("members").alias("m")).select("func", "comm", F.col("k").cast("bigint").alias("k"), "m.rank", "m.seq_id")


def a17_unmatched(spark, d):
    """Calls without a partner."""
    m = Matched(calls(spark, d))
    return mpi.unmatched(m.calls, m.pairs, m.groups, m.done)


def g1_edges(spark, d):
    """Edges between ranks; those of an all-to-all group lead to the group."""
    return Matched(calls(spark, d)).edges.select("src_rank", "src_seq", "dst_rank", "dst_seq", "kind")


def g4_clocks(spark, d):
    """What every ordered call knows of each rank when it begins and when it ends."""
    return happens_before.clocks(Matched(calls(spark, d)).edges)


def _judged(spark: SparkSession, sf_dir: str, *rules: str) -> DataFrame:
    """Every conflict, and for each rule a column: whether it is properly synchronized."""
    trace = calls(spark, sf_dir)
    ranges = cut(offsets.intervals(trace), "ranges")
    matched, known = None, []
    for strict in (False, True):
        if mine := [r for r in rules if (r == "mpi-io") == strict]:
            matched = Matched(trace, strict, matched)
            lists, ranks, nodes = happens_before.clock_lists(matched.edges)
            known.append((None if lists is None else cut(lists, "clocks"), ranks, mine, nodes, matched.edges))
    if all(lists is not None and len(ranks) <= happens_before.CARRIED_RANKS for lists, ranks, *_ in known):
        return happens_before.judged_pairs(ranges, trace, [k[:3] for k in known])
    pairs, out = cut(conflicts.conflict_pairs(ranges, None), "conflicts"), None
    for lists, ranks, mine, nodes, edges in known:
        rows = cut(happens_before.clocks_by_rounds(nodes, edges) if lists is None else happens_before.clock_rows(lists, ranks), "clock-rows")
        for r in mine:
            one = happens_before.verify(pairs, trace, rows, r).withColumnRenamed("ok", r)
            out = one if out is None else out.join(one, ["rank1", "seq1", "rank2", "seq2"])
    return out


def v1_posix(spark, d):
    """Each conflict, and whether one access happens before the other."""
    return _judged(spark, d, "posix").withColumnRenamed("posix", "ok")


def v2_session(spark, d):
    """Each conflict under session semantics."""
    return _judged(spark, d, "session").withColumnRenamed("session", "ok")


def v3_mpiio(spark, d):
    """Each conflict under MPI-IO semantics, where only collectives order that must synchronize."""
    return _judged(spark, d, "mpi-io").withColumnRenamed("mpi-io", "ok")


def v4_commit(spark, d):
    """Each conflict under commit semantics."""
    return _judged(spark, d, "commit").withColumnRenamed("commit", "ok")


def a16_verdicts(spark, d):
    """The verdict on the whole trace, by rule."""
    rules = ("posix", "session", "mpi-io", "commit")
    no = lambda r: F.coalesce(F.sum((~F.col(r)).cast("bigint")), F.lit(0))
    whole = _judged(spark, d, *rules).agg(F.count("*").alias("n_pairs"), *[no(r).alias(r) for r in rules])
    one = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n_violations")) for r in rules])).alias("v")
    return whole.select("n_pairs", one).select("n_pairs", "v.n_violations", (F.col("v.n_violations") == 0).alias("properly_synchronized"), "v.rule")


_QUERIES = (j5_matched_messages, j4_groups, a17_unmatched, g1_edges, g4_clocks, v1_posix, v2_session, v3_mpiio, v4_commit, a16_verdicts)


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


#: The same trace without arguments: tr(rank, seq_id, tick, event_id, func, src, dst, comm, tag, d).
_TRACE = f"""
ev as (select event_id as i, epoch_us(ts) - {EPOCH_US} as tick, (user_id % 8)::int as rank, event_type as t, ((user_id + 1 + event_id % 7) % 8)::int as dst, floor(value)::bigint + 1 as cnt from events),
ms as (select *, t = 'purchase' as blocking, t = 'purchase' and i % 9 = 3 as wild, case when t = 'purchase' and i % 9 = 3 then 'wild' when dst % 2 = rank % 2 then 'c' || (rank % 2) else 'MPI_COMM_WORLD' end as comm from ev where t in ('purchase', 'signup')),
dy as (select d, d % 5 as kind, unnest(range(8))::int as rank, [0, 0, 3, 2, 1][d % 5 + 1] as root from (select distinct tick // {DAY} as d from ev)),
t0 as (
  select rank, tick, 0 as ord, i, case when i % 4 = 0 then 'pwrite' else 'pread' end as func, null::int as src, null::int as dst, null as comm, null::bigint as tag, null::bigint as d, null::int as root from ev where t = 'click'
  union all select rank, tick, 0, i, ['open','close','fsync','MPI_File_sync','MPI_File_open','MPI_File_close'][i % 6 + 1], null, null, null, null, null, null from ev where t = 'view'
  union all select rank, tick, 0, i, ['fopen','fclose'][i % 2 + 1], null, null, null, null, null, null from ev where t = 'error'
  union all select rank, tick, 0, i, case when blocking then 'MPI_Send' else 'MPI_Isend' end, rank, dst, comm, i % 3, null, null from ms
  union all select rank, tick, 1, i, 'sent', null, null, null, null, null, null from ms where not blocking
  union all select dst, tick + case when blocking then {2 * HOUR} else {HOUR} end, 2, i, case when blocking then 'MPI_Recv' else 'MPI_Irecv' end, rank, dst, comm, i % 3, null, null from ms where i % 40 <> 7
  union all select dst, tick + {2 * HOUR}, 3, i, 'got', null, null, null, null, null, null from ms where not blocking and i % 40 <> 7
  union all select rank, (d + 1) * {DAY} - case kind when 2 then case when rank = root then 6 else 5 end when 3 then case when rank = root then 5 else 6 end when 4 then 8 else 5 end, 4, -1,
    ['MPI_Barrier','MPI_Allreduce','MPI_Bcast','MPI_Reduce','MPI_Ibcast'][kind + 1], null, null, case when kind = 1 then 'c' || (rank % 2) else 'MPI_COMM_WORLD' end, null, d, root from dy
  union all select rank, (d + 1) * {DAY} - case when rank = root then 6 else 5 end, 5, -1, 'met', null, null, null, null, d, root from dy where kind = 4
  union all select r::int, -100, 0, -1, 'MPI_Comm_split', null, null, 'c' || (r % 2), null, -1, null from range(8) x(r)),
tr as (select *, row_number() over (partition by rank order by tick, ord, i) - 1 as seq_id from t0),
s as (select *, row_number() over (partition by src, dst, comm, case when comm <> 'wild' then tag end order by seq_id) as k from tr where func in ('MPI_Send', 'MPI_Isend')),
rc as (select a.*, coalesce(b.seq_id, a.seq_id) as place, coalesce(b.tick, a.tick) as at, row_number() over (partition by a.src, a.dst, a.comm, case when a.comm <> 'wild' then a.tag end order by a.seq_id) as k
  from tr a left join tr b on b.func = 'got' and b.i = a.i and a.func = 'MPI_Irecv' where a.func in ('MPI_Recv', 'MPI_Irecv')),
mp as (select s.src, s.dst, s.comm, s.seq_id as send_seq, rc.place as recv_seq, s.tick as sent, rc.at as got from s join rc on rc.src = s.src and rc.dst = s.dst and rc.comm = s.comm and rc.k = s.k and (s.comm = 'wild' or rc.tag = s.tag)),
gr as (select a.func, a.comm, a.rank, a.root, a.d, coalesce(b.seq_id, a.seq_id) as seq_id, coalesce(b.tick, a.tick) as tick, row_number() over (partition by a.func, a.comm, a.rank order by a.seq_id) - 1 as k
  from tr a left join tr b on b.func = 'met' and b.d = a.d and b.rank = a.rank and a.func = 'MPI_Ibcast' where a.func in ('MPI_Barrier','MPI_Allreduce','MPI_Bcast','MPI_Reduce','MPI_Ibcast','MPI_Comm_split'))
"""


def _edges_sql(strict: bool) -> str:
    """ed(sr, ss, dr, ds, kind, g): edges; g is the group of an all-to-all member."""
    synchronizing = "('MPI_Barrier', 'MPI_Allreduce')" if strict else "('MPI_Barrier', 'MPI_Allreduce', 'MPI_Comm_split')"
    rooted = (
        ""
        if strict
        else """
  union all select a.rank, a.seq_id, b.rank, b.seq_id, 'one-to-many', null from gr a join gr b on a.func = b.func and a.d = b.d and a.rank = a.root and b.rank <> b.root where a.func in ('MPI_Bcast', 'MPI_Ibcast')
  union all select b.rank, b.seq_id, a.rank, a.seq_id, 'many-to-one', null from gr a join gr b on a.func = b.func and a.d = b.d and a.rank = a.root and b.rank <> b.root where a.func = 'MPI_Reduce'"""
    )
    return f"""{_TRACE},
ed as (select src as sr, send_seq as ss, dst as dr, recv_seq as ds, 'p2p' as kind, null::varchar as g from mp{rooted}
  union all select rank, seq_id, null::int, null::bigint, 'all-to-all', func || comm || d from gr where func in {synchronizing})"""


def _clocks_sql(strict: bool = False) -> str:
    """kn(rank, seq_id, idx, enter, leave): clocks as lists, found one call after another in an order of time that fits all edges.

    Groups stand among the calls, behind their members; a call follows the group of the call before it.
    """
    ranks = range(RANKS)
    zero = ", ".join(f"0::bigint as c{k}" for k in ranks)
    grown = ", ".join(f"greatest(coalesce(max(r.c{k}), 0), case when n.rank = {k} then n.idx else 0 end)::bigint" for k in ranks)
    listed = lambda t: "[" + ", ".join(f"{t}.c{k}" for k in ranks) + "]"
    most = "[" + ", ".join(f"greatest(c.c{k}, coalesce(g.c{k}, 0))" for k in ranks) + "]"
    return f"""{_edges_sql(strict)},
nd as (select rank, seq_id, max(g) as g from (select sr as rank, ss as seq_id, g from ed union all select dr, ds, null::varchar from ed where dr is not null) group by 1, 2),
ni as (select nd.*, tr.tick, row_number() over (partition by nd.rank order by nd.seq_id) as idx from nd join tr on tr.rank = nd.rank and tr.seq_id = nd.seq_id),
od as (select *, row_number() over (order by tick, ghost, seq_id, rank) as i from (select rank, seq_id, idx, g, tick, 0 as ghost from ni union all select -1, 0, 0, g, max(tick), 1 from ni where g is not null group by g)),
ep as (select b.i, coalesce(h.i, a.i) as p from od a join od b on a.ghost = 0 and b.ghost = 0 and a.rank = b.rank and b.idx = a.idx + 1 left join od h on h.ghost = 1 and h.g = a.g
  union all select b.i, a.i from ed join od a on a.rank = ed.sr and a.seq_id = ed.ss and a.ghost = 0 join od b on b.rank = ed.dr and b.seq_id = ed.ds and b.ghost = 0
  union all select h.i, a.i from od a join od h on h.ghost = 1 and a.ghost = 0 and h.g = a.g),
ck using key (i) as (select 0::bigint as i, {zero} union all
  select n.i, {grown} from (select max(i) as i from ck) w join od n on n.i = w.i + 1 left join ep on ep.i = n.i left join recurring.ck r on r.i = ep.p group by n.i, n.rank, n.idx),
kn as (select o.rank, o.seq_id, o.idx, {listed("c")} as enter, {most} as leave from od o join ck c on c.i = o.i left join od h on h.ghost = 1 and h.g = o.g left join ck g on g.i = h.i where o.ghost = 0)"""


def _judged_sql(rule: str) -> str:
    """jd(rank1, seq1, rank2, seq2, ok)."""
    names = {
        "session": ("('close', 'fclose')", "('open', 'fopen')"),
        "mpi-io": ("('MPI_File_close', 'MPI_File_sync')", "('MPI_File_open', 'MPI_File_sync')"),
        "commit": ("('fsync', 'close', 'fclose')", "('fsync', 'close', 'fclose')"),
    }
    ask = "select q, ra, sa, rb, sb from both_ways"
    extra = ""
    if rule != "posix":
        closing, opening = names[rule]
        extra = f""",
cl as (select rank, seq_id from tr where func in {closing}), op as (select rank, seq_id from tr where func in {opening}),
sy as (select p.*, c.seq_id as c, o.seq_id as o from both_ways p asof left join cl c on c.rank = p.ra and c.seq_id > p.sa asof left join op o on o.rank = p.rb and o.seq_id < p.sb)"""
        ask = "select q, ra, c, rb, o from sy" if rule != "commit" else "select q, ra, c as sa, rb, sb from sy union all select q, ra, sa, rb, o from sy"
    return f"""{_clocks_sql(rule == "mpi-io")},
io as (select tr.rank, tr.seq_id, ev.i % 10 as f, ev.i * 37 % 8192 as a, ev.i * 37 % 8192 + ev.cnt as z, tr.func = 'pread' as rd from tr join ev on ev.i = tr.i where tr.func in ('pread', 'pwrite')),
cp as (select row_number() over () as q, x.rank as r1, x.seq_id as s1, y.rank as r2, y.seq_id as s2 from io x join io y on x.f = y.f and x.rank <> y.rank and not (x.rd and y.rd) and x.z > y.a and y.z > x.a and (x.a, x.rank, x.seq_id) < (y.a, y.rank, y.seq_id)),
both_ways as (select q, r1 as ra, s1 as sa, r2 as rb, s2 as sb from cp union all select q, r2, s2, r1, s1 from cp){extra},
aq as ({ask}), aa as (select * from aq as t(q, ra, sa, rb, sb) where sa is not null and sb is not null),
hb as (select aa.q, coalesce(case when h.seq_id = aa.sb then h.enter else h.leave end[aa.ra + 1] >= n.idx, false) as before from aa asof left join kn n on n.rank = aa.ra and n.seq_id >= aa.sa asof left join kn h on h.rank = aa.rb and h.seq_id <= aa.sb),
jd as (select r1 as rank1, s1 as seq1, r2 as rank2, s2 as seq2, coalesce(bool_or(before), false) as ok from cp left join hb using (q) group by 1, 2, 3, 4)"""


def oracle_sql() -> dict[str, str]:
    verdict = "select '{}' as rule, count(*)::bigint as n_pairs, count(*) filter (where not ok)::bigint as n_violations, coalesce(bool_and(ok), true) as properly_synchronized from jd"
    rules = {"v1_posix": "posix", "v2_session": "session", "v3_mpiio": "mpi-io", "v4_commit": "commit"}
    return {
        "j5_matched_messages": f"with {_TRACE} select src, dst, comm, send_seq, recv_seq from mp",
        "j4_groups": f"with {_TRACE} select func, comm, k, rank, seq_id from gr",
        "a17_unmatched": f"""with {_TRACE} select src as rank, 'send' as kind, count(*)::bigint as n_unmatched from s where (src, seq_id) not in (select (src, send_seq) from mp) group by 1
union all select rank, 'collective', count(*)::bigint from tr where starts_with(func, 'MPI_File') group by 1""",
        "g1_edges": f"with {_edges_sql(False)} select sr as src_rank, ss as src_seq, dr as dst_rank, ds as dst_seq, kind from ed",
        "g4_clocks": f"with recursive {_clocks_sql()} select * from (select rank, seq_id, idx, unnest(range(8))::int as r, unnest(enter) as enter, unnest(leave) as leave from kn) where leave > 0",
        **{name: f"with recursive {_judged_sql(rule)} select * from jd" for name, rule in rules.items()},
        "a16_verdicts": " union all ".join(f"select * from (with recursive {_judged_sql(rule)} {verdict.format(rule)})" for rule in rules.values()),
    }
