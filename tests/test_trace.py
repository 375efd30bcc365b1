"""Micro-traces for the operators over calls."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calltide.functions import facts
from calltide.operators import callers, conflicts, happens_before, mpi, offsets, stats
from calltide.operators.sequence import dense_positions, neighbours, scan
from calltide.plans import events
from calltide.plans import trace as queries
from calltide.sources import export, layout, trace
from calltide.streaming import live

CALL = "rank int, seq_id bigint, tid bigint, tick_start bigint, tick_end bigint, func string, args array<string>, category int, level int, func_id smallint, tstart double, tend double, arg_count int"


def calls(spark, rows):
    """rows: (rank, seq_id, func, args[, level[, tick]])."""
    out = []
    for r, s, f, a, *rest in rows:
        level = rest[0] if rest else 0
        tick = rest[1] if len(rest) > 1 else s * 10
        cat = 3 if f.startswith("H5") else 1 if f.startswith("MPI_File") else 2 if f.startswith("MPI") else 0
        out.append((r, s, 0, tick, tick + 5, f, a, cat, level, 1, tick * 1e-7, (tick + 5) * 1e-7, len(a)))
    return spark.createDataFrame(out, CALL)


def simulate(rows):
    """Literal walk in time order."""
    end, cur, out = {}, {}, set()
    for r, s, f, a, *rest in sorted(rows, key=lambda x: (x[5] if len(x) > 5 else x[1] * 10, x[0], x[1])):
        p = a[3] if f in ("fread", "fwrite") else a[0]
        if f in ("read", "write", "fread", "fwrite", "readv", "writev"):
            n = int(a[1]) * int(a[2]) if f[0] == "f" else int(a[1]) if f.endswith("v") else int(a[2])
            o = cur.get((r, p), 0)
            out.add((p, r, s, o, n))
            cur[r, p] = o + n
            end[p] = max(end.get(p, 0), o + n)
        elif f in ("pread", "pwrite"):
            out.add((p, r, s, int(a[3]), int(a[2])))
            end[p] = max(end.get(p, 0), int(a[3]) + int(a[2]))
        elif f == "open":
            cur[r, p] = end.get(p, 0) if int(a[1]) & 0x400 else 0
        elif f == "lseek":
            cur[r, p] = {"0": int(a[1]), "1": cur.get((r, p), 0) + int(a[1]), "2": end.get(p, 0)}[a[2]]
        elif f == "close":
            cur[r, p] = 0
    return out


@pytest.mark.parametrize(("seed", "ends"), [(1, False), (2, True)])
def test_offsets_like_simulation(spark, seed, ends):
    rnd = random.Random(seed)
    rows, used = [], set()
    for r in range(4):
        for s in range(150):
            p = f"/f{rnd.randrange(3)}"
            f = rnd.choice(["open", "read", "write", "pread", "pwrite", "lseek", "close", "fwrite", "readv"])
            a = {
                "open": [p, str(0x400 if ends and rnd.random() < 0.3 else 2)], "lseek": [p, str(rnd.randrange(900)), rnd.choice("012" if ends else "01")], "close": [p],
                "fwrite": ["%p", "4", str(rnd.randrange(9)), p], "readv": [p, str(rnd.randrange(90)), "3"],
            }.get(f, [p, "%p", str(rnd.randrange(90)), str(rnd.randrange(9000))])
            t = rnd.randrange(10**6)
            while (r, t) in used:
                t += 1
            used.add((r, t))
            rows.append((r, s, f, a, 0, t))
    got = {(x.filename, x.rank, x.seq_id, x.offset, x["count"]) for x in offsets.intervals(calls(spark, rows), width=50_000).collect()}
    assert got == simulate(rows)


def test_handles(spark):
    rows = [(0, 0, "MPI_File_write_at", ["fh0", "0"], 0), (0, 1, "pwrite", ["/a", "%p", "5", "0"], 1), (0, 2, "pwrite", ["/a", "%p", "5", "9"], 0), (1, 0, "pwrite", ["/a", "%p", "5", "0"], 1)]
    got = {(r["rank"], r.seq_id): r.mpifh for r in offsets.intervals(calls(spark, rows)).collect()}
    assert got == {(0, 1): "fh0", (0, 2): "-", (1, 0): "-"}


def brute_conflicts(rows):
    out = set()
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if x[0] == y[0] and x[1] != y[1] and not (x[5] and y[5]) and x[3] + x[4] > y[3] and y[3] + y[4] > x[3]:
                out.add(frozenset([(x[1], x[2]), (y[1], y[2])]))
    return out


def test_conflicts_like_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("ab"), rnd.randrange(4), i, rnd.choice([0, 4096, rnd.randrange(20_000), 2**33]), rnd.choice([0, 1, 10, 4096, 50_000, 2**34]), rnd.random() < 0.5, "-") for i in range(250)]
    df = spark.createDataFrame(rows, "filename string, rank int, seq_id bigint, offset bigint, count bigint, is_read boolean, mpifh string")
    got = [frozenset([(r.rank1, r.seq1), (r.rank2, r.seq2)]) for r in conflicts.conflict_pairs(df, 512).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_conflicts(rows)


def test_conflict_queries_need_no_time(spark, tmp_path):
    rows = [("a", 0, 0, None, 0, 10, False), ("a", 1, 1, 1.0, 5, 10, None), ("a", 2, 2, 2.0, 0, 8, True), ("a", 2, 2, None, 90, 8, None), ("a", 3, 3, 3.0, 0, None, False)]
    schema = "filename string, rank int, seq_id bigint, tstart double, offset bigint, count bigint, is_read boolean, mpifh string"
    spark.createDataFrame([(*r, None) for r in rows], schema).write.parquet(f"{tmp_path}/intervals.parquet")
    got = {(r.rank1, r.rw1, r.rank2, r.rw2) for r in queries.j2_conflicts(spark, str(tmp_path)).collect()}
    assert got == {(0, "write", 1, "write"), (0, "write", 2, "read"), (2, "read", 1, "write")}
    assert {(r.rank1, r.n_conflicts) for r in queries.a15_conflict_counts(spark, str(tmp_path)).collect()} == {(0, 2), (2, 1)}
    assert {r.line for r in queries.k13_conflict_lines(spark, str(tmp_path)).collect()} == {"0,0,write,-:1,1,write,- 2,2,read,-", "2,2,read,-:1,1,write,-"}


def test_conflict_text_round_trip(spark, tmp_path):
    rows = [("a", r, r, 0, 10, False, f"fh{r}") for r in range(4)] + [("b", 0, 9, 0, 1, False, "-"), ("b", 1, 9, 0, 1, True, "-")]
    df = spark.createDataFrame(rows, "filename string, rank int, seq_id bigint, offset bigint, count bigint, is_read boolean, mpifh string")
    pairs = conflicts.conflict_pairs(df)
    export.write_conflicts(conflicts.conflict_lines(pairs), f"{tmp_path}/c")
    back = export.read_conflicts(spark, f"{tmp_path}/c")
    cols = ["rank1", "seq1", "rw1", "fh1", "rank2", "seq2", "rw2", "fh2"]
    assert {tuple(r) for r in back.select(cols).collect()} == {tuple(r) for r in pairs.select(cols).collect()} and pairs.count() == 7


def test_scan_and_positions(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 2, None]), rnd.randrange(10_000), i, rnd.choice([None, rnd.randrange(9)])) for i in range(800)]
    df = spark.createDataFrame(rows, "k int, t bigint, i bigint, v bigint")
    out = scan(df, ["k"], ["t", "i"], {"s": ("sum", F.col("v"), True), "m": ("max", F.col("v"), False), "l": ("last", F.col("v"), False)}, 700)
    back = scan(df, ["k"], ["t", "i"], {"l": ("last", F.col("v"), False)}, 700, descending=True)
    want, want_back = {}, {}
    for k in (1, 2, None):
        s, m, last = 0, None, None
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3])
        for r in mine:
            s += r[3] or 0
            want[r[2]] = (s, m, last)
            if r[3] is not None:
                m, last = max(m if m is not None else -1, r[3]), r[3]
        last = None
        for r in reversed(mine):
            want_back[r[2]] = last
            last = r[3] if r[3] is not None else last
    assert {r.i: (r.s, r.m, r.l) for r in out.collect()} == want
    assert {r.i: r.l for r in back.collect()} == want_back
    pos = dense_positions(df.select("k", "i"), ["k"], "i", 50)
    near = neighbours(pos, ["k"], "_pos", {"p": (lambda w: F.lag("i", 2).over(w), 2, 0), "n": (lambda w: F.lead("i").over(w), 0, 1)}, 16)
    for k in (1, 2, None):
        order = sorted(r[2] for r in rows if r[0] == k)
        got = {r._pos: (r.i, r.p, r.n) for r in near.filter(F.col("k").eqNullSafe(k)).collect()}
        assert got == {j: (x, order[j - 2] if j > 1 else None, order[j + 1] if j + 1 < len(order) else None) for j, x in enumerate(order)}


def test_callers(spark):
    rows = [(0, 0, "H5Dopen", [], 0), (0, 1, "MPI_File_open", [], 1), (0, 2, "access", ["/a", "0"], 2), (0, 3, "mkdir", ["/d", "0"], 0), (0, 4, "H5Fcreate", [], 0), (0, 5, "unlink", ["/a"], 1), (1, 0, "access", ["/a", "0"], 0)]
    codes = callers.caller_codes(calls(spark, rows))
    assert {r.func: r.code for r in codes.collect()} == {"access": 3, "mkdir": 3, "unlink": 2}
    report = callers.caller_report(spark, codes).orderBy("place").collect()
    assert len(report) == 20 and {r.func: r.code for r in report}["umask"] == 0


def test_callers_at_any_depth(spark):
    chain = ["H5Dwrite", "MPI_File_write_at", "user_a", "user_b", "H5Pget_chunk", "access", "mkdir"]
    rows = [(0, k, f, [], k) for k, f in enumerate(chain)] + [(0, 9, "MPI_Wait", [], 4), (0, 10, "unlink", [], 5)]
    got = {r.func: r.caller for r in callers.with_caller(calls(spark, rows), 4).collect()}
    assert got == {"H5Dwrite": None, **dict(zip(chain[1:], chain)), "MPI_Wait": "user_b", "unlink": "MPI_Wait"}
    assert {r.func: r.code for r in callers.caller_codes(calls(spark, rows), 4).collect()} == {"access": 2, "mkdir": 0, "unlink": 1, "user_a": 1, "user_b": 0}


def test_levels_from_containment(spark):
    rows = [(0, 0, 0, 100), (0, 1, 10, 50), (0, 2, 20, 30), (0, 3, 50, 60), (0, 4, 60, 60), (0, 5, 200, 210)]
    df = spark.createDataFrame([(r, s, 0, a, b, "read", [], 0, 0, 1, 0.0, 0.0, 0) for r, s, a, b in rows], CALL)
    assert {r.seq_id: r.depth for r in callers.derive_levels(df, 40).collect()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 1, 5: 0}


def test_paths_and_sizes(spark):
    rows = [(0, 0, "open", ["/tmp/x", "0"]), (0, 1, "open", ["/lus/y", "0"]), (0, 2, "fread", ["%p", "4", "8", "/lus/y"]), (0, 3, "writev", ["/lus/y", "64", "3"]), (0, 4, "vfprintf", ["/lus/y", "9"]), (0, 5, "mkdir", ["/lus", "7"])]
    rows += [(0, 6, "MPI_File_open", ["w", "/tmp/z", "0", "%p", "fh1"]), (0, 7, "MPI_File_write_at", ["fh1", "0"]), (0, 8, "MPI_File_open", ["w", "/lus/z", "0", "%p", "fh2"]), (0, 9, "MPI_File_write_at", ["fh2", "0"])]
    df = calls(spark, rows)
    assert {r.seq_id for r in facts.filter_paths(df, ["/tmp"]).collect()} == {1, 2, 3, 4, 5, 6, 8, 9}
    assert {r.seq_id for r in facts.filter_paths(df, ["/tmp"], ["/lus/y"]).filter("category = 0").collect()} == {1, 2, 3, 4}
    assert {r.size: r.n_calls for r in stats.size_histogram(df).collect()} == {32: 1, 64: 1, 9: 1}


def test_linear_offsets(spark):
    rows = [(r, t, "pwrite", 4096 * r + 512 if t == 0 else (r * r) * 100) for r in range(4) for t in (0, 1)]
    rows += [(r, 5, "pread", r * 8) for r in range(2)]
    out = stats.linear_offsets(spark.createDataFrame(rows, "rank int, terminal_id int, func string, offset bigint"))
    assert [tuple(r) for r in out.collect()] == [("pwrite", 0, 4096, 512, 4)]


def test_linear_offsets_by_group(spark):
    # ranks 1, 4 and 9 have two signatures each, the others one: every group is tested by itself, by places in it
    rows = [(r, t, "pwrite", 100 * i + 7 if t == 0 else 50) for i, r in enumerate((1, 4, 9)) for t in (0, 1)]
    rows += [(r, 0, "pwrite", (5, 15, 25, 36)[i]) for i, r in enumerate((0, 2, 3, 5))]
    rows += [(r, 0, "lseek", None if r == 2 else 8 * r) for r in range(4)]
    out = stats.linear_offsets(spark.createDataFrame(rows, "rank int, terminal_id int, func string, offset bigint"))
    assert {tuple(r) for r in out.collect()} == {("pwrite", 0, 100, 7, 3), ("pwrite", 1, 0, 50, 3)}


def test_linear_offsets_of_all_functions(spark, tmp_path):
    places = {"pread": 3, "lseek": 1, "MPI_File_write_at": 1, "mmap": 5, "write": 2}
    names = list(enumerate(places))
    spark.createDataFrame([(i, f, 1 if f.startswith("MPI") else 0) for i, f in names], "func_id smallint, name string, category int").write.parquet(f"{tmp_path}/function_list.parquet")
    rows = [(r, i, i, 0, 1, ["x"] * places[f] + [str(r * 64)]) for r in range(3) for i, f in names]
    spark.createDataFrame(rows, "rank int, terminal_id int, func_id smallint, level int, count bigint, args array<string>").write.parquet(f"{tmp_path}/cst.parquet")
    assert {tuple(r) for r in queries.k17_linear_offsets(spark, str(tmp_path)).collect()} == {(f, 0, 64, 0, 3) for f in places if f != "write"}


def test_merge_signatures(spark):
    rows = [(0, 0, 3, 0, 5, 0, ["a"]), (0, 1, 2, 0, 6, 0, ["b"]), (1, 0, 4, 0, 6, 0, ["b"]), (2, 0, 9, 0, 7, 0, None), (2, 1, None, 0, 5, 0, ["a"])]
    out = stats.merge_signatures(spark.createDataFrame(rows, "rank int, terminal_id int, count bigint, tid bigint, func_id smallint, level int, args array<string>"))
    assert {(r.terminal_id, r.func_id, r["count"], r["rank"]) for r in out.collect()} == {(0, 5, 3, 0), (1, 6, 6, 0), (2, 7, 9, 2)}


def test_deltas_round_trip(spark):
    df = calls(spark, [(r, s, "read", ["/a", "%p", "1"], 0, s * s * 7 + r) for r in range(2) for s in range(40)])
    back = stats.absolute_times(stats.delta_times(df, 8), width=8)
    assert {(r["rank"], r.seq_id, r.tick_start, r.tick_end) for r in back.collect()} == {(r["rank"], r.seq_id, r.tick_start, r.tick_end) for r in df.collect()}


def test_matching_with_tests_and_wildcards(spark):
    w = "MPI_COMM_WORLD"
    rows = [
        (0, 0, "MPI_Send", ["%p", "1", "INT", "1", "7", w]), (0, 1, "MPI_Send", ["%p", "1", "INT", "1", "8", w]), (0, 2, "MPI_Isend", ["%p", "1", "INT", "1", "9", w, "r1"]), (0, 3, "MPI_Wait", ["r1", "MPI_STATUS_IGNORE"]),
        (1, 0, "MPI_Irecv", ["%p", "1", "INT", "0", "8", w, "q1"]), (1, 1, "MPI_Irecv", ["%p", "1", "INT", "0", "-1", w, "q2"]), (1, 2, "MPI_Testsome", ["2", "[q1,q2]", "0", "[]", "%p"]),
        (1, 3, "MPI_Testsome", ["2", "[q1,q2]", "1", "[1]", "%p"]), (1, 4, "MPI_Waitany", ["2", "[q1,q2]", "0", "%p"]), (1, 5, "MPI_Recv", ["%p", "1", "INT", "-2", "-1", w, "[0_9]"]), (1, 6, "MPI_Irecv", ["%p", "1", "INT", "0", "3", w, "q9"]),
        (0, 9, "MPI_Bcast", ["%p", "1", "INT", "0", w]), (1, 9, "MPI_Bcast", ["%p", "1", "INT", "0", w]), (0, 10, "MPI_Barrier", [w]), (1, 10, "MPI_Barrier", [w]), (1, 11, "MPI_Barrier", [w]),
    ]
    m = mpi.normalize(calls(spark, rows))
    done = mpi.completions(m)
    assert {tuple(r) for r in done.collect()} == {(0, 2, 3), (1, 1, 3), (1, 0, 4)}
    pairs = mpi.point_to_point(m, done)
    # the open receive takes the earliest send that is left when it is its turn
    assert {(r.send_seq, r.recv_seq) for r in pairs.collect()} == {(0, 3), (1, 4), (2, 5)}
    groups = mpi.collectives(m, done)
    assert sorted((r.func, r.k, len(r.members)) for r in groups.collect()) == [("MPI_Barrier", 0, 2), ("MPI_Bcast", 0, 2)]
    left = {(r["rank"], r.kind): r.n_unmatched for r in mpi.unmatched(m, pairs, groups, done).collect()}
    assert left == {(1, "recv"): 1, (1, "collective"): 1}
    assert [r.func for r in mpi.collectives(m, done, only_synchronizing=True).collect()] == ["MPI_Barrier"]


def test_communicators(spark):
    rows = [(0, 0, "MPI_Comm_split", ["w", "0", "0", "0-1", "0"]), (1, 0, "MPI_Comm_split", ["w", "0", "0", "0-1", "1"]), (2, 0, "MPI_Comm_split", ["w", "9", "0", "MPI_COMM_NULL", "-1"]), (1, 1, "MPI_Reduce", ["%p", "%p", "1", "I", "+", "1", "0-1"])]
    c = calls(spark, rows)
    comms = mpi.communicators(c)
    assert {tuple(r) for r in comms.collect()} == {("0-1", 0, 0), ("0-1", 1, 1)}
    assert mpi.to_world(mpi.normalize(c).filter("func = 'MPI_Reduce'"), comms, "src").first().src == 1


def reach(edges):
    """All pairs of the literal graph with ghost nodes: edges (src_rank, src_seq, dst_rank, dst_seq, grp)."""
    nodes = sorted({(e[0], e[1]) for e in edges} | {(e[2], e[3]) for e in edges if e[2] is not None})
    ghost = {(e[0], e[1]): ("g", e[4]) for e in edges if e[4] is not None}
    after = {n: set() for n in [*nodes, *ghost.values()]}
    for a, b in zip(nodes, nodes[1:]):
        if a[0] == b[0]:
            after[a].add(b)
            if a in ghost:
                after[ghost[a]].add(b)
    for n, g in ghost.items():
        after[n].add(g)
    for e in edges:
        if e[2] is not None:
            after[e[0], e[1]].add((e[2], e[3]))
    out = set()
    for n in nodes:
        todo, seen = [n], set()
        while todo:
            for x in after[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        out |= {(n, x) for x in seen if x[0] != "g"}
    return nodes, out


def random_edges(seed):
    rnd = random.Random(seed)
    at, edges = [0] * 4, []
    for k in range(14):
        if rnd.random() < 0.6:
            a, b = rnd.sample(range(4), 2)
            at[a] += rnd.randrange(1, 3)
            at[b] += rnd.randrange(1, 3)
            edges.append((a, at[a], b, at[b], None))
        else:
            for r in rnd.sample(range(4), rnd.randrange(2, 5)):
                at[r] += 1
                edges.append((r, at[r], None, None, k))
    return edges


@pytest.mark.parametrize("limit", [20_000_000, 0])
def test_clocks_like_reachability(spark, limit):
    edges = random_edges(11)
    df = spark.createDataFrame([(a, b, c, d, "x", g) for a, b, c, d, g in edges], "src_rank int, src_seq bigint, dst_rank int, dst_seq bigint, kind string, grp bigint")
    known = happens_before.clocks(df, limit)
    nodes, want = reach(edges)
    pairs = [(*a, *b) for a in nodes for b in nodes if a[0] != b[0]]
    out = happens_before.happens_before(spark.createDataFrame(pairs, "a_rank int, a_seq bigint, b_rank int, b_seq bigint"), known)
    got = {((r.a_rank, r.a_seq), (r.b_rank, r.b_seq)) for r in out.collect() if r.before}
    assert got == {(a, b) for a, b in want if a[0] != b[0]}


def test_group_numbers_are_kept_whole(spark):
    rows = [(r, 1, None, None, "all-to-all", (1 << 60) + r // 2) for r in range(4)] + [(0, 2, 1, 2, "p2p", None)]
    df = spark.createDataFrame(rows, "src_rank int, src_seq bigint, dst_rank int, dst_seq bigint, kind string, grp bigint")
    knows = {(r["rank"], r.seq_id, r.r) for r in happens_before.clocks(df).collect()}
    assert knows == {(a, s, b) for a, s in ((0, 1), (1, 1), (2, 1), (3, 1), (0, 2), (1, 2)) for b in range(4) if a // 2 == b // 2}


def test_pairs_judged_where_they_are_found(spark):
    """The same verdicts as from listed conflicts that are joined with clocks, without a join of pairs."""
    w = ["MPI_COMM_WORLD"]
    rows = [(r, 4 * k, f, ["/a", "%p", "5", str(k)]) for r in range(3) for k, f in enumerate(("pwrite", "pread", "pwrite"))]
    rows += [(0, 1, "fsync", ["/a"]), (0, 2, "close", ["/a"]), (1, 6, "close", ["/a"]), (2, 7, "open", ["/a", "0"]), (1, 9, "fsync", ["/a"])]
    rows += [(r, s, "MPI_Barrier", w) for r in range(3) for s in (3, 10)]
    c = calls(spark, rows)
    ranges = offsets.intervals(c)
    lists, ranks, nodes = happens_before.clock_lists(happens_before.edges_of(spark.createDataFrame([], "src int, dst int, comm string, send_seq bigint, recv_seq bigint"), mpi.collectives(mpi.normalize(c))))
    rules = ["posix", "session", "commit"]
    for many in (ranges, ranges.union(ranges)):
        out = happens_before.judged_pairs(many, c, [(lists, ranks, rules)])
        got = {(r.rank1, r.seq1, r.rank2, r.seq2): (r.posix, r.session, r.commit) for r in out.collect()}
        assert out.count() == len(got) > 10
    pairs, known = conflicts.conflict_pairs(ranges), happens_before.clock_rows(lists, ranks)
    for k, rule in enumerate(rules):
        assert {(r.rank1, r.seq1, r.rank2, r.seq2): r.ok for r in happens_before.verify(pairs, c, known, rule).collect()} == {p: v[k] for p, v in got.items()}


def test_cycle_is_refused(spark):
    df = spark.createDataFrame([(0, 1, 1, 2, "x", None), (1, 1, 0, 0, "x", None), (0, 0, 1, 1, "x", None)], "src_rank int, src_seq bigint, dst_rank int, dst_seq bigint, kind string, grp bigint")
    with pytest.raises(Exception, match="cycle"):
        happens_before.clocks(df).collect()


def test_worked_example(spark):
    lanes = {"A": (0, 1), "B": (0, 2), "C": (0, 3), "D": (0, 4), "E": (0, 5), "F": (0, 6), "G": (0, 7), "H": (1, 1), "I": (1, 2), "J": (1, 3), "K": (2, 1), "L": (2, 2), "M": (2, 3)}
    links = ["BI", "DM", "FJ", "HC", "LE"]
    df = spark.createDataFrame([(*lanes[a], *lanes[b], "p2p", None) for a, b in links], "src_rank int, src_seq bigint, dst_rank int, dst_seq bigint, kind string, grp bigint")
    known = happens_before.clocks(df)
    ask = [("A", "I"), ("B", "J"), ("H", "G"), ("K", "G"), ("I", "C"), ("M", "G"), ("D", "M"), ("C", "L")]
    out = happens_before.happens_before(spark.createDataFrame([(*lanes[a], *lanes[b]) for a, b in ask], "a_rank int, a_seq bigint, b_rank int, b_seq bigint"), known)
    names = {v: k for k, v in lanes.items()}
    got = {names[r.a_rank, r.a_seq] + names[r.b_rank, r.b_seq]: r.before for r in out.collect()}
    assert got == {"AI": True, "BJ": True, "HG": True, "KG": True, "IC": False, "MG": False, "DM": True, "CL": False}
    flat = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("A", "D"), ("X", "Y")], "src string, dst string")
    assert happens_before.closure(flat).count() == 7
    assert happens_before.shortest_path(flat, "A", "D") == ["A", "D"] and happens_before.shortest_path(flat, "D", "A") == []


def test_vector_order(spark):
    df = spark.createDataFrame([([1, 0], [1, 2]), ([2, 0], [1, 2]), ([1, 2], [1, 2]), ([3, 3], [1, 2])], "x array<int>, y array<int>")
    assert [r[0] for r in df.select(happens_before.clock_order(F.col("x"), F.col("y"))).collect()] == ["before", "concurrent", "equal", "after"]


@pytest.mark.parametrize(("middle", "ok"), [("MPI_Barrier", True), ("MPI_Bcast", False)])
def test_sync_barrier_sync(spark, middle, ok):
    w = "MPI_COMM_WORLD"
    args = [w] if middle == "MPI_Barrier" else ["%p", "1", "INT", "1", w]
    rows = [(0, 0, "pwrite", ["/a", "%p", "5", "0"]), (0, 1, "MPI_File_sync", ["fh"]), (0, 2, middle, args), (0, 3, "MPI_File_sync", ["fh"])]
    rows += [(1, 0, "MPI_File_sync", ["fx"]), (1, 1, middle, args), (1, 2, "MPI_File_sync", ["fx"]), (1, 3, "pread", ["/a", "%p", "5", "0"])]
    c = calls(spark, rows)
    groups = mpi.collectives(mpi.normalize(c), only_synchronizing=True)
    none = spark.createDataFrame([], "src int, dst int, comm string, send_seq bigint, recv_seq bigint")
    known = happens_before.clocks(happens_before.edges_of(none, groups))
    pairs = conflicts.conflict_pairs(offsets.intervals(c))
    assert happens_before.verdict(happens_before.verify(pairs, c, known, "mpi-io")).first().properly_synchronized == ok


@pytest.mark.parametrize(("rule", "closing", "ok"), [("posix", None, True), ("session", "close", True), ("session", None, False), ("commit", "fsync", True), ("commit", None, False)])
def test_rules(spark, rule, closing, ok):
    w = "MPI_COMM_WORLD"
    rows = [(0, 0, "pwrite", ["/a", "%p", "5", "0"]), (0, 2, "MPI_Barrier", [w]), (1, 0, "MPI_Barrier", [w]), (1, 1, "open", ["/a", "0"]), (1, 2, "pread", ["/a", "%p", "5", "2"])]
    rows += [(0, 1, closing, ["/a"])] if closing else []
    c = calls(spark, rows)
    none = spark.createDataFrame([], "src int, dst int, comm string, send_seq bigint, recv_seq bigint")
    known = happens_before.clocks(happens_before.edges_of(none, mpi.collectives(mpi.normalize(c))))
    judged = happens_before.verify(conflicts.conflict_pairs(offsets.intervals(c)), c, known, rule)
    assert happens_before.verdict(judged).first().asDict() == {"n_pairs": 1, "n_violations": 0 if ok else 1, "properly_synchronized": ok}
    assert happens_before.verdict(judged.limit(0)).first().properly_synchronized


NAMES = ["open", "read", "write", "close", "PMPI_Barrier", "PMPI_File_open", "H5Dwrite"]


@pytest.mark.parametrize("merge", [False, True])
def test_binary_round_trip(spark, tmp_path, merge):
    rnd = random.Random(2)
    rows = []
    for r in range(3):
        t = 0
        for s in range(400):
            t += rnd.randrange(50)
            f = rnd.choice([0, 1, 1, 1, 2, 3, 6, 255])
            args = ["lib.so", "sym"] if f == 255 else [f"/a b{rnd.randrange(3)}", "%p"][: rnd.randrange(3)]
            rows.append((r, s, 9, t, t + rnd.randrange(30), "", args, 0, rnd.randrange(2), f, 0.0, 0.0, 0))
    df = spark.createDataFrame(rows, CALL)
    path = f"{tmp_path}/t"
    trace.write_trace(df, path, NAMES, merge_ranks=merge)
    back = trace.read_trace(spark, path)
    got = {(r["rank"], r.seq_id): (r.tid, r.func_id, r.level, r.tick_start, r.tick_end, tuple(r.args)) for r in back.collect()}
    assert got == {(r[0], r[1]): (r[2], r[9], r[8], r[3], r[4], tuple(a.replace(" ", "_") for a in r[6])) for r in rows}
    one = back.filter("rank = 1")
    assert one.count() == 400 and {r.func for r in one.filter("func_id = 255").collect()} == {"sym"}
    assert {(r.func_id, r.category) for r in trace.read_trace(spark, path, "functions").collect()} == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 2), (5, 1), (6, 3)}
    assert trace.read_trace(spark, path, "meta").first().total_ranks == 3
    cst = trace.read_trace(spark, path, "cst")
    assert cst.agg(F.sum("count")).first()[0] == 1200
    stat = trace.grammar_statistics(trace.read_trace(spark, path, "cfg"), trace.read_trace(spark, path, "ug")).first()
    assert stat.n_ranks == 3 and stat.ints_after <= stat.ints_before


def test_version_is_checked(spark, tmp_path):
    folder = layout.Folder(str(tmp_path))
    layout.write_metadata(folder, layout.Metadata(1, 0.0, 1e-7, 0, 0, 0, NAMES))
    folder.write("VERSION", b"2.3.0")
    with pytest.raises(Exception, match="format"):
        trace.read_trace(spark, str(tmp_path)).collect()


def test_grammars():

    nested = {-1: np.array([[-2, 3], [2, 1]]), -2: np.array([[0, 2], [1, 1]])}
    assert np.concatenate(list(layout.expand(nested))).tolist() == [0, 0, 1] * 3 + [2] and layout.expanded_length(nested) == 10
    assert np.concatenate(list(layout.expand(nested, 2))).tolist() == [0, 0, 1] * 3 + [2]
    rnd = random.Random(1)
    for n in (0, 1, 7, 500):
        ids = np.array([rnd.choice([1, 1, 2, 3]) for _ in range(n)] + [4, 5] * (n // 5), np.int32)
        rules = {k: np.array(v).reshape(-1, 2) for k, v in layout.compress(ids).items()}
        assert (np.concatenate([np.zeros(0, int), *layout.expand(rules, 16)]) == ids).all() and layout.expanded_length(rules) == len(ids)


def test_expanded_lengths(spark):
    rules = [(0, -1, 0, -2, 3), (0, -1, 1, 2, 1), (0, -2, 0, 0, 2), (0, -2, 1, 1, 1), (1, -1, 0, -3, 2), (1, -1, 1, -2, 5), (1, -2, 0, -3, 4), (1, -2, 1, 9, 1), (1, -3, 0, 7, 10)]
    out = trace.expanded_lengths(spark.createDataFrame(rules, "ug_id int, rule_id int, pos int, val int, exp int"))
    assert {tuple(r) for r in out.collect()} == {(0, 10), (1, 20 + 5 * 41)}


def test_exports(spark, tmp_path):
    df = calls(spark, [(0, 0, "read", ["/a", "%p", '5"'], 0, 10), (0, 1, "MPI_Bcast", [], 1, 20), (1, 0, "write", ["/a", "%p", "5"], 0, 30)])
    assert export.text_lines(df).filter("rank = 1").first().line == "0.0000030 0.0000035 write 0 0 ( /a %p 5 )"
    export.write_parquet(df, f"{tmp_path}/p")
    back = {(r["rank"], r.seq_id): list(r.args) for r in export.read_exported(spark, f"{tmp_path}/p").collect()}
    assert back == {(0, 0): ["/a", "%p", '5"'], (0, 1): [], (1, 0): ["/a", "%p", "5"]}
    export.write_timeline(df, f"{tmp_path}/t")
    import json
    from pathlib import Path

    text = "".join(p.read_text() for p in Path(f"{tmp_path}/t/rank=0").glob("*.txt"))
    events = json.loads(text)["traceEvents"]
    assert [e.get("name") for e in events] == ["read", None] and events[0]["args"]["args"][2] == '5"' and events[0]["pid"] == 0
    export.write_text(df, f"{tmp_path}/x")
    assert spark.read.text(f"{tmp_path}/x").count() == 3


def test_live_offsets(spark, tmp_path):
    rows = [(0, 0, "open", ["/a", "2"]), (0, 1, "write", ["/a", "%p", "10"]), (1, 2, "open", ["/a", str(0x400)]), (1, 3, "write", ["/a", "%p", "5"]), (0, 4, "write", ["/a", "%p", "1"])]
    events = offsets.cursor_events(offsets.attribute_handles(calls(spark, rows)))
    for low, high in ((0, 1), (2, 4)):
        events.filter(F.col("seq_id").between(low, high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = live.live_offsets(live.stream_folder(spark, f"{tmp_path}/in"))
    live.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r["rank"], r.seq_id, r.offset, r["count"]) for r in spark.read.parquet(f"{tmp_path}/out/batch=*").collect()}
    assert got == {(0, 1, 0, 10), (1, 3, 10, 5), (0, 4, 10, 1)}


def test_late_rows(spark):
    df = spark.sql("select * from values (timestamp'2031-01-01 00:00:00'), (timestamp'2031-01-01 10:00:00'), (null) as t(at)")
    on_time, late = live.quarantine(df, "at", "2031-01-01 10:00:00", 3600)
    assert (on_time.count(), late.count()) == (2, 1)


def test_rates_of_the_whole_table(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m, tzinfo=datetime.timezone.utc)
    rows = [("click", 2.5, at(1)), ("click", 3.0, at(1, 30)), ("view", 4.0, at(9)), ("click", 1.0, at(9, 59)), ("view", 7.0, at(2))]
    spark.createDataFrame(rows, "event_type string, value double, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.from_us // 3_600_000_000 % 24, r.event_type, r.n_calls, r.bytes) for r in events.st2_rates(spark, str(tmp_path)).collect()}
    assert got == {(1, "click", 2, 5), (2, "view", 1, 7), (9, "view", 1, 4), (9, "click", 1, 1)}


def test_grammars_hold_no_pair_twice_and_no_idle_rule():
    rnd = random.Random(21)
    for _ in range(400):
        ids = [rnd.randrange(rnd.choice([2, 3, 9])) for _ in range(rnd.randrange(60))]
        ids = ids[: rnd.randrange(1, 9)] * rnd.randrange(1, 9) + ids
        rules = layout.compress(np.array(ids, np.int64))
        assert [int(x) for part in layout.expand({k: np.array(v, np.int64).reshape(-1, 2) for k, v in rules.items()}) for x in part] == ids
        pairs = [(x, y) for body in rules.values() for x, y in zip(body, body[1:])]
        assert len(pairs) == len(set(pairs)) and all(x[0] != y[0] for x, y in pairs)
        used = {}
        for v, n in (x for body in rules.values() for x in body):
            used[v] = used.get(v, 0) + n
        assert all(used[r] > 1 for r in rules if r != layout.ROOT_RULE)
    assert layout.compress(np.array([0, 0, 1, 0, 0, 1, 2])) == {-1: [(-2, 2), (2, 1)], -2: [(0, 2), (1, 1)]}
    many = layout.compress(np.array([rnd.randrange(100) for _ in range(30_000)]))
    assert len(many) > 257  # no bound on rules


def test_names_of_hdf5_and_kernels(spark):
    rows = [(0, 4, "LE", True), (0, 1, "BE", False), (0, 8, "native", True), (1, 4, "VAX", True), (1, 8, "BE", True), (1, 16, "native", True), (6, None, None, None), (1, 3, "LE", True), (99, 1, "LE", True), (None, 1, "LE", True)]
    df = spark.createDataFrame(rows, "c int, s int, o string, g boolean")
    got = [r[0] for r in df.select(facts.h5_type_name(F.col("c"), F.col("s"), F.col("o"), F.col("g"))).collect()]
    assert got == ["H5T_STD_I32LE", "H5T_STD_U8BE", "H5T_NATIVE_LONG", "H5T_VAX_F32", "H5T_IEEE_F64BE", "H5T_NATIVE_LDOUBLE", "H5T_COMPOUND", "1", "99", None]
    c = calls(spark, [(0, 0, "H5Tcreate", ["1", "8"]), (0, 1, "H5Pcreate", ["5"]), (0, 2, "H5Sselect_elements", ["0", "77"]), (0, 3, "H5Dopen1", ["1", "a"]), (0, 4, "H5Pcreate", [])])
    assert {(r.seq_id, r.name) for r in facts.h5_names(c).collect()} == {(0, "H5T_FLOAT"), (1, "H5P_DATASET_ACCESS"), (2, "77"), (4, None)}
    k = spark.createDataFrame([(0, 1, 5, "axpy", 1_000, 2_050), (0, 2, 5, None, 3_000, None)], "rank int, seq_id bigint, tid bigint, name string, start_ns bigint, end_ns bigint")
    out = {r.seq_id: r for r in facts.kernel_calls(k).collect()}
    assert (out[1].func_id, out[1].tick_start, out[1].tick_end, out[1].args) == (255, 10, 20, ["reserved", "axpy"]) and (out[2].tick_end, out[2].args) == (None, ["reserved", None])


def test_rows_of_a_channel_meet_whatever_the_plan(spark):
    """Receives of any tag, with completions known: the plan's joins must not keep rows of a channel apart."""
    rows = [(r, s, "MPI_Send", ["%p", "1", "BYTE", str((r + 1) % 4), str(s % 3), "w"]) for r in range(4) for s in range(0, 40, 2)]
    rows += [(r, s, "MPI_Recv", ["%p", "1", "BYTE", str((r - 1) % 4), "-1", "w", "%p"]) for r in range(4) for s in range(1, 40, 2)]
    m = mpi.normalize(calls(spark, rows))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.src, r.dst, r.send_seq, r.recv_seq) for r in mpi.point_to_point(m, mpi.completions(m)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(r, (r + 1) % 4, s, s + 1) for r in range(4) for s in range(0, 40, 2)}


def test_caller_report_and_filters(spark):
    assert len(callers.CALLER_REPORT) == 20 and callers.CALLER_REPORT[10:13] == ("opendir", "readdir", "closedir") and "rmdir" not in callers.CALLER_REPORT
    rows = [(0, 0, "rename", ["/dev/a", "/b"]), (0, 1, "symlinkat", ["/ok", "/dev/a", "/ok"]), (0, 2, "symlinkat", ["/dev/a", "/ok", "/x"]), (0, 3, "tmpfile", []), (0, 4, "umask", ["7"]), (0, 5, "fread", ["%p", "1", "1", "/dev/a"]), (0, 6, "open", [])]
    got = {r.seq_id for r in facts.filter_paths(calls(spark, rows), ("/dev/",)).collect()}
    assert got == {0, 2, 3, 4}
    assert {r.seq_id for r in facts.filter_paths(calls(spark, rows), (), ("/ok",)).collect()} == {0, 2, 3, 4}


def test_clocks_by_rounds_raise_rather_than_stop(spark):
    e = spark.createDataFrame([(0, 0, 1, 1, "p2p", None), (1, 2, 2, 3, "p2p", None), (2, 4, 0, 5, "p2p", None)], "src_rank int, src_seq bigint, dst_rank int, dst_seq bigint, kind string, grp bigint")
    with pytest.raises(RuntimeError):
        happens_before.clocks_by_rounds(happens_before.ordered_calls(e), e, max_rounds=1)


def test_ranks_are_read_in_parts(spark, tmp_path):
    rnd = random.Random(31)
    rows = [(r, s, rnd.choice(["open", "read", "close"]), [f"/f{rnd.randrange(3)}"], 0, s * 10 + rnd.randrange(9)) for r in range(3) for s in range((40, 0, 23)[r])]
    df = calls(spark, rows).withColumn("func_id", F.when(F.col("func") == "open", 0).when(F.col("func") == "read", 1).otherwise(2).cast("smallint"))
    for merge in (False, True):
        path = f"{tmp_path}/{merge}"
        trace.write_trace(df.withColumn("rank", F.when(F.col("rank") == 2, 1).otherwise(F.col("rank"))), path, ["open", "read", "close"], merge_ranks=merge)
        whole = trace.read_trace(spark, path)
        parts = spark.read.format("calltide").option("path", path).option("callsPerTask", 7).load()
        key = lambda d: sorted((r["rank"], r.seq_id, r.func, tuple(r.args), r.tick_start, r.tick_end) for r in d.collect())
        assert key(whole) == key(parts) and len(key(whole)) == 63 and parts.rdd.getNumPartitions() > 6
    rules = {k: np.array(v, np.int64).reshape(-1, 2) for k, v in layout.compress(np.array([1, 2, 2, 3] * 50 + [4] * 9)).items()}
    every = np.concatenate(list(layout.expand(rules))).tolist()
    for chunk in (1, 5, 1000):
        for a, z in ((0, 5), (3, 4), (190, 209), (7, 7), (100, None), (209, 209)):
            assert [int(x) for part in layout.expand(rules, chunk, a, z) for x in part] == every[a:z]


def test_short_ranks_share_a_task(spark, tmp_path):
    rows = [(r, s, "open", [f"/f{r}"] * (s % (r + 1)), 0, s * 10) for r in range(30) for s in range(1 + r % 4)]
    df = calls(spark, rows).withColumn("func_id", F.lit(0).cast("smallint"))
    for merge in (False, True):
        path = f"{tmp_path}/{merge}"
        trace.write_trace(df, path, ["open"], merge_ranks=merge)
        read = {t: trace.read_trace(spark, path, t) for t in ("records", "cfg", "cst", "ug")}
        assert sorted((r["rank"], r.seq_id) for r in read["records"].collect()) == [(r, s) for r, s, *_ in rows]
        assert [d.rdd.getNumPartitions() for d in read.values()] == [1, 1, 1, 1]
        lengths = read["ug"].join(trace.expanded_lengths(read["cfg"]), "ug_id")
        assert {r["rank"]: r.n_calls for r in lengths.collect()} == {r: 1 + r % 4 for r in range(30)}
        assert {r["rank"] for r in read["records"].filter("rank = 7").collect()} == {7}
    assert [[len(p.value) for p in trace._grouped([(0, 0, 5), (1, 0, 5), (2, 0, 3), (2, 3, 9)], 10)]] == [[2, 2]]


def test_argument_places_are_those_of_the_listed_layouts(spark):
    """The places of matched calls' arguments against the layouts in the given list of functions."""
    layouts = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/function_list.parquet").collect():
        layouts[r.name] = max(layouts.get(r.name, []), list(r.args), key=len)
    names = {
        "src": {"source", "root"}, "dst": {"dest"}, "stag": {"tag", "sendtag"}, "rtag": {"tag", "recvtag"}, "comm": {"comm", "newcomm", "comm_cart"}, "req": {"r", "request", "fh"},
        "reqs": {"requests_str"}, "flag": {"flag", "outcount"}, "tindx": {"indx"}, "tindxs": {"indices_str"}, "status": {"status", "status_p"},
    }
    checked = 0
    for name, places in mpi.ARGUMENTS.items():
        for field, place in places.items():
            if layouts.get(name):
                assert layouts[name][place].split(":")[0] in names[field], (name, field)
                checked += 1
    assert checked > 80
    for name in ("fread", "mmap", "__xstat", "symlinkat", "open", "access"):
        assert layouts[name][facts.FILE_ARGUMENTS.get(name, 0)] == "file:path"
    assert all("file:path" not in layouts[n] for n in facts.NEVER_FILTERED if n in layouts)
    for name, place in facts.OFFSET_ARGUMENTS.items():
        assert not layouts.get(name) or "offset" in layouts[name][place], name
