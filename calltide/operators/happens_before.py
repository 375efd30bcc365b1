"""Happens-before order of calls, and whether conflicting accesses are properly synchronized.

Only calls with an edge to another rank matter for order between ranks; they are numbered per rank from 1. A call's clock
says, for each rank, up to which of its numbered calls everything has happened before. A collective that all take part in
hands the joined clocks to what follows each participant, not to the participants: so there is a clock on entering and one on leaving.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.operators.conflicts import conflict_pairs
from calltide.operators.sequence import scan
from calltide.runtime import cut, release

#: Up to so many entries clocks are computed in one task; beyond, by rounds over all executors. An ordered call has one for each
#: rank (4 bytes) and NODE_ENTRIES besides.
ONE_TASK_ENTRIES = 100_000_000
NODE_ENTRIES = 8
#: Clock entries of a batch that leaves the task.
CHUNK_ENTRIES = 1 << 19
#: Up to so many ranks accesses carry their clocks through the join that finds their conflicts.
CARRIED_RANKS = 64
SEQ_BLOCK = 4096
#: The calls that close and open access under each rule.
RULES = {
    "session": (("close", "fclose"), ("open", "open64", "fopen", "fopen64")),
    "mpi-io": (("MPI_File_close", "MPI_File_sync"), ("MPI_File_open", "MPI_File_sync")),
    "commit": (("fsync", "fdatasync", "close", "fclose"), ()),
}
#: What has to happen before what, by rule, under names of their own: whether it is the call that closes after one access, and the
#: one that opens before the other, instead of the accesses themselves. A commit counts on either rank.
SLOTS = {"posix": {"posix": (False, False)}, "session": {"session": (True, True)}, "mpi-io": {"mpiio": (True, True)}, "commit": {"own": (True, False), "other": (False, True)}}


def edges_of(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """src_rank, src_seq, dst_rank, dst_seq, kind, grp: messages, roots to members or members to roots, and all-to-all
    groups as edges to a group number (dst null). The root of a one-to-many or many-to-one group is its ``root`` rank."""
    p2p = pairs.select(F.col("src").alias("src_rank"), F.col("send_seq").alias("src_seq"), F.col("dst").alias("dst_rank"), F.col("recv_seq").alias("dst_seq"), F.lit("p2p").alias("kind"), F.lit(None).cast("bigint").alias("grp"))
    g = groups.withColumn("grp", F.xxhash64("func", "comm", "handle", "k"))
    root = F.get(F.filter("members", lambda m: m["rank"] == F.col("root")), F.lit(0))
    rooted = g.filter(F.col("role").isin("one-to-many", "many-to-one")).withColumn("_root", root).filter("_root is not null")
    rooted = rooted.select("role", "_root", F.explode("members").alias("m")).filter(F.col("m.rank") != F.col("_root.rank"))
    down = F.col("role") == "one-to-many"
    ends = lambda f: (F.when(down, F.col(f"_root.{f}")).otherwise(F.col(f"m.{f}")), F.when(down, F.col(f"m.{f}")).otherwise(F.col(f"_root.{f}")))
    (sr, dr), (ss, ds) = ends("rank"), ends("seq_id")
    rooted = rooted.select(sr.alias("src_rank"), ss.alias("src_seq"), dr.alias("dst_rank"), ds.alias("dst_seq"), F.col("role").alias("kind"), F.lit(None).cast("bigint").alias("grp"))
    every = g.filter(F.col("role") == "all-to-all").select("grp", F.explode("members").alias("m"))
    every = every.select(F.col("m.rank").alias("src_rank"), F.col("m.seq_id").alias("src_seq"), F.lit(None).cast("int").alias("dst_rank"), F.lit(None).cast("bigint").alias("dst_seq"), F.lit("all-to-all").alias("kind"), "grp")
    return p2p.unionByName(rooted).unionByName(every)


def ordered_calls(edges: DataFrame) -> DataFrame:
    """rank, seq_id, idx (from 1 in each rank) and grp of every call with an edge."""
    ends = edges.select(F.col("src_rank").alias("rank"), F.col("src_seq").alias("seq_id"), "grp").union(edges.filter("dst_rank is not null").select("dst_rank", "dst_seq", F.lit(None).cast("bigint")))
    nodes = ends.groupBy("rank", "seq_id").agg(F.max("grp").alias("grp"))
    return scan(nodes, ["rank"], ["seq_id"], {"idx": ("sum", F.lit(1), True)}, SEQ_BLOCK)


def _numbers(batches: Iterator[pa.RecordBatch], ranks: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """seq_id and group (-1: none) of each node, source and target of each edge; nodes are numbered rank after rank."""
    n = int(starts[-1])
    seq, grp, in_group = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    src, dst = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    number = lambda rank, idx: (starts[np.searchsorted(ranks, rank)] + idx - 1).astype(np.int32)
    for b in batches:
        edge = np.asarray(b["dst_rank"].is_valid())
        at = number(b["rank"].to_numpy(zero_copy_only=False), b["idx"].to_numpy(zero_copy_only=False))
        to = number(b["dst_rank"].fill_null(int(ranks[0])).to_numpy(zero_copy_only=False), b["dst_idx"].fill_null(1).to_numpy(zero_copy_only=False))
        src.append(at[edge])
        dst.append(to[edge])
        at = at[~edge]
        seq[at] = b["seq_id"].fill_null(0).to_numpy(zero_copy_only=False)[~edge]
        grp[at] = b["grp"].fill_null(0).to_numpy(zero_copy_only=False)[~edge]
        in_group[at] = np.asarray(b["grp"].is_valid())[~edge]
    group = np.full(n, -1, np.int32)
    group[in_group] = np.unique(grp[in_group], return_inverse=True)[1]
    return seq, group, np.concatenate(src), np.concatenate(dst)


def kahn(group: np.ndarray, src: np.ndarray, dst: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clocks in one pass over a topological order; raises on a cycle.

    A rank's clock changes only at calls that hear of others: behind edges and groups. Only these stops have a row.
    Returns the stops' clocks on entering, each node's last stop, and the groups' clocks.
    """
    n, n_ranks = int(starts[-1]), len(starts) - 1
    by_dst = np.argsort(dst, kind="stable")
    src, dst = src[by_dst], dst[by_dst]
    is_stop = np.zeros(n, bool)
    is_stop[starts[:-1]] = True
    is_stop[dst] = True
    is_stop[group >= 0] = True
    is_stop[1:] |= group[:-1] >= 0
    stop_of = (np.cumsum(is_stop) - 1).astype(np.int32)
    stops = np.nonzero(is_stop)[0]
    bounds = np.searchsorted(dst, np.append(stops, n))
    first = np.searchsorted(stops, starts)
    members = np.bincount(group[group >= 0]) if (group >= 0).any() else np.zeros(0, np.int64)
    clock, joined = np.zeros((len(stops), n_ranks), np.int32), np.zeros((len(members), n_ranks), np.int32)
    cell, owner = memoryview(clock), memoryview(np.repeat(np.arange(n_ranks, dtype=np.int32), np.diff(starts)))
    node, edge, source, last, groups, missing = map(memoryview, (stops, bounds, src, stop_of, group, members))
    start = starts.tolist()
    at, ends, limit = first[:-1].tolist(), first[1:].tolist(), start[:-1]
    waits: dict[int, list[int]] = {}  # rank, or group as ~number -> ranks that wait for it
    ready, left = list(range(n_ranks)), len(stops)
    while ready:
        r = ready.pop()
        j, moved = at[r], False
        while j < ends[r]:
            k = node[j]
            g = groups[k - 1] if k > start[r] else -1
            if g >= 0 and missing[g]:
                waits.setdefault(~g, []).append(r)
                break
            a, b = edge[j], edge[j + 1]
            blocked = next((q for q in (owner[source[e]] for e in range(a, b) if source[e] >= limit[owner[source[e]]])), None)
            if blocked is not None:
                if blocked == r:
                    raise ValueError("the order of calls has a cycle")
                waits.setdefault(blocked, []).append(r)
                break
            row = clock[j]
            if k > start[r]:
                row[:] = clock[j - 1]
                if g >= 0:
                    np.maximum(row, joined[g], out=row)
            for e in range(a, b):
                x = source[e]
                q = owner[x]
                np.maximum(row, clock[last[x]], out=row)
                cell[j, q] = max(cell[j, q], x - start[q] + 1)
            cell[j, r] = k - start[r] + 1
            own = groups[k]
            if own >= 0:
                np.maximum(joined[own], row, out=joined[own])
                missing[own] -= 1
                if not missing[own]:
                    ready += waits.pop(~own, [])
            j, moved, left = j + 1, True, left - 1
            limit[r] = node[j] if j < ends[r] else start[r + 1]
        at[r] = j
        if moved:
            ready += waits.pop(r, [])
    if left:
        raise ValueError("the order of calls has a cycle")
    return clock, stop_of, joined


def clocks_in_one_task(nodes: DataFrame, edges: DataFrame, counts: dict[int, int]) -> DataFrame:
    """rank, seq_id, idx, enter, leave by ``kahn`` over the whole trace; clocks are lists in the order of ranks. Only for graphs whose size was checked."""
    n = nodes.select("rank", "seq_id", "idx")
    ends = lambda to: n.select(F.col("rank").alias(f"{to}_rank"), F.col("seq_id").alias(f"{to}_seq"), F.col("idx").alias(f"{to}_idx"))
    both = nodes.select("rank", "idx", "seq_id", "grp", F.lit(None).cast("int").alias("dst_rank"), F.lit(None).cast("bigint").alias("dst_idx"))
    linked = edges.filter("dst_rank is not null").join(ends("src"), ["src_rank", "src_seq"]).join(ends("dst"), ["dst_rank", "dst_seq"])
    more = linked.select(F.col("src_rank").alias("rank"), F.col("src_idx").alias("idx"), F.lit(None).cast("bigint").alias("seq_id"), F.lit(None).cast("bigint").alias("grp"), "dst_rank", "dst_idx")
    ranks = np.array(sorted(counts), np.int64)
    starts = np.concatenate([[0], np.cumsum([counts[r] for r in ranks.tolist()], dtype=np.int64)]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(ranks):
            return
        seq, group, src, dst = _numbers(batches, ranks, starts)
        clock, stop_of, joined = kahn(group, src, dst, starts)
        step = max(1, CHUNK_ENTRIES // len(ranks))
        for a in range(0, len(seq), step):
            z = min(a + step, len(seq))
            place = np.searchsorted(starts, np.arange(a, z), side="right") - 1
            idx = np.arange(a, z) - starts[place] + 1
            enter = clock[stop_of[a:z]]
            enter[np.arange(z - a), place] = idx
            leave, grouped = enter.copy(), np.nonzero(group[a:z] >= 0)[0]
            leave[grouped] = np.maximum(leave[grouped], joined[group[a:z][grouped]])
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (z - a + 1) * len(ranks), len(ranks), dtype=np.int32)), pa.array(c.ravel())) for c in (enter, leave)]
            yield pa.RecordBatch.from_arrays([pa.array(ranks[place].astype(np.int32)), pa.array(seq[a:z]), pa.array(idx), *lists], ["rank", "seq_id", "idx", "enter", "leave"])

    return both.unionByName(more).repartition(1).mapInArrow(run, "rank int, seq_id bigint, idx bigint, enter array<int>, leave array<int>")


def clocks_by_rounds(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """The same clocks as rows (rank, seq_id, idx, r, enter, leave), by rounds until nothing grows.

    A round carries clocks along all program orders at once (a running maximum) and over every edge; so the number of
    rounds is that of changes of rank on the longest path. A cycle makes a call know a later one of its own rank.
    """
    n = nodes.select("rank", "seq_id", "idx", "grp")
    links = edges.filter("dst_rank is not null").select("src_rank", "src_seq", "dst_rank", "dst_seq")
    state = cut(n.select("rank", "seq_id", F.col("rank").alias("r"), F.col("idx").alias("enter"), F.col("idx").alias("leave")), "clocks")
    for _ in range(max_rounds):
        known = state.join(n, ["rank", "seq_id"])
        # what leaves a group is what any member entered with
        joined = known.filter("grp is not null").groupBy("grp", "r").agg(F.max("enter").alias("leave"))
        members = n.filter("grp is not null").join(joined, "grp").select("rank", "seq_id", "r", F.lit(0).cast("bigint").alias("enter"), "leave")
        sent = links.join(state, (F.col("src_rank") == F.col("rank")) & (F.col("src_seq") == F.col("seq_id"))).select(F.col("dst_rank").alias("rank"), F.col("dst_seq").alias("seq_id"), "r", "enter", F.col("enter").alias("leave"))
        new = state.unionByName(members).unionByName(sent).groupBy("rank", "seq_id", "r").agg(F.max("enter").alias("enter"), F.max("leave").alias("leave"))
        ran = scan(new.join(n.select("rank", "seq_id", "idx"), ["rank", "seq_id"]), ["rank", "r"], ["idx"], {"_before": ("max", F.col("leave"), False)}, SEQ_BLOCK)
        grown = cut(ran.select("rank", "seq_id", "r", F.greatest("enter", "_before").alias("enter"), F.greatest("leave", "_before").alias("leave")), "clocks")
        # calls in between, which have no entry for r yet, get it by the join of orders at the next lookup
        spread = grown.groupBy("rank", "r").agg(F.min("seq_id").alias("_from"))
        holes = n.join(spread, "rank").filter(F.col("seq_id") > F.col("_from")).select("rank", "seq_id", "r").join(grown, ["rank", "seq_id", "r"], "left_anti")
        filled = cut(grown.unionByName(holes.select("rank", "seq_id", "r", F.lit(0).cast("bigint").alias("enter"), F.lit(0).cast("bigint").alias("leave"))), "clocks")
        changed = filled.join(state.select("rank", "seq_id", "r", F.col("enter").alias("_e"), F.col("leave").alias("_l")), ["rank", "seq_id", "r"], "left")
        same = not changed.filter("_e is null or _e < enter or _l < leave").take(1)
        release(state, grown)
        state = filled
        if state.join(n, ["rank", "seq_id"]).filter("r = rank and enter > idx").take(1):
            raise ValueError("the order of calls has a cycle")
        if same:
            break
    else:
        raise RuntimeError(f"clocks still grow after {max_rounds} rounds")
    return state.join(n.select("rank", "seq_id", "idx"), ["rank", "seq_id"]).select("rank", "seq_id", "idx", "r", "enter", "leave")


def clock_lists(edges: DataFrame, one_task_entries: int = ONE_TASK_ENTRIES) -> tuple[DataFrame | None, list[int], DataFrame]:
    """Clocks as lists and the ranks in their order; the lists are None where there are too many for one task. And the ordered calls."""
    nodes = cut(ordered_calls(edges), "ordered-calls")
    per_rank = nodes.groupBy("rank").agg(F.count("*").alias("n"))
    n_ranks, n_nodes = per_rank.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if (n_ranks + NODE_ENTRIES) * n_nodes > one_task_entries:
        return None, [], nodes
    counts = {r["rank"]: r["n"] for r in per_rank.collect()}
    return clocks_in_one_task(nodes, edges, counts), sorted(counts), nodes


def clocks(edges: DataFrame, one_task_entries: int = ONE_TASK_ENTRIES) -> DataFrame:
    """rank, seq_id, idx, r, enter, leave: for every call with an edge and every rank r that it knows of, how far."""
    lists, ranks, nodes = clock_lists(edges, one_task_entries)
    return clocks_by_rounds(nodes, edges) if lists is None else clock_rows(lists, ranks)


def clock_rows(lists: DataFrame, ranks: list[int]) -> DataFrame:
    """Lists of clocks as rows; entries of nothing are left out."""
    rows = lists.select("rank", "seq_id", "idx", F.posexplode(F.arrays_zip("enter", "leave")).alias("p", "c"))
    number = F.get(F.array(*map(F.lit, ranks)), F.col("p")) if ranks else F.lit(None).cast("int")
    return rows.select("rank", "seq_id", "idx", number.alias("r"), F.col("c.enter").cast("bigint").alias("enter"), F.col("c.leave").cast("bigint").alias("leave")).filter("leave > 0")


def happens_before(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """pairs (with a_rank, a_seq, b_rank, b_seq) plus ``before``: whether a happens before b.

    Within a rank the order of calls decides. Between ranks a counts as its next ordered call, b as itself on entering or
    as the previous ordered call on leaving. Nulls on either side are never before.
    """
    nodes = known.select(F.col("rank"), F.col("seq_id"), F.col("idx")).distinct()
    asked = pairs.select(F.col("a_rank").alias("rank"), F.col("a_seq").alias("seq_id")).union(pairs.select("b_rank", "b_seq")).distinct().filter("rank is not null and seq_id is not null")
    marks = cut(asked.join(nodes, ["rank", "seq_id"], "left").unionByName(nodes.join(asked, ["rank", "seq_id"], "left_anti")), "asked")
    here = F.when(F.col("idx").isNotNull(), F.struct("seq_id", "idx"))
    up = scan(marks, ["rank"], ["seq_id"], {"nxt": ("last", here, True)}, SEQ_BLOCK, descending=True)
    down = scan(up, ["rank"], ["seq_id"], {"prv": ("last", here, True)}, SEQ_BLOCK)
    places = cut(down.select("rank", "seq_id", F.col("nxt.idx").alias("sends"), F.col("prv.seq_id").alias("hears")), "places")
    a = places.select(F.col("rank").alias("a_rank"), F.col("seq_id").alias("a_seq"), "sends")
    b = places.select(F.col("rank").alias("b_rank"), F.col("seq_id").alias("b_seq"), "hears")
    out = pairs.join(a, ["a_rank", "a_seq"], "left").join(b, ["b_rank", "b_seq"], "left")
    c = known.select(F.col("rank").alias("b_rank"), F.col("seq_id").alias("hears"), F.col("r").alias("a_rank"), "enter", "leave")
    out = out.join(c, ["b_rank", "hears", "a_rank"], "left")
    clock = F.when(F.col("hears") == F.col("b_seq"), F.col("enter")).otherwise(F.col("leave"))
    before = F.when(F.col("a_rank") == F.col("b_rank"), F.col("a_seq") < F.col("b_seq")).otherwise(clock >= F.col("sends"))
    return out.withColumn("before", F.coalesce(before, F.lit(False))).select(*pairs.columns, "before")


def nearest_calls(accesses: DataFrame, calls: DataFrame, names: tuple[str, ...], following: bool, to: str) -> DataFrame:
    """accesses (rank, seq_id) with ``to``: the seq_id of the next (or previous) call of the rank with one of the names."""
    marked = calls.filter(F.col("func").isin(*names)).select("rank", "seq_id", F.lit(True).alias("_hit"))
    asked = accesses.select("rank", "seq_id").distinct().withColumn("_hit", F.lit(False))
    both = cut(asked.unionByName(marked).groupBy("rank", "seq_id").agg(F.bool_or("_hit").alias("_hit")), "marks")
    found = scan(both, ["rank"], ["seq_id"], {to: ("last", F.when(F.col("_hit"), F.col("seq_id")), False)}, SEQ_BLOCK, descending=following)
    return accesses.join(found.select("rank", "seq_id", to), ["rank", "seq_id"], "left")


def verify(conflicts: DataFrame, calls: DataFrame, known: DataFrame, rule: str = "posix") -> DataFrame:
    """conflicts (rank1, seq1, rank2, seq2) with ``ok``: whether the pair is properly synchronized.

    posix: one access happens before the other. session and mpi-io: what closes after one happens before what opens before the
    other (for mpi-io: syncs, opens and closes of MPI files). commit: one of the two ranks commits after the first access and before the second.
    A pair counts in either direction.
    """
    rule = rule.lower()
    pair = cut(conflicts.select("rank1", "seq1", "rank2", "seq2").distinct(), "pairs")
    cols = ["rank1", "seq1", "rank2", "seq2"]
    if rule == "posix":
        full, asked = pair, [("seq1", "seq2")]
    else:
        closing, opening = RULES[rule]
        ops = pair.select(F.col("rank1").alias("rank"), F.col("seq1").alias("seq_id")).union(pair.select("rank2", "seq2")).distinct()
        ops = nearest_calls(cut(ops, "accesses"), calls, closing, True, "c")
        ops = cut(nearest_calls(cut(ops, "closing"), calls, opening or closing, False, "o"), "syncs")
        full = pair
        for i in (1, 2):
            full = full.join(ops.select(F.col("rank").alias(f"rank{i}"), F.col("seq_id").alias(f"seq{i}"), F.col("c").alias(f"c{i}"), F.col("o").alias(f"o{i}")), [f"rank{i}", f"seq{i}"], "left")
        full = cut(full, "pair-syncs")
        # a commit counts on either rank: the first access's own, or the other rank's last one before its access
        asked = [("c1", "o2")] if opening else [("c1", "seq2"), ("seq1", "o2")]
    both = [
        full.select(*cols, F.col(f"rank{i}").alias("a_rank"), F.col(a.replace("1", i)).alias("a_seq"), F.col(f"rank{j}").alias("b_rank"), F.col(b.replace("2", j)).alias("b_seq"))
        for a, b in asked
        for i, j in (("1", "2"), ("2", "1"))
    ]
    one = both[0]
    for more in both[1:]:
        one = one.unionByName(more)
    judged = happens_before(cut(one, "asked-pairs"), known)
    return judged.groupBy(*cols).agg(F.bool_or("before").alias("ok"))


def access_places(accesses: DataFrame, calls: DataFrame, nodes: DataFrame, rules: Sequence[str]) -> DataFrame:
    """accesses (rank, seq_id, each once) with, for every slot of ``SLOTS`` of the rules, what has to be known of the access
    (``s_<slot>``: the number of an ordered call) and what knows (``h_<slot>``: twice the number of one, plus 1 on leaving it)."""
    named = [r for r in rules if r != "posix"]
    sides = {(r, k): names or RULES[r][0] for r in named for k, names in zip("co", RULES[r])}
    flag = lambda r, k: f"_{k}_{r}"
    none = {f: F.lit(None).cast("boolean") for f in ("_access", *(flag(*x) for x in sides))}
    rows = nodes.select("rank", "seq_id", F.col("idx").cast("bigint").alias("idx"), *[c.alias(f) for f, c in none.items()])
    no = F.lit(None).cast("bigint").alias("idx")
    rows = rows.union(accesses.select("rank", "seq_id", no, *[(F.lit(True) if f == "_access" else c).alias(f) for f, c in none.items()]))
    if named:
        called = calls.filter(F.col("func").isin(*{f for names in sides.values() for f in names}))
        marked = {flag(*x): F.when(F.col("func").isin(*names), F.lit(True)) for x, names in sides.items()}
        rows = rows.union(called.select("rank", "seq_id", no, *[marked.get(f, c).alias(f) for f, c in none.items()]))
    rows = rows.groupBy("rank", "seq_id").agg(F.max("idx").alias("idx"), *[F.bool_or(f).alias(f) for f in none])
    rows = scan(rows, ["rank"], ["seq_id"], {"_s": ("last", F.col("idx"), True)}, SEQ_BLOCK, descending=True)
    heard = F.col("idx") * 2
    rows = cut(scan(rows, ["rank"], ["seq_id"], {"_h": ("last", heard, True)}, SEQ_BLOCK).withColumn("_h", F.when(F.col("idx").isNotNull(), heard).otherwise(F.col("_h") + 1)), "places")
    if named:
        # what follows a later call follows an earlier one too, so those that nothing follows or precedes can be passed over
        rows = scan(rows, ["rank"], ["seq_id"], {f"_s{flag(r, 'c')}": ("last", F.when(F.col(flag(r, "c")), F.col("_s")), False) for r in named}, SEQ_BLOCK, descending=True)
        rows = scan(rows, ["rank"], ["seq_id"], {f"_h{flag(r, 'o')}": ("last", F.when(F.col(flag(r, "o")), F.col("_h")), False) for r in named}, SEQ_BLOCK)
    out = []
    for r in rules:
        for slot, (s, h) in SLOTS[r].items():
            out += [F.col(f"_s{flag(r, 'c')}" if s else "_s").cast("int").alias(f"s_{slot}"), F.col(f"_h{flag(r, 'o')}" if h else "_h").alias(f"h_{slot}")]
    return rows.filter("_access").select("rank", "seq_id", *out)


def judged_pairs(ranges: DataFrame, calls: DataFrame, known: Sequence[tuple[DataFrame, list[int], Sequence[str]]]) -> DataFrame:
    """rank1, seq1, rank2, seq2 of the conflicts of ranges, each pair once, and for every rule a column: whether it is properly synchronized.

    Means the same as ``conflict_pairs`` and ``verify``; but accesses carry their clocks, so a pair is judged where it is
    found and never joined. ``known`` has clocks as lists, the ranks in their order, and the rules that go by them.
    """
    accesses = ranges.select("rank", "seq_id").filter("rank is not null and seq_id is not null")
    counted = cut(accesses.groupBy("rank", "seq_id").agg(F.count("*").alias("n")), "accesses")
    repeated = bool(counted.filter("n > 1").take(1)) or bool(ranges.filter("seq_id is null").take(1))
    rows, slots = ranges, {}
    for k, (lists, ranks, rules) in enumerate(known):
        places = access_places(counted.select("rank", "seq_id"), calls, lists, rules)
        order = ranges.sparkSession.createDataFrame([(r, i) for i, r in enumerate(ranks)], f"rank int, p_{k} int")
        places = places.join(order, "rank", "left")
        for r in rules:
            for slot in SLOTS[r]:
                clock = lists.select("rank", F.col("idx").alias("_idx"), "enter", "leave")
                h = F.col(f"h_{slot}")
                places = places.withColumn("_idx", F.floor(h / 2)).join(clock, ["rank", "_idx"], "left").withColumn(f"k_{slot}", F.when(h % 2 == 1, F.col("leave")).otherwise(F.col("enter"))).drop("_idx", "enter", "leave", f"h_{slot}")
                slots[slot] = k
        rows = rows.join(cut(places, "access-clocks"), ["rank", "seq_id"], "left")
    carried = [c for c in rows.columns if c not in ranges.columns]

    def ok(l: str, r: str) -> dict[str, Column]:
        before = lambda a, b, slot: F.coalesce(F.get(F.col(f"{b}.k_{slot}"), F.col(f"{a}.p_{slots[slot]}")) >= F.col(f"{a}.s_{slot}"), F.lit(False))
        either = {rule: [before(*ab, slot) for slot in SLOTS[rule] for ab in ((l, r), (r, l))] for _, _, rules in known for rule in rules}
        return {rule: functools.reduce(operator.or_, tests) for rule, tests in either.items()}

    every = [r for _, _, rules in known for r in rules]
    cols = ["rank1", "seq1", "rank2", "seq2"]
    pairs = conflict_pairs(cut(rows, "judged-ranges"), None, carried, ok).select(*cols, *every)
    return pairs.groupBy(*cols).agg(*[F.bool_or(r).alias(r) for r in every]) if repeated else pairs


def verdict(judged: DataFrame) -> DataFrame:
    """One row: pairs, pairs that aren't ok, and whether all are; true if there are none."""
    return judged.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum((~F.col("ok")).cast("bigint")), F.lit(0)).alias("n_violations"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("properly_synchronized"))


def clock_order(x: Column, y: Column) -> Column:
    """How two vector clocks lie: before, after, equal or concurrent."""
    le = F.forall(F.zip_with(x, y, lambda a, b: a <= b), lambda t: t)
    ge = F.forall(F.zip_with(x, y, lambda a, b: a >= b), lambda t: t)
    return F.when(le & ge, "equal").when(le, "before").when(ge, "after").otherwise("concurrent")


def closure(links: DataFrame) -> DataFrame:
    """All reachable pairs (src, dst) of a small graph given as links (src, dst), by doubling paths until none is new."""
    paths = cut(links.select("src", "dst").distinct(), "paths")
    while True:
        longer = paths.alias("p").join(paths.alias("q"), F.col("p.dst") == F.col("q.src")).select("p.src", "q.dst")
        more = cut(paths.union(longer).distinct(), "paths")
        if more.count() == paths.count():
            return more
        paths = more


def shortest_path(links: DataFrame, src: str, dst: str) -> list:
    """Nodes of a shortest path in links (src, dst), by breadth-first rounds; empty if there is none."""
    reached = links.sparkSession.createDataFrame([(src, [src])], "node string, path array<string>")
    while True:
        hit = reached.filter(F.col("node") == dst).take(1)
        if hit:
            return list(hit[0]["path"])
        step = reached.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = cut(step.join(reached.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")), "reached")
        if not new.take(1):
            return []
        reached = cut(reached.unionByName(new), "reached")


def dot_text(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The graph as lines of DOT: nodes with their rank as a lane, then edges."""
    n = nodes.select(F.concat(F.lit('  "'), "rank", F.lit("-"), "seq_id", F.lit('" [group='), "rank", F.lit("];")).alias("line"))
    e = links.filter("dst_rank is not null").select(F.concat(F.lit('  "'), "src_rank", F.lit("-"), "src_seq", F.lit('" -> "'), "dst_rank", F.lit("-"), "dst_seq", F.lit('";')).alias("line"))
    return n.union(e)


