"""Message-passing calls: one shape for all of them, and which belong together."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.functions.facts import int_list, status_pair
from calltide.operators.sequence import scan
from calltide.runtime import together

ANY_SOURCE, ANY_TAG = -2, -1
#: Blocks of sequence numbers for running values.
SEQ_BLOCK = 4096

#: Which argument (from 0) holds what, for each matched call. src: source or root; dst: destination; stag and
#: rtag: tag of the send and of the receive; comm: communicator; req: request or file handle, reqs: list of requests; flag:
#: flag or count of what completed; tindx: completed place, tindxs: list of them; status: source and tag as received.
ARGUMENTS = {
    "MPI_Send": {"dst": 3, "stag": 4, "comm": 5},
    "MPI_Ssend": {"dst": 3, "stag": 4, "comm": 5},
    "MPI_Isend": {"dst": 3, "stag": 4, "comm": 5, "req": 6},
    "MPI_Recv": {"src": 3, "rtag": 4, "comm": 5, "status": 6},
    "MPI_Irecv": {"src": 3, "rtag": 4, "comm": 5, "req": 6},
    "MPI_Sendrecv": {"dst": 3, "stag": 4, "src": 8, "rtag": 9, "comm": 10},
    "MPI_Wait": {"req": 0, "status": 1},
    "MPI_Waitall": {"reqs": 1},
    "MPI_Waitany": {"reqs": 1, "tindx": 2},
    "MPI_Waitsome": {"reqs": 1, "flag": 2, "tindxs": 3},
    "MPI_Test": {"req": 0, "flag": 1, "status": 2},
    "MPI_Testall": {"reqs": 1, "flag": 2},
    "MPI_Testany": {"reqs": 1, "tindx": 2, "flag": 3},
    "MPI_Testsome": {"reqs": 1, "flag": 2, "tindxs": 3},
    "MPI_Bcast": {"src": 3, "comm": 4},
    "MPI_Ibcast": {"src": 3, "comm": 4, "req": 5},
    "MPI_Reduce": {"src": 5, "comm": 6},
    "MPI_Ireduce": {"src": 5, "comm": 6, "req": 7},
    "MPI_Gather": {"src": 6, "comm": 7},
    "MPI_Igather": {"src": 6, "comm": 7, "req": 8},
    "MPI_Gatherv": {"src": 7, "comm": 8},
    "MPI_Igatherv": {"src": 7, "comm": 8, "req": 9},
    "MPI_Barrier": {"comm": 0},
    "MPI_Alltoall": {"comm": 6},
    "MPI_Allgather": {"comm": 6},
    "MPI_Allgatherv": {"comm": 7},
    "MPI_Allreduce": {"comm": 5},
    "MPI_Reduce_scatter": {"comm": 5},
    "MPI_File_open": {"comm": 0, "req": 4},
    "MPI_File_close": {"req": 0},
    "MPI_File_set_size": {"req": 0},
    "MPI_File_sync": {"req": 0},
    "MPI_File_read_all": {"req": 0},
    "MPI_File_read_ordered": {"req": 0},
    "MPI_File_write_all": {"req": 0},
    "MPI_File_write_ordered": {"req": 0},
    "MPI_File_read_at_all": {"req": 0},
    "MPI_File_write_at_all": {"req": 0},
    "MPI_File_set_view": {"req": 0},
    "MPI_Comm_dup": {"comm": 1},
    "MPI_Comm_split": {"comm": 3},
    "MPI_Comm_split_type": {"comm": 4},
    "MPI_Cart_create": {"comm": 5},
    "MPI_Cart_sub": {"comm": 2},
}
#: The roles of calls in matching; names not in the first two lists are all-to-all.
SENDS, RECEIVES = ("MPI_Send", "MPI_Ssend", "MPI_Isend", "MPI_Sendrecv"), ("MPI_Recv", "MPI_Irecv", "MPI_Sendrecv")
COMPLETIONS = ("MPI_Wait", "MPI_Waitall", "MPI_Waitany", "MPI_Waitsome", "MPI_Test", "MPI_Testall", "MPI_Testany", "MPI_Testsome")
ONE_TO_MANY = ("MPI_Bcast", "MPI_Ibcast")
MANY_TO_ONE = ("MPI_Reduce", "MPI_Ireduce", "MPI_Gather", "MPI_Igather", "MPI_Gatherv", "MPI_Igatherv")
#: Collectives that are guaranteed to synchronize.
SYNCHRONIZING = ("MPI_Barrier", "MPI_Allgather", "MPI_Allgatherv", "MPI_Alltoall", "MPI_Alltoallv", "MPI_Alltoallw", "MPI_Allreduce", "MPI_Reduce_scatter", "MPI_Reduce_scatter_block")
#: Communicator constructors, with the places of the new communicator and of the rank in it.
CONSTRUCTORS = {"MPI_Comm_split": (3, 4), "MPI_Comm_split_type": (4, 5), "MPI_Comm_dup": (1, 2), "MPI_Cart_create": (5, 6), "MPI_Comm_create": (2, 3), "MPI_Cart_sub": (2, 3)}
WORLD = ("MPI_COMM_WORLD", "COMM_WORLD")
NULL_COMM = ("MPI_COMM_NULL", "COMM_NULL")


def role(func: Column) -> Column:
    """send, recv, sendrecv, completion, one-to-many, many-to-one or all-to-all; null for calls that aren't matched."""
    return (
        F.when(func == "MPI_Sendrecv", "sendrecv")
        .when(func.isin(*SENDS), "send")
        .when(func.isin(*RECEIVES), "recv")
        .when(func.isin(*COMPLETIONS), "completion")
        .when(func.isin(*ONE_TO_MANY), "one-to-many")
        .when(func.isin(*MANY_TO_ONE), "many-to-one")
        .when(func.isin(*ARGUMENTS, *SYNCHRONIZING), "all-to-all")
    )


def synchronizing(func: Column) -> Column:
    """Whether a collective call orders its participants by itself."""
    return func.isin(*SYNCHRONIZING)


def normalize(calls: DataFrame) -> DataFrame:
    """rank, seq_id, func, role, src, dst, stag, rtag, comm, req (list), tindx (list) and done, for every matched call.

    A source or tag of "any" is replaced by the one in the status, where the call has one. done is false for a test that
    completed nothing. Collectives of an open file carry its handle in req.
    """
    def arg(*fields: str) -> Column:
        """The argument that holds one of the fields; null for calls without it."""
        out = F.lit(None).cast("string")
        at = {name: places[f] for name, places in ARGUMENTS.items() for f in fields if f in places}
        for place in sorted(set(at.values())):
            out = F.when(F.col("func").isin(*[n for n, k in at.items() if k == place]), F.get("args", F.lit(place))).otherwise(out)
        return out

    def listed(one: str, many: str) -> Column:
        single = F.when(arg(one).isNotNull(), F.array(arg(one))).otherwise(F.array().cast("array<string>"))
        has_list = F.col("func").isin(*[n for n, places in ARGUMENTS.items() if many in places])
        return F.when(has_list, F.coalesce(int_list(arg(many)), F.array().cast("array<string>"))).otherwise(single)

    status = status_pair(arg("status"))
    src, rtag = arg("src").try_cast("int"), arg("rtag").try_cast("int")
    waits = F.col("func").isin("MPI_Wait", "MPI_Test")
    flag = arg("flag").try_cast("int")
    return calls.filter(F.col("func").isin(*ARGUMENTS)).select(
        "rank", "seq_id", "func", role(F.col("func")).alias("role"),
        F.when(waits, status["src"]).when(src == ANY_SOURCE, F.coalesce(status["src"], src)).otherwise(src).alias("src"),
        arg("dst").try_cast("int").alias("dst"),
        arg("stag").try_cast("int").alias("stag"),
        F.when(waits, status["tag"]).when(rtag == ANY_TAG, F.coalesce(status["tag"], rtag)).otherwise(rtag).alias("rtag"),
        arg("comm").alias("comm"), listed("req", "reqs").alias("req"), listed("tindx", "tindxs").alias("tindx"),
        (F.coalesce(flag, F.lit(1)) != 0).alias("done"),
    )


def communicators(calls: DataFrame) -> DataFrame:
    """comm, local_rank, world_rank of the communicators that calls made; members with a null communicator are none."""
    pick = lambda k: F.coalesce(*[F.when(F.col("func") == f, F.get("args", F.lit(p[k]))) for f, p in CONSTRUCTORS.items()])
    rows = calls.filter(F.col("func").isin(*CONSTRUCTORS)).select(pick(0).alias("comm"), pick(1).try_cast("int").alias("local_rank"), F.col("rank").alias("world_rank"))
    return rows.filter(F.col("comm").isNotNull() & ~F.col("comm").isin(*NULL_COMM, *WORLD) & (F.col("local_rank") >= 0)).distinct()


def to_world(matched: DataFrame, comms: DataFrame, column: str) -> DataFrame:
    """A local rank column translated to world ranks; those of the world communicator and of unknown ones stay."""
    table = comms.groupBy(F.col("comm").alias("_c"), F.col("local_rank").alias("_l")).agg(F.min("world_rank").alias("_w"))
    out = matched.join(table, (F.col("comm") == F.col("_c")) & (F.col(column) == F.col("_l")), "left")
    return out.withColumn(column, F.coalesce("_w", column)).drop("_c", "_l", "_w")


def completions(matched: DataFrame) -> DataFrame:
    """rank, post_seq, done_seq: the n-th call that posts a request belongs to the n-th that completes it.

    Handles are reused, so it is the occurrence and not the value that matches. All posts count, sends too; waits and
    tests on any or some complete only the listed places; tests that completed nothing are left out.
    """
    posts = matched.filter((F.col("role") != "completion") & F.col("func").rlike("^MPI_I") & (F.size("req") > 0))
    posts = posts.select("rank", "seq_id", F.get("req", F.lit(0)).alias("handle"))
    done = matched.filter((F.col("role") == "completion") & F.col("done")).select("rank", "seq_id", "func", "tindx", F.posexplode("req").alias("at", "handle"))
    partial = F.col("func").isin("MPI_Waitany", "MPI_Waitsome", "MPI_Testany", "MPI_Testsome")
    done = done.filter(~partial | F.array_contains("tindx", F.col("at").cast("string"))).select("rank", "seq_id", "handle").distinct()
    number = lambda d: scan(d, ["rank", "handle"], ["seq_id"], {"k": ("sum", F.lit(1), False)}, SEQ_BLOCK)
    p = number(posts).select("rank", "handle", "k", F.col("seq_id").alias("post_seq"))
    return p.join(number(done).select("rank", "handle", "k", F.col("seq_id").alias("done_seq")), ["rank", "handle", "k"]).select("rank", "post_seq", "done_seq")


def collectives(matched: DataFrame, done: DataFrame | None = None, only_synchronizing: bool = False) -> DataFrame:
    """Groups of collective calls: func, comm, handle, k, and the members as sorted (rank, seq_id).

    The k-th call of a rank with the same function, communicator and file handle belongs to the k-th of every other rank.
    A non-blocking one stands where its completion does, if that is known. Groups of one are left out.
    """
    rows = matched.filter(F.col("role").isin("one-to-many", "many-to-one", "all-to-all"))
    if only_synchronizing:
        rows = rows.filter(synchronizing(F.col("func")) | F.col("func").isin("MPI_File_open", "MPI_File_close", "MPI_File_sync"))
    handle = F.when(F.col("func").startswith("MPI_File"), F.get("req", F.lit(0)))
    rows = rows.select("rank", "seq_id", "func", "role", "src", F.coalesce("comm", F.lit("")).alias("comm"), F.coalesce(handle, F.lit("")).alias("handle"))
    numbered = scan(rows, ["rank", "func", "comm", "handle"], ["seq_id"], {"k": ("sum", F.lit(1), False)}, SEQ_BLOCK)
    if done is not None:
        numbered = numbered.join(done.select("rank", F.col("post_seq").alias("seq_id"), "done_seq"), ["rank", "seq_id"], "left").withColumn("seq_id", F.coalesce("done_seq", "seq_id")).drop("done_seq")
    groups = numbered.groupBy("func", "role", "comm", "handle", "k").agg(F.sort_array(F.collect_list(F.struct("rank", "seq_id"))).alias("members"), F.max("src").alias("root"))
    return groups.filter(F.size("members") > 1)


def fifo_pairs(sends: DataFrame, receives: DataFrame, order: str = "seq_id", width: int = SEQ_BLOCK) -> DataFrame:
    """src, dst, tag, comm, k and both sequence numbers: the k-th send of a channel meets its k-th receive.

    ``sends`` and ``receives`` have rank, peer, tag, comm, seq_id and the integer ``order``, whose blocks of ``width`` are
    numbered by a task each; no tag is open here.
    """
    s = sends.select(F.col("rank").alias("src"), F.col("peer").alias("dst"), "tag", "comm", F.col("seq_id").alias("send_seq"), F.col(order).alias("_o"))
    r = receives.select(F.col("peer").alias("src"), F.col("rank").alias("dst"), "tag", "comm", F.col("seq_id").alias("recv_seq"), F.col(order).alias("_o"))
    channel = ["src", "dst", "comm", "tag"]
    s = scan(s, channel, ["_o", "send_seq"], {"k": ("sum", F.lit(1), False)}, width).drop("_o")
    r = scan(r, channel, ["_o", "recv_seq"], {"k": ("sum", F.lit(1), False)}, width).drop("_o")
    return s.join(r, [*channel, "k"])


def _first_fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Calls of one channel after another, in order: a message takes the first waiting partner whose tag allows it."""
    channel, sends = None, {}
    for b in batches:
        out = []
        for src, dst, comm, side, seq, tag in zip(*(b[c].tolist() for c in ("src", "dst", "comm", "side", "seq_id", "tag"))):
            if (src, dst, comm) != channel:
                channel, sends = (src, dst, comm), {}
            if side == 0:  # all sends of a channel come before its receives
                sends.setdefault(tag, deque()).append(seq)
                continue
            waiting = sends.get(tag) if tag != ANY_TAG else min((q for q in sends.values() if q), key=lambda q: q[0], default=None)
            if waiting:
                out.append((src, dst, comm, waiting.popleft(), seq))
        yield pd.DataFrame(out, columns=["src", "dst", "comm", "send_seq", "recv_seq"])


def point_to_point(matched: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """src, dst, comm, send_seq, recv_seq of matched messages.

    Channels without an open tag match by count (``fifo_pairs``). Where a receive takes any tag, it takes the earliest
    send that is left; such channels are walked in order, with only the unmatched sends of one channel held. A
    non-blocking receive stands where its completion does, and one without completion is no receive.
    """
    send = matched.filter(F.col("role").isin("send", "sendrecv")).select("rank", F.col("dst").alias("peer"), F.col("stag").alias("tag"), "comm", "seq_id")
    recv = matched.filter(F.col("role").isin("recv", "sendrecv")).select("rank", F.col("src").alias("peer"), F.col("rtag").alias("tag"), "comm", "seq_id", "func")
    if done is not None:
        recv = recv.join(done.select("rank", F.col("post_seq").alias("seq_id"), "done_seq"), ["rank", "seq_id"], "left")
        recv = recv.filter((F.col("func") != "MPI_Irecv") | F.col("done_seq").isNotNull()).withColumn("place", F.coalesce("done_seq", "seq_id")).drop("done_seq")
    else:
        recv = recv.withColumn("place", F.col("seq_id"))
    recv = recv.drop("func")
    open_ = recv.filter(F.col("tag") == ANY_TAG).select(F.col("peer").alias("_s"), F.col("rank").alias("_d"), F.col("comm").alias("_c")).distinct()
    s_on = (F.col("rank") == F.col("_s")) & (F.col("peer") == F.col("_d")) & (F.col("comm") == F.col("_c"))
    r_on = (F.col("peer") == F.col("_s")) & (F.col("rank") == F.col("_d")) & (F.col("comm") == F.col("_c"))
    plain = fifo_pairs(send.join(open_, s_on, "left_anti"), recv.join(open_, r_on, "left_anti"))
    places = recv.select(F.col("rank").alias("dst"), F.col("seq_id").alias("recv_seq"), "place")
    plain = plain.select("src", "dst", "comm", "send_seq", "recv_seq")
    a = send.join(open_, s_on, "left_semi").select(F.col("rank").alias("src"), F.col("peer").alias("dst"), "comm", F.lit(0).alias("side"), "seq_id", "tag")
    b = recv.join(open_, r_on, "left_semi").select(F.col("peer").alias("src"), F.col("rank").alias("dst"), "comm", F.lit(1).alias("side"), "seq_id", "tag")
    walked = together(a.unionByName(b), "src", "dst", "comm").sortWithinPartitions("src", "dst", "comm", "side", "seq_id")
    fitted = walked.mapInPandas(_first_fit, "src int, dst int, comm string, send_seq bigint, recv_seq bigint")
    both = plain.unionByName(fitted)
    return both.join(places, ["dst", "recv_seq"]).select("src", "dst", "comm", "send_seq", F.col("place").alias("recv_seq"))


def unmatched(matched: DataFrame, pairs: DataFrame, groups: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Per rank: sends, receives and collective calls that found no partner."""
    calls = matched.filter(F.col("role").isin("send", "recv", "one-to-many", "many-to-one", "all-to-all")).withColumn("seq", F.col("seq_id"))
    if done is not None:
        calls = calls.join(done.select("rank", F.col("post_seq").alias("seq_id"), "done_seq"), ["rank", "seq_id"], "left").withColumn("seq", F.when(F.col("role") == "send", F.col("seq_id")).otherwise(F.coalesce("done_seq", "seq_id")))
    met = (
        pairs.select(F.col("src").alias("_r"), F.col("send_seq").alias("_s"))
        .union(pairs.select(F.col("dst"), F.col("recv_seq")))
        .union(groups.select(F.explode("members").alias("m")).select("m.rank", "m.seq_id"))
        .distinct()
    )
    left = calls.join(met, (F.col("rank") == F.col("_r")) & (F.col("seq") == F.col("_s")), "left_anti")
    kind = F.when(F.col("role").isin("send", "recv"), F.col("role")).otherwise("collective")
    return left.groupBy("rank", kind.alias("kind")).agg(F.count("*").alias("n_unmatched"))
