"""Problem 8: items of varying length in containers of fixed capacity, by minimum bin slack.

For each container the longest remaining item is set, and a subset-sum over the lengths that are left, kept as a bitset
of reachable fills, finds the fullest feasible combination; those items are taken and the next container begins.
Items are packed in groups of bounded size, drawn by hash, so that groups are alike and no task sees them all; what a
group leaves in containers that aren't full is packed again together, in fewer groups each time, as long as a round leaves
so much less that a quarter fewer groups hold it; else, and after a round of one group, its containers stay as they are.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.runtime import cut

#: Items packed by one call; a group holds about as many.
GROUP_ITEMS = 8_192
#: A container filled less than this is taken apart and packed again with others.
FULL_ENOUGH = 0.98
#: Kinds of containers are a setting, not data: more than this are refused.
MAX_KINDS = 1_000
#: Fixed value: splits text before the merges of the vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODINGS: dict = {}


def encoding(vocabulary: str):
    """The byte-pair encoding of a rank file; loaded once in a process."""
    if vocabulary not in _ENCODINGS:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODINGS[vocabulary] = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[vocabulary]


def token_counts(docs: DataFrame, doc_id: str, text: str, vocabulary: str) -> DataFrame:
    """doc_id and n_tokens of every row; a null or empty text has 0. Whole texts are encoded.

    ``vocabulary`` is a file that the driver reads; executors get it from there.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(SparkFiles.get(name))
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["_text"]]})

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).mapInPandas(scan, f"doc_id {dict(docs.dtypes)[doc_id]}, n_tokens bigint")


def fullest(lengths: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, how many) of a combination of the available lengths that fills ``room`` as far as any can."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length, count in zip(lengths.tolist(), counts.tolist()):
        left, part = min(count, room // length), 1
        while left:
            part = min(part, left)
            before = reach
            reach |= (reach << (length * part)) & mask
            if reach != before:
                steps.append((length, part, before))
            if reach >> room:
                left = 0
                break
            left -= part
            part *= 2
        if reach >> room:
            break
    fill, taken = reach.bit_length() - 1, []
    for length, part, before in reversed(steps):
        if not (before >> fill) & 1:
            taken.append((length, part))
            fill -= length * part
    return taken


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item. Sizes lie between 1 and capacity."""
    out = np.full(len(sizes), -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    starts = np.searchsorted(sizes[order], np.arange(capacity + 2))
    counts = np.diff(starts)
    used = np.zeros(capacity + 1, np.int64)  # items of a length that are placed already
    container, longest = 0, capacity

    def take(length: int, many: int) -> None:
        a = starts[length] + used[length]
        out[order[a : a + many]] = container
        used[length] += many
        counts[length] -= many

    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return out
        room = capacity - longest
        take(longest, 1)
        if room:
            lengths = np.nonzero(counts[1 : room + 1])[0][::-1] + 1
            for length, many in fullest(lengths, counts[lengths], room):
                take(length, many)
        container += 1


def pack_items(items: DataFrame, containers: DataFrame, item_id: str = "doc_id", size: str = "n_tokens", group_items: int = GROUP_ITEMS) -> DataFrame:
    """container_kind, capacity_tokens, container_id, item id, piece, piece_start, piece_end, n for every item and kind.

    An item that exceeds a kind's capacity is split into full containers of its own and one rest, which is packed with the
    others; no other item is split. Items of size 0 or null take no room: they are given once per kind with a null
    container_id. Ids may be null or repeated; each row is an item. Kinds with a null capacity or one below 1 are left out.
    ``containers`` is a small list of kinds. Empty tables give no rows.
    """
    kinds = containers.filter("capacity_tokens >= 1").select("container_kind", F.col("capacity_tokens").cast("int").alias("c")).distinct().limit(MAX_KINDS + 1).collect()
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    each = [F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity_tokens")) for k, c in sorted(kinds, key=str)]
    each = F.array(*each) if each else F.expr("cast(array() as array<struct<container_kind string, capacity_tokens int>>)")
    n = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    rows = items.select(F.col(item_id).alias("_id"), n.alias("_size"), F.explode(each).alias("_k")).select("_id", "_size", "_k.container_kind", "_k.capacity_tokens")
    cap = F.col("capacity_tokens")
    pieces = F.greatest(F.ceil(F.col("_size") / cap), F.lit(1))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))
    rows = rows.withColumn("piece_start", F.col("piece") * cap).withColumn("piece_end", F.least(F.col("_size"), (F.col("piece") + 1) * cap))
    rows = cut(rows.withColumn("n", F.col("piece_end") - F.col("piece_start")), "pieces")

    alone = F.when(F.col("n") > 0, F.concat_ws("-", "container_kind", F.lit("full"), F.coalesce(F.col("_id").cast("string"), F.lit("null")), "piece"))
    columns = ["container_kind", "capacity_tokens", "_id", "piece", "piece_start", "piece_end", "n"]
    out = rows.filter((F.col("n") == 0) | (F.col("n") == cap)).select(*columns, alone.alias("container_id"))
    todo = rows.filter((F.col("n") > 0) & (F.col("n") < cap)).select(*columns)

    schema = ", ".join(f"{c} {t}" for c, t in todo.dtypes) + ", container_id string"

    def one_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        numbers = pack(pdf["n"].to_numpy(np.int64), int(key[1]))
        pdf["container_id"] = [f"{key[0]}-{int(key[2])}-{k}" for k in numbers]
        return pdf.drop(columns="_group")

    most = todo.groupBy("container_kind").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    groups, first_id = max(1, -(-most // group_items)), 0
    while True:
        number = F.pmod(F.xxhash64("_id", "piece", F.lit(first_id)), F.lit(groups)) + first_id
        packed = todo.withColumn("_group", number).groupBy("container_kind", "capacity_tokens", "_group").applyInPandas(one_group, schema)
        packed = cut(packed, "packed")
        if groups == 1:
            return out.unionByName(packed).withColumnRenamed("_id", item_id)
        fill = packed.groupBy("container_id").agg((F.sum("n") < F.lit(FULL_ENOUGH) * F.max("capacity_tokens")).alias("_slack"))
        marked = cut(packed.join(fill, "container_id"), "filled")
        rest = marked.filter("_slack").groupBy("container_kind").agg(F.count("*").alias("c")).collect()  # at most MAX_KINDS
        need = {r["container_kind"]: -(-r["c"] // group_items) for r in rest}
        # a kind whose rest doesn't shrink would fill ever larger groups
        again = {k: n for k, n in need.items() if n <= max(1, groups * 3 // 4)}
        stays = ~F.col("_slack") | ~F.coalesce(F.col("container_kind").isin(*[k for k in again if k is not None]), F.lit(None in again))
        out = out.unionByName(marked.filter(stays).drop("_slack"))
        if not again:
            return out.withColumnRenamed("_id", item_id)
        todo = marked.filter(~stays).select(*columns)
        first_id += groups
        groups = max(again.values())


def container_fill(packed: DataFrame) -> DataFrame:
    """Per container kind: items placed, containers used, tokens, the least number of containers possible, and slack."""
    used = packed.filter("container_id is not null").groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n").alias("fill"), F.count("*").alias("items"))
    return used.groupBy("container_kind", "capacity_tokens").agg(
        F.count("*").alias("n_containers"),
        F.sum("items").alias("n_items"),
        F.sum("fill").alias("n_tokens"),
        F.ceil(F.sum("fill") / F.col("capacity_tokens")).alias("least_containers"),
        (1 - F.sum("fill") / (F.count("*") * F.col("capacity_tokens"))).alias("slack_share"),
    )
