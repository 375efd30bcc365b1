"""Problem 2: ordered patterns that many entities share, with bounded gaps between their steps.

Sequences are stored once, as arrays of a few thousand events. The starts of frequent pairs become pseudo-projections: a
start with the items that follow it (at most as many as a longest pattern can span) and the few before it. Projections
are partitioned by their first item, and the partition of an item that holds very many starts is split. Patterns then grow
one step at a time by walking the projections along a trie of the patterns found so far; what leaves a task are only
distinct (pattern, next item, entity) triples.

Closure. With a bounded gap only an extension at either end keeps every occurrence (an item put between two steps widens
their gap). Walking a pattern's projection counts the items behind it and those in the gap before it: it is closed if
none of them has its support (bidirectional extension check, within the longest length). Every frequent pattern is a
contiguous part of a closed one of equal support, so all supports can be recovered (``all_supports``).

Backscan pruning. If some item e stands in the gap before every start of P, then P followed by anything has the support
of e, P, anything. P is then not grown: e P is grown instead, one step longer than otherwise and with e exempt from the
rule that items differ, so that nothing of P's subtree is lost. To stay sound under a longest length, e P itself is never
pruned, nor is P if the beginning of e P is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.runtime import BROADCAST_ROWS, cut, release

#: Starts of one first item that one task walks; an item with more is split.
STARTS_PER_TASK = 1_000_000
#: Events that are laid out as windows at a time.
EVENTS_AT_A_TIME = 1 << 18
#: What a row of counts says: entities that have a pattern and an item behind it; or before it, with the starts; starts of a pattern; entities that have an item.
AHEAD, BEFORE, STARTS, ITEM = range(4)


def _small(table: DataFrame) -> bool:
    return table.count() <= BROADCAST_ROWS


def _blocks(events: DataFrame, entity: str, order: str, item: str, least: int, reach: int, back: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Sequences in blocks of ``order``: _e, _block, items, behind (the next items of later blocks), before (the last of earlier ones).

    Items that too few entities have are -1. Also gives the table that has to be released.
    """
    rows = events.select(F.col(entity).alias("_e"), F.floor(F.col(order) / block).alias("_block"), F.col(order).alias("_o"), F.col(item).cast("int").alias("_i")).filter("_e is not null and _i is not null")
    # of repeated rows only one stands, so this may count too much: it only leaves out what is surely infrequent
    known = cut(rows.groupBy("_i", "_e").agg(F.lit(1).alias("_1")).groupBy("_i").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(F.col("_i").alias("_known")), "known-items")
    once = rows.groupBy("_e", "_block", "_o").agg(F.max("_i").alias("_i"))
    once = once.join(F.broadcast(known) if _small(known) else known, F.col("_i") == F.col("_known"), "left")
    packed = once.groupBy("_e", "_block").agg(F.sort_array(F.collect_list(F.struct("_o", F.coalesce("_known", F.lit(-1)).alias("i")))).alias("s"))
    blocks = cut(packed.select("_e", "_block", F.transform("s", lambda x: x["i"]).alias("items")), "sequences")
    release(known)
    # one short row a block says what lies beyond its ends
    ends = blocks.select("_e", "_block", F.slice("items", 1, reach).alias("_head"), F.reverse(F.slice(F.reverse("items"), 1, back)).alias("_tail"))
    w = Window.partitionBy("_e").orderBy("_block")
    behind = F.slice(F.flatten(F.collect_list("_head").over(w.rowsBetween(1, reach))), 1, reach)
    before = F.reverse(F.slice(F.reverse(F.flatten(F.collect_list("_tail").over(w.rowsBetween(-back, -1)))), 1, back))
    ends = ends.select(F.col("_e").alias("_ee"), F.col("_block").alias("_eb"), behind.alias("behind"), before.alias("before"))
    ends = F.broadcast(ends) if _small(blocks) else ends
    return blocks.join(ends, (F.col("_e") == F.col("_ee")) & (F.col("_block") == F.col("_eb"))).drop("_ee", "_eb"), blocks


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """The columns' distinct rows, with the number of each as a last column."""
    order = np.lexsort(columns[::-1])
    c = [x[order] for x in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in c:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return [*(x[first] for x in c), np.diff(np.append(first, len(order)))]


def _lay_out(b: pd.DataFrame, reach: int, back: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of sequences: row of b, window (own item and the next ``reach``) and the ``back`` items before, of every event."""
    part, n = [], 0
    for k in range(len(b) + 1):
        if part and (k == len(b) or n > EVENTS_AT_A_TIME):
            flat, at, row = [], [], []
            place = 0
            for r in part:
                items, behind, before = b["items"].iat[r], b["behind"].iat[r], b["before"].iat[r]
                flat += [np.full(back - len(before), -1), before, items, behind, np.full(reach - len(behind), -1)]
                at.append(place + back + np.arange(len(items)))
                row.append(np.full(len(items), r))
                place += back + len(items) + reach
            flat, at, row = np.concatenate(flat).astype(np.int32), np.concatenate(at), np.concatenate(row)
            own = flat[at] >= 0
            at, row = at[own], row[own]
            yield row, flat[at[:, None] + np.arange(reach + 1)], flat[at[:, None] - 1 - np.arange(back)]
            part, n = [], 0
        if k < len(b):
            part.append(k)
            n += len(b["items"].iat[k])


def _counts(kind: int, ids: np.ndarray, x: np.ndarray | None, entity: np.ndarray | None, n: np.ndarray | None, entities: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({
        "kind": np.full(len(ids), kind, np.int32), "id": ids.astype(np.int64), "x": np.full(len(ids), -1, np.int32) if x is None else x.astype(np.int32),
        "entity": None if entity is None else entities[entity], "n": np.zeros(len(ids), np.int64) if n is None else n.astype(np.int64),
    })


def _before(start: np.ndarray, pattern: np.ndarray, ahead_of: np.ndarray, entity: np.ndarray, excluded: np.ndarray) -> tuple:
    """Distinct (pattern, item in the gap before, entity) and at how many starts; ``ahead_of`` has those items for each start."""
    back = ahead_of.shape[1]
    s, p, e = np.repeat(start, back), np.repeat(pattern, back), ahead_of.ravel()
    good = (e >= 0) & ~excluded.ravel()
    s, p, e, _ = _distinct(s[good], p[good], e[good])
    return _distinct(p, e, entity[s])


def _first_counts(blocks: DataFrame, entity_type: str, reach: int, back: int) -> DataFrame:
    """Counts of single items: the pairs they begin, what stands before them, their starts and their entities."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            entities = b["_e"].to_numpy()
            for row, w, p in _lay_out(b, reach, back):
                first = w[:, 0]
                pairs = [(first, w[:, j], row) for j in range(1, back + 1)]
                i, x, r = (np.concatenate(c) for c in zip(*pairs))
                good = (x >= 0) & (x != i)
                i, x, r, _ = _distinct(i[good], x[good], r[good])
                yield _counts(AHEAD, i, x, r, None, entities)
                i, e, r, n = _before(np.arange(len(first)), first, p, row, p == first[:, None])
                yield _counts(BEFORE, i, e, r, n, entities)
                i, r, n = _distinct(first, row)
                yield _counts(ITEM, i, None, r, n, entities)

    return blocks.select("_e", "items", "behind", "before").mapInPandas(scan, f"kind int, id bigint, x int, entity {entity_type}, n bigint")


class Patterns:
    """Patterns of one length as a trie, to be found in windows."""

    def __init__(self, nodes: list, pairs: np.ndarray | None):
        order = sorted(nodes, key=lambda r: list(r["pat"]))
        self.items = np.array([r["pat"] for r in order], np.int64)
        self.ids = np.array([r["id"] for r in order], np.int64)
        self.lead = np.array([r["lead"] for r in order], np.int64)
        #: Frequent pairs as first * 2^32 + second, sorted, if they are few: other items can't follow or precede.
        self.pairs = pairs
        self.keys, parent = [], np.zeros(len(order), np.int64)
        for d in range(self.items.shape[1]):
            keys, parent = np.unique((parent << 32) + self.items[:, d], return_inverse=True)
            self.keys.append(keys)

    def _paired(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.pairs is None or not len(self.pairs):
            return np.full(len(a), self.pairs is None)
        key = (a.astype(np.int64) << 32) + b
        return self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key

    def walk(self, w: np.ndarray, p: np.ndarray, row: np.ndarray, step: int, entities: np.ndarray, grows_before: bool) -> Iterator[pd.DataFrame]:
        """Counts for all windows: what stands behind the patterns that begin there, and before them."""
        width = w.shape[1]
        start, at, node = np.arange(len(w)), np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        for d, keys in enumerate(self.keys):
            moves = range(1, step + 1) if d else (0,)
            s, a, n = (np.concatenate(c) for c in zip(*[(start, at + j, node) for j in moves]))
            x = w[s, a].astype(np.int64)
            key = (n << 32) + x
            child = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            met = (x >= 0) & (keys[child] == key)
            # one place in a window is reached once, whatever the steps between
            there = np.unique(((s[met] * width + a[met]) << 32) + child[met])
            start, at, node = (there >> 32) // width, (there >> 32) % width, there & 0xFFFFFFFF
        size = self.items.shape[1]
        ahead = [(start, node, w[start, at + j].astype(np.int64)) for j in range(1, step + 1)]
        s, n, x = (np.concatenate(c) for c in zip(*ahead))
        good = (x >= 0) & self._paired(self.items[n, -1], x)
        s, n, x = s[good], n[good], x[good]
        body = np.arange(size) >= self.lead[n][:, None]
        new = ~((self.items[n] == x[:, None]) & body).any(axis=1)
        n, x, r, _ = _distinct(n[new], x[new], row[s[new]])
        yield _counts(AHEAD, self.ids[n], x, r, None, entities)
        if not grows_before:
            return
        s, n, _ = _distinct(start, node)
        e = p[s].astype(np.int64)
        inside = (self.items[n][:, None, :] == e[:, :, None]).any(axis=2)
        inside |= ~self._paired(e.ravel(), np.repeat(self.items[n, 0], e.shape[1])).reshape(e.shape)
        # the exempt item of a pattern is no reason to leave out others, but a pattern that repeats it has no plain extension
        inside |= (self._repeats(n))[:, None]
        k, e, r, many = _before(np.arange(len(s)), n, e, row[s], inside)
        yield _counts(BEFORE, self.ids[k], e, r, many, entities)
        n, many = _distinct(n)
        yield _counts(STARTS, self.ids[n], None, None, many, entities)

    def _repeats(self, n: np.ndarray) -> np.ndarray:
        if "_twice" not in self.__dict__:
            s = np.sort(self.items, axis=1)
            self._twice = (s[:, 1:] == s[:, :-1]).any(axis=1)
        return self._twice[n]


def _project(blocks: DataFrame, firsts: DataFrame, entity_type: str, reach: int, back: int) -> DataFrame:
    """_first, _e, starts (windows one after another) and before (the items before each), partitioned by first item, large ones split."""
    few = firsts.count() <= BROADCAST_ROWS
    wanted = blocks.sparkSession.sparkContext.broadcast(np.sort(np.array([r["_first"] for r in firsts.select("_first").collect()], np.int64)) if few else None)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, w, p in _lay_out(b, reach, back):
                if wanted.value is not None:
                    keep = np.isin(w[:, 0], wanted.value)
                    row, w, p = row[keep], w[keep], p[keep]
                order = np.lexsort((row, w[:, 0]))
                row, w, p = row[order], w[order], p[order]
                edges = np.flatnonzero((np.diff(w[:, 0]) != 0) | (np.diff(row) != 0)) + 1
                for s in np.split(np.arange(len(row)), edges) if len(row) else []:
                    out.append((w[s[0], 0], b["_e"].iat[row[s[0]]], b["_block"].iat[row[s[0]]], w[s].ravel(), p[s].ravel()))
            yield pd.DataFrame(out, columns=["_first", "_e", "_block", "starts", "before"])

    rows = blocks.mapInPandas(scan, f"_first int, _e {entity_type}, _block bigint, starts array<int>, before array<int>")
    parts = firsts.select(F.col("_first").alias("_f"), F.greatest(F.lit(1), F.ceil(F.col("n") / STARTS_PER_TASK)).alias("_parts"))
    rows = rows.join(F.broadcast(parts) if few else parts, F.col("_first") == F.col("_f")).withColumn("_part", F.pmod(F.xxhash64("_e", "_block"), F.col("_parts")))
    return rows.select("_first", "_part", "_e", "starts", "before").repartition("_first", "_part")


def _grow(projection: DataFrame, nodes: DataFrame, pairs: np.ndarray | None, entity_type: str, reach: int, back: int, grows_before: bool) -> DataFrame:
    """Counts of the patterns ``nodes`` (id, pat, lead) in the projections."""
    schema = f"kind int, id bigint, x int, entity {entity_type}, n bigint"

    def walk(b: pd.DataFrame, patterns: Patterns) -> Iterator[pd.DataFrame]:
        if not len(b):
            return
        w, p = np.concatenate(b["starts"].to_list()).reshape(-1, reach + 1), np.concatenate(b["before"].to_list()).reshape(-1, back)
        row = np.repeat(np.arange(len(b)), b["starts"].str.len().to_numpy() // (reach + 1))
        for k in range(0, len(w), EVENTS_AT_A_TIME):
            part = slice(k, k + EVENTS_AT_A_TIME)
            yield from patterns.walk(w[part], p[part], row[part], back, b["_e"].to_numpy(), grows_before)

    if _small(nodes):
        shared = projection.sparkSession.sparkContext.broadcast(Patterns(nodes.collect(), pairs))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield from walk(b, shared.value)

        return projection.mapInPandas(scan, schema)

    # patterns that are too many for every task go to the partitions of their first item
    parts = projection.select("_first", "_part").distinct()
    placed = nodes.join(parts, F.element_at("pat", 1) == F.col("_first")).select("_first", "_part", "id", "pat", "lead")

    def both(b: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        found = list(walk(b, Patterns(n.to_dict("records"), pairs))) if len(n) else []
        return pd.concat(found) if found else pd.DataFrame(columns=["kind", "id", "x", "entity", "n"])

    return projection.groupBy("_first", "_part").cogroup(placed.groupBy("_first", "_part")).applyInPandas(both, schema)


def _summed(counts: DataFrame, least: int) -> DataFrame:
    """kind, id, x, support (number of entities) and n of all that at least ``least`` entities have, and starts."""
    once = counts.groupBy("kind", "id", "x", "entity").agg(F.sum("n").alias("n"))
    return once.groupBy("kind", "id", "x").agg(F.count("*").alias("support"), F.sum("n").alias("n")).filter((F.col("kind") == STARTS) | (F.col("support") >= least))


def _implied(stats: DataFrame, nodes: DataFrame) -> DataFrame:
    """pat and the item e that stands in the gap before every start of it (the least such e), where e P can be grown in its place."""
    total = stats.filter(F.col("kind") == STARTS).select("id", F.col("n").alias("_total"))
    every = stats.filter(F.col("kind") == BEFORE).join(total, "id").filter("n = _total").select("id", F.col("x").alias("e"))
    both = every.join(nodes.filter("lead = 0").select("id", "pat"), "id")
    both = both.withColumn("_begin", F.concat(F.array("e"), F.expr("slice(pat, 1, size(pat) - 1)")))
    closed_off = both.select(F.col("pat").alias("_begin")).distinct()
    grown = nodes.select(F.col("pat").alias("_begin")).distinct()
    return both.join(closed_off, "_begin", "left_anti").join(grown, "_begin", "left_semi").groupBy("pat").agg(F.min("e").alias("e"))


def _closed(nodes: DataFrame, stats: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """The patterns without an extension of equal support."""
    wider = stats.filter(F.col("kind").isin(*kinds)).groupBy("id").agg(F.max("support").alias("_widest"))
    return nodes.join(wider, "id", "left").filter(F.coalesce(F.col("_widest") < F.col("support"), F.lit(True))).select("pat", "support")


def _numbered(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("id", F.xxhash64("pat"))


def closed_patterns(
    events: DataFrame,
    entity: str,
    order: str,
    item: str,
    share: float,
    max_between: int = 2,
    max_len: int = 5,
    block: int = 2048,
) -> DataFrame:
    """pat (array of items) and support (number of entities) of the closed patterns of up to max_len different items.

    A pattern occurs in an entity if its items stand in this order in the entity's sequence with at most ``max_between``
    other events between neighbours. It is kept if at least ``share`` of all entities of ``events`` have it. Items are
    non-negative integers. Events with a null item are left out of the sequences, though their entity counts; a null
    entity is no entity. Of rows that repeat (entity, order) the one with the largest item stands. An empty table gives
    no rows. Patterns of one item are included; a pattern that was found only behind an implied item is given with that
    item in front, and may then be one step longer and hold that item twice.
    """
    back = max_between + 1
    reach = back * max_len
    entity_type = dict(events.dtypes)[entity]
    entities = events.filter(F.col(entity).isNotNull()).select(entity).distinct().count()
    least = max(1, math.ceil(share * entities - 1e-9))
    blocks, sequences = _blocks(events, entity, order, item, least, reach, back, block)

    counts = cut(_summed(_first_counts(blocks, entity_type, reach, back), least), "counts")
    nodes = counts.filter(F.col("kind") == ITEM).select(F.array(F.col("id").cast("int")).alias("pat"), F.lit(0).alias("lead"), "support", "n", F.col("id").alias("_item"))
    nodes = cut(nodes.withColumn("id", F.xxhash64("pat")), "patterns")
    pairs = cut(counts.filter(F.col("kind") == AHEAD).select(F.col("id").cast("int").alias("a"), F.col("x").alias("b"), "support"), "pairs")
    # the counts of single items have the item for an id
    starts = nodes.select(F.lit(STARTS).alias("kind"), "id", F.lit(-1).alias("x"), "support", "n")
    stats = counts.filter(F.col("kind").isin(AHEAD, BEFORE)).withColumnRenamed("id", "_item").join(nodes.select("_item", "id"), "_item").select("kind", "id", "x", "support", "n").unionByName(starts)
    closed = [_closed(nodes, stats, (AHEAD, BEFORE) if max_len > 1 else ())]
    keepers = cut(_implied(stats, nodes), "implied") if max_len > 2 else None

    found = _children(pairs.select(F.array("a").alias("pat"), F.lit(0).alias("lead"), F.col("b").alias("x"), "support"), keepers)
    if keepers is not None:
        found = found.join(keepers.select(F.col("pat")[0].alias("_pruned")), F.col("pat")[0] == F.col("_pruned"), "left_anti")
    nodes = cut(_numbered(found), "patterns")
    few_pairs = pairs.count() <= BROADCAST_ROWS
    known_pairs = np.sort(np.array([(r["a"] << 32) + r["b"] for r in pairs.select("a", "b").collect()], np.int64)) if few_pairs else None
    projection = None
    if max_len > 1 and nodes.take(1):
        firsts = nodes.select(F.col("pat")[0].alias("_first")).distinct()
        firsts = cut(firsts.join(counts.filter(F.col("kind") == ITEM).select("id", "n"), F.col("_first") == F.col("id")).select("_first", "n"), "first-items")
        projection = cut(_project(blocks, firsts, entity_type, reach, back), "projections")
    size, any_lead = 2, keepers is not None and bool(keepers.take(1))
    while size <= max_len and nodes.take(1):
        # the longest patterns are grown only behind an implied item
        growing = nodes if size < max_len else nodes.filter("lead = 1")
        if size == max_len:
            closed.append(nodes.filter("lead = 0").select("pat", "support"))
            if not any_lead or not growing.take(1):
                break
        stats = cut(_summed(_grow(projection, growing, known_pairs, entity_type, reach, back, size < max_len), least), "counts")
        closed.append(_closed(growing, stats, (AHEAD, BEFORE)))
        keepers = cut(_implied(stats, growing), "implied") if size <= max_len - 2 else None
        if keepers is not None:
            any_lead = any_lead or bool(keepers.take(1))
            growing = growing.join(keepers.select("pat"), "pat", "left_anti")
        ahead = stats.filter(F.col("kind") == AHEAD).select("id", "x", F.col("support").alias("_s"))
        children = growing.join(ahead, "id").select("pat", "lead", "x", F.col("_s").alias("support"))
        nodes = cut(_numbered(_children(children, keepers)), "patterns")
        size += 1
    if size > max_len:  # behind an implied item, one step longer
        closed.append(nodes.select("pat", "support"))
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    out = cut(out, "closed-patterns")
    release(sequences, *([projection] if projection is not None else []))
    return out


def _children(extended: DataFrame, keepers: DataFrame | None) -> DataFrame:
    """pat with x at its end; e P takes over from a pruned P: it is marked as led, so its tail may hold e again."""
    out = extended.select(F.concat("pat", F.array("x")).alias("pat"), "lead", "support")
    if keepers is None:
        return out
    kept = keepers.select(F.concat(F.array("e"), "pat").alias("_kept"))
    return out.join(kept, F.col("pat") == F.col("_kept"), "left").withColumn("lead", F.when(F.col("_kept").isNotNull(), 1).otherwise(F.col("lead"))).drop("_kept")


def all_supports(closed: DataFrame, min_len: int = 1, max_len: int | None = None) -> DataFrame:
    """pat and support of all patterns that closed ones stand for: their contiguous parts of different items."""
    size = F.size("pat")
    starts = closed.withColumn("_a", F.explode(F.sequence(F.lit(1), size)))
    longest = size - F.col("_a") + 1
    starts = starts.withColumn("_n", longest if max_len is None else F.least(longest, F.lit(max_len))).filter(F.col("_n") >= min_len)
    parts = starts.withColumn("_l", F.explode(F.sequence(F.lit(min_len), F.col("_n")))).withColumn("part", F.expr("slice(pat, _a, _l)"))
    parts = parts.filter(F.size(F.array_distinct("part")) == F.size("part"))
    return parts.groupBy(F.col("part").alias("pat")).agg(F.max("support").alias("support"))


def as_text(pat: Column) -> Column:
    return F.concat_ws(">", F.transform(pat, lambda x: x.cast("string")))
