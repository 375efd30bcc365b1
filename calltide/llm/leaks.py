"""Problem 9: evaluation texts inside a corpus, found by spaced seeds.

A seed looks at a window of ``SPAN`` words through a mask that ignores some positions, so one or a few replaced words
don't hide a passage from all masks. Windows of the test items and of the corpus are hashed under every mask and joined
on the hash. Each hit names a diagonal (offset between document and item); the words along it are compared, which gives
the longest run of equal words and the longest overlap with few replacements.

Words are compared as 64-bit hashes, so the test items take a known number of bytes. Up to ``SEEDS_IN_MEMORY`` seeds their
sorted hashes are sent to every task, and texts are scanned, joined and verified where they are read: only results are
shuffled. With more seeds corpus windows are first held against a bitmap of the seeds, and the windows that may match
leave the scan, with the words around them, for a salted join by hash. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm.words import words
from calltide.runtime import cut

#: Words a seed spans; every run of at least so many equal words is hit by every mask.
SPAN = 13
#: The masks. The second and third each ignore positions, the first none.
MASKS = ("1111111111111", "1101100110101", "1010110011011")
#: An overlap never has more than so many unequal words within so many words.
MAX_REPLACED, WITHIN = 3, 2 * SPAN
#: Words kept on either side of a group of hits, to extend overlaps into, where groups leave the scan.
MARGIN = 40
#: Seeds that every task may hold: 20 bytes each, and at most 13 words of 8 bytes for every 3 of them.
SEEDS_IN_MEMORY = 2_000_000
#: Bits of the bitmap for every seed, and in all.
BITS_PER_SEED, MOST_BITS = 64, 1 << 30
SALTS = 32
#: Pairs of words, and pairs of a window and a seed, that are compared at a time.
CELLS = 1 << 22


class Hasher:
    """A 64-bit hash per word, equal in all processes; the hashes of words met before are remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, ws: list[str]) -> np.ndarray:
        if not ws:
            return np.zeros(0, np.uint64)
        if len(self.known) > 500_000:
            self.known.clear()
        if new := [w for w in set(ws) if w not in self.known]:
            self.known.update(zip(new, pd.util.hash_array(np.array(new, dtype=object), categorize=False).tolist()))
        return np.fromiter(map(self.known.__getitem__, ws), np.uint64, len(ws))


def seed_hashes(h: np.ndarray) -> np.ndarray:
    """masks x windows hashes of all windows of SPAN words; empty for fewer words."""
    n = max(0, len(h) - SPAN + 1)
    out = np.zeros((len(MASKS), n), np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for m, mask in enumerate(MASKS):
        acc = np.full(n, m + 1, np.uint64)
        for i, bit in enumerate(mask):
            if bit == "1":
                acc ^= h[i : i + n]
                acc *= factor
                acc ^= acc >> np.uint64(29)
        out[m] = acc
    return out


def item_texts(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id and words (hashed) of the items that have seeds; repeated rows once."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for b in batches:
            split = [(i, ws) for i, t in zip(b["_id"], b["_text"]) if len(ws := words(t)) >= SPAN]
            yield pd.DataFrame([(i, hasher.of(ws).view(np.int64)) for i, ws in split], columns=["item_id", "words"])

    rows = items.select(F.col(item_id).cast("bigint").alias("_id"), F.col(text).alias("_text")).filter("_id is not null and _text is not null")
    return rows.mapInPandas(scan, "item_id bigint, words array<bigint>").distinct()


class Items:
    """Seeds and words of all items: sorted seed hashes with the texts and places they come from."""

    def __init__(self, ids: list[int], texts: list[np.ndarray]):
        self.ids = np.array(ids, np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.words = np.concatenate(texts).astype(np.int64).view(np.uint64) if texts else np.zeros(0, np.uint64)
        s = seed_hashes(self.words)
        mask, at = np.nonzero(np.ones(s.shape, bool))
        text = np.searchsorted(self.starts, at, side="right") - 1
        whole = at + SPAN <= self.starts[text + 1] if len(at) else np.zeros(0, bool)
        h, text, at = s[mask, at][whole], text[whole], (at - self.starts[text])[whole]
        order = np.argsort(h, kind="stable")
        self.text, self.at = text[order].astype(np.int32), at[order].astype(np.int32)
        self.hash, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))

    def table(self) -> np.ndarray:
        """For the low bits of a hash, whether any seed has them; made once in a process."""
        if "_table" not in self.__dict__:
            bits = 1 << max(16, int(32 * len(self.hash)).bit_length())
            self._table = np.zeros(bits, bool)
            self._table[self.hash & np.uint64(bits - 1)] = True
        return self._table


def _parts(texts: list[tuple], most: int = 1 << 18) -> Iterator[list[tuple]]:
    """texts in parts of about ``most`` words; a longer text is a part of its own."""
    part, n = [], 0
    for t in texts:
        if part and n + len(t[1]) > most:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t[1])
    if part:
        yield part


def _slices(sizes: np.ndarray, most: int = CELLS) -> Iterator[slice]:
    """Slices of consecutive entries whose sizes add up to about ``most``."""
    upto = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right")))
        yield slice(a, z)
        a = z


def _seed_hits(h: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, place and text of the windows whose low bits are in the table; ``ends`` are those of the texts in h."""
    s = seed_hashes(h)
    mask, at = np.nonzero(table[s & np.uint64(len(table) - 1)])
    text = np.searchsorted(ends, at, side="right")
    whole = at + SPAN <= ends[text] if len(at) else np.zeros(0, bool)  # not across two texts
    mask, at, text = mask[whole], at[whole], text[whole]
    return s[mask, at], at, text


def overlaps(doc: np.ndarray, item: np.ndarray, doc_from: np.ndarray, doc_to: np.ndarray, item_from: np.ndarray, item_to: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """For each row, along its diagonal (document position - item position): n_run, n_overlap, n_equal.

    n_run is the longest run of equal words. n_overlap is the longest stretch that begins and ends with equal words and
    never has more than MAX_REPLACED unequal ones within WITHIN; n_equal is how many of its words are equal (of the
    longest ones, the most). A row's document is doc[doc_from:doc_to], its item item[item_from:item_to].
    """
    out = np.zeros((len(diagonal), 3), np.int64)
    a = np.maximum(0, diagonal)
    length = np.maximum(0, np.minimum(doc_to - doc_from, item_to - item_from + diagonal) - a)
    for part in _slices(length):
        n = length[part]
        own = np.flatnonzero(n)
        n, starts = n[own], np.concatenate([[0], np.cumsum(n[own])]).astype(np.int64)
        if not len(own):
            continue
        pos = np.arange(starts[-1])
        begin = np.repeat(starts[:-1], n)
        step = pos - begin
        same = doc[np.repeat((doc_from + a)[part][own], n) + step] == item[np.repeat((item_from + a - diagonal)[part][own], n) + step]
        miss = np.flatnonzero(~same)
        last_miss = np.full(len(pos), -1)
        last_miss[miss] = miss
        run = pos - np.maximum(np.maximum.accumulate(last_miss), begin - 1)
        # a miss too close to the MAX_REPLACED-th one before it: no stretch over it may begin before that one's end
        earliest = begin.copy()
        late, early = miss[MAX_REPLACED:], miss[:-MAX_REPLACED]
        close = (late - early < WITHIN) & (begin[late] == begin[early])
        earliest[late[close]] = early[close] + 1
        earliest = np.maximum.accumulate(earliest)
        next_hit = np.where(same, pos, len(pos))
        next_hit = np.minimum.accumulate(next_hit[::-1])[::-1]
        equal = np.concatenate([[0], np.cumsum(same)])
        first = next_hit[earliest]
        wide = np.where(same, (pos - first + 1) * (1 << 31) + equal[1:] - equal[np.minimum(first, len(pos))], 0)
        best = np.maximum.reduceat(wide, starts[:-1])
        rows = np.arange(part.start, part.stop)[own]
        out[rows, 0] = np.maximum.reduceat(np.where(same, run, 0), starts[:-1])
        out[rows, 1], out[rows, 2] = best >> 31, best & ((1 << 31) - 1)
    return out


_FOUND = "doc_id bigint, item_id bigint, n_run int, n_overlap int, n_equal int"


def _found(doc_ids: np.ndarray, item_ids: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """The best row of each document and item in one batch."""
    rows = pd.DataFrame({"doc_id": doc_ids, "item_id": item_ids, "n_run": counts[:, 0], "n_overlap": counts[:, 1], "n_equal": counts[:, 2]})
    runs = rows.groupby(["doc_id", "item_id"], sort=False)["n_run"].transform("max")
    return rows.assign(n_run=runs).sort_values(["n_overlap", "n_equal"], ascending=False, kind="stable").drop_duplicates(["doc_id", "item_id"])


def _scan_with_items(docs: DataFrame, items: Items) -> DataFrame:
    """Documents (_id, _text) joined with the items' seeds and verified where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, hasher = shared.value, Hasher()
        for b in batches:
            texts = [(i, ws) for i, t in zip(b["_id"], b["_text"]) if len(ws := words(t)) >= SPAN]
            for part in _parts(texts):
                h = hasher.of([w for _, ws in part for w in ws])
                ends = np.cumsum([len(ws) for _, ws in part])
                hashes, at, text = _seed_hits(h, ends, known.table())
                place = np.minimum(np.searchsorted(known.hash, hashes), max(0, len(known.hash) - 1))
                true = known.hash[place] == hashes if len(known.hash) else np.zeros(0, bool)
                place, at, text = place[true], at[true], text[true]
                starts, ids = ends - [len(ws) for _, ws in part], np.array([i for i, _ in part], np.int64)
                many = known.first[place + 1] - known.first[place]
                for s in _slices(many):
                    seed = np.repeat(known.first[place[s]], many[s]) + np.arange(many[s].sum()) - np.repeat(np.cumsum(many[s]) - many[s], many[s])
                    t = np.repeat(text[s], many[s])
                    rows = np.unique(np.stack([t, known.text[seed], np.repeat(at[s], many[s]) - starts[t] - known.at[seed]], 1), axis=0)
                    d, i, diagonal = rows.T
                    yield _found(ids[d], known.ids[i], overlaps(h, known.words, starts[d], ends[d], known.starts[i], known.starts[i + 1], diagonal))

    return docs.mapInPandas(scan, _FOUND)


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """Which low bits of a hash the seeds have. Comes to the driver in bitmaps of 4 KB, MOST_BITS bits at most."""
    at = F.pmod("hash", F.lit(bits)) + 1  # Spark's bitmaps count from 1
    parts = seeds.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    whole = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in parts.toLocalIterator():
        whole[(r["part"] - 1) * 4096 : r["part"] * 4096] |= np.frombuffer(r["bits"], np.uint8)
    return whole


def _corpus_hits(docs: DataFrame, bitmap: np.ndarray, bits: int) -> DataFrame:
    """Groups of windows that may match: doc_id, from_word, words around (hashed), and the hits as hashes and places."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, table = Hasher(), np.unpackbits(shared.value, bitorder="little").view(bool)[:bits]
        for b in batches:
            out = []
            texts = [(i, ws) for i, t in zip(b["_id"], b["_text"]) if len(ws := words(t)) >= SPAN]
            for part in _parts(texts):
                h = hasher.of([w for _, ws in part for w in ws])
                ends = np.cumsum([len(ws) for _, ws in part])
                hashes, at, text = _seed_hits(h, ends, table)
                order = np.argsort(at, kind="stable")
                hashes, at, text = hashes[order], at[order], text[order]
                apart = (np.diff(at) > SPAN + 2 * MARGIN) | (np.diff(text) > 0)
                for g in np.split(np.arange(len(at)), np.flatnonzero(apart) + 1) if len(at) else []:
                    i, ws = part[text[g[0]]]
                    start = int(ends[text[g[0]]]) - len(ws)
                    a, z = max(0, int(at[g[0]]) - start - MARGIN), min(len(ws), int(at[g[-1]]) - start + SPAN + MARGIN)
                    out.append((i, a, h[start + a : start + z].view(np.int64), hashes[g].view(np.int64), (at[g] - start).astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "from_word", "around", "hashes", "ats"])

    return docs.mapInPandas(scan, "doc_id bigint, from_word int, around array<bigint>, hashes array<bigint>, ats array<int>")


def _join_by_hash(docs: DataFrame, texts: DataFrame, n_seeds: int) -> DataFrame:
    """The same as ``_scan_with_items`` for any number of seeds."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, k, ws in zip(b["item_id"], b["text_key"], b["words"]):
                s = seed_hashes(np.asarray(ws, np.int64).view(np.uint64))
                for m in range(len(MASKS)):
                    yield pd.DataFrame({"hash": s[m].view(np.int64), "item_id": np.int64(i), "text_key": np.int64(k), "item_at": np.arange(s.shape[1], dtype=np.int32)})

    texts = cut(texts.withColumn("text_key", F.xxhash64("words")), "item-texts")
    seeds = cut(texts.mapInPandas(windows, "hash bigint, item_id bigint, text_key bigint, item_at int"), "item-seeds")
    bits = min(MOST_BITS, 1 << (BITS_PER_SEED * n_seeds).bit_length())
    found = cut(_corpus_hits(docs, _bitmap(seeds, bits), bits), "corpus-hits")
    hit = found.select("doc_id", "from_word", F.explode(F.arrays_zip("hashes", "ats")).alias("_h"))
    # a stock phrase may stand in a third of the documents: its seeds are copied to every salt
    hit = hit.select("doc_id", "from_word", F.col("_h.hashes").alias("hash"), F.col("_h.ats").alias("doc_at"), F.pmod(F.xxhash64("doc_id", "from_word"), F.lit(SALTS)).alias("_salt"))
    salted = seeds.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    pairs = hit.join(salted, ["hash", "_salt"]).select("doc_id", "from_word", "item_id", "text_key", (F.col("doc_at") - F.col("item_at")).alias("diagonal"))
    pairs = pairs.groupBy("doc_id", "from_word", "item_id", "text_key").agg(F.collect_set("diagonal").alias("diagonals"))
    joined = pairs.join(found.select("doc_id", "from_word", "around"), ["doc_id", "from_word"]).join(texts, ["item_id", "text_key"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            n = b["diagonals"].str.len().to_numpy()
            row = np.repeat(np.arange(len(b)), n)
            doc_ends, item_ends = np.cumsum(b["around"].str.len().to_numpy()), np.cumsum(b["words"].str.len().to_numpy())
            doc_from, item_from = np.concatenate([[0], doc_ends[:-1]]), np.concatenate([[0], item_ends[:-1]])
            diagonal = np.concatenate(b["diagonals"].to_list()).astype(np.int64) - b["from_word"].to_numpy(np.int64)[row]
            counts = overlaps(np.concatenate(b["around"].to_list()), np.concatenate(b["words"].to_list()), doc_from[row], doc_ends[row], item_from[row], item_ends[row], diagonal)
            yield _found(b["doc_id"].to_numpy()[row], b["item_id"].to_numpy()[row], counts)

    return joined.select("doc_id", "item_id", "from_word", "around", "words", "diagonals").mapInPandas(verify, _FOUND)


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", seeds_in_memory: int = SEEDS_IN_MEMORY
) -> DataFrame:
    """doc_id, item_id, n_run, n_overlap, n_equal for every document that shares a seed with an item.

    n_run is the longest run of equal consecutive words that document and item share along a shared seed's diagonal,
    n_overlap the longest overlap with up to 3 replaced words within 26, n_equal the number of equal words in it. Every
    common run of SPAN words or more is found; overlaps with replacements are found if one window of SPAN words has them
    at positions a mask ignores. Null ids and texts and texts under SPAN words give nothing; a text of any length is read
    whole; an id that stands in several rows gets its best row. Other columns are ignored, whatever their names. Empty
    tables give no rows. Where the items' seeds don't fit memory, words further than MARGIN from any seed extend nothing.
    """
    texts = cut(item_texts(items, item_id, item_text), "item-texts")
    n_seeds = len(MASKS) * (texts.agg(F.sum(F.size("words") - (SPAN - 1))).first()[0] or 0)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text")).filter("_id is not null and _text is not null")
    if n_seeds <= seeds_in_memory:
        got = texts.collect()  # as many words as the bound on seeds allows
        checked = _scan_with_items(rows, Items([r["item_id"] for r in got], [np.array(r["words"], np.int64) for r in got]))
    else:
        checked = _join_by_hash(rows, texts, n_seeds)
    best = F.max(F.struct("n_overlap", "n_equal"))
    return checked.groupBy("doc_id", "item_id").agg(F.max("n_run").alias("n_run"), best.alias("_b")).select("doc_id", "item_id", "n_run", "_b.n_overlap", "_b.n_equal")
