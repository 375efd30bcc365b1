"""Sketches, patterns, runs, packing, leaks and residue against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from calltide.llm import leaks, packing, patterns, residue, runs, sketch
from calltide.llm.words import words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_percentiles_keep_their_bound(spark):
    rnd = random.Random(1)
    special = [None, math.nan, math.inf, -math.inf, 0.0, 1e-300, -1e300, 5e-324]
    rows = [(rnd.choice(["hot"] * 8 + ["cold", None]), i % 3, rnd.choice([*special, *[rnd.gauss(0, 1) * 10 ** rnd.randrange(-6, 7) for _ in range(9)]]), 1, 2) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, day int, v double, n int, _place int")
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    parts = sketch.sketch(df.filter("day < 2"), ["g", "day"], {"v": F.col("v")}).unionByName(sketch.sketch(df.filter("day = 2"), ["g", "day"], {"v": F.col("v")}))
    out = sketch.percentiles(sketch.combine(parts, ["g"]), ["g"], probs)
    assert out.count() == 3
    for r in out.collect():
        mine = [x[2] for x in rows if x[0] == r.g]
        vs = sorted(v for v in mine if v is not None and not math.isnan(v))
        assert (r.n, r.n_null, r.n_nan) == (len(vs), sum(v is None for v in mine), sum(v is not None and math.isnan(v) for v in mine))
        for p in probs:
            want, got = vs[math.floor(p * (len(vs) - 1))], r[f"p{p * 100:g}"]
            if abs(want) == math.inf or abs(want) > 3e38 or abs(want) < 1e-37:  # beyond 32 bits
                continue
            assert abs(got - want) <= r.rel_error * abs(want)
    assert sketch.percentiles(sketch.sketch(df.limit(0), ["g"], {"v": F.col("v")}), ["g"], probs).count() == 0
    nothing = sketch.percentiles(sketch.sketch(df.filter("v is null"), ["g"], {"v": F.col("v")}), ["g"], [0.5]).collect()
    assert all(r.n == 0 and r.p50 is None for r in nothing)


def test_percentiles_beyond_32_bits(spark):
    values = [-1.7976931348623157e308, -1e300, -3.5e38, -1e-300, 5e-324, 1e-45, 1e-38, 2e39, 1e300, 1.7976931348623157e308]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [i / 9 for i in range(10)]
    r = sketch.percentiles(sketch.sketch(df, [], {"v": F.col("v")}), [], probs).select("rel_error", *[f"`p{p * 100:g}`".replace(".", "_") for p in probs]).first()
    for want, got in zip(sorted(values), r[1:]):
        assert math.isfinite(got) and abs(got - want) <= r.rel_error * abs(want), (want, got)


def mined(rows, share, between, max_len):
    """Support of every list of different items, by walking every occurrence."""
    seqs = defaultdict(list)
    ents = set()
    for e, o, i in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        ents.add(e)
        if i is not None:
            seqs[e].append(i)
    support = Counter()
    for s in seqs.values():
        found = set()

        def grow(at, pat, s=s, found=found):
            found.add(pat)
            if len(pat) < max_len:
                for j in range(at + 1, min(len(s), at + between + 2)):
                    if s[j] not in pat:
                        grow(j, (*pat, s[j]))

        for a, x in enumerate(s):
            grow(a, (x,))
        support.update(found)
    least = max(1, math.ceil(share * len(ents) - 1e-9))
    return {p: n for p, n in support.items() if n >= least}


@pytest.mark.parametrize(("seed", "fixed"), [(1, False), (2, True)])
def test_patterns_like_brute_force(spark, seed, fixed):
    rnd = random.Random(seed)
    rows = []
    for e in [*range(12), None]:
        s, o = [], 0
        while len(s) < 30:
            # with ``fixed``, 1 always stands before 2, and 2 before 3: backscan pruning has work
            s += rnd.choice([[1, 2, 3], [1, 2, 5], [1, 2], [4], [6], [rnd.randrange(4, 9)], [None]]) if fixed else [rnd.choice([1, 2, 3, 4, 5, 6, None])]
        for i in s:
            o += rnd.randrange(1, 40)
            rows.append((e, o, i, 7, 8))
    df = spark.createDataFrame(rows, "e int, o bigint, item int, support int, w int")
    closed = patterns.closed_patterns(df, "e", "o", "item", 0.5, 2, 4, block=16)
    want = mined([r[:3] for r in rows], 0.5, 2, 4)
    got = {tuple(r["pat"]): r.support for r in patterns.all_supports(closed, 1, 4).collect()}
    assert got == want
    have = {tuple(r["pat"]): r.support for r in closed.collect()}
    assert len(have) < len(want)  # some patterns are only parts of others
    # no closed pattern has an extension of equal support
    for p, n in have.items():
        if len(p) < 4 and len(set(p)) == len(p):
            assert not any(n == m and len(q) == len(p) + 1 and p in (q[1:], q[:-1]) for q, m in want.items())
    if fixed:
        assert (2,) not in have  # 1 is implied


def test_patterns_of_nothing(spark):
    df = spark.createDataFrame([], "e int, o bigint, item int")
    assert patterns.closed_patterns(df, "e", "o", "item", 0.3).count() == 0


def test_runs_like_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for k in (1, 2, None):
        t = 0
        for o in sorted(rnd.sample(range(900), 300)):
            t += rnd.randrange(12)
            end = rnd.choice([None, t + rnd.randrange(-2, 8)])
            rows.append((k, o, rnd.choice(["a"] * 5 + ["b", None]), rnd.choice([t, t, t, None]), end, 1))
            t = max(t, end or 0)
    rows += [(9, o, "long", o, o + 1, 1) for o in range(700)]
    df = spark.createDataFrame(rows, "k int, o bigint, f string, a bigint, z bigint, _pos int")
    out = runs.collapse_runs(df, ["k"], "o", F.col("f"), F.col("a"), F.col("z"), 5, block=64)
    got = {(r.k, r.first_order): (r.last_order, r.n, r.event, r.first_start, r.last_end) for r in out.collect()}
    want = {}
    for k in (1, 2, None, 9):
        prev = None
        for _, o, f, a, z, _ in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            until = None if prev is None else (prev[4] if prev[4] is not None else prev[3])
            if prev is not None and f is not None and f == prev[2] and a is not None and until is not None and a - until <= 5:
                cur[-1].append((o, a, z))  # noqa: F821
            else:
                cur = [f, [(o, a, z)]]
                want[k, o] = cur
            prev = (k, o, f, a, z)
    flat = {
        key: (v[1][-1][0], len(v[1]), v[0], min((x[1] for x in v[1] if x[1] is not None), default=None), max((x[2] for x in v[1] if x[2] is not None), default=None))
        for key, v in want.items()
    }
    assert got == flat and got[9, 0][1] == 700
    assert runs.collapse_runs(df.limit(0), ["k"], "o", F.col("f"), F.col("a"), F.col("z")).count() == 0


def test_function_spellings(spark):
    listed = spark.createDataFrame([(1, "read"), (2, "pread64"), (3, "pread"), (4, "MPI_Wait"), (5, "odd64")], "func_id smallint, name string")
    rows = [(1, "x"), (None, " READ "), (2, None), (None, "pread"), (None, "P MPI_wait"), (5, None), (77, "User"), (None, None)]
    out = runs.decoded_function(listed, spark.createDataFrame(rows, "func_id smallint, func string"))
    assert Counter(r._function for r in out.collect()) == Counter(["read", "read", "pread", "pread", "mpi_wait", "odd64", "user", None])


def test_fullest_is_optimal():
    rnd = random.Random(6)
    for _ in range(200):
        sizes = [rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 9))]
        room = rnd.randrange(1, 60)
        count = Counter(sizes)
        lengths = np.array(sorted((s for s in count if s <= room), reverse=True), int)
        taken = packing.fullest(lengths, np.array([count[s] for s in lengths], int), room)
        sums = {0}
        for s in sizes:
            sums |= {x + s for x in sums if x + s <= room}
        assert sum(a * b for a, b in taken) == max(sums)
        used = Counter()
        for a, b in taken:
            used[a] += b
        assert all(used[s] <= count[s] for s in used)


@pytest.mark.parametrize("group", [8192, 40])
def test_packing(spark, group):
    rnd = random.Random(8)
    rows = [(rnd.choice([i, i, i, None, 5]), rnd.choice([0, None, rnd.randrange(1, 100), rnd.randrange(1, 100), 64, 128, 500]), "x", "y") for i in range(400)]
    items = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, container_id string, piece string")
    kinds = spark.createDataFrame([("s", 64), ("l", 200), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    out = packing.pack_items(items, kinds, group_items=group).collect()
    for kind, cap in (("s", 64), ("l", 200)):
        mine = [r for r in out if r.container_kind == kind]
        fill = defaultdict(int)
        for r in mine:
            assert 0 <= r.n == r.piece_end - r.piece_start <= cap
            if r.container_id is not None:
                fill[r.container_id] += r.n
            else:
                assert r.n == 0
        total = sum(r[1] or 0 for r in rows)
        assert sum(r.n for r in mine) == total and sum(r.piece == 0 for r in mine) == len(rows)
        packed = {c: f for c, f in fill.items() if "-full-" not in c}
        assert all(f <= cap for f in packed.values())
        assert sum(r.piece > 0 for r in mine) == sum(max(0, -(-(r[1] or 0) // cap) - 1) for r in rows)
        assert len(packed) <= 1.15 * -(-sum(packed.values()) // cap) + 2
    assert {r.container_kind for r in out} == {"s", "l"}
    assert packing.pack_items(items.limit(0), kinds).count() == 0 and packing.pack_items(items, kinds.limit(0)).count() == 0


def test_packing_of_items_that_fill_no_container(spark):
    items = spark.createDataFrame([(i, 60) for i in range(400)] + [(1000 + i, 25) for i in range(400)], "doc_id int, n_tokens int")
    kinds = spark.createDataFrame([("half", 70), ("whole", 100)], "container_kind string, capacity_tokens int")
    out = packing.pack_items(items, kinds, group_items=40).collect()
    assert Counter((r.container_kind, r.doc_id) for r in out) == Counter((k, i) for k in ("half", "whole") for i in [*range(400), *range(1000, 1400)])
    fill = Counter()
    for r in out:
        fill[r.container_kind, r.container_id] += r.n
    assert all(n <= {"half": 70, "whole": 100}[k] for (k, _), n in fill.items())
    groups = Counter((r.container_kind, r.container_id.split("-")[1]) for r in out)
    assert max(groups.values()) <= 3 * 40


def test_token_counts(spark):
    texts = [None, "", "hello world", "a" * 200_000, "ünï\x00 " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    enc = packing.encoding(VOCABULARY)
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(df, "doc_id", "text", VOCABULARY).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_words():
    assert words("Ab­c １２ ﬁne​st K-x İ") == ["abc", "12", "finest", "k", "x", "i"] and words(None) == words("") == []


def test_leaks_like_brute_force(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(30))) for i in range(6)] + [(6, "too short"), (7, None), (None, "x " * 20)]
    items += [(8, items[0][1]), (0, items[0][1])]
    docs = []
    for d in range(60):
        ws = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 80))]
        if rnd.random() < 0.7:
            src = words(rnd.choice(items[:6])[1])
            a, n = rnd.randrange(10), rnd.randrange(8, 21)
            part = src[a : a + n]
            if rnd.random() < 0.4:
                part[len(part) // 2] = "swapped"
            k = rnd.randrange(len(ws) + 1)
            ws[k:k] = part
        docs.append((d, rnd.choice([" ", "\n", " ​", ", "]).join(ws).upper()))
    docs += [(100, None), (101, ""), (102, "z" * 50_000), (None, items[0][1]), (103, ("pad " * 3000) + items[2][1] + (" pad" * 3000)), (0, items[3][1])]
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1)).withColumn("words", F.lit(1))
    tests = spark.createDataFrame(items, "item_id bigint, item_text string").withColumn("hash", F.lit(1))
    out = leaks.leaks(corpus, tests).collect()
    got = {(r.doc_id, r.item_id): r.n_run for r in out}
    want = defaultdict(int)
    for d, t in docs:
        for i, x in items:
            a, b = words(t), words(x)
            for p in range(len(a)):
                for q in range(len(b)):
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                        n += 1
                    if d is not None and i is not None and n >= 13:
                        want[d, i] = max(want[d, i], n)
    assert {k: n for k, n in got.items() if n >= 13} == want
    assert want[103, 2] == 30 and (0, 3) in want
    # the way for more seeds than memory takes gives the same rows
    assert set(out) == set(leaks.leaks(corpus, tests, seeds_in_memory=0).collect())
    for most in (leaks.SEEDS_IN_MEMORY, 0):
        assert leaks.leaks(corpus.limit(0), tests, seeds_in_memory=most).count() == 0
        assert leaks.leaks(corpus, tests.limit(0), seeds_in_memory=most).count() == 0


def overlap(doc, item, diagonal):
    """(longest run, longest overlap, most equal words of such an overlap) along one diagonal, word by word."""
    a, z = max(0, diagonal), min(len(doc), len(item) + diagonal)
    same = [doc[k] == item[k - diagonal] for k in range(a, z)]
    run = best = 0
    for s in same:
        run = run + 1 if s else 0
        best = max(best, run)
    wide = (0, 0)
    for k in range(len(same)):
        for x in range(k + 1):
            misses = [j for j in range(x, k + 1) if not same[j]]
            if same[x] and same[k] and all(misses[j + 3] - misses[j] >= 26 for j in range(len(misses) - 3)):
                wide = max(wide, (k - x + 1, sum(same[x : k + 1])))
    return best, *wide


def test_overlaps_like_word_by_word():
    rnd = random.Random(12)
    h = lambda ws: leaks.Hasher().of([str(w) for w in ws])
    docs, items, rows, want = [], [], [], []
    for _ in range(60):
        item = [rnd.randrange(1000) for _ in range(rnd.randrange(1, 60))]
        doc = [rnd.randrange(1000) for _ in range(rnd.randrange(9))] + [w if rnd.random() < rnd.choice([0.7, 0.95]) else -1 for w in item] + [rnd.randrange(1000) for _ in range(rnd.randrange(9))]
        for diagonal in (rnd.randrange(-len(item), len(doc) + 3), doc.index(item[0]) if item[0] in doc else 0):
            rows.append((sum(map(len, docs)), sum(map(len, docs)) + len(doc), sum(map(len, items)), sum(map(len, items)) + len(item), diagonal))
            want.append(overlap(doc, item, diagonal))
        docs.append(doc)
        items.append(item)
    got = leaks.overlaps(h([w for d in docs for w in d]), h([w for i in items for w in i]), *np.array(rows, np.int64).T)
    assert [tuple(g) for g in got.tolist()] == want
    a = [f"a{i}" for i in range(30)]
    b = list(a)
    b[10], b[17] = "x", "y"
    assert overlap(a, b, 0) == (12, 30, 28)


def test_replaced_words_hide_few_passages(spark):
    """Passages of 40 words with one, two or three words replaced, in texts of other words."""
    rnd = random.Random(13)
    vocab = [f"w{i}" for i in range(20_000)]
    items = [(i, [rnd.choice(vocab) for _ in range(40)]) for i in range(100)]
    docs = []
    for i, ws in items:
        for n in (1, 2, 3):
            part = list(ws)
            for k in rnd.sample(range(40), n):
                part[k] = "replaced"
            docs.append((i * 10 + n, " ".join([rnd.choice(vocab) for _ in range(30)] + part + [rnd.choice(vocab) for _ in range(30)])))
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id bigint, item_text string"))
    hit = Counter(r.doc_id % 10 for r in found.collect() if r.doc_id // 10 == r.item_id)
    assert hit[1] == 100 and hit[2] >= 99 and hit[3] >= 95, hit


RESIDUE = ["Lorem ipsum dolor sit amet vitae.", "Dear {{ user_name }}, your order is ready.", "404 Not Found", "Please enable JavaScript to view this page.", "Your text goes here.", "Hello [INSERT NAME HERE], thank you.", "Internal server error. Reference: ab12cd34"]
CONTENT = [
    "The reader waits for the second block of the file before it goes on.", "We counted many small writes on the shared mount last week.", 'The server said "404 Not Found" for a few of the requests, which is retried.',
    "To print it, use `{{ user_name }}` in the template and run it again.", "    export OUT=${SCRATCH}/run\nThe path is then used by the launcher.", "INFO  reader: rank 3 done\nNothing else happened on the other ranks today.",
]


def test_residue_is_told_from_talk_about_it(spark):
    rnd = random.Random(4)
    docs, bad = [], set()
    for d in range(400):
        parts = [rnd.choice(CONTENT) for _ in range(rnd.randrange(1, 5))]
        if d % 8 == 0:
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(RESIDUE))
            bad.add(d)
        docs.append((d, "\n\n".join(parts)))
    docs += [(1000, None), (1001, ""), (1002, "x" * 100_000), (1003, "\n\n".join(CONTENT * 400) + "\n\n" + RESIDUE[2]), (None, RESIDUE[0])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("passage", F.lit(0)).withColumn("score", F.lit(1.0))
    out = residue.residue(df)
    got = {r.doc_id for r in out.filter(F.col("score") >= residue.THRESHOLD).collect()}
    assert got == bad | {1003, None}
    assert {1000, 1001} & {r.doc_id for r in out.collect()} == set()


def test_residue_of_phrases_that_were_not_trusted(spark):
    """A fifth of the trusted beginnings is hidden: most documents are found all the same, and training settles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    full = {r.doc_id for r in residue.residue(docs).filter(F.col("score") >= residue.THRESHOLD).collect()}
    kept = tuple(b for i, b in enumerate(residue.TRUSTED_BEGINNINGS) if i % 5)
    out = residue.residue(docs, beginnings=kept)
    less = {r.doc_id for r in out.filter(F.col("score") >= residue.THRESHOLD).collect()}
    assert len(less & full) >= 0.9 * len(full) and len(less - full) <= 0.05 * len(full)
    assert 0 < out.first().rounds < residue.MOST_ROUNDS


def test_residue_without_any(spark):
    df = spark.createDataFrame([(1, "Some plain text about blocks."), (1, "More of it.")], "doc_id bigint, text string")
    assert [r.n_residue for r in residue.residue(df).collect()] == [0]
    assert residue.residue(df.limit(0)).count() == 0
