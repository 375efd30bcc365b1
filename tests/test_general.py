"""Interval merging, feature table, per-key results and compaction."""

import math
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from calltide.functions.values import duration
from calltide.operators.calls import distinct_rows, export_preference
from calltide.operators import intervals
from calltide.operators.features import entity_features, entity_type_rows
from calltide.operators.intervals import gaps, merged_ranges, stretches
from calltide.operators.skew import heavy_keys, key_results
from calltide.streaming.compact import compact, finish, stage

RANGE = "filename string, rank int, offset bigint, count bigint, tstart double, _block string, stretch int"


def covered(rows):
    """(gaps, stretches) of each group by walking sorted ranges."""
    groups = defaultdict(list)
    for f, r, o, c, t, *_ in rows:
        if o is not None and c is not None and c > 0:
            groups[f, r].append((o, o + c, t))
    g, s = set(), set()
    for key, v in groups.items():
        v.sort(key=lambda x: x[:2])
        start, end, times, n = v[0][0], v[0][1], [v[0][2]], 1
        for a, z, t in v[1:]:
            if a > end:
                g.add((*key, end, a))
                known = [x for x in times if x is not None]
                s.add((*key, start, end, min(known, default=None), max(known, default=None), n))
                start, end, times, n = a, z, [t], 1
            else:
                end, n = max(end, z), n + 1
                times.append(t)
        known = [x for x in times if x is not None]
        s.add((*key, start, end, min(known, default=None), max(known, default=None), n))
    return g, s


def random_ranges(seed, n=600):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        f = rnd.choice(["a", "a", "a", "b", None])
        rows.append((f, rnd.choice([1, 1, 2, None]), rnd.choice([None, rnd.randrange(4000), rnd.randrange(10**12), 7]), rnd.choice([None, 0, -3, 1, 5, 40, 3000]), rnd.choice([None, rnd.random()]), "x", 1))
    return rows + rows[:20]


@pytest.mark.parametrize(("block", "per_round", "broadcast"), [(1_000_000, 1024, True), (20, 1024, True), (30, 4, True), (40, 8, False)])
def test_ranges_like_brute_force(spark, monkeypatch, block, per_round, broadcast):
    monkeypatch.setattr(intervals, "BLOCKS_PER_ROUND", per_round)
    if not broadcast:
        monkeypatch.setattr(intervals, "BROADCAST_ROWS", 0)
    rows = random_ranges(3)
    df = spark.createDataFrame(rows, RANGE)
    merged = merged_ranges(df, rows_per_block=block)
    if block < 100:  # blocks follow the size of the group, and repeats of one offset aren't cut
        rows_in = df.filter("`offset` is not null and `count` > 0").select("filename", "rank", F.col("offset").alias("_from"))
        sizes = intervals._blocked(rows_in, ["filename", "rank"], block).groupBy("filename", "rank", "_block").agg(F.count_distinct("_from").alias("n")).collect()
        assert max(r.n for r in sizes) <= 2 * block and len(sizes) > 5
    want_gaps, want = covered(rows)
    assert {tuple(r) for r in gaps(merged).collect()} == want_gaps
    got = {(r.filename, r.rank, r.stretch_start, r.stretch_end, r.first_tstart, r.last_tstart, r.n_ranges) for r in stretches(merged).collect()}
    assert got == want


def test_ranges_touching_nested_far(spark):
    rows = [("f", 0, 0, 10, 1.0, "", 0), ("f", 0, 10, 5, 2.0, "", 0), ("f", 0, 2, 3, 3.0, "", 0), ("f", 0, 2**62, 2**62 + 5, 4.0, "", 0), ("f", 0, 100, 1, float("nan"), "", 0)]
    merged = merged_ranges(spark.createDataFrame(rows, RANGE))
    assert {tuple(r)[2:] for r in gaps(merged).collect()} == {(15, 100), (101, 2**62)}


def test_ranges_empty(spark):
    merged = merged_ranges(spark.createDataFrame([], RANGE))
    assert gaps(merged).count() == 0 and stretches(merged).count() == 0


CALLS = "rank int, index int, func string, a double, b double, n int, _salt int"


def test_features(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([0, 0, 0, 1, None]), i, rnd.choice(["r", "r", "w", None, "x"]), rnd.choice([None, rnd.random() * 9]), rnd.choice([None, math.nan, 0.0, 20.0]), 5, 1) for i in range(500)]
    df = spark.createDataFrame(rows, CALLS)
    out = entity_features(df, "rank", F.col("func"), F.col("a"), F.col("b"), ["index"], ["never"], salts=4)
    assert out.columns[0] == "rank" and {"never_n", "r_n", "unknown_since_us", "w_total_us", "x_n"} <= set(out.columns)
    got = {r["rank"]: r.asDict() for r in out.collect()}
    us = lambda x: math.floor(x * 1e6 + 0.5)
    now = max(us(r[3]) for r in rows if r[3] is not None)
    for rank in (0, 1, None):
        for t in ("r", "w", "x", "unknown"):
            mine = [r for r in rows if r[0] == rank and (r[2] or "unknown") == t]
            starts = [us(r[3]) for r in mine if r[3] is not None]
            total = sum(us(r[4] - r[3]) for r in mine if None not in r[3:5] and not math.isnan(r[4]) and r[4] >= r[3])
            assert (got[rank][f"{t}_n"], got[rank][f"{t}_total_us"]) == (len(mine), total)
            assert got[rank][f"{t}_since_us"] == (now - max(starts) if starts else None)
        assert got[rank]["never_n"] == 0 and got[rank]["never_since_us"] is None
    long = entity_type_rows(df, "rank", F.col("func"), F.col("a"), F.col("b"), ["index"], ["never"], salts=4).collect()
    assert {(r["rank"], r["type"]) for r in long} == {(k, t) for k in (0, 1, None) for t in ("r", "w", "x", "unknown", "never")} and len(long) == 15
    for r in long:
        assert (r.n, r.since_us, r.total_us) == tuple(got[r["rank"]][f"{r['type']}_{c}"] for c in ("n", "since_us", "total_us"))
    assert entity_type_rows(df.limit(0), "rank", F.col("func"), F.col("a"), F.col("b"), ["index"], ["t"]).count() == 0
    assert entity_features(df.limit(0), "rank", F.col("func"), F.col("a"), F.col("b"), ["index"], ["t"]).count() == 0


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_key_results_exact(spark, monkeypatch, broadcast):
    import calltide.operators.skew as skew

    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast)
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        v = rnd.choice([0.25, rnd.random(), -rnd.random() * 1e-9, rnd.expovariate(1) * 1e6, None])
        rows.append((rnd.choice([7] * 6 + [8, None]), rnd.choice(["hot"] * 9 + ["cold", None]), v, i, "c", 3))
    df = spark.createDataFrame(rows, "rank int, func string, v double, t bigint, key_field string, q int")
    out = key_results(df, ["rank", "func"], F.col("v"), F.col("t"), [0.0, 0.5, 0.9, 1.0])
    got = {(r.key_field, r.key_value): r for r in out.collect()}
    for field, k in (("rank", 0), ("func", 1)):
        for value in {r[k] for r in rows}:
            mine = [r for r in rows if r[k] == value]
            vs = sorted(r[2] for r in mine if r[2] is not None)
            r = got[field, None if value is None else str(value)]
            assert (r.n_rows, r.n_valued, r.last_us) == (len(mine), len(vs), max(x[3] for x in mine))
            assert [r.p0, r.p50, r.p90, r.p100] == [vs[math.floor(p * (len(vs) - 1))] for p in (0.0, 0.5, 0.9, 1.0)]
    heavy = {(r.key_field, r.key_value) for r in heavy_keys(out, 0.5).collect()}
    assert heavy == {("rank", "7"), ("func", "hot")}
    assert key_results(df.limit(0), ["rank"], F.col("v"), F.col("t")).count() == 0


def test_rows_per_key_are_not_broadcast(spark, monkeypatch):
    import calltide.operators.skew as skew

    plans, cut = [], skew.cut
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "cut", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, name))
    df = spark.createDataFrame([(i % 7, i / 3) for i in range(400)], "rank int, v double")
    assert key_results(df, ["rank"], F.col("v"), F.lit(None).cast("bigint")).count() == 7
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_heavy_keys_without_values(spark):
    df = spark.createDataFrame([(1, None)] * 5 + [(None, None)] * 95, "rank int, v double")
    out = key_results(df, ["rank"], F.col("v"), F.lit(None).cast("bigint"))
    assert [tuple(r) for r in heavy_keys(out, 0.05).select("key_field", "key_value").collect()] == [("rank", "1")]


def test_duration_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, math.nan), (2.0, 1.0), (None, 1.0), (1.0, math.inf), (1.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(duration(F.col("a"), F.col("b"))).collect()] == [1.0, None, None, None, None, 0.0]


def small_files(spark, path, lists):
    for k, rows in enumerate(lists):
        spark.createDataFrame(rows, "rank int, index int, v string").coalesce(1).write.mode("append").parquet(path)


def test_compaction(spark, tmp_path):
    source = f"{tmp_path}/in"
    lists = [[(r, i, f"{r}-{i}") for i in range(3)] for r in range(6)] + [[(0, 0, "0-0"), (1, 1, "other"), (None, 5, None), (None, 5, None)]]
    small_files(spark, source, lists)
    out = compact(spark, source, ["rank", "index"], [F.col("v").isNull()], files_per_batch=2)
    got = {(r["rank"], r["index"]): (r.v, r._copies) for r in out.collect()}
    assert out.count() == len(got) == 19
    assert got[0, 0] == ("0-0", 2) and got[1, 1][1] == 2 and got[1, 1][0] in ("1-1", "other") and got[None, 5] == (None, 2) and got[5, 2] == ("5-2", 1)
    assert len(out.inputFiles()) == 1


def test_compaction_retry_and_new_files(spark, tmp_path):
    source, staged, mark = f"{tmp_path}/in", f"{tmp_path}/staged", f"{tmp_path}/mark"
    small_files(spark, source, [[(1, i, "a")] for i in range(4)])
    schema = spark.read.parquet(source).schema
    assert stage(spark, source, staged, mark, 2) == 2
    # the last batch was written, but its commit was lost: it runs again under its number
    for f in (tmp_path / "mark" / "commits").glob("*1*"):
        f.unlink()
    stage(spark, source, staged, mark, 2)
    small_files(spark, source, [[(2, 0, "b")]])
    assert stage(spark, source, staged, mark, 2) == 3
    for _ in range(2):
        finish(spark, staged, f"{tmp_path}/out", ["rank", "index"], [], schema)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 5 and out.filter("_copies > 1").count() == 0


def test_compaction_takes_late_files_with_old_times(spark, tmp_path):
    source, staged, mark = f"{tmp_path}/in", f"{tmp_path}/staged", f"{tmp_path}/mark"
    small_files(spark, source, [[(1, 0, "a")]])
    assert stage(spark, source, staged, mark) == 1
    before = set((tmp_path / "in").glob("*.parquet"))
    small_files(spark, source, [[(2, 0, "b")]])
    (late,) = set((tmp_path / "in").glob("*.parquet")) - before
    os.utime(late, (10**9, 10**9))
    assert stage(spark, source, staged, mark) == 2
    assert {r["rank"] for r in spark.read.parquet(f"{staged}/batch=*").collect()} == {1, 2}


def test_compaction_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "rank int, index int, v string").write.parquet(f"{tmp_path}/in")
    assert compact(spark, f"{tmp_path}/in", ["rank"], []).count() == 0
    spark.createDataFrame([], "rank int, _copies int").write.parquet(f"{tmp_path}/bad")
    with pytest.raises(ValueError):
        compact(spark, f"{tmp_path}/bad", ["rank"], [])


def test_distinct_rows_keeps_clashing_column(spark):
    rows = [(1, 1, "f", 1.0, 2.0, None, "x", 9), (1, 1, None, 1.0, None, None, "x", 9)]
    df = spark.createDataFrame(rows, "rank int, index int, func_id string, tstart double, tend double, arrived_at timestamp, file_name string, _nth int")
    out = distinct_rows(df, ["rank", "index"], export_preference()).collect()
    assert len(out) == 1 and out[0].func_id == "f" and out[0]._nth == 9
