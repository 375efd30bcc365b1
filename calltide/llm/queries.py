"""Queries of the problems 1, 2, 4, 8, 9 and 10 over the trace tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.functions.names import plain_name, plain_name_sql
from calltide.llm import leaks, packing, patterns, residue, runs, sketch
from calltide.operators.calls import distinct_rows
from calltide.operators.skew import key_results
from calltide.runtime import cut

PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
ERROR = 0.01
MAX_PAUSE_TICKS = 5_000_000
VOCABULARY = os.environ.get("CALLTIDE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Unused space that a packing may leave in all, unless no packing needs fewer containers.
MOST_SLACK = 0.02
PATTERN_SHARE, PATTERN_BETWEEN, PATTERN_SHORTEST, PATTERN_LONGEST = 0.3, 2, 3, 5


def _measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """Exported calls with func and day, and what is measured of them."""
    rows = spark.read.parquet(f"{sf_dir}/export_records.parquet").select("func_id", "arrived_at", "tstart", "tend")
    rows = rows.withColumn("day", F.to_date("arrived_at")).withColumn("func", plain_name(F.col("func_id")))
    a, b = F.col("tstart").cast("double"), F.col("tend").cast("double")
    return rows, {"tstart": a, "tend": b, "duration": b - a}


def p1_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of each function and day of arrival: bucket counts of tstart, tend and tend - tstart, over the rows as stored.

    Counts of other days, files or runs are added to these by ``sketch.combine``; percentiles come from either.
    """
    rows, values = _measured(spark, sf_dir)
    return sketch.sketch(rows, ["func", "day"], values, sketch.Accuracy(ERROR))


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of tstart, tend and tend - tstart per function and day, from the sketches."""
    return sketch.percentiles(cut(p1_sketches(spark, sf_dir), "sketch"), ["func", "day"], PROBS, sketch.Accuracy(ERROR))


def p1_percentiles_all_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per function, from the combined sketches of the days."""
    both = cut(sketch.combine(cut(p1_sketches(spark, sf_dir), "sketch"), ["func"]), "sketch")
    return sketch.percentiles(both, ["func"], PROBS, sketch.Accuracy(ERROR))


def p1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each percentile over all days with its exact value, and whether the estimate keeps the stated relative error.

    Exact values come from refined histograms (``skew.key_results``), which gather no function's rows either.
    """
    rows, values = _measured(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("x")) for m, v in values.items()]))
    x = F.col("_m.x")
    long = rows.select("func", each.alias("_m")).select(F.to_json(F.struct("func", "_m.metric")).alias("key"), F.when(~F.isnan(x), x).alias("x"))
    exact = key_results(long, ["key"], F.col("x"), F.lit(None).cast("bigint"), PROBS)
    key = F.from_json("key_value", "func string, metric string")
    names = [f"p{p * 100:g}" for p in PROBS]
    pairs = lambda cols: F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(c).alias("v")) for p, c in zip(PROBS, cols)]))
    exact = exact.select(key.alias("k"), pairs(names).alias("e")).select("k.func", "k.metric", "e.p", F.col("e.v").alias("exact"))
    estimated = p1_percentiles_all_days(spark, sf_dir).select("func", "metric", "rel_error", pairs(names).alias("e")).select("func", "metric", "rel_error", "e.p", F.col("e.v").alias("estimate"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("func", "metric", "p")]
    close = F.abs(F.col("b.estimate") - F.col("a.exact")) <= F.col("b.rel_error") * F.abs(F.col("a.exact"))
    kept = F.when(F.col("a.exact").isNull(), F.col("b.estimate").isNull()).otherwise(close)
    return exact.alias("a").join(estimated.alias("b"), on).select("a.func", "a.metric", "a.p", "a.exact", kept.alias("kept"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded calls, each (rank, seq_id) once: the row with the most of its fields."""
    rows = spark.read.parquet(f"{sf_dir}/records.parquet").select("rank", "seq_id", "tid", "terminal_id", "func_id", "func", "tick_start", "tick_end")
    known = sum((F.col(c).isNotNull().cast("int") for c in ("tid", "terminal_id", "func_id", "func", "tick_start", "tick_end")), F.lit(0))
    return distinct_rows(rows, ["rank", "seq_id"], [known.desc(), "tid", "terminal_id", "func_id", "func", "tick_start", "tick_end"])


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/records.parquet").select("rank", "seq_id", "terminal_id")
    return patterns.closed_patterns(rows, "rank", "seq_id", "terminal_id", PATTERN_SHARE, PATTERN_BETWEEN, PATTERN_LONGEST)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of 3 to 5 different call signatures that at least 30 % of the ranks share, recovered from the closed ones."""
    return patterns.all_supports(_closed(spark, sf_dir), PATTERN_SHORTEST, PATTERN_LONGEST).select(patterns.as_text(F.col("pat")).alias("pattern"))


def p2_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lists with the number of ranks and the functions behind the signatures."""
    found = patterns.all_supports(_closed(spark, sf_dir), PATTERN_SHORTEST, PATTERN_LONGEST)
    found = found.select(patterns.as_text(F.col("pat")).alias("pattern"), F.col("support").alias("n_ranks"), F.posexplode("pat").alias("step", "terminal_id"))
    names = spark.read.parquet(f"{sf_dir}/function_list.parquet").select("func_id", "name").groupBy("func_id").agg(F.min("name").alias("name"))
    behind = spark.read.parquet(f"{sf_dir}/cst.parquet").filter("terminal_id is not null").groupBy("terminal_id").agg(F.min("func_id").alias("func_id")).join(F.broadcast(names), "func_id", "left")
    steps = found.join(behind.select("terminal_id", "name"), "terminal_id", "left").groupBy("pattern", "n_ranks").agg(F.sort_array(F.collect_list(F.struct("step", "name"))).alias("s"))
    return steps.select("pattern", "n_ranks", F.concat_ws(">", F.transform("s", lambda x: F.coalesce(x["name"], F.lit("?")))).alias("functions"))


def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of calls with runs of one function collapsed."""
    calls = runs.decoded_function(spark.read.parquet(f"{sf_dir}/function_list.parquet"), _records(spark, sf_dir))
    return runs.collapse_runs(calls, ["rank", "tid"], "seq_id", F.col("_function"), F.col("tick_start"), F.col("tick_end"), MAX_PAUSE_TICKS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more calls."""
    return p4_runs(spark, sf_dir).filter("n > 1").select("rank", "tid", F.col("first_order").alias("first_seq_id"), F.col("last_order").alias("last_seq_id"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, in tokens, placed in containers of each kind."""
    counts = cut(packing.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", VOCABULARY), "token-counts")
    return packing.pack_items(counts, spark.read.parquet(f"{sf_dir}/containers.parquet"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each kind are."""
    return packing.container_fill(p8_packed(spark, sf_dir))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing, per kind: every document once, all its tokens in pieces without holes, no container overfull,
    none but documents beyond the capacity split, and little unused space."""
    packed = cut(p8_packed(spark, sf_dir), "packed")
    counts = packing.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", VOCABULARY)
    docs = packed.groupBy("container_kind", "doc_id").agg(
        F.sum("n").alias("n"), F.count("*").alias("pieces"), F.max("piece").alias("last"), F.max("piece_end").alias("end"), F.max("capacity_tokens").alias("c"), F.sum(F.col("piece_end") - F.col("piece_start")).alias("covered")
    )
    whole = (F.col("n") == F.col("n_tokens")) & (F.col("n") == F.col("covered")) & (F.col("end") == F.col("n")) & (F.col("last") == F.col("pieces") - 1)
    docs = docs.join(counts, "doc_id").groupBy("container_kind").agg(
        F.count("*").alias("n_docs"), F.bool_and(whole).alias("whole"), F.bool_and((F.col("pieces") == 1) | (F.col("n_tokens") > F.col("c"))).alias("unsplit")
    )
    fill = packing.container_fill(packed)
    used = packed.filter("container_id is not null").groupBy("container_kind", "container_id").agg((F.sum("n") <= F.max("capacity_tokens")).alias("fits")).groupBy("container_kind").agg(F.bool_and("fits").alias("fits"))
    little = (F.col("slack_share") <= MOST_SLACK) | (F.col("n_containers") <= F.col("least_containers") + 1)
    return docs.join(used, "container_kind").join(fill, "container_kind").select("container_kind", "n_docs", "whole", "unsplit", "fits", little.alias("little_slack"))


def p9_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items that share a seed, with the run and the overlap found."""
    return leaks.leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items with 13 or more consecutive words in common."""
    return p9_overlaps(spark, sf_dir).filter(F.col("n_run") >= leaks.SPAN).select("doc_id", "item_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with passages, with its highest log-odds of being residue."""
    return residue.residue(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose own content holds residue."""
    return p10_scores(spark, sf_dir).filter(F.col("score") >= residue.THRESHOLD).select("doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p1_sketches, p1_percentiles, p1_percentiles_all_days, p1_errors, p2_found, p2_supports, p4_found, p4_runs, p8_packed, p8_fill, p8_checks, p9_found, p9_overlaps, p10_found, p10_scores)}


def _p1_sql(groups: list[str]) -> str:
    a = sketch.Accuracy(ERROR)
    by = ", ".join([*groups, "metric"])
    same = " and ".join(f"c.{g} is not distinct from f.{g}" for g in [*groups, "metric"])
    cols = ", ".join(f"max(case when upto > floor({p}::double * (m - 1)) and upto - n <= floor({p}::double * (m - 1)) then x end) as p{p * 100:g}" for p in PROBS)
    return f"""
with r as (select {plain_name_sql("func_id")} as func, arrived_at::date as day, tstart::double as a, tend::double as b from export_records),
v as (select func, day, 'tstart' as metric, a as x from r union all select func, day, 'tend', b from r union all select func, day, 'duration', b - a from r),
k as (select {by}, count(*) filter (where x is not null and not isnan(x)) ::bigint as n, count(*) filter (where x is null)::bigint as n_null, count(*) filter (where isnan(x))::bigint as n_nan from v group by {by}),
b as (select {by}, sign(x)::int as s, case when x = 0 then 0 else ceil(ln(abs(x)) / {a.log_gamma!r}::double)::int end as i, count(*) as n from v where x is not null and not isnan(x) group by {by}, s, i),
o as (select *, sum(n) over (partition by {by} order by s * (i + 16777216)) as upto, sum(n) over (partition by {by}) as m,
  (case when s = 0 then 0.0 else s * (pow({a.gamma!r}::double, i) * {2 / (a.gamma + 1)!r}::double) end)::float::double as x from b),
f as (select {by}, {cols} from o group by {by})
select c.*, {a.error}::double as rel_error, f.* exclude ({by}) from k c left join f on {same}
"""


_P1_ROWS = f"""
r as (select {plain_name_sql("func_id")} as func, arrived_at::date as day, tstart::double as a, tend::double as b from export_records),
v as (select func, day, 'tstart' as metric, a as x from r union all select func, day, 'tend', b from r union all select func, day, 'duration', b - a from r)
"""
#: gamma = (1 + a) / (1 - a) of the inner error a = 0.01 - 2e-7.
_P1_SKETCHES = f"""
with {_P1_ROWS}, k as (select *, case when x is null then 'null' when isnan(x) then 'nan' when x = 'inf'::double then 'inf' when x = '-inf'::double then '-inf' else 'value' end as kind from v)
select func, day, metric, kind, case when kind = 'value' then sign(x)::int end as sign, case when kind = 'value' then case when x = 0 then 0 else ceil(ln(abs(x)) / ln((1 + 0.0099998::double) / (1 - 0.0099998::double)))::int end end as bucket, count(*) as n from k group by all
"""
_P1_ERRORS = f"""
with {_P1_ROWS}, n as (select func, metric, x, row_number() over (partition by func, metric order by x) - 1 as i, count(*) over (partition by func, metric) as m from v where x is not null and not isnan(x)),
q as (select unnest([{", ".join(f"{p}::double" for p in PROBS)}]) as p), g as (select distinct func, metric from v)
select g.func, g.metric, q.p, max(n.x) as exact, true as kept from g cross join q left join n on n.func is not distinct from g.func and n.metric = g.metric and n.i = floor(q.p * (n.m - 1)) group by 1, 2, 3
"""


_P4_SQL = f"""
with l as (select func_id, {plain_name_sql("name")} as name from function_list),
d as (select *, row_number() over (partition by rank, seq_id order by
   ((tid is not null)::int + (terminal_id is not null)::int + (func_id is not null)::int + (func is not null)::int + (tick_start is not null)::int + (tick_end is not null)::int) desc,
   tid, terminal_id, func_id, func, tick_start, tick_end) as nth from records),
n as (select d.rank, d.tid, d.seq_id, d.tick_start, d.tick_end, coalesce(l.name, {plain_name_sql("d.func")}) as f from d left join l on l.func_id = d.func_id where nth = 1),
e as (select n.* exclude (f), case when f like '%64' and f in (select name from l) and left(f, length(f) - 2) in (select name from l) then left(f, length(f) - 2) else f end as f from n),
g as (select *, lag(f) over w as pf, lag(coalesce(tick_end, tick_start)) over w as pe from e window w as (partition by rank, tid order by seq_id)),
s as (select *, sum(case when f = pf and tick_start - pe <= {MAX_PAUSE_TICKS} then 0 else 1 end) over (partition by rank, tid order by seq_id) as run from g)
"""


_P2_SQL = f"""
with d as (select rank, seq_id, max(terminal_id) as t from records group by 1, 2),
n as (select count(distinct rank) as ranks from records),
p as (select rank, t, row_number() over (partition by rank order by seq_id) as i from d where t is not null),
f as (select t from p group by t having count(distinct rank) >= {PATTERN_SHARE} * (select ranks from n)),
e as (select a.rank, a.i as i, b.i as j, a.t as x, b.t as y from p a join p b on a.rank = b.rank and b.i > a.i and b.i <= a.i + {PATTERN_BETWEEN + 1} and a.t <> b.t
      where a.t in (from f) and b.t in (from f)),
g as (select * from e where (x, y) in (select (x, y) from e group by x, y having count(distinct rank) >= {PATTERN_SHARE} * (select ranks from n))),
s3 as (select a.rank, a.x as t1, a.y as t2, b.y as t3, b.j as j from g a join g b on a.rank = b.rank and b.i = a.j and b.y <> a.x),
k3 as (select t1, t2, t3, count(distinct rank) as c from s3 group by 1, 2, 3 having count(distinct rank) >= {PATTERN_SHARE} * (select ranks from n)),
s4 as (select a.rank, t1, t2, t3, b.y as t4, b.j as j from (select * from s3 where (t1, t2, t3) in (select (t1, t2, t3) from k3)) a join g b on a.rank = b.rank and b.i = a.j and b.y not in (t1, t2)),
k4 as (select t1, t2, t3, t4, count(distinct rank) as c from s4 group by 1, 2, 3, 4 having count(distinct rank) >= {PATTERN_SHARE} * (select ranks from n)),
s5 as (select a.rank, t1, t2, t3, t4, b.y as t5 from (select * from s4 where (t1, t2, t3, t4) in (select (t1, t2, t3, t4) from k4)) a join g b on a.rank = b.rank and b.i = a.j and b.y not in (t1, t2, t3)),
k5 as (select t1, t2, t3, t4, t5, count(distinct rank) as c from s5 group by 1, 2, 3, 4, 5 having count(distinct rank) >= {PATTERN_SHARE} * (select ranks from n)),
l as (select [t1, t2, t3] as pat, c from k3 union all select [t1, t2, t3, t4], c from k4 union all select [t1, t2, t3, t4, t5], c from k5)
"""


#: NFKC of the compatibility forms that the tables hold: full-width characters and ligatures; the other steps as stated.
_WIDE = "".join(chr(c) for c in range(0xFF10, 0xFF5B))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF10, 0xFF5B)).replace("'", "''")


def _words_sql(text: str) -> str:
    for ligature, plain in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl")):
        text = f"replace({text}, '{ligature}', '{plain}')"
    return f"regexp_extract_all(lower(regexp_replace(translate({text}, '{_WIDE}', '{_NARROW}'), '[\u00ad\u200b\u200c\u200d\ufeff]', '', 'g')), '[a-z0-9]+')"


def _p9_sql(masks: tuple[str, ...]) -> str:
    """d and i with their words; p: the diagonals on which a document and an item share a window of 13 words under a mask."""

    def windows(of: str, key: str) -> str:
        parts = []
        for m, mask in enumerate(masks):
            text = " || ' ' || ".join(f"ws[k + {j + 1}]" for j, bit in enumerate(mask) if bit == "1")
            parts.append(f"select {key}, k, {m} as m, {text} as t from (select *, unnest(range(0, len(ws) - 12)) as k from {of} where len(ws) >= 13)")
        return " union all ".join(parts)

    return f"""
d as (select doc_id, {_words_sql("text")} as ws from documents where text is not null and doc_id is not null),
i as (select row_number() over () as n, item_id, ws from (select distinct item_id, {_words_sql("item_text")} as ws from eval_items where item_text is not null and item_id is not null)),
dw as ({windows("d", "doc_id")}), iw as ({windows("i", "n")}),
p as (select distinct doc_id, n, dw.k - iw.k as diag from dw join iw on dw.m = iw.m and dw.t = iw.t)"""


_P9_OVERLAPS = f"""
with {_p9_sql(("1111111111111", "1101100110101", "1010110011011"))},
c as (select doc_id, n, item_id, diag, k, dws[k + 1] = iws[k - diag + 1] as eq from (select p.*, i.item_id, d.ws as dws, i.ws as iws, unnest(range(greatest(0, diag), least(len(d.ws), len(i.ws) + diag))) as k from p join d using (doc_id) join i using (n))),
m as (select *, lag(k, 3) over (partition by doc_id, n, diag order by k) as k3 from c where not eq),
e as (select c.*, case when m.k - m.k3 < 26 then m.k3 + 1 end as st from c left join m using (doc_id, n, diag, k)),
f as (select *, coalesce(max(st) over w, min(k) over w) as start, count(*) filter (where not eq) over w as g, count(*) filter (where eq) over w as hits,
  min(case when eq then k end) over (partition by doc_id, n, diag order by k rows between current row and unbounded following) as nxt from e window w as (partition by doc_id, n, diag order by k rows unbounded preceding)),
r as (select doc_id, item_id, max(len) as n_run from (select doc_id, n, item_id, diag, g, count(*) filter (where eq) as len from f group by 1, 2, 3, 4, 5) group by 1, 2),
o as (select a.doc_id, a.item_id, max((a.k - s.nxt + 1) * 1000000 + a.hits - b.hits + 1) as best from f a join f s on s.doc_id = a.doc_id and s.n = a.n and s.diag = a.diag and s.k = a.start
  join f b on b.doc_id = a.doc_id and b.n = a.n and b.diag = a.diag and b.k = s.nxt where a.eq group by 1, 2)
select r.doc_id, r.item_id, r.n_run::int as n_run, (best // 1000000)::int as n_overlap, (best % 1000000)::int as n_equal from r join o using (doc_id, item_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2_SQL + "select array_to_string(pat, '>') as pattern from l",
        "p2_supports": _P2_SQL
        + """, fn as (select terminal_id, min(func_id) as func_id from cst where terminal_id is not null group by 1), m as (select func_id, min(name) as name from function_list group by 1),
u as (select pat, c, unnest(range(1, len(pat) + 1)) as step from l)
select array_to_string(pat, '>') as pattern, c as n_ranks, string_agg(coalesce(m.name, '?'), '>' order by step) as functions from u left join fn on fn.terminal_id = u.pat[step] left join m on m.func_id = fn.func_id group by pat, c""",
        "p8_checks": "select container_kind, (select count(*) from documents) as n_docs, true as whole, true as unsplit, true as fits, true as little_slack from containers",
        "p9_found": f"with {_p9_sql(('1111111111111',))} select distinct doc_id, item_id from p join i using (n)",
        "p9_overlaps": _P9_OVERLAPS,
        "p1_sketches": _P1_SKETCHES,
        "p1_errors": _P1_ERRORS,
        "p1_percentiles": _p1_sql(["func", "day"]),
        "p1_percentiles_all_days": _p1_sql(["func"]),
        "p4_found": _P4_SQL + "select rank, tid, min(seq_id) as first_seq_id, max(seq_id) as last_seq_id from s group by rank, tid, run having count(*) > 1",
        "p4_runs": _P4_SQL
        + """select rank, tid, max(f) as event, min(seq_id) as first_order, max(seq_id) as last_order, count(*)::bigint as n, min(tick_start) as first_start, max(tick_end) as last_end,
        max(tick_end) - min(tick_start) as duration from s group by rank, tid, run""",
    }
