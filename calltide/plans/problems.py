"""Queries of the general problems 3, 5, 6 and 7 over the trace tables, and their SQL."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.functions.names import plain_name, plain_name_sql
from calltide.functions.values import duration, finite, to_micros
from calltide.operators.calls import distinct_rows, export_preference
from calltide.operators.features import entity_features, entity_type_rows
from calltide.operators.intervals import gaps, merged_ranges, stretches
from calltide.operators.skew import heavy_keys, key_results
from calltide.streaming.compact import compact

#: Consolidated files of the queries' tables; small, as these tables are.
COMPACTED_FILE_BYTES = 16 << 20
STAGED_BATCH_BYTES = 32 << 20
HEAVY_SHARE = 0.05
#: Tables that the SQL with a column per type is made for.
ORACLE_TABLES = os.environ.get("CALLTIDE_ORACLE_TABLES", "/root/testdata/sf0.01")


def _exported_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    """Exported calls, each once, with the arguments that the feature operators take."""
    rows = spark.read.parquet(f"{sf_dir}/export_records.parquet").select("rank", "index", "func_id", "tstart", "tend", "arrived_at", "file_name")
    calls = distinct_rows(rows, ["rank", "index"], export_preference())
    listed = [r[0] for r in spark.read.parquet(f"{sf_dir}/function_list.parquet").select(plain_name(F.col("name"))).distinct().collect()]
    return calls, ["rank", plain_name(F.col("func_id")), F.col("tstart"), F.col("tend"), ["rank", "index"], listed]


def p3_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per rank; per function the number of calls, microseconds since its last start, and total microseconds. Each call counts once."""
    calls, args = _exported_calls(spark, sf_dir)
    return entity_features(calls, *args)


def p3_type_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in long form: a row per rank and function of the complete list."""
    calls, args = _exported_calls(spark, sf_dir)
    return entity_type_rows(calls, *args)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the byte ranges of each file and rank."""
    return gaps(merged_ranges(spark.read.parquet(f"{sf_dir}/intervals.parquet"))).distinct()


def p5_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous stretches of each file and rank, with first and last time."""
    return stretches(merged_ranges(spark.read.parquet(f"{sf_dir}/intervals.parquet"))).drop("stretch")


def p6_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per function name as stored and per rank: rows, time, last start, and exact quantiles of the call's duration."""
    rows = spark.read.parquet(f"{sf_dir}/export_records.parquet").select("rank", "func_id", "tstart", "tend")
    return key_results(rows, ["rank", "func_id"], duration(F.col("tstart"), F.col("tend")), to_micros(finite(F.col("tstart"))))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks and function names that hold at least 5 % of all rows."""
    return heavy_keys(p6_results(spark, sf_dir), HEAVY_SHARE).select("key_field", "key_value")


def _missing() -> Column:
    return F.col("func_id").isNull().cast("int") + F.col("tstart").isNull().cast("int") + F.coalesce(F.isnan("tend") | (F.col("tend") < F.col("tstart")), F.lit(True)).cast("int")


def p7_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consolidated calls: every (rank, index) once, with the number of rows it was stored in."""
    prefer = [_missing(), F.col("arrived_at").isNull(), F.col("arrived_at")]
    return compact(spark, f"{sf_dir}/export_records.parquet", ["rank", "index"], prefer, bytes_per_batch=STAGED_BATCH_BYTES, file_bytes=COMPACTED_FILE_BYTES)


def p7_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every consolidated call, the number of its rows and what made the one that stands the best of them."""
    return p7_compacted(spark, sf_dir).select("rank", "index", F.col("_copies").alias("copies"), _missing().alias("missing"), "arrived_at")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that were stored in more than one row."""
    return p7_compacted(spark, sf_dir).filter("_copies > 1").select("rank", "index")


def queries() -> dict:
    return {f.__name__: f for f in (p3_features, p3_type_rows, p5_found, p5_stretches, p6_found, p6_results, p7_found, p7_compacted, p7_standing)}


_EXPORT_MISSING = "(func_id is null)::int + (tstart is null)::int + coalesce(isnan(tend) or tend < tstart, true)::int"
_DURATION = "case when isfinite(tstart) and isfinite(tend) and tend >= tstart then tend::double - tstart::double end"
_RUNS = """
with r as (select filename, rank, tstart, "offset" as a, "offset" + count as b from intervals where "offset" is not null and count > 0),
s as (select *, max(b) over (partition by filename, rank order by a, b rows between unbounded preceding and 1 preceding) as upto from r),
t as (select *, sum(case when upto is null or a > upto then 1 else 0 end) over (partition by filename, rank order by a, b rows unbounded preceding) as g from s)
"""


_P3_ROWS = f"""
  with c as (
    select rank, coalesce({plain_name_sql("func_id")}, 'unknown') as f, tstart, tend from export_records
    qualify row_number() over (partition by rank, "index" order by {_EXPORT_MISSING}, arrived_at nulls last, file_name nulls last, func_id nulls last, tstart nulls last, tend nulls last) = 1),
  a as (
    select rank, f, count(*)::bigint as n, max(floor(case when isfinite(tstart) then tstart::double end * 1000000 + 0.5))::bigint as last,
      coalesce(sum(floor(({_DURATION}) * 1000000 + 0.5)::bigint), 0)::bigint as total from c group by 1, 2),
  t as (select f from a union select {plain_name_sql("name")} from function_list),
  k as (select distinct rank from a)
  select k.rank, t.f as type, coalesce(a.n, 0) as n, (select max(last) from a) - a.last as since_us, coalesce(a.total, 0) as total_us
  from k cross join t left join a on a.rank is not distinct from k.rank and a.f = t.f
"""


def _p3_sql() -> dict[str, str]:
    """SQL has to name every column, so the wide form's is made from the types in the tables that it will run on; none where they aren't."""
    if not Path(ORACLE_TABLES).is_dir():
        return {}
    import pyarrow.parquet as pq

    def plain(name: str) -> str:
        return re.sub("^pmpi_", "mpi_", re.sub(r"\s+", "", name).lower())

    names = pq.read_table(f"{ORACLE_TABLES}/export_records.parquet", columns=["func_id"])["func_id"].unique().to_pylist()
    listed = pq.read_table(f"{ORACLE_TABLES}/function_list.parquet", columns=["name"])["name"].to_pylist()
    types = sorted({plain(n) if n is not None else "unknown" for n in [*names, *listed]})
    columns = ", ".join(f"max(case when type = '{t}' then {c} end) as \"{t}_{c}\"" for t in types for c in ("n", "since_us", "total_us"))
    return {"p3_features": f"select rank, {columns} from ({_P3_ROWS}) group by rank"}


def oracle_sql() -> dict[str, str]:
    key_rows = f"""
with r as (
  select 'rank' as key_field, rank::varchar as key_value, {_DURATION} as v, floor(case when isfinite(tstart) then tstart::double end * 1000000 + 0.5)::bigint as s from export_records
  union all
  select 'func_id', func_id, {_DURATION}, floor(case when isfinite(tstart) then tstart::double end * 1000000 + 0.5)::bigint from export_records),
"""
    ranked = "n as (select *, row_number() over (partition by key_field, key_value order by v) - 1 as i, count(*) over (partition by key_field, key_value) as m from r where v is not null), "
    pick = ", ".join(f"max(case when i = floor({p} * (m - 1)) then v end) as p{n}" for p, n in ((0.5, "50"), (0.9, "90"), (0.99, "99")))
    return {
        "p3_type_rows": _P3_ROWS,
        **_p3_sql(),
        "p5_found": _RUNS + "select distinct filename, rank, upto as gap_start, a as gap_end from t where a > upto",
        "p5_stretches": _RUNS + 'select filename, rank, min(a) as stretch_start, max(b) as stretch_end, min(tstart) as first_tstart, max(tstart) as last_tstart, count(*)::bigint as n_ranges from t group by filename, rank, g',
        "p6_found": """
select 'rank' as key_field, rank::varchar as key_value from export_records where rank is not null group by rank having count(*) >= 0.05 * (select count(*) from export_records)
union all
select 'func_id', func_id from export_records where func_id is not null group by func_id having count(*) >= 0.05 * (select count(*) from export_records)
""",
        "p6_results": f"""{key_rows}{ranked}
p as (select key_field, key_value, {pick} from n group by 1, 2),
t as (select key_field, key_value, count(*)::bigint as n_rows, count(v)::bigint as n_valued, coalesce(sum(floor(v * 1000000 + 0.5)::bigint), 0)::bigint as total_us, max(s) as last_us from r group by 1, 2)
select t.*, p50, p90, p99 from t left join p on p.key_field = t.key_field and p.key_value is not distinct from t.key_value
""",
        "p7_standing": f"""
select rank, "index", copies, missing, arrived_at from (select *, {_EXPORT_MISSING} as missing, count(*) over (partition by rank, "index") as copies,
  row_number() over (partition by rank, "index" order by {_EXPORT_MISSING}, arrived_at is null, arrived_at) as nth from export_records) where nth = 1""",
        "p7_found": 'select rank, "index" from export_records group by 1, 2 having count(*) > 1',
    }
