"""Every core query against its SQL on the smallest tables, with compiled plans as users run them."""

import pytest

from calltide.plans import events, flagship, problems, trace
from tests.compare import of_query, of_sql, tables

SF = "/root/testdata/sf0.001"
problems.ORACLE_TABLES = SF
QUERIES = {name: q for m in (problems, trace, events, flagship) for name, q in m.queries().items()}
SQL = {name: q for m in (problems, trace, events, flagship) for name, q in m.oracle_sql().items()}


@pytest.fixture(scope="module")
def compiled(spark):
    changed = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def con():
    return tables(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_like_sql(compiled, con, name):
    assert of_query(QUERIES[name](compiled, SF)) == of_sql(con, SQL[name])
