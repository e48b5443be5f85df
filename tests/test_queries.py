"""Every registered query against its SQL twin in an independent engine."""

import compare
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"

# The queries of the optional subpackage have tests of their own.
QUERIES = {name for name in entry.queries() if not entry.llm_queries or name not in {*entry.llm_queries.QUERIES, "pipeline"}}

# No all-pairs joins, and no rows handed to Python.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow")


@pytest.fixture(scope="module")
def engine():
    return compare.connect(FOLDER)


def test_every_query_has_a_twin():
    assert QUERIES <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, engine, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]
    ours = compare.spark_rows(df)
    theirs = compare.sql_rows(engine, entry.oracle_sql()[name])
    assert ours == theirs


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_order_finance_reads_every_table_once(spark):
    plan = entry.queries()["core_order_financial"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 4
    assert plan.count("Partial") >= 4


def test_unused_columns_are_not_read(spark):
    plan = entry.queries()["order_paid"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    columns = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert columns == "o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz"
