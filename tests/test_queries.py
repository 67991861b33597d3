"""Every registered query against its SQL, or for rows, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from revloom.plans.queries import QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    assert compare(df, connect(SF), SQL[name]) is None
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert unwanted not in _plan(df)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["user_id", "business_id", "first", "weighted"]


def test_scan_is_pruned_and_filtered(spark):
    plan = _plan(entry.queries()["q04_complete_cases"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>" in plan
    plan = _plan(entry.queries()["q02_pair_average"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    assert "l_extendedprice" not in plan
