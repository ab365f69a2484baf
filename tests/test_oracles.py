"""Every registered query against its DuckDB oracle at sf0.01 (the driver's correctness gate), and no plan
with a cartesian product, a nested-loop join or a row-at-a-time Python UDF."""

import contextlib
import io

import pytest
from conftest import SF001
from oracle_check import compare, duck

import __spark_entry__ as E

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    plan = plan_text(df)
    bad = [x for x in FORBIDDEN if x in plan]
    assert not bad, f"plan uses {bad}"
    ok, msg = compare(df, con, ORACLES[name])
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, name):
    df = QUERIES[name](spark, SF001)
    assert df.count() >= 0


def test_entry(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 3
