"""Every registered query against its SQL counterpart, values and types compared exactly."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from conformance.duckdb_sql import ORACLE
from conformance.spark_queries import QUERIES
from tests.compare import connect, duck_rows, spark_rows, spark_types
from tests.helpers import plan

ROWS_ONLY = {
    "train_fare_model",
    "score_fares",
}
# Spark ML scores rows inside the JVM, through functions that plans show as UDFs.
MODEL_QUERIES = {"score_fares", "train_fare_model", "score_fares_walk", "latest_model"}


def unwanted(text: str) -> list[str]:
    """Python workers and joins without a key have no place in any plan."""
    operators = ("Python", "Pandas", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin")
    return [operator for operator in operators if operator in text]


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert not set(ORACLE) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_answer(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    assert name in MODEL_QUERIES or not unwanted(plan(df))
    expected, types = duck_rows(duck, ORACLE[name])
    assert spark_types(df) == types
    assert spark_rows(df) == expected


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only(spark, small, name):
    df = QUERIES[name](spark, small)
    assert name in MODEL_QUERIES or not unwanted(plan(df))
    assert df.count() > 0


def test_registered():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLE) <= set(entry_point.oracle_sql())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
