"""Queries that read their rows more than once make them once."""

from __future__ import annotations

import pytest

from conformance.spark_queries import QUERIES
from tests.helpers import plan

REREAD = ("quality_report", "duplicate_count", "bounded_sample", "train_test_split", "replay_day")


@pytest.mark.parametrize("name", REREAD)
def test_the_join_is_not_repeated(spark, small, name):
    assert "o_orderkey" not in plan(QUERIES[name](spark, small))
