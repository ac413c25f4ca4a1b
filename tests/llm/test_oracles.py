"""Registered queries against their SQL counterparts."""

from __future__ import annotations

import pytest

from tests.compare import connect, duck_rows, spark_rows, spark_types
from tripstrata.llm.oracles import ORACLE
from tripstrata.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_answer(spark, small, name):
    df = QUERIES[name](spark, small)
    expected, types = duck_rows(connect(small), ORACLE[name])
    assert spark_types(df) == types
    assert spark_rows(df) == expected
