"""Where the acceptance rules are judged."""

from __future__ import annotations

from tripstrata.operators import silver
from tripstrata.sources import adapters


def test_rules_of_one_side_are_judged_before_the_join(spark, small):
    text = adapters.silver(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    join, below = text.split("Join Inner", 1)[1].split("\n", 1)
    assert "make_dt_interval" not in join and "l_returnflag" not in join
    assert "l_returnflag" in below.split("Relation")[0].split("Filter", 1)[1]


def test_accepted_rows_are_those_without_a_category(spark, small):
    rows = adapters.bronze(spark, small)
    accepted = silver.silver_accepted(rows).select(*rows.columns)
    plain = silver.with_category(rows).where("category IS NULL").select(*rows.columns)
    assert accepted.count() == plain.count() > 0 and accepted.exceptAll(plain).isEmpty()
