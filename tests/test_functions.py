from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripstrata.functions.fixed_point import exact_avg, exact_sum, merge, parts, total
from tripstrata.functions.quantiles import exact_percentiles
from tripstrata.functions.times import expand_months, micros_between, month_range

WANTED = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}
RELAXED = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
cents = st.integers(-10_000_000, 10_000_000).map(lambda n: n / 100)


def _values(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


@RELAXED
@given(values=st.lists(st.one_of(st.none(), cents), min_size=1, max_size=60), pieces=st.integers(1, 7))
def test_exact_sum_ignores_order_and_partitions(spark, values, pieces):
    known = [v for v in values if v is not None]
    expected = float(sum(Decimal(repr(v)) for v in known)) if known else None
    df = _values(spark, values).repartition(pieces)
    assert df.agg(exact_sum("v")).first()[0] == expected
    mean = df.agg(exact_avg("v")).first()[0]
    assert mean == (expected / len(known) if known else None)


def test_exact_sum_is_exact_where_a_plain_sum_is_not(spark):
    df = spark.range(100_000).select(F.lit(0.1).alias("v"))
    assert df.agg(exact_sum("v")).first()[0] == 10_000.0
    assert df.agg(F.sum("v")).first()[0] != 10_000.0


def test_exact_sum_beyond_the_fixed_range(spark):
    assert _values(spark, [1e300, 1.5, None]).agg(exact_sum("v")).first()[0] == 1e300
    assert _values(spark, [float("inf"), 1.5]).agg(exact_sum("v")).first()[0] == math.inf
    assert math.isnan(_values(spark, [float("nan"), 1.5]).agg(exact_sum("v")).first()[0])
    # A total that no BIGINT of 1e-8 units holds.
    df = spark.range(1000).select(F.lit(8e10).alias("v"))
    assert df.agg(exact_sum("v")).first()[0] == 8e13


def test_parts_roll_up(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") / 100).alias("v"))
    cells = df.groupBy("k").agg(*parts("v", "v"))
    assert cells.agg(*merge("v")).select(total("v")).first()[0] == df.agg(exact_sum("v")).first()[0]


@RELAXED
@given(values=st.lists(st.one_of(cents, st.floats(-1e12, 1e12)), min_size=1, max_size=80))
def test_percentiles_equal_numpy(spark, values):
    row = exact_percentiles(_values(spark, values), "v", WANTED).first()
    expected = np.quantile(np.array(values), list(WANTED.values()))
    assert list(row) == pytest.approx(list(expected), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_percentiles_of_crowded_values(spark, rounds):
    """All within one step of the logarithm, evenly or beside an outlier; widest range; infinite ends."""
    draw = np.random.default_rng(3)
    even = 100 + draw.random(20_000) / 2
    crowd = np.concatenate([[100.0], 101 + draw.random(20_000) * 1e-9])
    far = np.array([-1.7e308, -1.0, 0.0, 5e-324, 1.0, 1.7e308] * 3)
    for values in (even, crowd, far):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        row = exact_percentiles(df, "v", {"p25": 0.25, "p50": 0.5, "p999": 0.999}, rounds=rounds).first()
        expected = np.quantile(values, [0.25, 0.5, 0.999])
        assert list(row) == pytest.approx(list(expected), rel=1e-12)
    ends = _values(spark, [-math.inf, -math.inf, 1.0, 2.0, 3.0, math.inf, math.inf])
    assert exact_percentiles(ends, "v", {"p50": 0.5}, rounds=rounds).first().p50 == 2.0


def test_percentiles_per_group_keep_null_keys(spark):
    rows = [("a", float(n)) for n in range(11)] + [(None, 4.0), (None, 6.0), ("b", None), ("c", -3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {row.k: row.p50 for row in exact_percentiles(df, "v", {"p50": 0.5}, ["k"]).collect()}
    assert found == {"a": 5.0, None: 5.0, "c": -3.0}


def test_percentiles_of_a_hot_group(spark):
    hot = spark.range(30_000).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % 30_000 / 100).alias("v"))
    cold = spark.range(60_000).select(
        F.concat(F.lit("g"), (F.col("id") % 500).cast("string")).alias("k"), (F.col("id") / 10).alias("v")
    )
    df = hot.unionByName(cold)
    exact = exact_percentiles(df, "v", {"p50": 0.5, "p99": 0.99}, ["k"]).orderBy("k").collect()
    usual = df.groupBy("k").agg(F.percentile("v", F.lit(0.5)), F.percentile("v", F.lit(0.99))).orderBy("k").collect()
    assert [list(r)[1:] for r in exact] == [pytest.approx(list(r)[1:]) for r in usual]


def test_month_range(spark):
    assert [r.period for r in month_range(spark, "2023-11", "2024-02").collect()] == ["2023-11", "2023-12", "2024-01", "2024-02"]
    assert month_range(spark, "2024-02", "2024-01").count() == 0
    assert [tuple(r) for r in month_range(spark, "2024-05", "2024-05").collect()] == [("2024-05", 2024, 5)]
    for bad in ("2024", "2024-13", "abc-de", ""):
        with pytest.raises(ValueError):
            month_range(spark, bad, "2024-01")


def test_expand_months_skips_malformed_ranges(spark):
    rows = [("2024-01", "2024-02"), ("2024-02", "2024-03"), ("2024-1", "2024-03"), (None, "2024-03"), ("2024-05", "2024-04"), ("x", "y")]
    df = spark.createDataFrame(rows, "start string, end string")
    assert sorted(r.period for r in expand_months(df).collect()) == ["2024-01", "2024-02", "2024-03"]


def test_micros_do_not_depend_on_the_session_zone(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-03-10 01:59:59.5' AS a, timestamp_ntz'2024-03-10 03:00:00.25' AS b"
    ).select(micros_between("b", "a").alias("us"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert df.first().us == 3_600_750_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_percentiles_leave_nan_out(spark):
    row = exact_percentiles(_values(spark, [-5.0, 1.0, 2.0, 3.0, math.nan, None]), "v", {"p50": 0.5, "p99": 0.99}).first()
    assert row.p50 == 1.5 and row.p99 == pytest.approx(2.97)


def test_profile_keeps_small_values(spark):
    from tripstrata.operators.profile import profile_describe

    row = profile_describe(_values(spark, [1e-9, 3e-9])).first()
    assert row["mean"] == pytest.approx(2e-9, rel=1e-12) and row["value_count"] == 2
