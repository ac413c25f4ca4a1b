"""Periods, months and time differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MONTH = r"^[0-9]{4}-(0[1-9]|1[0-2])$"


def period_year(period: Column) -> Column:
    return F.substring(period, 1, 4).cast("int")


def month_start(text: Column) -> Column:
    """First day of a ``YYYY-MM`` text, NULL when it is not one."""
    return F.when(text.rlike(_MONTH), F.to_date(F.concat(text, F.lit("-01"))))


def expand_months(ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Every distinct ``YYYY-MM`` inside the inclusive ranges.

    Malformed or reversed ranges yield nothing. Equal ranges are merged before they are expanded.
    """
    first, last = month_start(F.col(start)), month_start(F.col(end))
    # The optimizer may evaluate the sequence of two constants before the filter has a say.
    forward = F.col("_first") <= F.col("_last")
    months = F.when(forward, F.sequence("_first", "_last", F.expr("interval 1 month")))
    return (
        ranges.select(first.alias("_first"), last.alias("_last"))
        .where(forward)
        .distinct()
        .select(F.explode(months).alias("_month"))
        .select(
            F.substring(F.col("_month").cast("string"), 1, 7).alias("period"),
            F.year("_month").alias("year"),
            F.month("_month").alias("month"),
        )
        .distinct()
    )


def month_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Inclusive range as ordered (period, year, month); a malformed bound is an error."""
    parsed = []
    for text in (start, end):
        year, _, month = text.partition("-")
        if not (year.isdigit() and month.isdigit() and 1 <= int(month) <= 12):
            raise ValueError(f"not a YYYY-MM month: {text!r}")
        parsed.append(f"{int(year):04d}-{int(month):02d}")
    bounds = spark.range(1).select(F.lit(parsed[0]).alias("start"), F.lit(parsed[1]).alias("end"))
    return expand_months(bounds).orderBy("period")


def micros_between(later: str, earlier: str) -> Column:
    """Whole microseconds between two zone-free timestamps, whatever the session zone is."""
    return F.expr(f"cast(cast(cast({later} - {earlier} as interval second) as decimal(18,6)) * 1000000 as bigint)")
