"""Exact percentiles with linear interpolation, without gathering a group in one task.

``percentile`` keeps every distinct value of a group in the memory of one task. Here values are
counted first, and intervals of the values split each group, however large it is: interval totals
tell in which interval a rank falls, and only those are looked into. The first intervals are steps of
the logarithm. Each that is hit is then cut again, between the smallest and the largest value found
in it; the last intervals hit are sorted. So a column whose values all lie close together is spread
like any other: ten million values spread over one step leave about 600 between two cuts. A second
round does the same for values that crowd within a millionth of each other beside outliers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEPS_PER_E = 50
_RESOLUTION = 1000.0
_CUTS = 1 << 14


def _step(value: Column) -> Column:
    # log(1 + |x| * r) never decreases with |x|, so steps keep the order of values.
    size = F.floor(F.log(F.lit(1.0) + F.abs(value) * F.lit(_RESOLUTION)) * F.lit(_STEPS_PER_E))
    return F.coalesce(F.when(value < 0, -size).otherwise(size), F.lit(0))


def _cut(value: Column, low: Column, high: Column) -> Column:
    """The place of a value between two others, one of ``_CUTS``. Differences and quotients of doubles
    keep their order too; halves are taken, so that the width of no interval overflows."""
    share = F.try_divide(value / 2 - low / 2, high / 2 - low / 2)
    place = F.least(F.floor(share * _CUTS), F.lit(_CUTS - 1).cast("long"))
    # Ends that are equal, infinite or next to each other leave nothing to cut.
    return F.when((high > low) & ~F.isnan(share), place).otherwise(F.when(value >= high, F.lit(_CUTS - 1)).otherwise(0))


def _covers(index: Column, start: Column, length: Column) -> Column:
    return (start <= index) & (index < start + length)


def _rank(p: float) -> Column:
    return F.lit(float(p)) * (F.col("_total") - 1)


def _same(names: Sequence[str]) -> Column:
    """Null-safe equality of columns with their namesakes among the targets."""
    met = F.lit(True)
    for name in names:
        met = met & F.col(name).eqNullSafe(F.col(f"_target_{name}"))
    return met


def _hit(intervals: DataFrame, wanted: Mapping[str, float], names: Sequence[str]) -> DataFrame:
    """The intervals in which a wanted rank falls, as targets to join."""
    hit = F.lit(False)
    for p in wanted.values():
        for index in (F.floor(_rank(p)), F.ceil(_rank(p))):
            hit = hit | _covers(index, F.col("_before"), F.col("_held"))
    found = intervals.where(hit).select(*names, "_before", "_total", "_low", "_high")
    return found.withColumnsRenamed({name: f"_target_{name}" for name in names})


def exact_percentiles(
    df: DataFrame, value: str, wanted: Mapping[str, float], keys: Sequence[str] = (), rounds: int = 1
) -> DataFrame:
    """One row per group (one in all without keys): ``keys`` and a column per entry of ``wanted``.

    NULL and NaN are left out; ``rounds`` is how often hit intervals are cut again, which changes no
    result. The input is scanned once. Values are counted on one shuffle, which the
    interval totals of every round and the final pick read; the null-safe joins keep it that way, since
    a plain equality would filter one of the two sides for NULL keys (and lose the group of NULL keys).
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_place0", _step(F.col("_value")))
    )
    sizes = (F.sum("_n").alias("_held"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))

    names = [*keys, "_place0"]
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_place0").rowsBetween(Window.unboundedPreceding, -1)
    intervals = (
        counts.groupBy(*names)
        .agg(*sizes)
        .withColumn("_before", F.coalesce(F.sum("_held").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_held").over(group))
    )

    def inside(targets: DataFrame) -> DataFrame:
        """The counted values of the intervals hit."""
        return counts.join(targets, _same(["_place0", *keys]) & F.col("_value").between(F.col("_low"), F.col("_high")))

    for number in range(1, rounds + 1):
        place = f"_place{number}"
        found = inside(_hit(intervals, wanted, names)).withColumn(
            place, _cut(F.col("_value"), F.col("_low"), F.col("_high"))
        )
        starts = [*keys, "_place0", F.col("_low").alias("_from")]
        earlier = Window.partitionBy(*keys, "_place0", "_from").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        intervals = (
            found.groupBy(*starts, place, F.col("_before").alias("_start"), "_total")
            .agg(*sizes)
            .withColumn("_before", F.col("_start") + F.coalesce(F.sum("_held").over(earlier), F.lit(0)))
        )

    within = Window.partitionBy(*keys, "_place0", "_low").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    placed = inside(_hit(intervals, wanted, names)).withColumn(
        "_start", F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    )

    picks = []
    for name, p in wanted.items():
        for side, index in (("lo", F.floor(_rank(p))), ("hi", F.ceil(_rank(p)))):
            here = _covers(index, F.col("_start"), F.col("_n"))
            picks.append(F.max(F.when(here, F.col("_value"))).alias(f"_{name}_{side}"))
    found = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)

    columns = []
    for name, p in wanted.items():
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        columns.append((low + (high - low) * (_rank(p) - F.floor(_rank(p)))).alias(name))
    return found.select(*keys, *columns)
