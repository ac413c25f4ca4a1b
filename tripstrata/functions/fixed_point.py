"""Sums of doubles that do not depend on row order.

A plain ``sum(double)`` changes in its last digits whenever a task is retried or the partitioning
changes, and ``sum(decimal)`` costs about ten times as much. Here a value becomes a BIGINT in units
of 1e-8, split into two parts so that neither can overflow: the high part lasts to 9e14 in total,
the low part to 9e14 rows. Values too large for a BIGINT (and infinities) are summed as doubles in
``big``. Every part is additive, so partial results roll up exactly.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = 1e8
_SPLIT = 10_000
_LARGEST = 9e10

PARTS = ("hi", "lo", "big", "n")


def _aggregates(value: Column) -> dict[str, Column]:
    small = F.abs(value) < F.lit(_LARGEST)
    units = F.when(small, F.rint(value * F.lit(_UNITS))).cast("bigint")
    return {
        "hi": F.sum(F.call_function("div", units, F.lit(_SPLIT))),
        "lo": F.sum(units % F.lit(_SPLIT)),
        "big": F.sum(F.when(~small, value)),
        "n": F.count(value),
    }


def _combine(hi: Column, lo: Column, big: Column, n: Column) -> Column:
    zero = F.lit(0)
    exact = F.coalesce(hi, zero).cast("decimal(19,0)") * F.lit(Decimal("0.0001")) + F.coalesce(lo, zero).cast(
        "decimal(19,0)"
    ) * F.lit(Decimal("0.00000001"))
    return F.when(n > 0, exact.cast("double") + F.coalesce(big, F.lit(0.0)))


def parts(value: Column | str, name: str) -> list[Column]:
    """Aggregate columns ``name_hi .. name_n`` over rows."""
    value = F.col(value) if isinstance(value, str) else value
    return [column.alias(f"{name}_{part}") for part, column in _aggregates(value).items()]


def merge(name: str) -> list[Column]:
    """Aggregate columns that add up parts computed before."""
    return [F.sum(f"{name}_{part}").alias(f"{name}_{part}") for part in PARTS]


def total(name: str) -> Column:
    return _combine(*[F.col(f"{name}_{part}") for part in PARTS])


def mean(name: str) -> Column:
    count = F.col(f"{name}_n")
    return F.when(count > 0, total(name) / count)


def exact_sum(value: Column | str) -> Column:
    """Order-independent ``sum`` as one aggregate expression."""
    value = F.col(value) if isinstance(value, str) else value
    return _combine(**_aggregates(value))


def exact_avg(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    count = F.count(value)
    return F.when(count > 0, _combine(**_aggregates(value)) / count)
