"""Dataset profiling: shape, preview, distribution, missing values, rule counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.fixed_point import exact_avg
from ..functions.quantiles import exact_percentiles
from .silver import slv_004, slv_005, slv_006

_RANGED = ("passenger_count", "trip_distance", "fare_amount", "total_amount")
_QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
_TAIL = {"p95": 0.95, "p99": 0.99, "p999": 0.999}


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column_name", "column_value"
    )


def profile_shape(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, with the table's row and column count."""
    fields = F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
            )
            for position, field in enumerate(df.schema.fields, 1)
        ]
    )
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select(
        F.inline(fields), "row_count", F.lit(len(df.columns)).alias("column_count")
    )


def profile_preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """First rows in the order of all columns, so the answer does not depend on file order."""
    return df.orderBy(C.PICKUP, *[c for c in df.columns if c != C.PICKUP]).limit(rows)


def profile_describe(df: DataFrame) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum per numeric column.

    The moments of all columns are one aggregation over the rows as they are; only the quartiles
    need a row for each value. Means are plain double means, so values of any size keep their digits.
    """
    columns = _numeric(df)

    def moments_of(name: str) -> Column:
        value = F.col(f"`{name}`").cast("double")
        return F.struct(
            F.lit(name).alias("column_name"),
            F.count(value).alias("value_count"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        )

    moments = df.agg(F.array(*map(moments_of, columns)).alias("_columns")).select(F.inline("_columns"))
    quartiles = exact_percentiles(_long(df, columns), "column_value", _QUARTILES, ["column_name"])
    return moments.join(quartiles, "column_name", "left").select(
        "column_name", "value_count", "mean", "std", "min", *_QUARTILES, "max"
    )


def profile_nulls(df: DataFrame) -> DataFrame:
    """Missing values per column, in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column_name", "null_count")


def profile_rule_counts(df: DataFrame) -> DataFrame:
    """Raw, overlapping counts of four rules; a dropoff equal to the pickup is not counted here."""
    return df.agg(
        F.count_if(slv_006()).alias("negative_fares"),
        F.count_if(slv_004()).alias("negative_distances"),
        F.count_if(slv_005()).alias("invalid_passengers"),
        F.count_if(F.col(C.DROPOFF) < F.col(C.PICKUP)).alias("dropoff_before_pickup"),
    )


def profile_quantiles(df: DataFrame, column: str = "trip_distance") -> DataFrame:
    return exact_percentiles(df, column, _TAIL)


def profile_ranges(df: DataFrame) -> DataFrame:
    """Range and mean per measure, earliest and latest timestamps."""
    columns: list[Column] = []
    for name in _RANGED:
        columns += [
            F.min(name).alias(f"min_{name}"),
            F.max(name).alias(f"max_{name}"),
            exact_avg(name).alias(f"avg_{name}"),
        ]
    for name, label in ((C.PICKUP, "pickup"), (C.DROPOFF, "dropoff")):
        columns += [F.min(name).alias(f"earliest_{label}"), F.max(name).alias(f"latest_{label}")]
    return df.agg(*columns)
