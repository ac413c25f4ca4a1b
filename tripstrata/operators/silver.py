"""Row-quality rules: which trips are kept, and why the others are not.

Every rule is a boolean column that is never NULL: a comparison with a missing value does not
hold, so a trip with an unknown passenger count passes that rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from .. import schemas
from ..functions.times import period_year
from ..session import stored


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def slv_001() -> Column:
    return F.col(C.PICKUP).isNull()


def slv_002() -> Column:
    return F.col(C.DROPOFF).isNull()


def slv_003() -> Column:
    return _holds(F.col(C.DROPOFF) <= F.col(C.PICKUP))


def slv_004() -> Column:
    return _holds(F.col("trip_distance") < 0)


def slv_005() -> Column:
    return _holds(F.col("passenger_count") <= 0)


def slv_006() -> Column:
    return _holds(F.col("fare_amount") < 0)


def slv_007() -> Column:
    return _holds(F.col("total_amount") < 0)


def slv_008() -> Column:
    return _holds(F.year(C.PICKUP) != period_year(F.col("period")))


def slv_009() -> Column:
    return _holds(F.year(C.DROPOFF) < period_year(F.col("period")))


def slv_010() -> Column:
    return _holds(F.col("trip_distance") > C.MAX_TRIP_DISTANCE)


RULES = {
    rule.__name__: rule
    for rule in (slv_001, slv_002, slv_003, slv_004, slv_005, slv_006, slv_007, slv_008, slv_009, slv_010)
}

_BREAKS = {
    C.INVALID_TIMESTAMPS: lambda: slv_001() | slv_002() | slv_003(),
    C.DISTANCE_OUTLIERS: lambda: slv_004() | slv_010(),
    C.INVALID_PASSENGER_COUNT: slv_005,
    C.NEGATIVE_FARES: slv_006,
    C.NEGATIVE_TOTAL_AMOUNTS: slv_007,
}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers as NULL: Spark sorts NaN above every number, so ``NaN > 100`` would hold."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(
        *[F.nanvl(name, F.lit(None).cast("double")).alias(name) if name in doubles else F.col(name) for name in df.columns]
    )


def category() -> Column:
    """First category in priority order whose rules the row breaks, NULL for a good row."""
    return F.coalesce(*[F.when(_BREAKS[name](), name) for name in C.CATEGORIES])


def tier() -> Column:
    """``rejected`` or ``quarantined`` for a row that has a category."""
    rejected = (F.col("category") == C.INVALID_TIMESTAMPS) | (
        (F.col("category") == C.DISTANCE_OUTLIERS) & slv_004()
    )
    return F.when(rejected, "rejected").when(F.col("category").isNotNull(), "quarantined")


def with_category(bronze: DataFrame) -> DataFrame:
    return bronze.withColumn("category", category())


def with_tier(bronze: DataFrame) -> DataFrame:
    return with_category(bronze).withColumn("tier", tier())


def _flags() -> dict[str, Column]:
    return {C.PICKUP_YEAR_FLAG: slv_008(), C.DROPOFF_YEAR_FLAG: slv_009()}


def _accepted() -> Column:
    """No rule of any category is broken. As one condition a category, so that a reader or a join takes those it can
    judge by itself, before rows are moved; ``category().isNull()`` is a single condition that waits for all columns."""
    return reduce(lambda a, b: a & b, [~_BREAKS[name]() for name in C.CATEGORIES])


def silver_accepted(bronze: DataFrame) -> DataFrame:
    """Good rows with both year flags."""
    kept = bronze.where(_accepted())
    return kept.withColumns(_flags()).select(*[f.name for f in schemas.SILVER_TABLE.fields])


def quarantine_rows(bronze: DataFrame) -> DataFrame:
    """Every other row, rejected ones included, with its category."""
    return with_category(bronze).where(F.col("category").isNotNull())


def with_outcome(bronze: DataFrame) -> DataFrame:
    """All rows with ``outcome`` (accepted or the category); flags are set on accepted rows only.

    One narrow pass: this is what the Silver write stores, partitioned by outcome and period.
    """
    outcome = F.coalesce(category(), F.lit(C.ACCEPTED))
    flags = {name: F.when(F.col("outcome") == C.ACCEPTED, flag) for name, flag in _flags().items()}
    return (
        bronze.withColumn("outcome", outcome)
        .withColumns(flags)
        .select(*[f.name for f in schemas.ROUTED_TABLE.fields])
    )


def exclude_year_mismatch(silver: DataFrame) -> DataFrame:
    return silver.where(~F.col(C.PICKUP_YEAR_FLAG))


def has_congestion() -> Column:
    return F.coalesce(F.col("congestion_surcharge"), F.lit(0.0)) > 0


def trips_of_day(silver: DataFrame, day) -> DataFrame:
    """Trips picked up on one date. Catalyst turns the comparison into a pushed timestamp range."""
    return silver.where(F.to_date(C.PICKUP) == F.lit(day).cast("date"))


def monitor_nulls(bronze: DataFrame) -> DataFrame:
    """Missing values of the monitored columns per period."""
    return bronze.groupBy("period").agg(
        *[F.count_if(F.col(name).isNull()).alias(name) for name in C.MONITORED_COLUMNS]
    )


def duplicate_count(bronze: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per period, rows beyond the first among rows equal in every column (NULL equals NULL).

    Comparing whole rows would shuffle the whole table. A first job shuffles one hash per row and
    stores the hashes that occur more than once; rows with any other hash have no copy. The stored
    file size then decides whether those hashes are broadcast. Candidates are compared in full, so
    a collision is not counted. Both aggregations combine before they shuffle: one row copied a
    billion times costs no more than any other.
    """
    columns = columns or [f.name for f in schemas.BRONZE.fields]
    rows = bronze.select("period", *columns).withColumn("_hash", F.xxhash64("period", *columns))
    repeated = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_hash")
    candidates = rows.join(stored(repeated, "row-hashes"), "_hash", "left_semi")
    return (
        candidates.groupBy("period", *columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("period")
        .agg(F.sum(F.col("_n") - 1).alias("duplicate_records"))
        .where(F.col("duplicate_records") > 0)
    )


def quality_report(rows: DataFrame) -> DataFrame:
    """One report row per period from Bronze rows, or from stored rows that carry ``outcome``."""
    routed = rows if "outcome" in rows.columns else with_outcome(rows)
    outcome, accepted = F.col("outcome"), F.col("outcome") == C.ACCEPTED
    rejected = (outcome == C.INVALID_TIMESTAMPS) | ((outcome == C.DISTANCE_OUTLIERS) & slv_004())

    def count(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    counted = routed.groupBy("period").agg(
        F.count(F.lit(1)).alias("records_processed"),
        count(accepted, "records_accepted"),
        count(rejected, "records_rejected"),
        count(~accepted & ~rejected, "records_quarantined"),
        count(outcome == C.INVALID_TIMESTAMPS, "invalid_timestamps"),
        count(outcome == C.NEGATIVE_FARES, "negative_fares"),
        count(outcome == C.INVALID_PASSENGER_COUNT, "invalid_passenger_counts"),
        count(outcome == C.DISTANCE_OUTLIERS, "distance_outliers"),
        count(outcome == C.NEGATIVE_TOTAL_AMOUNTS, "negative_total_amounts"),
        count(F.col(C.PICKUP_YEAR_FLAG), "records_flagged_pickup_year_mismatch"),
        count(F.col(C.DROPOFF_YEAR_FLAG), "records_flagged_dropoff_year_mismatch"),
        F.struct(*[count(F.col(name).isNull(), name) for name in C.MONITORED_COLUMNS]).alias(
            "missing_value_counts"
        ),
    )
    report = counted.join(duplicate_count(rows), "period", "left").withColumn(
        "duplicate_records", F.coalesce("duplicate_records", F.lit(0).cast("bigint"))
    )
    return report.select(*[f.name for f in schemas.QUALITY_REPORT.fields])


# --- The four-rule prototype: overlapping sets, and missing values fail -----------------------


def prototype_silver(bronze: DataFrame) -> DataFrame:
    rules = (
        F.col(C.DROPOFF) > F.col(C.PICKUP),
        F.col("passenger_count") > 0,
        F.col("fare_amount") >= 0,
        F.col("trip_distance") >= 0,
    )
    return bronze.where(reduce(lambda a, b: a & b, rules))


def _prototype_breaks() -> dict[str, Column]:
    return {
        "negative_fares": slv_006(),
        "invalid_passengers": slv_005(),
        C.INVALID_TIMESTAMPS: _holds(F.col(C.DROPOFF) < F.col(C.PICKUP)),
    }


def prototype_quarantine(bronze: DataFrame) -> DataFrame:
    """A row appears once for each of the three rules it breaks."""
    broken = F.array(*[F.when(hit, name) for name, hit in _prototype_breaks().items()])
    return bronze.withColumn("rule", F.explode(F.array_compact(broken)))


def prototype_report(bronze: DataFrame) -> DataFrame:
    breaks = _prototype_breaks()
    valid = (
        (F.col(C.DROPOFF) > F.col(C.PICKUP))
        & (F.col("passenger_count") > 0)
        & (F.col("fare_amount") >= 0)
        & (F.col("trip_distance") >= 0)
    )
    return bronze.agg(
        F.count(F.lit(1)).alias("records_processed"),
        F.count_if(valid).alias("records_valid"),
        *[F.count_if(hit).alias(name) for name, hit in breaks.items()],
        F.count_if(slv_004()).alias("negative_distances"),
    ).withColumn("records_quarantined", F.col("records_processed") - F.col("records_valid"))
