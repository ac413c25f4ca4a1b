"""Trip, run-log and request-log views over the generic test tables.

The tables hold no trips, so these views derive some that fire every rule. They use integer
arithmetic only, hold one join between the two big tables, and never read a table twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.silver import with_outcome, silver_accepted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hits(column: str, modulus: int, rest: int = 0) -> Column:
    return F.col(column) % modulus == rest


def _pick(hit: Column, then: Column, otherwise: Column) -> Column:
    return F.when(hit, then).otherwise(otherwise)


def bronze_trips(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The 19 raw columns and ``period``; ``lineitem`` may be a stream."""
    joined = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)

    clock = F.make_dt_interval(
        hours=((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 24).cast("int"),
        mins=(F.col("l_suppkey") % 60).cast("int"),
    )
    on_time = F.col("o_orderdate") + clock
    pickup = _pick(_hits("l_partkey", 211), on_time - F.make_ym_interval(F.lit(10)), on_time)
    direction = F.when(_hits("l_partkey", 97), -1).when(_hits("l_partkey", 89), 0).otherwise(1)
    ride = F.make_dt_interval(mins=(direction * (F.col("l_quantity") + 5)).cast("int"))

    unknown = F.col("l_linenumber") == 7
    price = F.col("l_extendedprice") / 1000
    refund = (F.col("l_returnflag") == "R") & _hits("l_partkey", 13)

    def known(value: Column) -> Column:
        return F.when(~unknown, value)

    columns = {
        "VendorID": (F.col("l_linenumber") % 2 + 1).cast("int"),
        C.PICKUP: F.when(~_hits("l_partkey", 499, 1), F.col("_pickup")),
        C.DROPOFF: F.when(~_hits("l_partkey", 499, 2), F.col("_pickup") + ride),
        "passenger_count": known(
            F.when(F.col("l_linenumber") == 6, 0.0).otherwise(F.col("l_linenumber").cast("double"))
        ),
        "trip_distance": F.when(_hits("l_partkey", 103), -F.col("l_quantity"))
        .when(_hits("l_partkey", 101), F.col("l_quantity") + 100)
        .otherwise(F.col("l_quantity") / 4),
        "RatecodeID": known((F.col("l_partkey") % 6 + 1).cast("double")),
        "store_and_fwd_flag": known(_pick(F.col("l_linestatus") == "O", F.lit("Y"), F.lit("N"))),
        C.PICKUP_ZONE: (F.col("l_suppkey") % 263 + 1).cast("int"),
        C.DROPOFF_ZONE: (F.col("l_partkey") % 263 + 1).cast("int"),
        "payment_type": (F.col("l_partkey") % 4 + 1).cast("bigint"),
        "fare_amount": _pick(refund, -price, price),
        "extra": (F.col("l_partkey") % 3).cast("double") / 2,
        "mta_tax": F.lit(0.5),
        "tip_amount": price * F.col("l_discount"),
        "tolls_amount": _pick(_hits("l_suppkey", 10), F.lit(6.94), F.lit(0.0)),
        "improvement_surcharge": F.lit(1.0),
        "total_amount": _pick(_hits("l_partkey", 107), F.lit(-1.0), price * (F.lit(1) + F.col("l_tax"))),
        "congestion_surcharge": known(_pick(_hits("l_suppkey", 3), F.lit(2.5), F.lit(0.0))),
        "Airport_fee": known(_pick(_hits("l_suppkey", 25), F.lit(1.75), F.lit(0.0))),
        "period": F.substring(F.col("o_orderdate").cast("string"), 1, 7),
    }
    # The pickup comes out of the step that copies rows, so rules over it are judged behind that step, on a value
    # made once; a filter that is pushed into the join would work out the pickup again wherever a rule names it.
    copies = F.array_repeat(pickup, _pick(_hits("l_partkey", 499, 3), F.lit(2), F.lit(1)))
    return joined.withColumn("_pickup", F.explode(copies)).select(
        *[value.alias(name) for name, value in columns.items()]
    )


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze_trips(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_outcome(bronze(spark, sf_dir))


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_accepted(bronze(spark, sf_dir))


def run_log(events: DataFrame) -> DataFrame:
    number = F.col("event_id")
    job = (
        F.when(F.col("event_type") == "signup", "ingest")
        .when(F.col("event_type") == "view", "silver")
        .when(F.col("event_type") == "click", "gold")
        .when(F.col("event_type") == "purchase", "train")
        .otherwise("features")
    )
    status = F.lit("succeeded")
    for rest, name in enumerate(("failed", "partial", "queued", "running", "cancelled")):
        status = F.when(number % 10 == rest, name).otherwise(status)
    first = number % 8 + 1
    months = F.format_string('{"start":"2024-%02d","end":"2024-%02d"}', first, first + number % 2)
    params = (
        F.when(F.col("job_type") != "ingest", "{}")
        .when(number % 50 == 0, "{}")
        .when(number % 50 == 5, "not json")
        .otherwise(months)
    )
    metrics = F.format_string('{"mae":%d,"rmse":%d,"r2":0.5}', F.col("user_id"), F.col("user_id") * 2)
    runtime = F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)"))
    queued = F.col("status") == "queued"
    return (
        events.withColumns({"job_type": job, "status": status})
        .withColumn("started_at", F.when(~queued, F.col("ts") + F.expr("interval 1 second")))
        .select(
            number.cast("string").alias("id"),
            "job_type",
            "status",
            params.alias("params"),
            F.col("ts").alias("submitted_at"),
            "started_at",
            F.when(F.col("status") != "running", F.col("started_at") + runtime).alias("finished_at"),
            F.lit(None).cast("int").alias("exit_code"),
            F.lit(None).cast("string").alias("error"),
            F.lit(None).cast("string").alias("log_output"),
            F.when(F.col("job_type") != "gold", F.col("user_id") * 1000).alias("rows_processed"),
            F.when(F.col("job_type") == "train", metrics).alias("metrics"),
        )
    )


def request_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").alias("requested_at"),
        F.col("event_type").alias("handler"),
        F.when(F.col("event_type") == "error", "5xx").otherwise("2xx").alias("status"),
        (F.col("value") / 1000).alias("duration_s"),
    )


def arrivals(events: DataFrame) -> DataFrame:
    """Events as trips that arrive at ``ts``: one value stands for fare, total and distance."""
    value = F.col("value")
    return events.select(
        F.col("ts").alias("arrived_at"),
        value.alias("total_amount"),
        value.alias("fare_amount"),
        value.alias("trip_distance"),
    )


def topic_offsets(events: DataFrame) -> DataFrame:
    """Offsets per topic and partition, with one internal topic."""
    topic = F.when(F.col("event_type") == "error", "__error").otherwise(F.col("event_type"))
    return (
        events.groupBy(topic.alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"))
        .agg(F.min("event_id").alias("first_offset"), F.max("event_id").alias("last_offset"))
    )


def ingest_results(trips: DataFrame) -> DataFrame:
    """Per-period outcomes of an imagined ingest: the period's last digit decides."""
    digit = F.substring("period", -1, 1)
    status = F.when(digit == "3", "REJECTED").when(digit == "7", "UNAVAILABLE").otherwise("OK")
    reason = F.when(status == "REJECTED", "schema").when(status == "UNAVAILABLE", "no file")
    return trips.groupBy("period").agg(F.count(F.lit(1)).alias("_rows")).select(
        "period",
        status.alias("status"),
        reason.alias("reason"),
        F.when(status == "OK", F.col("_rows")).alias("rows"),
        F.lit(None).cast("string").alias("bronze_path"),
    )


__all__ = [
    "arrivals",
    "bronze",
    "bronze_trips",
    "ingest_results",
    "request_log",
    "routed",
    "run_log",
    "silver",
    "table",
    "topic_offsets",
]
