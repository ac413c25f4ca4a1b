"""Times the pipeline and the headline queries; prints one JSON line.

    BENCH_SF_DIR   test tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_RUNS     timed runs per query after one warm-up (default 3); the median counts

The trips are written to a landing folder once, outside the timing. ``ingest`` and ``silver`` then
build the lake, and the other queries read it, as they would in production. Results go to a sink
that reads every row and column; rows in and out are reported beside the times.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tripstrata import constants as C  # noqa: E402
from tripstrata.operators import adhoc, features, gold, model, profile, replay, runlog, service, silver  # noqa: E402
from tripstrata.plans import pipeline  # noqa: E402
from tripstrata.session import build_session  # noqa: E402
from tripstrata.sources import adapters, lake  # noqa: E402
from tripstrata.streaming import ticks, trips  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work: Callable[[], object]) -> float:
    started = time.perf_counter()
    work()
    return time.perf_counter() - started


def main() -> None:
    work = tempfile.mkdtemp(prefix="run-bench-")
    spark = build_session(
        "tripstrata-bench",
        master=f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            # Listing hundreds of local folders is quicker in the driver than as a Spark job.
            "spark.sql.sources.parallelPartitionDiscovery.threshold": "4096",
            "spark.checkpoint.dir": f"{work}/checkpoints",
            "spark.sql.warehouse.dir": f"{work}/warehouse",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    landing, root = f"{work}/landing", f"{work}/lake"
    adapters.bronze(spark, SF_DIR).repartition("period").write.partitionBy("period").parquet(landing)

    times: dict[str, float] = {}
    once = {
        "ingest": lambda: pipeline.run_ingest(spark, landing, root),
        "silver": lambda: pipeline.run_silver(spark, root),
        "gold": lambda: pipeline.run_gold(spark, root),
        "features": lambda: pipeline.run_features(spark, root, rollup=spark.read.parquet(f"{root}/trip_rollup")),
    }
    # Stages write, so every run does the same work again; the first one builds the lake.
    for name, stage in once.items():
        first = timed(stage)
        times[name] = statistics.median([timed(stage) for _ in range(RUNS)]) if RUNS else first

    bronze, trips_ = lake.load_bronze(spark, root), lake.load_silver(spark, root)
    events = adapters.table(spark, SF_DIR, "events")
    runs, log, arrivals = adapters.run_log(events), adapters.request_log(events), adapters.arrivals(events)
    requests = trips_.select(F.col(C.DROPOFF_ZONE).alias(C.PICKUP_ZONE), F.hour(C.PICKUP).alias("pickup_hour"))
    stored_features = lake.read_gold(spark, root, C.FEATURE_TABLE)
    for name in ("orders", "customer", "nation"):
        adapters.table(spark, SF_DIR, name).createOrReplaceTempView(name)
    joined = """
        SELECT n.n_name, o.o_orderstatus, COUNT(*) AS orders
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        GROUP BY n.n_name, o.o_orderstatus
    """
    queries: dict[str, Callable[[], object]] = {
        "routing": lambda: drain(silver.with_outcome(bronze)),
        "quality_report": lambda: drain(silver.quality_report(bronze)),
        "duplicate_count": lambda: drain(silver.duplicate_count(bronze)),
        "daily_revenue": lambda: drain(gold.daily_revenue(trips_)),
        "hourly_demand": lambda: drain(gold.hourly_demand(trips_)),
        "zone_stats": lambda: drain(gold.zone_stats(trips_)),
        "congestion_metrics": lambda: drain(gold.congestion_metrics(trips_)),
        "zone_hour_features": lambda: drain(features.zone_hour_features(trips_)),
        "feature_lookup": lambda: drain(features.feature_lookup(requests, stored_features)),
        "profile_describe": lambda: drain(profile.profile_describe(bronze)),
        "profile_quantiles": lambda: drain(profile.profile_quantiles(bronze)),
        "replay_select": lambda: drain(replay.replay_select(trips_, limit=C.REPLAY_MAX_LIMIT)),
        "replay_day": lambda: drain(replay.replay_schedule(replay.replay_select(trips_, limit=None))),
        "stream_hourly_batch": lambda: drain(trips.stream_hourly(trips_)),
        "live_ticks": lambda: drain(ticks.live_ticks(arrivals)),
        "etl_health": lambda: drain(runlog.etl_health(runs)),
        "months_ingested": lambda: drain(runlog.months_ingested(runs)),
        "svc_latency_percentiles": lambda: drain(service.svc_latency_percentiles(log)),
        "svc_error_rate": lambda: drain(service.svc_error_rate(log)),
        "run_sql": lambda: adhoc.run_sql(spark, joined),
    }
    for name, query in queries.items():
        query()
        times[name] = statistics.median([timed(query) for _ in range(max(RUNS, 1))])

    replay.replay_publish(trips_.drop("period"), f"{work}/topic")

    def drain_stream() -> None:
        out = tempfile.mkdtemp(prefix="stream-", dir=work)
        hourly = trips.stream_hourly(trips.stream_trips(spark, f"{work}/topic"))
        trips.start_hourly(hourly, f"{out}/hours", f"{out}/checkpoint", "append", True).awaitTermination()

    fitted: list = []
    late = {
        "stream_drain": drain_stream,
        "model_fit": lambda: fitted.append(model.train_fare_model(trips_)),
        "score_fares": lambda: drain(model.score_fares(fitted[0][0], trips_)),
    }
    for name, work_ in late.items():
        work_()
        times[name] = statistics.median([timed(work_) for _ in range(max(RUNS, 1))])
    quality = fitted[0][1]

    rows = {
        "bronze": bronze.count(),
        "silver": trips_.count(),
        "events": events.count(),
        **{name: lake.read_gold(spark, root, name).count() for name in (*C.GOLD_TABLES, C.FEATURE_TABLE)},
        "model_sample": quality["rows"],
    }
    result = {
        "metric": "total wall-clock of pipeline stages and headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {name: round(seconds, 3) for name, seconds in times.items()},
        "sf": Path(SF_DIR).name.removeprefix("sf"),
        "cpus": int(CPUS),
        "rows": rows,
        "model": {name: round(quality[name], 4) for name in ("mae", "rmse", "r2")},
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
