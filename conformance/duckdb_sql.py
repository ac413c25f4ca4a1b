"""The same answers in DuckDB SQL, written by hand against the test tables."""

from __future__ import annotations

from conformance.adhoc_sql import ADHOC
from tripstrata import schemas

_BRONZE = """
WITH joined AS (
    SELECT l.*, o.o_orderdate,
           o.o_orderdate + to_hours((l.l_partkey * 7 + l.l_linenumber) % 24) + to_minutes(l.l_suppkey % 60) AS on_time,
           CASE WHEN l.l_partkey % 97 = 0 THEN -1 WHEN l.l_partkey % 89 = 0 THEN 0 ELSE 1 END AS direction
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
), copied AS (
    SELECT * FROM joined UNION ALL SELECT * FROM joined WHERE l_partkey % 499 = 3
), started AS (
    SELECT *, CASE WHEN l_partkey % 211 = 0 THEN on_time - INTERVAL 10 YEAR ELSE on_time END AS pu0 FROM copied
), bronze AS (
    SELECT CAST(l_linenumber % 2 + 1 AS INTEGER) AS "VendorID",
           CASE WHEN l_partkey % 499 = 1 THEN NULL ELSE pu0 END AS tpep_pickup_datetime,
           CASE WHEN l_partkey % 499 = 2 THEN NULL
                ELSE pu0 + to_minutes(CAST(direction * (l_quantity + 5) AS BIGINT)) END AS tpep_dropoff_datetime,
           CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 0.0
                ELSE CAST(l_linenumber AS DOUBLE) END::DOUBLE AS passenger_count,
           CASE WHEN l_partkey % 103 = 0 THEN -l_quantity WHEN l_partkey % 101 = 0 THEN l_quantity + 100
                ELSE l_quantity / 4 END AS trip_distance,
           CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_partkey % 6 + 1 AS DOUBLE) END AS "RatecodeID",
           CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'O' THEN 'Y' ELSE 'N' END AS store_and_fwd_flag,
           CAST(l_suppkey % 263 + 1 AS INTEGER) AS "PULocationID",
           CAST(l_partkey % 263 + 1 AS INTEGER) AS "DOLocationID",
           CAST(l_partkey % 4 + 1 AS BIGINT) AS payment_type,
           CASE WHEN l_returnflag = 'R' AND l_partkey % 13 = 0 THEN -(l_extendedprice / 1000)
                ELSE l_extendedprice / 1000 END AS fare_amount,
           CAST(l_partkey % 3 AS DOUBLE) / 2 AS extra,
           0.5::DOUBLE AS mta_tax,
           l_extendedprice / 1000 * l_discount AS tip_amount,
           CASE WHEN l_suppkey % 10 = 0 THEN 6.94::DOUBLE ELSE 0.0::DOUBLE END AS tolls_amount,
           1.0::DOUBLE AS improvement_surcharge,
           CASE WHEN l_partkey % 107 = 0 THEN -1.0::DOUBLE ELSE l_extendedprice / 1000 * (1 + l_tax) END AS total_amount,
           CASE WHEN l_linenumber = 7 THEN NULL WHEN l_suppkey % 3 = 0 THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END
               AS congestion_surcharge,
           CASE WHEN l_linenumber = 7 THEN NULL WHEN l_suppkey % 25 = 0 THEN 1.75::DOUBLE ELSE 0.0::DOUBLE END
               AS "Airport_fee",
           strftime(o_orderdate, '%Y-%m') AS period
    FROM started
)"""

_ROUTED = (
    _BRONZE
    + """, categorised AS (
    SELECT *,
           CASE WHEN tpep_pickup_datetime IS NULL OR tpep_dropoff_datetime IS NULL
                     OR tpep_dropoff_datetime <= tpep_pickup_datetime THEN 'invalid_timestamps'
                WHEN trip_distance < 0 OR trip_distance > 100 THEN 'distance_outliers'
                WHEN passenger_count <= 0 THEN 'invalid_passenger_count'
                WHEN fare_amount < 0 THEN 'negative_fares'
                WHEN total_amount < 0 THEN 'negative_total_amounts' END AS category,
           CAST(substr(period, 1, 4) AS INTEGER) AS period_year
    FROM bronze
), silver AS (
    SELECT * EXCLUDE (category, period_year, period),
           year(tpep_pickup_datetime) <> period_year AS flag_pickup_year_mismatch,
           year(tpep_dropoff_datetime) < period_year AS flag_dropoff_year_mismatch,
           period
    FROM categorised WHERE category IS NULL
)"""
)


def _sum(column: str) -> str:
    return f"CAST(SUM(CAST({column} AS DECIMAL(18,8))) AS DOUBLE)"


def _avg(column: str) -> str:
    return f"{_sum(column)} / COUNT({column})"


def _bronze(query: str) -> str:
    return f"{_BRONZE}\n{query}"


def _silver(query: str) -> str:
    return f"{_ROUTED}\n{query}"


def _ctes(**named: str) -> str:
    return _ROUTED + "".join(f", {name} AS ({text})" for name, text in named.items())


_DAILY = f"""
SELECT CAST(tpep_pickup_datetime AS DATE) AS pickup_date, COUNT(*) AS trip_count,
       {_sum("total_amount")} AS total_revenue, {_sum("fare_amount")} AS total_fare,
       {_sum("tip_amount")} AS total_tips, {_avg("fare_amount")} AS avg_fare
FROM silver WHERE NOT flag_pickup_year_mismatch GROUP BY 1"""

_HOURLY = f"""
SELECT CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour, COUNT(*) AS trip_count,
       {_avg("fare_amount")} AS avg_fare, {_avg("trip_distance")} AS avg_trip_distance,
       {_avg("passenger_count")} AS avg_passenger_count
FROM silver GROUP BY 1"""


def _zones(column: str) -> str:
    return f"""
SELECT "{column}", COUNT(*) AS trip_count, {_sum("total_amount")} AS total_revenue,
       {_avg("fare_amount")} AS avg_fare, {_avg("trip_distance")} AS avg_trip_distance,
       {_avg("tip_amount")} AS avg_tip
FROM silver GROUP BY 1"""


_CONGESTION = f"""
SELECT CAST(tpep_pickup_datetime AS DATE) AS pickup_date, COUNT(*) AS trip_count,
       COUNT(*) FILTER (COALESCE(congestion_surcharge, 0) > 0) AS trips_with_congestion,
       {_sum("congestion_surcharge")} AS total_congestion_surcharge,
       CAST(COUNT(*) FILTER (COALESCE(congestion_surcharge, 0) > 0) AS DOUBLE) / COUNT(*) * 100
           AS congestion_trip_pct
FROM silver WHERE NOT flag_pickup_year_mismatch GROUP BY 1"""

_FEATURES = f"""
SELECT "PULocationID", CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour, COUNT(*) AS trip_count,
       {_avg("fare_amount")} AS avg_fare, {_avg("trip_distance")} AS avg_trip_distance,
       {_avg("tip_amount")} AS avg_tip, {_avg("passenger_count")} AS avg_passenger_count
FROM silver GROUP BY 1, 2"""

_TRAINING = """
SELECT trip_distance, "PULocationID", "DOLocationID", passenger_count,
       CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour, fare_amount
FROM silver
WHERE trip_distance IS NOT NULL AND "PULocationID" IS NOT NULL AND "DOLocationID" IS NOT NULL
  AND passenger_count IS NOT NULL AND tpep_pickup_datetime IS NOT NULL AND fare_amount IS NOT NULL"""

_LIVE = """
SELECT tpep_pickup_datetime AS pickup_at, tpep_dropoff_datetime AS dropoff_at,
       "PULocationID" AS pu_location_id, "DOLocationID" AS do_location_id,
       passenger_count, trip_distance, fare_amount, tip_amount, total_amount, payment_type
FROM silver"""

# The order of replayed trips: pickup, then every other Silver column.
_REPLAY_ORDER = """tpep_pickup_datetime, "VendorID", tpep_dropoff_datetime, passenger_count NULLS FIRST, trip_distance,
    "RatecodeID" NULLS FIRST, store_and_fwd_flag NULLS FIRST, "PULocationID", "DOLocationID", payment_type,
    fare_amount, extra, mta_tax, tip_amount, tolls_amount, improvement_surcharge, total_amount,
    congestion_surcharge NULLS FIRST, "Airport_fee" NULLS FIRST, flag_pickup_year_mismatch,
    flag_dropoff_year_mismatch, period"""
_BRONZE_ORDER = """tpep_pickup_datetime NULLS FIRST, "VendorID", tpep_dropoff_datetime NULLS FIRST,
    passenger_count NULLS FIRST, trip_distance, "RatecodeID" NULLS FIRST, store_and_fwd_flag NULLS FIRST,
    "PULocationID", "DOLocationID", payment_type, fare_amount, extra, mta_tax, tip_amount, tolls_amount,
    improvement_surcharge, total_amount, congestion_surcharge NULLS FIRST, "Airport_fee" NULLS FIRST, period"""

_LATEST_DAY = "SELECT CAST(MAX(tpep_pickup_datetime) AS DATE) AS max_pickup_date FROM silver"


def _replay(limit: int) -> str:
    return f"""SELECT * FROM silver
        WHERE CAST(tpep_pickup_datetime AS DATE) = (SELECT max_pickup_date FROM latest)
        ORDER BY {_REPLAY_ORDER} LIMIT {limit}"""


_COLUMNS = (
    ("VendorID", "int"),
    ("tpep_pickup_datetime", "timestamp_ntz"),
    ("tpep_dropoff_datetime", "timestamp_ntz"),
    ("passenger_count", "double"),
    ("trip_distance", "double"),
    ("RatecodeID", "double"),
    ("store_and_fwd_flag", "string"),
    ("PULocationID", "int"),
    ("DOLocationID", "int"),
    ("payment_type", "bigint"),
    ("fare_amount", "double"),
    ("extra", "double"),
    ("mta_tax", "double"),
    ("tip_amount", "double"),
    ("tolls_amount", "double"),
    ("improvement_surcharge", "double"),
    ("total_amount", "double"),
    ("congestion_surcharge", "double"),
    ("Airport_fee", "double"),
    ("period", "string"),
)
_NUMERIC = [name for name, kind in _COLUMNS if kind in ("int", "bigint", "double")]
_MONITORED = ("passenger_count", "RatecodeID", "store_and_fwd_flag", "congestion_surcharge", "Airport_fee")

_SHAPE = "\nUNION ALL\n".join(
    f"SELECT CAST({n} AS INTEGER) AS position, '{name}' AS column_name, '{kind}' AS data_type, "
    f"COUNT(*) AS row_count, CAST({len(_COLUMNS)} AS INTEGER) AS column_count FROM bronze"
    for n, (name, kind) in enumerate(_COLUMNS, 1)
)
_DESCRIBE = "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS column_name, COUNT("{name}") AS value_count,
       ROUND(AVG(CAST("{name}" AS DOUBLE)), 6) AS mean,
       ROUND(STDDEV_SAMP(CAST("{name}" AS DOUBLE)), 6) AS std, CAST(MIN("{name}") AS DOUBLE) AS "min",
       ROUND(QUANTILE_CONT(CAST("{name}" AS DOUBLE), 0.25), 6) AS p25,
       ROUND(QUANTILE_CONT(CAST("{name}" AS DOUBLE), 0.5), 6) AS p50,
       ROUND(QUANTILE_CONT(CAST("{name}" AS DOUBLE), 0.75), 6) AS p75,
       CAST(MAX("{name}") AS DOUBLE) AS "max" FROM bronze"""
    for name in _NUMERIC
)
_NULLS = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS column_name, COUNT(*) FILTER (\"{name}\" IS NULL) AS null_count FROM bronze"
    for name, _ in _COLUMNS
)
_RANGES = ", ".join(
    f"MIN({c}) AS min_{c}, MAX({c}) AS max_{c}, {_avg(c)} AS avg_{c}"
    for c in ("passenger_count", "trip_distance", "fare_amount", "total_amount")
)

_RULES = {
    "slv_001": "tpep_pickup_datetime IS NULL",
    "slv_002": "tpep_dropoff_datetime IS NULL",
    "slv_003": "tpep_dropoff_datetime <= tpep_pickup_datetime",
    "slv_004": "trip_distance < 0",
    "slv_005": "passenger_count <= 0",
    "slv_006": "fare_amount < 0",
    "slv_007": "total_amount < 0",
    "slv_008": "year(tpep_pickup_datetime) <> CAST(substr(period, 1, 4) AS INTEGER)",
    "slv_009": "year(tpep_dropoff_datetime) < CAST(substr(period, 1, 4) AS INTEGER)",
    "slv_010": "trip_distance > 100",
}
_TIER = """CASE WHEN category = 'invalid_timestamps' OR (category = 'distance_outliers' AND trip_distance < 0)
                THEN 'rejected' WHEN category IS NOT NULL THEN 'quarantined' END"""
_MONTH_LIST = """
SELECT strftime(m, '%Y-%m') AS period, CAST(year(m) AS INTEGER) AS "year", CAST(month(m) AS INTEGER) AS "month"
FROM months"""

_QUALITY = f"""
SELECT t.period, COUNT(*) AS records_processed,
       COUNT(*) FILTER (category IS NULL) AS records_accepted,
       COUNT(*) FILTER ({_TIER} = 'rejected') AS records_rejected,
       COUNT(*) FILTER ({_TIER} = 'quarantined') AS records_quarantined,
       COALESCE(ANY_VALUE(d.duplicate_records), 0) AS duplicate_records,
       COUNT(*) FILTER (category = 'invalid_timestamps') AS invalid_timestamps,
       COUNT(*) FILTER (category = 'negative_fares') AS negative_fares,
       COUNT(*) FILTER (category = 'invalid_passenger_count') AS invalid_passenger_counts,
       COUNT(*) FILTER (category = 'distance_outliers') AS distance_outliers,
       COUNT(*) FILTER (category = 'negative_total_amounts') AS negative_total_amounts,
       COUNT(*) FILTER (category IS NULL AND year(tpep_pickup_datetime) <> period_year)
           AS records_flagged_pickup_year_mismatch,
       COUNT(*) FILTER (category IS NULL AND year(tpep_dropoff_datetime) < period_year)
           AS records_flagged_dropoff_year_mismatch,
       {", ".join(f'COUNT(*) FILTER ("{c}" IS NULL) AS "missing_{c}"' for c in _MONITORED)}
FROM categorised t LEFT JOIN duplicates d ON d.period = t.period
GROUP BY t.period"""
_DUPLICATES = """
SELECT period, CAST(SUM(n - 1) AS BIGINT) AS duplicate_records
FROM (SELECT COUNT(*) AS n, * FROM bronze GROUP BY ALL) WHERE n > 1 GROUP BY period"""

_PROTOTYPE = """tpep_dropoff_datetime > tpep_pickup_datetime AND passenger_count > 0 AND fare_amount >= 0
    AND trip_distance >= 0"""

_RUNS = """
WITH typed AS (
    SELECT *, CASE event_type WHEN 'signup' THEN 'ingest' WHEN 'view' THEN 'silver' WHEN 'click' THEN 'gold'
                              WHEN 'purchase' THEN 'train' ELSE 'features' END AS job_type,
           CASE event_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'queued' WHEN 3 THEN 'running'
                              WHEN 4 THEN 'cancelled' ELSE 'succeeded' END AS status
    FROM events
), timed AS (
    SELECT *, CASE WHEN status <> 'queued' THEN ts + INTERVAL 1 SECOND END AS started_at FROM typed
), runs AS (
    SELECT CAST(event_id AS VARCHAR) AS id, job_type, status,
           CASE WHEN job_type <> 'ingest' OR event_id % 50 = 0 THEN '{}'
                WHEN event_id % 50 = 5 THEN 'not json'
                ELSE '{"start":"2024-0' || (event_id % 8 + 1) || '","end":"2024-0'
                     || (event_id % 8 + 1 + event_id % 2) || '"}' END AS params,
           ts AS submitted_at, started_at,
           CASE WHEN status NOT IN ('queued', 'running')
                THEN started_at + to_microseconds(CAST(ROUND(value * 1000000) AS BIGINT)) END AS finished_at,
           CAST(NULL AS INTEGER) AS exit_code, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS log_output,
           CASE WHEN job_type <> 'gold' THEN user_id * 1000 END AS rows_processed,
           CASE WHEN job_type = 'train'
                THEN '{"mae":' || user_id || ',"rmse":' || (2 * user_id) || ',"r2":0.5}' END AS metrics
    FROM timed
)"""


def _runs(query: str) -> str:
    return f"{_RUNS}\n{query}"


_HEALTH = """
SELECT job_type, COUNT(*) FILTER (status = 'succeeded') AS succeeded, COUNT(*) FILTER (status = 'partial') AS partial,
       COUNT(*) FILTER (status = 'failed') AS failed,
       CAST(SUM(epoch_us(finished_at) - epoch_us(started_at)) AS DOUBLE) / COUNT(finished_at) / 1000000
           AS avg_duration_seconds
FROM runs WHERE status IN ('succeeded', 'partial', 'failed') GROUP BY 1"""
_TRAINED = """
SELECT finished_at, id, CAST(json_extract(metrics, '$.mae') AS DOUBLE) AS mae,
       CAST(json_extract(metrics, '$.rmse') AS DOUBLE) AS rmse, CAST(json_extract(metrics, '$.r2') AS DOUBLE) AS r2
FROM runs WHERE job_type = 'train' AND status = 'succeeded' AND metrics IS NOT NULL"""

_REQUESTS = """
WITH requests AS (
    SELECT ts AS requested_at, event_type AS handler,
           CASE WHEN event_type = 'error' THEN '5xx' ELSE '2xx' END AS status, value / 1000 AS duration_s,
           time_bucket(INTERVAL 5 MINUTE, ts) AS w5, time_bucket(INTERVAL 1 MINUTE, ts) AS w1
    FROM events
)"""


def _requests(query: str) -> str:
    return f"{_REQUESTS}\n{query}"


def _quantile(column: str, p: str) -> str:
    return f"ROUND(QUANTILE_CONT({column}, {p}), 9)"


_TICKS = f"""
WITH bounds AS (
    SELECT MIN(time_bucket(INTERVAL 2 SECOND, ts)) AS first_tick, MAX(time_bucket(INTERVAL 2 SECOND, ts)) AS last_tick
    FROM events
), every AS (
    SELECT UNNEST(generate_series(first_tick, last_tick, INTERVAL 2 SECOND)) AS tick FROM bounds
), filled AS (
    SELECT time_bucket(INTERVAL 2 SECOND, ts) AS tick, COUNT(*) AS trip_count, {_sum("value")} AS total
    FROM events GROUP BY 1
), ticks AS (
    SELECT every.tick, COALESCE(trip_count, 0) AS trip_count, COALESCE(total, 0) AS total,
           CASE WHEN trip_count > 0 THEN total / trip_count ELSE 0 END AS mean
    FROM every LEFT JOIN filled ON every.tick = filled.tick
)"""

# ROUND on a double, and a direct cast to a long DECIMAL, multiply first, which turns a value just under
# a half into a half. The cast through text keeps every digit.
_ONLINE_MEANS = ", ".join(
    f"'{c}', CAST(ROUND(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38,18)), 4) AS DOUBLE)"
    for c in ("avg_fare", "avg_trip_distance", "avg_tip", "avg_passenger_count")
)

ORACLE: dict[str, str] = {
    # Sources and sinks
    "list_periods": _bronze(
        """SELECT DISTINCT CAST(substr(period, 1, 4) AS INTEGER) AS "year", CAST(substr(period, 6, 2) AS INTEGER) AS "month"
           FROM bronze"""
    ),
    "month_range": f"""
        WITH bounds AS (SELECT date_trunc('month', MIN(o_orderdate)) AS a, date_trunc('month', MAX(o_orderdate)) AS b
                        FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
        months AS (SELECT UNNEST(generate_series(a, b, INTERVAL 1 MONTH)) AS m FROM bounds)
        {_MONTH_LIST}""",
    "ingest_rollup": _bronze(
        """, per_period AS (SELECT period, COUNT(*) AS n, substr(period, 7, 1) AS digit FROM bronze GROUP BY period),
        results AS (
            SELECT period, CASE digit WHEN '3' THEN 'REJECTED' WHEN '7' THEN 'UNAVAILABLE' ELSE 'OK' END AS status,
                   CASE digit WHEN '3' THEN 'schema' WHEN '7' THEN 'no file' END AS reason, n FROM per_period),
        counted AS (
            SELECT COUNT(*) FILTER (status = 'OK') AS good, COUNT(*) FILTER (status <> 'OK') AS bad,
                   CAST(COALESCE(SUM(n) FILTER (status = 'OK'), 0) AS BIGINT) AS ok_rows,
                   STRING_AGG(period || ': ' || status || ' (' || reason || ')', '; ' ORDER BY period)
                       FILTER (status <> 'OK') AS errors
            FROM results)
        SELECT CASE WHEN bad = 0 THEN 'succeeded' WHEN good = 0 THEN 'failed' ELSE 'partial' END AS status,
               errors AS error, CASE WHEN bad = 0 OR good > 0 THEN ok_rows END AS rows_processed
        FROM counted"""
    ),
    "load_silver": _silver("SELECT * FROM silver"),
    "publish_online": _ctes(f=_FEATURES)
    + f"""
        SELECT 'features:zone:' || "PULocationID" || ':hour:' || pickup_hour AS key,
               CAST(json_object('trip_count', trip_count, {_ONLINE_MEANS}) AS VARCHAR) AS value
        FROM f""",
    # Silver rules
    **{name: _bronze(f"SELECT * FROM bronze WHERE {rule}") for name, rule in _RULES.items()},
    "monitor_nulls": _bronze(
        "SELECT period, "
        + ", ".join(f'COUNT(*) FILTER ("{c}" IS NULL) AS "{c}"' for c in _MONITORED)
        + " FROM bronze GROUP BY period"
    ),
    "rule_priority": _silver('SELECT period, category, COUNT(*) AS "rows" FROM categorised GROUP BY 1, 2'),
    "silver_accepted": _silver("SELECT * FROM silver"),
    "quarantine_rows": _silver("SELECT * EXCLUDE (period_year) FROM categorised WHERE category IS NOT NULL"),
    "reject_split": _silver(
        f'SELECT period, category, {_TIER} AS tier, COUNT(*) AS "rows" FROM categorised GROUP BY 1, 2, 3'
    ),
    "exclude_year_mismatch": _silver("SELECT * FROM silver WHERE NOT flag_pickup_year_mismatch"),
    "has_congestion": _silver(
        """SELECT congestion_surcharge, COALESCE(congestion_surcharge, 0) > 0 AS has_congestion, COUNT(*) AS "rows"
           FROM silver GROUP BY 1, 2"""
    ),
    "day_filter": _silver(
        "SELECT * FROM silver WHERE CAST(tpep_pickup_datetime AS DATE) = DATE '1996-01-02'"
    ),
    "drop_incomplete": _silver(_TRAINING),
    "prototype_silver": _bronze(f"SELECT * FROM bronze WHERE {_PROTOTYPE}"),
    "prototype_quarantine": _bronze(
        """SELECT *, 'negative_fares' AS rule FROM bronze WHERE fare_amount < 0
        UNION ALL SELECT *, 'invalid_passengers' FROM bronze WHERE passenger_count <= 0
        UNION ALL SELECT *, 'invalid_timestamps' FROM bronze WHERE tpep_dropoff_datetime < tpep_pickup_datetime"""
    ),
    "prototype_report": _bronze(
        f"""SELECT COUNT(*) AS records_processed, COUNT(*) FILTER ({_PROTOTYPE}) AS records_valid,
               COUNT(*) - COUNT(*) FILTER ({_PROTOTYPE}) AS records_quarantined,
               COUNT(*) FILTER (fare_amount < 0) AS negative_fares,
               COUNT(*) FILTER (passenger_count <= 0) AS invalid_passengers,
               COUNT(*) FILTER (tpep_dropoff_datetime < tpep_pickup_datetime) AS invalid_timestamps,
               COUNT(*) FILTER (trip_distance < 0) AS negative_distances
        FROM bronze"""
    ),
    "live_projection": _silver(_LIVE),
    # Aggregations
    "quality_report": _ctes(duplicates=_DUPLICATES) + _QUALITY,
    "duplicate_count": _bronze(_DUPLICATES),
    "daily_revenue": _silver(_DAILY),
    "hourly_demand": _silver(_HOURLY),
    "zone_stats": _silver(_zones("PULocationID")),
    "zone_stats_dropoff": _silver(_zones("DOLocationID")),
    "congestion_metrics": _silver(_CONGESTION),
    "run_gold": _ctes(d=_DAILY, h=_HOURLY, z=_zones("PULocationID"), c=_CONGESTION, f=_FEATURES)
    + "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, COUNT(*) AS table_rows, CAST(SUM(trip_count) AS BIGINT) AS trips FROM {cte}"
        for name, cte in (
            ("daily_revenue", "d"),
            ("hourly_demand", "h"),
            ("zone_stats", "z"),
            ("congestion_metrics", "c"),
            ("zone_hour_features", "f"),
        )
    ),
    "zone_hour_features": _silver(_FEATURES),
    "max_pickup_date": _silver(_LATEST_DAY),
    "dashboard_totals": _ctes(d=_DAILY, h=_HOURLY, c=_CONGESTION)
    + f"""
        SELECT COALESCE((SELECT {_sum("total_revenue")} FROM d), 0) AS total_revenue,
               CAST((SELECT SUM(trip_count) FROM d) AS BIGINT) AS daily_trips,
               CAST((SELECT SUM(trip_count) FROM h) AS BIGINT) AS hourly_trips,
               COALESCE((SELECT {_sum("total_congestion_surcharge")} FROM c), 0) AS total_congestion_surcharge""",
    # Sorts, limits, top-k
    "top_zones": _ctes(z=_zones("PULocationID")) + ' SELECT * FROM z ORDER BY trip_count DESC, "PULocationID" LIMIT 10',
    "revenue_last_14": _ctes(d=_DAILY) + " SELECT * FROM d ORDER BY pickup_date DESC LIMIT 14",
    "revenue_change_pct": _ctes(
        d=_DAILY,
        latest="SELECT pickup_date, COALESCE(total_revenue, 0) AS revenue FROM d ORDER BY pickup_date DESC LIMIT 14",
        placed="SELECT revenue, ROW_NUMBER() OVER (ORDER BY pickup_date) AS position, COUNT(*) OVER () AS n FROM latest",
        sums=f"""SELECT COUNT(*) AS days, {_sum("revenue")} AS total_revenue,
            {_sum("CASE WHEN position <= n // 2 THEN revenue END")} AS first_half,
            {_sum("CASE WHEN position > n // 2 THEN revenue END")} AS second_half FROM placed""",
    )
    + """
        SELECT *, CASE WHEN first_half <> 0 THEN (second_half - first_half) / first_half * 100 ELSE 0 END AS change_pct
        FROM sums WHERE days >= 2""",
    "latest_daily_kpis": _ctes(d=_DAILY, h=_HOURLY, c=_CONGESTION)
    + """
        SELECT (SELECT avg_fare FROM d ORDER BY pickup_date DESC LIMIT 1) AS latest_avg_fare,
               (SELECT congestion_trip_pct FROM c ORDER BY pickup_date DESC LIMIT 1) AS latest_congestion_pct,
               (SELECT avg_fare FROM h ORDER BY pickup_hour LIMIT 1) AS first_hour_avg_fare""",
    "replay_select": _ctes(latest=_LATEST_DAY) + " " + _replay(500),
    "replay_schedule_flat": _ctes(latest=_LATEST_DAY, chosen=_replay(5000))
    + f"""
        SELECT *, ROW_NUMBER() OVER (ORDER BY {_REPLAY_ORDER}) - 1 AS event_number,
               (ROW_NUMBER() OVER (ORDER BY {_REPLAY_ORDER}) - 1) / 40.0::DOUBLE AS send_at_s
        FROM chosen""",
    "replay_schedule_gap": _silver(
        """SELECT tpep_pickup_datetime, tpep_dropoff_datetime, "PULocationID", total_amount,
               CAST(epoch_us(tpep_pickup_datetime) - MIN(epoch_us(tpep_pickup_datetime)) OVER () AS DOUBLE)
                   / 3600000000.0::DOUBLE AS send_at_s
        FROM silver"""
    ),
    "replay_gaps": _ctes(
        times="SELECT tpep_pickup_datetime, COUNT(*) AS events FROM silver GROUP BY 1",
    )
    + """
        SELECT tpep_pickup_datetime, events,
               COALESCE(CAST(epoch_us(tpep_pickup_datetime)
                   - LAG(epoch_us(tpep_pickup_datetime)) OVER (ORDER BY tpep_pickup_datetime) AS DOUBLE)
                   / 3600000000.0::DOUBLE, 0) AS wait_s
        FROM times""",
    "gold_ordering": _silver(_HOURLY),
    "live_feed_last_n": _ctes(live=_LIVE)
    + """ SELECT * FROM live
        ORDER BY pickup_at DESC, dropoff_at DESC, pu_location_id DESC, do_location_id DESC,
                 passenger_count DESC NULLS LAST, trip_distance DESC, fare_amount DESC, tip_amount DESC,
                 total_amount DESC, payment_type DESC
        LIMIT 20""",
    "live_tick_history": f"""{_TICKS}
        SELECT tick + INTERVAL 2 SECOND AS window_ended_at, trip_count,
               trip_count / 2.0::DOUBLE AS messages_per_second, CAST(total AS DOUBLE) AS total_revenue,
               CAST(mean AS DOUBLE) AS avg_fare, CAST(mean AS DOUBLE) AS avg_distance
        FROM ticks ORDER BY tick DESC LIMIT 30""",
    # Streams
    "stream_hourly": _silver(
        f"""SELECT date_trunc('hour', tpep_pickup_datetime) AS window_start,
               date_trunc('hour', tpep_pickup_datetime) + INTERVAL 1 HOUR AS window_end,
               COUNT(*) AS trip_count, {_sum("total_amount")} AS revenue
        FROM silver GROUP BY 1, 2"""
    ),
    **dict.fromkeys(("live_tick", "live_tick_stream"), f"""{_TICKS}
        SELECT date_trunc('hour', tick) AS tick_hour, COUNT(*) AS ticks,
               COUNT(*) FILTER (trip_count = 0) AS empty_ticks, CAST(SUM(trip_count) AS BIGINT) AS trips,
               MAX(trip_count) / 2.0::DOUBLE AS max_rate, CAST(MAX(total) AS DOUBLE) AS max_revenue,
               CAST(MAX(mean) AS DOUBLE) AS max_avg_fare, CAST(MAX(mean) AS DOUBLE) AS max_avg_distance
        FROM ticks GROUP BY 1"""),
    "skip_malformed": _silver(
        """SELECT "PULocationID", COUNT(*) AS trips, MIN(tpep_pickup_datetime) AS first_pickup,
               MAX(total_amount) AS max_total, COUNT(passenger_count) AS known_passengers
        FROM silver WHERE "PULocationID" % 10 NOT IN (1, 2) GROUP BY 1"""
    ),
    "topic_stats": """
        WITH offsets AS (
            SELECT event_type AS topic, user_id % 4 AS p, MIN(event_id) AS a, MAX(event_id) AS b
            FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
        SELECT topic, COUNT(*) AS partitions, CAST(SUM(b - a) AS BIGINT) AS message_count FROM offsets GROUP BY 1""",
    # Model
    "regression_metrics": _ctes(t=_TRAINING)
    + """, scored AS (SELECT fare_amount AS y, trip_distance * 8 + passenger_count AS guess FROM t)
        SELECT ROUND(AVG(ABS(y - guess)), 6) AS mae, ROUND(SQRT(AVG((y - guess) * (y - guess))), 6) AS rmse,
               ROUND(1 - SUM((y - guess) * (y - guess)) / (VAR_POP(y) * COUNT(y)), 6) AS r2
        FROM scored""",
    "feature_lookup": _ctes(f=_FEATURES)
    + """
        SELECT s."DOLocationID" AS "PULocationID", CAST(hour(s.tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
               f.trip_count IS NOT NULL AS found, COUNT(*) AS requests, MAX(f.trip_count) AS trip_count,
               MAX(f.avg_fare) AS avg_fare, MAX(f.avg_tip) AS avg_tip
        FROM silver s
        LEFT JOIN f ON f."PULocationID" = s."DOLocationID" AND f.pickup_hour = hour(s.tpep_pickup_datetime)
        GROUP BY 1, 2, 3""",
    # Profiling
    "profile_shape": _bronze(_SHAPE),
    "profile_preview": _bronze(f"SELECT * FROM bronze ORDER BY {_BRONZE_ORDER} LIMIT 5"),
    "profile_describe": _bronze(_DESCRIBE),
    "profile_nulls": _bronze(_NULLS),
    "profile_rule_counts": _bronze(
        """SELECT COUNT(*) FILTER (fare_amount < 0) AS negative_fares,
               COUNT(*) FILTER (trip_distance < 0) AS negative_distances,
               COUNT(*) FILTER (passenger_count <= 0) AS invalid_passengers,
               COUNT(*) FILTER (tpep_dropoff_datetime < tpep_pickup_datetime) AS dropoff_before_pickup
        FROM bronze"""
    ),
    "profile_quantiles": _bronze(
        f"""SELECT {_quantile("trip_distance", "0.95")} AS p95, {_quantile("trip_distance", "0.99")} AS p99,
               {_quantile("trip_distance", "0.999")} AS p999 FROM bronze"""
    ),
    "profile_ranges": _bronze(
        f"""SELECT {_RANGES}, MIN(tpep_pickup_datetime) AS earliest_pickup, MAX(tpep_pickup_datetime) AS latest_pickup,
               MIN(tpep_dropoff_datetime) AS earliest_dropoff, MAX(tpep_dropoff_datetime) AS latest_dropoff
        FROM bronze"""
    ),
    # Run log
    "etl_health": _runs(_HEALTH),
    "etl_health_share": _runs(
        f""", health AS ({_HEALTH}), summed AS (
            SELECT *, CAST(GREATEST(succeeded + partial + failed, 1) AS DOUBLE) AS total FROM health)
        SELECT job_type, succeeded / total * 100 AS succeeded_pct, partial / total * 100 AS partial_pct,
               failed / total * 100 AS failed_pct
        FROM summed"""
    ),
    "train_metrics": _runs(f"SELECT finished_at, mae, rmse, r2 FROM ({_TRAINED})"),
    "latest_silver_rows": _runs(
        """SELECT rows_processed FROM runs
        WHERE job_type = 'silver' AND status = 'succeeded' AND rows_processed IS NOT NULL
        ORDER BY finished_at DESC, id DESC LIMIT 1"""
    ),
    "latest_fare_mae": _runs(f"SELECT mae FROM ({_TRAINED}) ORDER BY finished_at DESC, id DESC LIMIT 1"),
    "months_ingested": _runs(
        """, ranges AS (
            SELECT CASE WHEN json_valid(params) THEN json_extract_string(params, '$.start') END AS a,
                   CASE WHEN json_valid(params) THEN json_extract_string(params, '$.end') END AS b
            FROM runs WHERE job_type = 'ingest' AND status IN ('succeeded', 'partial')
        ), months AS (
            SELECT UNNEST(generate_series(CAST(a || '-01' AS TIMESTAMP), CAST(b || '-01' AS TIMESTAMP), INTERVAL 1 MONTH)) AS m
            FROM ranges WHERE a IS NOT NULL AND b IS NOT NULL)
        SELECT COUNT(DISTINCT m) AS months_ingested FROM months"""
    ),
    "list_runs": _runs(
        """, page AS (SELECT * FROM runs ORDER BY submitted_at DESC, id DESC LIMIT 20 OFFSET 40)
        SELECT *, (SELECT COUNT(*) FROM runs) > 60 AS has_more FROM page"""
    ),
    "get_run": _runs("SELECT * FROM runs WHERE id = '4711'"),
    "latest_run_per_type": _runs(
        """, newest AS (SELECT * FROM runs ORDER BY submitted_at DESC, id DESC LIMIT 10)
        SELECT * FROM newest QUALIFY ROW_NUMBER() OVER (PARTITION BY job_type ORDER BY submitted_at DESC, id DESC) = 1"""
    ),
    "run_status_signal": _runs(
        """SELECT id, status, CASE status WHEN 'succeeded' THEN 'good' WHEN 'failed' THEN 'crit' ELSE 'warn' END AS signal,
               CASE WHEN status = 'succeeded' THEN 'good' WHEN status IN ('failed', 'cancelled') THEN 'crit'
                    ELSE 'warn' END AS lineage_signal
        FROM runs"""
    ),
    "run_duration": _runs(
        """SELECT id, status, CASE WHEN started_at IS NOT NULL THEN GREATEST(0, CAST(FLOOR(
                   (epoch_us(COALESCE(finished_at, TIMESTAMP '2024-02-01 00:00:00')) - epoch_us(started_at))
                   / 1000000.0::DOUBLE + 0.5) AS BIGINT)) END AS duration_seconds
        FROM runs"""
    ),
    "clear_terminal_runs": _runs("SELECT * FROM runs WHERE status IN ('queued', 'running')"),
    # Service metrics
    "svc_requests_5m": _requests("SELECT w5 AS window_start, COUNT(*) AS requests FROM requests GROUP BY 1"),
    "svc_error_rate": _requests(
        """SELECT w5 AS window_start, COUNT(*) FILTER (status = '5xx') * 100.0::DOUBLE / COUNT(*) AS error_rate_pct
        FROM requests GROUP BY 1"""
    ),
    "svc_rate_by_handler": _requests(
        """SELECT w1 AS window_start, handler, COUNT(*) / 60.0::DOUBLE AS requests_per_second
        FROM requests GROUP BY 1, 2"""
    ),
    "svc_rate_by_status": _requests(
        """SELECT w5 AS window_start, status, COUNT(*) / 300.0::DOUBLE AS requests_per_second
        FROM requests GROUP BY 1, 2"""
    ),
    "svc_latency_percentiles": _requests(
        f"""SELECT w5 AS window_start, {_quantile("duration_s", "0.5")} AS p50, {_quantile("duration_s", "0.95")} AS p95,
               {_quantile("duration_s", "0.99")} AS p99
        FROM requests GROUP BY 1"""
    ),
    "svc_p95_by_handler": _requests(
        f"""SELECT w5 AS window_start, handler, {_quantile("duration_s", "0.95")} AS p95
        FROM requests GROUP BY 1, 2"""
    ),
    # Ad-hoc SQL: the dialects agree on these texts
    "run_sql": """SELECT o_orderkey, o_custkey, o_orderstatus, (SELECT COUNT(*) FROM orders) > 500 AS truncated
        FROM orders ORDER BY o_orderkey LIMIT 500""",
    **ADHOC,
}

# --- Samples by row hash ------------------------------------------------------------------------

_FEATURES = ("trip_distance", '"PULocationID"', '"DOLocationID"', "passenger_count", "pickup_hour", "fare_amount")


def _hashed(seed: int) -> str:
    parts = ", ".join(f"CAST(CAST(round_even(CAST({c} AS DOUBLE) * 1e8, 0) AS BIGINT) AS VARCHAR)" for c in _FEATURES)
    return f"SELECT *, md5(concat_ws('|', '{seed}', {parts})) AS h FROM ({ORACLE['drop_incomplete']})"


_IN_TEST = "CAST('0x' || substr(h, 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE < 0.2"
ORACLE["train_test_split"] = (
    f"SELECT * EXCLUDE (h), CASE WHEN {_IN_TEST} THEN 'test' ELSE 'train' END AS part FROM ({_hashed(43)})"
)
ORACLE["bounded_sample"] = f"SELECT * EXCLUDE (h) FROM ({_hashed(42)}) ORDER BY h LIMIT 3000"

_TRAINED = f"SELECT LEAST(COUNT(*), 300000) AS n FROM ({ORACLE['drop_incomplete']})"
ORACLE["train_fare_model_signal"] = _silver(
    """SELECT CAST(LEAST(COUNT(*), 300000) AS BIGINT) AS rows, true AS learned FROM silver
    WHERE trip_distance IS NOT NULL AND "PULocationID" IS NOT NULL AND "DOLocationID" IS NOT NULL
      AND passenger_count IS NOT NULL AND tpep_pickup_datetime IS NOT NULL"""
)
ORACLE["score_fares_walk"] = _silver(
    """SELECT trip_distance, "PULocationID", "DOLocationID", passenger_count,
           CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour, COUNT(*) AS trips, true AS agrees
    FROM silver GROUP BY ALL"""
)
ORACLE["log_run"] = f"""
    SELECT CAST(n + later AS BIGINT) AS rows, CAST(50 AS BIGINT) AS trees_asked,
           'trip_distance,PULocationID,DOLocationID,passenger_count,pickup_hour' AS features, true AS has_mae,
           CAST(50 AS BIGINT) AS trees, CAST(50 AS BIGINT) AS roots, CAST(50 AS BIGINT) AS leaves_over
    FROM ({_TRAINED}), (VALUES (0), (1)) AS runs(later)"""
ORACLE["latest_model"] = f"""
    SELECT CAST(n + 2 AS BIGINT) AS trained_on, scored
    FROM ({_TRAINED}), ({_silver("SELECT COUNT(*) AS scored FROM silver")})"""

# --- Files of the test tables ---------------------------------------------------------------------

_ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
ORACLE["storage_stats"] = " UNION ALL ".join(
    f"SELECT '{name}' AS layer, CAST(1 AS BIGINT) AS file_count, COUNT(*) AS total_rows, true AS has_bytes FROM {name}"
    for name in _ALL_TABLES
)
ORACLE["lake_inventory"] = " UNION ALL ".join(
    f"SELECT '{name}' AS layer, CAST(1 AS BIGINT) AS object_count, COUNT(*) > 0 AS has_bytes, true AS ordered FROM {name}"
    for name in _ALL_TABLES
)

# --- Round trips give back what the batch operator computes -----------------------------------------

ORACLE |= {
    "ingest_bronze": _bronze("SELECT * FROM bronze"),
    "write_silver": ORACLE["load_silver"],
    "write_quarantine": ORACLE["quarantine_rows"],
    "write_quality_report": ORACLE["quality_report"],
    "write_gold": ORACLE["hourly_demand"],
    "read_gold": ORACLE["daily_revenue"],
    "publish_table": ORACLE["daily_revenue"],
    "export_csv": ORACLE["daily_revenue"],
    # An hour is closed when the latest pickup is an hour past its end.
    "stream_sink": f"""
        WITH hours AS ({ORACLE["stream_hourly"]})
        SELECT * FROM hours WHERE window_end <= (SELECT MAX(window_start) FROM hours) - INTERVAL 1 HOUR""",
    "replay_day": _silver(
        f"""SELECT tpep_pickup_datetime, tpep_dropoff_datetime, "PULocationID", total_amount,
               ROW_NUMBER() OVER (ORDER BY {_REPLAY_ORDER}) - 1 AS event_number,
               (ROW_NUMBER() OVER (ORDER BY {_REPLAY_ORDER}) - 1) / 1000.0::DOUBLE AS send_at_s
        FROM (SELECT * REPLACE (TIMESTAMP '2024-01-05' + (tpep_pickup_datetime - date_trunc('day', tpep_pickup_datetime))
                                AS tpep_pickup_datetime) FROM silver)"""
    ),
    # A text is judged by its form; blanks in front of the form's words change nothing.
    "sql_guard": """
        WITH texts AS (
            SELECT event_id % 8 AS form, event_type, CAST(user_id AS VARCHAR) AS u FROM events
        ), judged AS (
            SELECT form, event_type, CASE form WHEN 0 THEN ' ' WHEN 7 THEN event_type WHEN 1 THEN event_type || u ELSE u END AS t,
                   CASE form WHEN 0 THEN 'SQL query cannot be empty.'
                             WHEN 4 THEN 'Only SELECT queries are allowed.'
                             WHEN 5 THEN 'Only SELECT queries are allowed.'
                             WHEN 6 THEN 'Only a single SQL statement is allowed.'
                             WHEN 7 THEN 'Only a single SQL statement is allowed.' END AS reason
            FROM texts
        )
        SELECT form, event_type, reason, COUNT(DISTINCT t) AS texts, COUNT(*) AS events FROM judged GROUP BY ALL""",
    "read_only_enforced": """
        SELECT event_type, COUNT(*) AS events, CAST(5 AS BIGINT) AS refused FROM events GROUP BY 1""",
}

ORACLE["schema_gate"] = _bronze(
    """SELECT period, CASE WHEN m = 2 THEN 'OK' ELSE 'REJECTED' END AS status,
           CASE m WHEN 0 THEN 'Missing expected columns: [''RatecodeID'', ''extra'']'
                  WHEN 1 THEN 'Dtype mismatch: VendorID: expected int, got bigint; extra: expected double, got string'
           END AS reason, CASE WHEN m = 2 THEN n END AS "rows"
    FROM (SELECT period, CAST(substr(period, 6, 2) AS INTEGER) % 3 AS m, COUNT(*) AS n FROM bronze GROUP BY ALL)"""
)

ORACLE["incremental_rollup"] = ORACLE["run_gold"]

# --- Streams, judged by their own logs --------------------------------------------------------------

_HALF = "CASE WHEN tpep_pickup_datetime < TIMESTAMP '1998-01-01' THEN 'first' ELSE 'second' END"

ORACLE |= {
    "stream_source": _silver("SELECT * EXCLUDE (period) FROM silver"),
    "replay_publish": _silver(
        """SELECT "PULocationID", COUNT(*) AS trips, MIN(tpep_pickup_datetime) AS first_pickup,
               MAX(total_amount) AS max_total FROM silver GROUP BY 1"""
    ),
    "offsets_and_stop": _silver(
        f"""SELECT {_HALF} AS publish, COUNT(*) AS trips, COUNT(*) AS trips_in_sink, CAST(0 AS BIGINT) AS files_lost,
               CAST(0 AS BIGINT) AS files_repeated FROM silver GROUP BY 1"""
    ),
    "tail_latest": _silver(
        "SELECT * EXCLUDE (period) FROM silver WHERE tpep_pickup_datetime >= TIMESTAMP '1998-01-01'"
    ),
    # An event meets the latest time of all batches but its own and the one before, less an hour.
    "late_data": """
        WITH dealt AS (
            SELECT ts, (event_id + CASE WHEN event_id % 11 = 0 THEN event_id % 7 * 100 ELSE 0 END) // 50 AS batch FROM events
        ), tops AS (SELECT batch, MAX(date_trunc('millisecond', ts)) AS latest FROM dealt GROUP BY 1),
        marks AS (
            SELECT batch, MAX(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)
                   - INTERVAL 1 HOUR AS watermark
            FROM tops
        ), judged AS (
            SELECT d.*, watermark, date_trunc('hour', ts) AS window_start,
                   COALESCE(date_trunc('hour', ts) + INTERVAL 1 HOUR <= watermark, false) AS late
            FROM dealt d JOIN marks USING (batch)
        )
        SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, COUNT(*) FILTER (NOT late) AS accepted,
               COUNT(*) FILTER (late) AS dropped, COUNT(DISTINCT CASE WHEN late THEN batch END) AS losing_batches,
               MAX((epoch_us(watermark) - epoch_us(ts)) // 1000000) FILTER (late) AS worst_lateness_s
        FROM judged GROUP BY ALL""",
}

# --- Catalog, preview, reset and bundles ------------------------------------------------------------

_GOLD_ORACLES = ("daily_revenue", "hourly_demand", "zone_stats", "congestion_metrics")
_GOLD_COLUMNS = [
    (name, place, field.name, field.dataType.simpleString())
    for name in _GOLD_ORACLES
    for place, field in enumerate(schemas.GOLD[name].fields, 1)
]
_OVERVIEW = {
    "daily_revenue": ("daily_revenue", 6),
    "hourly_demand": ("hourly_demand", 5),
    "top_zones": ("top_zones", 6),
    "congestion": ("congestion_metrics", 5),
    "model_metrics": ("train_metrics", 4),
    "etl_health": ("etl_health", 5),
}

ORACLE |= {
    # The declared layout of the published tables.
    "catalog": "SELECT * FROM (VALUES "
    + ", ".join(f"('{t}', CAST({n} AS INTEGER), '{c}', '{kind}')" for t, n, c, kind in _GOLD_COLUMNS)
    + ") AS c(table_name, position, column_name, data_type)",
    "dashboard_overview": " UNION ALL ".join(
        f"""SELECT '{dataset}' AS dataset, COUNT(*) AS "rows", CAST({columns} AS BIGINT) AS columns FROM ({ORACLE[name]})"""
        for dataset, (name, columns) in _OVERVIEW.items()
    ),
    "table_preview": " UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, COUNT(*) AS row_count, LEAST(COUNT(*), 20) AS sampled,
            CAST(0 AS BIGINT) AS strange, false AS failed FROM ({ORACLE[name]})"""
        for name in _GOLD_ORACLES
    )
    + """ UNION ALL SELECT 'no_such_table', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), true""",
    "reset_layers": " UNION ALL ".join(
        f"SELECT '{name}' AS name, CAST(1 AS BIGINT) AS removed, CAST(0 AS BIGINT) AS left_over"
        for name in (*_GOLD_ORACLES, "bronze")
    ),
    "home_stats": f"""
        SELECT 'silver_rows_processed' AS figure, CAST(rows_processed AS DOUBLE) AS value FROM ({ORACLE["latest_silver_rows"]})
        UNION ALL SELECT 'months_ingested', CAST(months_ingested AS DOUBLE) FROM ({ORACLE["months_ingested"]})
        UNION ALL SELECT 'fare_model_mae', CAST(mae AS DOUBLE) FROM ({ORACLE["latest_fare_mae"]})
        UNION ALL SELECT 'revenue_trend ' || strftime(pickup_date, '%Y-%m-%d'), round(total_revenue, 6)
        FROM ({ORACLE["revenue_last_14"]})""",
}
