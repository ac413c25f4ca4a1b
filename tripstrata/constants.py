"""Names, thresholds and messages every module shares."""

# --- Fixed values: they decide the results and must stay as they are -------------------------

PICKUP = "tpep_pickup_datetime"
DROPOFF = "tpep_dropoff_datetime"
PICKUP_ZONE = "PULocationID"
DROPOFF_ZONE = "DOLocationID"
PICKUP_YEAR_FLAG = "flag_pickup_year_mismatch"
DROPOFF_YEAR_FLAG = "flag_dropoff_year_mismatch"

MAX_TRIP_DISTANCE = 100

INVALID_TIMESTAMPS = "invalid_timestamps"
DISTANCE_OUTLIERS = "distance_outliers"
INVALID_PASSENGER_COUNT = "invalid_passenger_count"
NEGATIVE_FARES = "negative_fares"
NEGATIVE_TOTAL_AMOUNTS = "negative_total_amounts"

# Priority order: a row that breaks several rules belongs to the first category it meets.
CATEGORIES = (
    INVALID_TIMESTAMPS,
    DISTANCE_OUTLIERS,
    INVALID_PASSENGER_COUNT,
    NEGATIVE_FARES,
    NEGATIVE_TOTAL_AMOUNTS,
)

MONITORED_COLUMNS = (
    "passenger_count",
    "RatecodeID",
    "store_and_fwd_flag",
    "congestion_surcharge",
    "Airport_fee",
)

GOLD_TABLES = ("daily_revenue", "hourly_demand", "zone_stats", "congestion_metrics")
FEATURE_TABLE = "zone_hour_features"
ONLINE_KEY_FORMAT = "features:zone:%d:hour:%d"
ONLINE_DECIMALS = 4

MODEL_FEATURES = ("trip_distance", PICKUP_ZONE, DROPOFF_ZONE, "passenger_count", "pickup_hour")
MODEL_TARGET = "fare_amount"
MODEL_TREES = 50
MODEL_DEPTH = 12
MODEL_SEED = 42
MODEL_SAMPLE_ROWS = 300_000
MODEL_SAMPLE_MARGIN = 1.1
MODEL_TEST_SHARE = 0.2

TOPIC = "yellow-taxi-trips"
REPLAY_DEFAULT_LIMIT = 500
REPLAY_MAX_LIMIT = 5000
REPLAY_DEFAULT_RATE = 10.0
REPLAY_MIN_RATE = 0.1
REPLAY_MAX_RATE = 100.0
REPLAY_SPEEDS = (1, 2, 3, 5, 10)
TICK_SECONDS = 2
HOURLY_WATERMARK = "1 hour"
HOURLY_WINDOW = "1 hour"
HOURLY_TRIGGER = "10 seconds"

TOP_ZONES = 10
TREND_DAYS = 14
RUNS_PAGE = 20
LINEAGE_RUNS = 10
LIVE_TRIPS = 20
LIVE_TICKS = 30
PREVIEW_ROWS = 20
SQL_MAX_ROWS = 500
SQL_TIMEOUT_SECONDS = 10

SCHEMA_MISSING = "Missing expected columns: {columns}"
SCHEMA_MISMATCH = "Dtype mismatch: {fields}"

SQL_EMPTY = "SQL query cannot be empty."
SQL_NOT_SELECT = "Only SELECT queries are allowed."
SQL_MANY_STATEMENTS = "Only a single SQL statement is allowed."

TERMINAL_COUNTED = ("succeeded", "partial", "failed")
ACTIVE_STATUSES = ("queued", "running")
# --- End of fixed values ----------------------------------------------------------------------

ACCEPTED = "accepted"

# How much of the trees' statistics one pass over the rows may gather: fewer passes, same trees.
MODEL_PASS_MEMORY_MB = 512
