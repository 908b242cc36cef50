"""Table contracts and fixed values, as data.

Lengths and NOT NULL marks live in ``StructField`` metadata / nullability so
``operators.contract.enforce_contract`` can check them generically.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the behaviour being reproduced.
# Column-name aliases applied after canonicalisation (lower snake case):
#   pulocationid      -> pu_location_id
#   pu_location_id    -> pu_location_id
#   dolocationid      -> do_location_id
#   do_location_id    -> do_location_id
#   dropoff_datetime  -> dropoff_datetime
#   drop_off_datetime -> dropoff_datetime
# Key separator for trip_id: "||"; label sanitising pattern: "[^a-zA-Z0-9 ]"
# replaced by "_"; run id meaning "all runs": "manual"; SQL identifier
# pattern: ^[A-Za-z_][A-Za-z0-9_]*$ ; valid duration: 0 <= minutes < 1440.
# ---------------------------------------------------------------------------
TRIP_ALIASES = {
    "pulocationid": "pu_location_id",
    "pu_location_id": "pu_location_id",
    "dolocationid": "do_location_id",
    "do_location_id": "do_location_id",
    "dropoff_datetime": "dropoff_datetime",
    "drop_off_datetime": "dropoff_datetime",
}
KEY_SEPARATOR = "||"
LABEL_DISALLOWED = r"[^a-zA-Z0-9 ]"
ALL_RUNS = "manual"
IDENTIFIER_PATTERN = r"^[A-Za-z_][A-Za-z0-9_]*$"
MAX_TRIP_MINUTES = 1440.0
UNKNOWN = "Unknown"


def _f(name, dtype, nullable=True, max_length=None):
    meta = {"max_length": max_length} if max_length else {}
    return T.StructField(name, dtype, nullable, meta)


S, I, SH, D, TS, DT, L, B = (
    T.StringType(),
    T.IntegerType(),
    T.ShortType(),
    T.DoubleType(),
    T.TimestampType(),
    T.DateType(),
    T.LongType(),
    T.BooleanType(),
)

# Bronze trips with canonical names; also the schema used when a read is empty.
BRONZE = T.StructType(
    [
        _f("dispatching_base_num", S),
        _f("pickup_datetime", TS),
        _f("dropoff_datetime", TS),
        _f("pu_location_id", I),
        _f("do_location_id", I),
        _f("sr_flag", I),
        _f("affiliated_base_number", S),
    ]
)

# Target types applied to Bronze (lenient: bad text becomes null).
BRONZE_CASTS = {
    "pickup_datetime": "timestamp",
    "dropoff_datetime": "timestamp",
    "pu_location_id": "int",
    "do_location_id": "int",
    "sr_flag": "int",
}

# Zone lookup as read from a headered CSV: every column is text.
ZONE_CSV = T.StructType(
    [_f("locationid", S), _f("borough", S), _f("zone", S), _f("service_zone", S)]
)
ZONE = T.StructType(
    [_f("location_id", I), _f("borough", S), _f("zone", S), _f("service_zone", S)]
)

ZONE_ROLE_COLUMNS = ("borough", "zone", "service_zone")

SILVER_PARTITIONS = ("pickup_year", "pickup_month", "run_id")

SILVER = T.StructType(
    list(BRONZE.fields)
    + [
        _f("source_file", S),
        _f("pu_borough", S),
        _f("pu_zone", S),
        _f("pu_service_zone", S),
        _f("do_borough", S),
        _f("do_zone", S),
        _f("do_service_zone", S),
        _f("pickup_date", DT),
        _f("pickup_day", I),
        _f("pickup_hour", I),
        _f("pickup_date_key", I),
        _f("trip_duration_minutes", D),
        _f("load_timestamp", TS),
        _f("trip_id", S),
        _f("pu_borough_sanitized", S),
        _f("pu_zone_sanitized", S),
        # partition columns last, as a partitioned read returns them
        _f("pickup_year", I),
        _f("pickup_month", I),
        _f("run_id", S),
    ]
)

# Fields folded into trip_id, in order.
TRIP_KEY_FIELDS = (
    "dispatching_base_num",
    "pickup_datetime",
    "dropoff_datetime",
    "pu_location_id",
    "do_location_id",
    "affiliated_base_number",
    "source_file",
)

# Gold star (warehouse contracts: NOT NULL keys, VARCHAR lengths).
DIM_ZONE = T.StructType(
    [
        _f("location_id", I, nullable=False),
        _f("borough", S, max_length=64),
        _f("zone", S, max_length=128),
        _f("service_zone", S, max_length=64),
        _f("load_timestamp", TS),
    ]
)

DIM_DATE = T.StructType(
    [
        _f("date_key", I, nullable=False),
        _f("full_date", DT),
        _f("year", SH),
        _f("month", SH),
        _f("day", SH),
        _f("day_of_week", SH),
        _f("day_name", S, max_length=16),
        _f("month_name", S, max_length=16),
        _f("load_timestamp", TS),
    ]
)

FACT = T.StructType(
    [
        _f("trip_id", S, nullable=False, max_length=64),
        _f("dispatching_base_num", S, max_length=32),
        _f("affiliated_base_number", S, max_length=32),
        _f("pickup_datetime", TS),
        _f("dropoff_datetime", TS),
        _f("pickup_date", DT),
        _f("pickup_date_key", I),
        _f("pickup_hour", SH),
        _f("pu_location_id", I),
        _f("do_location_id", I),
        _f("sr_flag", I),
        _f("trip_duration_minutes", D),
        _f("source_file", S, max_length=512),
        _f("source_run_id", S, max_length=128),
        _f("load_timestamp", TS),
    ]
)

STAR_TABLES = {"dim_zone": DIM_ZONE, "dim_date": DIM_DATE, "fact_fhvhv_trips": FACT}
STAR_KEYS = {"dim_zone": "location_id", "dim_date": "date_key", "fact_fhvhv_trips": "trip_id"}
FACT_PARTITION = "pickup_date_key"
FACT_SORT = ("pickup_date_key", "pickup_hour", "pu_location_id")

# Audit columns added to a quarantined batch.
QUARANTINE_AUDIT = T.StructType(
    [
        _f("quarantined_at", TS),
        _f("dq_ruleset_name", S),
        _f("dq_result_id", S),
        _f("dq_score", S),
    ]
)

RULE_OUTCOME = T.StructType(
    [
        _f("ruleset", S),
        _f("rule_no", I),
        _f("rule", S),
        _f("metric", D),
        _f("passed", B),
    ]
)

RUN_LOG = T.StructType(
    [
        _f("ts", T.TimestampNTZType()),
        _f("pipeline", S),
        _f("job", S),
        _f("status", S),
        _f("elapsed_ms", L),
        _f("tasks", L),
        _f("bytes_read", L),
    ]
)

RUN_STATUSES = ("SUCCEEDED", "FAILED", "TIMED_OUT")
