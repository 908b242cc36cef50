"""DuckDB SQL for each registered query (the correctness oracle).

The CTE chain re-derives, in plain SQL over the supplied tables, exactly what
``sources.sample`` + ``plans.silver_job`` + ``operators.dims`` build in
Spark. Dialect mapping: ``timestampadd`` <-> ``+ INTERVAL`` / ``to_seconds``;
``unix_timestamp`` <-> ``epoch(date_trunc('second', x))``; ``sha2(.., 256)``
<-> ``sha256``; ``regexp_replace`` needs the ``'g'`` flag; ``dayofweek`` is
0-based in DuckDB (+1). Timestamps are compared as naive (NTZ) values.
"""

from __future__ import annotations

RUN_ID = "run-0001"

RAW = """
raw AS (
  SELECT
    event_id,
    event_type AS dispatching_base_num,
    CAST(ts AS TIMESTAMP) AS pickup_datetime,
    CASE
      WHEN event_id % 97 = 0 THEN NULL
      WHEN event_id % 89 = 0 THEN ts - INTERVAL 5 MINUTE
      WHEN event_id % 83 = 0 THEN ts + INTERVAL 2 DAY
      WHEN event_id % 79 = 0 THEN ts + INTERVAL 1 DAY
      WHEN event_id % 73 = 0 THEN ts
      ELSE ts + to_seconds(CAST(floor(value * 60) AS BIGINT))
    END AS dropoff_datetime,
    CASE WHEN event_id % 4 = 0 THEN CAST(user_id % 30 AS INTEGER) END AS pu_location_id,
    CASE WHEN event_id % 10 <> 0 THEN CAST((user_id * 7 + event_id) % 27 AS INTEGER) END AS do_location_id,
    CASE WHEN event_id % 11 = 0 THEN 1 END AS sr_flag,
    CASE WHEN event_id % 5 <> 0 THEN 'B' || CAST(user_id % 7 AS VARCHAR) END AS affiliated_base_number,
    'fhvhv/part-' || CAST(event_id % 3 AS VARCHAR) AS source_file
  FROM events
)"""

ZONES = """
zones AS (
  SELECT
    CAST(n_nationkey AS INTEGER) AS location_id,
    r_name AS borough,
    n_name || ' / ' || r_name AS zone,
    CASE n_nationkey % 3 WHEN 0 THEN 'Boro Zone' WHEN 1 THEN 'Yellow Zone' ELSE 'Airports' END AS service_zone
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

SRC_ONE = """
src AS (SELECT *, '{run}' AS run_id FROM raw)"""

# Two overlapping runs: run-a = pickup days 1-20, run-b = days 11-30.
SRC_TWO = """
src AS (
  SELECT *, 'run-a' AS run_id FROM raw WHERE day(pickup_datetime) <= 20
  UNION ALL
  SELECT *, 'run-b' AS run_id FROM raw WHERE day(pickup_datetime) >= 11
)"""

ENRICHED = """
enriched AS (
  SELECT t.*,
    pz.borough AS pu_borough, pz.zone AS pu_zone, pz.service_zone AS pu_service_zone,
    dz.borough AS do_borough, dz.zone AS do_zone, dz.service_zone AS do_service_zone
  FROM src t
  LEFT JOIN zones pz ON t.pu_location_id = pz.location_id
  LEFT JOIN zones dz ON t.do_location_id = dz.location_id
)"""

DERIVED = """
derived AS (
  SELECT e.*,
    CAST(pickup_datetime AS DATE) AS pickup_date,
    CAST(year(pickup_datetime) AS INTEGER) AS pickup_year,
    CAST(month(pickup_datetime) AS INTEGER) AS pickup_month,
    CAST(day(pickup_datetime) AS INTEGER) AS pickup_day,
    CAST(hour(pickup_datetime) AS INTEGER) AS pickup_hour,
    CAST(strftime(pickup_datetime, '%Y%m%d') AS INTEGER) AS pickup_date_key,
    (epoch(date_trunc('second', dropoff_datetime)) - epoch(date_trunc('second', pickup_datetime))) / 60.0
      AS trip_duration_minutes,
    sha256(concat_ws('||', dispatching_base_num, CAST(pickup_datetime AS VARCHAR),
      CAST(dropoff_datetime AS VARCHAR), CAST(pu_location_id AS VARCHAR),
      CAST(do_location_id AS VARCHAR), affiliated_base_number, source_file)) AS trip_id,
    regexp_replace(pu_borough, '[^a-zA-Z0-9 ]', '_', 'g') AS pu_borough_sanitized,
    regexp_replace(pu_zone, '[^a-zA-Z0-9 ]', '_', 'g') AS pu_zone_sanitized
  FROM enriched e
)"""

SILVER = """
silver AS (
  SELECT * FROM derived
  WHERE pickup_year IS NOT NULL AND pickup_month IS NOT NULL AND run_id IS NOT NULL
    AND trip_duration_minutes >= 0 AND trip_duration_minutes < 1440
)"""

FACT = """
fact AS (
  SELECT trip_id, dispatching_base_num, affiliated_base_number, pickup_datetime, dropoff_datetime,
    pickup_date, pickup_date_key, CAST(pickup_hour AS SMALLINT) AS pickup_hour, pu_location_id,
    do_location_id, sr_flag, CAST(trip_duration_minutes AS DOUBLE) AS trip_duration_minutes,
    source_file, run_id AS source_run_id
  FROM silver
)"""

DIM_DATE = """
dim_date AS (
  SELECT DISTINCT
    pickup_date_key AS date_key,
    pickup_date AS full_date,
    CAST(year(pickup_date) AS SMALLINT) AS year,
    CAST(month(pickup_date) AS SMALLINT) AS month,
    CAST(day(pickup_date) AS SMALLINT) AS day,
    CAST(dayofweek(pickup_date) + 1 AS SMALLINT) AS day_of_week,
    dayname(pickup_date) AS day_name,
    monthname(pickup_date) AS month_name
  FROM fact WHERE pickup_date IS NOT NULL AND pickup_date_key IS NOT NULL
)"""

DIM_ZONE = """
dim_zone AS (
  SELECT location_id, borough, zone, service_zone FROM (
    SELECT *, row_number() OVER (PARTITION BY location_id
      ORDER BY borough NULLS FIRST, zone NULLS FIRST, service_zone NULLS FIRST) AS rn
    FROM zones WHERE location_id IS NOT NULL)
  WHERE rn = 1
)"""


def chain(*ctes: str, run: str = RUN_ID) -> str:
    body = ",".join(c.replace("{run}", run) for c in ctes)
    return "WITH" + body + "\n"


PIPE_SILVER = (RAW, SRC_ONE, ZONES, ENRICHED, DERIVED, SILVER)
PIPE_STAR = PIPE_SILVER + (FACT, DIM_DATE, DIM_ZONE)
PIPE_SILVER_TWO = (RAW, SRC_TWO, ZONES, ENRICHED, DERIVED, SILVER)
PIPE_STAR_TWO = PIPE_SILVER_TWO + (FACT, DIM_DATE, DIM_ZONE)


def star_sql(select: str, two_runs: bool = False, extra: tuple[str, ...] = ()) -> str:
    """The star CTE chain (one or two runs), any ``extra`` CTEs ("name AS (...)")
    after it, then ``select``."""
    return chain(*(PIPE_STAR_TWO if two_runs else PIPE_STAR), *("\n" + e for e in extra)) + select


def silver_sql(select: str, two_runs: bool = False) -> str:
    return chain(*(PIPE_SILVER_TWO if two_runs else PIPE_SILVER)) + select


def half_up(n: str, d: str, factor: int = 1) -> str:
    """HALF_UP, 2 decimals, on the exact ratio factor*n/d (see half_up_ratio)."""
    return (
        f"CAST(({2 * factor * 100} * CAST({n} AS HUGEINT) + CAST({d} AS HUGEINT))"
        f" // NULLIF(2 * CAST({d} AS HUGEINT), 0) AS DOUBLE) / 100.0"
    )


def pct(n: str, d: str) -> str:
    return half_up(n, d, factor=100)


def mean_minutes(col: str = "trip_duration_minutes") -> str:
    return half_up(f"sum(CAST(round({col} * 60) AS BIGINT))", f"60 * count({col})")


MEAN = mean_minutes()
MEAN_F = mean_minutes("f.trip_duration_minutes")


REPORT_SQL = {
    "total_trips": "SELECT CAST(count(*) AS BIGINT) AS trips FROM fact",
    "average_duration": f"SELECT {MEAN} AS avg_minutes FROM fact",
    "pickup_location_coverage": f"SELECT {pct('count(pu_location_id)', 'count(*)')} AS pickup_location_pct FROM fact",
    "dropoff_location_coverage": f"SELECT {pct('count(do_location_id)', 'count(*)')} AS dropoff_location_pct FROM fact",
    "daily_trip_volume": """
SELECT d.full_date AS pickup_date, count(*) AS trips
FROM fact f JOIN dim_date d ON f.pickup_date_key = d.date_key
GROUP BY 1 ORDER BY 1""",
    "pickup_borough_mix": """
SELECT coalesce(z.borough, 'Unknown') AS pickup_borough, count(*) AS trips
FROM fact f LEFT JOIN dim_zone z ON f.pu_location_id = z.location_id
GROUP BY 1 ORDER BY trips DESC, 1""",
    "pickup_hour_volume": "SELECT pickup_hour, count(*) AS trips FROM fact GROUP BY 1 ORDER BY 1",
    "warehouse_table_counts": """
SELECT 'fact_fhvhv_trips' AS table_name, count(*) AS row_count FROM fact
UNION ALL SELECT 'dim_date', count(*) FROM dim_date
UNION ALL SELECT 'dim_zone', count(*) FROM dim_zone
ORDER BY table_name""",
    "top_pickup_zones": """
SELECT coalesce(z.borough, 'Unknown') || ' - ' || coalesce(z.zone, 'Unknown') AS pickup_zone, count(*) AS trips
FROM fact f LEFT JOIN dim_zone z ON f.pu_location_id = z.location_id
WHERE f.pu_location_id IS NOT NULL
GROUP BY 1 ORDER BY trips DESC, pickup_zone NULLS FIRST LIMIT 15""",
    "top_dropoff_zones": """
SELECT coalesce(z.borough, 'Unknown') || ' - ' || coalesce(z.zone, 'Unknown') AS dropoff_zone, count(*) AS trips
FROM fact f LEFT JOIN dim_zone z ON f.do_location_id = z.location_id
WHERE f.do_location_id IS NOT NULL
GROUP BY 1 ORDER BY trips DESC, dropoff_zone NULLS FIRST LIMIT 15""",
    "borough_flows": f"""
SELECT coalesce(pu.borough, 'Unknown') AS pickup_borough, coalesce(dz.borough, 'Unknown') AS dropoff_borough,
  count(*) AS trips, {MEAN_F} AS avg_minutes
FROM fact f
LEFT JOIN dim_zone pu ON f.pu_location_id = pu.location_id
LEFT JOIN dim_zone dz ON f.do_location_id = dz.location_id
GROUP BY 1, 2 ORDER BY trips DESC, 1 NULLS FIRST, 2 NULLS FIRST LIMIT 25""",
    "top_routes": f"""
SELECT coalesce(pu.zone, 'Unknown') AS pickup_zone, coalesce(dz.zone, 'Unknown') AS dropoff_zone,
  count(*) AS trips, {MEAN_F} AS avg_minutes
FROM fact f
LEFT JOIN dim_zone pu ON f.pu_location_id = pu.location_id
LEFT JOIN dim_zone dz ON f.do_location_id = dz.location_id
WHERE f.pu_location_id IS NOT NULL AND f.do_location_id IS NOT NULL
GROUP BY 1, 2 ORDER BY trips DESC, 1 NULLS FIRST, 2 NULLS FIRST LIMIT 25""",
    "longest_common_routes": f"""
SELECT coalesce(pu.zone, 'Unknown') AS pickup_zone, coalesce(dz.zone, 'Unknown') AS dropoff_zone,
  count(*) AS trips, {MEAN_F} AS avg_minutes
FROM fact f
LEFT JOIN dim_zone pu ON f.pu_location_id = pu.location_id
LEFT JOIN dim_zone dz ON f.do_location_id = dz.location_id
WHERE f.pu_location_id IS NOT NULL AND f.do_location_id IS NOT NULL
GROUP BY 1, 2 HAVING count(*) >= {{min_trips}}
ORDER BY avg_minutes DESC NULLS LAST, 1 NULLS FIRST, 2 NULLS FIRST LIMIT 25""",
    "pickup_service_zone": """
SELECT coalesce(z.service_zone, 'Unknown') AS pickup_service_zone, count(*) AS trips
FROM fact f LEFT JOIN dim_zone z ON f.pu_location_id = z.location_id
GROUP BY 1 ORDER BY trips DESC, 1""",
    "loaded_date_range": """
SELECT min(pickup_date) AS first_pickup_date, max(pickup_date) AS last_pickup_date,
  count(DISTINCT pickup_date) AS loaded_days FROM fact""",
    "loaded_run_ids": """
SELECT coalesce(source_run_id, 'Unknown') AS source_run_id, count(*) AS trips
FROM fact GROUP BY 1 ORDER BY trips DESC, 1""",
    "loaded_source_files": """
SELECT source_file, count(*) AS trips FROM fact
GROUP BY 1 ORDER BY trips DESC, source_file NULLS FIRST LIMIT 20""",
    "duration_quality_band": f"""
SELECT round(min(trip_duration_minutes), 2) AS min_minutes, {MEAN} AS avg_minutes,
  round(max(trip_duration_minutes), 2) AS max_minutes FROM fact""",
    "location_completeness": f"""
SELECT 'pickup_location_id' AS field_name, count(pu_location_id) AS non_null_rows, count(*) AS total_rows,
  {pct('count(pu_location_id)', 'count(*)')} AS completeness_pct FROM fact
UNION ALL
SELECT 'dropoff_location_id', count(do_location_id), count(*),
  {pct('count(do_location_id)', 'count(*)')} FROM fact
ORDER BY field_name""",
}
