"""Oracle SQL per registered query name (see ``plans.oracle_sql``)."""

from __future__ import annotations

from strata.plans import oracle_sql as O

ORACLE: dict[str, str] = {}

for _name, _sql in O.REPORT_SQL.items():
    ORACLE[_name] = O.star_sql(_sql.replace("{min_trips}", "100"))
ORACLE["longest_common_routes_min5"] = O.star_sql(
    O.REPORT_SQL["longest_common_routes"].replace("{min_trips}", "5")
)

BRONZE_COLS = (
    "dispatching_base_num, pickup_datetime, dropoff_datetime, pu_location_id, "
    "do_location_id, sr_flag, affiliated_base_number, source_file"
)
ORACLE["normalize_columns"] = O.chain(O.RAW) + f"SELECT {BRONZE_COLS} FROM raw"
ORACLE["lenient_casts"] = ORACLE["normalize_columns"]
ORACLE["enrich_pickup"] = O.chain(O.RAW, O.ZONES) + f"""
SELECT t.*, z.borough AS pu_borough, z.zone AS pu_zone, z.service_zone AS pu_service_zone
FROM (SELECT {BRONZE_COLS} FROM raw) t LEFT JOIN zones z ON t.pu_location_id = z.location_id"""
ORACLE["enrich_both"] = O.chain(O.RAW, O.SRC_ONE, O.ZONES, O.ENRICHED) + (
    "SELECT * EXCLUDE (event_id, run_id) FROM enriched"
)
ORACLE["valid_trips"] = O.silver_sql("SELECT * EXCLUDE (event_id) FROM silver")
ORACLE["fact_trips"] = O.star_sql("SELECT * FROM fact")
ORACLE["dim_date"] = O.star_sql("SELECT * FROM dim_date")
ORACLE["dim_zone"] = O.star_sql("SELECT * FROM dim_zone")


# --- helpers for the scenario queries --------------------------------------
def _rule_sql(rule, ruleset: str, no: int, table: str, group: str = "") -> str:
    """One outcome row (per group) for one rule, in plain SQL."""
    c = f'"{rule.column}"' if rule.column else None
    if rule.kind == "row_count":
        metric, passed = "CAST(count(*) AS DOUBLE)", f"count(*) > {rule.threshold}"
    elif rule.kind in ("is_complete", "completeness"):
        metric = f"CAST(count({c}) AS DOUBLE) / NULLIF(count(*), 0)"
        passed = (f"count({c}) = count(*)" if rule.kind == "is_complete"
                  else f"coalesce({metric} > {rule.threshold}, false)")
    else:
        cond = (f"{c} >= {rule.lo} AND {c} <= {rule.hi}" if rule.inclusive
                else f"{c} > {rule.lo} AND {c} < {rule.hi}")
        ok = f"count(*) FILTER (WHERE {cond})"
        metric, passed = f"CAST({ok} AS DOUBLE) / NULLIF(count({c}), 0)", f"{ok} = count({c})"
    text = rule.text().replace("'", "''")
    keys = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return (f"SELECT {keys}'{ruleset}' AS ruleset, {no} AS rule_no, '{text}' AS rule, "
            f"CAST({metric} AS DOUBLE) AS metric, {passed} AS passed FROM {table}{tail}")


def outcomes_sql(ruleset, table: str, group: str = "") -> str:
    return "\nUNION ALL\n".join(
        _rule_sql(r, ruleset.name, i + 1, table, group) for i, r in enumerate(ruleset.rules)
    )


def _score_sql(outcomes: str) -> str:
    return (f"SELECT ruleset, count(*) AS total_rules, CAST(sum(CAST(passed AS INTEGER)) AS BIGINT) AS passed_rules,"
            f" avg(CAST(CAST(passed AS INTEGER) AS DOUBLE)) AS score FROM ({outcomes}) o GROUP BY ruleset")


def _dim_date_of(fact: str) -> str:
    return f"""
SELECT DISTINCT pickup_date_key AS date_key, pickup_date AS full_date,
  CAST(year(pickup_date) AS SMALLINT) AS year, CAST(month(pickup_date) AS SMALLINT) AS month,
  CAST(day(pickup_date) AS SMALLINT) AS day, CAST(dayofweek(pickup_date) + 1 AS SMALLINT) AS day_of_week,
  dayname(pickup_date) AS day_name, monthname(pickup_date) AS month_name
FROM {fact} WHERE pickup_date IS NOT NULL AND pickup_date_key IS NOT NULL"""


def _two(select: str) -> str:
    """Two-run star plus per-run facts/dims (fa, fb, da, db)."""
    extra = (
        "fa AS (SELECT * FROM fact WHERE source_run_id = 'run-a')",
        "fb AS (SELECT * FROM fact WHERE source_run_id = 'run-b')",
        f"da AS ({_dim_date_of('fa')})",
        f"db AS ({_dim_date_of('fb')})",
    )
    return O.star_sql(select, two_runs=True, extra=extra)


def _derived(select: str) -> str:
    return O.chain(*O.PIPE_SILVER[:-1]) + select


from strata.rulesets import bronze_ruleset, silver_ruleset  # noqa: E402
from strata.operators import quality as _Q  # noqa: E402

BRONZE7 = ("dispatching_base_num, pickup_datetime, dropoff_datetime, pu_location_id, "
           "do_location_id, sr_flag, affiliated_base_number")
VALID = ("pickup_year IS NOT NULL AND pickup_month IS NOT NULL AND run_id IS NOT NULL "
         "AND trip_duration_minutes >= 0 AND trip_duration_minutes < 1440")

ORACLE["bronze_scan"] = O.chain(O.RAW) + f"SELECT {BRONZE7} FROM raw"
ORACLE["source_file_lineage"] = O.chain(O.RAW) + (
    "SELECT CAST(year(pickup_datetime) AS INTEGER) AS pickup_year, CAST(month(pickup_datetime) AS INTEGER)"
    " AS pickup_month, count(*) AS trips FROM raw GROUP BY 1, 2")
ORACLE["zone_lookup_csv"] = O.chain(O.ZONES) + "SELECT location_id, borough, zone, service_zone FROM zones"
ORACLE["normalize_zone_columns"] = O.chain(O.ZONES) + (
    "SELECT CAST(location_id AS VARCHAR) AS locationid, borough, zone, service_zone FROM zones")
ORACLE["silver_roundtrip"] = O.silver_sql("SELECT * EXCLUDE (event_id) FROM silver", two_runs=True)
ORACLE["scope_run"] = O.silver_sql("SELECT * EXCLUDE (event_id) FROM silver WHERE run_id = 'run-b'", two_runs=True)
ORACLE["scope_all_runs"] = ORACLE["silver_roundtrip"]
ORACLE["registered_silver"] = O.silver_sql("SELECT run_id, count(*) AS trips FROM silver GROUP BY 1", two_runs=True)
ORACLE["schema_merge"] = O.chain(O.RAW) + f"""
SELECT {BRONZE7}, CAST(NULL AS VARCHAR) AS access_a_ride_flag FROM raw WHERE day(pickup_datetime) <= 15
UNION ALL
SELECT {BRONZE7}, CASE WHEN dispatching_base_num = 'click' THEN 'Y' ELSE 'N' END FROM raw
WHERE day(pickup_datetime) >= 16"""
ORACLE["incremental_ingest"] = O.silver_sql(
    "SELECT * EXCLUDE (event_id, source_file, trip_id, run_id) FROM silver")
ORACLE["incremental_published_fact"] = O.star_sql("SELECT * EXCLUDE (trip_id, source_file, source_run_id) FROM fact")
ORACLE["bronze_spelling_drift"] = O.chain(O.RAW) + f"SELECT {BRONZE7} FROM raw"
ORACLE["bronze_type_drift"] = ORACLE["bronze_spelling_drift"]
ORACLE["two_manual_runs"] = O.silver_sql("SELECT * EXCLUDE (event_id, run_id), 'manual' AS run_id FROM silver")
ORACLE["rerun_same_run_fact"] = O.star_sql("SELECT * FROM fact WHERE day(pickup_datetime) >= 11")
ORACLE["catalog_drift_log"] = O.chain(O.RAW) + """
SELECT DISTINCT 'partition' AS kind, 'd=' || day(pickup_datetime) AS name,
  CASE WHEN day(pickup_datetime) = 1 THEN 'missing in files' ELSE 'added' END AS action
FROM raw WHERE day(pickup_datetime) = 1 OR day(pickup_datetime) >= 16
UNION ALL SELECT 'column', 'access_a_ride_flag', 'added'"""
ORACLE["gold_stage"] = O.star_sql("SELECT * FROM fact")
ORACLE["quarantine_batch"] = O.silver_sql(
    "SELECT * EXCLUDE (event_id), 'silver-fhvhv-quality' AS dq_ruleset_name, "
    "'silver/run-0001' AS dq_result_id, '0.5' AS dq_score FROM silver")
ORACLE["star_ddl"] = O.star_sql("""
SELECT 'fact_fhvhv_trips' AS table_name, count(*) AS row_count FROM fact
UNION ALL SELECT 'dim_date', count(*) FROM dim_date
UNION ALL SELECT 'dim_zone', count(*) FROM dim_zone""")


# The limits of the fact contract.
FACT_LIMITS = {"trip_id": 64, "dispatching_base_num": 32, "affiliated_base_number": 32,
               "source_file": 512, "source_run_id": 128}


def _contract_sql(table: str, extra: tuple[str, ...] = ()) -> str:
    parts = [f"SELECT 'fact_fhvhv_trips' AS table_name, 'trip_id' AS column_name, 'not_null' AS check_name,"
             f" CAST(NULL AS INTEGER) AS limit_value, count(*) FILTER (WHERE trip_id IS NULL) AS violations FROM {table}"]
    parts += [f"SELECT 'fact_fhvhv_trips', '{name}', 'max_length', {n},"
              f" count(*) FILTER (WHERE {name} IS NOT NULL AND strlen({name}) > {n}) FROM {table}"
              for name, n in FACT_LIMITS.items()]
    return O.star_sql("\nUNION ALL\n".join(parts), extra=extra)


ORACLE["contract_violations"] = _contract_sql("fact")
ORACLE["contract_violations_found"] = _contract_sql("broken", extra=("""broken AS (SELECT * REPLACE (
  CASE WHEN pickup_hour = 4 THEN NULL ELSE trip_id END AS trip_id,
  CASE WHEN pickup_hour = 5 THEN repeat('\u00e9', 20) ELSE dispatching_base_num END AS dispatching_base_num,
  CASE WHEN pickup_hour = 6 THEN repeat('e', 32) WHEN pickup_hour = 7 THEN repeat('e', 33)
       ELSE affiliated_base_number END AS affiliated_base_number) FROM fact)""",))
ORACLE["dq_results_store"] = O.silver_sql(
    outcomes_sql(bronze_ruleset(), "raw") + "\nUNION ALL\n" + outcomes_sql(silver_ruleset(), "silver"))
ORACLE["upsert_dim_zone"] = O.star_sql("""
SELECT * FROM prior p WHERE NOT EXISTS (SELECT 1 FROM dim_zone s WHERE s.location_id = p.location_id)
UNION ALL SELECT * FROM dim_zone""", extra=(
    "prior AS (SELECT location_id + 10 AS location_id, borough, zone || ' (prior)' AS zone, service_zone"
    " FROM dim_zone)",))
ORACLE["upsert_dim_date"] = _two("""
SELECT * FROM da WHERE NOT EXISTS (SELECT 1 FROM db WHERE db.date_key = da.date_key)
UNION ALL SELECT * FROM db""")
ORACLE["upsert_fact"] = _two("""
SELECT * FROM fa WHERE NOT EXISTS (SELECT 1 FROM fb WHERE fb.trip_id = fa.trip_id)
UNION ALL SELECT * FROM fb""")
ORACLE["published_fact"] = ORACLE["upsert_fact"]
ORACLE["published_fact_partitions"] = ORACLE["upsert_fact"]
ORACLE["published_fact_by_date"] = ORACLE["upsert_fact"]
ORACLE["expired_star_fact"] = ORACLE["upsert_fact"]
ORACLE["published_card"] = _two("""
SELECT day_name, pickup_hour, count(*) AS trips FROM (
  SELECT * FROM fa WHERE NOT EXISTS (SELECT 1 FROM fb WHERE fb.trip_id = fa.trip_id)
  UNION ALL SELECT * FROM fb
) f JOIN (SELECT * FROM da UNION SELECT * FROM db) d ON f.pickup_date_key = d.date_key GROUP BY 1, 2""")
ORACLE["upsert_replaced_rows"] = _two("""
SELECT * FROM fa WHERE EXISTS (SELECT 1 FROM fb WHERE fb.trip_id = fa.trip_id)""")
ORACLE["publish_rollback"] = _two("""
SELECT 'fact_fhvhv_trips' AS table_name, count(*) AS row_count FROM fa
UNION ALL SELECT 'dim_date', count(*) FROM da
UNION ALL SELECT 'dim_zone', count(*) FROM dim_zone""")
ORACLE["clustered_fact"] = O.star_sql("SELECT * FROM fact")
ORACLE["bound_table_query"] = O.star_sql("SELECT pickup_hour, count(*) AS trips FROM fact GROUP BY pickup_hour")

_adhoc = lambda rule: _Q.Ruleset("adhoc", (rule,))
ORACLE["dq_row_count"] = O.chain(O.RAW) + outcomes_sql(_adhoc(_Q.row_count(0)), "raw")
ORACLE["dq_is_complete"] = O.chain(O.RAW) + outcomes_sql(_adhoc(_Q.is_complete("dropoff_datetime")), "raw")
ORACLE["dq_completeness"] = O.silver_sql(outcomes_sql(_adhoc(_Q.completeness("pu_borough", 0.15)), "silver"))
ORACLE["dq_between"] = _derived(outcomes_sql(_adhoc(_Q.column_values("trip_duration_minutes", (0, 1440))), "derived"))
ORACLE["dq_bronze"] = O.chain(O.RAW) + outcomes_sql(bronze_ruleset(), "raw")
ORACLE["dq_silver"] = O.silver_sql(outcomes_sql(silver_ruleset(), "silver"))
ORACLE["dq_silver_by_run"] = O.silver_sql(outcomes_sql(silver_ruleset(), "silver", group="run_id"), two_runs=True)
ORACLE["dq_silver_incremental"] = O.silver_sql(outcomes_sql(silver_ruleset(), "silver"), two_runs=True)
_BOTH = outcomes_sql(bronze_ruleset(), "raw") + "\nUNION ALL\n" + outcomes_sql(silver_ruleset(), "silver")
ORACLE["dq_score"] = O.silver_sql(_score_sql(_BOTH))
ORACLE["dq_rule_counts"] = O.silver_sql(
    f"SELECT ruleset, count(*) FILTER (WHERE passed) AS rules_passed, count(*) FILTER (WHERE NOT passed)"
    f" AS rules_failed FROM ({_BOTH}) o GROUP BY ruleset")
ORACLE["gate_pass"] = O.silver_sql(
    f"SELECT *, CASE WHEN score >= 1.0 THEN 'publish' ELSE 'quarantine' END AS action FROM "
    f"({_score_sql(outcomes_sql(silver_ruleset(), 'silver'))}) s")
_STRICT_SCORE = f"SELECT CAST(score AS VARCHAR) FROM ({_score_sql(outcomes_sql(silver_ruleset(inclusive=False), 'silver'))}) s"
ORACLE["gate_fail_quarantine"] = O.silver_sql(
    f"SELECT * EXCLUDE (event_id), 'silver-fhvhv-quality' AS dq_ruleset_name, 'silver/run-0001' AS dq_result_id,"
    f" ({_STRICT_SCORE}) AS dq_score FROM silver")


def _failing_sql() -> str:
    checks = [(r.text(), f'"{r.column}" IS NOT NULL' if r.kind == "is_complete"
               else f'("{r.column}" IS NULL OR ("{r.column}" >= {r.lo} AND "{r.column}" <= {r.hi}))')
              for r in silver_ruleset().rules if r.kind in ("is_complete", "column_values")]
    names = ", ".join(f"CASE WHEN NOT ({ok}) THEN '{t}' END" for t, ok in checks)
    bad = " OR ".join(f"NOT ({ok})" for _, ok in checks)
    return _derived(f"SELECT trip_id, pickup_datetime, dropoff_datetime, trip_duration_minutes, "
                    f"concat_ws('; ', {names}) AS failed_rules FROM derived WHERE {bad}")


ORACLE["dq_failing_rows"] = _failing_sql()
ORACLE["batch_metrics"] = _derived(
    f"SELECT count(*) AS rows_read, count(*) FILTER (WHERE pu_borough IS NULL OR do_borough IS NULL) AS unresolved,"
    f" count(*) FILTER (WHERE {VALID}) AS rows_written FROM derived")
ORACLE["rejected_by_reason"] = _derived(f"""
SELECT CASE WHEN pickup_year IS NULL THEN 'missing_pickup_year'
            WHEN pickup_month IS NULL THEN 'missing_pickup_month'
            WHEN run_id IS NULL THEN 'missing_run_id'
            WHEN trip_duration_minutes IS NULL THEN 'missing_duration'
            WHEN trip_duration_minutes < 0 THEN 'negative_duration'
            WHEN trip_duration_minutes >= 1440 THEN 'duration_too_long' END AS reject_reason,
       count(*) AS trips
FROM derived WHERE NOT coalesce({VALID}, false) GROUP BY 1""")
ORACLE["unresolved_zones"] = O.chain(O.RAW, O.SRC_ONE, O.ZONES, O.ENRICHED) + (
    "SELECT pu_location_id, do_location_id, pickup_datetime, pu_borough, do_borough FROM enriched "
    "WHERE pu_borough IS NULL OR do_borough IS NULL")
ORACLE["derive_calendar"] = _derived(
    "SELECT pickup_datetime, pickup_date, pickup_year, pickup_month, pickup_day, pickup_hour, pickup_date_key FROM derived")
ORACLE["trip_duration"] = _derived("SELECT pickup_datetime, dropoff_datetime, trip_duration_minutes FROM derived")
ORACLE["surrogate_key"] = _derived(
    "SELECT trip_id, dispatching_base_num, pickup_datetime, dropoff_datetime, pu_location_id, do_location_id,"
    " affiliated_base_number, source_file FROM derived")
ORACLE["sanitize_labels"] = _derived(
    "SELECT pu_borough, pu_zone, pu_borough_sanitized, pu_zone_sanitized FROM derived")
ORACLE["stamp_run"] = _derived("SELECT trip_id, run_id FROM derived")

RUNS_CTE = """
WITH runs AS (
  SELECT ts, 'trips' AS pipeline, event_type AS job,
    CASE WHEN event_id % 4 <= 1 THEN 'SUCCEEDED' WHEN event_id % 4 = 2 THEN 'FAILED' ELSE 'TIMED_OUT' END AS status,
    CAST(floor(value * 1000) AS BIGINT) AS elapsed_ms,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS tasks,
    CAST(json_extract_string(props, '$.k') AS BIGINT) * 65536 AS bytes_read
  FROM events
), b AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket_start FROM runs)
"""
ORACLE["execution_health"] = RUNS_CTE + """
SELECT bucket_start, bucket_start + INTERVAL 5 MINUTE AS bucket_end, count(*) AS started,
  count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE status = 'FAILED') AS failed,
  count(*) FILTER (WHERE status = 'TIMED_OUT') AS timed_out
FROM b GROUP BY bucket_start"""
ORACLE["execution_time"] = RUNS_CTE + """
SELECT bucket_start, bucket_start + INTERVAL 5 MINUTE AS bucket_end, avg(elapsed_ms) AS avg_elapsed_ms,
  max(elapsed_ms) AS max_elapsed_ms FROM b GROUP BY bucket_start"""
ORACLE["job_metrics"] = RUNS_CTE + """
SELECT bucket_start, bucket_start + INTERVAL 5 MINUTE AS bucket_end, job, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms,
  CAST(sum(tasks) AS BIGINT) AS completed_tasks, CAST(sum(bytes_read) AS BIGINT) AS bytes_read
FROM b GROUP BY bucket_start, job"""
ORACLE["event_log_steps"] = """
WITH t AS (
  SELECT event_id % 97 % 7 AS step, event_id, epoch_us(ts) // 1000 AS launched,
    CAST(floor(value * 1000) AS BIGINT) AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)
SELECT make_timestamp(min(launched) * 1000) AS ts, 'trips' AS pipeline, 'step_' || step AS job,
  CAST(NULL AS VARCHAR) AS status, CAST(max(launched + ms) - min(launched) AS BIGINT) AS elapsed_ms,
  count(*) FILTER (WHERE event_id % 4 <= 1) AS tasks, CAST(sum(k) * 65536 AS BIGINT) AS bytes_read
FROM t GROUP BY step"""
ORACLE["rule_outcome_series"] = O.silver_sql(f"""
SELECT CAST(pickup_date AS TIMESTAMP) + to_hours(pickup_hour) AS bucket_start,
  CAST(pickup_date AS TIMESTAMP) + to_hours(pickup_hour + 1) AS bucket_end, ruleset,
  count(*) FILTER (WHERE passed) AS rules_passed, count(*) FILTER (WHERE NOT passed) AS rules_failed
FROM ({outcomes_sql(silver_ruleset(), 'silver', group='pickup_date, pickup_hour')}) o
GROUP BY pickup_date, pickup_hour, ruleset""")
