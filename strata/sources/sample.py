"""Adapter from the supplied test tables to trips and zones.

The test data has no trip table, so trips are derived row by row from
``events`` and the zone lookup from ``nation`` joined with ``region``. The
rules are fixed so that the DuckDB oracle (plans/oracle_sql.py) derives the
very same rows; both sides must change together.

Raw trips carry source-style spellings (``PUlocationID``, ``dropOff_datetime``,
``SR_Flag``, ...) so the Bronze normaliser has real work to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed adapter values (shared with the oracle SQL):
# drop-off rule, first match on event_id: %97=0 -> null; %89=0 -> ts - 5 min;
# %83=0 -> ts + 2 days; %79=0 -> ts + 1 day; %73=0 -> ts; else
# ts + floor(value*60) seconds. Pickup id: %4=0 -> user_id%30 else null.
# Drop-off id: %10<>0 -> (user_id*7+event_id)%27 else null. sr_flag: %11=0 -> 1.
# Affiliated base: %5<>0 -> 'B' || user_id%7. Source file: 'fhvhv/part-' || %3.
SERVICE_ZONES = ("Boro Zone", "Yellow Zone", "Airports")
RUN_STATUS_BY_MOD4 = ("SUCCEEDED", "SUCCEEDED", "FAILED", "TIMED_OUT")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _dropoff(eid: Column, ts: Column, value: Column) -> Column:
    return (
        F.when(eid % 97 == 0, F.lit(None))
        .when(eid % 89 == 0, F.timestamp_add("MINUTE", F.lit(-5), ts))
        .when(eid % 83 == 0, F.timestamp_add("DAY", F.lit(2), ts))
        .when(eid % 79 == 0, F.timestamp_add("DAY", F.lit(1), ts))
        .when(eid % 73 == 0, ts)
        .otherwise(F.timestamp_add("SECOND", F.floor(value * 60).cast("long"), ts))
    )


def trip_columns(events: DataFrame) -> dict[str, Column]:
    eid, uid, ts = F.col("event_id"), F.col("user_id"), F.col("ts")
    return {
        "dispatching_base_num": F.col("event_type"),
        "Pickup_datetime": ts,
        "dropOff_datetime": _dropoff(eid, ts, F.col("value")),
        "PUlocationID": F.when(eid % 4 == 0, (uid % 30).cast("int")),
        "DOlocationID": F.when(eid % 10 != 0, ((uid * 7 + eid) % 27).cast("int")),
        "SR_Flag": F.when(eid % 11 == 0, F.lit(1)),
        "Affiliated_base_number": F.when(
            eid % 5 != 0, F.concat(F.lit("B"), (uid % 7).cast("string"))
        ),
    }


def raw_trips(spark: SparkSession, sf_dir: str, lineage: bool = True) -> DataFrame:
    """Raw (Bronze-spelling) trips, one per event. ``source_file`` is a literal
    per row group of ``event_id % 3`` rather than a real path, so both engines
    hash the same text into ``trip_id``."""
    events = table(spark, sf_dir, "events")
    cols = trip_columns(events)
    if lineage:
        cols["source_file"] = F.concat(
            F.lit("fhvhv/part-"), (F.col("event_id") % 3).cast("string")
        )
    return events.select(*[c.alias(n) for n, c in cols.items()])


def zone_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones: id = nation key, borough = region name, zone = ``nation / region``,
    service zone by ``nation key % 3``."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    service = (
        F.when(key % 3 == 0, SERVICE_ZONES[0])
        .when(key % 3 == 1, SERVICE_ZONES[1])
        .otherwise(SERVICE_ZONES[2])
    )
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        key.cast("int").alias("location_id"),
        F.col("r_name").alias("borough"),
        F.concat_ws(" / ", F.col("n_name"), F.col("r_name")).alias("zone"),
        service.alias("service_zone"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-log rows (``ts, pipeline, job, status, elapsed_ms, tasks,
    bytes_read``) standing in for job telemetry: one per event; job = event
    type, status by ``event_id % 4``, elapsed = ``floor(value * 1000)`` ms,
    tasks = the ``k`` of ``props``, bytes read = ``tasks * 65536``."""
    events = table(spark, sf_dir, "events")
    mod4 = F.col("event_id") % 4
    status = F.when(mod4 <= 1, RUN_STATUS_BY_MOD4[0]).when(mod4 == 2, RUN_STATUS_BY_MOD4[2])
    status = status.otherwise(RUN_STATUS_BY_MOD4[3])
    tasks = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("ts"),
        F.lit("trips").alias("pipeline"),
        F.col("event_type").alias("job"),
        status.alias("status"),
        F.floor(F.col("value") * 1000).cast("long").alias("elapsed_ms"),
        tasks.alias("tasks"),
        (tasks * 65536).alias("bytes_read"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a Spark event log standing in for a run's own: one finished task per
    event (stage ``event_id % 97``, launched at ``ts``, ``floor(value * 1000)`` ms long,
    successful if ``event_id % 4`` is 0 or 1, bytes read as in :func:`run_log`), and the
    submission of each stage in the job group of step ``stage % 7``."""
    rows = table(spark, sf_dir, "events")
    stage = F.col("event_id") % 97
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    ok = F.when(F.col("event_id") % 4 <= 1, "Success").otherwise("ExceptionFailure")
    read = F.get_json_object("props", "$.k").cast("long") * 65536
    task = F.struct(
        F.lit("SparkListenerTaskEnd").alias("Event"),
        stage.alias("Stage ID"),
        F.lit(0).alias("Stage Attempt ID"),
        F.struct(ok.alias("Reason")).alias("Task End Reason"),
        F.struct(
            start.alias("Launch Time"), (start + F.floor(F.col("value") * 1000).cast("long")).alias("Finish Time")
        ).alias("Task Info"),
        F.struct(F.struct(read.alias("Bytes Read")).alias("Input Metrics")).alias("Task Metrics"),
    )
    group = F.format_string("strata-step_%d-%08x", F.col("stage") % 7, F.col("stage") % 7)
    submitted = F.struct(
        F.lit("SparkListenerStageSubmitted").alias("Event"),
        F.struct(F.col("stage").alias("Stage ID"), F.lit(0).alias("Stage Attempt ID")).alias("Stage Info"),
        F.struct(group.alias("spark.jobGroup.id")).alias("Properties"),
    )
    stages = rows.select(stage.alias("stage")).distinct()
    return rows.select(F.to_json(task).alias("value")).unionByName(stages.select(F.to_json(submitted).alias("value")))
