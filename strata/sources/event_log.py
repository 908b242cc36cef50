"""Spark's event log as a source of job telemetry.

A session started with ``spark.eventLog.enabled=true``,
``spark.eventLog.dir=<shared folder>`` and ``spark.eventLog.compress=false`` (Spark's
readers have no codec for the compressed form) leaves one JSON line per event there,
in one file or in rolled ones.  The lines are read as any other JSON table, by as many
tasks as the files have splits; only the fields that telemetry needs are parsed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of events and fields in Spark's event log.
STAGE_SUBMITTED = "SparkListenerStageSubmitted"
TASK_END = "SparkListenerTaskEnd"
JOB_GROUP = "spark.jobGroup.id"
EVENT_SCHEMA = (
    "Event STRING, `Stage ID` BIGINT, `Stage Attempt ID` BIGINT, "
    "`Stage Info` STRUCT<`Stage ID`: BIGINT, `Stage Attempt ID`: BIGINT>, "
    "Properties MAP<STRING, STRING>, "
    "`Task Info` STRUCT<`Launch Time`: BIGINT, `Finish Time`: BIGINT>, "
    "`Task End Reason` STRUCT<Reason: STRING>, "
    "`Task Metrics` STRUCT<`Input Metrics`: STRUCT<`Bytes Read`: BIGINT>>"
)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of every application logged under ``path``, with ``app`` from the folder
    of rolled files (``eventlog_v2_<app>``) or else from the file's name. Lines that are
    no events, such as the broken last line of a running application, are left out."""
    lines = spark.read.schema(EVENT_SCHEMA).option("recursiveFileLookup", "true").json(path)
    file = F.col("_metadata.file_path")
    folder = F.regexp_extract(file, r"/eventlog_v2_([^/]+)/[^/]*$", 1)
    own = F.regexp_extract(file, r"([^/.]+)[^/]*$", 1)
    return lines.withColumn("app", F.when(folder != "", folder).otherwise(own)).filter(F.col("Event").isNotNull())


def stage_tasks(events: DataFrame) -> DataFrame:
    """Per application and stage attempt: successful tasks, bytes read by all of them
    (failed ones too), first launch and last finish in milliseconds."""
    ended = events.filter(F.col("Event") == TASK_END)
    return ended.groupBy(
        "app", F.col("Stage ID").alias("stage_id"), F.col("Stage Attempt ID").alias("attempt")
    ).agg(
        F.count(F.when(F.col("`Task End Reason`.Reason") == "Success", 1)).alias("tasks"),
        F.coalesce(F.sum("`Task Metrics`.`Input Metrics`.`Bytes Read`"), F.lit(0)).alias("bytes_read"),
        F.min("`Task Info`.`Launch Time`").alias("launched"),
        F.max("`Task Info`.`Finish Time`").alias("finished"),
    )


def group_tasks(events: DataFrame) -> DataFrame:
    """The same per application and job group (null: stages run outside any group).

    A stage belongs to the group that submitted it, so one that a later job reuses
    counts once. Tasks are summed by stage before they meet the submissions."""
    submitted = events.filter(F.col("Event") == STAGE_SUBMITTED).select(
        "app",
        F.col("`Stage Info`.`Stage ID`").alias("stage_id"),
        F.col("`Stage Info`.`Stage Attempt ID`").alias("attempt"),
        F.col("Properties")[JOB_GROUP].alias("job_group"),
    )
    return (
        stage_tasks(events)
        .join(submitted.distinct(), ["app", "stage_id", "attempt"], "left")
        .groupBy("app", "job_group")
        .agg(
            F.sum("tasks").alias("tasks"),
            F.sum("bytes_read").alias("bytes_read"),
            F.min("launched").alias("launched"),
            F.max("finished").alias("finished"),
        )
    )
