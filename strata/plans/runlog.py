"""Operational rollups over a run log (O1-O4), in fixed time buckets.

Each is one grouped aggregate over ``window(ts, bucket)``: partial counts
and sums are merged map-side, so a burst of runs in one bucket is collapsed
inside each task before the shuffle. Output buckets are ``bucket_start`` /
``bucket_end``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.sources.event_log import group_tasks


def _bucket(ts: str, every: str):
    return F.window(ts, every).alias("w")


def _flat(df: DataFrame, *rest: str) -> DataFrame:
    return df.select(
        F.col("w.start").alias("bucket_start"), F.col("w.end").alias("bucket_end"), *rest
    )


def execution_health(runs: DataFrame, every: str = "5 minutes") -> DataFrame:
    """Started / succeeded / failed / timed-out runs per bucket (O1)."""
    status = F.col("status")
    out = runs.groupBy(_bucket("ts", every)).agg(
        F.count(F.lit(1)).alias("started"),
        F.count(F.when(status == "SUCCEEDED", 1)).alias("succeeded"),
        F.count(F.when(status == "FAILED", 1)).alias("failed"),
        F.count(F.when(status == "TIMED_OUT", 1)).alias("timed_out"),
    )
    return _flat(out, "started", "succeeded", "failed", "timed_out")


def execution_time(runs: DataFrame, every: str = "5 minutes") -> DataFrame:
    """Average and maximum run duration (ms) per bucket (O2)."""
    out = runs.groupBy(_bucket("ts", every)).agg(
        F.avg("elapsed_ms").alias("avg_elapsed_ms"), F.max("elapsed_ms").alias("max_elapsed_ms")
    )
    return _flat(out, "avg_elapsed_ms", "max_elapsed_ms")


def job_metrics(runs: DataFrame, every: str = "5 minutes") -> DataFrame:
    """Per job and bucket: total elapsed ms, completed tasks, bytes read (O3)."""
    out = runs.groupBy(_bucket("ts", every), "job").agg(
        F.sum("elapsed_ms").alias("elapsed_ms"),
        F.sum("tasks").alias("completed_tasks"),
        F.sum("bytes_read").alias("bytes_read"),
    )
    return _flat(out, "job", "elapsed_ms", "completed_tasks", "bytes_read")


def rule_outcome_series(outcomes: DataFrame, ts: str = "evaluated_at", every: str = "5 minutes") -> DataFrame:
    """Passed and failed rules per ruleset per bucket."""
    out = outcomes.groupBy(_bucket(ts, every), "ruleset").agg(
        F.count(F.when(F.col("passed"), 1)).alias("rules_passed"),
        F.count(F.when(~F.col("passed"), 1)).alias("rules_failed"),
    )
    return _flat(out, "ruleset", "rules_passed", "rules_failed")


# -- writing the run log ------------------------------------------------------
EXECUTION = "execution"  # job name of the row that stands for a whole run


def executions(log: DataFrame) -> DataFrame:
    """The rows of whole runs, leaving out their steps (input of O1 and O2)."""
    return log.filter(F.col("job") == EXECUTION)


STEP_GROUP = r"^strata-(.*)-[0-9a-f]{8}$"  # job group of a logged step


def steps_from_events(events: DataFrame, pipeline: str = "trips") -> DataFrame:
    """Run-log rows (input of O3) of every step found in Spark's own event log, with
    the tasks and bytes of all its stages, however many the status tracker keeps.
    A step's time runs from its first task to its last; one that ran no task has no
    row. The status of a step is not in the event log and stays null."""
    job = F.regexp_extract("job_group", STEP_GROUP, 1)
    return group_tasks(events).filter(F.col("job_group").rlike(STEP_GROUP)).select(
        F.timestamp_millis("launched").cast("timestamp_ntz").alias("ts"),
        F.lit(pipeline).alias("pipeline"),
        job.alias("job"),
        F.lit(None).cast("string").alias("status"),
        (F.col("finished") - F.col("launched")).alias("elapsed_ms"),
        "tasks",
        "bytes_read",
    )


class RunLogger:
    """Time a run and its steps and append one run-log row for each. A step whose
    gate failed is FAILED, and so is the run it stopped, raised or not.

    Each step runs under its own Spark job group, so the completed task count
    is read from the public status tracker; bytes read are not exposed to
    Python and stay null (``steps_from_events`` has both, from the event log). The
    rows are a handful of per-step metadata values, written with one small append
    at ``flush``.
    """

    def __init__(self, spark, path: str | None, pipeline: str = "trips"):
        self.spark, self.path, self.pipeline = spark, path, pipeline
        self.rows: list[tuple] = []

    def step(self, job: str):
        return _Step(self, job)

    def flush(self) -> None:
        if self.path and self.rows:
            from strata.contracts import RUN_LOG

            from strata.functions.literals import literal_frame

            literal_frame(self.spark, self.rows, RUN_LOG).write.mode("append").parquet(self.path)
        self.rows = []


class _Step:
    def __init__(self, log: RunLogger, job: str):
        self.log, self.job, self.failed = log, job, False
        self.first = len(log.rows)

    def fail(self) -> None:
        """Log the step as failed although it ends without an exception."""
        self.failed = True

    def __enter__(self):
        import datetime as dt
        import time
        import uuid

        self.group = f"strata-{self.job}-{uuid.uuid4().hex[:8]}"
        self.log.spark.sparkContext.setJobGroup(self.group, self.job)
        self.ts = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        self.t0 = time.perf_counter()
        return self

    def __exit__(self, exc_type, exc, tb):
        import time

        elapsed = int((time.perf_counter() - self.t0) * 1000)
        sc = self.log.spark.sparkContext
        tracker = sc.statusTracker()
        tasks = 0
        for jid in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(jid)
            for sid in info.stageIds if info else []:
                stage = tracker.getStageInfo(sid)
                tasks += stage.numCompletedTasks if stage else 0
        sc.setLocalProperty("spark.jobGroup.id", None)
        if self.job == EXECUTION:
            tasks += sum(r[5] for r in self.log.rows[self.first :])
        status = "SUCCEEDED" if exc_type is None and not self.failed else "FAILED"
        self.log.rows.append((self.ts, self.log.pipeline, self.job, status, elapsed, tasks, None))
        return False
