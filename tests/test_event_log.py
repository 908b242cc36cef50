"""Job telemetry from Spark's own event log, and byte limits of the contract."""

import subprocess
import sys
import textwrap

from pyspark.sql import functions as F

from strata.contracts import DIM_ZONE
from strata.operators.contract import contract_report, enforce_contract
from strata.plans.runlog import job_metrics, steps_from_events
from strata.sources.event_log import group_tasks, read_event_log
from tests.conftest import SF001


def test_event_log_has_all_tasks_and_bytes_of_a_step(spark, work):
    """A step of more stages than the status tracker keeps, in a session of its own."""
    script = f"""
    from strata.session import build_session
    from strata.plans.runlog import RunLogger
    spark = build_session("local[2]", conf={{
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": "{work}/log", "spark.eventLog.compress": "false",
        "spark.ui.enabled": "false", "spark.ui.retainedStages": "2", "spark.ui.retainedJobs": "2"}})
    log = RunLogger(spark, "{work}/runs")
    with log.step("many"):
        for _ in range(12):
            spark.range(0, 9, 1, 3).write.format("noop").mode("overwrite").save()
    with log.step("scan"):
        spark.read.parquet("{SF001}/events.parquet").write.format("noop").mode("overwrite").save()
    with log.step("idle"):
        pass
    spark.range(5).count()
    log.flush()
    spark.stop()
    """
    import os

    os.makedirs(f"{work}/log")
    subprocess.run([sys.executable, "-c", textwrap.dedent(script)], check=True, timeout=300,
                   cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    events = read_event_log(spark, f"{work}/log")
    steps = {r.job: r for r in steps_from_events(events).collect()}
    assert set(steps) == {"many", "scan"}
    assert steps["many"].tasks == 36 and steps["many"].bytes_read == 0
    assert steps["scan"].tasks >= 1 and steps["scan"].bytes_read > 0 and steps["scan"].elapsed_ms >= 0
    assert group_tasks(events).filter("job_group IS NULL").count() == 1
    total = job_metrics(steps_from_events(events)).agg(F.sum("completed_tasks").alias("n")).first().n
    assert total == sum(r.tasks for r in steps.values())
    logged = spark.read.parquet(f"{work}/runs")
    assert logged.filter("job = 'many'").first().tasks <= 36


def test_broken_lines_and_logs_of_two_applications(spark, work):
    """Stages of different applications share numbers; a broken line is no event."""
    end = ('{"Event":"SparkListenerTaskEnd","Stage ID":0,"Stage Attempt ID":0,"Task End Reason":{"Reason":"%s"},'
           '"Task Info":{"Launch Time":1000,"Finish Time":%d}}')
    sub = ('{"Event":"SparkListenerStageSubmitted","Stage Info":{"Stage ID":0,"Stage Attempt ID":0},'
           '"Properties":{"spark.jobGroup.id":"strata-%s-0123abcd"}}')
    lines = [sub % "load", end % ("Success", 1500), end % ("ExceptionFailure", 1700), '{"Event":"SparkLis']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{work}/e/eventlog_v2_app-1")
    lines = [sub % "gold-load", end % ("Success", 1100)]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{work}/e/eventlog_v2_app-2")
    got = {r.job: (r.tasks, r.bytes_read, r.elapsed_ms) for r in steps_from_events(read_event_log(spark, f"{work}/e")).collect()}
    assert got == {"load": (1, 0, 700), "gold-load": (1, 0, 100)}


def test_limits_are_bytes(spark):
    rows = spark.createDataFrame([(1, "é" * 40), (2, "e" * 64), (3, None), (4, "é" * 32)], "location_id int, borough string")
    rows = rows.withColumns({"zone": F.lit("z"), "service_zone": F.lit("s"), "load_timestamp": F.lit(None).cast("timestamp")})
    kept, bad = enforce_contract(rows, DIM_ZONE)
    assert sorted(r.location_id for r in kept.collect()) == [2, 3, 4]
    assert [r.violations for r in bad.collect()] == ["borough max_length 64"]
    assert contract_report(rows, DIM_ZONE, "dim_zone").filter("violations > 0").count() == 1
