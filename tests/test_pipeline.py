"""End-to-end runs: pass, quarantine, Bronze stop, crash before commit, rerun,
incremental waves."""

import pytest
from pyspark.sql import functions as F

from strata.operators.quality import GateFailed
from strata.plans.gold_job import load_gold
from strata.plans.run import PipelineConfig, run_pipeline
from strata.sinks.gold import committed_version, read_star
from strata.sources import sample
from tests.conftest import SF001


def cfg(work, **kw):
    return PipelineConfig(f"{work}/silver", f"{work}/stage", f"{work}/star", f"{work}/quarantine",
                          f"{work}/dq", run_log_path=f"{work}/runlog", **kw)


def clean_raw(spark):
    # A Bronze batch that passes the Bronze gate (no null drop-off times).
    return sample.raw_trips(spark, SF001).where(F.col("dropOff_datetime").isNotNull())


def fact_rows(spark, work):
    return read_star(spark, f"{work}/star")["fact_fhvhv_trips"].drop("load_timestamp")


def test_pass_then_rerun_then_quarantine(spark, work):
    zones = sample.zone_lookup(spark, SF001)
    rep = run_pipeline(spark, clean_raw(spark), zones, "r1", cfg(work))
    assert rep.bronze_gate.passed and rep.silver_gate.passed and rep.gold.version == 1
    assert rep.silver.rows_written == fact_rows(spark, work).count() > 0
    assert rep.silver.rows_read >= rep.silver.rows_written

    # Rerun of the same source under a new run id: same trip ids, so the fact
    # row set is unchanged apart from the run id.
    before = fact_rows(spark, work).drop("source_run_id")
    run_pipeline(spark, clean_raw(spark), zones, "r2", cfg(work))
    after = fact_rows(spark, work).drop("source_run_id")
    assert before.exceptAll(after).count() == 0 and after.exceptAll(before).count() == 0

    # A strict range rule fails on zero-minute trips: quarantine, no publish.
    with pytest.raises(GateFailed):
        run_pipeline(spark, clean_raw(spark), zones, "r3", cfg(work, silver_inclusive=False, gate_scope="run"))
    assert committed_version(spark, f"{work}/star") == 2
    q = spark.read.parquet(f"{work}/quarantine/run_id=r3")
    assert q.count() > 0 and {"quarantined_at", "dq_score", "dq_result_id", "dq_ruleset_name"} <= set(q.columns)
    assert q.select("dq_score").first()[0] == repr(10 / 11)


def test_bronze_gate_stops_before_silver(spark, work):
    zones = sample.zone_lookup(spark, SF001)
    with pytest.raises(GateFailed):
        run_pipeline(spark, sample.raw_trips(spark, SF001), zones, "r1", cfg(work))
    import os

    assert not os.path.exists(f"{work}/silver")


def test_crash_between_stage_and_commit_keeps_previous_version(spark, work):
    from strata.plans.registry import demo_silver

    zones = sample.zone_lookup(spark, SF001)
    silver = demo_silver(spark, SF001)
    load_gold(spark, silver, zones, "run-0001", f"{work}/stage", f"{work}/star")
    v1 = fact_rows(spark, work).count()
    with pytest.raises(RuntimeError):
        load_gold(spark, silver, zones, "run-0001", f"{work}/stage", f"{work}/star", fail_after="dim_date")
    assert committed_version(spark, f"{work}/star") == 1
    assert fact_rows(spark, work).count() == v1


def test_empty_run_touches_nothing(spark, work):
    from strata.plans.registry import demo_silver

    res = load_gold(spark, demo_silver(spark, SF001), sample.zone_lookup(spark, SF001), "no-such-run",
                    f"{work}/stage", f"{work}/star")
    assert not res.loaded and committed_version(spark, f"{work}/star") is None


def test_incremental_waves_only_new_files(spark, work):
    from strata.streaming.incremental import read_incremental

    raw = sample.raw_trips(spark, SF001, lineage=False)
    seen = []

    def on_batch(df, batch_id):
        seen.append(df.count())

    landing = f"{work}/landing"
    raw.where(F.dayofmonth("Pickup_datetime") <= 10).write.parquet(f"{landing}/w0")
    read_incremental(spark, landing, raw.schema, f"{work}/ckpt", on_batch)
    n0 = list(seen)
    read_incremental(spark, landing, raw.schema, f"{work}/ckpt", on_batch)
    assert seen == n0  # nothing new -> no batch
    raw.where(F.dayofmonth("Pickup_datetime") > 10).write.parquet(f"{landing}/w1")
    read_incremental(spark, landing, raw.schema, f"{work}/ckpt", on_batch)
    assert sum(seen) == raw.count() and len(seen) == len(n0) + 1


def test_streaming_gate_inside_batch(spark, work):
    from strata.rulesets import silver_ruleset
    from strata.sources.silver import read_silver
    from strata.streaming.incremental import read_incremental, silver_batch_writer

    raw = sample.raw_trips(spark, SF001, lineage=False)
    zones = sample.zone_lookup(spark, SF001)
    landing = f"{work}/landing"
    raw.write.parquet(f"{landing}/w0")
    strict = silver_batch_writer(zones, "s", f"{work}/silver", gate_ruleset=silver_ruleset(inclusive=False),
                                 quarantine_path=f"{work}/q")
    read_incremental(spark, landing, raw.schema, f"{work}/ckpt", strict)
    import os

    assert not os.path.exists(f"{work}/silver")  # failing batch never reached Silver
    assert spark.read.parquet(f"{work}/q/run_id=s-b0").count() > 0
    ok = silver_batch_writer(zones, "s", f"{work}/silver2", gate_ruleset=silver_ruleset())
    read_incremental(spark, landing, raw.schema, f"{work}/ckpt2", ok)
    assert read_silver(spark, f"{work}/silver2").count() > 0


def test_partition_mode_rewrites_only_touched_dates(spark, work):
    import glob
    import os

    from strata.plans.scenarios import run_star
    from strata.sinks.gold import publish_star

    root = f"{work}/star"
    publish_star(spark, run_star(spark, SF001, "run-a"), root, fact_mode="partitions")
    day1 = glob.glob(f"{root}/fact_fhvhv_trips/pickup_date_key=20240101/w=*/*.parquet")
    assert day1
    stamp = {p: os.path.getmtime(p) for p in day1}
    publish_star(spark, run_star(spark, SF001, "run-b"), root, fact_mode="partitions")
    # run-b covers days 11-30 only: day 1's files are the very same files
    assert {p: os.path.getmtime(p) for p in glob.glob(f"{root}/fact_fhvhv_trips/pickup_date_key=20240101/w=*/*.parquet")} == stamp
    fact = read_star(spark, root)["fact_fhvhv_trips"]
    runs = {r.source_run_id: r["count"] for r in fact.groupBy("source_run_id").count().collect()}
    assert set(runs) == {"run-a", "run-b"}


def test_contract_violation_stops_publish(spark, work):
    from strata.plans.registry import demo_silver
    from strata.sinks.gold import ContractViolation

    zones = sample.zone_lookup(spark, SF001)
    long_zone = zones.withColumn("zone", F.when(F.col("location_id") == 3, F.lit("z" * 129)).otherwise(F.col("zone")))
    with pytest.raises(ContractViolation) as err:
        load_gold(spark, demo_silver(spark, SF001), long_zone, "run-0001", f"{work}/stage", f"{work}/star")
    assert err.value.counts == {"dim_zone": {"zone max_length": 1}}
    assert committed_version(spark, f"{work}/star") is None


def test_run_log_and_stamped_outcomes_feed_rollups(spark, work):
    from strata.plans import runlog

    zones = sample.zone_lookup(spark, SF001)
    run_pipeline(spark, clean_raw(spark), zones, "r1", cfg(work))
    with pytest.raises(GateFailed):
        run_pipeline(spark, clean_raw(spark), zones, "r2", cfg(work, silver_inclusive=False, gate_scope="run"))
    log = spark.read.parquet(f"{work}/runlog")
    steps = {(r.job, r.status) for r in log.collect()}
    assert ("gold_load", "SUCCEEDED") in steps and ("silver_gate", "SUCCEEDED") in steps
    assert ("quarantine", "SUCCEEDED") in steps
    assert log.where("job = 'bronze_to_silver'").first().tasks > 0
    health = runlog.execution_health(log).agg(F.sum("started").alias("n")).first().n
    assert health == log.count()
    outcomes = spark.read.parquet(f"{work}/dq")
    series = runlog.rule_outcome_series(outcomes, every="1 hour").collect()
    assert sum(r.rules_failed for r in series) == 1  # the strict range rule of r2
    assert sum(r.rules_passed for r in series) == 3 + 3 + 11 + 10  # bronze x2, silver r1, r2


def test_incremental_table_gate_equals_full_table_gate(spark, work):
    """Three runs with the strict rule: the score from stored per-run counts
    equals the score over the whole Silver table, while each gate scans only
    its own run."""
    from strata.operators.quality import evaluate
    from strata.rulesets import silver_ruleset
    from strata.sources.silver import read_silver

    zones = sample.zone_lookup(spark, SF001)
    raw = clean_raw(spark)
    days = [(1, 9), (10, 19), (20, 31)]
    for i, (a, b) in enumerate(days):
        part = raw.where(F.dayofmonth("Pickup_datetime").between(a, b))
        rep = run_pipeline(spark, part, zones, f"r{i}", cfg(work, gate_scope="table_incremental"),
                           raise_on_fail=False)
        full = evaluate(read_silver(spark, f"{work}/silver"), silver_ruleset())
        want = sorted((r.rule_no, r.metric, r.passed) for r in full.collect())
        got = sorted((r.rule_no, r.metric, r.passed) for r in spark.read.parquet(f"{work}/dq/layer=silver")
                     .where(F.col("run_id") == f"r{i}").collect())
        assert got == want
        assert rep.silver_gate.passed == all(p for _, _, p in want)


def test_backfill_then_incremental_matches_full_table(spark, work):
    from strata.operators.quality import evaluate
    from strata.plans.run import backfill_partials, table_outcomes_incremental
    from strata.plans.scenarios import run_silver
    from strata.rulesets import silver_ruleset
    from strata.sinks.silver import write_silver
    from strata.sources.silver import read_silver, scope_run

    write_silver(run_silver(spark, SF001, "run-a"), f"{work}/silver")
    backfill_partials(read_silver(spark, f"{work}/silver"), silver_ruleset(), f"{work}/partials")
    write_silver(run_silver(spark, SF001, "run-b"), f"{work}/silver")
    silver = read_silver(spark, f"{work}/silver")
    got = table_outcomes_incremental(spark, scope_run(silver, "run-b"), silver_ruleset(), f"{work}/partials")
    want = evaluate(silver, silver_ruleset())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_observed_silver_metrics_equal_batch_metrics(spark, work):
    """The counts riding on the Silver write equal the oracle-checked
    batch_metrics aggregate over the same batch."""
    from strata.plans.scenarios import batch_metrics
    from strata.plans.silver_job import bronze_to_silver

    res = bronze_to_silver(sample.raw_trips(spark, SF001), sample.zone_lookup(spark, SF001), "run-0001",
                           f"{work}/silver")
    want = batch_metrics(spark, SF001).first()
    assert (res.rows_read, res.unresolved, res.rows_written) == (want.rows_read, want.unresolved, want.rows_written)
    assert res.written
