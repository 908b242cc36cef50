"""Mended losses: mode switch, null dates, unstored runs, the last day of a month."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from strata.functions.identifiers import BadIdentifier, plain_identifier
from strata.functions.columns import mean_minutes
from strata.operators.joins import fits_broadcast
from strata.operators.quality import GateFailed, evaluate
from strata.operators.upsert import in_partitions, partition_values, stage_keys, upsert_partitions
from strata.plans import runlog
from strata.plans.registry import demo_silver
from strata.plans.run import run_pipeline, table_outcomes_incremental
from strata.plans.scenarios import RUNS, run_star
from strata.rulesets import silver_ruleset
from strata.sinks.gold import publish_star, read_star
from strata.sources import sample
from test_pipeline import cfg, clean_raw, fact_rows


def test_last_run_has_no_upper_bound():
    assert RUNS["run-b"][1] is None


def test_changing_the_fact_mode_loses_nothing(spark, work):
    publish_star(spark, run_star(spark, SF001, "run-a"), f"{work}/star")
    publish_star(spark, run_star(spark, SF001, "run-b"), f"{work}/star", fact_mode="partitions")
    for run in ("run-a", "run-b"):
        publish_star(spark, run_star(spark, SF001, run), f"{work}/same")
    one, two = (read_star(spark, f"{work}/{r}")["fact_fhvhv_trips"].drop("load_timestamp") for r in ("star", "same"))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty() and one.count() > 0
    with pytest.raises(ValueError, match="fact_mode"):
        publish_star(spark, run_star(spark, SF001, "run-b"), f"{work}/star", fact_mode="other")


def test_null_dated_rows_stay_when_their_partition_is_rewritten(spark):
    target = spark.createDataFrame([(None, "a"), (1, "b"), (2, "c")], "day int, id string")
    staged = spark.createDataFrame([(None, "n"), (1, "b")], "day int, id string")
    got = {(r["day"], r["id"]) for r in upsert_partitions(target, staged, "id", "day").collect()}
    assert got == {(None, "a"), (None, "n"), (1, "b")}


def test_runs_without_stored_counts_enter_the_score(spark, work):
    rules = silver_ruleset()
    silver = demo_silver(spark, SF001)
    both = silver.unionByName(silver.withColumn("run_id", F.lit("older")))
    got = table_outcomes_incremental(spark, silver, rules, f"{work}/partials", both)
    assert sorted(map(str, got.collect())) == sorted(map(str, evaluate(both, rules).collect()))


def test_identifier_with_a_newline_is_refused():
    with pytest.raises(BadIdentifier):
        plain_identifier("gold\n")


def test_the_same_run_twice_leaves_silver_and_fact_alone(spark, work):
    from strata.sources.silver import read_silver

    zones = sample.zone_lookup(spark, SF001)
    counts = []
    for _ in range(2):
        run_pipeline(spark, clean_raw(spark), zones, "r1", cfg(work))
        fact = fact_rows(spark, work)
        counts.append((read_silver(spark, f"{work}/silver").count(), fact.count(), fact.distinct().count()))
    assert counts[0] == counts[1]


def test_run_log_counts_failed_gates_as_failed_runs(spark, work):
    zones = sample.zone_lookup(spark, SF001)
    run_pipeline(spark, clean_raw(spark), zones, "r1", cfg(work))
    with pytest.raises(GateFailed):
        run_pipeline(spark, sample.raw_trips(spark, SF001), zones, "r2", cfg(work))  # Bronze gate
    run_pipeline(spark, clean_raw(spark), zones, "r3", cfg(work, silver_inclusive=False, gate_scope="run"),
                 raise_on_fail=False)  # Silver gate
    log = spark.read.parquet(f"{work}/runlog")
    health = runlog.execution_health(runlog.executions(log), every="1 day")
    got = health.agg(F.sum("started"), F.sum("succeeded"), F.sum("failed")).first()
    assert tuple(got) == (3, 1, 2)
    assert log.filter("job = 'execution' and status = 'SUCCEEDED'").first()["tasks"] > 0


def test_partition_publish_scans_only_the_dates_of_the_batch(spark, work):
    star = run_star(spark, SF001, "run-a")
    publish_star(spark, star, f"{work}/star", fact_mode="partitions")
    target = read_star(spark, f"{work}/star")["fact_fhvhv_trips"]
    batch = star["fact_fhvhv_trips"].filter("pickup_date_key in (20240103, 20240104)")
    keys = stage_keys(batch, ["pickup_date_key", "trip_id"], f"{work}/keys")
    days = partition_values(keys, "pickup_date_key")
    assert sorted(days) == [20240103, 20240104]
    merged = upsert_partitions(target, batch, "trip_id", "pickup_date_key", keys, days)
    scan = merged._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters: [" in x and "20240103" in x and "20240104" in x for x in scan.splitlines())
    read = target.filter(in_partitions("pickup_date_key", days))
    assert read.select(F.input_file_name().alias("f")).filter("f not like '%20240103%' and f not like '%20240104%'").isEmpty()


def test_an_older_version_is_read_in_its_own_layout(spark, work):
    publish_star(spark, run_star(spark, SF001, "run-a"), f"{work}/star")
    first = read_star(spark, f"{work}/star")["fact_fhvhv_trips"].count()
    publish_star(spark, run_star(spark, SF001, "run-b"), f"{work}/star", fact_mode="snapshot_by_date")
    assert read_star(spark, f"{work}/star", 1)["fact_fhvhv_trips"].count() == first
    assert read_star(spark, f"{work}/star", 9) is None
    for run in ("run-a", "run-b"):
        publish_star(spark, run_star(spark, SF001, run), f"{work}/parts", fact_mode="partitions")
    assert read_star(spark, f"{work}/parts", 1)["fact_fhvhv_trips"].count() == first


def test_means_of_very_large_sums(spark):
    row = spark.range(1).select(mean_minutes(F.lit(6 * 10**17), F.lit(10**15)).alias("m")).first()
    assert row["m"] == 10.0


def test_wide_lookups_are_not_broadcast(spark):
    wide = spark.range(70).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    assert not fits_broadcast(wide) and fits_broadcast(wide.limit(10))
