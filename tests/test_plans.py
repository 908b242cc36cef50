"""Physical-plan properties: pushdown, pruning, join strategy, one scan."""

from strata.plans import reports
from strata.plans.registry import demo_silver, demo_star
from strata.sources import sample
from tests.conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_silver_enrichment_broadcasts_the_lookup(spark):
    p = plan(demo_silver(spark, SF001))
    assert p.count("BroadcastHashJoin") >= 2
    assert "SortMergeJoin" not in p


def test_report_scan_reads_only_needed_columns(spark):
    p = plan(reports.pickup_hour_volume(demo_star(spark, SF001)))
    scan = [line for line in p.splitlines() if "ReadSchema" in line or "FileScan parquet" in line]
    joined = " ".join(scan)
    assert "props" not in joined  # events.props is never read by this report


def test_zone_reports_never_join_the_fact(spark):
    # The fact is aggregated by location id before any join with dim_zone:
    # every join input on the fact side is an aggregate.
    df = reports.top_routes(demo_star(spark, SF001))
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in optimized
    assert optimized.count("Aggregate") >= 3


def test_rules_are_one_scan(spark):
    from strata.operators.quality import evaluate
    from strata.rulesets import silver_ruleset

    p = plan(evaluate(demo_silver(spark, SF001), silver_ruleset()))
    assert p.count("FileScan parquet") + p.count("Scan parquet") >= 1
    # one aggregate over the table (partial + final), no per-rule jobs
    assert p.count("HashAggregate") == 2


def test_run_filter_is_a_partition_filter(spark, work):
    from strata.sinks.silver import write_silver
    from strata.sources.silver import read_silver, scope_run

    write_silver(demo_silver(spark, SF001), f"{work}/silver")
    p = plan(scope_run(read_silver(spark, f"{work}/silver"), "run-0001"))
    assert "PartitionFilters: [isnotnull(run_id" in p


def test_bounded_broadcast_falls_back_beyond_bound(spark):
    from pyspark.sql import functions as F

    from strata.operators.joins import bounded_broadcast, fits_broadcast

    zones = sample.zone_lookup(spark, SF001)
    assert fits_broadcast(zones, 25) and not fits_broadcast(zones, 24)
    big = spark.range(100).withColumnRenamed("id", "k")
    small = bounded_broadcast(spark.range(10).withColumnRenamed("id", "k").withColumn("x", F.lit(1)), 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(big.join(small, "k"))
        assert "BroadcastHashJoin" not in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_upsert_hot_key_is_split_by_aqe(spark, work):
    """A trip copied into a third of the target: with the delete list staged,
    the anti join is a plain shuffle join and AQE splits the hot partition."""
    from pyspark.sql import functions as F

    from strata.operators.upsert import stage_keys, upsert

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        tid = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
        target = spark.range(30000).select(tid.alias("trip_id"), F.col("id").alias("v")).repartition(8)
        staged = spark.range(0, 30000, 7).select(tid.alias("trip_id"), F.col("id").alias("v"))
        out = upsert(target, staged, "trip_id", stage_keys(staged, "trip_id", f"{work}/keys"))
        ids = range(0, 30000, 7)
        key = lambda i: "hot" if i % 3 == 0 else str(i)
        deleted = {key(i) for i in ids}
        kept = sum(1 for i in range(30000) if key(i) not in deleted)
        assert out.count() == kept + len(ids)
        out.collect()
        assert "SortMergeJoin(skew=true)" in plan(out)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_cluster_fact_splits_a_hot_date(spark):
    """One date holds a third of the rows: rebalance spreads it over several
    tasks instead of one (AQE splits skewed rebalance partitions)."""
    from pyspark.sql import functions as F

    from strata.operators.dims import cluster_fact

    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
            "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.2"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(60000)
        fact = ids.select(
            F.when(F.col("id") % 3 == 0, F.lit(20240101)).otherwise(20240102 + F.col("id") % 20)
            .cast("int").alias("pickup_date_key"),
            (F.col("id") % 24).cast("short").alias("pickup_hour"),
            (F.col("id") % 250).cast("int").alias("pu_location_id"),
            F.col("id").alias("payload"),
        )
        out = cluster_fact(fact).withColumn("task", F.spark_partition_id())
        hot_tasks = out.where("pickup_date_key = 20240101").select("task").distinct().count()
        assert out.count() == 60000
        assert hot_tasks > 1
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_compact_silver_write_packs_small_inputs(spark, work):
    import glob

    from strata.sinks.silver import write_silver
    from strata.sources.silver import read_silver

    silver = demo_silver(spark, SF001).repartition(20)
    write_silver(silver, f"{work}/loose")
    write_silver(silver, f"{work}/packed", compact=True)
    files = lambda d: len(glob.glob(f"{work}/{d}/w=*/*/*/*/*.parquet".replace("file:", "")))
    assert files("packed") < files("loose")
    assert read_silver(spark, f"{work}/packed").count() == read_silver(spark, f"{work}/loose").count()


def test_gates_read_only_rule_columns(spark, work):
    """The Bronze gate runs before the Silver job, so Bronze is scanned twice;
    the gate's scan must carry only the columns its rules use."""
    from strata.operators.derive import prepare_bronze
    from strata.operators.quality import evaluate
    from strata.rulesets import bronze_ruleset
    from strata.sources.bronze import read_bronze

    sample.raw_trips(spark, SF001, lineage=False).write.parquet(f"{work}/bronze")
    p = plan(evaluate(prepare_bronze(read_bronze(spark, f"{work}/bronze", lineage=False)), bronze_ruleset()))
    schema = [line for line in p.splitlines() if "ReadSchema" in line][0]
    read = schema.split("ReadSchema: struct<")[1]
    assert "Pickup_datetime" in read and "dropOff_datetime" in read
    for unused in ("PUlocationID", "DOlocationID", "Affiliated_base_number", "SR_Flag", "dispatching_base_num"):
        assert unused not in read


def test_reports_over_published_star_broadcast_dimensions(spark, work):
    """Over a published star the dimension joins (against pre-aggregated fact
    rows) are planned as broadcast hash joins from the small dimension files;
    no sort-merge join, and the fact scan reads only the report's columns."""
    from strata.sinks.gold import publish_star, read_star

    publish_star(spark, demo_star(spark, SF001), f"{work}/star")
    star = read_star(spark, f"{work}/star")
    for report in (reports.top_routes, reports.borough_flows, reports.daily_trip_volume):
        df = report(star)
        df.collect()
        p = plan(df)
        assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p, report.__name__
    p = plan(reports.top_routes(star))
    fact_scan = [line for line in p.splitlines() if "ReadSchema" in line and "trip_duration_minutes" in line][0]
    assert "trip_id" not in fact_scan and "source_file" not in fact_scan


def test_gate_scans_the_table_once(spark):
    """The outcomes a gate returns (and the pipeline stores) come from the one
    settled row of counts: no file scan left in their plan."""
    from strata.operators.quality import evaluate, gate
    from strata.rulesets import silver_ruleset

    silver = demo_silver(spark, SF001)
    decision, outcomes = gate(silver, silver_ruleset())
    p = plan(outcomes)
    assert "FileScan" not in p and "Scan parquet" not in p
    want = sorted(map(tuple, evaluate(silver, silver_ruleset()).collect()))
    assert sorted(map(tuple, outcomes.collect())) == want
    assert decision.total_rules == 11 and decision.passed


def test_publish_by_date_lists_untouched_dates_again(spark, work):
    from strata.plans.scenarios import run_star
    from strata.sinks import commits
    from strata.sinks.gold import FACT_DIR, publish_star

    for run in ("run-a", "run-b"):
        publish_star(spark, run_star(spark, SF001, run), f"{work}/star", fact_mode="snapshot_by_date")
    one, two = (commits.read_commit(spark, f"{work}/star", v).parts(FACT_DIR) for v in (1, 2))
    same = {d for d in one if one[d] == two[d]}
    assert same and {int(d) % 100 for d in same} <= set(range(1, 11))
    assert {int(d) % 100 for d in set(two) - same} <= set(range(11, 32))
