"""Registered queries that exercise sources, sinks, quality, upsert and
publish on data derived from the supplied tables.

Scenario: two overlapping runs. ``run-a`` delivers trips picked up on days
1-20, ``run-b`` (a re-delivery) days 11-30; every trip of the table is in at
least one run. Writes go to a fresh folder under the shared work folder
(``session.shared_dir``), never a machine-local one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.contracts import FACT, SILVER_PARTITIONS
from strata.operators import quality as Q
from strata.operators.aggregates import batch_counts
from strata.operators.contract import contract_report
from strata.sources.event_log import read_event_log
from strata.operators.derive import enriched_trips, prepare_bronze, silver_columns, to_silver
from strata.operators.dims import build_star, cluster_fact
from strata.operators.filters import rejected_trips, unresolved, unresolved_predicate, validity_predicate
from strata.operators.normalize import normalize_columns
from strata.operators.upsert import replaced_rows, upsert
from strata.plans import reports, runlog
from strata.plans.registry import RUN_ID, _memo, demo_silver, demo_star, demo_zones, register
from strata.rulesets import bronze_ruleset, silver_ruleset
from strata.session import shared_dir
from strata.sinks import gold as G
from strata.sinks import commits
from strata.sinks.silver import WRITE, write_silver
from strata.sources import sample
from strata.plans.gold_job import load_gold
from strata.plans.incremental_run import run_incremental
from strata.plans.run import PipelineConfig
from strata.sources.bronze import read_bronze, read_drifting_bronze
from strata.sources.catalog import catalog_drift, register_table
from strata.sources.lookup import read_zone_lookup, write_zone_csv
from strata.sources.silver import read_silver, scope_run
from strata.streaming.incremental import read_incremental, silver_batch_writer

RUNS = {"run-a": (1, 20), "run-b": (11, None)}  # days; the last run takes all that follow
STRICT_RESULT_ID = f"silver/{RUN_ID}"


def _work(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, "queries", name, unique=True)


def raw_days(spark: SparkSession, sf_dir: str, first: int, last: int | None) -> DataFrame:
    day = F.dayofmonth("Pickup_datetime")
    raw = sample.raw_trips(spark, sf_dir).filter(day >= first)
    return raw if last is None else raw.filter(day <= last)


def run_silver(spark: SparkSession, sf_dir: str, run_id: str) -> DataFrame:
    first, last = RUNS[run_id]
    return _memo(spark, ("run_silver", sf_dir, run_id),
                 lambda: to_silver(raw_days(spark, sf_dir, first, last), demo_zones(spark, sf_dir), run_id))


def run_star(spark: SparkSession, sf_dir: str, run_id: str) -> dict[str, DataFrame]:
    return _memo(spark, ("run_star", sf_dir, run_id),
                 lambda: build_star(run_silver(spark, sf_dir, run_id), demo_zones(spark, sf_dir)))


def derived_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver columns before the validity filter (what the filter judges)."""
    return _memo(spark, ("derived", sf_dir), lambda: silver_columns(
        enriched_trips(sample.raw_trips(spark, sf_dir), demo_zones(spark, sf_dir)), RUN_ID))


# --- sources -----------------------------------------------------------------
def write_bronze_layout(raw: DataFrame, root: str) -> None:
    """Raw files under ``<root>/fhvhv_trips/_y=<yyyy>/_m=<m>/`` (one write job;
    the helper columns live only in directory names) plus a zone CSV beside
    them that a ``*.parquet`` glob must skip."""
    d = F.col("Pickup_datetime")
    (raw.drop("source_file").withColumns({"_y": F.year(d), "_m": F.month(d)})
        .write.mode("overwrite").partitionBy("_y", "_m").parquet(f"{root}/fhvhv_trips"))


@register("bronze_scan")
def bronze_scan(spark, sf_dir):
    """Recursive, glob-filtered Bronze read of nested month folders."""
    root = _work(spark, "bronze_scan")
    write_bronze_layout(sample.raw_trips(spark, sf_dir), root)
    write_zone_csv(demo_zones(spark, sf_dir), f"{root}/fhvhv_trips/reference")
    return prepare_bronze(read_bronze(spark, f"{root}/fhvhv_trips", lineage=False))


@register("source_file_lineage")
def source_file_lineage(spark, sf_dir):
    """Rows per source folder, from the file path of each row."""
    root = _work(spark, "lineage")
    write_bronze_layout(sample.raw_trips(spark, sf_dir), root)
    df = read_bronze(spark, f"{root}/fhvhv_trips", lineage=True)
    path = F.col("source_file")
    return df.groupBy(
        F.regexp_extract(path, r"/_y=(\d+)/", 1).cast("int").alias("pickup_year"),
        F.regexp_extract(path, r"/_m=(\d+)/", 1).cast("int").alias("pickup_month"),
    ).agg(F.count(F.lit(1)).alias("trips"))


@register("zone_lookup_csv")
def zone_lookup_csv(spark, sf_dir):
    """Headered CSV lookup -> typed zones."""
    path = _work(spark, "zones_csv")
    write_zone_csv(demo_zones(spark, sf_dir), path)
    return read_zone_lookup(spark, path)


@register("normalize_zone_columns")
def normalize_zone_columns(spark, sf_dir):
    """Mixed-case CSV headers -> canonical names, no alias map."""
    path = _work(spark, "zones_raw")
    write_zone_csv(demo_zones(spark, sf_dir), path)
    return normalize_columns(spark.read.option("header", "true").csv(path))


def _two_run_silver_path(spark, sf_dir) -> str:
    def build():
        path = _work(spark, "silver")
        for run in RUNS:
            write_silver(run_silver(spark, sf_dir, run), path)
        return path

    return _memo(spark, ("silver_path", sf_dir), build)


@register("silver_roundtrip")
def silver_roundtrip(spark, sf_dir):
    """Two runs appended to partitioned Silver, read back with its schema."""
    return read_silver(spark, _two_run_silver_path(spark, sf_dir))


@register("scope_run")
def scope_run_b(spark, sf_dir):
    """One run of Silver; a partition filter on ``run_id``."""
    return scope_run(read_silver(spark, _two_run_silver_path(spark, sf_dir)), "run-b")


@register("scope_all_runs")
def scope_all(spark, sf_dir):
    """The ``manual`` sentinel keeps every run."""
    return scope_run(read_silver(spark, _two_run_silver_path(spark, sf_dir)), "manual")


@register("registered_silver")
def registered_silver(spark, sf_dir):
    """Silver registered in the catalog with partition discovery."""
    from strata.contracts import SILVER

    from pyspark.sql import types as T

    name = "silver_" + _work(spark, "tbl").rsplit("/", 1)[-1][:12]
    layout = T.StructType([*SILVER.fields, T.StructField(WRITE, T.StringType())])
    levels = (WRITE, *SILVER_PARTITIONS)
    table = register_table(spark, name, _two_run_silver_path(spark, sf_dir), layout, levels)
    return table.groupBy("run_id").agg(F.count(F.lit(1)).alias("trips"))


EXTRA_COLUMN = "access_a_ride_flag"


@register("schema_merge")
def schema_merge(spark, sf_dir):
    """Files written later gain a column; a merged-schema read returns it,
    null for the older files (S7 schema evolution)."""
    root = _work(spark, "merge")
    old = raw_days(spark, sf_dir, 1, 15).drop("source_file")
    new = raw_days(spark, sf_dir, 16, 31).drop("source_file").withColumn(
        EXTRA_COLUMN, F.when(F.col("dispatching_base_num") == "click", "Y").otherwise("N"))
    old.write.mode("overwrite").parquet(f"{root}/2024/01a")
    new.write.mode("overwrite").parquet(f"{root}/2024/01b")
    return prepare_bronze(read_bronze(spark, root, lineage=False, merge_schema=True))


@register("incremental_ingest")
def incremental_ingest(spark, sf_dir):
    """Files arrive in waves (days 1-10, nothing, days 11-31); each wave only
    processes new files, through foreachBatch into Silver (S2). Path-derived
    columns (source_file, trip_id) and the per-batch run id are left out."""
    root = _work(spark, "incremental")
    landing, silver, ckpt = f"{root}/landing", f"{root}/silver", f"{root}/_checkpoint"
    raw_schema = sample.raw_trips(spark, sf_dir, lineage=False).schema
    writer = silver_batch_writer(demo_zones(spark, sf_dir), "inc", silver)
    for i, days in enumerate([(1, 10), None, (11, 31)]):
        if days:
            raw_days(spark, sf_dir, *days).drop("source_file").write.mode("overwrite").parquet(
                f"{landing}/wave={i}")
        read_incremental(spark, landing, raw_schema, ckpt, writer)
    out = read_silver(spark, silver)
    return out.drop("source_file", "trip_id", "run_id")


@register("incremental_published_fact")
def incremental_published_fact(spark, sf_dir):
    """The same waves taken all the way to Gold, each file once (S2). Path-derived
    columns and the per-batch run id are left out."""
    root = _work(spark, "incremental_gold")
    cfg = PipelineConfig(f"{root}/silver", f"{root}/stage", f"{root}/star", f"{root}/quarantine", f"{root}/dq",
                         fact_mode="snapshot_by_date")
    for i, days in enumerate([(1, 10), None, (11, 31)]):
        if days:
            complete = raw_days(spark, sf_dir, *days).drop("source_file").filter("dropOff_datetime IS NOT NULL")
            complete.write.parquet(f"{root}/landing/wave={i}")
        run_incremental(spark, f"{root}/landing", demo_zones(spark, sf_dir), "inc", cfg,
                        f"{root}/_checkpoint", f"{root}/ledger")
    return G.read_star(spark, f"{root}/star")["fact_fhvhv_trips"].drop("trip_id", "source_file", "source_run_id")


@register("bronze_spelling_drift")
def bronze_spelling_drift(spark, sf_dir):
    """Deliveries that spell their columns in three ways, read as one table."""
    root = _work(spark, "spelling")
    raw_days(spark, sf_dir, 1, 10).drop("source_file").write.parquet(f"{root}/2024/a")
    raw_days(spark, sf_dir, 11, 20).drop("source_file").withColumnsRenamed({
        "PUlocationID": "PULocationID", "DOlocationID": "do_location_id", "dropOff_datetime": "drop_off_datetime",
    }).write.parquet(f"{root}/2024/b")
    raw_days(spark, sf_dir, 21, None).drop("source_file").withColumnsRenamed({
        "PUlocationID": "pu location id", "SR_Flag": "sr flag", "dropOff_datetime": "DropOff_DateTime",
    }).write.parquet(f"{root}/2024/c")
    return prepare_bronze(read_drifting_bronze(spark, root, lineage=False))


@register("bronze_type_drift")
def bronze_type_drift(spark, sf_dir):
    """Deliveries whose ids and times have other types, read as one table."""
    root = _work(spark, "types")
    raw_days(spark, sf_dir, 1, 10).drop("source_file").write.parquet(f"{root}/2024/a")
    raw_days(spark, sf_dir, 11, 20).drop("source_file").withColumns({
        "PUlocationID": F.col("PUlocationID").cast("long"), "SR_Flag": F.col("SR_Flag").cast("string"),
    }).write.parquet(f"{root}/2024/b")
    raw_days(spark, sf_dir, 21, None).drop("source_file").withColumns({
        "DOlocationID": F.col("DOlocationID").cast("double"), "Pickup_datetime": F.col("Pickup_datetime").cast("string"),
    }).write.parquet(f"{root}/2024/c")
    return prepare_bronze(read_drifting_bronze(spark, root, lineage=False))


@register("two_manual_runs")
def two_manual_runs(spark, sf_dir):
    """Two hand-started runs over different files: the later one adds (K1)."""
    path = _work(spark, "manual")
    for days in ((1, 15), (16, None)):
        write_silver(to_silver(raw_days(spark, sf_dir, *days), demo_zones(spark, sf_dir), "manual"), path)
    return read_silver(spark, path)


@register("rerun_same_run_fact")
def rerun_same_run_fact(spark, sf_dir):
    """A run written again from a corrected source replaces all that it had (K1)."""
    root = _work(spark, "rerun")
    for days in ((1, 20), (11, None)):
        write_silver(to_silver(raw_days(spark, sf_dir, *days), demo_zones(spark, sf_dir), RUN_ID), f"{root}/silver")
    load_gold(spark, f"{root}/silver", demo_zones(spark, sf_dir), RUN_ID, f"{root}/stage", f"{root}/star")
    return G.read_star(spark, f"{root}/star")["fact_fhvhv_trips"]


@register("catalog_drift_log")
def catalog_drift_log(spark, sf_dir):
    """Days arrive with a new column, one day's files vanish: both are found by
    comparing the registered table with its folder (S7)."""
    root = _work(spark, "catalog_drift")
    name = "trips_" + root.rsplit("/", 1)[-1][:12]
    old = raw_days(spark, sf_dir, 1, 15).withColumn("d", F.dayofmonth("Pickup_datetime"))
    old.write.partitionBy("d").parquet(f"{root}/t")
    register_table(spark, name, f"{root}/t", old.schema, ("d",))
    commits.Folder(spark, f"{root}/t").delete("d=1")
    new = raw_days(spark, sf_dir, 16, None).withColumn("d", F.dayofmonth("Pickup_datetime"))
    new.withColumn(EXTRA_COLUMN, F.lit("Y")).write.mode("append").partitionBy("d").parquet(f"{root}/t")
    catalog_drift(spark, name, f"{root}/t", f"{root}/log")
    return spark.read.parquet(f"{root}/log").drop("table_name")


# --- sinks -------------------------------------------------------------------
@register("gold_stage")
def gold_stage(spark, sf_dir):
    """Per-run staging write and positional read-back of the fact (K3, K6)."""
    base = _work(spark, "stage")
    G.write_gold_stage(demo_star(spark, sf_dir), base, RUN_ID)
    return G.read_gold_stage(spark, base, RUN_ID)["fact_fhvhv_trips"]


@register("quarantine_batch")
def quarantine_batch(spark, sf_dir):
    """Run copied to quarantine with audit columns (K4)."""
    out = G.quarantine(demo_silver(spark, sf_dir), RUN_ID, "silver-fhvhv-quality",
                       STRICT_RESULT_ID, "0.5", _work(spark, "quarantine"))
    return spark.read.parquet(out)


@register("star_ddl")
def star_ddl(spark, sf_dir):
    """Idempotent star DDL, then a positional load into the staging tables (K5)."""
    root = _work(spark, "ddl")
    schema = "star_" + root.rsplit("/", 1)[-1][:12]
    G.create_star(spark, schema, root)
    G.create_star(spark, schema, root)  # idempotent
    star = demo_star(spark, sf_dir)
    parts = []
    for name in ("fact_fhvhv_trips", "dim_date", "dim_zone"):
        cols = [f.name for f in G.STAR_TABLES[name].fields]
        star[name].select(*cols).write.insertInto(f"{schema}.staging_{name}", overwrite=True)
        parts.append(spark.table(f"{schema}.staging_{name}").agg(F.count(F.lit(1)).alias("row_count"))
                     .select(F.lit(name).alias("table_name"), "row_count"))
    return reduce(DataFrame.unionByName, parts)


@register("contract_violations")
def contract_violations(spark, sf_dir):
    """Violations per NOT NULL / VARCHAR(n) constraint of the fact contract (K8)."""
    return contract_report(demo_star(spark, sf_dir)["fact_fhvhv_trips"], FACT, "fact_fhvhv_trips")


@register("contract_violations_found")
def contract_violations_found(spark, sf_dir):
    """The same report over a fact that breaks it: keys missing, and codes whose bytes
    are beyond the limit, also where their characters are not (K8)."""
    hour, accent = F.col("pickup_hour"), F.lit("\u00e9")
    broken = demo_star(spark, sf_dir)["fact_fhvhv_trips"].withColumns({
        "trip_id": F.when(hour == 4, None).otherwise(F.col("trip_id")),
        "dispatching_base_num": F.when(hour == 5, F.repeat(accent, 20)).otherwise(F.col("dispatching_base_num")),
        "affiliated_base_number": F.when(hour == 6, F.repeat(F.lit("e"), 32)).when(
            hour == 7, F.repeat(F.lit("e"), 33)).otherwise(F.col("affiliated_base_number")),
    })
    return contract_report(broken, FACT, "fact_fhvhv_trips")


@register("dq_results_store")
def dq_results_store(spark, sf_dir):
    """Rule outcomes appended per ruleset and read back."""
    path = _work(spark, "dq_results")
    G.save_rule_results(Q.evaluate(prepare_bronze(sample.raw_trips(spark, sf_dir)), bronze_ruleset()), path)
    G.save_rule_results(Q.evaluate(demo_silver(spark, sf_dir), silver_ruleset()), path)
    return spark.read.parquet(path)


# --- upsert / publish --------------------------------------------------------
@register("upsert_dim_zone")
def upsert_dim_zone(spark, sf_dir):
    """Prior zones (ids shifted by 10, relabelled) upserted with the current ones (K7)."""
    cur = demo_star(spark, sf_dir)["dim_zone"]
    prior = cur.select((F.col("location_id") + 10).alias("location_id"), "borough",
                       F.concat(F.col("zone"), F.lit(" (prior)")).alias("zone"), "service_zone",
                       "load_timestamp")
    return upsert(prior, cur, "location_id")


@register("upsert_dim_date")
def upsert_dim_date(spark, sf_dir):
    return upsert(run_star(spark, sf_dir, "run-a")["dim_date"], run_star(spark, sf_dir, "run-b")["dim_date"],
                  "date_key")


@register("upsert_fact")
def upsert_fact(spark, sf_dir):
    """run-b re-delivers days 11-20 of run-a: those rows are replaced."""
    return upsert(run_star(spark, sf_dir, "run-a")["fact_fhvhv_trips"],
                  run_star(spark, sf_dir, "run-b")["fact_fhvhv_trips"], "trip_id")


@register("upsert_replaced_rows")
def upsert_replaced(spark, sf_dir):
    return replaced_rows(run_star(spark, sf_dir, "run-a")["fact_fhvhv_trips"],
                         run_star(spark, sf_dir, "run-b")["fact_fhvhv_trips"], "trip_id")


def _published(spark, sf_dir, fail_second: bool) -> str:
    root = _work(spark, "publish")
    G.publish_star(spark, run_star(spark, sf_dir, "run-a"), root)
    try:
        G.publish_star(spark, run_star(spark, sf_dir, "run-b"), root,
                       fail_after="dim_date" if fail_second else None)
    except RuntimeError:
        if not fail_second:
            raise
    return root


@register("published_fact")
def published_fact(spark, sf_dir):
    """Two snapshot publishes; the current fact is the upserted one (K9)."""
    root = _published(spark, sf_dir, fail_second=False)
    return G.read_star(spark, root)["fact_fhvhv_trips"]


@register("published_fact_partitions")
def published_fact_partitions(spark, sf_dir):
    """Same two publishes with the fact in date partitions: run-b rewrites
    only days 11-30; days 1-10 of run-a are left untouched (K9 scale mode)."""
    root = _work(spark, "publish_parts")
    G.publish_star(spark, run_star(spark, sf_dir, "run-a"), root, fact_mode="partitions")
    G.publish_star(spark, run_star(spark, sf_dir, "run-b"), root, fact_mode="partitions")
    return G.read_star(spark, root)["fact_fhvhv_trips"]


@register("published_fact_by_date")
def published_fact_by_date(spark, sf_dir):
    """Two atomic snapshots where the second copies days 1-10 of run-a without
    a shuffle and merges only the dates run-b touches (K9)."""
    root = _work(spark, "publish_by_date")
    G.publish_star(spark, run_star(spark, sf_dir, "run-a"), root, fact_mode="snapshot_by_date")
    G.publish_star(spark, run_star(spark, sf_dir, "run-b"), root, fact_mode="snapshot_by_date")
    return G.read_star(spark, root)["fact_fhvhv_trips"]


@register("published_card")
def published_card(spark, sf_dir):
    """A dashboard card's SQL on ``{{schema}}`` tables that follow two publishes."""
    root = _work(spark, "card")
    schema = "card_" + root.rsplit("/", 1)[-1][:12]
    G.create_star(spark, schema, root)
    for run in RUNS:
        G.publish_star(spark, run_star(spark, sf_dir, run), root, fact_mode="snapshot_by_date", catalog=schema)
    return reports.bound_query(
        spark,
        "SELECT d.day_name, f.pickup_hour, count(*) AS trips FROM {{schema}}.fact_fhvhv_trips f "
        "JOIN {{schema}}.dim_date d ON f.pickup_date_key = d.date_key GROUP BY d.day_name, f.pickup_hour",
        schema=schema,
    )


@register("expired_star_fact")
def expired_star_fact(spark, sf_dir):
    """Three publishes, then all but the newest version is deleted: it reads as
    before (K9 retention)."""
    root = _work(spark, "expired")
    for run in ("run-a", "run-b", "run-b"):
        G.publish_star(spark, run_star(spark, sf_dir, run), root, fact_mode="snapshot_by_date")
    G.expire_star(spark, root, keep=1, grace_seconds=0)
    return G.read_star(spark, root)["fact_fhvhv_trips"]


@register("publish_rollback")
def publish_rollback(spark, sf_dir):
    """The second publish fails after two tables: readers still see the first
    version in full (K9)."""
    root = _published(spark, sf_dir, fail_second=True)
    return reports.warehouse_table_counts(G.read_star(spark, root))


@register("clustered_fact")
def clustered_fact(spark, sf_dir):
    """Fact laid out by date key, sorted by (date key, hour, pickup id) (T4)."""
    return cluster_fact(demo_star(spark, sf_dir)["fact_fhvhv_trips"])


@register("bound_table_query")
def bound_table_query(spark, sf_dir):
    """Dashboard SQL with a ``{{fact}}`` placeholder bound as an identifier."""
    view = "fact_" + _work(spark, "view").rsplit("/", 1)[-1][:12]
    demo_star(spark, sf_dir)["fact_fhvhv_trips"].createOrReplaceTempView(view)
    return reports.bound_query(
        spark,
        "SELECT pickup_hour, count(*) AS trips FROM {{fact}} GROUP BY pickup_hour",
        fact=view,
    )


# --- quality -----------------------------------------------------------------
def _one(rule) -> Q.Ruleset:
    return Q.Ruleset("adhoc", (rule,))


@register("dq_row_count")
def dq_row_count(spark, sf_dir):
    return Q.evaluate(prepare_bronze(sample.raw_trips(spark, sf_dir)), _one(Q.row_count(0)))


@register("dq_is_complete")
def dq_is_complete(spark, sf_dir):
    return Q.evaluate(prepare_bronze(sample.raw_trips(spark, sf_dir)), _one(Q.is_complete("dropoff_datetime")))


@register("dq_completeness")
def dq_completeness(spark, sf_dir):
    return Q.evaluate(demo_silver(spark, sf_dir), _one(Q.completeness("pu_borough", 0.15)))


@register("dq_between")
def dq_between(spark, sf_dir):
    return Q.evaluate(derived_unfiltered(spark, sf_dir),
                      _one(Q.column_values("trip_duration_minutes", (0, 1440))))


@register("dq_bronze")
def dq_bronze(spark, sf_dir):
    """Bronze ruleset over the raw batch; fails on null drop-off times."""
    return Q.evaluate(prepare_bronze(sample.raw_trips(spark, sf_dir)), bronze_ruleset())


@register("dq_silver")
def dq_silver(spark, sf_dir):
    return Q.evaluate(demo_silver(spark, sf_dir), silver_ruleset())


@register("dq_silver_by_run")
def dq_silver_by_run(spark, sf_dir):
    """Silver ruleset per run, both runs in one grouped aggregate."""
    silver = run_silver(spark, sf_dir, "run-a").unionByName(run_silver(spark, sf_dir, "run-b"))
    return Q.evaluate_by(silver, silver_ruleset(), ["run_id"])


@register("dq_silver_incremental")
def dq_silver_incremental(spark, sf_dir):
    """Table-scope Silver outcomes from stored per-run counts: each run is
    scanned once when it lands; the table outcome sums the stored counts."""
    from strata.plans.run import table_outcomes_incremental

    path = _work(spark, "partials")
    silver = read_silver(spark, _two_run_silver_path(spark, sf_dir))
    out = None
    for run in RUNS:
        out = table_outcomes_incremental(spark, scope_run(silver, run), silver_ruleset(), path)
    return out


def _both_outcomes(spark, sf_dir) -> DataFrame:
    return dq_bronze(spark, sf_dir).unionByName(dq_silver(spark, sf_dir))


@register("dq_score")
def dq_score(spark, sf_dir):
    return Q.score(_both_outcomes(spark, sf_dir))


@register("dq_rule_counts")
def dq_rule_counts(spark, sf_dir):
    return Q.rule_counts(_both_outcomes(spark, sf_dir))


def _decision_frame(outcomes: DataFrame, min_score: float = 1.0) -> DataFrame:
    s = Q.score(outcomes)
    return s.withColumn("action", F.when(F.col("score") >= min_score, "publish").otherwise("quarantine"))


@register("gate_pass")
def gate_pass(spark, sf_dir):
    """Silver gate on the run passes (score 1.0) -> publish (Q7)."""
    decision, outcomes = Q.gate(demo_silver(spark, sf_dir), silver_ruleset())
    if not decision.passed:
        raise Q.GateFailed(decision)
    return _decision_frame(outcomes)


@register("gate_fail_quarantine")
def gate_fail_quarantine(spark, sf_dir):
    """Strict range (0 and 1440 excluded) fails on zero-minute trips: the run
    is quarantined with its score; the quarantined rows are returned (Q7, K4)."""
    silver = demo_silver(spark, sf_dir)
    decision, _ = Q.gate(silver, silver_ruleset(inclusive=False), result_id=STRICT_RESULT_ID)
    if decision.passed:
        raise ValueError("the strict gate was expected to fail on zero-minute trips")
    out = G.quarantine(silver, RUN_ID, decision.ruleset, decision.result_id, decision.score_text,
                       _work(spark, "gate_quarantine"))
    return spark.read.parquet(out)


@register("dq_failing_rows")
def dq_failing_rows(spark, sf_dir):
    """Rows breaking a row-level Silver rule, with the rules they break (Q9)."""
    bad = Q.failing_rows(derived_unfiltered(spark, sf_dir), silver_ruleset())
    return bad.select("trip_id", "pickup_datetime", "dropoff_datetime", "trip_duration_minutes", "failed_rules")


# --- filters / metrics / derivations -------------------------------------------
@register("batch_metrics")
def batch_metrics(spark, sf_dir):
    """Rows read, unresolved zones, rows kept: one pass (A1)."""
    return batch_counts(derived_unfiltered(spark, sf_dir), {
        "rows_read": None, "unresolved": unresolved_predicate(), "rows_written": validity_predicate()})


@register("rejected_by_reason")
def rejected_by_reason(spark, sf_dir):
    """Rows the validity filter drops, counted by first failing reason (F2)."""
    return rejected_trips(derived_unfiltered(spark, sf_dir)).groupBy("reject_reason").agg(
        F.count(F.lit(1)).alias("trips"))


@register("unresolved_zones")
def unresolved_zones(spark, sf_dir):
    """Trips with an unknown pickup or drop-off borough."""
    return unresolved(enriched_trips(sample.raw_trips(spark, sf_dir), demo_zones(spark, sf_dir))).select(
        "pu_location_id", "do_location_id", "pickup_datetime", "pu_borough", "do_borough")


@register("derive_calendar")
def derive_calendar(spark, sf_dir):
    return derived_unfiltered(spark, sf_dir).select(
        "pickup_datetime", "pickup_date", "pickup_year", "pickup_month", "pickup_day", "pickup_hour",
        "pickup_date_key")


@register("trip_duration")
def trip_duration(spark, sf_dir):
    return derived_unfiltered(spark, sf_dir).select("pickup_datetime", "dropoff_datetime",
                                                    "trip_duration_minutes")


@register("surrogate_key")
def surrogate_key(spark, sf_dir):
    return derived_unfiltered(spark, sf_dir).select(
        "trip_id", "dispatching_base_num", "pickup_datetime", "dropoff_datetime", "pu_location_id",
        "do_location_id", "affiliated_base_number", "source_file")


@register("sanitize_labels")
def sanitize_labels(spark, sf_dir):
    return derived_unfiltered(spark, sf_dir).select(
        "pu_borough", "pu_zone", "pu_borough_sanitized", "pu_zone_sanitized")


@register("stamp_run")
def stamp_run(spark, sf_dir):
    return derived_unfiltered(spark, sf_dir).select("trip_id", "run_id", "load_timestamp")


# --- run log -------------------------------------------------------------------
@register("execution_health")
def execution_health(spark, sf_dir):
    return runlog.execution_health(sample.run_log(spark, sf_dir))


@register("execution_time")
def execution_time(spark, sf_dir):
    return runlog.execution_time(sample.run_log(spark, sf_dir))


@register("job_metrics")
def job_metrics(spark, sf_dir):
    return runlog.job_metrics(sample.run_log(spark, sf_dir))


@register("event_log_steps")
def event_log_steps(spark, sf_dir):
    """Steps read out of Spark's event log (O3's input): the log is derived from
    ``events``, a finished task each, over 97 stages of seven steps."""
    path = _work(spark, "event_log")
    sample.event_log(spark, sf_dir).write.text(f"{path}/eventlog_v2_app-1")
    return runlog.steps_from_events(read_event_log(spark, path))


@register("rule_outcome_series")
def rule_outcome_series(spark, sf_dir):
    """Silver rules evaluated per pickup hour (one grouped aggregate), then
    passed/failed rules per ruleset per hourly bucket (O4)."""
    silver = demo_silver(spark, sf_dir)
    per_hour = Q.evaluate_by(silver, silver_ruleset(), ["pickup_date", "pickup_hour"])
    at = F.timestamp_add("HOUR", F.col("pickup_hour"), F.col("pickup_date").cast("timestamp_ntz"))
    return runlog.rule_outcome_series(per_hour.withColumn("evaluated_at", at), every="1 hour")
