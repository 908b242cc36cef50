"""Commits of Silver and of the star, incremental runs to Gold, drifting files,
catalogue tables that follow."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata.contracts import FACT
from strata.operators.quality import evaluate
from strata.operators.upsert import upsert
from strata.plans.incremental_run import batch_publisher, read_ledger, run_incremental
from strata.plans.registry import demo_silver, demo_zones
from strata.plans.run import table_outcomes_incremental
from strata.plans.scenarios import raw_days, run_star
from strata.rulesets import silver_ruleset
from strata.sinks import commits
from strata.sinks.gold import FACT_DIR, KEYS_DIR, create_star, expire_star, publish_star, read_star
from strata.sinks.silver import expire_silver, write_silver
from strata.sources.bronze import list_files, read_drifting_bronze, read_drifting_files, schema_groups, widest
from strata.sources.catalog import catalog_drift, register_table, sync_star
from strata.sources.silver import read_silver
from tests.conftest import SF001
from tests.test_pipeline import cfg


def fact_of(spark, root, version=None):
    return read_star(spark, root, version)[FACT_DIR].drop("load_timestamp")


def same(one, two):
    return one.exceptAll(two.select(*one.columns)).isEmpty() and two.select(*one.columns).exceptAll(one).isEmpty()


# --- commits ------------------------------------------------------------------
def test_of_two_writers_from_one_version_one_commits(spark, work):
    first = commits.commit(spark, work, None, [("t", None, "a")], run_id="r")
    commits.commit(spark, work, first, [("t", None, "b")])
    with pytest.raises(commits.CommitConflict):
        commits.commit(spark, work, first, [("t", None, "c")])
    assert commits.read_commit(spark, work).parts("t") == {None: "b"}
    assert commits.read_commit(spark, work, 1).run_id == "r" and commits.published_runs(spark, work) == {"r"}
    assert commits.read_commit(spark, work, 7) is None and commits.read_commit(spark, f"{work}/no") is None
    assert commits.commit(spark, work, commits.read_commit(spark, work), []).entries == ()


def test_interleaved_publishers_lose_nothing(spark, work, monkeypatch):
    """run-b is published whole between run-a's merge and its commit."""
    a, b, root = run_star(spark, SF001, "run-a"), run_star(spark, SF001, "run-b"), f"{work}/star"
    real, waiting = commits.commit, [True]

    def interleaved(*args, **kw):
        if waiting:
            waiting.clear()
            publish_star(spark, b, root, fact_mode="snapshot_by_date")
        return real(*args, **kw)

    monkeypatch.setattr(commits, "commit", interleaved)
    assert publish_star(spark, a, root, fact_mode="snapshot_by_date") == 2
    want = upsert(b[FACT_DIR], a[FACT_DIR], "trip_id").drop("load_timestamp")
    assert same(fact_of(spark, root), want)
    listed = commits.read_commit(spark, root).directories() | commits.read_commit(spark, root, 1).directories()
    found = {n for n, _ in commits.Folder(spark, root).matching(f"{FACT_DIR}/*/w=*")}
    assert found <= listed  # what the loser wrote first is gone

    def always(*args, **kw):
        raise commits.CommitConflict("again")

    monkeypatch.setattr(commits, "commit", always)
    with pytest.raises(commits.CommitConflict):
        publish_star(spark, a, root, fact_mode="snapshot_by_date", attempts=2)
    assert commits.versions(spark, root) == [1, 2]


def test_a_batch_of_two_dates_writes_two_directories_and_old_versions_stay(spark, work):
    star, root = run_star(spark, SF001, "run-a"), f"{work}/star"
    publish_star(spark, star, root)
    before = fact_of(spark, root).count()
    days = star[FACT_DIR].filter("pickup_date_key in (20240103, 20240104)").withColumn("sr_flag", F.lit(9))
    publish_star(spark, {**star, FACT_DIR: days}, root, run_id="two")
    one, two = (commits.read_commit(spark, root, v).parts(FACT_DIR) for v in (1, 2))
    assert {d for d in two if two[d] != one.get(d)} == {"20240103", "20240104"}
    assert fact_of(spark, root, 1).filter("sr_flag = 9").isEmpty() and fact_of(spark, root, 1).count() == before
    assert fact_of(spark, root).filter("sr_flag = 9").count() == days.count() and fact_of(spark, root).count() == before


def test_snapshot_mode_finds_a_trip_that_changed_its_date(spark, work):
    day = dt.datetime(2024, 1, 1)

    def star(*rows):
        fact = spark.createDataFrame([(k, d, f) for k, d, f in rows], "trip_id string, pickup_date_key int, sr_flag int")
        fact = fact.select(*[F.col(f.name) if f.name in fact.columns else F.lit(None).cast(f.dataType).alias(f.name)
                             for f in FACT.fields])
        return {**run_star(spark, SF001, "run-a"), FACT_DIR: fact}

    root = f"{work}/star"
    publish_star(spark, star(("a", 1, 0), ("b", 2, 0), (None, None, 0)), root)
    publish_star(spark, star(("a", 3, 1), (None, None, 1)), root)
    got = sorted(((r.trip_id, r.pickup_date_key, r.sr_flag) for r in fact_of(spark, root).collect()), key=str)
    assert got == sorted([("a", 3, 1), ("b", 2, 0), (None, None, 0), (None, None, 1)], key=str), day
    assert set(commits.read_commit(spark, root).parts(FACT_DIR)) == {"2", "3", "__HIVE_DEFAULT_PARTITION__"}


def test_retention_bounds_the_folder_and_keeps_versions_readable(spark, work):
    root = f"{work}/star"
    stars = [run_star(spark, SF001, r) for r in ("run-a", "run-b")]
    for k in range(4):
        publish_star(spark, stars[k % 2], root, fact_mode="snapshot_by_date")
    with pytest.raises(RuntimeError):
        publish_star(spark, stars[0], root, fail_after=FACT_DIR)  # leaves directories that no commit lists
    latest = fact_of(spark, root).collect()
    assert all("_commits/v=" in n for n in expire_star(spark, root, keep=3))  # the data is within its grace
    assert expire_star(spark, root, keep=2, grace_seconds=0)
    listed = set().union(*(commits.read_commit(spark, root, v).directories() for v in (3, 4)))
    folder = commits.Folder(spark, root)
    found = {n for p in (f"{FACT_DIR}/*/w=*", f"{KEYS_DIR}/*/w=*", "dim_*/w=*", "_merge/*") for n, _ in folder.matching(p)}
    assert found == listed and commits.versions(spark, root) == [3, 4]
    assert sorted(fact_of(spark, root).collect(), key=str) == sorted(latest, key=str)
    assert fact_of(spark, root, 3).count() > 0 and read_star(spark, root, 1) is None


# --- Silver -----------------------------------------------------------------------
def months(spark, run, *wanted):
    silver = demo_silver(spark, SF001).withColumn("run_id", F.lit(run))
    return silver.withColumn("pickup_month", F.pmod("pickup_day", F.lit(3)) + 1).filter(F.col("pickup_month").isin(*wanted))


def test_a_rerun_replaces_the_run_and_manual_runs_add(spark, work):
    path = f"{work}/silver"
    for run, wanted in (("r1", (1, 2)), ("r2", (1,)), ("r1", (2, 3)), ("manual", (1,)), ("manual", (1, 2))):
        write_silver(months(spark, run, *wanted), path)
    got = {(r.run_id, r.pickup_month): r["count"] for r in read_silver(spark, path).groupBy("run_id", "pickup_month").count().collect()}
    n = {m: months(spark, "x", m).count() for m in (1, 2, 3)}
    assert got == {("r1", 2): n[2], ("r1", 3): n[3], ("r2", 1): n[1], ("manual", 1): 2 * n[1], ("manual", 2): n[2]}
    assert read_silver(spark, path, version=1).count() == n[1] + n[2]  # as it was
    write_silver(months(spark, "r1"), path)  # no rows: as it was
    assert commits.versions(spark, path) == [1, 2, 3, 4, 5]
    held = read_silver(spark, path).count()
    assert expire_silver(spark, path, keep=1, grace_seconds=0)
    assert read_silver(spark, path).count() == held
    with pytest.raises(ValueError):
        read_silver(spark, path, version=1)


def test_silver_writers_that_meet_both_stay(spark, work, monkeypatch):
    path, real, waiting = f"{work}/silver", commits.commit, [True]

    def interleaved(*args, **kw):
        if waiting:
            waiting.clear()
            write_silver(months(spark, "r2", 1), path)
        return real(*args, **kw)

    monkeypatch.setattr(commits, "commit", interleaved)
    write_silver(months(spark, "r1", 1), path)
    assert {r.run_id for r in read_silver(spark, path).select("run_id").distinct().collect()} == {"r1", "r2"}


def test_counts_of_runs_that_left_the_table_leave_the_score(spark, work):
    rules, silver = silver_ruleset(), demo_silver(spark, SF001)
    bad = silver.withColumn("run_id", F.lit("bad")).withColumn("trip_id", F.lit(None).cast("string"))
    table_outcomes_incremental(spark, bad, rules, f"{work}/partials", silver.unionByName(bad))
    got = table_outcomes_incremental(spark, silver, rules, f"{work}/partials", silver)
    assert sorted(map(str, got.collect())) == sorted(map(str, evaluate(silver, rules).collect()))


# --- incremental run -----------------------------------------------------------------
def test_batches_reach_gold_exactly_once(spark, work, monkeypatch):
    conf = cfg(work, fact_mode="snapshot_by_date")
    zones, landing = demo_zones(spark, SF001), f"{work}/landing"
    clean = lambda *d: raw_days(spark, SF001, *d).drop("source_file").filter("dropOff_datetime is not null")
    run = lambda: run_incremental(spark, landing, zones, "inc", conf, f"{work}/ckpt", f"{work}/ledger")
    clean(1, 5).write.parquet(f"{landing}/w0")
    assert [(r.run_id, r.status, r.version) for r in run().collect()] == [("inc-b0", "published", 1)]
    first = fact_of(spark, conf.star_root).collect()
    assert run().count() == 1  # an empty wave
    files = spark.createDataFrame([(f,) for f in list_files(spark, landing)], "path string")
    again = batch_publisher(spark, zones, "inc", conf, f"{work}/ledger", f"{work}/ckpt")
    again(files, 0)  # handed out again after it was recorded
    crashed = batch_publisher(spark, zones, "inc", conf, f"{work}/ledger2", f"{work}/ckpt")
    crashed(files, 0)  # committed, but the ledger row is lost
    assert read_ledger(spark, f"{work}/ledger2").first().status == "published"
    assert commits.versions(spark, conf.star_root) == [1]
    assert sorted(fact_of(spark, conf.star_root).collect(), key=str) == sorted(first, key=str)
    clean(6, 9).withColumnRenamed("PUlocationID", "pu_location_id").write.parquet(f"{landing}/w1")  # another spelling
    raw_days(spark, SF001, 10, 31).drop("source_file").write.parquet(f"{work}/late")
    assert [r.status for r in run().orderBy("batch_id").collect()] == ["published", "published"]
    want = clean(1, 9).filter(F.col("dropOff_datetime") >= F.col("Pickup_datetime")).filter(
        "timestampdiff(SECOND, Pickup_datetime, dropOff_datetime) < 86400")
    assert fact_of(spark, conf.star_root).count() == want.count()
    bad = raw_days(spark, SF001, 10, 31).drop("source_file")  # null drop-off times: the Bronze gate fails
    bad.write.parquet(f"{landing}/w2")
    assert run().orderBy(F.desc("batch_id")).first().status == "bronze_failed"
    assert commits.versions(spark, conf.star_root) == [1, 2]


# --- drift ------------------------------------------------------------------------
def test_types_widen_to_the_next_common_one():
    assert widest(["int"]) == "int" and widest(["int", "bigint", "smallint"]) == "bigint"
    assert widest(["int", "double"]) == "double" and widest(["timestamp_ntz", "string"]) == "string"
    assert widest(["date", "timestamp"]) == "timestamp" and widest(["binary", "int"]) == "string"


def test_drifting_files_lose_no_row(spark, work):
    one = spark.createDataFrame([(1, "a")], "PUlocationID int, extra string")
    two = spark.createDataFrame([(2, 5)], "pulocationid long, `sr flag` int")
    three = spark.createDataFrame([("3",), ("x",)], "pu_location_id string")
    both = spark.createDataFrame([(None, 4), (5, 6)], "PUlocationID int, pu_location_id int")
    for k, df in enumerate((one, two, three, both)):
        df.coalesce(1).write.parquet(f"{work}/in/{k}")
    got = read_drifting_bronze(spark, f"{work}/in")
    assert got.schema["pu_location_id"].dataType.simpleString() == "string"
    assert sorted(r.pu_location_id for r in got.collect()) == ["1", "2", "3", "4", "5", "x"]
    assert got.filter("sr_flag = 5 and extra is null").count() == 1 and got.filter("source_file is null").isEmpty()
    assert len(schema_groups(spark, list_files(spark, f"{work}/in"))) >= 2
    assert read_drifting_files(spark, []).count() == 0


# --- catalogue -------------------------------------------------------------------
def test_tables_follow_the_commits(spark, work):
    root, schema = f"{work}/star", "follow_" + work.rsplit("/", 1)[-1][:10]
    create_star(spark, schema, root)
    assert sync_star(spark, schema, root) is None
    for k, run in enumerate(("run-a", "run-b", "run-a")):
        publish_star(spark, run_star(spark, SF001, run), root, fact_mode="snapshot_by_date", catalog=schema)
        if k == 1:  # the version that the tables show goes: the next switch starts from none
            publish_star(spark, run_star(spark, SF001, run), root, fact_mode="snapshot_by_date")
            expire_star(spark, root, keep=1, grace_seconds=0)
        else:
            shown = spark.table(f"{schema}.fact_fhvhv_trips").drop("load_timestamp")
            assert same(fact_of(spark, root), shown) and shown.count() > 0
            assert spark.table(f"{schema}.dim_zone").count() == read_star(spark, root)["dim_zone"].count()


def test_drift_of_a_table_is_followed_and_logged_once(spark, work):
    name, path = "drift_" + work.rsplit("/", 1)[-1][:10], f"{work}/t"
    old = spark.createDataFrame([(1, 1), (2, 2)], "a int, d int")
    old.write.partitionBy("d").parquet(path)
    register_table(spark, name, path, old.schema, ("d",))
    commits.Folder(spark, path).delete("d=1")
    spark.createDataFrame([(3, "x", 3)], "a int, b string, d int").write.mode("append").partitionBy("d").parquet(path)
    got = {(r.kind, r.name, r.action) for r in catalog_drift(spark, name, path, f"{work}/log").collect()}
    assert got == {("column", "b", "added"), ("partition", "d=3", "added"), ("partition", "d=1", "missing in files")}
    assert spark.table(name).filter("b = 'x'").count() == 1 and spark.read.parquet(f"{work}/log").count() == 3
    assert {r.action for r in catalog_drift(spark, name, path).collect()} == {"missing in files"}
