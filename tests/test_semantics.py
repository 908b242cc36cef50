"""Hand-made edge fixtures (one per semantic that must be preserved)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata.contracts import BRONZE, DIM_ZONE, TRIP_ALIASES
from strata.functions.columns import column_key, surrogate_key
from strata.functions.identifiers import BadIdentifier, plain_identifier
from strata.operators.contract import contract_report, enforce_contract
from strata.operators.derive import prepare_bronze, to_silver
from strata.operators.dims import build_dim_zone
from strata.operators.filters import rejected_trips, valid_trips
from strata.operators.joins import LookupFanOut, enrich
from strata.operators.normalize import ColumnNameClash, normalize_columns
from strata.operators.upsert import upsert
from strata.sources.bronze import or_empty

T0 = dt.datetime(2024, 1, 5, 10, 0, 0)
ZONES = [(5, "Queens", "Astoria", "Boro Zone"), (7, "Bronx", "Fordham", "Boro Zone")]


def zones_df(spark, rows=ZONES):
    return spark.createDataFrame(rows, "location_id int, borough string, zone string, service_zone string")


def trips_df(spark, rows):
    return spark.createDataFrame(rows, BRONZE).withColumn("source_file", F.lit("f1"))


def test_trip_id_null_shift_collides_by_default_and_not_with_token(spark):
    rows = [("B1", T0, T0, 5, None, None, "A"), ("B1", T0, T0, None, 5, None, "A")]
    df = trips_df(spark, rows)
    cols = ["dispatching_base_num", "pickup_datetime", "dropoff_datetime", "pu_location_id",
            "do_location_id", "affiliated_base_number", "source_file"]
    ids = df.select(surrogate_key(cols).alias("k")).distinct().count()
    safe = df.select(surrogate_key(cols, null_token="\\N").alias("k")).distinct().count()
    assert ids == 1 and safe == 2


def test_durations_validity_and_second_truncation(spark):
    def row(start, minutes):
        end = None if minutes is None else start + dt.timedelta(minutes=minutes)
        return ("B", start, end, 5, 7, None, None)

    rows = [row(T0, -5), row(T0, 0), row(T0.replace(microsecond=500000), 0.98 / 60),
            row(T0, 1439.98), row(T0, 1440), row(T0, 2880), row(T0, None), ("B", None, T0, 5, 7, None, None)]
    silver = to_silver(trips_df(spark, rows), zones_df(spark), "r1")
    got = sorted(r.trip_duration_minutes for r in silver.collect())
    # 0, a sub-second trip crossing a second boundary (1 s after truncation),
    # and 1439.98 min (truncated to whole seconds) survive; the rest is dropped.
    assert len(got) == 3
    assert got[0] == 0.0
    assert got[1] == pytest.approx(1 / 60)
    assert got[2] == (1439 * 60 + 58) / 60.0
    rejected = rejected_trips(to_silver_unfiltered(spark, rows)).groupBy("reject_reason").count()
    reasons = {r.reject_reason: r["count"] for r in rejected.collect()}
    assert reasons == {"negative_duration": 1, "duration_too_long": 2, "missing_pickup_year": 1,
                       "missing_duration": 1}


def to_silver_unfiltered(spark, rows):
    from strata.operators.derive import enriched_trips, silver_columns

    return silver_columns(enriched_trips(trips_df(spark, rows), zones_df(spark)), "r1")


def test_accepted_plus_rejected_is_input(spark):
    from tests.conftest import SF001
    from strata.plans.scenarios import derived_unfiltered

    df = derived_unfiltered(spark, SF001)
    assert valid_trips(df).count() + rejected_trips(df).count() == df.count()


def test_zone_lookup_fan_out_and_dimension_dedupe(spark):
    dup = ZONES + [(5, "Queens", "Astoria Dup", "Boro Zone"), (None, "X", "Y", "Z")]
    trips = trips_df(spark, [("B", T0, T0 + dt.timedelta(minutes=3), 5, 7, None, None)])
    assert to_silver(trips, zones_df(spark, dup), "r").count() == 2  # multiplied, as the source does
    with pytest.raises(LookupFanOut):
        enrich(prepare_bronze(trips), zones_df(spark, dup).withColumnRenamed("location_id", "pu_location_id"),
               "pu_location_id", on_duplicate="error")
    first = enrich(prepare_bronze(trips), zones_df(spark, dup).withColumnRenamed("location_id", "pu_location_id"),
                   "pu_location_id", on_duplicate="first")
    assert first.count() == 1 and first.first().zone == "Astoria"
    dim = build_dim_zone(zones_df(spark, dup)).collect()
    assert sorted(r.location_id for r in dim) == [5, 7]
    assert [r.zone for r in dim if r.location_id == 5] == ["Astoria"]


def test_raw_names_normalised(spark):
    df = spark.createDataFrame([(1, 2, None, 1, "B")],
                               "PUlocationID int, DOlocationID int, dropOff_datetime timestamp, SR_Flag int, "
                               "Affiliated_base_number string")
    assert normalize_columns(df, TRIP_ALIASES).columns == [
        "pu_location_id", "do_location_id", "dropoff_datetime", "sr_flag", "affiliated_base_number"]
    assert column_key("drop off datetime", TRIP_ALIASES) == "dropoff_datetime"


def test_raw_name_clash_raises(spark):
    df = spark.createDataFrame([(1, 2)], "`PU location id` int, PUlocationID int")
    with pytest.raises(ColumnNameClash):
        normalize_columns(df, TRIP_ALIASES)


def test_lenient_casts_under_ansi(spark):
    df = spark.createDataFrame([("x", "zz", "2024-01-05 10:00:00")],
                               "pu_location_id string, pickup_datetime string, dropoff_datetime string")
    row = prepare_bronze(df).first()
    assert row.pu_location_id is None and row.pickup_datetime is None
    assert row.dropoff_datetime == dt.datetime(2024, 1, 5, 10, 0)


def test_run_ids_stay_strings_and_scope(spark, work):
    from strata.sinks.silver import write_silver
    from strata.sources.silver import read_silver, scope_run

    trips = trips_df(spark, [("B", T0, T0 + dt.timedelta(minutes=3), 5, 7, None, None)])
    for run in ("007", "manual-1"):
        write_silver(to_silver(trips, zones_df(spark), run), f"{work}/silver")
    silver = read_silver(spark, f"{work}/silver")
    assert sorted(r.run_id for r in silver.select("run_id").collect()) == ["007", "manual-1"]
    assert scope_run(silver, "007").count() == 1
    assert scope_run(silver, "manual").count() == 2
    plan = scope_run(silver, "007")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "run_id" in plan.split("PartitionFilters")[1][:200]


def test_upsert_pairs(spark):
    schema = "k int, v string"
    target = spark.createDataFrame([(1, "old"), (2, "old"), (None, "old-null")], schema)
    staged = spark.createDataFrame([(2, "new-a"), (2, "new-b"), (None, "new-null"), (3, "new")], schema)
    got = sorted(upsert(target, staged, "k").collect(), key=lambda r: (r.k is None, r.k or 0, r.v))
    assert [(r.k, r.v) for r in got] == [
        (1, "old"), (2, "new-a"), (2, "new-b"), (3, "new"), (None, "new-null"), (None, "old-null")]


def test_upsert_idempotent_on_rerun(spark):
    from tests.conftest import SF001
    from strata.plans.registry import demo_star

    fact = demo_star(spark, SF001)["fact_fhvhv_trips"].drop("load_timestamp")
    once = upsert(fact, fact, "trip_id")
    twice = upsert(once, fact, "trip_id")
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_empty_bronze_guard(spark):
    empty = spark.range(0).select()  # zero columns
    guarded = or_empty(empty)
    assert guarded.schema == BRONZE and guarded.count() == 0
    assert to_silver(empty, zones_df(spark), "r").count() == 0


def test_skip_empty_write(spark, work):
    from strata.sinks.silver import write_if_any

    calls = []
    assert write_if_any(spark.range(0), lambda df: calls.append(1)) is False
    assert write_if_any(spark.range(3), lambda df: calls.append(1)) is True
    assert calls == [1]


def test_overlong_zone_violates_contract(spark):
    rows = [(1, "Queens", "z" * 129, "Boro Zone", None), (None, "Q", "ok", "S", None)]
    df = spark.createDataFrame(rows, "location_id int, borough string, zone string, service_zone string, "
                                     "load_timestamp timestamp")
    ok, bad = enforce_contract(df, DIM_ZONE)
    assert ok.count() == 0
    reasons = sorted(r.violations for r in bad.collect())
    assert reasons == ["location_id not_null", "zone max_length 128"]
    report = {(r.column_name, r.check_name): r.violations for r in contract_report(df, DIM_ZONE, "dim_zone").collect()}
    assert report[("zone", "max_length")] == 1 and report[("location_id", "not_null")] == 1


def test_identifier_guard():
    assert plain_identifier("gold_1") == "gold_1"
    for bad in ("1abc", "a-b", "a;drop", ""):
        with pytest.raises(BadIdentifier):
            plain_identifier(bad)


def test_bound_query_schema_placeholder(spark, work):
    from tests.conftest import SF001
    from strata.plans.registry import demo_star
    from strata.plans.reports import bound_query, pickup_hour_volume

    spark.sql(f"CREATE DATABASE IF NOT EXISTS card_test LOCATION '{work}/card_test'")
    star = demo_star(spark, SF001)
    star["fact_fhvhv_trips"].drop("load_timestamp").write.mode("overwrite").saveAsTable("card_test.fact_fhvhv_trips")
    card = ("select pickup_hour, count(*)::bigint as trips from {{schema}}.fact_fhvhv_trips "
            "group by 1 order by 1")
    got = [tuple(r) for r in bound_query(spark, card, schema="card_test").collect()]
    assert got == [tuple(r) for r in pickup_hour_volume(star).collect()]
    with pytest.raises(BadIdentifier):
        bound_query(spark, card, schema="x; drop table y")
