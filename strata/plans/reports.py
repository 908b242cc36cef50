"""The dashboard reports (R1-R19) over a Gold star, plus SQL-text binding.

Every report takes ``star`` = ``{"fact_fhvhv_trips", "dim_date", "dim_zone"}``
DataFrames (read from a published snapshot or built lazily) and returns a
DataFrame. Aggregates merge partially on the map side, so a hot zone or date
does not concentrate rows in one task; dimensions are joined only to
pre-aggregated rows. Top-k cuts order by the measure and then by the group
keys, so membership at the cut is defined.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.contracts import UNKNOWN
from strata.functions.columns import mean_minutes, ratio_pct, whole_seconds
from strata.functions.identifiers import plain_identifier
from strata.operators.aggregates import count_by, value_range
from strata.operators.joins import role_dimension
from strata.operators.ordering import sort_by, sort_by_measure, top_k
from strata.operators.sets import completeness_profile, table_counts

Star = Mapping[str, DataFrame]


def _fact(star: Star) -> DataFrame:
    return star["fact_fhvhv_trips"]


def _label(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(UNKNOWN))


# Zone-labelled reports aggregate the fact by location id(s) first: a hash
# aggregate with map-side partial merge, so a hot id is collapsed inside each
# task and only one row per id (pair) and task reaches the shuffle. The few
# aggregated rows are then joined to dim_zone and re-aggregated by label. This
# equals join-then-aggregate exactly, including lookup fan-out (each matching
# lookup row receives the id's count) and unmatched ids (null label). The fact
# itself is never joined, so no broadcast of anything that grows with it.
def _id_counts(fact: DataFrame, keys: list[str], durations: bool = False) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("_n")]
    if durations:
        aggs += [F.sum(whole_seconds("trip_duration_minutes")).alias("_s"),
                 F.count("trip_duration_minutes").alias("_c")]
    return fact.groupBy(*keys).agg(*aggs)


def _zone_role(star: Star, fact_key: str, prefix: str) -> DataFrame:
    dim = star["dim_zone"].select("location_id", "borough", "zone", "service_zone")
    return role_dimension(dim, "location_id", fact_key, prefix, ("borough", "zone", "service_zone"))


def _label_ids(ids: DataFrame, star: Star, pickup=True, dropoff=False) -> DataFrame:
    if pickup:
        ids = ids.join(_zone_role(star, "pu_location_id", "pu"), "pu_location_id", "left")
    if dropoff:
        ids = ids.join(_zone_role(star, "do_location_id", "dz"), "do_location_id", "left")
    return ids


def _rollup(labelled: DataFrame, keys: list[Column], durations: bool = False) -> DataFrame:
    aggs = [F.sum("_n").alias("trips")]
    if durations:
        aggs.append(mean_minutes(F.sum("_s"), F.sum("_c")).alias("avg_minutes"))
    return labelled.groupBy(*keys).agg(*aggs)


# R1
def total_trips(star: Star) -> DataFrame:
    return _fact(star).agg(F.count(F.lit(1)).alias("trips"))


# Durations are whole seconds / 60 by construction (P7), so means are taken
# exactly over integer seconds and rounded HALF_UP; a mean of exactly x.xx5
# minutes always rounds up, whatever the float summation order.
def _mean_minutes(col: str = "trip_duration_minutes") -> Column:
    return mean_minutes(F.sum(whole_seconds(col)), F.count(col))


# R2
def average_duration(star: Star) -> DataFrame:
    return _fact(star).agg(_mean_minutes().alias("avg_minutes"))


# R3
def pickup_location_coverage(star: Star) -> DataFrame:
    f = _fact(star)
    return f.agg(ratio_pct(F.count("pu_location_id"), F.count(F.lit(1))).alias("pickup_location_pct"))


# R4
def dropoff_location_coverage(star: Star) -> DataFrame:
    f = _fact(star)
    return f.agg(ratio_pct(F.count("do_location_id"), F.count(F.lit(1))).alias("dropoff_location_pct"))


# R5
def daily_trip_volume(star: Star) -> DataFrame:
    """Inner join: a fact row whose date key has no dim_date row is dropped.
    Counted per date key first, then joined to dim_date (both sides small)."""
    per_key = _id_counts(_fact(star), ["pickup_date_key"])
    dates = star["dim_date"].select("date_key", "full_date")
    joined = per_key.join(dates, F.col("pickup_date_key") == F.col("date_key"), "inner")
    out = joined.groupBy(F.col("full_date").alias("pickup_date")).agg(F.sum("_n").alias("trips"))
    return sort_by(out, "pickup_date")


# R6
def pickup_borough_mix(star: Star) -> DataFrame:
    ids = _label_ids(_id_counts(_fact(star), ["pu_location_id"]), star)
    out = _rollup(ids, [_label("pu_borough").alias("pickup_borough")])
    return sort_by_measure(out, "trips", ["pickup_borough"])


# R7
def pickup_hour_volume(star: Star) -> DataFrame:
    return sort_by(count_by(_fact(star), ["pickup_hour"]), "pickup_hour")


# R8
def warehouse_table_counts(star: Star) -> DataFrame:
    tables = {n: star[n] for n in ("fact_fhvhv_trips", "dim_date", "dim_zone")}
    return sort_by(table_counts(tables), "table_name")


def _top_zones(star: Star, key: str, prefix: str, name: str, k: int) -> DataFrame:
    ids = _id_counts(_fact(star).where(F.col(key).isNotNull()), [key])
    ids = ids.join(_zone_role(star, key, prefix), key, "left")
    label = F.concat(_label(f"{prefix}_borough"), F.lit(" - "), _label(f"{prefix}_zone"))
    return top_k(_rollup(ids, [label.alias(name)]), "trips", k, [name])


# R9
def top_pickup_zones(star: Star, k: int = 15) -> DataFrame:
    return _top_zones(star, "pu_location_id", "pu", "pickup_zone", k)


# R10
def top_dropoff_zones(star: Star, k: int = 15) -> DataFrame:
    return _top_zones(star, "do_location_id", "dz", "dropoff_zone", k)


# R11
def borough_flows(star: Star, k: int = 25) -> DataFrame:
    ids = _id_counts(_fact(star), ["pu_location_id", "do_location_id"], durations=True)
    ids = _label_ids(ids, star, pickup=True, dropoff=True)
    keys = [_label("pu_borough").alias("pickup_borough"), _label("dz_borough").alias("dropoff_borough")]
    return top_k(_rollup(ids, keys, durations=True), "trips", k, ["pickup_borough", "dropoff_borough"])


def _routes(star: Star) -> DataFrame:
    f = _fact(star).where(F.col("pu_location_id").isNotNull() & F.col("do_location_id").isNotNull())
    ids = _label_ids(_id_counts(f, ["pu_location_id", "do_location_id"], durations=True), star,
                     pickup=True, dropoff=True)
    keys = [_label("pu_zone").alias("pickup_zone"), _label("dz_zone").alias("dropoff_zone")]
    return _rollup(ids, keys, durations=True)


# R12
def top_routes(star: Star, k: int = 25) -> DataFrame:
    return top_k(_routes(star), "trips", k, ["pickup_zone", "dropoff_zone"])


# R13
def longest_common_routes(star: Star, k: int = 25, min_trips: int = 100) -> DataFrame:
    """Zone pairs (by name) with at least ``min_trips`` trips, slowest first."""
    out = _routes(star).where(F.col("trips") >= F.lit(min_trips))
    return top_k(out, "avg_minutes", k, ["pickup_zone", "dropoff_zone"])


# R14
def pickup_service_zone(star: Star) -> DataFrame:
    ids = _label_ids(_id_counts(_fact(star), ["pu_location_id"]), star)
    out = _rollup(ids, [_label("pu_service_zone").alias("pickup_service_zone")])
    return sort_by_measure(out, "trips", ["pickup_service_zone"])


# R15
def loaded_date_range(star: Star) -> DataFrame:
    return value_range(_fact(star), "pickup_date", "pickup_date")


# R16
def loaded_run_ids(star: Star) -> DataFrame:
    out = count_by(_fact(star), [_label("source_run_id").alias("source_run_id")])
    return sort_by_measure(out, "trips", ["source_run_id"])


# R17
def loaded_source_files(star: Star, k: int = 20) -> DataFrame:
    return top_k(count_by(_fact(star), ["source_file"]), "trips", k, ["source_file"])


# R18
def duration_quality_band(star: Star) -> DataFrame:
    f = _fact(star)
    return f.agg(
        F.round(F.min("trip_duration_minutes"), 2).alias("min_minutes"),
        _mean_minutes().alias("avg_minutes"),
        F.round(F.max("trip_duration_minutes"), 2).alias("max_minutes"),
    )


# R19
def location_completeness(star: Star) -> DataFrame:
    out = completeness_profile(
        _fact(star), {"pickup_location_id": "pu_location_id", "dropoff_location_id": "do_location_id"}
    )
    return sort_by(out, "field_name")


REPORTS = {
    "total_trips": total_trips,
    "average_duration": average_duration,
    "pickup_location_coverage": pickup_location_coverage,
    "dropoff_location_coverage": dropoff_location_coverage,
    "daily_trip_volume": daily_trip_volume,
    "pickup_borough_mix": pickup_borough_mix,
    "pickup_hour_volume": pickup_hour_volume,
    "warehouse_table_counts": warehouse_table_counts,
    "top_pickup_zones": top_pickup_zones,
    "top_dropoff_zones": top_dropoff_zones,
    "borough_flows": borough_flows,
    "top_routes": top_routes,
    "longest_common_routes": longest_common_routes,
    "pickup_service_zone": pickup_service_zone,
    "loaded_date_range": loaded_date_range,
    "loaded_run_ids": loaded_run_ids,
    "loaded_source_files": loaded_source_files,
    "duration_quality_band": duration_quality_band,
    "location_completeness": location_completeness,
}


# P14 -------------------------------------------------------------------------
def bound_query(spark: SparkSession, sql: str, **names: str) -> DataFrame:
    """Run report SQL whose schema or table names are parameters.

    ``{{name}}.table`` becomes ``IDENTIFIER(:name || '.table')`` and a bare
    ``{{name}}`` becomes ``IDENTIFIER(:name)``; Spark binds the values itself
    (no splicing of values into the text). Each bound value must be a plain
    identifier or a dotted pair of them."""
    for name, value in names.items():
        for part in value.split("."):
            plain_identifier(part, name)

    def qualified(m: re.Match) -> str:
        return f"IDENTIFIER(:{m.group(1)} || '.{plain_identifier(m.group(2), 'table')}')"

    text = re.sub(r"\{\{\s*(\w+)\s*\}\}\.(\w+)", qualified, sql)
    text = re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: f"IDENTIFIER(:{m.group(1)})", text)
    return spark.sql(text, args=dict(names))
