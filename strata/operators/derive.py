"""Derived Silver columns (P5-P10) and the one-pass Silver transform."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.contracts import (
    BRONZE,
    BRONZE_CASTS,
    TRIP_ALIASES,
    TRIP_KEY_FIELDS,
    ZONE_ROLE_COLUMNS,
)
from strata.functions.columns import calendar_columns, duration_minutes, sanitize, surrogate_key
from strata.operators.filters import validity_predicate
from strata.operators.joins import DEFAULT_BROADCAST_ROWS, bounded_broadcast
from strata.operators.normalize import cast_columns, normalize_columns
from strata.sources.bronze import or_empty


def derive_calendar(df: DataFrame, ts: str = "pickup_datetime", prefix: str = "pickup") -> DataFrame:
    return df.withColumns(calendar_columns(ts, prefix))


def with_duration(df: DataFrame, start="pickup_datetime", end="dropoff_datetime",
                  name="trip_duration_minutes") -> DataFrame:
    return df.withColumn(name, duration_minutes(start, end))


def stamp(df: DataFrame, run_id: str, load_time: bool = True) -> DataFrame:
    """Run id literal and (optionally) the load time, one value per query."""
    cols = {"run_id": F.lit(run_id)}
    if load_time:
        cols["load_timestamp"] = F.current_timestamp()
    return df.withColumns(cols)


def with_trip_id(df: DataFrame, null_token: str | None = None) -> DataFrame:
    return df.withColumn("trip_id", surrogate_key(TRIP_KEY_FIELDS, null_token=null_token))


def with_sanitized_labels(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "pu_borough_sanitized": sanitize("pu_borough"),
            "pu_zone_sanitized": sanitize("pu_zone"),
        }
    )


def prepare_bronze(raw: DataFrame) -> DataFrame:
    """Canonical names, empty-read guard, lenient casts."""
    return cast_columns(or_empty(normalize_columns(raw, TRIP_ALIASES), BRONZE), BRONZE_CASTS)


def enrich_zones(
    trips: DataFrame, zones: DataFrame, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS
) -> DataFrame:
    """Pickup then drop-off role of the same lookup, both left joins.

    Both roles join the very same (size-checked) broadcast frame and only
    rename columns after the join, so the two broadcast sides are one plan and
    Spark ships the lookup once (``ReusedExchange``). The lookup is not
    de-duplicated (a repeated id repeats the trip), as in the source pipeline;
    use ``joins.enrich(on_duplicate=...)`` to change that.
    """
    small = bounded_broadcast(zones.select("location_id", *ZONE_ROLE_COLUMNS), max_broadcast_rows)
    pz, dz, t = small.alias("pz"), small.alias("dz"), trips.alias("t")
    joined = t.join(pz, F.col("t.pu_location_id") == F.col("pz.location_id"), "left").join(
        dz, F.col("t.do_location_id") == F.col("dz.location_id"), "left"
    )
    return joined.select(
        "t.*",
        *[F.col(f"pz.{c}").alias(f"pu_{c}") for c in ZONE_ROLE_COLUMNS],
        *[F.col(f"dz.{c}").alias(f"do_{c}") for c in ZONE_ROLE_COLUMNS],
    )


def enriched_trips(raw: DataFrame, zones: DataFrame, **kw) -> DataFrame:
    """Bronze rows, typed and zone-enriched: the frame the batch metrics
    ``rows_read`` and ``unresolved`` are taken on."""
    trips = prepare_bronze(raw)
    if "source_file" not in trips.columns:
        trips = trips.withColumn("source_file", F.lit(None).cast("string"))
    return enrich_zones(trips, zones, **kw)


def silver_columns(enriched: DataFrame, run_id: str, null_token: str | None = None,
                   load_time: bool = True) -> DataFrame:
    """Calendar, duration, run stamp, trip_id and sanitised labels, all
    computed in one projection on top of the enriched rows."""
    cols = dict(calendar_columns("pickup_datetime", "pickup"))
    cols["trip_duration_minutes"] = duration_minutes("pickup_datetime", "dropoff_datetime")
    cols["run_id"] = F.lit(run_id)
    if load_time:
        cols["load_timestamp"] = F.current_timestamp()
    cols["trip_id"] = surrogate_key(TRIP_KEY_FIELDS, null_token=null_token)
    cols["pu_borough_sanitized"] = sanitize("pu_borough")
    cols["pu_zone_sanitized"] = sanitize("pu_zone")
    return enriched.withColumns(cols)


def to_silver(
    raw: DataFrame,
    zones: DataFrame,
    run_id: str,
    *,
    lo: float = 0.0,
    hi: float = 1440.0,
    null_token: str | None = None,
    load_time: bool = True,
    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
) -> DataFrame:
    """Bronze -> Silver as one lazy plan: normalise, type, enrich, derive, key,
    sanitise, keep valid rows. Catalyst pushes the row-local validity filter
    below both lookup joins, so invalid rows are never joined."""
    enriched = enriched_trips(raw, zones, max_broadcast_rows=max_broadcast_rows)
    silver = silver_columns(enriched, run_id, null_token=null_token, load_time=load_time)
    return silver.filter(validity_predicate(lo, hi))
