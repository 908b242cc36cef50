"""Gold star construction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.contracts import DIM_DATE, DIM_ZONE, FACT
from strata.operators.joins import dedupe_min

# Silver column feeding each fact column (identity unless listed).
FACT_SOURCES = {"source_run_id": "run_id"}


def project_contract(
    df: DataFrame,
    contract: T.StructType,
    sources: dict[str, str] | None = None,
    load_time: bool = True,
) -> DataFrame:
    """Closed projection: exactly the contract's columns, in its order, cast
    to its types. ``load_timestamp`` is stamped when the contract has it."""
    sources = sources or {}
    cols = []
    for f in contract.fields:
        if f.name == "load_timestamp":
            expr = F.current_timestamp() if load_time else F.lit(None)
        else:
            expr = F.col(sources.get(f.name, f.name))
        cols.append(expr.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def to_fact(silver: DataFrame, load_time: bool = True) -> DataFrame:
    """15-column fact projection; Silver ``run_id`` becomes ``source_run_id``.
    Zone labels and sanitised columns are not carried."""
    return project_contract(silver, FACT, FACT_SOURCES, load_time)


def build_dim_date(fact: DataFrame, load_time: bool = True) -> DataFrame:
    """One row per pickup date key: parts, weekday (1 = Sunday) and names.

    ``groupBy(key)`` keeps one row per key with map-side partial aggregation,
    so even a date holding a third of all trips adds one row per task to the
    shuffle. The key is a function of the date, so any survivor is the same."""
    dates = (
        fact.where(F.col("pickup_date").isNotNull() & F.col("pickup_date_key").isNotNull())
        .groupBy("pickup_date_key")
        .agg(F.min("pickup_date").alias("pickup_date"))
    )
    d = F.col("pickup_date")
    out = dates.select(
        F.col("pickup_date_key").alias("date_key"),
        d.alias("full_date"),
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        F.dayofweek(d).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.date_format(d, "MMMM").alias("month_name"),
    )
    return project_contract(out, DIM_DATE, load_time=load_time)


def build_dim_zone(zones: DataFrame, load_time: bool = True) -> DataFrame:
    """Cast, drop null ids, keep one row per id: deterministically the one
    with the smallest (borough, zone, service_zone), nulls first."""
    typed = zones.select(
        F.col("location_id").cast("int").alias("location_id"),
        F.col("borough").cast("string").alias("borough"),
        F.col("zone").cast("string").alias("zone"),
        F.col("service_zone").cast("string").alias("service_zone"),
    ).where(F.col("location_id").isNotNull())
    return project_contract(dedupe_min(typed, ["location_id"]), DIM_ZONE, load_time=load_time)


def build_star(silver: DataFrame, zones: DataFrame, load_time: bool = True) -> dict[str, DataFrame]:
    fact = to_fact(silver, load_time)
    return {
        "fact_fhvhv_trips": fact,
        "dim_date": build_dim_date(fact, load_time),
        "dim_zone": build_dim_zone(zones, load_time),
    }


def cluster_fact(fact: DataFrame) -> DataFrame:
    """Physical layout of the fact (T4): rows of one date key together, sorted
    by (date key, hour, pickup id) inside each partition so Parquet row-group
    min/max statistics can skip on all three.

    ``rebalance`` rather than ``repartition``: AQE splits a date that holds a
    large share of all trips into several advisory-sized tasks instead of
    sending it to one, and merges small dates together."""
    return fact.hint("rebalance", "pickup_date_key").sortWithinPartitions(
        "pickup_date_key", "pickup_hour", "pu_location_id"
    )
