"""Zone lookup reader (S4) and zone CSV writer used to publish a lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.contracts import ZONE_CSV
from strata.operators.normalize import normalize_columns


def read_zone_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV, all text, names canonicalised; ``location_id`` is the
    lenient int cast of ``locationid`` (bad text -> null)."""
    raw = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    zones = normalize_columns(raw)
    return zones.select(
        F.trim(F.col("locationid")).try_cast("int").alias("location_id"),
        F.col("borough"),
        F.col("zone"),
        F.col("service_zone"),
    )


def write_zone_csv(zones: DataFrame, path: str) -> None:
    """Write a zone frame in the lookup's CSV layout (header ``LocationID``)."""
    (
        zones.select(
            F.col("location_id").cast("string").alias("LocationID"),
            F.col("borough").alias("Borough"),
            F.col("zone").alias("Zone"),
            F.col("service_zone"),
        )
        .write.mode("overwrite")
        .option("header", "true")
        .csv(path)
    )


__all__ = ["read_zone_lookup", "write_zone_csv", "ZONE_CSV"]
