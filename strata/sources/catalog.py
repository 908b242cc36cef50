"""Catalog registration of a partitioned Parquet location.

A table created over existing directories knows no partitions until they are
discovered; partitions appended later must be discovered again, so call
``refresh_partitions`` after every append. New columns: ``add_columns``
(table) or read the path with ``mergeSchema`` (``read_bronze(...,
merge_schema=True)``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.contracts import FACT_PARTITION, STAR_TABLES
from strata.functions.identifiers import plain_identifier
from strata.functions.literals import literal_frame
from strata.sinks import commits


def register_table(
    spark: SparkSession,
    name: str,
    path: str,
    schema: T.StructType,
    partitions: Sequence[str] = (),
) -> DataFrame:
    """``CREATE TABLE IF NOT EXISTS ... USING parquet PARTITIONED BY ...
    LOCATION``, then partition discovery; returns ``spark.table(name)``."""
    for part in name.split("."):
        plain_identifier(part, "table name")
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    part = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet{part} LOCATION '{path}'")
    if partitions:
        refresh_partitions(spark, name)
    return spark.table(name)


def refresh_partitions(spark: SparkSession, name: str) -> None:
    """Discover partition directories added since the last call."""
    spark.sql(f"MSCK REPAIR TABLE {name}")
    spark.catalog.refreshTable(name)


def add_columns(spark: SparkSession, name: str, new: T.StructType) -> None:
    """Schema evolution: append columns (old files read them as null)."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.fields)
    spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({cols})")


# -- the star's tables follow its commits ------------------------------------------
VERSION = "strata.version"  # table property: the version that a table shows


def sync_star(spark: SparkSession, schema: str, root: str, commit: commits.Commit | None = None) -> int | None:
    """Point the tables that ``create_star`` made at the newest commit (K5, P14):
    SQL on ``<schema>.<table>`` then reads what was published.

    Dimensions move their location; the fact's dates are partitions whose locations
    are the committed directories, and only dates that changed since the version
    that the table shows are altered. Each table switches whole dates at a time; a
    query across tables that must not see two versions reads ``read_star``."""
    plain_identifier(schema, "schema")
    commit = commit or commits.read_commit(spark, root)
    if commit is None:
        return None
    base = root.rstrip("/")
    for name in STAR_TABLES:
        table, parts = f"{schema}.{name}", commit.parts(name)
        shown = _shown_version(spark, table)
        if shown == commit.version:
            continue
        if list(parts) == [None]:
            spark.sql(f"ALTER TABLE {table} SET LOCATION '{base}/{parts[None]}'")
        else:
            before = commits.read_commit(spark, root, shown) if shown else None
            _move_partitions(spark, table, base, before.parts(name) if before else None, parts)
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{VERSION}' = '{commit.version}')")
        spark.catalog.refreshTable(table)
    return commit.version


def _shown_version(spark: SparkSession, table: str) -> int | None:
    found = spark.sql(f"SHOW TBLPROPERTIES {table}").filter(F.col("key") == VERSION).collect()
    return int(found[0]["value"]) if found else None


def _spec(part: str) -> str:
    value = "null" if part == "__HIVE_DEFAULT_PARTITION__" else str(int(part))
    return f"PARTITION ({FACT_PARTITION} = {value})"


def _move_partitions(spark, table: str, base: str, before: dict | None, after: dict) -> None:
    known = {r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    for part in sorted(known - set(after)):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {_spec(part)}")
    new = [f"{_spec(part)} LOCATION '{base}/{after[part]}'" for part in sorted(set(after) - known)]
    if new:
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS " + " ".join(new))
    for part in sorted(known & set(after)):
        if before is None or before.get(part) != after[part]:
            spark.sql(f"ALTER TABLE {table} {_spec(part)} SET LOCATION '{base}/{after[part]}'")


# -- drift between a table and its folder --------------------------------------------
DRIFT = T.StructType([T.StructField(n, T.StringType()) for n in ("table_name", "kind", "name", "action")])


def catalog_drift(spark: SparkSession, name: str, path: str, log_path: str | None = None) -> DataFrame:
    """Compare a registered table with the files below ``path`` and follow them.

    Columns that files have and the table lacks are added. Partitions that were not
    registered are; those whose files have vanished are only logged and stay
    registered, and so do columns that no file has any more. Returns, and with
    ``log_path`` appends, one row (table_name, kind, name, action) for each."""
    for part in name.split("."):
        plain_identifier(part, "table name")
    table = spark.table(name)
    stored = spark.read.option("mergeSchema", "true").parquet(path).schema
    partitions = {c.name for c in spark.catalog.listColumns(name) if c.isPartition}
    known, found = ({f.name.lower(): f for f in s.fields if f.name not in partitions} for s in (table.schema, stored))
    rows = [(name, "column", found[c].name, "added") for c in found if c not in known]
    rows += [(name, "column", known[c].name, "missing in files") for c in known if c not in found]
    added = T.StructType([found[c] for c in found if c not in known])
    if added.fields:
        add_columns(spark, name, added)
    if partitions:
        levels = "/".join(f"{c.name}=*" for c in spark.catalog.listColumns(name) if c.isPartition)
        on_disk = spark.createDataFrame(
            [(p,) for p, _ in commits.Folder(spark, path).matching(levels)], "partition string"
        )
        registered = spark.sql(f"SHOW PARTITIONS {name}").select("partition")
        new = on_disk.join(registered, "partition", "left_anti").collect()
        gone = registered.join(on_disk, "partition", "left_anti").collect()
        rows += [(name, "partition", r[0], "added") for r in new]
        rows += [(name, "partition", r[0], "missing in files") for r in gone]
        if new:
            spark.sql(f"MSCK REPAIR TABLE {name} ADD PARTITIONS")
    spark.catalog.refreshTable(name)
    drift = literal_frame(spark, rows, DRIFT)
    if log_path and rows:
        drift.write.mode("append").parquet(log_path)
    return drift
