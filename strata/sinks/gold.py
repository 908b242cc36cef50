"""Gold sinks: per-run staging (K3, K6), quarantine (K4), star DDL (K5),
atomic publish (K9) and rule-result storage (K10).

Every path is on the shared folder given by the caller (on a cluster: under
``spark.checkpoint.dir`` or a warehouse location), never a machine-local one.

Publishing. Parquet has no multi-table transactions, so the star is versioned by
commits (``sinks.commits``): a publish writes new directories, one for each dimension
and each date that it touches, and only then commits the list of all that are
current. A publish that fails half way leaves directories that no commit lists;
the previous version stays current, and ``expire_star`` removes them. Two publishers
may run at once: the one that commits later merges its batch into the other's.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.contracts import FACT, FACT_PARTITION, STAR_KEYS, STAR_TABLES
from strata.functions.identifiers import plain_identifier
from strata.functions.literals import empty_frame
from strata.operators.contract import contract_checks
from strata.operators.dims import cluster_fact
from strata.operators.upsert import partition_values, stage_keys, upsert
from strata.sinks import commits

# -- staging -----------------------------------------------------------------
def stage_path(base: str, run_id: str, table: str) -> str:
    return f"{base.rstrip('/')}/run_id={run_id}/{table}"


class ContractViolation(ValueError):
    """Staged rows break a NOT NULL or VARCHAR(n) limit; nothing was published."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        super().__init__(f"contract violations in staged tables: {counts}")
        self.counts = counts


def write_gold_stage(
    tables: Mapping[str, DataFrame], base: str, run_id: str, *, enforce: bool = True
) -> dict[str, str]:
    """Overwrite the run's staging directory of each table, columns in
    contract order (positional loads stay correct).

    With ``enforce`` the contract limits a warehouse applies at load (NOT NULL
    keys, VARCHAR lengths) are counted by an ``Observation`` riding on each
    staging write, so checking costs no extra scan; any violation raises
    ``ContractViolation`` after staging and before anything is published.
    """
    paths, bad = {}, {}
    for name, df in tables.items():
        contract = STAR_TABLES.get(name)
        out = df.select(*(contract.names if contract else df.columns))
        obs = None
        if enforce and contract is not None:
            checks = contract_checks(contract)
            if checks:
                obs = Observation(f"contract_{name}_{uuid.uuid4().hex[:8]}")
                out = out.observe(obs, *[F.count(F.when(~ok, F.lit(1))).alias(f"{col} {check}")
                                         for col, check, _, ok in checks])
        path = stage_path(base, run_id, name)
        out.write.mode("overwrite").parquet(path)
        paths[name] = path
        if obs is not None:
            found = {k: int(v) for k, v in obs.get.items() if v}
            if found:
                bad[name] = found
    if bad:
        raise ContractViolation(bad)
    return paths


def read_gold_stage(spark: SparkSession, base: str, run_id: str) -> dict[str, DataFrame]:
    return {
        name: spark.read.schema(schema).parquet(stage_path(base, run_id, name))
        for name, schema in STAR_TABLES.items()
    }


# -- quarantine ----------------------------------------------------------------
def quarantine_frame(df: DataFrame, ruleset: str, result_id: str, score: str) -> DataFrame:
    return df.withColumns(
        {
            "quarantined_at": F.current_timestamp(),
            "dq_ruleset_name": F.lit(ruleset),
            "dq_result_id": F.lit(result_id),
            "dq_score": F.lit(str(score)),
        }
    )


def quarantine(df: DataFrame, run_id: str, ruleset: str, result_id: str, score: str, path: str) -> str:
    """Copy the batch plus 4 audit columns to ``<path>/run_id=<id>/``
    (overwriting that run only). Source rows are not deleted."""
    out = f"{path.rstrip('/')}/run_id={run_id}"
    quarantine_frame(df, ruleset, result_id, score).write.mode("overwrite").parquet(out)
    return out


# -- DDL ---------------------------------------------------------------------
def _ddl_type(f: T.StructField) -> str:
    n = (f.metadata or {}).get("max_length")
    base = f"VARCHAR({n})" if n else f.dataType.simpleString().upper()
    return base + ("" if f.nullable else " NOT NULL")


def create_star(spark: SparkSession, schema: str, root: str, fact_table: str = "fact_fhvhv_trips") -> list[str]:
    """Idempotent ``CREATE SCHEMA/TABLE IF NOT EXISTS`` for the three star
    tables and their staging twins (no NOT NULL on staging), Parquet at
    ``<root>/<table>``; the fact is partitioned by its date key."""
    plain_identifier(schema, "schema")
    plain_identifier(fact_table, "fact_table")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema} LOCATION '{root.rstrip('/')}/_db'")
    made = []
    for name, contract in STAR_TABLES.items():
        table = fact_table if name == "fact_fhvhv_trips" else name
        for tname, strict in ((table, True), (f"staging_{table}", False)):
            cols = ", ".join(
                f"{f.name} {_ddl_type(f) if strict else _ddl_type(T.StructField(f.name, f.dataType, True, f.metadata))}"
                for f in contract.fields
            )
            part = f" PARTITIONED BY ({FACT_PARTITION})" if name == "fact_fhvhv_trips" and strict else ""
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {schema}.{tname} ({cols}) USING parquet{part} "
                f"LOCATION '{root.rstrip('/')}/{tname}'"
            )
            made.append(f"{schema}.{tname}")
    return made


# -- publish -------------------------------------------------------------------
FACT_DIR = "fact_fhvhv_trips"
KEYS_DIR = "fact_keys"  # the key index: hashes of the fact's trip_ids, by date
KEY_HASH = "key_hash"
WRITE = "w"  # partition level of one publish, below a date or a dimension
NULL_PART = "__HIVE_DEFAULT_PARTITION__"  # fixed: how a null partition value is spelt
FACT_MODES = ("snapshot", "snapshot_by_date", "partitions")


def committed_version(spark: SparkSession, root: str) -> int | None:
    """Highest committed version, or None before the first publish."""
    known = commits.versions(spark, root)
    return known[-1] if known else None


def _read_dirs(spark: SparkSession, root: str, table: str, directories) -> DataFrame:
    """The rows of some directories of a star table."""
    schema, base = STAR_TABLES[table], root.rstrip("/")
    paths = sorted(f"{base}/{d}" for d in directories)
    if not paths:
        return empty_frame(spark, schema)
    reader = spark.read.schema(schema).option("basePath", f"{base}/{table}")
    return reader.parquet(*paths).select(*schema.names)


def read_star(
    spark: SparkSession, root: str, version: int | None = None, *, commit: commits.Commit | None = None
) -> dict[str, DataFrame] | None:
    """The committed star (latest version unless ``version``), None if there is
    none. Any version that is kept can be read, whatever was published since.
    ``commit`` is a commit already read by the caller (saves reading it again)."""
    found = commit or commits.read_commit(spark, root, version)
    if found is None:
        return None
    return {name: _read_dirs(spark, root, name, found.parts(name).values()) for name in STAR_TABLES}


def publish_star(
    spark: SparkSession,
    staged: Mapping[str, DataFrame],
    root: str,
    *,
    fact_mode: str = "snapshot",
    run_id: str | None = None,
    catalog: str | None = None,
    attempts: int = 3,
    fail_after: str | None = None,
) -> int:
    """Upsert the staged star into the current version and commit it as the
    next version, all tables at once; returns the new version number.

    All modes share one layout. Dimensions are written whole. The fact is kept by
    date, and a publish writes only the dates that it touches; the others are listed
    again in the commit. ``fact_mode`` says how the touched dates are found:
    ``"snapshot"`` (default) looks for the staged trip_ids in the key index, eight bytes
    a row kept beside each date, and so needs no assumption and reads no fact file of
    another date; ``"snapshot_by_date"`` and
    ``"partitions"`` rely on a trip_id falling in its pickup date, so that only the
    batch's own dates are read at all. Modes may change from one publish to the next.

    If another writer commits first, the batch is merged anew into that version, up
    to ``attempts`` times, then ``CommitConflict`` is raised: nothing is lost.
    ``run_id`` is kept with the commit. ``catalog`` names a schema whose tables are
    switched to the new version (see ``sync_star``). ``fail_after`` names a table
    after whose write an error is raised (tests the rollback path).
    """
    if fact_mode not in FACT_MODES:
        raise ValueError(f"fact_mode {fact_mode!r} is none of {FACT_MODES}")
    for attempt in range(attempts):
        base = commits.read_commit(spark, root)
        entries = _merge_star(spark, staged, root, base, fact_mode, fail_after)
        try:
            made = commits.commit(spark, root, base, entries, run_id=run_id, mode=fact_mode)
            break
        except commits.CommitConflict:
            folder, known = commits.Folder(spark, root), base.directories() if base else set()
            for _, _, directory in entries:
                if directory not in known:
                    folder.delete(directory)
            if attempt == attempts - 1:
                raise
    if catalog:
        from strata.sources.catalog import sync_star

        sync_star(spark, catalog, root, made)
    return made.version


def _merge_star(spark, staged, root, base, fact_mode, fail_after) -> list[commits.Entry]:
    """Write what the batch changes; the entries of the version that results."""
    root, write = root.rstrip("/"), commits.new_write()
    entries: list[commits.Entry] = []
    for name, schema in STAR_TABLES.items():
        batch = staged[name].select(*schema.names)
        live = base.parts(name) if base else {}
        if name == FACT_DIR:
            indexed = base.parts(KEYS_DIR) if base else {}
            entries += _merge_fact(spark, batch, root, live, indexed, fact_mode, write)
        else:
            where = f"{name}/{WRITE}={write}"
            upsert(_read_dirs(spark, root, name, live.values()), batch, STAR_KEYS[name]).write.parquet(f"{root}/{where}")
            entries.append((name, None, where))
        if fail_after == name:
            raise RuntimeError(f"injected failure after writing {name} (nothing committed)")
    return entries


def _part_of(day) -> str:
    return NULL_PART if day is None else str(day)


def key_index(spark: SparkSession, root: str, directories) -> DataFrame:
    """(date, key_hash) of the fact rows that some index directories stand for."""
    day = STAR_TABLES[FACT_DIR][FACT_PARTITION]
    schema, base = T.StructType([T.StructField(KEY_HASH, T.LongType()), day]), root.rstrip("/")
    paths = sorted(f"{base}/{d}" for d in directories)
    return spark.read.schema(schema).option("basePath", f"{base}/{KEYS_DIR}").parquet(*paths)


def touched_parts(spark: SparkSession, root: str, live: Mapping, indexed: Mapping, keys: DataFrame) -> set[str]:
    """Dates of the fact that may hold a staged trip_id: a semi join of key hashes.

    Equal trip_ids have equal hashes, so no date is missed; two keys of one hash would
    rewrite a date that did not change, nothing more. Dates without an index (of
    versions older than it) are looked through by the trip_id column itself. A null
    key is in no other row and is not looked for."""
    probe = keys.filter("trip_id is not null").select(F.xxhash64("trip_id").alias(KEY_HASH)).distinct()
    rest = [d for part, d in live.items() if part not in indexed]
    sides = []
    if indexed:
        sides.append(key_index(spark, root, indexed.values()))
    if rest:
        sides.append(_read_dirs(spark, root, FACT_DIR, rest).select(F.xxhash64("trip_id").alias(KEY_HASH), FACT_PARTITION))
    found: set[str] = set()
    for side in sides:
        days = side.join(probe, KEY_HASH, "left_semi").select(FACT_PARTITION).distinct()
        found |= {_part_of(r[0]) for r in days.collect()}  # bounded by the calendar
    return found


def _written(folder: commits.Folder, table: str, write: str) -> list[commits.Entry]:
    names = [name for name, _ in folder.matching(f"{table}/{FACT_PARTITION}=*/{WRITE}={write}")]
    return [(table, name.split("/")[1].split("=", 1)[1], name) for name in names]


def _merge_fact(spark, batch, root, live, indexed, fact_mode, write) -> list[commits.Entry]:
    """Rewrite the touched dates: their rows without the staged trip_ids, and the
    batch; then the key index of what was written."""
    scratch = f"{root}/_merge/{write}"
    keys = stage_keys(batch, [FACT_PARTITION, "trip_id"], scratch)
    touched = {_part_of(day) for day in partition_values(keys, FACT_PARTITION)}
    on = [FACT_PARTITION, "trip_id"]
    if fact_mode == "snapshot":
        on = ["trip_id"]
        if live:
            touched |= touched_parts(spark, root, live, indexed, keys)
    target = _read_dirs(spark, root, FACT_DIR, [d for part, d in live.items() if part in touched])
    merged = upsert(target, batch, on, keys if len(on) > 1 else keys.select(*on).distinct())
    by_date = [FACT_PARTITION, WRITE]
    cluster_fact(merged).withColumn(WRITE, F.lit(write)).write.mode("append").partitionBy(*by_date).parquet(
        f"{root}/{FACT_DIR}"
    )
    folder = commits.Folder(spark, root)
    folder.delete(f"_merge/{write}")
    entries = _written(folder, FACT_DIR, write)
    if entries:  # from the files just written: one column of the touched dates, no shuffle
        rows = _read_dirs(spark, root, FACT_DIR, [d for _, _, d in entries])
        hashes = rows.select(FACT_PARTITION, F.xxhash64("trip_id").alias(KEY_HASH), F.lit(write).alias(WRITE))
        hashes.sortWithinPartitions(FACT_PARTITION, KEY_HASH).write.mode("append").partitionBy(*by_date).parquet(
            f"{root}/{KEYS_DIR}"
        )
        entries += _written(folder, KEYS_DIR, write)
    kept = [(FACT_DIR, live), (KEYS_DIR, indexed)]
    return [(table, part, d) for table, own in kept for part, d in own.items() if part not in touched] + entries


def expire_star(spark: SparkSession, root: str, *, keep: int = 2, grace_seconds: float = 86_400) -> list[str]:
    """Delete versions but the newest ``keep`` and every directory that none of
    those lists, merge scratch included (see ``commits.expire``)."""
    dims = [f"{name}/{WRITE}=*" for name in STAR_TABLES if name != FACT_DIR]
    facts = [f"{name}/{FACT_PARTITION}=*/{WRITE}=*" for name in (FACT_DIR, KEYS_DIR)]
    patterns = [*dims, *facts, "_merge/*", f"{commits.COMMITS}/.*"]
    return commits.expire(spark, root, patterns, keep=keep, grace_seconds=grace_seconds)


# -- rule results ----------------------------------------------------------------
def save_rule_results(outcomes: DataFrame, path: str) -> None:
    """Append outcome rows, one directory per ruleset. The pipeline writes
    ``<results>/layer=bronze`` and ``<results>/layer=silver`` so the whole
    store reads back as one table partitioned by (layer, ruleset)."""
    outcomes.write.mode("append").partitionBy("ruleset").parquet(path)
