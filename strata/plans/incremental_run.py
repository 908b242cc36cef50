"""Incremental run to Gold (S2): new files -> gate -> Silver -> gate -> publish.

The file source hands out each file once (its checkpoint is the bookmark); every
micro-batch goes through the whole pipeline under its own run id ``<run>-b<batch>``.

Exactly once. A batch is recorded in a ledger when it is decided: published,
quarantined, stopped at the Bronze gate, or empty. A batch that the source hands out
again (a crash after the decision, before its checkpoint) is found there and skipped.
A crash earlier leaves no ledger row, and the batch is done anew under the same run
id: Silver replaces the run, quarantine overwrites it, and a publish that was
committed is recognised by the run id in its commit and not made twice. An empty wave
hands out no batch and changes nothing.

The stream carries file paths only; their files are then read as drifting Bronze
(``sources.bronze``), so a delivery with other spellings or types loses no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.literals import literal_frame
from strata.plans.run import PipelineConfig, RunReport, run_pipeline
from strata.sinks import commits
from strata.sources.bronze import read_drifting_files

LEDGER = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("files", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("version", T.LongType()),
])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per decided batch."""
    if not commits.Folder(spark, path).matching("*.parquet"):
        return literal_frame(spark, [], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def _decision(report: RunReport) -> tuple[str, int | None]:
    if not report.bronze_gate.passed:
        return "bronze_failed", None
    if report.quarantined_to or not report.silver_gate.passed:
        return "quarantined", None
    if report.gold is None or not report.gold.loaded:
        return "empty", None
    return "published", report.gold.version


def batch_publisher(
    spark: SparkSession, zones: DataFrame, run_id: str, cfg: PipelineConfig, ledger_path: str, source: str
) -> Callable[[DataFrame, int], None]:
    """``on_batch`` for a stream of file paths (column ``path``)."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        own = (F.col("source") == source) & (F.col("batch_id") == batch_id)
        if not read_ledger(spark, ledger_path).filter(own).isEmpty():
            return
        files = sorted(r["path"] for r in batch.select("path").collect())  # bounded by max_files_per_trigger
        if not files:
            return
        run = f"{run_id}-b{batch_id}"
        if run in commits.published_runs(spark, cfg.star_root):
            status, version = "published", commits.versions(spark, cfg.star_root)[-1]
        else:
            raw = read_drifting_files(spark, files)
            status, version = _decision(run_pipeline(spark, raw, zones, run, cfg, raise_on_fail=False))
        row = (source, int(batch_id), run, len(files), status, version)
        literal_frame(spark, [row], LEDGER).coalesce(1).write.mode("append").parquet(ledger_path)

    return on_batch


def run_incremental(
    spark: SparkSession,
    landing: str,
    zones: DataFrame,
    run_id: str,
    cfg: PipelineConfig,
    checkpoint: str,
    ledger_path: str,
    *,
    glob: str = "*.parquet",
    max_files_per_trigger: int = 10_000,
) -> DataFrame:
    """Take all files under ``landing`` that ``checkpoint`` has not seen to Gold, and
    return the ledger. Batches are of at most ``max_files_per_trigger`` files."""
    stream = (
        spark.readStream.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", str(max_files_per_trigger))
        .schema("path string, modificationTime timestamp, length long, content binary")
        .load(landing)
        .select("path")  # contents are not read here
    )
    query = (
        stream.writeStream.foreachBatch(batch_publisher(spark, zones, run_id, cfg, ledger_path, checkpoint))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return read_ledger(spark, ledger_path)
