"""Silver sink (K1) and empty-batch guard (K2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.contracts import ALL_RUNS, SILVER_PARTITIONS
from strata.sinks import commits

TABLE = "silver"
WRITE = "w"  # partition level of one write, above the others
ATTEMPTS = 20


def write_silver(df: DataFrame, path: str, partitions=SILVER_PARTITIONS, *, compact: bool = False) -> None:
    """Write runs' rows, Hive-partitioned by (year, month, run) below a directory of
    this write, and commit them (see ``sinks.commits``).

    A run written again under its own id (a retry, or a corrected source) replaces
    all that it had, whatever months it then had, by one commit: readers see the
    earlier run or the later, never both nor a part. The run id ``manual``, which
    every hand-started run carries, adds to what is there. Other runs are never
    touched, and a writer that loses the race for a version commits the next one:
    writes of different runs do not conflict, of the same run the last one stays.

    Default: written straight from the map side, each task writing one file
    per partition value it holds, with no shuffle; with input splits of
    ~128 MB the files come out near that size. ``compact=True`` is for input
    made of many small files (e.g. micro-batches): a ``rebalance`` hint on the
    partition columns lets AQE pack rows into advisory-sized files (and split
    a hot month across tasks) at the price of one shuffle of the batch.
    A batch with no rows commits nothing, so an empty run leaves the table
    unchanged. Directories that were replaced stay until ``expire_silver``."""
    spark, write = df.sparkSession, commits.new_write()
    if compact:
        df = df.hint("rebalance", *partitions)
    df.withColumn(WRITE, F.lit(write)).write.mode("append").partitionBy(WRITE, *partitions).parquet(path)
    below = "/".join(f"{p}=*" for p in partitions)
    written = commits.written_parts(commits.Folder(spark, path), f"{WRITE}={write}/{below}")
    if not written:
        return
    replaced = {run for run, _ in written} - {ALL_RUNS}
    for attempt in range(ATTEMPTS):
        base = commits.read_commit(spark, path)
        kept = [e for e in (base.entries if base else ()) if e[1] not in replaced]
        try:
            commits.commit(spark, path, base, [*kept, *((TABLE, run, where) for run, where in written)])
            return
        except commits.CommitConflict:
            if attempt == ATTEMPTS - 1:
                raise


def expire_silver(spark, path: str, partitions=SILVER_PARTITIONS, *, keep: int = 2, grace_seconds: float = 86_400):
    """Delete replaced and uncommitted run directories (see ``commits.expire``)."""
    pattern = "/".join([f"{WRITE}=*", *(f"{p}=*" for p in partitions)])
    return commits.expire(spark, path, [pattern, f"{commits.COMMITS}/.*"], keep=keep, grace_seconds=grace_seconds)


def write_if_any(df: DataFrame, writer: Callable[[DataFrame], None]) -> bool:
    """Call ``writer(df)`` only when ``df`` has a row.

    ``isEmpty`` stops at the first row found, so the check costs one short
    job; use it in front of overwrite-mode sinks, where an empty write would
    replace existing data with nothing."""
    if df.isEmpty():
        return False
    writer(df)
    return True
