"""Silver reader and run scoping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.contracts import ALL_RUNS, SILVER
from strata.functions.literals import empty_frame
from strata.sinks import commits


def read_silver(
    spark: SparkSession, path: str, schema: T.StructType = SILVER, *, version: int | None = None
) -> DataFrame:
    """Read the partitioned Silver table with an explicit schema: the directories of
    the newest commit, or of ``version``. The frame keeps to them: writes that are
    committed later do not show in it. A folder without commits is read whole.

    Partition inference would turn ``run_id=007`` into the int 7 and then
    fail on ``run_id=manual-1``; the declared schema keeps it a string, so a
    run filter stays a partition filter."""
    reader = spark.read.schema(schema)
    commit = commits.read_commit(spark, path, version)
    if commit is None:
        if version is not None:
            raise ValueError(f"no version {version} of {path}")
        return reader.parquet(path)
    root = path.rstrip("/")
    live = sorted(f"{root}/{d}" for d in commit.directories())
    if not live:
        return empty_frame(spark, schema)
    return reader.option("basePath", root).parquet(*live).select(*schema.names)


def scope_run(df: DataFrame, run_id: str, column: str = "run_id") -> DataFrame:
    """Keep one run; the sentinel ``"manual"`` keeps every run. On a
    partitioned read this becomes a partition filter (directories pruned)."""
    if run_id == ALL_RUNS:
        return df
    return df.filter(F.col(column) == F.lit(run_id))
