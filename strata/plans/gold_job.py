"""Silver -> Gold load (entry point C): scope the run, build the star, stage
it, publish it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strata.operators.dims import build_star
from strata.sinks.gold import publish_star, read_gold_stage, write_gold_stage
from strata.sources.silver import read_silver, scope_run


@dataclass
class GoldResult:
    loaded: bool
    version: int | None


def load_gold(
    spark: SparkSession,
    silver: DataFrame | str,
    zones: DataFrame,
    run_id: str,
    stage_base: str,
    star_root: str,
    *,
    fact_mode: str = "snapshot",
    catalog: str | None = None,
    fail_after: str | None = None,
) -> GoldResult:
    """Stage and publish one run. An empty run returns before touching the
    staging area or the published star (one short ``isEmpty`` job)."""
    df = read_silver(spark, silver) if isinstance(silver, str) else silver
    batch = scope_run(df, run_id)
    if batch.isEmpty():
        return GoldResult(False, None)
    write_gold_stage(build_star(batch, zones), stage_base, run_id)
    # Publish from the staged files, as the warehouse load does, so the star
    # is computed once and the upsert reads plain Parquet.
    staged = read_gold_stage(spark, stage_base, run_id)
    version = publish_star(spark, staged, star_root, fact_mode=fact_mode, run_id=run_id, catalog=catalog,
                           fail_after=fail_after)
    return GoldResult(True, version)
