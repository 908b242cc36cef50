"""The whole pipeline for one run (entry point A).

``ingest -> gate(bronze) -> Bronze->Silver -> gate(silver) -> quarantine |
Gold publish``. Spark actions block, so no polling is needed; the only values
the driver looks at are the two one-row gate scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.derive import prepare_bronze
from strata.operators.quality import GateDecision, GateFailed, gate, outcomes_from_partials, partial_counts
from strata.plans.gold_job import GoldResult, load_gold
from strata.plans.runlog import EXECUTION, RunLogger
from strata.plans.silver_job import SilverResult, bronze_to_silver
from strata.rulesets import bronze_ruleset, silver_ruleset
from strata.sinks.gold import quarantine, save_rule_results
from strata.sources.catalog import refresh_partitions
from strata.sources.silver import read_silver, scope_run


@dataclass
class PipelineConfig:
    silver_path: str
    stage_base: str
    star_root: str
    quarantine_path: str
    results_path: str
    # "table": score the whole Silver table (parity; scans all of it),
    # "table_incremental": same score from stored per-run counts (scans only
    # this run), "run": score this run only.
    gate_scope: str = "table"
    silver_inclusive: bool = True
    min_score: float = 1.0
    fact_mode: str = "snapshot"  # or "snapshot_by_date" / "partitions" (see publish_star)
    run_log_path: str | None = None  # append one row per step (O1-O3 input)
    silver_table: str | None = None  # catalog table over silver_path to refresh
    star_schema: str | None = None  # schema whose star tables follow each publish (create_star)


@dataclass
class RunReport:
    run_id: str
    bronze_gate: GateDecision | None = None
    silver: SilverResult | None = None
    silver_gate: GateDecision | None = None
    gold: GoldResult | None = None
    quarantined_to: str | None = None
    notes: list[str] = field(default_factory=list)


def table_outcomes_incremental(
    spark: SparkSession, run_rows: DataFrame, ruleset, path: str, table: DataFrame | None = None
) -> DataFrame:
    """Table-scope outcomes while scanning only the new run.

    The run's partial counts (one row per run id) are written with dynamic
    partition overwrite, so a re-gated or replayed run replaces its own row;
    the table's outcomes are then computed from the sum over all stored runs.
    Exact as long as Silver runs are only appended or replaced whole, which is
    how this pipeline writes them. Given the ``table``, runs in it that have no
    stored counts yet are counted first, so none is left out of the score, and
    stored counts of runs that are no longer in it are left out."""
    (
        partial_counts(run_rows, ruleset, ["run_id"])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(f"{path}/ruleset={ruleset.name}")
    )
    stored = f"{path}/ruleset={ruleset.name}"
    counts = spark.read.parquet(stored)
    if table is not None:
        runs = table.select("run_id").distinct()
        known = counts.select(F.col("run_id").cast("string").alias("run_id")).distinct()
        gap = runs.join(known, "run_id", "left_anti")
        if not gap.isEmpty():
            backfill_partials(table.join(gap, "run_id", "left_semi"), ruleset, path)
        # a run that has gone from the table no longer counts
        counts = spark.read.parquet(stored).withColumn("run_id", F.col("run_id").cast("string"))
        counts = counts.join(runs, "run_id", "left_semi")
    return outcomes_from_partials(counts, ruleset)


def backfill_partials(silver: DataFrame, ruleset, path: str) -> None:
    """Store the per-run counts of every run already in Silver (one grouped
    aggregate over the table), before switching a table to
    ``gate_scope="table_incremental"``. Safe to repeat: each run's row is
    replaced."""
    (
        partial_counts(silver, ruleset, ["run_id"])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(f"{path}/ruleset={ruleset.name}")
    )


def _stamped(outcomes: DataFrame, run_id: str) -> DataFrame:
    """Outcome rows with the run and evaluation time (input of O4)."""
    return outcomes.withColumns({"run_id": F.lit(run_id), "evaluated_at": F.current_timestamp()})


def run_pipeline(
    spark: SparkSession,
    raw: DataFrame,
    zones: DataFrame,
    run_id: str,
    cfg: PipelineConfig,
    *,
    raise_on_fail: bool = True,
) -> RunReport:
    report = RunReport(run_id)
    log = RunLogger(spark, cfg.run_log_path)
    try:
        with log.step(EXECUTION) as whole:
            _run(spark, raw, zones, run_id, cfg, report, log, raise_on_fail)
            if not (report.bronze_gate.passed and report.silver_gate and report.silver_gate.passed):
                whole.fail()
        return report
    finally:
        log.flush()


def _run(spark, raw, zones, run_id, cfg, report, log, raise_on_fail) -> RunReport:
    # Bronze gate: failure stops the run; nothing is quarantined.
    with log.step("bronze_gate") as step:
        decision, outcomes = gate(prepare_bronze(raw), bronze_ruleset(), cfg.min_score,
                                  result_id=f"bronze/{run_id}")
        save_rule_results(_stamped(outcomes, run_id), f"{cfg.results_path}/layer=bronze")
        report.bronze_gate = decision
        if not decision.passed:
            step.fail()
    if not decision.passed:
        if raise_on_fail:
            raise GateFailed(decision)
        return report

    with log.step("bronze_to_silver"):
        report.silver = bronze_to_silver(raw, zones, run_id, cfg.silver_path)
        if cfg.silver_table:
            refresh_partitions(spark, cfg.silver_table)

    # Silver gate, on the whole table (parity) or only this run.
    with log.step("silver_gate") as step:
        silver = read_silver(spark, cfg.silver_path)
        rules = silver_ruleset(inclusive=cfg.silver_inclusive)
        scope = silver if cfg.gate_scope == "table" else scope_run(silver, run_id)
        precomputed = None
        if cfg.gate_scope == "table_incremental":
            precomputed = table_outcomes_incremental(
                spark, scope, rules, f"{cfg.results_path.rstrip('/')}_partials", silver)
        decision, outcomes = gate(scope, rules, cfg.min_score, result_id=f"silver/{run_id}",
                                  outcomes=precomputed)
        save_rule_results(_stamped(outcomes, run_id), f"{cfg.results_path}/layer=silver")
        report.silver_gate = decision
        if not decision.passed:
            step.fail()
    if not decision.passed:
        with log.step("quarantine"):
            report.quarantined_to = quarantine(
                scope_run(silver, run_id), run_id, decision.ruleset, decision.result_id,
                decision.score_text, cfg.quarantine_path,
            )
        if raise_on_fail:
            raise GateFailed(decision)
        return report

    with log.step("gold_load"):
        report.gold = load_gold(spark, silver, zones, run_id, cfg.stage_base, cfg.star_root,
                                fact_mode=cfg.fact_mode, catalog=cfg.star_schema)
    return report
