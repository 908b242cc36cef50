"""Data-quality rules, evaluation, score and gate (Q1-Q9).

Rules are typed Python objects (no rule-text parser). A ruleset compiles to
ONE aggregate over the table: every rule contributes a few counting columns,
all computed in the same scan with map-side partial aggregation, and the
single wide result row is turned into one outcome row per rule with
``inline(array(struct ...))``. ``evaluate_by`` does the same per group (for
example per run) in one grouped aggregate.

Outcome rows: ``ruleset, rule_no, rule, metric, passed``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.literals import literal_frame


def _n(name: str) -> str:
    return f"`{name}`"


@dataclass(frozen=True)
class Rule:
    """One rule. ``kind``: row_count | is_complete | completeness | column_values."""

    kind: str
    column: str | None = None
    threshold: float | None = None
    lo: float | None = None
    hi: float | None = None
    inclusive: bool = True

    # -- text -------------------------------------------------------------
    def text(self) -> str:
        if self.kind == "row_count":
            return f"RowCount > {_num(self.threshold)}"
        if self.kind == "is_complete":
            return f'IsComplete "{self.column}"'
        if self.kind == "completeness":
            return f'Completeness "{self.column}" > {_num(self.threshold)}'
        if self.kind == "column_values":
            word = "between" if self.inclusive else "strictly between"
            return f'ColumnValues "{self.column}" {word} {_num(self.lo)} and {_num(self.hi)}'
        raise ValueError(self.kind)

    # -- row level --------------------------------------------------------
    def in_range(self) -> Column:
        c = F.col(_n(self.column))
        if self.inclusive:
            return (c >= F.lit(self.lo)) & (c <= F.lit(self.hi))
        return (c > F.lit(self.lo)) & (c < F.lit(self.hi))

    def row_ok(self) -> Column | None:
        """Per-row condition for row-level rules (None for table-level ones).
        ColumnValues leaves nulls to IsComplete, so a null passes it."""
        if self.kind == "is_complete":
            return F.col(_n(self.column)).isNotNull()
        if self.kind == "column_values":
            return F.col(_n(self.column)).isNull() | self.in_range()
        return None

    # -- aggregate level --------------------------------------------------
    def partials(self, i: int) -> list[Column]:
        """Counting aggregates this rule needs, named ``_r{i}_*``."""
        total = F.count(F.lit(1)).alias(f"_r{i}_all")
        if self.kind == "row_count":
            return [total]
        nonnull = F.count(F.col(_n(self.column))).alias(f"_r{i}_nn")
        if self.kind in ("is_complete", "completeness"):
            return [total, nonnull]
        if self.kind == "column_values":
            good = F.count(F.when(self.in_range(), F.lit(1))).alias(f"_r{i}_ok")
            return [nonnull, good]
        raise ValueError(self.kind)

    def outcome(self, i: int) -> tuple[Column, Column]:
        """(metric, passed) from the aggregated ``_r{i}_*`` columns."""
        col = lambda s: F.col(f"_r{i}_{s}")
        if self.kind == "row_count":
            return col("all").cast("double"), col("all") > F.lit(self.threshold)
        frac_all = F.try_divide(col("nn").cast("double"), F.nullif(col("all"), F.lit(0)))
        if self.kind == "is_complete":
            return frac_all, col("nn") == col("all")
        if self.kind == "completeness":
            return frac_all, F.coalesce(frac_all > F.lit(self.threshold), F.lit(False))
        frac_ok = F.try_divide(col("ok").cast("double"), F.nullif(col("nn"), F.lit(0)))
        return frac_ok, col("ok") == col("nn")


def _num(x) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def row_count(gt: int = 0) -> Rule:
    return Rule("row_count", threshold=gt)


def is_complete(col: str) -> Rule:
    return Rule("is_complete", col)


def completeness(col: str, gt: float) -> Rule:
    """Non-null fraction strictly greater than ``gt``; an empty table fails."""
    return Rule("completeness", col, threshold=gt)


def column_values(col: str, between: tuple[float, float], inclusive: bool = True) -> Rule:
    lo, hi = between
    return Rule("column_values", col, lo=lo, hi=hi, inclusive=inclusive)


@dataclass(frozen=True)
class Ruleset:
    name: str
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def texts(self) -> list[str]:
        return [r.text() for r in self.rules]


def _outcome_structs(ruleset: Ruleset) -> Column:
    structs = []
    for i, rule in enumerate(ruleset.rules):
        metric, passed = rule.outcome(i)
        structs.append(
            F.struct(
                F.lit(ruleset.name).alias("ruleset"),
                F.lit(i + 1).alias("rule_no"),
                F.lit(rule.text()).alias("rule"),
                metric.cast("double").alias("metric"),
                passed.alias("passed"),
            )
        )
    return F.array(*structs)


def _partials(ruleset: Ruleset) -> list[Column]:
    return [p for i, r in enumerate(ruleset.rules) for p in r.partials(i)]


def evaluate(df: DataFrame, ruleset: Ruleset) -> DataFrame:
    """All rules of ``ruleset`` over the whole of ``df`` in one aggregate."""
    wide = df.agg(*_partials(ruleset))
    return wide.select(F.inline(_outcome_structs(ruleset)))


def evaluate_by(df: DataFrame, ruleset: Ruleset, by: Sequence[str]) -> DataFrame:
    """Outcomes per group (e.g. per run), one grouped aggregate; the group
    columns are kept in front of the outcome columns. A hot group is merged
    map-side, so it costs no more than any other."""
    wide = df.groupBy(*by).agg(*_partials(ruleset))
    return wide.select(*by, F.inline(_outcome_structs(ruleset)))


# -- additive evaluation ----------------------------------------------------
# Every metric above is a ratio or comparison of COUNTS, and counts add up.
# So the per-group counting columns ("partials") of disjoint parts of a table
# can be stored and summed later: the outcome over the union equals the
# outcome from the summed partials, exactly (same integers, same division).
def partial_counts(df: DataFrame, ruleset: Ruleset, by: Sequence[str] = ()) -> DataFrame:
    """The ruleset's counting columns, per group of ``by`` (one aggregate)."""
    if by:
        return df.groupBy(*by).agg(*_partials(ruleset))
    return df.agg(*_partials(ruleset))


def outcomes_from_partials(partials: DataFrame, ruleset: Ruleset) -> DataFrame:
    """Outcome rows from stored partial counts of any number of parts."""
    names = [c for c in partials.columns if c.startswith("_r")]
    summed = partials.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])
    return summed.select(F.inline(_outcome_structs(ruleset)))


def score(outcomes: DataFrame, by: Sequence[str] = ("ruleset",)) -> DataFrame:
    """Share of passed rules per ruleset (1.0 = every rule passed)."""
    passed = F.col("passed").cast("int")
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.sum(passed).cast("long").alias("passed_rules"),
        F.avg(passed.cast("double")).alias("score"),
    )


def rule_counts(outcomes: DataFrame, by: Sequence[str] = ("ruleset",)) -> DataFrame:
    """Passed and failed rules per ruleset (Q8)."""
    return outcomes.groupBy(*by).agg(
        F.count(F.when(F.col("passed"), F.lit(1))).alias("rules_passed"),
        F.count(F.when(~F.col("passed"), F.lit(1))).alias("rules_failed"),
    )


def failing_rows(df: DataFrame, ruleset: Ruleset, sep: str = "; ") -> DataFrame:
    """Rows breaking at least one row-level rule, with the broken rules
    listed (in rule order) in ``failed_rules``."""
    checks = [(r.text(), r.row_ok()) for r in ruleset.rules if r.row_ok() is not None]
    if not checks:
        return df.limit(0).withColumn("failed_rules", F.lit(None).cast("string"))
    names = F.concat_ws(sep, *[F.when(~ok, F.lit(text)) for text, ok in checks])
    bad = F.lit(False)
    for _, ok in checks:
        bad = bad | ~ok
    return df.filter(bad).withColumn("failed_rules", names)


# -- gate -------------------------------------------------------------------
class GateFailed(RuntimeError):
    def __init__(self, decision: "GateDecision"):
        super().__init__(
            f"{decision.ruleset} scored {decision.score} (< {decision.min_score}); "
            f"{decision.passed_rules}/{decision.total_rules} rules passed"
        )
        self.decision = decision


@dataclass(frozen=True)
class GateDecision:
    ruleset: str
    score: float
    passed_rules: int
    total_rules: int
    min_score: float
    result_id: str

    @property
    def passed(self) -> bool:
        return self.score >= self.min_score

    @property
    def score_text(self) -> str:
        return repr(float(self.score))


def settled_counts(df: DataFrame, ruleset: Ruleset) -> DataFrame:
    """Run the ruleset's single aggregate once and keep its one row of counts
    as a local frame (a fixed number of longs, whatever the table size), so
    score, stored outcomes and reports derived from it never rescan ``df``."""
    counts = partial_counts(df, ruleset)
    return literal_frame(df.sparkSession, [tuple(counts.first())], counts.schema)


def gate(df: DataFrame, ruleset: Ruleset, min_score: float = 1.0, result_id: str | None = None,
         *, outcomes: DataFrame | None = None) -> tuple[GateDecision, DataFrame]:
    """Evaluate and decide with ONE scan of ``df``.

    The ruleset's counts are computed once (``settled_counts``); the score and
    the returned outcomes frame (for storage) both come from that one row, by
    plain projections (no shuffle), so saving the outcomes does not scan the
    table again. Pass ``outcomes`` (e.g. from ``outcomes_from_partials``) to
    decide on precomputed ones."""
    if outcomes is None:
        settled = settled_counts(df, ruleset)
        structs = _outcome_structs(ruleset)
        outcomes = settled.select(F.inline(structs))
        passed = F.aggregate(structs, F.lit(0), lambda acc, x: acc + x["passed"].cast("int"))
        row = settled.select(passed.alias("passed_rules"), F.size(structs).alias("total_rules")).first()
        row = {"passed_rules": row["passed_rules"], "total_rules": row["total_rules"],
               "score": row["passed_rules"] / row["total_rules"] if row["total_rules"] else 0.0}
    else:
        row = score(outcomes).first()
    decision = GateDecision(
        ruleset.name,
        float(row["score"]) if row else 0.0,
        int(row["passed_rules"]) if row else 0,
        int(row["total_rules"]) if row else 0,
        min_score,
        result_id or f"dqresult-{ruleset.name}",
    )
    return decision, outcomes
