"""Aggregation building blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strata.functions.columns import ratio_pct


def count_by(df: DataFrame, keys: Sequence[str | Column], name: str = "trips") -> DataFrame:
    """``count(*)`` per key; a null key is its own group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_and_mean(
    df: DataFrame, keys: Sequence[str | Column], x: str, count_name="trips", mean_name="avg_minutes"
) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(count_name), F.round(F.avg(x), 2).alias(mean_name)
    )


def coverage_pct(col: str) -> Column:
    """100 x non-null rows / all rows, 2 dp; null on an empty input."""
    return ratio_pct(F.count(col), F.count(F.lit(1)))


def value_range(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """min, max and exact distinct count of one column."""
    return df.agg(
        F.min(col).alias(f"first_{prefix}"),
        F.max(col).alias(f"last_{prefix}"),
        F.count_distinct(col).alias("loaded_days"),
    )


def summary_band(df: DataFrame, col: str, suffix: str = "minutes") -> DataFrame:
    return df.agg(
        F.round(F.min(col), 2).alias(f"min_{suffix}"),
        F.round(F.avg(col), 2).alias(f"avg_{suffix}"),
        F.round(F.max(col), 2).alias(f"max_{suffix}"),
    )


def metric_columns(metrics: Mapping[str, Column | None]) -> list[Column]:
    """``{name: predicate}`` -> counting aggregates; ``None`` counts all rows."""
    out = []
    for name, pred in metrics.items():
        agg = F.count(F.lit(1)) if pred is None else F.count(F.when(pred, F.lit(1)))
        out.append(agg.alias(name))
    return out


def observe_counts(
    df: DataFrame, metrics: Mapping[str, Column | None], name: str = "batch_metrics"
) -> tuple[DataFrame, Observation]:
    """Attach counting metrics to ``df`` without an extra job (A1).

    The counts are gathered by the next action on the returned frame (for
    example the Silver write), so the source is scanned once instead of once
    per count."""
    obs = Observation(name)
    return df.observe(obs, *metric_columns(metrics)), obs


def batch_counts(df: DataFrame, metrics: Mapping[str, Column | None]) -> DataFrame:
    """Same metrics as one aggregate row (for reporting / comparison)."""
    return df.agg(*metric_columns(metrics))
