"""Sorts and top-k (T1-T3). Top-k plans as ``TakeOrderedAndProject``: each
task keeps its own k best rows and only those reach the final merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*[F.col(k).asc_nulls_first() for k in keys])


def _measure_order(measure: str, keys: Sequence[str]):
    return [F.col(measure).desc_nulls_last()] + [F.col(k).asc_nulls_first() for k in keys]


def sort_by_measure(df: DataFrame, measure: str, keys: Sequence[str] = ()) -> DataFrame:
    """Descending by ``measure``, ties broken by ``keys`` ascending."""
    return df.orderBy(*_measure_order(measure, keys))


def top_k(df: DataFrame, measure: str, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows by ``measure`` descending, ties broken by ``keys``."""
    return df.orderBy(*_measure_order(measure, keys)).limit(k)
