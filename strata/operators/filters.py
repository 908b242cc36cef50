"""Row filters (F1-F4) and their complements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.contracts import MAX_TRIP_MINUTES


def validity_predicate(
    lo: float = 0.0,
    hi: float = MAX_TRIP_MINUTES,
    duration: str = "trip_duration_minutes",
    required: tuple[str, ...] = ("pickup_year", "pickup_month", "run_id"),
) -> Column:
    """non-null required columns and ``lo <= duration < hi``.

    Three-valued logic: a null duration makes the predicate null, so the row
    is dropped by ``filter``."""
    pred = (F.col(duration) >= F.lit(lo)) & (F.col(duration) < F.lit(hi))
    for c in reversed(required):
        pred = F.col(c).isNotNull() & pred
    return pred


def valid_trips(df: DataFrame, lo: float = 0.0, hi: float = MAX_TRIP_MINUTES) -> DataFrame:
    return df.filter(validity_predicate(lo, hi))


def rejection_reason(lo: float = 0.0, hi: float = MAX_TRIP_MINUTES) -> Column:
    """First failing condition, in the order the validity filter lists them;
    null for a valid row."""
    d = F.col("trip_duration_minutes")
    return (
        F.when(F.col("pickup_year").isNull(), "missing_pickup_year")
        .when(F.col("pickup_month").isNull(), "missing_pickup_month")
        .when(F.col("run_id").isNull(), "missing_run_id")
        .when(d.isNull(), "missing_duration")
        .when(d < F.lit(lo), "negative_duration")
        .when(d >= F.lit(hi), "duration_too_long")
    )


def rejected_trips(df: DataFrame, lo: float = 0.0, hi: float = MAX_TRIP_MINUTES) -> DataFrame:
    """Complement of ``valid_trips`` (null predicate counts as rejected), with
    a ``reject_reason`` column. ``valid + rejected`` is the input."""
    keep = F.coalesce(validity_predicate(lo, hi), F.lit(False))
    return df.filter(~keep).withColumn("reject_reason", rejection_reason(lo, hi))


def unresolved_predicate() -> Column:
    return F.col("pu_borough").isNull() | F.col("do_borough").isNull()


def unresolved(df: DataFrame) -> DataFrame:
    """Rows whose pickup or drop-off borough is unknown (null id, id absent
    from the lookup, or a lookup row with a null borough)."""
    return df.filter(unresolved_predicate())


def known(df: DataFrame, *cols: str) -> DataFrame:
    """Keep rows where every named column is non-null."""
    pred = F.lit(True)
    for c in cols:
        pred = pred & F.col(c).isNotNull()
    return df.filter(pred)
