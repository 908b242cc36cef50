from strata.functions.columns import (
    calendar_columns,
    column_key,
    duration_minutes,
    lenient_cast,
    ratio_pct,
    sanitize,
    surrogate_key,
)

__all__ = [
    "calendar_columns",
    "column_key",
    "duration_minutes",
    "lenient_cast",
    "ratio_pct",
    "sanitize",
    "surrogate_key",
]
