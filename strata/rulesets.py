"""The two reference rulesets, as data built from the typed rule builders.

Fixed values: Bronze = RowCount > 0, IsComplete pickup_datetime, IsComplete
dropoff_datetime. Silver = RowCount > 0; IsComplete trip_id, pickup_datetime,
dropoff_datetime, pickup_date, trip_duration_minutes; Completeness
pu_location_id > 0.15, do_location_id > 0.80, pu_borough > 0.15,
do_borough > 0.80; ColumnValues trip_duration_minutes between 0 and 1440.
The Bronze set deliberately does not require location completeness.
"""

from __future__ import annotations

from strata.operators.quality import Ruleset, column_values, completeness, is_complete, row_count

BRONZE_RULESET_NAME = "bronze-fhvhv-quality"
SILVER_RULESET_NAME = "silver-fhvhv-quality"


def bronze_ruleset(name: str = BRONZE_RULESET_NAME) -> Ruleset:
    return Ruleset(
        name,
        (row_count(0), is_complete("pickup_datetime"), is_complete("dropoff_datetime")),
    )


def silver_ruleset(name: str = SILVER_RULESET_NAME, inclusive: bool = True) -> Ruleset:
    """``inclusive`` decides whether 0 and 1440 pass the range rule."""
    return Ruleset(
        name,
        (
            row_count(0),
            is_complete("trip_id"),
            is_complete("pickup_datetime"),
            is_complete("dropoff_datetime"),
            is_complete("pickup_date"),
            is_complete("trip_duration_minutes"),
            completeness("pu_location_id", 0.15),
            completeness("do_location_id", 0.80),
            completeness("pu_borough", 0.15),
            completeness("do_borough", 0.80),
            column_values("trip_duration_minutes", (0, 1440), inclusive=inclusive),
        ),
    )
