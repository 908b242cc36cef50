"""Bronze -> Silver job (entry point B) with one-pass batch metrics."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation

from strata.operators.aggregates import observe_counts
from strata.operators.derive import enriched_trips, silver_columns
from strata.operators.filters import unresolved_predicate, validity_predicate
from strata.sinks.silver import write_silver


@dataclass
class SilverResult:
    written: bool
    rows_read: int
    unresolved: int
    rows_written: int


def silver_plan(raw: DataFrame, zones: DataFrame, run_id: str, **kw) -> tuple[DataFrame, Observation]:
    """Lazy Silver frame with ONE observation attached, on the derived rows
    just before the validity filter: rows read (after enrichment, as the
    source counts them), unresolved zones, and rows kept (a conditional count
    of the filter's own predicate). Filled by the single write action."""
    lo, hi = kw.pop("lo", 0.0), kw.pop("hi", 1440.0)
    enriched = enriched_trips(raw, zones, **{k: v for k, v in kw.items() if k == "max_broadcast_rows"})
    derived = silver_columns(enriched, run_id, null_token=kw.get("null_token"))
    keep = validity_predicate(lo, hi)
    derived, obs = observe_counts(
        derived,
        {"rows_read": None, "unresolved": unresolved_predicate(), "rows_written": keep},
        f"silver_batch_{uuid.uuid4().hex[:8]}",
    )
    return derived.filter(keep), obs


def bronze_to_silver(raw: DataFrame, zones: DataFrame, run_id: str, silver_path: str, *,
                     compact: bool = False, **kw) -> SilverResult:
    """Transform and append one run to Silver in a single Spark action.

    An empty result writes nothing (no empty partition directories);
    ``compact`` packs many small inputs into fewer files (see write_silver)."""
    silver, obs = silver_plan(raw, zones, run_id, **kw)
    write_silver(silver, silver_path, compact=compact)
    m = obs.get
    rows = int(m.get("rows_written", 0) or 0)
    return SilverResult(rows > 0, int(m.get("rows_read", 0) or 0), int(m.get("unresolved", 0) or 0), rows)
