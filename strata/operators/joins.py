"""Lookup joins (J1-J4, P5) and the size-checked broadcast they use.

A lookup is broadcast only after its rows and bytes have been counted and found
under their bounds; the count is one aggregate that is merged inside each task,
so nothing of the lookup itself is moved for it.
Beyond the bound the join is left to the planner (sort-merge join, with AQE
free to switch strategy from runtime sizes).
"""

from __future__ import annotations

import weakref
from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default ceiling for a broadcast lookup. 1M narrow rows is a few tens of MB
#: per executor; real zone and date dimensions are hundreds to thousands.
DEFAULT_BROADCAST_ROWS = 1_000_000
#: Ceiling for the values of a broadcast lookup, whatever its number of rows.
MAX_BROADCAST_BYTES = 64 << 20

_checked: "weakref.WeakKeyDictionary[DataFrame, dict[int, bool]]" = weakref.WeakKeyDictionary()


class LookupFanOut(ValueError):
    """A lookup key maps to more than one row and fan-out was refused."""


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows, of at most
    ``MAX_BROADCAST_BYTES`` together (checked once per frame and bound)."""
    try:
        return _checked[df][max_rows]
    except (KeyError, TypeError):
        pass
    values = [F.coalesce(F.octet_length(df[f"`{c}`"].cast("string")), F.lit(0)) + 8 for c in df.columns]
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(reduce(add, values).cast("long")).alias("bytes")).first()
    ok = size["n"] <= max_rows and (size["bytes"] or 0) <= MAX_BROADCAST_BYTES
    try:
        _checked.setdefault(df, {})[max_rows] = ok
    except TypeError:  # pragma: no cover - frame not weak-referenceable
        pass
    return ok


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` when its size is proven small, else ``df`` unchanged."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def role_dimension(
    dim: DataFrame, key: str, role_key: str, prefix: str, columns: Iterable[str]
) -> DataFrame:
    """Project a lookup under role-specific names, e.g. ``pu_borough``."""
    return dim.select(
        F.col(key).alias(role_key), *[F.col(c).alias(f"{prefix}_{c}") for c in columns]
    )


def check_unique_key(dim: DataFrame, key: str) -> None:
    """Raise ``LookupFanOut`` when ``key`` repeats (one aggregate job)."""
    dup = dim.groupBy(key).count().filter(F.col("count") > 1).limit(1).count()
    if dup:
        raise LookupFanOut(f"lookup key {key!r} is not unique")


def enrich(
    df: DataFrame,
    dim: DataFrame,
    on: str,
    *,
    on_duplicate: str = "multiply",
    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
) -> DataFrame:
    """Left outer equi-join of ``df`` with a lookup on one shared column.

    ``on_duplicate``: ``"multiply"`` (default; a duplicated lookup key repeats
    the row, as a plain join does), ``"error"`` (raise) or ``"first"`` (keep
    one lookup row per key, the smallest by the remaining columns).
    """
    if on_duplicate == "error":
        check_unique_key(dim, on)
    elif on_duplicate == "first":
        dim = dedupe_min(dim, [on])
    elif on_duplicate != "multiply":
        raise ValueError(f"unknown on_duplicate={on_duplicate!r}")
    return df.join(bounded_broadcast(dim, max_broadcast_rows), on, "left")


def dedupe_min(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the row whose ``order`` columns (default: all other
    columns) are smallest, nulls first. A hash aggregate with map-side
    partial merge, so a hot key is collapsed before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order = order or rest
    tail = [c for c in rest if c not in order]
    picked = F.min(F.struct(*[F.col(c) for c in order + tail])).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
