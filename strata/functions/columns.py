"""Column-expression builders. All are Spark built-ins, so they stay inside
whole-stage codegen; nothing here runs Python per row."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.contracts import KEY_SEPARATOR, LABEL_DISALLOWED


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


_RUN = re.compile("[0-9A-Za-z]+")


def column_key(spelling: str, known_as: Mapping[str, str] | None = None) -> str:
    """The key that all spellings of a column share: its ASCII letter and digit
    runs in lower case, joined by ``_``, unless ``known_as`` names it otherwise.
    Works on column *names*, when the plan is built."""
    key = "_".join(run.lower() for run in _RUN.findall(spelling))
    return known_as[key] if known_as and key in known_as else key


def lenient_cast(col: str | Column, source: T.DataType, target: str) -> Column:
    """Cast that yields null for unparseable text instead of raising under ANSI.

    Text timestamps go through ``try_to_timestamp``; typed inputs (e.g.
    ``timestamp_ntz`` from Parquet) take an ordinary cast.
    """
    c = _c(col)
    if target == "timestamp":
        if isinstance(source, T.StringType):
            return F.try_to_timestamp(c)
        if isinstance(source, T.TimestampType):
            return c
        return c.try_cast("timestamp")
    if isinstance(source, T.StringType):
        return F.trim(c).try_cast(target)
    return c.try_cast(target)


def calendar_columns(ts: str | Column, prefix: str = "pickup") -> dict[str, Column]:
    """Date, year, month, day, hour and a ``yyyyMMdd`` integer key.

    The key is built arithmetically (``year*10000 + month*100 + day``), which
    equals ``date_format(d, 'yyyyMMdd')`` cast to int for years 1-9999 and
    avoids formatting a string per row.
    """
    t = _c(ts)
    d = F.to_date(t)
    return {
        f"{prefix}_date": d,
        f"{prefix}_year": F.year(d),
        f"{prefix}_month": F.month(d),
        f"{prefix}_day": F.dayofmonth(d),
        f"{prefix}_hour": F.hour(t),
        f"{prefix}_date_key": F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d),
    }


def duration_minutes(start: str | Column, end: str | Column) -> Column:
    """Whole-second difference divided by 60, as double.

    ``unix_timestamp`` truncates each side to whole seconds before the
    subtraction (0.98 s apart can be 0 or 1 s), as in the source pipeline.
    """
    return (F.unix_timestamp(_c(end)) - F.unix_timestamp(_c(start))) / F.lit(60.0)


def surrogate_key(
    cols: Iterable[str | Column],
    sep: str = KEY_SEPARATOR,
    null_token: str | None = None,
) -> Column:
    """SHA-256 hex of the fields joined by ``sep``.

    Default: ``concat_ws`` skips nulls, so (5, null) and (null, 5) give one
    key, which is what the source pipeline does. With ``null_token`` every null
    is replaced by that token first, which keeps positions and avoids those
    collisions.
    """
    parts = []
    for col in cols:
        s = _c(col).cast("string")
        parts.append(F.coalesce(s, F.lit(null_token)) if null_token is not None else s)
    return F.sha2(F.concat_ws(sep, *parts), 256)


def sanitize(col: str | Column, disallowed: str = LABEL_DISALLOWED, repl: str = "_") -> Column:
    """Replace every disallowed character (regex class) by ``repl``."""
    return F.regexp_replace(_c(col), disallowed, repl)


def half_up_ratio(numer: Column, denom: Column, factor: int = 1, scale: int = 2) -> Column:
    """``round(factor * numer / denom, scale)`` for non-negative integers, as
    double; null when ``denom`` is 0.

    Rounding is HALF_UP on the exact ratio, done in integer arithmetic
    (``(2*f*10^s*n + d) div (2*d)``), so it cannot depend on how a double
    quotient happens to fall at a .xx5 boundary (engines disagree there). The
    products are decimals, so no sum that a long can hold overflows in them.
    """
    n = numer.cast("decimal(20,0)")
    d = F.nullif(denom.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    units = F.call_function("div", n * F.lit(2 * factor * 10**scale) + d, d * F.lit(2))
    return units.cast("double") / F.lit(float(10**scale))


def ratio_pct(numer: Column, denom: Column) -> Column:
    """``round(100 * numer / denom, 2)`` (HALF_UP, exact), null when ``denom`` is 0."""
    return half_up_ratio(numer, denom, factor=100)


def whole_seconds(minutes: str | Column) -> Column:
    """Recover the integer seconds behind a whole-second duration in minutes
    (``s / 60.0`` is within an ulp of ``s / 60``, so ``round(m * 60)`` is ``s``)."""
    return F.round(_c(minutes) * 60).cast("long")


def mean_minutes(sum_seconds: Column, count: Column, scale: int = 2) -> Column:
    """Exact HALF_UP mean in minutes of whole-second durations, from the sum of
    their seconds and their count (non-negative durations)."""
    return half_up_ratio(sum_seconds, count * 60, scale=scale)
