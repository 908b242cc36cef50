"""Column-name normalisation and lenient type casts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import column_key, lenient_cast


class ColumnNameClash(ValueError):
    """Two source columns map to the same canonical name."""


def normalize_columns(df: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Rename every column to its canonical form in one projection.

    Fails early when two columns collapse to one name (a plain rename would
    succeed and only break later with an ambiguous reference).
    """
    names = [column_key(c, aliases) for c in df.columns]
    seen: dict[str, str] = {}
    for original, new in zip(df.columns, names):
        if new in seen:
            raise ColumnNameClash(
                f"columns {seen[new]!r} and {original!r} both normalise to {new!r}"
            )
        seen[new] = original
    if names == df.columns:
        return df
    return df.toDF(*names)


def cast_columns(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    """Cast the named columns leniently (bad text -> null). Columns absent
    from the frame are left alone; other columns flow through unchanged."""
    types = {f.name: f.dataType for f in df.schema.fields}
    present = {c: t for c, t in casts.items() if c in types}
    if not present:
        return df
    return df.withColumns(
        {c: lenient_cast(F.col(c), types[c], t).alias(c) for c, t in present.items()}
    )
