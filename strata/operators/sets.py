"""Set-style combinations."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import ratio_pct


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """UNION ALL of one ``count(*)`` per table, labelled with its name."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def completeness_profile(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """One row per column: non-null rows, all rows and the percentage.

    All counts come from a single aggregate (one scan); the wide row is then
    turned into one row per field with ``inline(array(struct ...))``. Each
    struct uses the same field names so the array has one element type."""
    aggs = [F.count(F.lit(1)).alias("_total")]
    aggs += [F.count(col).alias(f"_nn_{i}") for i, col in enumerate(fields.values())]
    wide = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(label).alias("field_name"),
            F.col(f"_nn_{i}").alias("non_null_rows"),
            F.col("_total").alias("total_rows"),
            ratio_pct(F.col(f"_nn_{i}"), F.col("_total")).alias("completeness_pct"),
        )
        for i, label in enumerate(fields)
    ]
    return wide.select(F.inline(F.array(*rows)))
