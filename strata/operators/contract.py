"""Contract enforcement (K8): the NOT NULL and VARCHAR(n) limits a warehouse
applies at load, checked from ``StructField`` nullability and metadata. A
VARCHAR(n) holds n bytes of UTF-8, as the warehouse counts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def contract_checks(contract: T.StructType) -> list[tuple[str, str, int | None, Column]]:
    """``(column, check, limit, ok_predicate)`` for every constraint."""
    out = []
    for f in contract.fields:
        c = F.col(f"`{f.name}`")
        if not f.nullable:
            out.append((f.name, "not_null", None, c.isNotNull()))
        n = (f.metadata or {}).get("max_length")
        if n:
            out.append((f.name, "max_length", int(n), c.isNull() | (F.octet_length(c) <= F.lit(n))))
    return out


def enforce_contract(df: DataFrame, contract: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Split into (conforming rows, violating rows + ``violations`` text)."""
    checks = contract_checks(contract)
    ok = F.lit(True)
    for *_, pred in checks:
        ok = ok & pred
    reasons = F.concat_ws(
        "; ",
        *[F.when(~pred, F.lit(f"{name} {check}" + (f" {n}" if n else ""))) for name, check, n, pred in checks],
    )
    return df.filter(ok), df.filter(~ok).withColumn("violations", reasons)


def contract_report(df: DataFrame, contract: T.StructType, table: str) -> DataFrame:
    """One row per constraint with its violation count, from ONE aggregate."""
    checks = contract_checks(contract)
    wide = df.agg(*[F.count(F.when(~pred, F.lit(1))).alias(f"_v{i}") for i, (*_, pred) in enumerate(checks)])
    rows = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(name).alias("column_name"),
            F.lit(check).alias("check_name"),
            F.lit(n).cast("int").alias("limit_value"),
            F.col(f"_v{i}").alias("violations"),
        )
        for i, (name, check, n, _) in enumerate(checks)
    ]
    return wide.select(F.inline(F.array(*rows)))
