"""Every registered query against its DuckDB oracle on the smallest tables,
plus plan properties that must hold for all of them."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from strata.plans.oracle_registry import ORACLE
from strata.plans.registry import REGISTRY
from tests.conftest import SF001

# The corpus operators have their own tests (tests/llm), with Python workers allowed.
TABLES = ["events", "nation", "region"]
NAMES = sorted(REGISTRY)


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), "" if x is None else x) for x in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def test_contract_keys_match():
    assert set(REGISTRY) == set(ORACLE)
    assert set(REGISTRY) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["pickup_zone", "dropoff_zone", "trips", "avg_minutes"]
    assert df.count() >= 0


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE",
                 "string": "VARCHAR", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = REGISTRY[name](spark, SF001)
    got = sorted([tuple(_norm(x) for x in r) for r in df.collect()], key=_key)
    rel = duck.sql(ORACLE[name])
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    for f in df.schema.fields:  # same column types as the oracle
        assert SPARK_TO_DUCK.get(f.dataType.simpleString()) == types[f.name], (name, f.name)
    res = duck.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in df.columns]
    want = sorted([tuple(_norm(r[i]) for i in order) for r in res.fetchall()], key=_key)
    assert got == want


BANNED = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct",
          "BroadcastNestedLoopJoin", "FlatMapGroupsInPandas")


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_python_udf_or_cross_join(spark, name):
    plan = REGISTRY[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    for word in BANNED:
        assert word not in plan, f"{name}: {word}"


RUN_LOG_QUERIES = {"execution_health", "execution_time", "job_metrics"}


@pytest.mark.parametrize("name", NAMES)
def test_events_scan_is_pruned(spark, name):
    """Only the run-log queries use events.props; every other query's scan of
    events must leave that column out (column pruning reaches the scan)."""
    plan = REGISTRY[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "events.parquet" in line]
    for line in scans:
        schema = line.split("ReadSchema: ")[-1]
        if name not in RUN_LOG_QUERIES:
            assert "props" not in schema, name
