"""Small local frames (one row of rule counts, a commit-log entry, a run-log
entry, an empty frame of a schema).

``spark.createDataFrame`` on a Python list goes through an RDD of pickled rows,
which needs Python worker processes to run. Rows passed as a pandas frame go
through Arrow into a local relation instead (``LocalTableScan``, no Python
worker). The values are data, not literals in the plan, so plans built on top
keep the same generated code from run to run and hit the codegen cache.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_frame(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType) -> DataFrame:
    """A frame of ``rows`` (tuples in ``schema`` order) with ``schema``'s types."""
    rows = [tuple(r) for r in rows]
    if not rows:
        return empty_frame(spark, schema)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # object dtype keeps None as null (not NaN) and Python ints exact
    data = pd.DataFrame(rows, columns=schema.names, dtype=object)
    return spark.createDataFrame(data, schema)


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Zero rows with ``schema``'s column names and types."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
