"""Bronze readers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.contracts import BRONZE, TRIP_ALIASES
from strata.functions.columns import column_key
from strata.functions.literals import empty_frame


def read_bronze(
    spark: SparkSession,
    path: str,
    glob: str = "*.parquet",
    *,
    schema: T.StructType | None = None,
    lineage: bool = True,
    merge_schema: bool = False,
) -> DataFrame:
    """All raw trip files under ``path`` (any depth, e.g. ``<yyyy>/<mm>/``) as one
    table; only files matching ``glob`` are read, so a CSV beside them is
    ignored. With ``lineage`` the file path of each row is added as
    ``source_file`` from the scan's hidden ``_metadata`` column."""
    reader = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("mergeSchema", str(merge_schema).lower())
    )
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path)
    return file_lineage(df) if lineage else df


# -- files that differ in spelling or types -------------------------------------------
#: Types from narrow to wide; a column that has several takes the widest, and text
#: where they have no common line.
WIDENING = (
    ("tinyint", "smallint", "int", "bigint", "double", "string"),
    ("tinyint", "smallint", "int", "bigint", "float", "double", "string"),
    ("date", "timestamp_ntz", "timestamp", "string"),
)


def widest(types: Sequence[str]) -> str:
    """The narrowest type that all of ``types`` widen to, ``string`` if none does."""
    for line in WIDENING:
        if set(types) <= set(line):
            return max(types, key=line.index)
    return types[0] if len(set(types)) == 1 else "string"


def list_files(spark: SparkSession, path: str, glob: str = "*.parquet") -> list[str]:
    """Paths of the files below ``path``, in order; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return sorted(r[0] for r in files.load(path).select("path").collect())


def schema_groups(spark: SparkSession, files: Sequence[str]) -> list[tuple[list[str], T.StructType]]:
    """Files that one schema can read, and that schema. Footers are merged by a Spark
    job over all files; only where types contradict each other is the list halved, so
    k changes of type along it cost about k log n such jobs, none of them per file."""
    if not files:
        return []
    try:
        merged = spark.read.option("mergeSchema", "true").parquet(*files).schema
        return [(list(files), merged)]
    except (PySparkException, Py4JJavaError) as error:
        if len(files) == 1 or "CANNOT_MERGE" not in str(error):
            raise
    half = len(files) // 2
    out: list[tuple[list[str], T.StructType]] = []
    for part, schema in schema_groups(spark, files[:half]) + schema_groups(spark, files[half:]):
        same = next((g for g in out if g[1] == schema), None)
        if same:
            same[0].extend(part)
        else:
            out.append((part, schema))
    return out


def read_drifting_files(
    spark: SparkSession, files: Sequence[str], aliases: Mapping[str, str] = TRIP_ALIASES, *, lineage: bool = True
) -> DataFrame:
    """Files whose columns drift in spelling, type or number as one table.

    Columns get canonical names; spellings that mean the same column are one column,
    the first of them that is not null in the order of their names; it has the
    widest of its types over all files. A column that a file lacks is null there. No
    row is lost. No files give the empty Bronze table."""
    groups = schema_groups(spark, files)
    if not groups:
        empty = empty_frame(spark, BRONZE)
        return empty.withColumn("source_file", F.lit(None).cast("string")) if lineage else empty
    types: dict[str, list[str]] = {}
    for _, schema in groups:
        for f in schema.fields:
            types.setdefault(column_key(f.name, aliases), []).append(f.dataType.simpleString())
    wide = {name: widest(of) for name, of in types.items()}
    out = None
    for part, schema in groups:
        df = spark.read.schema(schema).parquet(*part)
        of: dict[str, list[str]] = {}
        for name in sorted(schema.names):
            of.setdefault(column_key(name, aliases), []).append(name)
        cols = [
            F.coalesce(*[F.col(f"`{n}`").cast(wide[key]) for n in of[key]]).alias(key) if key in of
            else F.lit(None).cast(wide[key]).alias(key)
            for key in wide
        ]
        if lineage and "source_file" not in wide:
            cols.append(F.col("_metadata.file_path").alias("source_file"))
        out = df.select(*cols) if out is None else out.unionByName(df.select(*cols))
    return out


def read_drifting_bronze(
    spark: SparkSession, path: str, glob: str = "*.parquet", aliases: Mapping[str, str] = TRIP_ALIASES,
    *, lineage: bool = True,
) -> DataFrame:
    """:func:`read_bronze` for files that differ from each other (see above)."""
    return read_drifting_files(spark, list_files(spark, path, glob), aliases, lineage=lineage)


def file_lineage(df: DataFrame, name: str = "source_file") -> DataFrame:
    """Add the file path each row was read from.

    ``_metadata.file_path`` must be resolved on the scan itself, so call this
    directly on a file-source frame, before any join or aggregate."""
    return df.withColumn(name, F.col("_metadata.file_path"))


def or_empty(df: DataFrame, schema: T.StructType = BRONZE) -> DataFrame:
    """A read that found no files has no columns; substitute an empty frame
    with the fixed Bronze schema so later steps still resolve (S3)."""
    if df.columns:
        return df
    return empty_frame(df.sparkSession, schema)
