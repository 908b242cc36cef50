"""Helpers shared by the corpus operators.

Documents reach every operator through :func:`keyed`: only the needed columns
are read, under fixed internal names, so extra or clashing columns of the input
never matter.  A document's internal key is ``(did, th)``: ``did`` is its
``doc_id`` (a hash of the text where that is null) and ``th`` are 24 bits of the
text's hash, which tell apart rows that repeat a ``doc_id`` with another text.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import shared_dir

#: Rows and bytes of one Arrow batch handed to a Python worker: bounds the
#: worker's memory whatever the length of the texts.
ARROW_ROWS = 1024
ARROW_BYTES = 8 << 20

WHITE = r"[\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Give Python workers this package, and bound the batches that they get."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def _ship(spark: SparkSession) -> None:
    """Spark copies the package to every worker, which need not have it installed."""
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="strata-ship-")) / "strata_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """``docs`` as (doc_id, did, th, text, *more); a null text is empty."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    doc_id = docs["doc_id"].cast("long")
    return docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.xxhash64(text)).alias("did"),
        F.shiftrightunsigned(F.xxhash64(text), 40).alias("th"),
        text.alias("text"),
        *more,
    )


# --- tables that cut the lineage ---------------------------------------------
_TABLES: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back: what
    follows survives lost executors without redoing what came before.  With ``few``,
    what many tasks leave over is gathered into files of the advisory size first:
    on a local disk Hadoop starts processes for every file that it writes."""
    if few:
        df = df.hint("rebalance")
    spark = df.sparkSession
    path = f"{shared_dir(spark, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append((spark, path))
    free_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and nothing reads any more."""
    for table in tables:
        entry = (table.sparkSession, table._written)
        if entry in _TABLES:
            _TABLES.remove(entry)
            _delete(*entry)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner drop the shuffle files of plans that nothing
    refers to any more, rather than whenever the driver's heap fills."""
    gc.collect()
    try:
        spark.sparkContext._jvm.System.gc()
    except Exception:  # pragma: no cover - Spark Connect has no JVM handle
        return


def drop_tables() -> None:
    """Delete every table that :func:`materialize` wrote in this process."""
    while _TABLES:
        spark, path = _TABLES.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; its owner cleans its folder
            return


atexit.register(drop_tables)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until none is a column of ``df`` in any spelling."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def bloom_filtered(spark: SparkSession, items: int) -> Iterator[None]:
    """While it lasts, Spark puts a Bloom filter of a join's filtered side, of about
    ``items`` keys, before the exchange of the other side.  The filter has a byte a key and
    at most 8 MB, beyond which more rows that find no partner pass; no row is lost."""
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    conf = {
        "enabled": "true",
        "creationSideThreshold": str(1 << 50),
        "applicationSideScanSizeThreshold": "0",
        "expectedNumItems": str(min(max(items, 1 << 17), 4_000_000)),
        "numBits": str(min(max(8 * items, 1 << 20), 1 << 26)),
    }
    before = {k: spark.conf.get(prefix + k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(prefix + k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(prefix + k) if v is None else spark.conf.set(prefix + k, v)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by ``keys`` to the session's shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


# --- Arrow -------------------------------------------------------------------
def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets, without copying the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list<long> column's values and its n + 1 offsets."""
    ends = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return longs(column.values)[ends[0] : ends[-1]], ends - ends[0]


def rows(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    """A batch of long columns named by ``schema``'s words."""
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names=schema.split())
