"""Exact dedup by content sort, in Spark's own operators only.

Copies are first folded inside each map task and salt (a two-phase aggregate keyed
by the normalised text itself), so a text that a third of all rows hold sends a
few rows on.  Sampled splitters then range-partition the distinct texts by their
first characters and a hash, so the sample that reaches the driver is of short keys
whatever the length of the texts; each partition is sorted externally by key and
whole text, which places equals side by side, and a window over neighbouring equal
texts (full comparisons) keeps the smallest identifier.
The decision travels back to the rows by the text's SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm import common

#: Partial rows of one text per map task: bounds what meets in one sort group.
SALTS = 16
#: Leading characters of a text in its sort key; texts that share them part by hash.
HEAD = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), common.WHITE, " ")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), normalised(docs["text"]).alias("norm"))


def text_classes(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id, group_size."""
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(SALTS)).alias("salt")
    folded = (
        _rows(docs).groupBy("norm", salt).agg(F.min("doc_id").alias("lo"), F.count(F.lit(1)).alias("n"))
    )
    keys = folded.withColumns({"head": F.substring("norm", 1, HEAD), "hash": F.xxhash64("norm")})
    ranged = keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "head", "hash")
    equal = Window.partitionBy("head", "hash", "norm")
    first = F.row_number().over(equal.orderBy(F.col("lo").asc_nulls_last(), "salt"))
    return (
        ranged.select("norm", F.col("lo").alias("keep_id"), F.sum("n").over(equal).alias("group_size"), first.alias("k"))
        .filter("k = 1")
        .select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after each run of ASCII white space became one
    space; null counts as empty.  ``keep_id`` is the smallest doc_id of the group
    (null if none of its rows has one) and ``kept`` says whether this row has it;
    rows that repeat the kept doc_id and text are the same document and all say
    true.  An empty table gives no rows.  Other columns are not read.
    """
    ours = _rows(docs).select("doc_id", F.sha2("norm", 256).alias("text_sha256"))
    return ours.join(text_classes(docs), "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group, all columns kept.

    A row that repeats both doc_id and text of the kept row goes too.  The join is
    on text and identifier together, so a hot group's rows spread over all tasks.
    """
    names = dict(zip(("sha", "id", "keep", "k", "of"), common.fresh(docs, "sha", "own_id", "keep", "k", "of")))
    marked = docs.withColumns(
        {names["sha"]: F.sha2(normalised(docs["text"]), 256), names["id"]: docs["doc_id"].cast("long")}
    )
    keep = text_classes(docs).select(F.col("text_sha256").alias(names["of"]), F.col("keep_id").alias(names["keep"]))
    kept = marked.join(
        keep, (marked[names["sha"]] == keep[names["of"]]) & marked[names["id"]].eqNullSafe(keep[names["keep"]])
    )
    one = Window.partitionBy(names["sha"], names["id"]).orderBy(names["keep"])
    return kept.withColumn(names["k"], F.row_number().over(one)).filter(F.col(names["k"]) == 1).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op5: groups of equal texts among all documents."""
    return exact_groups(common.documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256
  FROM d)
"""
