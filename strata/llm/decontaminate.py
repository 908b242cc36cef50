"""Benchmark decontamination: containment search of short items in long documents,
in Spark's own operators only.

Items are partitioned by size: the partition of sizes [2**k, 2**(k+1)) gives each
of its items a bottom-m MinHash sketch, its m smallest shingle hashes, with m one
more than the most shingles that an item of the partition may lack.  An item of n
shingles that may lack l of them is a candidate of each document that holds m - l of
its sketch: a document that contains the item to the threshold always does, whatever
its length, so none is missed.  Only the sketches are searched for in all documents;
candidates are then verified by exact containment, joining their items' shingles with
the distinct shingles of the candidate documents alone.

The sketches have a row per sketched shingle.  They are broadcast only below a counted
number of rows; beyond it the shingles of documents and sketches meet in a shuffled
join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm import common

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 500_000  # 40 bytes each: at most 20 MB


def words(text: Column) -> Column:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+``; none for null or blank text."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), common.WHITE, " "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def _shingles(w: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words of the array column ``w``."""
    at = F.sequence(F.lit(0), F.size(w) - size)
    hashed = F.transform(at, lambda i: F.xxhash64(*(F.get(F.col(w), i + k) for k in range(size))))
    return F.when(F.size(w) >= size, hashed).otherwise(F.array().cast("array<long>"))


def item_index(items: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(item_id, size, hash, n_shingles, sketched, need): an item's distinct shingles of
    ``least(shingle, its words)`` words, which of them are in its sketch, and how many
    of the sketch a document that contains the item holds at least."""
    item = items.select(items["item_id"].cast("long").alias("item_id"), words(items["text"]).alias("w"))
    item = item.filter(F.size("w") > 0)
    parts = [
        item.filter((F.size("w") >= size) if size == shingle else (F.size("w") == size)).select(
            "item_id", F.lit(size).alias("size"), F.explode(_shingles("w", size)).alias("hash")
        )
        for size in range(1, shingle + 1)
    ]
    distinct = reduce(DataFrame.unionByName, parts).distinct()
    own = Window.partitionBy("item_id", "size")
    upper = F.pow(F.lit(2.0), F.floor(F.log2("n_shingles")) + 1) - 1  # largest size of the partition
    lacking = lambda n: F.floor(F.lit(1.0 - threshold) * n + F.lit(1e-9))
    sketch = F.least(F.col("n_shingles"), lacking(upper) + 1)
    return (
        distinct.withColumn("n_shingles", F.count(F.lit(1)).over(own))
        .withColumn("rank", F.row_number().over(own.orderBy(F.xxhash64("hash", F.lit(7)), "hash")))
        .withColumn("sketched", F.col("rank") <= sketch)
        .withColumn("need", F.greatest(F.lit(1), sketch - lacking(F.col("n_shingles"))))
        .select("item_id", "size", "hash", "n_shingles", "sketched", "need")
    )


def _exploded(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows``' other columns with (size, hash) of every shingle of their words ``w``."""
    other = [c for c in rows.columns if c != "w"]
    return reduce(
        DataFrame.unionByName,
        [rows.select(*other, F.lit(n).alias("size"), F.explode(_shingles("w", n)).alias("hash")) for n in sizes],
    )


def candidates(docs: DataFrame, index: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """Pairs (did, th, doc_id, item_id, size, n_shingles) whose document holds enough of
    the item's sketch."""
    sketches = index.filter("sketched").select("item_id", "size", "hash", "n_shingles", "need")
    rows = common.keyed(docs, words(docs["text"]).alias("w")).select("doc_id", "did", "th", "w")
    return (
        _exploded(rows, sizes)
        .join(F.broadcast(sketches) if small else sketches, ["size", "hash"])
        .groupBy("did", "th", "doc_id", "item_id", "size", "n_shingles", "need")
        .agg(F.countDistinct("hash").alias("held"))
        .filter("held >= need")
        .drop("held", "need")
    )


def verified(docs: DataFrame, index: DataFrame, pairs: DataFrame, sizes: list[int]) -> DataFrame:
    """``pairs`` with n_found, the number of the item's distinct shingles in the document."""
    item = index.select(F.col("item_id").alias("of"), F.col("size").alias("of_size"), "hash")
    same = pairs["item_id"].eqNullSafe(item["of"]) & (pairs["size"] == item["of_size"])
    wanted = pairs.join(item, same).drop("of", "of_size")
    rows = common.keyed(docs).join(pairs.select("did", "th").distinct(), ["did", "th"], "left_semi")
    rows = rows.select("did", "th", words(F.col("text")).alias("w"))
    held = _exploded(rows, sizes).distinct()
    return (
        wanted.join(held, ["did", "th", "size", "hash"])
        .groupBy("did", "th", "doc_id", "item_id", "size", "n_shingles")
        .agg(F.count(F.lit(1)).alias("n_found"))
    )


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE_WORDS
) -> DataFrame:
    """Pairs of a document and a benchmark item of whose distinct shingles it holds
    the share ``threshold`` or more: doc_id, item_id, n_shingles, n_found,
    containment, and the internal key (did, th).

    Words are lower-cased and parted by ASCII white space.  An item of fewer than
    ``shingle`` words is one shingle of all its words.  Null or blank texts, in
    either table, match nothing; equal items and repeated documents are pairs of
    their own, but rows that repeat doc_id and text count once; empty tables give
    no rows.  Of the items item_id and text are read, of the documents doc_id and
    text.
    """
    index = common.materialize(item_index(items, threshold, shingle), "items")
    stats = {r["size"]: r["n"] for r in index.groupBy("size").agg(F.count(F.when(F.col("sketched"), 1)).alias("n")).collect()}
    sizes = sorted(stats) or [shingle]
    pairs = common.materialize(candidates(docs, index, sizes, sum(stats.values()) <= BROADCAST_ROWS), "candidates")
    return (
        verified(docs, index, pairs, sizes)
        .withColumn("containment", F.col("n_found") / F.col("n_shingles"))
        .filter(F.col("containment") >= threshold)
        .select("did", "th", "doc_id", "item_id", "n_shingles", "n_found", "containment")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept."""
    bad = contaminated(docs, items).select(F.col("did").alias("__did"), F.col("th").alias("__th")).distinct()
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    did = F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(text))
    th = F.shiftrightunsigned(F.xxhash64(text), 40)
    return docs.join(bad, (did == bad["__did"]) & (th == bad["__th"]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: benchmark items contained in any document."""
    pairs = contaminated(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))
    return pairs.drop("did", "th")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark
), i AS (
  SELECT DISTINCT item_id, list_aggregate(w[k:k + 4], 'string_agg', ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM iw WHERE len(w) >= 5)
), n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY 1),
d AS (
  SELECT DISTINCT doc_id, list_aggregate(w[k:k + 4], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM dw WHERE len(w) >= 5)
), f AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN i USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
FROM f JOIN n USING (item_id) WHERE n_found / n_shingles >= 0.8
"""
