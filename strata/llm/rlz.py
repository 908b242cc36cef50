"""Substring dedup of words: windows of words that occur more than once, joined to spans.

Counting windows replaces relative Lempel-Ziv parsing: no greedy longest factor is
looked up and no factor has a reference position.  :mod:`strata.llm.repeats` counts
the names of runs of windows around positions sampled by content, cuts runs that
this does not settle down to single windows, and the repeated windows of a document
are joined here to disjoint spans, so that the spans are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import common
from strata.llm.names import word_bounds
from strata.llm.repeats import Unit, by_content, covered, repeated

WINDOW_WORDS = 35


def word_unit(window: int = WINDOW_WORDS) -> Unit:
    span = max(1, min(20, window * 4 // 7))
    blocks = ((5,) if span >= 15 else ()) + ((1,) if span > 1 else ())
    return Unit(words=True, window=window, span=span, gram=1, blocks=blocks)


def _factors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = common.utf8(batch["text"])
            first, last, words = word_bounds(data, ends)
            at, n = common.lists(batch["at"])
            dd, _ = common.lists(batch["dd"])
            out = []
            for k in range(len(ends) - 1):
                lo, hi = covered(at[n[k] : n[k + 1]], dd[n[k] : n[k + 1]], window)
                begin, end = first[words[k] : words[k + 1]], last[words[k] : words[k + 1]]
                kept, glue = hashlib.sha256(), b""
                for x, y in zip(np.concatenate(([0], hi)), np.concatenate((lo, [len(begin)]))):
                    if x < y:  # the words of a literal stretch, joined by one space
                        raw = data[begin[x] : end[y - 1]].tobytes()
                        kept.update(glue + b" ".join(raw.split()))
                        glue = b" "
                out.append((int((hi - lo).sum()), lo.tolist(), hi.tolist(), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["did"],
                    batch["th"],
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.list_(pa.int64())),
                    pa.array([x[2] for x in out], pa.list_(pa.int64())),
                    pa.array([x[3] for x in out], pa.string()),
                ],
                names=["did", "th", "n_removed", "factor_start", "factor_end", "kept_sha256"],
            )

    return run


def duplicate_factors(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Every word covered by ``window`` consecutive words that also start at
    another place of the corpus (of the same document included).

    ``docs`` needs doc_id and text; other columns are not read.  Returns one row
    per input row: doc_id, n_words, n_removed, factor_start and factor_end (word
    offsets of the removed stretches, in order) and kept_sha256.

    A null or blank text has no words; short texts and empty tables lose nothing.
    Rows that repeat another's text, under any doc_id or none, count as another
    place, so all of them lose their words.
    """
    common.prepare(docs.sparkSession)
    rows = by_content(common.keyed(docs))
    texts, runs = repeated(rows, word_unit(window))
    found = texts.join(runs, ["did", "th"]).mapInArrow(
        _factors(window),
        "did long, th long, n_removed long, factor_start array<long>, factor_end array<long>, kept_sha256 string",
    )
    joined = F.trim(F.regexp_replace("text", common.WHITE, " "))
    base = rows.select("doc_id", "did", "th", joined.alias("joined")).select(
        "doc_id",
        "did",
        "th",
        F.when(F.col("joined") == "", 0)
        .otherwise(F.length("joined") - F.length(F.replace("joined", F.lit(" "), F.lit(""))) + 1)
        .cast("long")
        .alias("n_words"),
        F.sha2("joined", 256).alias("whole"),
    )
    none = F.array().cast("array<long>")
    return base.join(found, ["did", "th"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        F.coalesce("factor_start", none).alias("factor_start"),
        F.coalesce("factor_end", none).alias("factor_end"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op1: repeated 35-word windows of all documents."""
    return duplicate_factors(common.documents(spark, sf_dir)).drop("factor_start", "factor_end")


#: The query's rows: every window named, whatever the operator skips.
ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), listed AS (
  SELECT r, list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i : i + 34], ' '))) AS wins FROM docs
), named AS (
  SELECT r, unnest(range(1, len(wins) + 1)) AS i, unnest(wins) AS win FROM listed
), twice AS (
  SELECT r, i FROM named WHERE win IN (SELECT win FROM named GROUP BY win HAVING count(*) > 1)
), each AS (
  SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs
), marked AS (
  SELECT e.r, e.i, e.word,
    max(t.i) OVER (PARTITION BY e.r ORDER BY e.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS removed
  FROM each e LEFT JOIN twice t ON e.r = t.r AND e.i = t.i
), done AS (
  SELECT r, count(*) FILTER (removed) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS kept
  FROM marked GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN done USING (r)
"""
