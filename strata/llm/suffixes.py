"""Suffix-array dedup of bytes: positions named at growing lengths until unique
or as long as the threshold.

Prefix doubling ranks positions by ever longer prefixes and drops those that have
become unique.  Dense integer ranks of all byte positions would shuffle some forty
bytes for every byte of text in each round, so here a round's rank is the 128-bit
name of the prefix itself, computed where the text is, and only sampled positions
have rows (see :mod:`strata.llm.repeats`): Spark groups and counts names of
``window - 127`` bytes, then ``window - 15``, then the whole window, and each
round keeps only positions whose rank is still shared and not yet settled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import common
from strata.llm.repeats import Unit, by_content, covered, repeated

WINDOW_BYTES = 400


def byte_unit(window: int = WINDOW_BYTES) -> Unit:
    gram = max(1, min(8, window // 4))
    span = max(1, min(128, window // 3))
    blocks = tuple(b for b in (16, 4) if b * 4 <= span) + ((1,) if span > 1 else ())
    return Unit(words=False, window=window, span=span, gram=gram, blocks=blocks)


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = common.utf8(batch["text"])
            at, n = common.lists(batch["at"])
            dd, _ = common.lists(batch["dd"])
            out = []
            for k in range(len(ends) - 1):
                lo, hi = covered(at[n[k] : n[k + 1]], dd[n[k] : n[k + 1]], window)
                raw = data[ends[k] : ends[k + 1]]
                kept = hashlib.sha256()
                for x, y in zip(np.concatenate(([0], hi)), np.concatenate((lo, [len(raw)]))):
                    kept.update(raw[x:y])
                out.append((int((hi - lo).sum()), len(lo), lo.tolist(), hi.tolist(), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["did"],
                    batch["th"],
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.int64()),
                    pa.array([x[2] for x in out], pa.list_(pa.int64())),
                    pa.array([x[3] for x in out], pa.list_(pa.int64())),
                    pa.array([x[4] for x in out], pa.string()),
                ],
                names=["did", "th", "n_removed", "n_spans", "span_start", "span_end", "kept_sha256"],
            )

    return run


def duplicate_byte_spans(docs: DataFrame, window: int = WINDOW_BYTES) -> DataFrame:
    """Every byte covered by a ``window``-byte string that starts at two or more
    places of the corpus (of the same document included).

    ``docs`` needs doc_id and text; other columns are not read.  Returns one row
    per input row: doc_id, n_bytes, n_removed, n_spans, span_start and span_end
    (byte offsets of the maximal removed runs, in order) and kept_sha256.

    A null text is empty; empty or short texts and empty tables lose nothing.
    Rows that repeat another's text, under any doc_id or none, count as another
    place, so all of them lose their bytes.  Matches never cross documents.
    """
    common.prepare(docs.sparkSession)
    rows = by_content(common.keyed(docs))
    texts, runs = repeated(rows, byte_unit(window))
    spans = texts.join(runs, ["did", "th"]).mapInArrow(
        _cut(window),
        "did long, th long, n_removed long, n_spans long, span_start array<long>, span_end array<long>, kept_sha256 string",
    )
    base = rows.select(
        "doc_id", "did", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")
    )
    none = F.array().cast("array<long>")
    return base.join(spans, ["did", "th"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        F.coalesce("span_start", none).alias("span_start"),
        F.coalesce("span_end", none).alias("span_end"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op9: repeated 400-byte strings of all documents."""
    return duplicate_byte_spans(common.documents(spark, sf_dir)).drop("span_start", "span_end")
