"""Language identification of web pages by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior per page:

* its visible text: naive Bayes over hashed byte trigrams, flattened by a
  temperature because neighbouring trigrams are not independent;
* the language its markup declares: P(declared | language), estimated from all
  pages by grouped aggregation of the text posteriors;
* its address suffix and its host: a prior smoothed hierarchically, where a host's
  soft counts lean on its site's, those on its suffix's, those on the whole
  corpus's.  A page's own contribution is taken out of each level first, so no
  evidence counts twice.

The trigram model knows every labelled language and is fitted on a bounded sample of
each one's documents (``SAMPLE``, ``SAMPLE_CHARS``); all pages are scored whole and all
counts are over all pages, as two-phase aggregates.  Posteriors are arrays in the order
of the languages.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm import common

SAMPLE = 300  # labelled documents of a language that the trigram model is fitted on
SAMPLE_CHARS = 10_000  # longer texts are left out of that sample, never cut; a language without shorter has one
BUCKETS = 1 << 14
TEMPERATURE = 12.0
SMOOTHING = 4.0  # pages that a level's parent counts for

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|template|noscript)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # (BUCKETS, languages): log P(trigram | language)


def visible(page: str | None) -> str:
    """What a reader sees of a page, blanks squeezed."""
    return " ".join(markup.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or ""))).split())


def _trigrams(text: str) -> np.ndarray:
    x = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    h = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - 14)).astype(np.int64)


def learn(docs: DataFrame) -> Model | None:
    """Fit the trigram model; None without labelled texts."""
    text = docs["text"].cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].alias("lang"), F.length(text).alias("n"))
    rows = rows.filter(F.col("lang").isNotNull() & (F.col("n") >= 1))
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not names:
        return None
    longer = F.col("n") > SAMPLE_CHARS
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(longer, F.xxhash64("doc_id"), "doc_id"))
    ids = rows.withColumn("rank", rank).filter((F.col("rank") <= SAMPLE) & (~longer | (F.col("rank") == 1)))
    ids = ids.select("doc_id", "lang")  # SAMPLE rows a language at most
    sample = (
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].alias("lang"), text.alias("text"))
        .filter(F.length("text") >= 1)
        .join(F.broadcast(ids), ["doc_id", "lang"])
        .select("lang", "text")
    )
    found = sample.mapInArrow(_counted(names), "k long, bucket long, n long")
    found = found.groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((BUCKETS, len(names)), 0.5)
    counts[found["bucket"].to_numpy(), found["k"].to_numpy()] += found["n"].to_numpy()
    return Model(tuple(names), np.log(counts / counts.sum(axis=0)).astype(np.float32))


def _counted(names: list[str]):
    """Rows (k, bucket, n): the trigrams of the texts of language k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {name: k for k, name in enumerate(names)}
        for batch in batches:
            for name, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                n = np.bincount(_trigrams(text), minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield common.rows("k bucket n", np.full(len(at), of[name]), at, n[at])

    return run


def _text_posterior(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(model.languages)))
            for k, page in enumerate(batch["html"].to_pylist()):
                n = np.bincount(_trigrams(visible(page)), minlength=BUCKETS)
                at = np.flatnonzero(n)
                if len(at):
                    out[k] = n[at] @ model.weights[at].astype(np.float64) / TEMPERATURE
            out -= out.max(axis=1, keepdims=True) if len(out) else 0
            out = np.exp(out)
            out /= out.sum(axis=1, keepdims=True)
            ends = pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32())
            t = pa.ListArray.from_arrays(ends, pa.array(out.ravel()))
            kept = ("page_id", "declared", "host", "site", "suffix")
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), t], names=[*kept, "t"])

    return run


def _fused(languages: tuple[str, ...], whole: np.ndarray):
    """The posterior of each page from its own values and the totals of its keys."""
    shares = (whole + 1.0) / (whole + 1.0).sum()

    def best(p: np.ndarray) -> list[pa.Array]:
        at = p.argmax(axis=1)
        sure = p[np.arange(len(p)), at] / p.sum(axis=1)
        return [pa.array([languages[k] for k in at], pa.string()), pa.array(sure)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, d, x, s, h = (
                batch[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(languages)) for c in "tdxsh"
            )
            prior = shares[None, :]
            for level in (x, s, h):  # suffix, then site, then host lean on the level above
                own = np.maximum(level - t, 0.0)
                prior = (own + SMOOTHING * prior) / (own.sum(axis=1, keepdims=True) + SMOOTHING)
            # P(declared | language), every language's own declarations smoothed by one page
            told = (np.maximum(d - t, 0.0) + SMOOTHING / len(languages)) / (whole + SMOOTHING)
            told[np.array([c == "" for c in batch["declared"].to_pylist()], bool)] = 1.0
            columns = [batch["page_id"], *best(t * told * prior), *best(t), batch["declared"], batch["host"]]
            names = ["page_id", "lang", "confidence", "text_lang", "text_confidence", "declared", "host"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _address(pages: DataFrame) -> list[Column]:
    """Declared language, host, site (its last two labels) and suffix (the last)."""
    page, url = F.coalesce(pages["html"].cast("string"), F.lit("")), F.coalesce(pages["url"].cast("string"), F.lit(""))
    declared = F.lower(F.regexp_extract(page, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return [
        declared.alias("declared"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("site"),
        F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"),
    ]


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page: page_id, lang, confidence (its posterior), text_lang and
    text_confidence (from the text alone), declared and host ('' if there is none).

    A page without visible text (null or empty html too) has a flat likelihood and
    goes by its other evidence; without any it gets the corpus's most frequent
    language.  Ties go to the first language in order.  A missing or odd url counts
    as one host ''.  Repeated rows are pages of their own.  Without labelled
    documents lang is null and confidence 0; an empty table gives no rows.
    """
    common.prepare(pages.sparkSession)
    model = learn(docs)
    page_id = pages["page_id"].cast("long").alias("page_id")
    if model is None:
        return pages.select(
            page_id,
            F.lit(None).cast("string").alias("lang"),
            F.lit(0.0).alias("confidence"),
            F.lit(None).cast("string").alias("text_lang"),
            F.lit(0.0).alias("text_confidence"),
            *_address(pages)[:2],
        )
    rows = pages.select(page_id, pages["html"].cast("string").alias("html"), *_address(pages))
    kinds = "page_id long, declared string, host string, site string, suffix string, t array<double>"
    rows = common.materialize(rows.mapInArrow(_text_posterior(model), kinds), "evidence")

    def totals(name: str, *keys: str) -> DataFrame:
        each = rows.select(*keys, F.posexplode("t").alias("k", "v")).groupBy(*keys, "k").agg(F.sum("v").alias("v"))
        sums = F.array_sort(F.collect_list(F.struct("k", "v")))
        return common.materialize(each.groupBy(*keys).agg(sums.getField("v").alias(name)), name)

    whole = np.array(totals("g").first()["g"] or [0.0] * len(model.languages))  # one row
    fused = rows
    for name, key in (("d", "declared"), ("x", "suffix"), ("s", "site"), ("h", "host")):
        fused = fused.join(totals(name, key), key)
    return fused.select("page_id", "declared", "host", *"tdxsh").mapInArrow(
        _fused(model.languages, whole),
        "page_id long, lang string, confidence double, text_lang string, text_confidence double,"
        " declared string, host string",
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op2: languages of all pages."""
    return identify(common.table(spark, sf_dir, "pages"), common.documents(spark, sf_dir))
