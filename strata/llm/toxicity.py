"""Toxicity by compression distance.

Two zstandard dictionaries of equal size are learned from labelled text.  Both end
in the same body of ordinary language; in front of it one holds more ordinary words
and the other the segments that recur in toxic text but hardly in ordinary text.  A
window of words that compresses to fewer bytes under the toxic dictionary shares
segments with toxic text: as the dictionaries agree on everything else, the
difference of the two compressed lengths measures just that.  Windows of a whole
text give its largest and typical differences and the share of windows beyond two
thresholds, which a logistic calibration turns into a score.

The dictionaries and the calibration are fitted on a bounded sample of labelled
rows (``SAMPLE`` and ``SAMPLE_CHARS``); every text is scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import common

WINDOW_WORDS = 24
SAMPLE = 1200  # labelled rows of each class that the classifier is fitted on, at most
SAMPLE_CHARS = 10_000  # longer texts are left out of that sample, never cut
BODY_BYTES = 49_000
FRONT_BYTES = 12_000
LENGTHS = (4, 5, 6)  # characters of the segments that are counted


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the intercept

    def score(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(
        3,
        source_size=128,
        dict_size=len(content),
        min_match=4,
        strategy=zstandard.STRATEGY_LAZY2,
        window_log=17,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    return zstandard.ZstdCompressor(dict_data=words, compression_params=params)


def windows(text: str, size: int = WINDOW_WORDS) -> list[bytes]:
    """Whole text, lower-cased, in windows of ``size`` words; one empty window if none."""
    w = text.lower().split()
    return [f" {' '.join(w[i : i + size])} ".encode() for i in range(0, len(w), size)] or [b""]


def features(text: str, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> list[float]:
    each = windows(text)
    less = sorted((len(ordinary.compress(x)) - len(toxic.compress(x)) for x in each), reverse=True)
    n = len(less)
    two, three = sum(d >= 2 for d in less), sum(d >= 3 for d in less)
    return [
        less[0],
        sum(less[:3]) / min(3, n),
        sum(less) / n,
        two / n,
        three / n,
        math.log1p(three),
        math.log1p(n),
    ]


# --- learning ------------------------------------------------------------------
def _segments(text: str) -> set[str]:
    out: set[str] = set()
    for word in set(text.lower().split()):
        word = f" {word} "
        for n in LENGTHS:
            out.update(word[i : i + n] for i in range(len(word) - n + 1))
    return out


def _marked(word: str, telling: set[str]) -> list[str]:
    """The stretches of a word that telling segments cover."""
    word = f" {word} "
    hit = bytearray(len(word))
    for n in LENGTHS:
        for i in range(len(word) - n + 1):
            if word[i : i + n] in telling:
                hit[i : i + n] = b"\1" * n
    return [s for s in "".join(c if h else "\0" for c, h in zip(word, hit)).split("\0") if s]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit(texts: list[str], labels: list[int], odds_of_toxic: float | None = None) -> Model | None:
    """Dictionaries and calibration of a sample; None unless both classes are
    there.  ``odds_of_toxic`` are the odds among all labelled rows, to which the
    calibration on the sample is shifted."""
    toxic = [t for t, y in zip(texts, labels) if y == 1]
    ordinary = [t for t, y in zip(texts, labels) if y == 0]
    if not toxic or not ordinary:
        return None
    with_it, without = Counter(), Counter()
    for t in toxic:
        with_it.update(_segments(t))
    least = min(max(3, round(len(toxic) * 0.012)), max(1, len(toxic) // 2))
    kept = {s for s, n in with_it.items() if n >= least}
    for t in ordinary:
        without.update(_segments(t) & kept)
    odds = {
        s: math.log((with_it[s] + 0.5) / (len(toxic) + 1)) - math.log((without[s] + 0.5) / (len(ordinary) + 1))
        for s in kept
    }
    telling = {s for s, v in odds.items() if v > 3.5}
    marked = Counter(s for t in toxic for w in set(t.lower().split()) for s in _marked(w, telling))
    front = "".join(s for s, _ in sorted(marked.items(), key=lambda x: (x[1], x[0]))).encode()[-FRONT_BYTES:]
    common_words = Counter(w for t in ordinary for w in t.lower().split())
    ranked = sorted(common_words.items(), key=lambda x: (x[1], x[0]))
    body = f" {' '.join(w for w, _ in ranked)} ".encode()
    pad = body[: max(0, len(body) - BODY_BYTES)][-len(front) :] if front else b""
    pad = pad.rjust(len(front), b" ")
    body = body[-BODY_BYTES:]
    model = Model(pad + body, front + body, np.zeros(1), np.ones(1), np.zeros(2))
    one, two = compressor(model.ordinary), compressor(model.toxic)
    x = np.array([features(t, one, two) for t in texts], float)
    mean, scale, weights = _logistic(x, np.array(labels, float))
    if odds_of_toxic:
        weights[-1] += math.log(odds_of_toxic) - math.log(len(toxic) / len(ordinary))
    return Model(model.ordinary, model.toxic, mean, scale, weights)


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on labelled rows with crc32(doc_id) mod 5 other than 0.

    Of each class at most ``SAMPLE`` rows of at most ``SAMPLE_CHARS`` characters,
    those with the smallest hash of their doc_id, come to the driver.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    text = docs["text"].cast("string")
    sizes = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.length(text).alias("n"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    odds = counts.get(1, 0) / counts[0] if counts.get(0) else None
    fits = sizes.filter(F.col("n").between(1, SAMPLE_CHARS)).join(known.distinct(), "doc_id")
    picked = [
        fits.filter(F.col("y") == y).select("doc_id", "y").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        for y in (0, 1)
    ]
    ids = picked[0].unionByName(picked[1])  # 2 * SAMPLE rows of two numbers at most
    rows = (
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
        .filter(F.length("text").between(1, SAMPLE_CHARS))
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))  # of rows that share a doc_id, one
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["y"], r["text"]))
    return fit([r["text"] for r in rows], [r["y"] for r in rows], odds)


# --- scoring -------------------------------------------------------------------
def score_column(df: DataFrame, model: Model | None, name: str, text: str) -> DataFrame:
    """``df`` with the score of its string column ``text`` as ``name`` in its place."""
    if model is None:
        return df.withColumn(name, F.lit(0.0)).drop(text)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one, two = compressor(model.ordinary), compressor(model.toxic)
        for texts in batches:
            rows = [features(t or "", one, two) for t in texts.to_pylist()]
            x = np.array(rows, float).reshape(len(rows), -1)
            yield pa.array(model.score(x) if len(rows) else np.zeros(0), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, "double")
    return df.withColumn(name, udf(F.col(text))).drop(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out (crc32 of the doc_id as text is a
    multiple of 5; false for a null doc_id), score and predicted.

    Null and empty texts are scored as one empty window; without toxic or without
    ordinary labels every score is 0.  Repeated rows get equal scores; an empty
    table gives no rows.  Of the documents doc_id and text are read, of the labels
    doc_id and toxic, and the score depends on the text alone.
    """
    common.prepare(docs.sparkSession)
    model = learn(docs, labels)
    doc_id = docs["doc_id"].cast("long")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    held_out = F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
    rows = docs.select(doc_id.alias("doc_id"), held_out.alias("held_out"), text.alias("text"))
    return score_column(rows, model, "score", "text").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns kept.  Null and empty
    texts are scored as one empty window, rows with equal texts go or stay together,
    and without toxic or without ordinary labels, or on an empty table, none goes."""
    common.prepare(docs.sparkSession)
    model = learn(docs, labels)
    text, score = common.fresh(docs, "scored_text", "score")
    marked = docs.withColumn(text, F.coalesce(docs["text"].cast("string"), F.lit("")))
    scored = score_column(marked, model, score, text)
    return scored.filter(F.col(score) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op6: toxicity of all documents."""
    return toxicity_scores(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))
