"""MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes its set of distinct word shingles (as 64-bit hashes), a 128-bit
   digest of the set and a MinHash signature.  Texts with equal sets are one node from
   here on.
2. Signatures are banded; nodes that share a band are candidates.  With 40 bands
   of 6 values a pair at the threshold is missed with probability 5e-6.
3. A candidate's signatures are compared batch by batch.  After each batch the
   matches so far give the posterior of the similarity (uniform prior), and a pair
   is dropped as soon as the probability that it reaches the threshold falls below
   ``MISS``.  Survivors are verified exactly on their full sets.

Components, not pairs, are wanted, so a bucket never emits all its pairs.  In two
rounds its members are compared with one leader each, which merges what is dense.
Buckets that still hold several components are dealt to blocks; a task compares two
blocks, verifies on the sets themselves, skips what it has already connected and emits
a spanning forest of the links that it finds: fewer rows than it has members.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import common
from strata.llm.graph import components
from strata.llm.names import LIMIT, Names, mix, word_bounds, word_codes

SHINGLE_WORDS = 4
PERCENT = 80  # linked if 100 * intersection >= PERCENT * union
BANDS, VALUES = 40, 6
BATCH = 24  # signature values compared between two looks at the posterior
MISS = 1e-5
LEADER_ROUNDS = 2
BLOCK = 1024  # members of a large bucket that one task compares with as many others
BLOCK_BYTES = 32 << 20  # of their sets, about

U = np.uint64
_RANDOM = np.random.default_rng(20240607)
_MULTIPLY = _RANDOM.integers(0, 2**31, BANDS * VALUES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RANDOM.integers(0, 2**32, BANDS * VALUES).astype(np.uint32)


# --- sets and signatures -----------------------------------------------------------
def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: A-Z lower-cased, words
    parted by ASCII white space; fewer than ``size`` words are one shingle."""
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data | 32, data)
    n = len(ends) - 1
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + LIMIT, "right")) - 1)
        raw, own = data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        first, last, words = word_bounds(raw, own)
        codes = word_codes(raw, first, last)
        names = Names(codes)
        for k in range(to - at):
            lo, hi = int(words[k]), int(words[k + 1])
            if hi - lo >= size:
                begin = np.arange(lo, hi - size + 1)
                yield np.unique(names(begin, begin + size))
            elif hi > lo:
                yield names(np.array([lo]), np.array([hi]))
            else:
                yield np.zeros(0, U)
        at = to


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each of BANDS * VALUES minima; the set must not be empty."""
    x = (shingles >> U(32)).astype(np.uint32)
    least = np.full(len(_ADD), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        hashed = _MULTIPLY[:, None] * x[None, at : at + 4096] + _ADD[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _digest(s: np.ndarray) -> tuple[int, int, int]:
    if not len(s):
        return 0, 0, 0
    pair = (int(mix(x).sum(dtype=U)) for x in (s, s ^ U(0xA5A5A5A5A5A5A5A5)))
    return len(s), *(v - (v >> 63 << 64) for v in pair)


def _sketcher(size: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = common.utf8(batch["text"])
            digests, sig = [], []
            for s in shingle_sets(data, ends, size):
                digests.append(_digest(s))
                sig.append(signature(s).tobytes() if len(s) else b"")
            n, one, two = np.array(digests, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["th"], pa.array(n), pa.array(one), pa.array(two), pa.array(sig, pa.binary())],
                names=["doc_id", "th", "n", "d1", "d2", "sig"],
            )

    return sketch


def _set_maker(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(*common.utf8(batch["text"]), size)]
            yield pa.RecordBatch.from_arrays([batch["sid"], pa.array(found, pa.binary())], names=["sid", "shingles"])

    return sets


def _keys(signatures: np.ndarray) -> np.ndarray:
    """Bucket of each signature in each band."""
    sig = signatures.reshape(-1, BANDS, VALUES).astype(U)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), sig.shape[:2])
    for v in range(VALUES):
        key = mix(key * U(65599) + sig[:, :, v])
    return key


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        key = _keys(np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint16))
        yield common.rows("bucket sid", key.reshape(-1), np.repeat(common.longs(batch["sid"]), BANDS))


# --- sequential verification ---------------------------------------------------------
@lru_cache(maxsize=None)
def least_matches(share: float, miss: float) -> list[tuple[int, int]]:
    """(compared, matches) after each batch: with fewer matches the posterior
    probability of a similarity of ``share`` or more is below ``miss``."""
    s = (np.arange(2_000) + 0.5) / 2_000

    def enough(n: int, m: int) -> bool:
        log = m * np.log(s) + (n - m) * np.log1p(-s)
        like = np.exp(log - log.max())
        return bool(like[s >= share].sum() >= miss * like.sum())

    counts = range(BATCH, BANDS * VALUES + 1, BATCH)
    return [(n, bisect_left(range(n + 1), True, key=lambda m: enough(n, m))) for n in counts]


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bounds = least_matches(PERCENT / 100, MISS)
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (
            np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, BANDS * VALUES) for c in ("sa", "sb")
        )
        alive, matches, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
        for n, least in bounds:
            matches = matches + (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
            keep = matches >= least
            alive, matches, done = alive[keep], matches[keep], n
        keep = pa.array(alive)
        yield pa.RecordBatch.from_arrays([batch["a"].take(keep), batch["b"].take(keep)], names=["a", "b"])


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch["x"], batch["y"])
        keep = [k for k, (x, y) in enumerate(pairs) if _linked(*(np.frombuffer(v.as_buffer(), U) for v in (x, y)))]
        keep = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch["a"].take(keep), batch["b"].take(keep)], names=["a", "b"])


def verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    one, two = (reps.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
    likely = (
        pairs.join(one, "a")
        .join(two, "b")
        .filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))  # sizes alone can rule it out
        .select("a", "b", "sa", "sb")
        .mapInArrow(_prune, "a long, b long")
    )
    likely = common.materialize(likely, "likely", few=True)
    x, y = (sets.select(F.col("sid").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    found = likely.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")
    found = common.materialize(found, "links", few=True)
    common.discard(likely)
    return found


def _unresolved(active: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(bucket, sid, label) of buckets that hold two or more components."""
    rows = active.withColumn("label", F.col("sid"))
    if labels is not None:
        known = labels.select(F.col("node").alias("sid"), F.col("label").alias("known"))
        rows = active.join(known, "sid", "left").select("bucket", "sid", F.coalesce("known", "sid").alias("label"))
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y")
    return common.materialize(rows.join(mixed.select("bucket"), "bucket"), "rows")


def _with_leaders(rows: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of each bucket's leader and its members of other components, and the
    rows without the leaders, which have now met all the others.  Every turn orders
    the members in another way."""
    first = F.struct(F.xxhash64(F.lit(turn), "sid").alias("o"), "sid", "label")
    leaders = rows.groupBy("bucket").agg(F.min(first).alias("x"))
    leaders = common.materialize(
        leaders.select("bucket", F.col("x.sid").alias("leader"), F.col("x.label").alias("leader_label")), "leaders"
    )
    met = rows.join(leaders, "bucket")
    pairs = met.filter("label <> leader_label").select(
        F.least("leader", "sid").alias("a"), F.greatest("leader", "sid").alias("b")
    )
    return pairs.distinct(), met.filter("sid <> leader").select("bucket", "sid")


def _forest(table: pa.Table) -> pa.Table:
    """Links between two blocks of one bucket, or within one, that connect components
    not connected before.  A pair is looked at only in the first band that it shares."""
    table = table.combine_chunks()
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, BANDS * VALUES)
    sid, label, block, size = (table[c].to_numpy() for c in ("sid", "label", "block", "n"))
    shingles = [np.frombuffer(v.as_buffer(), U) for v in table["shingles"]]
    i, j = int(table["i"][0].as_py()), int(table["j"][0].as_py())
    keys = _keys(sig)
    band = int(np.flatnonzero(keys[0] == np.int64(table["bucket"][0].as_py()).astype(U))[0])
    bounds = least_matches(PERCENT / 100, MISS)
    component = label.copy()
    right = np.flatnonzero(block == j)
    links: list[tuple[int, int]] = []
    for k in np.flatnonzero(block == i):
        other = right[(sid[right] > sid[k]) if i == j else slice(None)]
        other = other[component[other] != component[k]]
        other = other[100 * np.minimum(size[other], size[k]) >= PERCENT * np.maximum(size[other], size[k])]
        other = other[~(keys[other, :band] == keys[k, :band]).any(axis=1)]
        matches, done = np.zeros(len(other), np.int64), 0
        for n, least in bounds:
            matches = matches + (sig[other, done:n] == sig[k, done:n]).sum(axis=1)
            keep = matches >= least
            other, matches, done = other[keep], matches[keep], n
        for o in other[np.argsort(-matches, kind="stable")]:
            if component[o] != component[k] and _linked(shingles[k], shingles[o]):
                links.append((int(sid[k]), int(sid[o])))
                component[component == component[o]] = component[k]
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table({"a": a, "b": b})


def _across_blocks(rows: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect what is left in each bucket."""
    members = rows.join(reps.select("sid", "n", "sig"), "sid")
    most = F.greatest(F.count(F.lit(1)) / BLOCK, 8 * F.sum("n") / BLOCK_BYTES)
    sizes = rows.join(reps.select("sid", "n"), "sid").groupBy("bucket").agg(F.ceil(most).alias("blocks"))
    sided = members.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    dealt = sided.join(sets, "sid").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "bucket",
        F.least("block", "with").cast("long").alias("i"),
        F.greatest("block", "with").cast("long").alias("j"),
        F.col("block").cast("long").alias("block"),
        "sid", "label", "n", "sig", "shingles",
    )
    links = dealt.groupBy("bucket", "i", "j").applyInArrow(_forest, "a long, b long")
    return common.materialize(links, "links", few=True)


def wanted_sets(rows: DataFrame, wanted: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(sid, shingles): the set of each row (sid, rep, rep_th, n) of ``wanted``, made again
    from the text of the row (doc_id, th, text) that has it.  Few texts are wanted, so under
    :func:`common.bloom_filtered` most of the others are left out before texts move."""
    same = (rows["doc_id"] == wanted["rep"]) & (rows["th"] == wanted["rep_th"])
    # the condition holds for all sets; Spark filters only by a side that is itself filtered
    texts = rows.join(wanted.filter("n > 0"), same).select("sid", "text")
    made = texts.mapInArrow(_set_maker(size), "sid long, shingles binary")
    return made.groupBy("sid").agg(F.first("shingles").alias("shingles"))


def near_components(docs: DataFrame, size: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(keys, reps, labels): of every row (doc_id, th, n, d1, d2), the hash of its text
    and its set's size and digest; of every distinct set of rows with a doc_id (sid,
    rep, rep_th, n, d1, d2, sig), rep being its smallest doc_id and rep_th the smallest hash
    of such a text under it; and (node, label), the smallest sid of the component, of those sids that are linked with another (None if none is)."""
    rows = common.keyed(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")
    sketches = common.materialize(
        rows.mapInArrow(_sketcher(size), "doc_id long, th long, n long, d1 long, d2 long, sig binary"), "sketches"
    )
    reps = sketches.filter("doc_id is not null and n > 0").groupBy("d1", "d2", "n").agg(
        F.min(F.struct("doc_id", "th")).alias("of"), F.first("sig").alias("sig")
    )
    reps = reps.select("d1", "d2", "n", F.col("of.doc_id").alias("rep"), F.col("of.th").alias("rep_th"), "sig")
    reps = common.materialize(reps.withColumn("sid", F.monotonically_increasing_id()), "reps")
    keys = common.materialize(sketches.drop("sig"), "keys")
    common.discard(sketches)
    banded = reps.select("sid", "sig").mapInArrow(_bands, "bucket long, sid long")
    shared = banded.groupBy("bucket").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).filter("x < y")
    active = common.materialize(banded.join(shared.select("bucket"), "bucket").distinct(), "active", few=True)
    if active.isEmpty():
        return keys, reps, None
    wanted = reps.join(active.select("sid").distinct(), "sid").select("sid", "rep", "rep_th", "n")
    wanted = common.materialize(wanted, "wanted")
    with common.bloom_filtered(rows.sparkSession, wanted.count()):
        sets = common.materialize(wanted_sets(rows, wanted, size), "sets")
    common.discard(wanted)

    labels = None
    for turn in range(LEADER_ROUNDS + 1):
        left = _unresolved(active, labels)
        common.discard(active)
        if left.isEmpty():
            break
        if turn == LEADER_ROUNDS:
            links = _across_blocks(left, reps, sets)
        else:
            pairs, rest = _with_leaders(left, turn)
            active = common.materialize(rest, "active", few=True)
            links = verified(pairs, reps, sets)
        if labels is not None:
            links = links.union(labels.filter("node <> label").select("node", "label"))
        labels = components(links)
        common.discard(left)
    common.discard(sets)
    return keys, reps, labels


def _known(keys: DataFrame, reps: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``keys`` with sid and label, both null where there is no set or no doc_id."""
    sids = reps.select("d1", "d2", F.col("n").alias("m"), "sid")
    same = (keys["d1"] == sids["d1"]) & (keys["d2"] == sids["d2"]) & (keys["n"] == sids["m"])
    found = keys.join(sids, same & keys["doc_id"].isNotNull(), "left").select("doc_id", "th", "n", "sid")
    if labels is None:
        return found.withColumn("label", F.col("sid"))
    named = labels.withColumnsRenamed({"node": "sid", "label": "found"})
    return found.join(named, "sid", "left").select("doc_id", "th", "n", "sid", F.coalesce("found", "sid").alias("label"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id
    reachable over links, itself included) and kept (doc_id = component_id).

    Documents are linked if 100 * intersection >= 80 * union of their sets of
    distinct shingles of ``size`` words (four unless given).  Null, empty and blank
    texts have no shingles and are linked with nothing.  Rows that share a doc_id are
    one node: what one of its texts is linked with, all are.  A row without a doc_id
    is linked with nothing, has no component and is kept.  An empty table gives no
    rows; other columns than doc_id and text are not read.
    """
    common.prepare(docs.sparkSession)
    known = common.materialize(_known(*near_components(docs, size)), "known")
    nodes = known.filter("label is not null")
    several = nodes.groupBy("doc_id").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y")
    joined = nodes.join(several.select("doc_id", "x"), "doc_id").filter("label <> x").select(
        F.col("label").alias("a"), F.col("x").alias("b")
    )
    joined = common.materialize(joined.distinct(), "several")
    if not joined.isEmpty():
        merged = components(joined).select("node", "label").toDF("label", "merged")
        known = known.join(merged, "label", "left").withColumn("label", F.coalesce("merged", "label")).drop("merged")
    smallest = known.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = known.join(smallest, "label", "left")
    # an empty text under a doc_id that has others belongs to its node
    of_doc = out.filter("component_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("of_doc"))
    out = out.join(of_doc, "doc_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "of_doc", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def drop_near_copies(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one document of each component of near duplicates, all columns
    kept: that with the smallest doc_id, of several texts under it the one with the
    smallest hash.  Texts, not ids, are what is compared: rows that share a doc_id but
    not the text are different documents here; rows equal in both stay or go together.
    Rows without a doc_id or without a word stay; an empty table stays empty."""
    common.prepare(docs.sparkSession)
    known = common.materialize(_known(*near_components(docs, size)).filter("label is not null"), "known")
    stays = known.groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("stays"))
    gone = known.join(stays, "label").filter(
        (F.col("doc_id") != F.col("stays.doc_id")) | (F.col("th") != F.col("stays.th"))
    )
    gone = common.materialize(gone.select("doc_id", "th").distinct(), "gone")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    same = (docs["doc_id"].cast("long") == gone["doc_id"]) & (F.xxhash64(text) == gone["th"])
    return docs.join(gone, same, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: near-duplicate components of all documents."""
    return near_duplicates(common.documents(spark, sf_dir))


#: The query's rows, of tables whose doc_ids are neither null nor repeated.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3])))
  END AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS size, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * (any_value(a.size) + any_value(b.size) - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a
)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
