"""Embedding near-dedup through a pivot-permutation index.

1. Equal vectors are one class.  All that follows works on classes.
2. Reference points (pivots) are drawn from a bounded sample of the classes, none of
   them close to another, so that a dense cluster has at most one of its own.
3. A vector is described by its ``NEAREST`` pivots of largest cosine, in that order.
   Close vectors have most of them in common.
4. Inverted lists by pivot give the candidates: pairs with at least ``SHARED`` pivots
   in common.  Two such descriptions also meet in one of their NEAREST - SHARED + 1
   pivots that come first in a common order, so a vector is listed only under these,
   with the pivots of the shortest lists first.
5. A list is compared by blocks of ``BLOCK`` members, two blocks in a task: pivots in
   common are counted, then cosines are computed in double precision.  A pair is
   looked at in the first list that it shares only.  What a task returns is one count
   for each member and a spanning forest of its links, never the pairs.

The sample (at most ``SAMPLE`` vectors) fits the pivots only; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm import common
from strata.llm.graph import components

COSINE = 0.9
PIVOTS = 256  # reference points at most
SAMPLE = 4096  # vectors that they are chosen from
APART = 0.6  # no two pivots have a larger cosine
NEAREST = 16  # pivots that describe a vector
SHARED = 8  # that a candidate pair has in common at least
BLOCK = 2048  # members of a list that one task compares with as many others

_WORDS = PIVOTS // 64
U = np.uint64


def is_vector(column: Column) -> Column:
    """Whether there is a direction: components, all of them finite, not all zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def classes_of(rows: DataFrame) -> DataFrame:
    """(cid, d1, d2, rep, size, vec) of the distinct vectors of (vec_id, vec, d1, d2)."""
    one = rows.groupBy("d1", "d2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("vec").alias("vec")
    )
    return common.materialize(one.withColumn("cid", F.monotonically_increasing_id()), "classes")


def _matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, filled with zeros to one width (or cut to
    it), and the vectors' own lengths."""
    ends = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    size = np.diff(ends)
    full = int(size.max(initial=1))
    out = np.zeros((len(size), max(full, width or 0)))
    out[np.arange(out.shape[1]) < size[:, None]] = flat[ends[0] : ends[-1]]
    out /= np.abs(out).max(axis=1, keepdims=True)  # squares neither vanish nor overflow
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    return out[:, :width] if width else out, size


def choose_pivots(classes: DataFrame) -> np.ndarray:
    """At most PIVOTS of a sample of SAMPLE classes: those with the smallest hashes
    that are no closer to one chosen before than APART."""
    drawn = classes.orderBy("d1", "d2").limit(SAMPLE).select("vec").toArrow()
    if not drawn.num_rows:
        return np.zeros((0, 1))
    points, _ = _matrix(drawn["vec"].combine_chunks())
    chosen: list[int] = []
    for k in range(len(points)):
        if len(chosen) < PIVOTS and (points[chosen] @ points[k] <= APART).all():
            chosen.append(k)
    return points[chosen]


def _describer(pivots: np.ndarray):
    """Adds the NEAREST pivots in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = min(NEAREST, len(pivots))
        for batch in batches:
            points, _ = _matrix(batch["vec"], pivots.shape[1])
            near = np.argsort(-(points @ pivots.T), axis=1, kind="stable")[:, :n]
            order = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel().astype(np.int64)), n)
            yield pa.RecordBatch.from_arrays([batch["cid"], order.cast(pa.list_(pa.int64()))], names=["cid", "near"])

    return run


def described(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(cid, near): every class and its nearest pivots, nearest first."""
    return classes.select("cid", "vec").mapInArrow(_describer(pivots), "cid long, near array<long>")


def _listing(need: int):
    """Postings (list, cid, bits): one for each list that must hold a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = batch["ranks"]
            flat, ends = common.lists(ranks)
            n = int(ends[1] - ends[0]) if len(ends) > 1 else 0
            if not n:
                continue
            ranked = np.sort(flat.reshape(-1, n), axis=1)
            first = ranked[:, : n - need + 1]
            bits = np.zeros((len(ranked), _WORDS), U)
            np.bitwise_or.at(bits, (np.arange(len(ranked))[:, None], ranked >> 6), U(1) << (ranked & 63).astype(U))
            packed = pa.array([b.tobytes() for b in bits], pa.binary())
            row = np.repeat(np.arange(len(ranked)), first.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(first.ravel()), batch["cid"].take(pa.array(row)), packed.take(pa.array(row))],
                names=["list", "cid", "bits"],
            )

    return run


def _lowest(bits: np.ndarray, n: int) -> np.ndarray:
    """Only the ``n`` lowest set bits of each description."""
    rest, out = bits.copy(), np.zeros_like(bits)
    for _ in range(n):
        word = np.argmax(rest != 0, axis=1)
        at = (np.arange(len(rest)), word)
        low = rest[at] & (~rest[at] + U(1))
        out[at] |= low
        rest[at] ^= low
    return out


def _comparer(cosine: float, need: int, listed: int):
    def compare(table: pa.Table) -> pa.Table:
        """Links between two blocks of a list, or within one: (a, a, how many vectors
        a is linked with here) and, with n = 0, the links (a, b) of a spanning forest."""
        table = table.combine_chunks()
        cid, size, block = (table[c].to_numpy() for c in ("cid", "size", "block"))
        this, i, j = (int(table[c][0].as_py()) for c in ("list", "i", "j"))
        points, width = _matrix(table["vec"].chunk(0) if table["vec"].num_chunks else table["vec"].combine_chunks())
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), U).reshape(-1, _WORDS)
        heads = _lowest(bits, listed)
        before = np.zeros(_WORDS, U)  # the lists before this one
        before[: this >> 6] = ~U(0)
        before[this >> 6] |= (U(1) << U(this & 63)) - U(1)
        heads = heads & before
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        linked, group = np.zeros(len(cid), np.int64), np.arange(len(cid))
        links: list[tuple[int, int]] = []
        for at in range(0, len(left), 256):
            mine = left[at : at + 256]
            both = np.zeros((len(mine), len(right)), np.uint8)
            earlier = np.zeros(both.shape, bool)
            for w in range(_WORDS):
                both += np.bitwise_count(bits[mine, None, w] & bits[None, right, w])
                if before[w]:
                    earlier |= (heads[mine, None, w] & heads[None, right, w]) != 0
            close = (both >= need) & ~earlier & (width[mine, None] == width[None, right])
            if i == j:
                close &= mine[:, None] < right[None, :]
            close &= points[mine] @ points[right].T >= cosine
            linked[mine] += close @ size[right]
            linked[right] += size[mine] @ close
            for k, hits in zip(mine, close):
                met = right[hits]
                other, one = np.unique(group[met], return_index=True)
                new = other != group[k]
                if new.any():
                    links += [(k, int(b)) for b in met[one[new]]]
                    group[np.isin(group, other)] = group[k]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        some = np.flatnonzero(linked)
        return pa.table(
            {
                "a": np.concatenate((cid[some], cid[a])),
                "b": np.concatenate((cid[some], cid[b])),
                "n": np.concatenate((linked[some], np.zeros(len(a), np.int64))),
            }
        )

    return compare


def class_links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b, n) over class ids: with n > 0 and a = b, that a is linked with n vectors
    of other classes in one task; with n = 0 a link between two classes."""
    spark = classes.sparkSession
    pivots = choose_pivots(classes)
    n = min(NEAREST, len(pivots))
    need = min(SHARED, n)
    listed = n - need + 1
    near = common.materialize(described(classes, pivots), "described")
    # PIVOTS rows at most: how many classes have each pivot
    counted = {r[0]: r[1] for r in near.select(F.explode("near").alias("p")).groupBy("p").count().collect()}
    order = sorted(range(len(pivots)), key=lambda p: (counted.get(p, 0), p))
    rank = np.argsort(order) if order else np.zeros(0, np.int64)
    ranks = F.array(*[F.lit(int(r)) for r in rank]) if len(rank) else F.array(F.lit(0))
    ranked = near.select("cid", F.transform("near", lambda p: F.get(ranks, p.cast("int")).cast("long")).alias("ranks"))
    posted = common.materialize(ranked.mapInArrow(_listing(need), "list long, cid long, bits binary"), "postings")
    sizes = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))  # PIVOTS rows at most
    sizes = common.materialize(sizes, "list-sizes")
    block = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    dealt = (
        posted.join(F.broadcast(sizes), "list")
        .withColumn("block", block)
        .join(classes.select("cid", "size", "vec"), "cid")
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "list", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"),
            "block", "cid", "size", "vec", "bits",
        )
    )
    found = dealt.groupBy("list", "i", "j").applyInArrow(_comparer(cosine, need, listed), "a long, b long, n long")
    return common.materialize(found, "links")


def near_duplicate_vectors(
    vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per input row: vec_id, n_links (other rows whose vector has a cosine of
    at least ``cosine`` with this one's), component_id (the smallest vec_id reachable
    over links, itself included) and kept (vec_id = component_id).

    Found through the index: a pair that has fewer than SHARED of its NEAREST pivots
    in common is missed; none below the threshold is returned.  Equal vectors are
    linked.  Vectors that are null or empty, hold a null or non-finite component or
    only zeros, and rows without an id, are linked with nothing; a row without an id
    has no component and is kept.  Vectors of different lengths are not linked.  Rows
    that share an id are one node, and each counts in others' n_links.  An empty table
    gives no rows; other columns are not read.
    """
    common.prepare(vectors.sparkSession)
    vec = vectors[vector_col]
    good = is_vector(vec) & vectors[id_col].isNotNull()
    plain = F.transform(vec, lambda x: F.when(x == 0, F.lit(0).cast("float")).otherwise(x))  # -0.0 is 0.0
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), F.when(good, plain).alias("vec"))
    rows = rows.select(
        "vec_id", "vec",
        F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(1), "vec")).alias("d1"),
        F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(2), "vec")).alias("d2"),
    )
    keys = common.materialize(rows.drop("vec"), "vector-keys")
    classes = classes_of(rows.filter("vec is not null"))
    links = class_links(classes, cosine)
    n = links.filter("n > 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    known = classes.select("cid", "d1", "d2", "rep", "size").join(n, "cid", "left").select(
        "cid", "d1", "d2", "rep", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
    )
    known = common.materialize(known, "known")
    rep = known.select("cid", "rep")
    edges = links.filter("n = 0").join(rep.toDF("a", "x"), "a").join(rep.toDF("b", "y"), "b").select("x", "y")
    mine = keys.join(known.drop("cid"), ["d1", "d2"], "left")
    several = mine.filter("vec_id <> rep").join(
        mine.groupBy("vec_id").agg(F.min("rep").alias("r1"), F.max("rep").alias("r2")).filter("r1 < r2"), "vec_id"
    )  # an id with several vectors joins their classes
    labels = components(edges.union(several.select("vec_id", "rep")).toDF("a", "b").filter("a <> b"))
    out = mine.join(labels.toDF("rep", "label"), "rep", "left")
    own = F.coalesce("label", "rep", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.col("vec_id").eqNullSafe(own).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op13: near-duplicate components of all embeddings."""
    return near_duplicate_vectors(common.table(spark, sf_dir, "embeddings"))


#: All pairs in double precision, and labels passed along links until none changes.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION SELECT reach.node, link.y FROM reach JOIN link ON reach.other = link.x
)
SELECT vec_id,
       (SELECT count(*) FROM link WHERE x = vec_id) AS n_links,
       min(other) AS component_id,
       vec_id = min(other) AS kept
FROM embeddings JOIN reach ON node = vec_id GROUP BY vec_id
"""
