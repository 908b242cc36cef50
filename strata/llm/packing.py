"""Packing of token sequences into fixed-length rows.

Documents become ids (:mod:`strata.llm.tokens`); one longer than a row is cut into
full rows and a rest, losing nothing.  Pieces are dealt by hash to groups of bounded
text, and a group is packed as a whole by one task: a group wastes a part of one
row at most on top of what packing everything at once would waste, and groups of a
few thousand pieces keep that below a thousandth.  Their number follows the input.
Equal rows are told apart by their task and their turn among its equal rows, which
does not depend on the order of rows, so a retried task deals alike.

Two packers share this frame:

* :func:`packed_matrices`: best-fit decreasing, where a segment tree over the
  remaining capacities finds the tightest row in logarithmic time.
* :func:`local_search_packing`: best fit, longest first, then a local search that
  moves or exchanges pieces (one for one, two for one) between rows that are not
  full, always raising the sum of squared fills, until rows run empty.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import common, tokens
from strata.llm.names import mix

ROW = 2048
GROUP_BYTES = 4 << 20  # of text in a group of pieces, on average
GIVERS = 24  # rows in turn without a step, after which the local search ends


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _groups(docs: DataFrame) -> int:
    """Number of groups, from the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(docs["text"].cast("string")).cast("long")).alias("n")).first()["n"]
    return max(1, -(-(total or 0) // GROUP_BYTES))


def _dealt(did: np.ndarray, content: np.ndarray, task: np.uint64, seen: dict[int, int]) -> np.ndarray:
    """A key of each row that differs between equal rows: their turns in a task differ."""
    own = mix(did.astype(np.uint64) ^ mix(content.astype(np.uint64)))
    turn = np.empty(len(own), np.uint64)
    for k, x in enumerate(own.tolist()):
        turn[k] = seen[x] = seen.get(x, 0) + 1
    return mix(own ^ mix(turn << np.uint64(32) ^ task))


def _pieces(path: str, row: int, after: int | None, groups: int, with_ids: bool):
    """Rows (g, doc_id, piece, start, length, ids_crc32[, ids]) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = np.uint64(TaskContext.get().partitionId() + 1), {}
        for batch in batches:
            data, ends = common.utf8(batch["text"])
            doc_ids, key = batch["doc_id"], _dealt(common.longs(batch["did"]), common.longs(batch["content"]), task, seen)
            for first, ids, offsets in tokens.encode(data, ends, path, after):
                doc, piece, lo, hi = [], [], [], []
                for k in range(len(offsets) - 1):
                    for p, x in enumerate(range(int(offsets[k]), int(offsets[k + 1]), row)):
                        doc.append(first + k)
                        piece.append(p)
                        lo.append(x)
                        hi.append(min(x + row, int(offsets[k + 1])))
                if not doc:
                    continue
                doc, piece, lo, hi = (np.array(x, np.int64) for x in (doc, piece, lo, hi))
                raw = [ids[x:y].astype("<u4").tobytes() for x, y in zip(lo, hi)]
                mixed = mix(key[doc] ^ (piece * 0x9E3779B1).astype(np.uint64))
                group = ((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)
                columns = [
                    pa.array(group),
                    doc_ids.take(pa.array(doc)),
                    pa.array(piece),
                    pa.array(lo - offsets[doc - first]),
                    pa.array(hi - lo),
                    pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                ]
                names = ["g", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    if len(ids) and int(ids.max()) > 0xFFFF:
                        raise ValueError("matrices hold 16-bit ids; this tokenizer has larger ones")
                    columns.append(pa.array([ids[x:y].astype("<u2").tobytes() for x, y in zip(lo, hi)], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


PIECE = "g long, doc_id long, piece long, start long, length long, ids_crc32 long"


# --- best-fit decreasing ---------------------------------------------------------
class CapacityTree:
    """Segment tree over remaining capacities 0..limit: each leaf holds the rows
    with that capacity, each inner node how many rows are below it."""

    def __init__(self, limit: int):
        self._leaves = 1 << (limit + 1).bit_length()
        self._count = [0] * (2 * self._leaves)
        self._rows: list[list[int]] = [[] for _ in range(limit + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = capacity + self._leaves
        while node:
            self._count[node] += n
            node >>= 1

    def put(self, row: int, capacity: int) -> None:
        self._rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (row, capacity) of the least capacity >= need."""
        node = need + self._leaves
        count = self._count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1  # up, until a subtree to the right has rows
            if node <= 1:
                return None
            node += 1
            while node < self._leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self._leaves
        row = self._rows[capacity].pop()
        self._add(capacity, -1)
        return row, capacity


def best_fit_decreasing(lengths: np.ndarray, limit: int) -> np.ndarray:
    """Row of each piece."""
    tree = CapacityTree(limit)
    out = np.zeros(len(lengths), np.int64)
    rows = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = tree.take(need)
        if found is None:
            found = (rows, limit)
            rows += 1
        out[k] = found[0]
        tree.put(found[0], found[1] - need)
    return out


# --- local search ----------------------------------------------------------------
def best_fit(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Rows of pieces, each put in the tightest row as it comes."""
    rows: list[list[int]] = []
    space: list[tuple[int, int]] = []  # (capacity, row), in order
    for k, need in enumerate(lengths.tolist()):
        at = bisect_left(space, (need, -1))
        if at == len(space):
            rows.append([k])
            left, row = limit - need, len(rows) - 1
        else:
            left, row = space.pop(at)
            rows[row].append(k)
            left -= need
        if left:
            insort(space, (left, row))
    return rows


def empty_rows(rows: list[list[int]], lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Move and exchange pieces between rows that are not full until rows empty.

    The emptiest row gives.  Every step raises a receiver's fill by delta and
    lowers the giver's by as much, so with a receiver at least as full as the
    giver the sum of squared fills rises by 2 * delta * (receiver - giver + delta):
    the search ends.  Steps, in this order: move a piece into the tightest gap;
    exchange one piece for a shorter one; one for two that are shorter together;
    two for one that is shorter than both together.  A row from which no step is
    left is set aside, and after ``GIVERS`` of them in turn the search ends, as it does
    at the least number of rows there can be.
    """
    fill = np.array([int(lengths[r].sum()) for r in rows], np.int64)
    least = -(-int(lengths.sum()) // limit)
    alive = int((fill > 0).sum())
    aside = fill >= limit
    stuck, sums = 0, _Sums(rows, lengths)
    while alive > least and stuck < GIVERS:
        open_rows = np.flatnonzero((fill > 0) & (fill < limit))
        givers = open_rows[~aside[open_rows]]
        if len(open_rows) < 2 or not len(givers):
            break
        giver = int(givers[np.argmin(fill[givers])])
        takers = open_rows[(open_rows != giver) & (fill[open_rows] >= fill[giver])]
        step = _step(rows, sums, fill, lengths, limit, giver, takers) if len(takers) else None
        if step is None:
            aside[giver] = True
            stuck += 1
            continue
        stuck = 0
        taker, given, taken = step
        for k in given:
            rows[giver].remove(k)
        for k in taken:
            rows[taker].remove(k)
        rows[giver] += taken
        rows[taker] += given
        sums.changed(giver)
        sums.changed(taker)
        delta = int(lengths[given].sum() - (lengths[taken].sum() if taken else 0))
        fill[giver] -= delta
        fill[taker] += delta
        if not rows[giver]:
            alive -= 1
            aside[(fill > 0) & (fill < limit)] = False
    return [r for r in rows if r]


class _Sums:
    """The distinct lengths of each row's pieces, alone and two together, in order,
    with pieces that have them; kept until the row changes."""

    def __init__(self, rows: list[list[int]], lengths: np.ndarray):
        self._rows, self._lengths = rows, lengths
        self._known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def of(self, row: int, pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if (row, pieces) not in self._known:
            mine = np.array(self._rows[row])
            a, b = (np.arange(len(mine)),) * 2 if pieces == 1 else np.triu_indices(len(mine), 1)
            own = self._lengths[mine]
            sums, at = np.unique(own[a] if pieces == 1 else own[a] + own[b], return_index=True)
            self._known[row, pieces] = sums, mine[a[at]], mine[b[at]]
        return self._known[row, pieces]

    def changed(self, row: int) -> None:
        self._known.pop((row, 1), None)
        self._known.pop((row, 2), None)


def _exchange(sums: _Sums, giver: int, give: int, takers: np.ndarray, take: int, gap: np.ndarray, limit: int):
    """(delta, taker, pieces given, pieces taken) of the exchange of ``give`` pieces for
    ``take`` that raises a taker's fill most; None if there is none.

    Taker t can give up no less than the given length minus its gap.  One search over
    the takers' sums, each shifted by its taker's number, finds the least such sum."""
    own, one, two = sums.of(giver, give)
    theirs = [sums.of(int(t), take) for t in takers]
    end = np.cumsum([len(x[0]) for x in theirs])
    if not len(own) or not end[-1]:
        return None
    shift = np.arange(len(takers)) * (2 * limit + 2)
    flat = np.concatenate([x[0] for x in theirs]) + np.repeat(shift, np.diff(end, prepend=0))
    at = np.searchsorted(flat, np.maximum(own[:, None] - gap[None, :], 0) + shift[None, :])
    found = at < end[None, :]
    delta = np.where(found, own[:, None] + shift[None, :] - flat[np.minimum(at, end[-1] - 1)], 0)
    i, t = np.unravel_index(int(delta.argmax()), delta.shape)
    if delta[i, t] <= 0:
        return None
    j = int(at[i, t] - (end[t - 1] if t else 0))
    given = [int(one[i]), int(two[i])][:give]
    taken = [int(theirs[t][1][j]), int(theirs[t][2][j])][:take]
    return int(delta[i, t]), int(takers[t]), given, taken


def _step(rows, sums, fill, lengths, limit, giver, takers):
    """(taker, pieces given, pieces taken) of the first kind of step that exists,
    with the largest delta of its kind; None if there is none."""
    mine = np.array(rows[giver])
    size = lengths[mine]
    gap = limit - fill[takers]
    # a move, largest piece first, into the tightest gap
    for k in np.argsort(-size, kind="stable"):
        fits = np.flatnonzero(gap >= size[k])
        if len(fits):
            return int(takers[fits[np.argmin(gap[fits])]]), [int(mine[k])], []
    best = _exchange(sums, giver, 1, takers, 1, gap, limit)
    if best is None:
        two = [_exchange(sums, giver, 1, takers, 2, gap, limit), _exchange(sums, giver, 2, takers, 1, gap, limit)]
        best = max((x for x in two if x is not None), key=lambda x: x[0], default=None)
    return None if best is None else best[1:]


# --- operators -------------------------------------------------------------------
def local_search_packing(docs: DataFrame, row: int = ROW, after: int = 0, path: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``row`` tokens.

    A document is its text's ids and then ``after``; only one longer than ``row``
    is cut.  Returns one row per piece: doc_id, piece, start, length, ids_crc32 (of
    its ids as little-endian unsigned 32-bit numbers), sequence_id and offset.
    A null or empty text is the id ``after`` alone; rows that repeat a doc_id are
    packed each for itself, a null doc_id stays null; an empty table gives no rows.
    """
    common.prepare(docs.sparkSession)
    groups = _groups(docs)
    pieces = common.keyed(docs).select("doc_id", "did", F.xxhash64("text").alias("content"), "text")
    pieces = pieces.mapInArrow(_pieces(path or tokenizer_path(), row, after, groups, False), PIECE)

    def pack(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        order = np.lexsort((table["ids_crc32"].to_numpy(), -lengths))
        rows = [[int(order[k]) for k in r] for r in best_fit(lengths[order], row)]
        rows = empty_rows(rows, lengths, row)
        where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, r in enumerate(rows):
            where[r] = k
            offset[r] = np.cumsum(lengths[r]) - lengths[r]
        g = int(table["g"][0].as_py())
        return table.drop_columns(["g"]).append_column("sequence_id", pa.array((g << 24) + where)).append_column(
            "offset", pa.array(offset)
        )

    out = "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.groupBy("g").applyInArrow(pack, out)


def packed_matrices(docs: DataFrame, row: int = ROW, after: int = 0, path: str | None = None) -> DataFrame:
    """Packed id matrices: one row per sequence with sequence_id, n_tokens, ids
    (binary, ``row`` little-endian unsigned 16-bit ids, zero beyond n_tokens),
    cu_seqlens (cumulative segment lengths from 0 to n_tokens; the position counts
    from 0 again at each but the last), and of each segment doc_ids, pieces and
    starts (its place among the document's ids).

    Vocabularies of up to 65,536 ids.  A null or empty text is the id ``after``
    alone; repeated doc_ids are packed each for itself; an empty table gives no
    rows.  Documents come back whole from :func:`unpacked`.
    """
    common.prepare(docs.sparkSession)
    groups = _groups(docs)
    pieces = common.keyed(docs).select("doc_id", "did", F.xxhash64("text").alias("content"), "text")
    pieces = pieces.mapInArrow(_pieces(path or tokenizer_path(), row, after, groups, True), PIECE + ", ids binary")

    def pack(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        where = best_fit_decreasing(lengths, row)
        order = np.lexsort((table["start"].to_numpy(), -lengths, where))
        cuts = np.flatnonzero(np.diff(where[order], prepend=-1))
        ids, g = table["ids"], int(table["g"][0].as_py())
        out = {k: [] for k in ("sequence_id", "n_tokens", "ids", "cu_seqlens", "doc_ids", "pieces", "starts")}
        doc_id, piece, start = (table[c].to_pylist() for c in ("doc_id", "piece", "start"))
        for at, some in enumerate(np.split(order, cuts[1:])):
            own = lengths[some]
            out["sequence_id"].append((g << 24) + at)
            out["n_tokens"].append(int(own.sum()))
            out["ids"].append(b"".join(ids[int(k)].as_py() for k in some).ljust(2 * row, b"\0"))
            out["cu_seqlens"].append([0, *np.cumsum(own).tolist()])
            out["doc_ids"].append([doc_id[k] for k in some])
            out["pieces"].append([piece[k] for k in some])
            out["starts"].append([start[k] for k in some])
        kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 4]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return pieces.groupBy("g").applyInArrow(
        pack,
        "sequence_id long, n_tokens long, ids binary, cu_seqlens array<long>, doc_ids array<long>,"
        " pieces array<long>, starts array<long>",
    )


def unpacked(packed: DataFrame) -> DataFrame:
    """The segments of packed matrices: doc_id, piece, start and ids (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<u2").astype(np.int32)
                for k, (x, y) in enumerate(zip(r["cu_seqlens"], r["cu_seqlens"][1:])):
                    for column, v in zip(out, (r["doc_ids"][k], r["pieces"][k], r["starts"][k], ids[x:y].tolist())):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, kinds)], names=["doc_id", "piece", "start", "ids"]
            )

    return packed.mapInArrow(run, "doc_id long, piece long, start long, ids array<int>")


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write packed matrices as Parquet files of fixed-length id rows."""
    packed.write.mode("overwrite").parquet(path)


def query_matrices(spark, sf_dir: str) -> DataFrame:
    """op4: all documents as packed id matrices."""
    return packed_matrices(common.documents(spark, sf_dir))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all documents packed by local search."""
    return local_search_packing(common.documents(spark, sf_dir))
