"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers cut the same bytes.  Byte offsets where tokens of both end are shared
cuts; they part a text into groups of tokens that cover the same bytes.  To find
them, each text is an interval of A's token ends.  A common end is located near the
interval's middle, going outwards from it and bisecting in B's ends; the interval is
parted there and both halves go on.  An interval without a common end is a leaf: one
group.  All intervals of a batch of texts descend together, level by level, and an
end that was found not to be shared is not looked at again.

What is counted over the corpus (how many documents link a pair of ids) is a Spark
aggregation over the pairs of all documents.  Looking the counts up again joins on
the pair; common pairs are in most documents, so the ``HOT`` most frequent ones, a
fixed number, are broadcast, and only the rest is shuffled.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strata.llm import common

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXT_BYTES = 1 << 20  # texts handled together; a longer text is handled alone
LINKS = 1 << 21  # links expanded together
HOT = 1 << 18  # pairs whose counts are broadcast: 262,144 rows of two longs and a flag
WORDS = 600_000  # words a worker remembers
SPACE = "\u2581"  # fixed: how sentence pieces write a space
_RUN = regex.compile(r"\S{1000}|\s{1000}")


# --- tokenizers ------------------------------------------------------------------
def _byte_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class _Tokens:
    """Bytes, lengths and decimal digits of a vocabulary's tokens."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.n_digits = np.array([len(str(k)) for k in range(len(pieces))], np.int64)

    def covers(self, ids: list[int], text: bytes) -> bool:
        return b"".join(map(self.pieces.__getitem__, ids)) == text


class ByteLevel(_Tokens):
    """A byte-level BPE file.  Its ranks are read from its own merges and given to
    the faster of the two libraries; texts with a very long run, on which that one
    takes quadratic time, go to the other.  Both give the same ids."""

    def __init__(self, path: str):
        self._exact = Tokenizer.from_file(path)
        self._exact.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        alphabet, vocabulary = _byte_alphabet(), self._exact.get_vocab(with_added_tokens=False)
        pieces = [b""] * (max(self._exact.get_vocab().values()) + 1)
        for token, k in vocabulary.items():
            if all(c in alphabet for c in token):
                pieces[k] = bytes(alphabet[c] for c in token)
        super().__init__(pieces)
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ranks = [vocabulary[m] for m in merged]
        known = {p: k for k, p in enumerate(pieces) if p and k <= ranks[-1]}
        self._fast = None
        if ranks == sorted(ranks) and len(known) == len(ranks) + 256:  # ids are in merge order
            self._fast = tiktoken.Encoding(
                "byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}
            )

    def __call__(self, text: str) -> list[int]:
        if self._fast is None or len(text) > 1000 and _RUN.search(text):
            return self._exact.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


class Pieces(_Tokens):
    """A sentence-piece model with byte fallback, which adds a space of its own."""

    def __init__(self, path: str):
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(k) for k in range(self._model.get_piece_size())]
        super().__init__(
            [
                bytes([int(p[3:-1], 16)]) if self._model.is_byte(k) else p.replace(SPACE, " ").encode()
                for k, p in enumerate(names)
            ]
        )
        #: No piece goes on after a word with a space: words can be encoded alone.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in names)

    def __call__(self, text: str) -> list[int]:
        return self._model.encode(text)

    def many(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Both:
    """Ids by both tokenizers, remembered by word.

    Neither has a token that ends a word and begins the space after it, so a text
    parted before each space that follows a word has the ids of its parts in a row.
    Texts with other white space before a space are encoded whole.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self._known: dict[str, tuple[list[int], list[int]] | None] = {}

    def _encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """The ids, or None if one tokenizer's bytes are not a space and the text."""
        a, b, raw = self.a(" " + text), self.b(text), b" " + text.encode()
        return (a, b) if self.a.covers(a, raw) and self.b.covers(b, raw) else None

    def _learn(self, words: list[str]) -> None:
        for word, b in zip(words, self.b.many(words)):
            a, raw = self.a(" " + word), b" " + word.encode()
            self._known[word] = (a, b) if self.a.covers(a, raw) and self.b.covers(b, raw) else None

    def __call__(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        known, parted = self._known, [t.split(" ") for t in texts]
        if len(known) > WORDS:
            known.clear()
        new = set(chain.from_iterable(parted)).difference(known)
        whole = {w for w in new if not self.b.by_word or not w or w[-1].isspace() or SPACE in w}
        self._learn(list(new - whole))
        out = []
        for text, words in zip(texts, parted):
            if whole and not whole.isdisjoint(words):
                out.append(self._encode(text) if text else None)
                continue
            found = [known[w] for w in words]
            out.append(None if None in found else tuple(list(chain.from_iterable(map(itemgetter(k), found))) for k in (0, 1)))
        return out


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Both:
    return Both(a_path, b_path)


# --- divide and conquer ------------------------------------------------------------
def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in A, in B): indices of the tokens at whose end tokens of both end, for texts
    laid end to end.  ``first`` is where each text's A tokens begin, and their total;
    every text has tokens, and its last ends are shared."""
    cut = np.zeros(len(ends_a), bool)
    cut[first[1:] - 1] = True
    lo, hi = first[:-1], first[1:] - 1  # the ends inside an interval, whose own last end is shared
    while len(lo):
        inside = lo < hi
        lo, hi = lo[inside], hi[inside]
        if not len(lo):
            break
        middle = (lo + hi) >> 1
        below, above = middle.copy(), middle + 1  # [below + 1, above) has been looked at
        found = np.full(len(lo), -1)
        left = np.arange(len(lo))
        while len(left):
            for side, step in ((below, -1), (above, 1)):
                at = left[(side[left] >= lo[left]) & (side[left] < hi[left]) & (found[left] < 0)]
                probe = side[at]
                hit = ends_b[np.searchsorted(ends_b, ends_a[probe])] == ends_a[probe]
                found[at[hit]] = probe[hit]
                side[at] += step
            left = left[(found[left] < 0) & ((below[left] >= lo[left]) | (above[left] < hi[left]))]
        parted = found >= 0
        cut[found[parted]] = True
        # the ends between the halves have all been looked at
        lo, hi = (
            np.concatenate((lo[parted], above[parted])),
            np.concatenate((np.minimum(below[parted] + 1, found[parted]), hi[parted])),
        )
    in_a = np.flatnonzero(cut)
    return in_a, np.searchsorted(ends_b, ends_a[in_a])


@lru_cache(maxsize=2)
def _decimals(n: int) -> np.ndarray:
    """The digits of 0 to n - 1, left-justified, with room for a mark."""
    wide = len(str(n - 1))
    return np.array([[*str(k).encode().ljust(wide + 1)] for k in range(n)], np.uint8)


def _group_text(ids: np.ndarray, n_digits: np.ndarray, marks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids under ``n``, each followed by its mark, as bytes; where each begins."""
    out = _decimals(n)[ids]
    out[np.arange(len(ids)), n_digits] = marks
    begin = np.concatenate(([0], np.cumsum(n_digits + 1)))
    return out[np.arange(out.shape[1]) <= n_digits[:, None]], begin


def _count(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[begin], np.add.reduceat(times, begin) if len(begin) else times


def _links(ida, idb, a0, b0, na, nb, doc, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc << bits | id of A * width + id of B, times), distinct, of all links."""
    n = na * nb
    found, at = [], 0
    ends = np.concatenate(([0], np.cumsum(n)))
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + LINKS, "right")) - 1)
        if to == at + 1 and n[at] > LINKS:  # a long group without cuts: its distinct ids suffice
            ua, ca = np.unique(ida[a0[at] : a0[at] + na[at]], return_counts=True)
            ub, cb = np.unique(idb[b0[at] : b0[at] + nb[at]], return_counts=True)
            rows = max(1, LINKS // len(ub))
            for k in range(0, len(ua), rows):
                key = (doc[at] << bits) | (ua[k : k + rows, None] * width + ub[None, :]).ravel()
                found.append((key, (ca[k : k + rows, None] * cb[None, :]).ravel()))
        else:
            g = np.repeat(np.arange(at, to), n[at:to])
            k = np.arange(int(ends[to] - ends[at])) - (ends[g] - ends[at])
            i, j = np.divmod(k, nb[g])
            key = (doc[g] << bits) | (ida[a0[g] + i] * width + idb[b0[g] + j])
            key, times = np.unique(key, return_counts=True)
            found.append((key, times))
        at = to
    if len(found) == 1:
        return found[0]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _count(*map(np.concatenate, zip(*found)))


_LINK = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))


def _align(texts: list[str], both: Both) -> dict[str, list | pa.Array]:
    """Columns of the texts' alignments; a text that has none is all zeros."""
    a, b = both.a, both.b
    encoded = both(texts)
    good = [k for k, ids in enumerate(encoded) if ids is not None]
    zeros = np.zeros((4, len(texts)), np.int64)
    sha = [""] * len(texts)
    keys, times, bits = np.zeros(0, np.int64), np.zeros(0, np.int64), 62
    if good:
        of_a, of_b = zip(*(encoded[k] for k in good))
        first_a, first_b = (np.concatenate(([0], np.cumsum([len(x) for x in of]))) for of in (of_a, of_b))
        ida = np.fromiter(chain.from_iterable(of_a), np.int64, int(first_a[-1]))
        idb = np.fromiter(chain.from_iterable(of_b), np.int64, int(first_b[-1]))
        cut_a, cut_b = shared_cuts(np.cumsum(a.size[ida]), np.cumsum(b.size[idb]), first_a)
        a1, b1 = cut_a + 1, cut_b + 1
        a0, b0 = np.concatenate(([0], a1[:-1])), np.concatenate(([0], b1[:-1]))
        na, nb = a1 - a0, b1 - b0
        doc = np.searchsorted(first_a, a0, "right") - 1
        groups = np.searchsorted(a0, first_a)
        n_links = np.concatenate(([0], np.cumsum(na * nb)))[groups]
        zeros[:, good] = np.diff(first_a), np.diff(first_b), np.diff(groups), np.diff(n_links)
        # ids of a group: A's, then B's
        at_a = np.arange(len(ida)) + np.repeat(b0, na)
        at_b = np.arange(len(idb)) + np.repeat(a1, nb)
        n = len(ida) + len(idb)
        ids, size, marks = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[at_a], ids[at_b] = ida, idb
        size[at_a], size[at_b] = a.n_digits[ida], b.n_digits[idb]
        marks[at_a[cut_a]], marks[at_b[cut_b]] = ord("|"), ord(";")
        text, begin = _group_text(ids, size, marks, max(len(a.pieces), len(b.pieces)))
        where = begin[first_a + first_b]
        for k, x, y in zip(good, where[:-1].tolist(), where[1:].tolist()):
            sha[k] = hashlib.sha256(memoryview(text[x : y - 1])).hexdigest()
        width = len(b.pieces)
        bits = (len(a.pieces) * width).bit_length()
        keys, times = _links(ida, idb, a0, b0, na, nb, np.array(good)[doc], width, bits)
    owner, pair = keys >> bits, keys & ((1 << bits) - 1)
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    links = pa.StructArray.from_arrays([pa.array(pair), pa.array(times)], names=["pair", "times"])
    return {
        "n_a": zeros[0], "n_b": zeros[1], "n_groups": zeros[2], "n_links": zeros[3], "groups_sha256": sha,
        "links": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), links),
    }


def _aligner(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(a_path, b_path)
        for batch in batches:
            texts = batch["text"].to_pylist()
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to]) <= TEXT_BYTES):
                    held += len(texts[to])
                    to += 1
                out = _align(texts[at:to], both)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(at, to - at), *(c if isinstance(c, pa.Array) else pa.array(c) for c in out.values())],
                    names=["doc_id", *out],
                )
                at = to

    return run


def aligned_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and
    ``links``, the distinct (pair, times) of the text's linked tokens, where pair is
    id of A * (size of B's vocabulary) + id of B; and ``row``, unique to the row.

    Null and empty texts, and texts whose joined token bytes differ from a space and
    the text, have no tokens: zeros, an empty string, no links.  The table is written
    once to the shared folder; whoever counts over it reads it again.
    """
    common.prepare(docs.sparkSession)
    a_path = a_path or public_tokenizers.path(A_FILE)
    b_path = b_path or public_tokenizers.path(B_FILE)
    rows = common.keyed(docs).select("doc_id", "text").mapInArrow(
        _aligner(a_path, b_path),
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
        " links array<struct<pair: long, times: long>>",
    )
    return common.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, docs, best): in how many rows a pair of ids is linked, and whether no
    other pair of the same A id is linked in more."""
    counts = aligned.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counts = common.materialize(counts.withColumn("a", F.expr(f"pair div {width}")), "pairs")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    found = counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    return common.materialize(found, "counts")


def alignment_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose
    pair is linked in as many rows as the A id's best), count_sum (over links, the
    rows that link the pair) and groups_sha256.

    Repeated rows and rows that share a doc_id each count as a document; a null
    doc_id is kept.  Texts without tokens have zeros and an empty string.  An empty
    table gives no rows; other columns than doc_id and text are not read.
    """
    a_path, b_path = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    aligned = aligned_tokens(docs, a_path, b_path)
    counts = pair_counts(aligned, len(load(a_path, b_path).b.pieces))
    hot = common.materialize(counts.orderBy(F.desc("docs"), "pair").limit(HOT), "hot")
    links = aligned.select("row", F.inline("links"))
    sums = [
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("docs")).alias("count_sum"),
    ]
    common_pairs = links.join(F.broadcast(hot), "pair").groupBy("row").agg(*sums)
    rest = links.join(F.broadcast(hot.select("pair")), "pair", "left_anti")
    rare_pairs = rest.join(counts, "pair").groupBy("row").agg(*sums)
    total = common_pairs.union(rare_pairs).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    return aligned.drop("links").join(total, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op12: alignment of two public tokenizers over all documents."""
    return alignment_counts(common.documents(spark, sf_dir))
