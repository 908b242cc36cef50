"""Token ids of whole texts by a public tokenizer file, fast enough for a corpus.

The tokenizer parts text at white space before anything else, so a text's ids are
the ids of its words in a row.  Words repeat, so a task looks only at the distinct
words of a batch, and at those only once as long as they stay in a bounded cache
of the worker.  Words of plain letters and marks are put in lower case and cut where
letters and marks meet, as the tokenizer would do it, which lets "The", "the" and
"the." share an entry; all of this is done on arrays of bytes, and new pieces reach the
tokenizer thousands at a time as one text.  All other words go to it whole, one by one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from strata.llm.names import LIMIT, gather, word_bounds, word_codes

GROUP = LIMIT // 4  # bytes of texts looked up in one go; their arrays take some hundred times that
CACHE = 400_000  # pieces and words a worker remembers, as numbers: most are rare ones that come once
TOGETHER = 2_000  # new pieces that the tokenizer gets as one text

_LETTER, _MARK, _OTHER = 1, 2, 3  # a byte's class; white space is 0
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0
_CLASS[[ord(c) for c in "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"]] = _MARK  # no "'" and "<": "it's", "<|endoftext|>"
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _folded(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with the letters A-Z and U+00C0 to U+00DE in lower case, and their
    classes; letters beyond U+00FF are of the class of all other bytes."""
    low, kind = _LOWER[raw], _CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    after = raw[lead + 1]
    lead = lead[(after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    upper = lead[raw[lead + 1] <= 0x9E] + 1
    low[upper] += 0x20
    return low, kind


def _cut(raw: np.ndarray, ends: np.ndarray):
    """(bytes, first, last, plain, offsets): the pieces of texts laid end to end, which of
    them hold letters or marks alone, and the n + 1 offsets of each text's pieces.  The
    bytes of plain pieces are in lower case, those of others as they were."""
    first, last, _ = word_bounds(raw, ends)
    low, kind = _folded(raw)
    odd = np.flatnonzero(kind == _OTHER)
    whole = np.unique(np.searchsorted(first, odd, "right") - 1)  # words that hold another byte
    at = gather(first[whole], last[whole])
    low[at], kind[at] = raw[at], _OTHER
    meet = np.flatnonzero(kind[:-1] * kind[1:] == _LETTER * _MARK) + 1
    meet = np.setdiff1d(meet, ends, assume_unique=False)  # a text ends where another begins
    first, last = np.sort(np.concatenate((first, meet))), np.sort(np.concatenate((last, meet)))
    return low, first, last, kind[first] != _OTHER, np.searchsorted(first, ends)


@lru_cache(maxsize=4)
def load(path: str) -> "PieceIds":
    return PieceIds(path)


class PieceIds:
    """Ids by piece, for a tokenizer that lower-cases, drops white space and parts
    letters from marks."""

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self._codes, self._slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._begin, self._flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def by_code(
        self, codes: np.ndarray, data: np.ndarray, first: np.ndarray, last: np.ndarray, plain: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all known pieces, first, number) for sorted distinct codes of the
        pieces [first, last) of ``data``."""
        if len(self._codes) > CACHE:
            self._forget()
        where = np.searchsorted(self._codes, codes)
        if len(self._codes):
            new = np.flatnonzero(self._codes[np.minimum(where, len(self._codes) - 1)] != codes)
        else:
            new = np.arange(len(codes))
        if len(new):
            new = np.concatenate((new[plain[new]], new[~plain[new]]))
            n = int(plain[new].sum())
            flat, size = [], []
            for at in range(0, n, TOGETHER):
                some = new[at : min(at + TOGETHER, n)]
                ids, sizes = self._together(data, first[some], last[some])
                flat.append(ids)
                size.append(sizes)
            for k in new[n:].tolist():
                flat.append(self._alone(data[first[k] : last[k]]))
                size.append(np.array([len(flat[-1])]))
            slots = np.arange(len(new)) + len(self._begin) - 1
            self._begin = np.concatenate((self._begin, self._begin[-1] + np.cumsum(np.concatenate(size))))
            self._flat = np.concatenate((self._flat, *flat))
            order = np.argsort(new)
            self._slots = np.insert(self._slots, where[new[order]], slots[order])
            self._codes = np.insert(self._codes, where[new[order]], codes[new[order]])
            where = np.searchsorted(self._codes, codes)
        slot = self._slots[where]
        return self._flat, self._begin[slot], self._begin[slot + 1] - self._begin[slot]

    def _alone(self, word: np.ndarray) -> np.ndarray:
        text = word.tobytes().decode("utf-8", "replace")
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _together(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each) of pieces, encoded as one text and parted where pieces end."""
        begin = np.cumsum(last - first + 1) - (last - first + 1)
        text = np.full(int((last - first + 1).sum()), 0x20, np.uint8)
        text[gather(begin, begin + last - first)] = data[gather(first, last)]
        ids = self._tokenizer.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids
        ids = np.array(ids, np.uint32)
        cuts = np.flatnonzero(self._ends[ids]) + 1
        if len(cuts) == len(first):
            return ids, np.diff(cuts, prepend=0)
        each = [self._alone(data[x:y]) for x, y in zip(first, last)]  # a tokenizer that cuts otherwise
        return np.concatenate(each), np.array([len(x) for x in each])


def encode(data: np.ndarray, ends: np.ndarray, path: str, after: int | None):
    """Ids of texts laid end to end, each text's followed by ``after`` if given.

    Yields (first text, ids, offsets) for groups of texts of bounded size; a text
    longer than the bound is a group of its own.
    """
    lookup = load(path)
    n = len(ends) - 1
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + GROUP, "right")) - 1)
        raw, own = data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        low, first, last, plain, words = _cut(raw, own)
        distinct, one, which = np.unique(word_codes(low, first, last), return_index=True, return_inverse=True)
        flat, begin, size = lookup.by_code(distinct, low, first[one], last[one], plain[one])
        n_ids = size[which]
        total = np.concatenate(([0], np.cumsum(n_ids)))
        out = flat[np.repeat(begin[which] - total[:-1], n_ids) + np.arange(int(total[-1]))]
        offsets = total[words]
        if after is not None:
            out = np.insert(out, offsets[1:], after)
            offsets = offsets + np.arange(len(offsets))
        yield at, out.astype(np.uint32), offsets
        at = to
