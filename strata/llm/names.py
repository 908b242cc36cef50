"""Numpy kernels on sequences of symbols: names of substrings and sampled positions.

A sequence is an array of 64-bit symbol codes (bytes, or hashed words).  Any
substring's 64-bit name comes from prefix sums of ``code * base**i`` modulo 2**64
in constant time, so a task names thousands of overlapping substrings in a few
vector operations.  Two bases give names of 128 bits.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
LIMIT = 1 << 20  # symbols that are named in one go, which bounds the arrays
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256).astype(U) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = (n + 0xFFFF >> 16) << 16  # few sizes, and hardly more than asked for
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            steps = np.full(size, base, U)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = _POWERS[which] = (out[0], out[1])
    return have


class Names:
    """Names of the substrings [lo, hi) of ``codes``."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        n = len(codes)
        up, self._down = _powers(which, n + 1)
        self._sums = np.zeros(n + 1, U)
        np.cumsum(codes * up[:n], out=self._sums[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self._sums[hi] - self._sums[lo]) * self._down[lo] + (hi - lo).astype(U))


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _CODES[data]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end: first and end
    byte of each word, and the n + 1 offsets of each text's words."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a text ends where another begins
    edge[ends] = True
    first = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    last = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False]))))
    return first, last + 1, np.searchsorted(first, ends)


def word_codes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit codes of words, a pure function of each word's bytes."""
    out = np.empty(len(first), U)
    at = 0
    while at < len(first):  # in pieces of bounded bytes
        to = max(at + 1, int(np.searchsorted(last, first[at] + LIMIT, "right")))
        lo, hi = int(first[at]), int(last[to - 1])
        names = Names(byte_codes(data[lo:hi]))
        out[at:to] = names(first[at:to] - lo, last[at:to] - lo)
        at = to
    return out


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` neighbours, by block-wise prefix and suffix minima."""
    n = len(x) - span + 1
    if n <= 0:
        return x[:0]
    full = -(-len(x) // span) * span
    padded = np.full(full, ~U(0))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, span)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], before[span - 1 : span - 1 + n])


def sampled(codes: np.ndarray, lo: np.ndarray, starts: np.ndarray, window: int, span: int, gram: int):
    """Positions sampled by content (minimizers).

    Sequence s begins at ``lo[s]`` and has ``starts[s]`` windows of ``window``
    symbols.  A window's anchor is the leftmost of the smallest-hashed grams
    among its first ``span`` ones: equal windows have their anchor at the same
    place.  Returns (anchor, first start, last start) of each run of windows
    that share an anchor; every window is in exactly one run.
    """
    names = Names(codes)
    at = np.arange(len(codes) - gram + 1)
    if not len(at):
        return at, at, at
    low = U((1 << 22) - 1)
    packed = (names(at, at + gram) & ~low) | at.astype(U)
    least = (sliding_min(packed, span) & low).astype(np.int64)
    keep = starts > 0
    lo, n = lo[keep], starts[keep]
    if not len(lo):
        return at[:0], at[:0], at[:0]
    begin = np.cumsum(n) - n
    p = np.arange(int(n.sum())) + np.repeat(lo - begin, n)
    anchor = least[p]
    new = np.empty(len(p), bool)
    new[0] = True
    new[1:] = anchor[1:] != anchor[:-1]
    new[begin] = True
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(p)])) - 1
    return anchor[first], p[first], p[last]


def pieces(ends: np.ndarray, window: int, limit: int = LIMIT):
    """Cut sequences laid end to end into groups of bounded size.

    Yields (document, offset in it, first symbol, end symbol, windows) arrays;
    a long document comes as several pieces that overlap by window - 1 symbols,
    so each of its windows is in exactly one piece.  Documents shorter than a
    window have none.
    """
    step = limit // 2
    group: list[tuple[int, int, int, int, int]] = []
    size = 0
    length = np.diff(ends)
    for doc in np.flatnonzero(length >= window):
        n, begin = int(length[doc]), int(ends[doc])
        total = n - window + 1
        for off in range(0, total, step):
            have = min(step, total - off)
            if size and size + have + window > limit:
                yield [np.array(c) for c in zip(*group)]
                group, size = [], 0
            group.append((int(doc), off, begin + off, begin + off + have + window - 1, have))
            size += have + window - 1
    if group:
        yield [np.array(c) for c in zip(*group)]


def gather(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Indices of all the ranges [lo, hi), one after another."""
    n = hi - lo
    begin = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(lo - begin, n)
