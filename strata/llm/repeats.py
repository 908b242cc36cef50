"""Which windows of the corpus occur more than once, without a row per position.

Every document is a sequence of symbols (bytes or words).  A window is
``Unit.window`` consecutive symbols of one document; the engine finds exactly the
windows whose content starts at two or more places of the corpus.

1. Positions are sampled by content (:func:`names.sampled`), about two in
   ``span``.  Each stands for the run of windows that share it as their anchor;
   equal windows have it at the same offset d, so equal windows meet under it.
2. A run ``d in [dlo, dhi]`` of windows has two names: of its *core* (what all its
   windows have in common, at a place fixed by the anchor and the block of
   offsets) and of its *hull* (all that its windows cover).  Spark counts names:
   a core that occurs once settles the run as unique; a hull that occurs twice
   settles it as repeated.
3. Runs that neither settles, and one witness of every other hull of the same
   core, are cut into shorter runs and named again.  Cores grow to the whole
   window as runs shrink to one offset, where core, hull and window are the same.

Rows of equal text are folded to one with a multiplicity first, whatever their
doc_id: a run is listed once and counts as often as its text has rows, so rows of
runs grow with the texts and never with the square of their copies.

Only names, counts and positions are shuffled; texts move once, and again only
those of documents that share a core.  Counting is a two-phase aggregate and the
way back a plain join, so a passage that a third of all documents hold makes one
partial count a task and a join side that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import common
from strata.llm.names import LIMIT, Names, gather, mix, pieces, sampled, word_bounds, word_codes, byte_codes

LOW40 = (1 << 40) - 1


@dataclass(frozen=True)
class Unit:
    """What a window is made of: ``window`` symbols; ``span`` grams of ``gram``
    symbols choose an anchor (span + gram - 1 <= window); ``blocks`` are the
    widths, ending in 1, that unsettled runs are cut to."""

    words: bool
    window: int
    span: int
    gram: int
    blocks: tuple[int, ...]

    def symbols(self, data: np.ndarray, ends: np.ndarray) -> tuple[Callable[[np.ndarray], np.ndarray], np.ndarray]:
        """A function from symbol indices to codes, and each text's offsets."""
        if not self.words:
            return lambda at: byte_codes(data[at]), ends
        first, last, offsets = word_bounds(data, ends)
        codes = word_codes(data, first, last)
        return lambda at: codes[at], offsets


def _scan(unit: Unit, only_cores: bool):
    """Rows (core, did, at, dd) of every run, or (core, n) alone; ``at`` is
    th << 40 | anchor and ``dd`` is dhi << 16 | dlo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = common.utf8(batch["text"])
            codes_at, ends = unit.symbols(data, ends)
            did, th, n = (common.longs(batch[c]) for c in ("did", "th", "n"))
            for doc, off, lo, hi, starts in pieces(ends, unit.window):
                codes = codes_at(gather(lo, hi))
                begin = np.cumsum(hi - lo) - (hi - lo)
                a, first, last = sampled(codes, begin, starts, unit.window, unit.span, unit.gram)
                core = Names(codes)(a, a + unit.window - unit.span + 1)
                k = np.searchsorted(begin, a, "right") - 1
                if only_cores:
                    yield common.rows("core n", core, n[doc[k]])
                    continue
                at = (th[doc[k]] << 40) | (a - begin[k] + off[k])
                yield common.rows("core did at dd", core, did[doc[k]], at, ((a - first) << 16) | (a - last))

    return run


def _named(unit: Unit, block: int):
    """Cut the runs listed beside each text into blocks of offsets and name them:
    rows (core, h1, h2, did, at, dd, n)."""
    window = unit.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = common.utf8(batch["text"])
            codes_at, ends = unit.symbols(data, ends)
            did, copies = common.longs(batch["did"]), common.longs(batch["n"])
            at, n = common.lists(batch["at"])
            dd, _ = common.lists(batch["dd"])
            doc = np.repeat(np.arange(len(did)), np.diff(n))
            dlo, dhi = dd & 0xFFFF, dd >> 16
            cuts = dhi // block - dlo // block + 1
            each = np.repeat(np.arange(len(at)), cuts)
            b0 = (dlo // block * block)[each] + block * (np.arange(len(each)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
            at, doc = at[each], doc[each]
            dlo, dhi = np.maximum(dlo[each], b0), np.minimum(dhi[each], b0 + block - 1)
            a = at & LOW40
            lo, hi = ends[doc] + a - dhi, ends[doc] + a - dlo + window
            fits = (a >= dhi) & (hi <= ends[doc + 1])  # always, but for texts of equal hashes
            order = np.flatnonzero(fits)
            order = order[np.argsort(lo[order], kind="stable")]
            begin = 0
            while begin < len(order):
                base = int(lo[order[begin]])
                end = begin + int(np.searchsorted(lo[order[begin:]], base + LIMIT, "left"))
                some = order[begin:end]
                begin = end
                codes = codes_at(np.arange(base, int(hi[some].max())))
                one, two = Names(codes, 0), Names(codes, 1)
                core = lo[some] + dhi[some] - b0[some] - base
                shape = mix(((dlo[some] << 16) | dhi[some]).astype(np.uint64))
                yield common.rows(
                    "core h1 h2 did at dd n",
                    one(core, core - block + 1 + window),
                    one(lo[some] - base, hi[some] - base) ^ shape,
                    two(lo[some] - base, hi[some] - base) ^ shape,
                    did[doc[some]],
                    at[some],
                    (dhi[some] << 16) | dlo[some],
                    copies[doc[some]],
                )

    return run


def _lists(runs: DataFrame) -> DataFrame:
    """Runs by text.  A list is no longer than its text: texts are folded, so one row
    listed each of its runs."""
    return runs.groupBy("did", F.shiftrightunsigned("at", 40).alias("th")).agg(
        F.collect_list("at").alias("at"), F.collect_list("dd").alias("dd")
    )


def by_content(rows: DataFrame) -> DataFrame:
    """:func:`common.keyed` rows under a key (did, th) of 88 bits of their text alone."""
    th = F.hash("text").bitwiseAND(0xFFFFFF).cast("long")
    return rows.withColumns({"did": F.xxhash64("text"), "th": th})


def folded(rows: DataFrame) -> DataFrame:
    """One row (did, th, text, n) per text of :func:`by_content` rows; n counts its
    rows.  Only texts with copies are aggregated, each once a task before they move."""
    rows = rows.select("did", "th", "text")
    copied = rows.groupBy("did", "th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("did", "th")
    copied = common.materialize(copied, "copied")
    once = rows.join(copied, ["did", "th"], "left_anti").withColumn("n", F.lit(1).cast("long"))
    more = rows.join(copied, ["did", "th"], "left_semi").groupBy("did", "th", "text").agg(F.count(F.lit(1)).alias("n"))
    return once.unionByName(common.materialize(more, "copies"))


def repeated(rows: DataFrame, unit: Unit) -> tuple[DataFrame, DataFrame]:
    """(work, runs): of :func:`by_content` rows the texts (did, th, text, n), each once,
    that share a core with any place, and per text of ``work`` the lists ``at`` and
    ``dd`` of the runs whose windows all occur at least twice in the corpus."""
    docs = folded(rows)
    cores = docs.mapInArrow(_scan(unit, True), "core long, n long")
    shared = cores.groupBy("core").agg(F.sum("n").alias("n")).filter("n > 1").select("core")
    # Written first: a join of two exchanges is one that skew handling can split.
    shared = common.materialize(shared, "cores")
    runs = docs.mapInArrow(_scan(unit, False), "core long, did long, at long, dd long").join(shared, "core")
    work = common.materialize(docs.join(_lists(runs), ["did", "th"]), "work")
    texts = work.select("did", "th", "text", "n")

    todo, done = work, []
    schema = "core long, h1 long, h2 long, did long, at long, dd long, n long"
    for block in (unit.span, *unit.blocks):
        named = common.materialize(todo.mapInArrow(_named(unit, block), schema), f"runs-{block}")
        hulls = named.groupBy("core", "h1", "h2").agg(
            F.sum("n").alias("n"), F.min(F.struct("did", "at", "dd")).alias("witness")
        )
        hulls = common.materialize(hulls, f"hulls-{block}")
        twice = hulls.filter("n > 1").select("core", "h1", "h2")
        done.append(named.join(twice, ["core", "h1", "h2"]).select("did", "at", "dd"))
        if block > 1:
            open_cores = (
                hulls.groupBy("core")
                .agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"))
                .filter("m > 1 and least = 1")
                .select("core")
            )
            unsettled = hulls.join(open_cores, "core").select("witness.*")
            todo = texts.join(_lists(unsettled), ["did", "th"])
    settled = done[0]
    for more in done[1:]:
        settled = settled.unionByName(more)
    return texts, _lists(settled)


def covered(at: np.ndarray, dd: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the stretches that runs cover into disjoint, non-touching spans."""
    a = at & LOW40
    lo, hi = a - (dd >> 16), a - (dd & 0xFFFF) + window
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    ends = np.flatnonzero(np.concatenate((new[1:], [True])))
    return lo[new], hi[ends]
