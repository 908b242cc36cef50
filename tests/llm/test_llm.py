"""Corpus operators on small tables against brute force, and their edge cases."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strata.llm import common, decontaminate, exact, language, licenses, minhash, names, packing, rlz, suffixes, tokens, toxicity

SF001 = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"pass{i}age" for i in range(80))
BASE = " ".join(f"w{i * 7919 % 1000}" for i in range(300))
LONG = " ".join(f"l{i}" for i in range(9000))

ROWS = [
    (1, "Alpha beta  gamma"),
    (2, "Alpha beta\tgamma"),
    (3, None),
    (4, ""),
    (5, "   "),
    (6, f"before one two {PASSAGE} after three"),
    (7, f"other start {PASSAGE[:-9]} and another end"),
    (8, BASE),
    (9, BASE.replace("w7919 ", "x ") + " tail"),
    (10, BASE.upper()),
    (11, LONG),
    (12, "aé" * 700),
    (None, "Alpha beta gamma"),
    (13, "z z z z z " * 120),
    (14, "Released under the MIT License.\nsome words that follow here"),
    (14, "Released under the MIT License.\nsome words that follow here"),
    (15, "short one"),
    (15, f"another text under the same id {PASSAGE}"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names the operators use themselves
    rows = [(i, t, "en", "s", "x", 1, True) for i, t in ROWS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, norm string, did int, kept boolean"
    ).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def window_marks(sequences, size):
    seen = Counter(tuple(s[p : p + size]) for s in sequences for p in range(len(s) - size + 1))
    marks = []
    for s in sequences:
        hit = np.zeros(len(s), bool)
        for p in range(len(s) - size + 1):
            if seen[tuple(s[p : p + size])] > 1:
                hit[p : p + size] = True
        marks.append(hit)
    return marks


def test_substring_dedup(docs, empty):
    words = [WORDS.findall(t or "") for _, t in ROWS]
    want = Counter()
    for (i, _), w, hit in zip(ROWS, words, window_marks(words, 35)):
        kept = " ".join(x for x, h in zip(w, hit) if not h)
        want[(i, len(w), int(hit.sum()), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = rlz.duplicate_factors(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == want
    assert sum(k[2] for k in want) > 200
    assert rlz.duplicate_factors(empty).count() == 0


@pytest.mark.parametrize("window", [400, 30, 3])
def test_suffix_dedup(docs, empty, window):
    raw = [(t or "").encode() for _, t in ROWS]
    want = Counter()
    for (i, _), b, hit in zip(ROWS, raw, window_marks(raw, window)):
        left = bytes(x for x, h in zip(b, hit) if not h)
        runs = int((hit & ~np.concatenate(([False], hit[:-1]))).sum())
        want[(i, len(b), int(hit.sum()), runs, hashlib.sha256(left).hexdigest())] += 1
    got = suffixes.duplicate_byte_spans(docs, window)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == want
    assert suffixes.duplicate_byte_spans(empty, window).count() == 0


def test_exact_dedup(docs, empty):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS]
    want = Counter()
    for (i, _), t in zip(ROWS, norm):
        ids = [j for (j, _), u in zip(ROWS, norm) if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        want[(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(map(tuple, exact.exact_groups(docs).collect())) == want
    assert exact.exact_groups(empty).count() == 0
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(norm))
    assert exact.drop_copies(empty).count() == 0


def shingles(text, size=4):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def test_near_dedup(docs, empty):
    sets = [shingles(t) for _, t in ROWS]
    label = {i: i for i, _ in ROWS if i is not None}
    for _ in ROWS:
        for (i, _), x in zip(ROWS, sets):
            for (j, _), y in zip(ROWS, sets):
                if x and None not in (i, j) and 100 * len(x & y) >= 80 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    want = Counter((i, len(s), label.get(i), i == label.get(i)) for (i, _), s in zip(ROWS, sets))
    assert Counter(map(tuple, minhash.near_duplicates(docs).collect())) == want
    assert label[10] == label[9] == 8
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.drop_near_copies(docs).columns == docs.columns


def test_near_dedup_of_a_large_bucket(spark, monkeypatch):
    """Leaders, then blocks: many variants of one text, most of them not linked."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(60):
        w = list(base)
        for p in rng.choice(150, rng.integers(0, 8), replace=False):
            w[p] = f"e{k}x{p}"
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    label = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(rows).collect()}
    assert [got[k] for k in range(60)] == label
    assert 1 < len(set(label)) < 60


def test_texts_without_a_wanted_set_are_left_out_before_they_move(spark):
    rows = spark.range(2_000).selectExpr("id as doc_id", "id * 7 as th", "concat_ws(' ', id, 'a b c d', id) as text")
    rows = common.materialize(rows, "rows")
    wanted = rows.filter("doc_id % 100 = 3").selectExpr("doc_id + 9 as sid", "doc_id as rep", "th as rep_th", "1L as n")
    wanted = common.materialize(wanted, "wanted")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with common.bloom_filtered(spark, wanted.count()):
            sets = minhash.wanted_sets(rows, wanted)
            plan = sets._jdf.queryExecution().toString()
            got = {r["sid"]: len(r["shingles"]) for r in sets.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "might_contain" in plan
    assert got == {k + 9: 8 * 3 for k in range(3, 2_000, 100)}
    assert "might_contain" not in minhash.wanted_sets(rows, wanted)._jdf.queryExecution().toString()


def test_texts_under_one_doc_id_are_one_node_but_dropped_one_by_one(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = spark.createDataFrame([(3, a), (15, a), (15, b), (20, b + " tail"), (15, ""), (15, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(rows).collect()}
    assert got == {(3, 3), (15, 3), (20, 3)}
    kept = Counter((r["doc_id"], r["text"]) for r in minhash.drop_near_copies(rows).collect())
    assert kept == Counter([(3, a), (15, b), (15, ""), (15, None)])  # a text of every group stays


def test_posterior_bounds_hardly_drop_a_pair_at_the_threshold():
    rng = np.random.default_rng(1)
    match = rng.random((20_000, minhash.BANDS * minhash.VALUES)) < 0.8
    bounds = minhash.least_matches(0.8, minhash.MISS)
    lost = np.zeros(len(match), bool)
    for n, least in bounds:
        lost |= match[:, :n].sum(axis=1) < least
    assert lost.mean() < 1e-3
    assert bounds == sorted(bounds)


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame(
        [(1, PASSAGE), (2, "alpha BETA"), (3, None), (4, ""), (5, PASSAGE), (6, " ".join(BASE.split()[:20]))],
        "item_id long, text string",
    )
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(d, i) for d in (6, 7, 15) for i in (1, 5)} | {(d, 2) for d in (1, 2, None)} | {
        (d, 6) for d in (8, 9, 10)
    }
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {3, 4, 5, 11, 12, 13, 14, 15}
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(ROWS)


def test_decontamination_index_beyond_the_broadcast_bound(docs, spark, monkeypatch):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()} == {6, 7, 15}


def dice(text, template):
    a, b = licenses.bigrams(text), licenses.bigrams(template)
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) if a or b else 0.0


def closest(text):
    """Best coefficient of the line and of the windows at the anchors of templates, by
    licence, largest first."""
    words, out = re.findall(r"[^\W_]+", text.lower()), {}
    for name, template in ((name, t) for name, own in licenses.TEMPLATES.items() for t in own):
        size = sum(licenses.bigrams(template).values()) + 1
        starts = {i - j for j, mark in licenses.anchors(template) for i in range(len(words) - 1) if " ".join(words[i : i + 2]) == mark}
        windows = [words[s : s + size] for s in (max(0, min(s, len(words) - size)) for s in starts)]
        out[name] = max([out.get(name, 0.0), dice(text, template), *(dice(" ".join(w), template) for w in windows)])
    return sorted(out.values(), reverse=True)


def test_license_scan(spark, docs, empty):
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert rows[14]["license"] == "MIT" and rows[14]["dice"] == 1.0
    assert rows[3]["license"] is None and rows[11]["n_matches"] == 0
    assert licenses.scan_licenses(docs).count() == len(ROWS)
    assert licenses.scan_licenses(empty).count() == 0
    lines = [t for own in licenses.TEMPLATES.values() for t in own]
    lines += [t.rsplit(" ", 2)[0] + " changed ending" for t in lines] + ["the the the the", "of the"]
    some = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r["dice"] or 0.0 for r in licenses.scan_licenses(some).collect()}
    for k, line in enumerate(lines):
        best, second = closest(line)[:2]
        if best < 1 and best - second < licenses.MARGIN:
            assert got[k] <= best  # undecided between two licences
        else:
            assert got[k] == pytest.approx(best if best >= licenses.THRESHOLD else 0.0)


def test_local_search_packing(docs, empty):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t in ROWS]
    want = Counter()
    for (i, _), x in zip(ROWS, ids):
        for p, at in enumerate(range(0, len(x), 2048)):
            own = x[at : at + 2048]
            want[(i, p, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    got = packing.local_search_packing(docs).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    rows = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert rows.get(r["sequence_id"], 0) == r["offset"]
        rows[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(rows.values()) <= 2048
    assert len(rows) <= -(-sum(rows.values()) // 2048) + 1
    assert packing.local_search_packing(empty).count() == 0


def test_matrices_come_back_whole(docs, empty):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    packed = packing.packed_matrices(docs, row=256)
    assert all(len(r["ids"]) == 512 and r["cu_seqlens"][-1] == r["n_tokens"] <= 256 for r in packed.collect())
    parts = {}
    for r in packing.unpacked(packed).collect():
        parts.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for i, t in ROWS:
        if i not in (14, 15, None):
            whole = [x for _, ids in sorted(parts[i]) for x in ids]
            assert whole == tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
    assert packing.packed_matrices(empty).count() == 0


def test_best_fit_decreasing_is_what_it_says():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 300)
    space: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [c for c in space if c >= n]
        if fits:
            space[space.index(min(fits))] -= n
        else:
            space.append(100 - n)
    rows = packing.best_fit_decreasing(lengths, 100)
    assert sorted(100 - np.bincount(rows, weights=lengths)) == sorted(space)


def test_local_search_empties_rows():
    lengths = np.array([60, 60, 40, 40, 50, 50, 30, 70], np.int64)
    rows = packing.empty_rows([[0], [1], [2, 4], [3, 5], [6], [7]], lengths, 100)
    assert len(rows) == 4
    assert sorted(k for r in rows for k in r) == list(range(8))
    assert all(lengths[r].sum() <= 100 for r in rows)


def test_toxicity(spark, docs, empty):
    known = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    got = toxicity.toxicity_scores(known, labels)
    rows = got.collect()
    assert len(rows) == known.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert toxicity.toxicity_scores(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_toxicity_tells_planted_words():
    rng = np.random.default_rng(0)
    plain = [" ".join(f"w{x}" for x in rng.integers(0, 400, 120)) for _ in range(160)]
    texts = [t + " blorptoxic " * 2 + "tail" if k % 2 else t for k, t in enumerate(plain)]
    model = toxicity.fit(texts[:120], [k % 2 for k in range(120)], 1.0)
    one, two = toxicity.compressor(model.ordinary), toxicity.compressor(model.toxic)
    score = model.score(np.array([toxicity.features(t, one, two) for t in texts[120:]]))
    assert ((score >= 0.5) == (np.arange(40) % 2 == 1)).mean() >= 0.95
    assert toxicity.fit(["a"], [0]) is None


def test_language(spark):
    known = spark.read.parquet(f"{SF001}/documents.parquet")
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    got = language.identify(pages, known)
    rows = got.collect()
    assert len(rows) == pages.count()
    assert sum(r["lang"] == r["declared"] for r in rows) >= 0.9 * len(rows)
    odd = spark.createDataFrame(
        [(1, None, None), (2, "", ""), (3, "no url", "<html lang='fr'><p></p>"), (3, None, "<html lang='fr'>")],
        "page_id long, url string, html string",
    )
    assert language.identify(odd, known).count() == 4
    assert language.identify(pages.limit(0), known).count() == 0
    assert [r["lang"] for r in language.identify(odd, known.limit(0)).collect()] == [None] * 4


def test_pipeline(spark):
    import corpus_pipeline

    known = spark.read.parquet(f"{SF001}/documents.parquet")
    pieces = corpus_pipeline.run(spark, SF001)
    left = {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()}
    assert left <= {r["doc_id"] for r in known.select("doc_id").collect()}
    assert len(left) > 0.7 * known.count()
    docs = known
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF001).columns == known.columns, name


@pytest.mark.parametrize("ids", [[None] * 24, [7] * 24, list(range(24))])
def test_copies_list_each_run_once(spark, monkeypatch, ids):
    """Rows of equal text, under no doc_id, one or many: runs are those of one text."""
    written, plain = {}, common.materialize

    def counted(df, name):
        out = plain(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(common, "materialize", counted)
    rows = [(i, PASSAGE) for i in ids] + [(100, "some other words"), (101, f"unlike {PASSAGE[:-9]}")]
    got = rlz.duplicate_factors(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    words = [WORDS.findall(t) for _, t in rows]
    want = Counter((i, int(hit.sum())) for (i, _), hit in zip(rows, window_marks(words, 35)))
    assert Counter((r["doc_id"], r["n_removed"]) for r in got) == want
    assert written["work"] == 2
    assert all(n <= 2 * len(PASSAGE.split()) for name, n in written.items() if name.startswith("runs-"))


def test_language_models_every_labelled_language(spark):
    """Forty languages, the last the rarest and one of them with a long text only."""
    own = {f"l{k:02d}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}q" for x in "aeiouxyz"] for k in range(40)}
    known = [(100 * k + j, " ".join(w[j:] + w) * 3, lang) for k, (lang, w) in enumerate(own.items()) for j in range(1 + k % 5 + (k < 35))]
    known = [(i, t * 200 if lang == "l35" else t, lang) for i, t, lang in known]
    pages = [(k, None, f"<p>{' '.join(w * 20)}</p>") for k, w in enumerate(own.values())]
    got = language.identify(
        spark.createDataFrame(pages, "page_id long, url string, html string"),
        spark.createDataFrame(known, "doc_id long, text string, lang string"),
    ).collect()
    assert {r["page_id"]: r["text_lang"] for r in got} == dict(enumerate(own))
    assert {r["page_id"]: r["lang"] for r in got} == dict(enumerate(own))


@pytest.mark.parametrize("ids", [[None] * 400, [7] * 400])
def test_equal_rows_are_dealt_to_all_groups(spark, monkeypatch, ids):
    """Copies under no doc_id or one: no group gets more than a few times its share."""
    monkeypatch.setattr(packing, "GROUP_BYTES", 1000)
    rows = spark.createDataFrame([(i, BASE[:100]) for i in ids], "doc_id long, text string").repartition(3)
    got = packing.local_search_packing(rows).collect()
    groups = Counter(r["sequence_id"] >> 24 for r in got)
    assert len(got) == 400 and len(groups) > 30 and max(groups.values()) < 40
    packed = packing.packed_matrices(rows).collect()
    groups = Counter()
    for r in packed:
        groups[r["sequence_id"] >> 24] += len(r["doc_ids"])
    assert sum(groups.values()) == 400 and len(groups) > 30 and max(groups.values()) < 40


@pytest.mark.parametrize("mark", ["#", " *", "//"])
def test_license_scan_parts_comments_at_bare_marks(spark, mark):
    """A header whose empty lines hold the comment mark is parted into paragraphs."""
    grant = licenses.TEMPLATES["GPL-3.0"][1].split()
    lines = [" ".join(grant[k : k + 12]) for k in range(0, len(grant), 12)]
    tail = "This program is distributed in the hope that it will be useful but without any warranty".split()
    text = "\n".join(f"{mark} {x}".rstrip() for x in ["Copyright someone", "", *lines, "", " ".join(tail[:8]), " ".join(tail[8:]) * 9])
    some = spark.createDataFrame([(1, text), (2, text.replace(f"\n{mark}\n", "\n\n"))], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["dice"], r["n_matches"]) for r in licenses.scan_licenses(some).collect()}
    assert got[1] == got[2] and got[1][:2] == ("GPL-3.0", 1.0)
    units = {(r["did"], r["unit"]) for r in licenses.license_matches(some).filter("dice = 1").collect()}
    assert {(1, "paragraph"), (2, "paragraph"), (1, "window")} <= units


def test_license_scan_tells_kin_apart(spark):
    """GPL versions, LGPL, AGPL, BSD with and without its third condition, also inside
    longer text; a BSD opening alone names none."""
    own, fill = licenses.TEMPLATES, "some other words that belong to no licence at all " * 3
    cases = [(name, text) for name, texts in own.items() for text in texts]
    rows = [(k, text) for k, (_, text) in enumerate(cases)]
    rows += [(100 + k, f"{fill}{text} {fill}") for k, (_, text) in enumerate(cases)]
    rows += [(200 + k, fill + "\n" + "\n\n".join(text.split(". "))) for k, (_, text) in enumerate(cases)]
    rows += [(300, own["BSD-2-Clause"][0][:140]), (301, fill), (302, fill * 2000 + own["ISC"][0])]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (name, _) in enumerate(cases):
        assert got[k]["license"] == got[100 + k]["license"] == name, name
        assert got[k]["dice"] == got[100 + k]["dice"] == 1.0
        assert got[200 + k]["license"] == name
    assert got[300]["license"] is None and got[301]["n_matches"] == 0 and got[302]["license"] == "ISC"


def test_columns_named_like_ours_come_back_untouched(spark, docs):
    extra = {n: F.lit(7) for n in ("__text", "__score", "score", "scored_text", "__sha", "__id", "sha", "own_id", "keep", "k", "of")}
    rows = docs.withColumns(extra)
    labels = spark.createDataFrame([(8, 1), (9, 0), (11, 0), (1, 1)], "doc_id long, toxic int")
    for out in (toxicity.drop_toxic(rows, labels), exact.drop_copies(rows), minhash.drop_near_copies(rows)):
        assert out.columns == rows.columns
        assert out.select(*extra).distinct().collect() == [(7,) * len(extra)]


def test_rows_that_share_a_doc_id_are_one_in_the_fit(spark):
    docs = spark.createDataFrame([(8, f"some words {k}") for k in range(300)] + [(9, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(8, 1), (8, 1), (9, 0)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit
    toxicity.fit = lambda texts, y, odds: seen.append((len(texts), sorted(y))) or fit(texts, y, odds)
    try:
        toxicity.learn(docs, labels)
    finally:
        toxicity.fit = fit
    assert seen == [(2, [0, 1])]


def test_pairs_that_many_tasks_leave_over_are_few_files(spark, monkeypatch):
    """Every file costs processes beside the executor's JVM; ten tasks' pairs are one file."""
    sets = [np.sort(np.unique(np.arange(k, k + 300, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) for k in (0, 1, 5000)]
    reps = spark.createDataFrame(
        [(k, len(s), bytearray(minhash.signature(s).tobytes())) for k, s in enumerate(sets)], "sid long, n long, sig binary"
    )
    made = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "sid long, shingles binary")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)] * 20, "a long, b long").repartition(10)
    files, write = {}, common.materialize

    def seen(df, name, *more, **named):
        out = write(df, name, *more, **named)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(common, "materialize", seen)
    assert Counter(map(tuple, minhash.verified(pairs, reps, made).collect())) == {(0, 1): 20}
    assert files == {"likely": 1, "links": 1}


def test_token_ids_need_little_memory_beside_the_texts():
    """A worker holds the JVM's limit with others: 2 MB of words and then of rare ones."""
    path, rng = packing.tokenizer_path(), np.random.default_rng(3)
    rare = [" ".join(f"q{x:x}" for x in rng.integers(0, 1 << 40, 1_000)) for _ in range(150)]
    data, ends = common.utf8(pa.array([LONG] * 40 + rare))
    names._POWERS.clear()
    tokens.load.cache_clear()
    tokens.load(path)
    tracemalloc.start()
    try:
        n = sum(len(ids) for _, ids, _ in tokens.encode(data, ends, path, 0))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    one = Tokenizer.from_file(path)
    assert n == 40 * len(one.encode(LONG).ids) + sum(len(one.encode(t).ids) for t in rare) + 190
    assert peak < 90e6


def test_token_ids_of_letters_and_marks_equal_the_tokenizer(monkeypatch):
    """Pieces cut on bytes, in groups and with a cache that fills up."""
    path, rng = packing.tokenizer_path(), np.random.default_rng(5)
    parts = ["the", "The", "ÉTÉ", "niño", "×", "÷", "ÿ", "ß", "İ", "Σς", "e\u0301", "E\u0301", "ŵ", "ª", "漢字", "\u00a0", "\x1c", "7", "20", "É", "À",
             "'s", "'S", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|>", ".", "!!", "%%%", "-", "_", "(", " ", "  ", "\n", "", "x", "LL", "'ll"]
    texts = ["".join(rng.choice(parts, n)) for n in rng.integers(0, 40, 400)] + ["a", ".b", "C", "É", "é", "", LONG]
    monkeypatch.setattr(tokens, "GROUP", 500)
    monkeypatch.setattr(tokens, "CACHE", 300)
    data, ends = common.utf8(pa.array(texts))
    got = [ids[x:y].tolist() for _, ids, cuts in tokens.encode(data, ends, path, None) for x, y in zip(cuts, cuts[1:])]
    one = Tokenizer.from_file(path)
    assert got == [one.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_ids_know_a_piece_however_it_is_marked(monkeypatch):
    """New words reach the tokenizer as pieces: alike but for case and marks, once."""
    path, rng = packing.tokenizer_path(), np.random.default_rng(6)
    plain = ["".join(rng.choice(list("abcdeéñ"), 9)) for _ in range(300)]
    data, ends = common.utf8(pa.array([" ".join(f(w) for w in plain) for f in (str, str.upper, "{}%%%".format, "({}),".format)]))
    lookup = tokens.load(path)
    lookup._forget()
    monkeypatch.setattr(lookup, "_alone", None)
    assert sum(len(ids) for _, ids, _ in tokens.encode(data, ends, path, 0))
    assert len(lookup._codes) == len(set(plain)) + 3
