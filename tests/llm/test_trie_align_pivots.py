"""Conversation trie, cross-tokenizer alignment and embedding near-dedup against
brute force: nulls, ties, repeated rows, empty tables, clashing columns, long texts."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strata.llm import align, common, pivots, trie
from tests.conftest import SF01, SF001


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# --- conversation trie -----------------------------------------------------------
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows, rebuilt):
    conv = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [v[2:] for v in sorted(vs)] for c, vs in conv.items()}
    if rebuilt:
        cut = {c: zlib.crc32(str(c).encode()) % 9 for c in conv}
        conv = {c: conv.get(c - c % 5, [])[: cut[c]] + v[cut[c]:] for c, v in conv.items()}
    members, ends, kids = (collections.defaultdict(list) for _ in range(3))
    for c, v in conv.items():
        for d in range(len(v) + 1):
            if d and tuple(v[:d]) not in members:
                kids[tuple(v[: d - 1])].append(tuple(v[:d]))
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = [
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest())
        for k, m in members.items()
    ]
    return sorted(out, key=str)


def odd_conversations():
    rng = random.Random(2)
    rows = [
        (rng.randrange(60) * rng.choice([1, 1, 1000003]), rng.choice([None, *range(11), 5000, 9000]),
         rng.choice(["user", "bot", None]), rng.choice([None, "", "a", "b", "é日"]))
        for _ in range(500)
    ]
    return rows + [(None, 1, "user", "x"), (7, None, None, None)] + [
        (1000 + k, t, "user", f"t{t}") for k in range(200) for t in range(12)  # many equal ones
    ]


@pytest.fixture(scope="module")
def conversations(spark):
    df = spark.createDataFrame(odd_conversations(), "conv_id long, turn int, role string, text string")
    return df.selectExpr("*", "turn as c", "text as k1", "1 as depth")


@pytest.mark.parametrize("small", [False, True])
def test_trie_equals_brute_force(conversations, monkeypatch, small):
    if small:  # every chunk and group has a few rows
        for name, value in (("CHUNK", 4), ("SIDE", 2), ("DEEP", 1), ("POSITIONS", 16)):
            monkeypatch.setattr(trie, name, value)
    got = rows_of(trie.shared_conversation_trie(conversations), *TRIE)
    assert got == brute_trie(odd_conversations(), True)


def test_trie_of_conversations_as_they_are(conversations):
    assert rows_of(trie.conversation_trie(conversations), *TRIE) == brute_trie(odd_conversations(), False)
    assert trie.shared_conversation_trie(conversations.limit(0)).collect() == []


def test_trie_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF001}/conversations.parquet')")
    res = con.execute(trie.ORACLE)
    names = [d[0] for d in res.description]
    want = sorted((tuple(r[names.index(n)] for n in TRIE) for r in res.fetchall()), key=str)
    assert rows_of(trie.query(spark, SF001), *TRIE) == want


# --- alignment ---------------------------------------------------------------------
ALIGN = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    (1, "x"), (2, None), (3, ""), (4, " "), (5, "  a  b\n\n\tc "), (6, "<|endoftext|> <s> </s> <unk>"),
    (7, "日本語のテキスト 🎉 é\u0000 ▁ x"), (8, "日本語のテキスト 🎉🎉 ẞß"), (9, "a" * 5000 + " " * 3000 + "b"), (9, "x"),
    (None, "Ünïcödé Straße žluťoučký kůň " * 40), (11, "​　 nbsp "), (12, "\r\n\r\n"),
    (13, "It's 1234567 tokens' ends; don't\ncut here. " * 30),
]


def brute_alignment(rows):
    a = Tokenizer.from_file(public_tokenizers.path(align.A_FILE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.B_FILE))
    alphabet = align._byte_alphabet()
    found, docs = [], collections.Counter()
    for i, text in rows:
        text = text or ""
        ia = a.encode(" " + text, add_special_tokens=False)
        ib = b.encode(text)
        ta = [bytes(alphabet[c] for c in t) for t in ia.tokens]
        tb = [bytes([int(b.id_to_piece(x)[3:-1], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ib]
        if not text or b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            found.append((i, 0, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
        x = y = 0
        links, parts = [], []
        for cut in sorted(set(ends_a) & set(ends_b)):
            x1, y1 = ends_a.index(cut, x) + 1, ends_b.index(cut, y) + 1
            ga, gb = ia.ids[x:x1], ib[y:y1]
            parts.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            links += [(p, q) for p in ga for q in gb]
            x, y = x1, y1
        docs.update(set(links))
        found.append((i, len(ta), len(tb), len(parts), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    best = collections.Counter()
    for (p, _), n in docs.items():
        best[p] = max(best[p], n)
    return sorted(
        ((i, na, nb, ng, len(ls), sum(docs[k] == best[k[0]] for k in ls), sum(docs[k] for k in ls), sha)
         for i, na, nb, ng, ls, sha in found), key=str)


@pytest.mark.parametrize("hot", [None, 20])
def test_alignment_equals_brute_force(spark, monkeypatch, hot):
    if hot:  # most pairs are looked up by the shuffled join
        monkeypatch.setattr(align, "HOT", hot)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "1 as row", "text as links", "2 as n_a")
    assert rows_of(align.alignment_counts(docs), *ALIGN) == brute_alignment(TEXTS)


def test_alignment_of_real_texts_and_of_none(spark):
    docs = common.documents(spark, SF01).filter("doc_id % 41 = 3")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(align.alignment_counts(docs), *ALIGN) == brute_alignment(texts)
    assert align.alignment_counts(docs.limit(0)).collect() == []


def test_shared_cuts_are_the_common_ends():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b, first, total = [], [], [0], 0
        for _ in range(rng.integers(1, 4)):
            size = int(rng.integers(1, 60))
            pick = lambda: sorted({*rng.integers(1, size + 1, rng.integers(0, 30)).tolist(), size})
            a += [total + e for e in pick()]
            b += [total + e for e in pick()]
            total += size
            first.append(len(a))
        in_a, in_b = align.shared_cuts(np.array(a), np.array(b), np.array(first))
        common_ends = sorted(set(a) & set(b))
        assert [a[k] for k in in_a] == [b[k] for k in in_b] == common_ends


def test_a_long_group_without_cuts_counts_all_links(monkeypatch):
    monkeypatch.setattr(align, "LINKS", 10)
    ida, idb = np.array([1, 1, 2, 3] * 5), np.array([4, 5, 5] * 4)
    one = np.array([0])
    keys, times = align._links(ida, idb, one, one, np.array([20]), np.array([12]), one, 10, 20)
    want = collections.Counter(int(x) * 10 + int(y) for x in ida for y in idb)
    assert dict(zip(keys.tolist(), times.tolist())) == want


# --- embeddings --------------------------------------------------------------------
VECTORS = ["vec_id", "n_links", "component_id", "kept"]


def brute_vectors(rows, cosine=0.9):
    good = [k for k, (i, e) in enumerate(rows) if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, up = collections.Counter(), {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    unit = {k: np.array(rows[k][1], np.float64) / np.linalg.norm(np.array(rows[k][1], np.float64)) for k in good}
    for x in good:
        for y in good:
            if x != y and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= cosine:
                links[x] += 1
                p, q = top(rows[x][0]), top(rows[y][0])
                up[max(p, q)] = min(p, q)
    return sorted(((i, links[k], None if i is None else top(i), i is None or top(i) == i) for k, (i, _) in enumerate(rows)), key=str)


def odd_vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    rows = [(k, (base[k % 60] + rng.normal(size=8) * 0.1 * (k % 3)).astype(np.float32).tolist()) for k in range(200)]
    return rows + [
        (500, None), (501, []), (502, [0.0] * 8), (503, [1.0, None] + [0.0] * 6), (504, [float("nan")] * 8),
        (None, rows[0][1]), (505, rows[0][1]), (506, rows[0][1]), (7, rows[9][1]), (7, rows[9][1]), (507, [1.0, 2.0]),
        (508, [2.0, 4.0]), (509, [-0.0, 3.0]), (510, [0.0, 3.0]), (511, [float("inf")] * 8), (150, rows[30][1]),
        (512, [1e-30] * 8), (513, [3e30] * 8),
    ]


@pytest.mark.parametrize("block", [None, 16])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    if block:  # lists are dealt to many blocks
        monkeypatch.setattr(pivots, "BLOCK", block)
    df = spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<float>")
    df = df.selectExpr("*", "vec_id as cid", "embedding as vec", "1 as d1", "2 as rep")
    assert rows_of(pivots.near_duplicate_vectors(df), *VECTORS) == brute_vectors(odd_vectors())
    assert pivots.near_duplicate_vectors(df.limit(0)).collect() == []


def test_recall_of_the_index_at_the_threshold(spark):
    """Pairs just above the threshold, the hardest to find: at least nine in ten."""
    rng = np.random.default_rng(5)
    one = rng.normal(size=(600, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other = rng.normal(size=one.shape)
    other -= (other * one).sum(axis=1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    two = 0.905 * one + np.sqrt(1 - 0.905**2) * other
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate((one, two)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    linked = pivots.near_duplicate_vectors(df).filter("n_links > 0").count()
    assert linked >= 0.9 * len(rows)
