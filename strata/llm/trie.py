"""Prefix trie of conversations, its subtree sums by an Euler tour.

1. Turns are numbered and reduced to hashes.  A prefix is named by the exclusive or of
   the 128-bit hashes of its (position, turn): a running aggregate, so a prefix of any
   length has a name of one size.  A node is a distinct prefix; (smallest member,
   depth) is unique to it.
2. Euler tour: every node has an enter and an exit arc.  An arc's successor follows
   from the node's first child, its next sibling or its parent.
3. List ranking: arcs are first joined to chains within groups of close conversation
   ids and depths, which are bounded in size; the few chains that are left are ranked
   by pointer doubling over joins.  An arc's position is its chain's and its own in it.
4. A node's subtree is what lies between its two arcs: sums over it are differences of
   prefix sums at the two positions, taken by blocks of positions.

Groups that may be hot (the children of a node, the members that end at one, the turns
of a conversation) are handled in bounded chunks, and a chunk table joins them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm import common

CHUNK = 4096  # turns, siblings or ids in a chunk, about
SIDE, DEEP = 10, 6  # a group of arcs: 2**SIDE conversation ids, 2**DEEP depths
POSITIONS = 1 << 16  # positions in a block of the prefix sums

KEY = ["depth", "k1", "k2"]


# --- turns -------------------------------------------------------------------------
def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(c, p, t1, t2, bytes): of every turn its conversation, its place from 1 in the
    order of turn (nulls first; equal turns by role, then text), a 128-bit hash of role
    and text, and the text's UTF-8 bytes.  Null roles and texts are empty; rows without
    a conv_id belong to no conversation and go."""
    role, text = (F.coalesce(conversations[n].cast("string"), F.lit("")) for n in ("role", "text"))
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("c"), conversations["turn"].cast("long").alias("turn"),
        role.alias("role"), text.alias("text"),
    ).filter("c is not null")
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**63)))
    rows = rows.withColumn("chunk", chunk.cast("long"))
    counts = rows.groupBy("c", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("c", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("c", "chunk").orderBy(F.asc_nulls_first("turn"), "role", "text")
    own = rows.select(
        "c", "chunk", F.row_number().over(order).alias("own"),
        F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "text", "role").alias("t2"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    found = own.join(counts, ["c", "chunk"])
    return found.select("c", (F.col("before") + F.col("own")).cast("long").alias("p"), "t1", "t2", "bytes")


def shared_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of conversations rebuilt so that they share openings: c has the
    first h turns of conversation c - c % 5, h = crc32(c) % 9, then its own after its
    first h.  members: (c, length), also of those that are left without a turn."""
    lengths = turns.groupBy("c").agg(F.max("p").alias("n"))
    convs = lengths.select(
        "c", "n", (F.col("c") - F.col("c") % 5).alias("base"), (F.crc32(F.col("c").cast("string")) % 9).alias("h")
    )
    of_base = lengths.select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(of_base, "base", "left").select("c", "base", "h", "n", taken.alias("taken"))
    convs = common.materialize(convs, "convs")
    opening = turns.filter("p <= 8").withColumnRenamed("c", "base")
    first = convs.select("c", "base", "h").join(opening, "base").filter("p <= h").select("c", "p", "t1", "t2", "bytes")
    rest = turns.join(convs.select("c", "h", "taken"), "c").filter("p > h")
    rest = rest.select("c", (F.col("p") - F.col("h") + F.col("taken")).alias("p"), "t1", "t2", "bytes")
    members = convs.select("c", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return first.union(rest), members


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, depth, k1, k2, q1, q2, bytes): every prefix of every conversation, its name
    (k1, k2), the name without its last turn and the bytes of that turn's text."""
    rows = turns.select(
        "c", "p", F.floor((F.col("p") - 1) / CHUNK).alias("chunk"), "bytes",
        F.xxhash64("p", "t1", "t2").alias("e1"), F.xxhash64("t2", F.lit(3), "p", "t1").alias("e2"),
    )
    order = Window.partitionBy("c", "chunk").orderBy("p")
    within = rows.select(
        "c", "chunk", "p", "bytes", "e1", "e2",
        F.bit_xor("e1").over(order).alias("x1"), F.bit_xor("e2").over(order).alias("x2"),
    )
    totals = rows.groupBy("c", "chunk").agg(F.bit_xor("e1").alias("e1"), F.bit_xor("e2").alias("e2"))
    before = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "c", "chunk",
        F.coalesce(F.bit_xor("e1").over(before), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("e2").over(before), F.lit(0)).alias("b2"),
    )
    both = within.join(totals, ["c", "chunk"])
    k1, k2 = F.col("x1").bitwiseXOR(F.col("b1")), F.col("x2").bitwiseXOR(F.col("b2"))
    return both.select(
        "c", F.col("p").alias("depth"), k1.alias("k1"), k2.alias("k2"),
        k1.bitwiseXOR(F.col("e1")).alias("q1"), k2.bitwiseXOR(F.col("e2")).alias("q2"), "bytes",
    )


# --- nodes -------------------------------------------------------------------------
def nodes_of(paths: DataFrame, members: DataFrame) -> DataFrame:
    """(depth, k1, k2, q1, q2, conv_id, n_convs, bytes, n_children), the root included."""
    named = paths.groupBy(*KEY).agg(
        F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("c").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"),
    )
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    root = members.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("q1"), none.alias("q2"),
        "conv_id", "n_convs", zero.alias("bytes"),
    )
    found = common.materialize(named.unionByName(root), "prefix-nodes")
    children = found.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    out = found.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return common.materialize(out, "nodes")


def linked_nodes(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, sibling, first_child, leaf, saved): siblings are
    ordered by chunk, then conv_id, where ids that are close share a chunk and a chunk
    has about CHUNK of them, however many children a node has."""
    parent = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"),
        F.col("conv_id").alias("parent_conv_id"), F.ceil(F.col("n_children") / CHUNK).alias("chunks"),
    )
    child = nodes.select("depth", "q1", "q2", "conv_id").join(parent, ["depth", "q1", "q2"])
    close = F.xxhash64(F.floor(F.col("conv_id") / CHUNK))
    child = child.select("parent_conv_id", "depth", "conv_id", F.pmod(close, F.col("chunks")).alias("chunk"))
    child = common.materialize(child, "children")
    family = ["parent_conv_id", "depth"]
    heads = child.groupBy(*family, "chunk").agg(F.min("conv_id").alias("head"))
    order = Window.partitionBy(*family).orderBy("chunk")
    heads = common.materialize(
        heads.select(
            *family, "chunk", "head", F.lead("head").over(order).alias("after"), F.row_number().over(order).alias("k")
        ),
        "chunks",
    )
    within = Window.partitionBy(*family, "chunk").orderBy("conv_id")
    siblings = child.withColumn("next", F.lead("conv_id").over(within)).join(
        heads.drop("head", "k"), [*family, "chunk"]
    )
    siblings = siblings.select("conv_id", "depth", "parent_conv_id", F.coalesce("next", "after").alias("sibling"))
    first = heads.filter("k = 1").select(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.col("head").alias("first_child")
    )
    out = nodes.select(
        "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    out = out.join(siblings, ["conv_id", "depth"], "left").join(first, ["conv_id", "depth"], "left")
    return common.materialize(out, "linked")


# --- the tour ----------------------------------------------------------------------
def tour_arcs(linked: DataFrame) -> DataFrame:
    """(c, x, nc, nx, leaf, saved): arc x of node (c, depth) is 2 * depth for entering
    and one more for leaving; (nc, nx) follows it, nothing follows the root's exit.
    The node's own values stand on its enter arc."""
    d = F.col("depth") * 2
    last = F.col("sibling").isNull()
    enter = F.struct(
        d.alias("x"), F.coalesce("first_child", "conv_id").alias("nc"),
        F.when(F.col("first_child").isNull(), d + 1).otherwise(d + 2).alias("nx"), "leaf", "saved",
    )
    leave = F.struct(
        (d + 1).alias("x"), F.coalesce("sibling", "parent_conv_id").alias("nc"),
        F.when(~last, d).when(F.col("parent_conv_id").isNotNull(), d - 1).alias("nx"),
        F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"),
    )
    return linked.select(F.col("conv_id").alias("c"), F.inline(F.array(enter, leave)))


def _chainer(side: int, deep: int):
    def chains(table: pa.Table) -> pa.Table:
        """The arcs of one group with the head of their chain within the group and their
        place in it; a head also has its chain's length and the arc that follows it."""
        get = lambda n: table[n].to_numpy(zero_copy_only=False)
        c, x = get("c"), get("x")
        n = len(c)
        ends = table["nc"].is_null().to_numpy(zero_copy_only=False)
        nc, nx = (table[k].fill_null(0).to_numpy(zero_copy_only=False) for k in ("nc", "nx"))
        place = lambda a, b: ((a & ((1 << side) - 1)) << (deep + 1)) | (b & ((2 << deep) - 1))
        where = np.full(1 << (side + deep + 1), -1)
        where[place(c, x)] = np.arange(n)
        inside = ~ends & (nc >> side == c >> side) & (nx >> (deep + 1) == x >> (deep + 1))
        head, off = np.arange(n), np.zeros(n, np.int64)
        follows = np.flatnonzero(inside)
        head[where[place(nc[follows], nx[follows])]] = follows
        off[head != np.arange(n)] = 1
        while True:
            further = head[head]
            if (further == head).all():
                break
            off, head = off + off[head], further
        tail = np.flatnonzero(~inside)
        size, after_c, after_x, last = (np.zeros(n, np.int64) for _ in range(4))
        size[head[tail]] = off[tail] + 1
        after_c[head[tail]], after_x[head[tail]], last[head[tail]] = nc[tail], nx[tail], ends[tail]
        none = (off > 0) | (last > 0)
        return pa.table(
            {
                "c": c, "x": x, "leaf": table["leaf"], "saved": table["saved"],
                "hc": c[head], "hx": x[head], "off": off, "size": size,
                "nc": pa.array(after_c, mask=none), "nx": pa.array(after_x, mask=none),
            }
        )

    return chains


def ranked_chains(chains: DataFrame) -> DataFrame:
    """(c, x, left): how many arcs there are from a chain's head to the tour's end, by
    pointer doubling: each round every chain looks over twice as many as before."""
    now = common.materialize(chains.filter("off = 0").select("c", "x", "nc", "nx", F.col("size").alias("left")), "ranks")
    while not now.filter("nc is not null").isEmpty():
        done = now.filter("nc is null")
        ahead = now.select(
            F.col("c").alias("nc"), F.col("x").alias("nx"), F.col("nc").alias("nc2"), F.col("nx").alias("nx2"),
            F.col("left").alias("more"),
        )
        jumped = now.filter("nc is not null").join(ahead, ["nc", "nx"]).select(
            "c", "x", F.col("nc2").alias("nc"), F.col("nx2").alias("nx"), (F.col("left") + F.col("more")).alias("left")
        )
        before, now = now, common.materialize(done.unionByName(jumped), "ranks")
        common.discard(before)
    return now.select("c", "x", "left")


def tour_positions(linked: DataFrame) -> DataFrame:
    """(c, x, pos, leaf, saved): the position of every arc in the Euler tour, from 0."""
    arcs = tour_arcs(linked).withColumn("gc", F.shiftright("c", SIDE)).withColumn("gd", F.shiftright("x", DEEP + 1))
    chains = common.materialize(
        arcs.groupBy("gc", "gd").applyInArrow(
            _chainer(SIDE, DEEP),
            "c long, x long, leaf long, saved long, hc long, hx long, off long, size long, nc long, nx long",
        ),
        "chains",
    )
    ranks = ranked_chains(chains)
    total = ranks.agg(F.max("left")).first()[0] or 0
    heads = ranks.select(F.col("c").alias("hc"), F.col("x").alias("hx"), "left")
    pos = F.lit(total) - F.col("left") + F.col("off")
    return chains.join(heads, ["hc", "hx"]).select("c", "x", pos.alias("pos"), "leaf", "saved")


def subtree_sums(positions: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) from prefix sums over the tour."""
    rows = positions.withColumn("block", F.floor(F.col("pos") / POSITIONS))
    rows = common.materialize(rows, "positions")
    totals = rows.groupBy("block").agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    totals = totals.select(
        "block", F.coalesce(F.sum("l").over(before), F.lit(0)).alias("l0"),
        F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"),
    )
    running = Window.partitionBy("block").orderBy("pos")
    at = rows.select(
        "block", "c", "x", "leaf", "saved",
        F.sum("leaf").over(running).alias("l"), F.sum("saved").over(running).alias("s"),
    ).join(totals, "block")
    enter = F.col("x") % 2 == 0
    side = lambda own, sum_, start: F.sum(
        F.when(enter, F.col(own) - F.col(sum_) - F.col(start)).otherwise(F.col(sum_) + F.col(start))
    )
    return at.groupBy(F.col("c").alias("conv_id"), F.floor(F.col("x") / 2).alias("depth")).agg(
        side("leaf", "l", "l0").alias("n_leaves"), side("saved", "s", "s0").alias("saved_tokens")
    )


# --- members that end at a node ------------------------------------------------------
def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each run of rows of a node, over its chunks of ids in their order."""
    names, out, now, state = [*KEY, "sha"], [], None, None
    for batch in batches:
        for *key, ids in zip(*(batch[n].to_pylist() for n in (*KEY, "ids"))):
            if key != now:
                if state is not None:
                    out.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out)], names=names)
            out = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, state.hexdigest())], names=names)


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, sha): SHA-256 of the ids c, in order and joined by commas, of the
    conversations that end at each node.  Ids are joined in chunks first, which bounds
    what is gathered and leaves one row in CHUNK for the node that many end at."""
    parts = ends.groupBy(*KEY, F.floor(F.col("c") / CHUNK).alias("chunk")).agg(
        F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids")
    )
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, *KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids").mapInArrow(
        _hash_runs, "depth long, k1 long, k2 long, sha string"
    )


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations given as turns (c, p, t1, t2, bytes)
    and members (c, length): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256."""
    common.prepare(turns.sparkSession)
    paths = common.materialize(prefixes(turns), "paths")
    nodes = nodes_of(paths, members)
    linked = linked_nodes(nodes)
    sums = subtree_sums(tour_positions(linked))
    zero = F.lit(0).cast("long")
    last = paths.join(members.withColumnRenamed("length", "depth"), ["c", "depth"]).select(*KEY, "c")
    empty = members.filter("length = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "c")
    ends = end_hashes(last.union(empty))
    own = ["conv_id", "depth"]
    out = nodes.join(ends, KEY, "left").join(linked.select(*own, "parent_conv_id"), own).join(sums, own)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of ``conversations`` (conv_id, turn, role, text) as they are.

    Turns are ordered by turn, nulls first, then role and text where turns repeat (equal
    rows are so many turns); null roles and texts are empty; rows without a conv_id go.
    The root has depth 0, no parent and every conversation as a member.  An empty table
    gives no rows; other columns are not read.
    """
    turns = common.materialize(numbered_turns(conversations), "turns")
    return prefix_trie(turns, turns.groupBy("c").agg(F.max("p").alias("length")))


def shared_conversation_trie(conversations: DataFrame) -> DataFrame:
    """As :func:`conversation_trie`, of conversations rebuilt by :func:`shared_openings`;
    those left without a turn are members of the root and end there."""
    turns, members = shared_openings(common.materialize(numbered_turns(conversations), "turns"))
    return prefix_trie(common.materialize(turns, "rebuilt"), common.materialize(members, "members"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: prefix trie of all conversations, rebuilt to share openings."""
    return shared_conversation_trie(common.table(spark, sf_dir, "conversations"))


#: Prefixes as strings of hashes of equal length; a subtree is all nodes that start so.
ORACLE = """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, count(*) AS n, c - c % 5 AS base, xor(list_reduce(
      list_concat([4294967295::UBIGINT],
                  list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)),
      lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0],
                               lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))
    ), 4294967295::UBIGINT)::BIGINT % 9 AS h
  FROM turns GROUP BY c
), whole AS (
  SELECT v.c, v.h, v.base, v.n, least(v.h, coalesce(b.n, 0)) AS taken FROM convs v LEFT JOIN convs b ON b.c = v.base
), built AS (
  SELECT w.c, t.p, t.role, t.text FROM whole w JOIN turns t ON t.c = w.base AND t.p <= w.h
  UNION ALL
  SELECT w.c, t.p - w.h + w.taken, t.role, t.text FROM whole w JOIN turns t ON t.c = w.c AND t.p > w.h
), paths AS (
  SELECT c, p, octet_length(encode(text)) AS bytes,
         string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY p) AS name
  FROM built
), ended AS (
  SELECT name, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (
    SELECT w.c, coalesce(p.name, '') AS name
    FROM whole w LEFT JOIN paths p ON p.c = w.c AND p.p = w.taken + greatest(w.n - w.h, 0)
  ) GROUP BY name
), nodes AS (
  SELECT name, p AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM paths GROUP BY name, p
  UNION ALL SELECT '', 0, min(c), count(*), 0 FROM whole HAVING count(*) > 0
), family AS (
  SELECT a.name, count(*) FILTER (b.depth = a.depth + 1) AS n_children,
         sum((b.n_convs - 1) * b.bytes) AS saved_tokens
  FROM nodes a JOIN nodes b ON starts_with(b.name, a.name) GROUP BY a.name
)
SELECT a.conv_id, a.depth, up.conv_id AS parent_conv_id, a.n_convs, f.n_children,
       (SELECT count(*) FROM nodes b JOIN family g ON g.name = b.name
        WHERE starts_with(b.name, a.name) AND g.n_children = 0) AS n_leaves,
       f.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes a JOIN family f ON f.name = a.name
LEFT JOIN nodes up ON a.depth > 0 AND up.name = left(a.name, length(a.name) - 64)
LEFT JOIN ended e ON e.name = a.name
"""
