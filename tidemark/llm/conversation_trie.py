"""Tries of conversations: one node for each distinct sequence of first turns.

A turn is its content's 128-bit digest, a node the exclusive or of its turns' digests, each hashed with its position, so
running values tell nodes apart without texts. Nodes are hash-partitioned by the digest of their first turn; in each part
a dictionary trie with pointers is built and walked in iterative postorder. A first-turn subtrie over the limit is
repartitioned by its next turn that branches, again and again; the turns before, which all of it shares, are a chain that
sums of what hangs below it are added to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import ranges
from .common import materialize, partitions

#: Nodes of a subtrie that one task may build. Smaller inputs are split at twice a partition's share of the nodes.
NODES, LEAST_NODES = 200_000, 256
#: Ids that are joined into one piece of text before they meet.
CHUNK = 65_536
#: Of a conversation's first turns, those that may come from another one.
BORROWED = 5

#: Columns of nodes: p is the digest of the node, u of its parent, k of the top of its subtrie; up is the top's parent's conv_id.
_BUILT = "p1 long, p2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean, k1 long, k2 long"


def _longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, x1, x2, chars): turns without their texts. Rows without a conv_id belong to no conversation and are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("r"), text.alias("t")).filter("conv_id is not null")
    return own.select("conv_id", "turn", F.xxhash64("r", "t").alias("x1"), F.xxhash64(F.lit("second"), "t", "r").alias("x2"), F.length("t").cast("long").alias("chars"))


def numbered(turns: DataFrame) -> DataFrame:
    """turns with their position from 1: by turn, null first; equal turns by content's digest."""

    def local(table, starts, state):
        pos = np.arange(1, len(starts) + 1) - ranges.run_start(starts)
        if state and not starts[0]:
            pos[: ranges.first_run(starts)] += state["pos"]
        return {"pos": pos}

    more = lambda a, b: {"pos": a["pos"] + b["pos"]}
    return ranges.scan(turns, ["conv_id"], ["turn", "x1", "x2"], ranges.State(_longs("pos"), local, more, lambda c: {"pos": F.col("pos") + F.coalesce(c("pos"), F.lit(0))}), name="numbered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns whose first h turns, h = crc32(id) % 6, are those of conversation id - id % 100 instead, and (conv_id, n_turns).

    The one borrowed from lends its own first turns to at most 100 ids, so no key grows; what it hasn't is left out.
    """
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    known = lengths.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 100).alias("lender"), (F.crc32(F.col("conv_id").cast("string")) % (BORROWED + 1)).alias("h"))
    self_lent = F.col("conv_id") == F.col("lender")
    lent = lengths.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("lender"), F.col("n").alias("m"))
    m = F.least("h", F.coalesce("m", F.lit(0)))
    known = known.join(lent, "lender", "left").select(
        "conv_id", "lender", F.when(self_lent, 0).otherwise(F.col("h")).alias("h"), F.when(self_lent, 0).otherwise(F.col("h") - m).alias("shift"),
        F.when(self_lent, F.col("n")).otherwise(m + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"),
    )
    known = materialize(known, "rebuilt")
    own = turns.join(known, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("shift")).alias("pos"), "x1", "x2", "chars", "n_turns")
    first = turns.filter(f"conv_id % 100 = 0 and pos <= {BORROWED}").select(F.col("conv_id").alias("lender"), "pos", "x1", "x2", "chars")
    borrowed = known.filter("h > 0").join(first, "lender").filter("pos <= h").select("conv_id", "pos", "x1", "x2", "chars", "n_turns")
    return own.unionByName(borrowed), known.select("conv_id", "n_turns")


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, chars, n_turns, h1, h2, p1, p2): p is the node that a turn ends at, p xor h its parent."""

    def local(table, starts, state):
        out, at = {}, ranges.run_start(starts)
        for i in ("1", "2"):
            h = ranges.values(table, f"h{i}").astype(np.int64)
            upto = np.bitwise_xor.accumulate(h) if len(h) else h
            p = upto ^ (upto ^ h)[at]
            if state and not starts[0]:
                p[: ranges.first_run(starts)] ^= state[f"p{i}"]
            out[f"p{i}"] = p
        return out

    hashed = turns.select("conv_id", "pos", "chars", "n_turns", F.xxhash64("pos", "x1").alias("h1"), F.xxhash64("pos", "x2").alias("h2"))
    both = lambda a, b: {i: a[i] ^ b[i] for i in a}
    add = lambda c: {p: F.col(p).bitwiseXOR(F.coalesce(c(p), F.lit(0))) for p in ("p1", "p2")}
    return ranges.scan(materialize(hashed, "turns"), ["conv_id"], ["pos"], ranges.State(_longs("p1", "p2"), local, both, add), name="prefixes")


def _tries(nodes: pd.DataFrame) -> pd.DataFrame:
    """The nodes of whole subtries with what their subtrees hold: a dictionary from digests to nodes, pointers to children, postorder."""
    p = list(zip(nodes["p1"].tolist(), nodes["p2"].tolist(), strict=True))
    up = list(zip(nodes["u1"].tolist(), nodes["u2"].tolist(), strict=True))
    top = ((nodes["p1"] == nodes["k1"]) & (nodes["p2"] == nodes["k2"])).tolist()
    index = {key: i for i, key in enumerate(p)}
    parent = [-1 if t else index[u] for t, u in zip(top, up, strict=True)]
    children: list[list[int]] = [[] for _ in p]
    for i, j in enumerate(parent):
        if j >= 0:
            children[j].append(i)
    convs, chars, ids, above = nodes["n_convs"].tolist(), nodes["chars"].tolist(), nodes["conv_id"].tolist(), nodes["up"].tolist()
    leaves, saved = [0] * len(p), [(n - 1) * c for n, c in zip(convs, chars, strict=True)]
    for root in (i for i, t in enumerate(top) if t):
        stack = [(root, 0)]
        while stack:
            node, child = stack.pop()
            if child < len(children[node]):
                stack += [(node, child + 1), (children[node][child], 0)]
                continue
            leaves[node] = leaves[node] or 1
            if node != root:
                leaves[parent[node]] += leaves[node]
                saved[parent[node]] += saved[node]
    parents = [above[i] if j < 0 else ids[j] for i, j in enumerate(parent)]
    return nodes[["p1", "p2", "conv_id", "depth"]].assign(parent_conv_id=parents, n_convs=convs, n_children=[len(c) for c in children], n_leaves=leaves, saved_tokens=saved, top=top, k1=nodes["k1"], k2=nodes["k2"])


def _chain(trunk: DataFrame, below: DataFrame) -> DataFrame:
    """The shared turns of subtries that were split, given what hangs below each of them: (k1, k2, leaves, saved, n)."""

    def local(table, starts, state):
        w = (ranges.values(table, "n_convs").astype(np.int64) - 1) * ranges.values(table, "chars").astype(np.int64)
        upto = np.cumsum(w)
        held = upto - (upto - w)[ranges.run_start(starts)]
        if state and not starts[0]:
            held[: ranges.first_run(starts)] += state["held"]
        return {"held": held}

    more = lambda a, b: {"held": a["held"] + b["held"]}
    rows = ranges.scan(trunk, ["k1", "k2"], [F.col("depth").desc()], ranges.State(_longs("held"), local, more, lambda c: {"held": F.col("held") + F.coalesce(c("held"), F.lit(0))}), name="chain")
    parents = trunk.select(F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("conv_id").alias("parent"))
    rows = rows.join(below, ["k1", "k2"], "left").join(parents, ["u1", "u2"], "left")
    top = (F.col("p1") == F.col("k1")) & (F.col("p2") == F.col("k2"))
    last = F.col("depth") == F.col("ends")
    return rows.select(
        "p1", "p2", "conv_id", "depth", F.when(top, F.col("up")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs", F.when(last, F.coalesce("n", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.col("held") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"), top.alias("top"), "k1", "k2",
    )


def _subtries(level: DataFrame, prefixes: DataFrame, most: int | None) -> DataFrame:
    """All nodes below the root with what their subtrees hold. level: nodes with their first turn as k1, k2."""
    spark = level.sparkSession
    level = materialize(level, "nodes")
    total = level.count()
    most = most or min(NODES, max(LEAST_NODES, -(-2 * total // partitions(spark))))
    buckets = max(8 * partitions(spark), -(-4 * total // most))
    built, split = [], []
    while True:
        over = materialize(level.groupBy("k1", "k2").count().filter(F.col("count") > most), "over")
        some = bool(over.limit(1).count())
        small = level.join(over, ["k1", "k2"], "left_anti") if some else level
        built.append(materialize(small.withColumn("bucket", F.pmod(F.xxhash64("k1", "k2"), F.lit(buckets))).groupBy("bucket").applyInPandas(_tries, _BUILT), "tries"))
        if not some:
            break
        large = level.join(over.select("k1", "k2"), ["k1", "k2"])
        at = large.groupBy("k1", "k2", "depth").count().groupBy("k1", "k2").agg(F.min(F.when(F.col("count") > 1, F.col("depth"))).alias("branch"), F.max("depth").alias("deepest"))
        ends = at.select("k1", "k2", "branch", F.coalesce(F.col("branch") - 1, F.col("deepest")).alias("ends"))
        large = materialize(large.join(ends, ["k1", "k2"]), "large")
        trunk = large.filter("depth <= ends")
        last = trunk.filter("depth = ends").select("k1", "k2", F.col("conv_id").alias("above"))
        rest = large.filter("depth > ends").join(last, ["k1", "k2"])
        key = prefixes.select("conv_id", F.col("pos").alias("branch"), F.col("p1").alias("n1"), F.col("p2").alias("n2"))
        moved = materialize(rest.drop("up").join(key, ["conv_id", "branch"]), "moved")
        split.append((trunk, moved.filter("p1 = n1 and p2 = n2").select("n1", "n2", F.col("k1").alias("over1"), F.col("k2").alias("over2"))))
        level = moved.select(*(c for c in level.columns if c not in ("k1", "k2", "up")), F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("above").alias("up"))
    done = built.pop()
    for part, (trunk, link) in zip(reversed(built), reversed(split), strict=True):
        tops = done.filter("top").select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), "n_leaves", "saved_tokens")
        below = link.join(tops, ["n1", "n2"]).groupBy(F.col("over1").alias("k1"), F.col("over2").alias("k2")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("n"))
        chain = _chain(trunk, materialize(below, "below"))
        done = materialize(part.unionByName(chain).unionByName(done.withColumn("top", F.lit(False))), "tries")
    return done


def _ends(last: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of each node at which conversations end: ids ascending, in pieces, hashed as a stream."""
    n = partitions(last.sparkSession)

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), CHUNK):
                ids = pdf[at : at + CHUNK]
                grouped = ids.groupby(["p1", "p2"], sort=False)["conv_id"]
                yield pd.DataFrame([(*k, int(v.iloc[0]), ",".join(map(str, v.tolist()))) for k, v in grouped], columns=["p1", "p2", "first", "ids"])

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest, out = None, None, []
        for pdf in frames:
            for p1, p2, ids in zip(pdf["p1"].tolist(), pdf["p2"].tolist(), pdf["ids"].tolist(), strict=True):
                if (p1, p2) != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (p1, p2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["p1", "p2", "ends_sha256"])
            out = []
        if key:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=["p1", "p2", "ends_sha256"])

    parts = last.repartitionByRange(n, "conv_id").sortWithinPartitions("conv_id").mapInPandas(pieces, "p1 long, p2 long, first long, ids string")
    return parts.repartition(n, "p1", "p2").sortWithinPartitions("p1", "p2", "first").mapInPandas(hashed, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, most: int | None = None) -> DataFrame:
    """The trie's nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` are numbered and digested (conv_id, pos, x1, x2, chars, n_turns), `lengths` has (conv_id, n_turns) of every
    conversation, those without turns included. `most` nodes of a subtrie go to one task (a test's means to see it split).
    (conv_id, depth) names a node: its smallest member and its depth. The root has depth 0 and no parent. No conversation
    gives no node. Equal conversations are members of the same nodes and hashed together; ids are hashed in pieces of CHUNK.
    A node's id is 128 bits of hashes: two sequences of a corpus share one with odds of about n^2 / 2^129.
    """
    prefixes = _prefixes(turns)
    nodes = prefixes.groupBy("p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("pos").alias("depth"), F.min("chars").alias("chars"), F.min(F.col("p1").bitwiseXOR(F.col("h1"))).alias("u1"), F.min(F.col("p2").bitwiseXOR(F.col("h2"))).alias("u2")
    )
    smallest, members = lengths.agg(F.min("conv_id"), F.count("*")).first()
    first = prefixes.filter("pos = 1").select("conv_id", F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    inner = _subtries(nodes.join(first, "conv_id").withColumn("up", F.lit(smallest).cast("long")), prefixes, most)
    below = inner.filter("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = below.filter(F.lit(members > 0)).select(
        F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), F.lit(smallest).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(members).cast("long").alias("n_convs"),
        "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
    )
    last = prefixes.filter("pos = n_turns").select("conv_id", "p1", "p2").unionByName(lengths.filter("n_turns = 0").select("conv_id", F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2")))
    out = inner.select(root.columns).unionByName(root).join(_ends(last), ["p1", "p2"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, most: int | None = None) -> DataFrame:
    """prefix_trie of the conversations as they are. Null roles and texts are empty; turns are ordered by number, null first, equal ones by content."""
    turns = numbered(materialize(digested(conversations), "digested"))
    lengths = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")), "lengths")
    return prefix_trie(turns.join(lengths, "conv_id").drop("turn"), lengths, most)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations of the table, rebuilt with borrowed first turns."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns, lengths = rebuilt(numbered(materialize(digested(conversations), "digested")))
    return prefix_trie(turns, lengths)


#: CRC-32 of an id's digits, bit by bit; 3988292384 is its reflected polynomial.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(str_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS UBIGINT))),
    lambda a, ch: list_reduce(list_prepend(xor(a, ch), list_transform(range(8), lambda i: 0::UBIGINT)), lambda b, i: xor(b >> 1, (b & 1::UBIGINT) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""

OP11_SQL = f"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT conv_id, conv_id - conv_id % 100 AS lender, CAST({_CRC} % 6 AS BIGINT) AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
    SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY t.pos) AS depth, t.role, t.text
    FROM convs c JOIN turns t ON (t.conv_id = c.lender AND t.pos <= c.h) OR (t.conv_id = c.conv_id AND t.pos > c.h)
), paths AS (
    SELECT conv_id, depth, length(text) AS chars, string_agg(sha256(concat(length(role), ' ', role, text)), '/') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM rebuilt
), members AS (
    SELECT conv_id, depth, chars, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM paths
    UNION ALL SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM paths) FROM convs
), nodes AS (
    SELECT node, min(parent) AS parent, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256
    FROM members GROUP BY node
), children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
under AS (SELECT DISTINCT a.node, b.node AS low FROM members a JOIN members b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
    SELECT u.node, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens
    FROM under u JOIN nodes n ON n.node = u.low LEFT JOIN children c ON c.node = u.low GROUP BY u.node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN children c USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""
