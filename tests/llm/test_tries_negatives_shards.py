"""Conversation tries, hard negatives and shards against plain Python, with hot keys and edge cases."""

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalog, conversation_trie, hard_negatives, sharding

# --- 11

TURNS = "conv_id long, turn long, role string, text string"


def plain_rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members = collections.defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, set()
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        ends = ",".join(str(c) for c in members[node] if len(convs[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.add((members[node][0], len(node), parent, len(members[node]), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(df):
    return {tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}


def crowd(rng, n=150):
    """Conversations of which a third are one conversation, many share a long start, and some have one turn or many."""
    shared = [("user" if i % 2 == 0 else "assistant", f"shared {i}" + "é" * i) for i in range(12)]
    rows = []
    for c in range(n):
        turns = shared[:7] if c % 3 == 0 else shared[: rng.randrange(13)] + [("user", rng.choice("abc")) for _ in range(rng.randrange(1, 5))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(1000 + i % 2, i, "user", f"long {i // 3}") for i in range(400)]
    return rows


def test_trie_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(catalog.queries()["op11_conversation_trie"](spark, sf)) == plain_trie(plain_rebuilt(rows))


@pytest.mark.parametrize("most", [3, 40, None])
def test_split_subtries_equal_whole_ones(spark, most):
    rows = crowd(random.Random(5))
    convs = collections.defaultdict(list)
    for c, _, r, t in rows:
        convs[c].append((r, t))
    got = conversation_trie.conversation_trie(spark.createDataFrame(rows, TURNS), most)
    assert trie_rows(got) == plain_trie(convs)


def test_rebuilt_conversations(spark):
    rng = random.Random(8)
    rows = crowd(rng) + [(301, 0, "user", "lender missing"), (302, 1, None, None), (302, None, "user", "null turn first"), (-5, 3, "a", "x"), (None, 1, "user", "nobody's"), (303, 9, "user", "")]
    df = spark.createDataFrame(rows, TURNS)
    for c in ("pos", "p1", "up", "k1", "node", "depth", "n_convs"):
        df = df.withColumn(c, F.lit(1))
    turns, lengths = conversation_trie.rebuilt(conversation_trie.numbered(conversation_trie.digested(df)))
    want = plain_rebuilt(rows)
    assert {r.conv_id: r.n_turns for r in lengths.collect()} == {c: len(t) for c, t in want.items()}
    assert any(not t for t in want.values())
    assert trie_rows(conversation_trie.prefix_trie(turns, lengths, 5)) == plain_trie(want)


def test_no_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversation_trie.conversation_trie(none).count() == 0
    turns, lengths = conversation_trie.rebuilt(conversation_trie.numbered(conversation_trie.digested(none)))
    assert conversation_trie.prefix_trie(turns, lengths).count() == 0


# --- 12

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows, anchor=lambda i: i % 100 == 0):


    kept = set()
    for i, vec, label in rows:
        if i is not None and label is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec):
            kept.add((i, label, tuple(math.floor(256 * float(x)) for x in vec)))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905  missing components are zeros
    out = []
    for a in kept:
        if not anchor(a[0]):
            continue
        ranked = sorted(((-score(a[2], b[2]), b[0], b) for b in kept if b != a), key=lambda x: x[:2])
        for s, p, _ in [x for x in ranked if x[2][1] == a[1]][:5]:
            fits = [x for x in ranked if x[2][1] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a[0], p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits[:5])]
    return sorted(out)


def negative_rows(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def float32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("hot", [False, True])
def test_negatives_against_all_pairs(spark, monkeypatch, hot):
    """Few and many blocks; a third of the rows around one vector, or one vector exactly."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 60)
    monkeypatch.setattr(hard_negatives, "LEAF", 4)
    rng = random.Random(3 + hot)
    centre = [rng.gauss(0, 1) for _ in range(6)]
    rows = []
    for i in range(900):
        vec = centre if hot and i % 3 else [c + rng.gauss(0, 0.05) for c in centre] if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(6)]
        rows.append((i, [float32(x) for x in vec], rng.randrange(4)))
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("id") % 100 == 0)
    assert negative_rows(got) == plain_negatives(rows)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0, 1.5], 1), (2, [1.0, 1.4], 2), (3, [1.0, 1.4], 3), (4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 2), (7, [1.0, None], 2), (8, [9.0, 9.0], None)]
    rows += [(9, [1.5], 2), (10, [], 2), (100, [0.0, 0.0], 2), (200, [-1.0, -1.0], 3), (None, [1.0, 1.4], 2), (300, [0.1, 0.1, 0.7], 1), (11, [-0.001, 1.2], 2)]
    df = spark.createDataFrame(rows, VECTORS)
    for c in ("id", "row", "block", "part", "kind", "asked", "score", "rank"):
        df = df.withColumn(c, F.lit(1))
    assert negative_rows(hard_negatives.hard_negatives(df, F.col("id") % 100 == 0)) == plain_negatives(rows)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_too_long_vectors_are_an_error(spark):
    df = spark.createDataFrame([(0, [3e9], 1), (1, [1.0], 1)], VECTORS)
    with pytest.raises(Exception, match="64-bit"):
        hard_negatives.hard_negatives(df, F.col("id") % 100 == 0).count()


# --- 13


def check_shards(rows, got, shards, slack):
    """Every row once; slots gapless; sizes and checksums right; bytes as near to equal as `slack` says."""
    size = lambda t: len((t or "").encode()) + 1
    want = collections.Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(0 <= s < shards for s in by)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    held = [sum(r.size for r in by[s]) for s in range(shards)]
    assert max(held) - min(held) <= slack, held
    return held


def test_shards_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = catalog.queries()["op13_sharding"](spark, sf).collect()
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    check_shards(rows, got, 8, largest + 2 * sharding.SNAP * total / 8 + 1)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


@pytest.mark.parametrize("copies", [0, 1500])
def test_shards_keep_groups_but_divide_large_ones(spark, copies):
    rng = random.Random(copies)
    rows = [(i, "w" * rng.randrange(200)) if i % 2 else (i, f"{i} " + "x" * rng.randrange(400)) for i in range(2500)]
    rows += [(5000 + i, "a copy of the hot text " * 9) for i in range(copies)] + [(7, "one row many times " * 3)] * (copies // 3)
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    total = sum(r.size for r in got)
    check_shards(rows, got, 8, 2 * (sharding.SNAP * total / 8 + max(r.size for r in got)))
    of = collections.defaultdict(set)
    for r in got:
        of[r.text_crc32].add(r.shard)
    sizes = collections.Counter()
    for r in got:
        sizes[r.text_crc32] += r.size
    assert all(len(of[c]) == 1 for c in of if sizes[c] < sharding.SNAP * total / 8)


def test_shards_of_odd_tables(spark):
    rows = [(1, None), (2, ""), (None, "null id"), (None, "null id"), (3, "long " * 20_000), (3, "é"), (3, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("key", "k", "d", "r", "size", "range", "shard", "slot"):
        df = df.withColumn(c, F.lit(1))
    check_shards(rows, sharding.sharded(df).collect(), 8, 200_000)
    assert sharding.sharded(df.limit(0)).count() == 0
    assert [r.shard for r in sharding.sharded(df.limit(1)).collect()] in ([i] for i in range(8))


def test_written_shards_hold_the_texts(spark, tmp_path):
    rows = [(i % 50, f"text {i % 70}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted(rows)
    placed = collections.Counter((r.shard, r.slot) for r in back.select("shard", "slot").collect())
    assert set(placed.values()) == {1} and {s for s, _ in placed} == {0, 1, 2, 3}
