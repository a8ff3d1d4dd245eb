"""Near copies: texts whose sets of SHINGLE-word shingles have a Jaccard similarity of at least LEAST.

The first step is that of op6: a SimHash of each text's shingles, Golay keys, groups of fingerprints at most 3 bits apart. Each text
is verified against the first one of its group, on the shingles of both, so no link is too weak. That reaches copies that are
nearly equal: at a similarity of 0.8 fingerprints differ in about 10 bits, too many for any key of a code of 23.

So the second step finds what lies further apart. A text has BANDS * ROWS minima of hashes of its shingles, and texts that agree in
all minima of a band are candidates: at a similarity of 0.8 one pair in about 150,000 shares none. Candidates that the first step
has put into one group are settled, the others are verified in the same way.

Equal texts are one node. Up to ALL texts of a band are paired with each other. The texts of a larger (hot) band are paired with
one leader: in a group of copies that settles all, with pairs in proportion to the texts. What is left, texts that share a band but
not its largest group, is compared with all texts of the band in blocks, by the minima; pairs that agree in LEAST_EQUAL of them and
aren't in one group yet are verified there, so a block yields fewer links than it has texts. Where that would be over BLOCK comparisons a text, they get LEADERS of their own first, as long as that halves the
work. At a similarity of 0.8 one pair in 500,000 agrees in fewer minima, so hot bands lose no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, materialize, mix
from .components import connected_components
from .spotsigs import BASE, INVERSE

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 30, 5
ALL = 32
LEADERS = 4
LEAST_EQUAL = 98
#: Texts of a block; hashes of shingles that a comparison of blocks keeps.
BLOCK = 512
KEPT = 1 << 23
#: Shingles hashed at once.
STEP = 2048

_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingles(text: str | bytes) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; of all its words together if they are fewer."""
    digest = xxhash.xxh64_intdigest
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    words = np.array([digest(w) for w in data.lower().split()], np.uint64)
    if len(words) < SHINGLE:
        words = np.concatenate([words, np.full(SHINGLE - len(words), INVERSE, np.uint64)]) if len(words) else words
    if not len(words):
        return words
    h = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        h = mix(h * BASE + words[k : k + len(h)])
    return np.unique(h)


def sketch(h: np.ndarray) -> np.ndarray:
    """Of each of the BANDS * ROWS minima of a set of hashes the low 16 bits."""
    low = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(h), STEP):
        for k in range(0, len(low), 10):
            part = (h[i : i + STEP, None] ^ _XOR[k : k + 10]) * _ODD[k : k + 10]
            low[k : k + 10] = np.minimum(low[k : k + 10], part.min(axis=0))
    return low.astype("<u2")


def bands(sketches: np.ndarray) -> np.ndarray:
    """(n, BANDS): the keys of n sketches."""
    low = sketches.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.tile(_SALT, (len(low), 1))
    for r in range(ROWS):
        key = mix(key * BASE + low[:, :, r])
    return key


def node(text: Column) -> Column:
    """What tells texts apart: a hash of all bytes. Null is an empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found, prints = [], np.zeros(b.num_rows, np.uint64)
        for i, t in enumerate(b.column(2)):
            h = shingles(t.as_py())
            found.append(sketch(h).tobytes())
            prints[i] = simhash.majority(simhash.ones(h), len(h))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary()), pa.array(prints.view(np.int64))], names=["node", "doc_id", "sketch", "fp"])
    _release()


def _read(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), "<u2").reshape(-1, BANDS * ROWS)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            key = bands(_read(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["key", "node"])


def _edges(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
    """Pairs, the smaller node first, each once."""
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *u]), np.concatenate([none, *v])
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches that don't end within a run of rows with equal first `width` columns, of batches sorted by these."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in range(width)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if kept and any(kept[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in range(width)):
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept = []
        if len(new):
            yield pa.Table.from_batches([*kept, b.slice(0, new[-1])]).combine_chunks().to_batches()[0]
            kept = [b.slice(new[-1])]
        else:
            kept.append(b)
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs within the runs of one key; rows come sorted by key."""
    for b in _runs(batches, 1):
        key, nodes = b.column(0).to_numpy(), b.column(1).to_numpy()
        u, v = [], []
        for k in range(1, len(key)):
            at = np.flatnonzero(key[k:] == key[:-k])
            if not len(at):
                break
            u.append(nodes[at])
            v.append(nodes[at + k])
        yield _edges(u, v)


class _Sets:
    """The shingles of compressed texts by number; those read last are kept, up to KEPT hashes."""

    def __init__(self, data: pa.Array):
        self.data, self.known, self.size, self.large = data, {}, 0, zstandard.ZstdDecompressor()

    def __getitem__(self, i: int) -> np.ndarray:
        found = self.known.pop(i, None)
        if found is None:
            found = shingles(self.large.decompress(self.data[i].as_py()))
            self.size += len(found)
            while self.size > KEPT and self.known:
                self.size -= len(self.known.pop(next(iter(self.known))))
        self.known[i] = found
        return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the strays and the members of each block, as few as connect what all of them would.

    Of texts that aren't in one group yet, those whose sketches agree enough are verified, the most alike first. Two texts
    that share several open bands are compared in the one with the smallest key.
    """
    for b in _runs(batches, 3):
        parts = [b.column(k).to_numpy() for k in range(3)]
        stray, nodes, root = b.column(3).to_numpy(zero_copy_only=False).astype(bool), b.column(4).to_numpy(), b.column(5).to_numpy()
        starts = np.r_[0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in parts], axis=0)) + 1, b.num_rows]
        low, sets = _read(b.column(6)), _Sets(b.column(7))
        bands_of = [np.array(x, np.int64) for x in b.column(8).to_pylist()]
        u, v = [], []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            ours, theirs = s + np.flatnonzero(stray[s:e]), s + np.flatnonzero(~stray[s:e])
            group = root.copy()
            for i in ours.tolist():
                equal = (low[theirs] == low[i]).sum(axis=1)
                at = np.flatnonzero((equal >= LEAST_EQUAL) & (group[theirs] != group[i]))
                for k in theirs[at[np.argsort(-equal[at], kind="stable")]].tolist():
                    if group[k] == group[i] or np.intersect1d(bands_of[i], bands_of[k]).min() != parts[0][s]:
                        continue
                    if similarity(sets[i], sets[k]) >= LEAST - 1e-12:
                        u.append(nodes[i : i + 1])
                        v.append(nodes[k : k + 1])
                        group[s:e][group[s:e] == group[k]] = group[i]
        yield _edges(u, v)
    _release()


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, so that both texts of many pairs take little room."""
    small = zstandard.ZstdCompressor(level=1)
    for b in batches:
        data = [small.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["node", "data"])
    _release()


def _release() -> None:
    """Give back what Arrow keeps; the worker lives on for the next stages."""
    pa.default_memory_pool().release_unused()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, own = None, None
    large = zstandard.ZstdDecompressor()
    read = lambda x: shingles(large.decompress(x.as_py()))
    for b in batches:
        u, v, keep = b.column(0).to_pylist(), b.column(1).to_pylist(), []
        for i, (a, x, y) in enumerate(zip(u, b.column(2), b.column(3), strict=True)):
            if a != last:
                last, own = a, read(x)
            if similarity(own, read(y)) >= LEAST - 1e-12:
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in keep], pa.int64()), pa.array([v[i] for i in keep], pa.int64())], names=["u", "v"])
    _release()


def _grouped(members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with the root of their group, components) after joining what the edges connect."""
    found = connected_components(edges)
    return materialize(members.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "members"), found


def _strays(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members of hot bands with several groups, those of them that aren't in their band's largest group)."""
    per = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = per.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("groups"), F.sum("n").alias("all")).filter("groups > 1")
    open_ = members.join(largest.drop("groups"), "key")
    return open_, open_.filter("root <> main")


def print_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v): the first node of each group of fingerprints (fp) that links of few bits connect, with every other of its nodes."""
    return simhash.grouped(nodes.select("node", "fp"), "node").filter("node <> component_id").select(F.col("component_id").alias("u"), F.col("node").alias("v"))


def _beyond(pairs: DataFrame, settled: DataFrame) -> DataFrame:
    """Pairs of nodes that aren't in one group yet; a node that has no row in settled is its own group's root."""
    roots = [settled.toDF("u", "_u"), settled.toDF("v", "_v")]
    return pairs.join(roots[0], "u", "left").join(roots[1], "v", "left").filter(F.coalesce("_u", "u") != F.coalesce("_v", "v")).select("u", "v")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = ALL) -> tuple[DataFrame, DataFrame]:
    """(rows, kept). rows: (node, doc_id) of every row. kept: (node, doc_id) of the row that stays of each group of texts that
    links connect: the smallest id's; of several such texts, the smallest node's. Null ids come last.

    Null texts count as empty, texts without words are alike, texts of fewer words than a shingle are one shingle. Repeated rows and
    ids are fine, other columns aren't read, an empty table gives empty ones. `most`: texts of a band that are all paired.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(node(F.col(text_col)).alias("node"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = materialize(plain.mapInArrow(_sketch, "node long, doc_id long, sketch binary, fp long"), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("node"))
    nodes = materialize(rows.groupBy("node").agg(F.min(first).alias("first"), F.min("sketch").alias("sketch"), F.min("fp").alias("fp")), "nodes")

    def compressed(ends: DataFrame) -> DataFrame:
        """(node, data): the texts of some nodes, compressed."""
        return plain.select("node", "text").join(ends.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"]).mapInArrow(_zipped, "node long, data binary")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.distinct(), "pairs")
        ends = pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "node")
        texts = materialize(compressed(ends), "texts")
        both = pairs.join(texts.toDF("u", "a"), "u").join(texts.toDF("v", "b"), "v").select("u", "v", "a", "b").sortWithinPartitions("u")
        out = materialize(both.mapInArrow(_verify, "u long, v long"), "links")
        discard(pairs)
        discard(texts)
        return out

    def starred(members: DataFrame, leaders: int) -> DataFrame:
        """Pairs of all members with their band's leaders: those whose nodes have the smallest hashes, one of each class of them."""
        by = F.xxhash64("node")
        chosen = members.groupBy("key", F.pmod(by, F.lit(leaders)).alias("class")).agg(F.min_by("node", by).alias("leader")).select("key", "leader")
        return members.select("key", "node").join(chosen, "key").filter("node <> leader").select(F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v"))

    def comparisons(strays: DataFrame) -> int:
        """Of all strays with all texts of their bands."""
        return int(strays.agg(F.sum("all")).first()[0] or 0)

    close = verified(print_pairs(nodes))
    settled = close.select(F.col("v").alias("node"), F.col("u").alias("root"))
    spread = nodes.select("node", "sketch").mapInArrow(_spread, "key long, node long")
    hot = materialize(spread.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key"), "hot")
    members = materialize(spread.join(hot, "key"), "members")
    near = spread.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(_pairs, "u long, v long")
    links = close.unionByName(verified(_beyond(near.unionByName(starred(members, 1)).distinct(), settled)))
    grouped, found = _grouped(members, links)
    open_, strays = _strays(grouped)
    many, work, before = members.count(), comparisons(strays), None
    while work > BLOCK * many and (before is None or work <= before / 2):
        links = links.unionByName(verified(starred(strays, LEADERS)))
        grouped, found = _grouped(members, links)
        open_, strays = _strays(grouped)
        work, before = comparisons(strays), work
    if work:
        size = F.ceil(F.col("all") / BLOCK)
        per = strays.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("strays"))
        texts = compressed(open_.select("node").distinct())
        about = texts.join(open_.groupBy("node").agg(F.collect_set("key").alias("open")), "node").join(nodes.select("node", "sketch"), "node")
        blocks = materialize(open_.join(per, "key").join(about, "node").withColumn("h", F.xxhash64("node")), "blocks")
        every = F.explode(F.sequence(F.lit(0), F.col("strays").cast("int") - 1))
        ours = blocks.filter("root <> main").select("key", F.pmod("h", "strays").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), size.cast("int") - 1)).alias("j"), F.lit(True).alias("stray"), "node", "root", "sketch", "data", "open")
        theirs = blocks.select("key", every.alias("i"), F.pmod("h", size).cast("int").alias("j"), F.lit(False).alias("stray"), "node", "root", "sketch", "data", "open")
        near = ours.unionByName(theirs).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare, "u long, v long")
        grouped, found = _grouped(members, links.unionByName(near))
    member = nodes.select("node", "first").join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = member.groupBy("root").agg(F.min("first").alias("first")).select("first.node", "first.doc_id")
    return rows.select("node", "doc_id"), materialize(kept, "kept")
