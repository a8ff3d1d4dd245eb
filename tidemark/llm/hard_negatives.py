"""Hard negatives: rows of another label whose score with an anchor lies just below that of one of its positives.

Scores are inner products of integer vectors. With one more coordinate, sqrt(M - |x|^2) where M is the largest squared
norm, and 0 for anchors, the squared distance is M + |q|^2 - 2 score: best scores are nearest, and a window of scores is
an annulus. Rows are dealt to blocks by a vantage-point tree over a bounded sample; a task builds the tree of its block
and traverses it nearest first for each anchor that the block can matter to, from the annulus's inner edge outwards until
every window is full or the outer edge is passed. Bounds only skip what can't be a result; scores are exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import exchange, materialize, partitions

POSITIVES = NEGATIVES = 5
#: A negative's score is between these hundredths of its positive's.
LOW, HIGH = 80, 100
#: Rows of a block (they are in memory at once), leaves of the tree over the sample, rows and bytes of the sample, rows of a leaf in a task.
BLOCK, LEAVES, SAMPLE, SAMPLE_BYTES, LEAF = 20_000, 1024, 8192, 32 << 20, 64
_SLACK = 1e-7
_ROWS = "part int, block int, kind int, id long, row long, label int, vec array<int>, asked array<long>"
_FOUND = "row long, place int, id long, score long"


class Tree:
    """A vantage-point tree over rows of an integer matrix x, augmented to squared norm `bound`."""

    def __init__(self, x: np.ndarray, bound: int, leaf: int):
        self.bound, self.order = bound, np.arange(len(x))
        norms = np.einsum("ij,ij->i", x, x)
        self.extra = np.sqrt(np.maximum(bound - norms, 0).astype(float))
        self.x = x.astype(float)
        self.slack = _SLACK * math.sqrt(max(bound, 1))
        self.nodes: list[tuple] = []  # (vantage row, [(child, nearest, farthest from the vantage row)]) or (start, stop) of a leaf
        self.vantages: list[int] = []
        self._build(leaf)

    def _distances(self, at: np.ndarray, v: int) -> np.ndarray:
        d = self.x[at] - self.x[v]
        return np.sqrt(np.einsum("ij,ij->i", d, d) + (self.extra[at] - self.extra[v]) ** 2)

    def _build(self, leaf: int) -> None:
        todo = [(0, len(self.order), None, 0)]
        while todo:
            start, stop, above, side = todo.pop()
            me = len(self.nodes)
            if above is not None:
                self.nodes[above][1][side][0] = me
            if stop - start <= leaf:
                self.nodes.append((start, stop))
                continue
            at = self.order[start:stop]
            v = int(at[np.argmax(self._distances(at, int(at[0])))])  # far from the others
            d = self._distances(at, v)
            half = (stop - start) // 2
            cut = np.argpartition(d, half)
            self.order[start:stop], d = at[cut], d[cut]
            self.nodes.append((len(self.vantages), [[None, d[:half].min(), d[:half].max()], [None, d[half:].min(), d[half:].max()]]))
            self.vantages.append(v)
            todo += [(start + half, stop, me, 1), (start, start + half, me, 0)]

    def to_vantages(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries (their augmented coordinate is 0) to all vantage rows."""
        v = self.x[self.vantages]
        square = (q * q).sum(1)[:, None] + self.bound - 2 * (q @ v.T) if len(v) else np.zeros((len(q), 0))
        return np.sqrt(np.maximum(square, 0))

    def nearest_first(self, near: np.ndarray, closest: float, slack: float) -> Iterator[tuple[float, tuple]]:
        """Leaves by a lower bound of their rows' distance, as long as they are asked for; those wholly within `closest` are skipped. near: distances to the vantages."""
        queue = [(0.0, 0, math.inf)]
        while queue:
            least, node, most = heapq.heappop(queue)
            what = self.nodes[node]
            if not isinstance(what[1], list):
                yield least, what
                continue
            d = near[what[0]]
            for child, low, high in what[1]:
                a, b = max(least, d - high - slack, low - d - slack), min(most, d + high + slack)
                if b >= closest:
                    heapq.heappush(queue, (a, child, b))


def _quantized(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, vec) of the rows that take part, floor(256 x) as integers. A squared norm of 2^62 or more is an error: scores wouldn't fit."""
    vec, x = F.col(vec_col), F.col("v")
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.transform(vec, lambda c: c.cast("double")).alias("v"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    own = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~bad)
    norm = F.aggregate(x, F.lit(0.0), lambda a, c: a + F.pow(F.abs(c) * 256 + 1, F.lit(2.0)))
    return own.select("id", "label", F.when(norm < 2.0**62, F.transform(x, lambda c: F.floor(c * 256).cast("int"))).otherwise(F.raise_error(F.lit("a vector is too long for 64-bit scores")).cast("array<int>")).alias("vec"))


def _row_id() -> Column:
    return F.xxhash64("id", "label", "vec")


def _exact(bound: int) -> bool:
    """Whether doubles hold every partial sum of a score."""
    return bound < 2**52


def _scores(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    return (x @ q).astype(np.int64) if exact else x.astype(np.int64) @ q.astype(np.int64)


class _Windows:
    """The best `k` (score, id) of each window of scores."""

    def __init__(self, windows: list[tuple[int, int]], k: int):
        self.windows, self.k = windows, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]

    def least(self) -> int:
        """Scores below this can't matter any more."""
        return min(max(low, int(s[-1])) if len(s) == self.k else low for (low, _), (s, _) in zip(self.windows, self.best, strict=True))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for i, (low, high) in enumerate(self.windows):
            s, d = self.best[i]
            floor = max(low, int(s[-1])) if len(s) == self.k else low
            fits = (scores >= floor) & (scores <= high)
            if fits.any():
                s, d = np.concatenate([s, scores[fits]]), np.concatenate([d, ids[fits]])
                first = np.lexsort((d, -s))[: self.k]
                self.best[i] = s[first], d[first]


def _answer(tree: Tree, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, q: np.ndarray, near: np.ndarray, row: int, label: int, windows: _Windows, same: bool, exact: bool) -> None:
    """Traverse a block's tree for one anchor. Columns are in the order of the tree's leaves."""
    square = int(np.dot(q.astype(np.int64), q.astype(np.int64)))
    slack = tree.slack + _SLACK * math.sqrt(square)
    top = max(high for _, high in windows.windows)
    closest = math.sqrt(max(0, tree.bound + square - 2 * top)) - slack if top < 2**62 else 0.0
    for least, (start, stop) in tree.nearest_first(near, closest, slack):
        reach = (tree.bound + square - max(0.0, least - slack) ** 2) / 2 + 1e-9 * (tree.bound + square) + 1  # no score beyond `least` is higher
        if reach < windows.least():
            return
        fits = labels[start:stop] == label if same else labels[start:stop] != label
        fits &= rows[start:stop] != row
        if fits.any():
            windows.add(_scores(tree.x[tree.order[start:stop][fits]], q, exact), ids[start:stop][fits])


def _searcher(bound: int, dims: int, k: int, same: bool):
    """Rows of blocks, each block's points (kind 0) before its anchors (kind 1), to the best rows of each anchor and window."""
    exact = _exact(bound)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, points, tree = None, [], None
        for batch in batches:
            names = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "kind", "id", "row", "label")}
            vecs = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            asked = batch.column("asked").to_pylist()
            cuts = np.flatnonzero((np.diff(names["block"]) != 0) | (np.diff(names["kind"]) != 0)) + 1
            out = []
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == stop:
                    continue
                if names["block"][start] != block:
                    block, points, tree = names["block"][start], [], None
                part = slice(start, stop)
                if names["kind"][start] == 0:
                    points.append((names["id"][part], names["label"][part], names["row"][part], vecs[part]))
                    continue
                if not points:
                    continue
                if tree is None:
                    ids, labels, rows, x = (np.concatenate(c) for c in zip(*points, strict=True))
                    tree = Tree(x.astype(np.int64), bound, LEAF)
                    ids, labels, rows = ids[tree.order], labels[tree.order], rows[tree.order]
                q = vecs[part].astype(float)
                near = tree.to_vantages(q)
                for i in range(stop - start):
                    at = start + i
                    if same:
                        places, spans = [0], [(asked[at][0], 2**62)]
                    else:
                        tops = sorted({p for p in asked[at] if p >= 0}, reverse=True)
                        places, spans = [asked[at].index(p) for p in tops], [(-(-LOW * p // HIGH), p) for p in tops]
                    found = _Windows(spans, k)
                    _answer(tree, ids, labels, rows, q[i], near[i], names["row"][at], names["label"][at], found, same, exact)
                    for place, (s, d) in zip(places, found.best, strict=True):
                        out += [(int(names["row"][at]), place, int(b), int(a)) for a, b in zip(s, d, strict=True)]
            row, place, ident, score = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(place, pa.int32()), pa.array(ident, pa.int64()), pa.array(score, pa.int64())], names=["row", "place", "id", "score"])

    return search


class _Index:
    """Points in blocks: (block, id, row, label, vec), with the sample's tree, whose leaves own consecutive blocks."""

    def __init__(self, points: DataFrame, n: int, bound: int, dims: int):
        spark = points.sparkSession
        self.parts, self.bound, self.dims = partitions(spark), bound, dims
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(dims, 1))))
        share = F.shiftrightunsigned(F.xxhash64("row", F.lit(7)), 11) / float(2**53)
        got = points.filter(share * n < most).select("row", "label", "vec").orderBy("row").collect()
        self.sample = np.array([r["vec"] for r in got], np.int64).reshape(len(got), dims)
        self.sample_rows, self.sample_labels = np.array([r["row"] for r in got], np.int64), np.array([r["label"] for r in got], np.int64)
        blocks = max(1, self.parts, -(-n // BLOCK))
        self.tree = Tree(self.sample, bound, max(1, len(got) // min(blocks, LEAVES)))
        self.leaves = [i for i, x in enumerate(self.tree.nodes) if not isinstance(x[1], list)]
        leaf = self._leaf_of()
        counted = materialize(points.mapInArrow(leaf, "leaf int, id long, row long, label int, vec array<int>"), "leaves")
        counts = dict(counted.groupBy("leaf").count().collect())
        self.first, at = {}, 0
        for i in range(len(self.leaves)):
            parts = max(1, -(-counts.get(i, 0) * blocks // max(n, 1)))
            self.first[i] = (at, parts)
            at += parts
        self.blocks = at
        place = F.from_json(F.lit(str([{"a": a, "b": b} for a, b in self.first.values()]).replace("'", '"')), "array<struct<a:int,b:int>>")
        own = F.get(place, F.col("leaf"))
        self.points = counted.select((own["a"] + F.pmod(F.xxhash64("row"), own["b"])).cast("int").alias("block"), "id", "row", "label", "vec")

    def _leaf_of(self):
        tree, leaves, dims = self.tree, {node: i for i, node in enumerate(self.leaves)}, self.dims

        def route(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims).astype(float)
                extra = np.sqrt(np.maximum(tree.bound - (x * x).sum(1), 0))
                leaf = np.zeros(len(x), np.int32)
                todo = [(0, np.arange(len(x)))] if tree.nodes else []
                while todo:
                    node, at = todo.pop()
                    what = tree.nodes[node]
                    if not isinstance(what[1], list):
                        leaf[at] = leaves[node]
                        continue
                    v = tree.vantages[what[0]]
                    inside = (((x[at] - tree.x[v]) ** 2).sum(1) + (extra[at] - tree.extra[v]) ** 2) <= what[1][0][2] ** 2
                    todo += [(c[0], a) for c, a in ((what[1][0], at[inside]), (what[1][1], at[~inside])) if len(a)]
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *(batch.column(c) for c in ("id", "row", "label", "vec"))], names=["leaf", "id", "row", "label", "vec"])

        return route

    def _reaching(self, same: bool):
        """Anchors to the blocks that can matter: `asked` is the least score that counts (from the sample), or the scores of the positives."""
        tree, leaves, first, dims, parts = self.tree, {node: i for i, node in enumerate(self.leaves)}, self.first, self.dims, self.parts
        sample, sample_rows, sample_labels, exact = self.sample.astype(float), self.sample_rows, self.sample_labels, _exact(self.bound)

        def spread(batches):
            for batch in batches:
                out = []
                q = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims).astype(float)
                labels, rows, asked = batch.column("label").to_numpy(), batch.column("row").to_numpy(), batch.column("asked").to_pylist()
                near = tree.to_vantages(q)
                for i in range(batch.num_rows):
                    square = int(np.dot(q[i].astype(np.int64), q[i].astype(np.int64)))
                    if same:
                        known = _scores(sample[(sample_labels == labels[i]) & (sample_rows != rows[i])], q[i], exact)
                        # Row ids of a sample are distinct rows, so the k-th best of them bounds the k-th best of all.
                        least, top = (int(np.sort(known)[-POSITIVES]) if len(known) >= POSITIVES else -(2**62)), 2**62
                        asked[i] = [least]
                    elif not any(p >= 0 for p in asked[i]):
                        continue
                    else:
                        top = max(asked[i])
                        least = min(-(-LOW * p // HIGH) for p in asked[i] if p >= 0)
                    slack = tree.slack + _SLACK * math.sqrt(square)
                    far = math.sqrt(max(0, tree.bound + square - 2 * least)) + slack
                    closest = math.sqrt(max(0, tree.bound + square - 2 * top)) - slack
                    todo = [(0, 0.0, math.inf)] if tree.nodes else []
                    while todo:
                        node, low, high = todo.pop()
                        what = tree.nodes[node]
                        if not isinstance(what[1], list):
                            a, n = first[leaves[node]]
                            out += [(b % parts, b, i, asked[i]) for b in range(a, a + n)]
                            continue
                        d, radius = near[i][what[0]], what[1][0][2]  # rows were dealt by this radius alone
                        for child, a, b in ((what[1][0][0], max(low, d - radius - slack), min(high, d + radius + slack)), (what[1][1][0], max(low, radius - d - slack), high)):
                            if a <= far and b >= closest:
                                todo.append((child, a, b))
                part, block, at, wanted = zip(*out, strict=True) if out else ((), (), (), ())
                picked = pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "row", "label", "vec")], names=["id", "row", "label", "vec"]).take(pa.array(at, pa.int64()))
                kind = pa.array(np.ones(len(part), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int32()), kind, *picked.columns, pa.array(wanted, pa.list_(pa.int64()))], names=["part", "block", "kind", "id", "row", "label", "vec", "asked"])

        return spread

    def best(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(row, place, id, score, rank): for each anchor and window the first k rows over all blocks."""
        asks = anchors.select("id", "row", "label", "vec", "asked").mapInArrow(self._reaching(same), _ROWS)
        points = self.points.select((F.col("block") % self.parts).alias("part"), "block", F.lit(0).alias("kind"), "id", "row", "label", "vec", F.lit(None).cast("array<long>").alias("asked"))
        dealt = exchange(points.unionByName(asks), self.parts).sortWithinPartitions("block", "kind")
        found = dealt.mapInArrow(_searcher(self.bound, self.dims, k, same), _FOUND)
        w = Window.partitionBy("row", "place").orderBy(F.col("score").desc(), "id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact over all rows.

    Rows with a null id, label or vector, or a component that is null, NaN or infinite, take no part. A vector shorter than
    the longest is filled up with zeros. A row repeated whole (id, label, vector) counts once; different rows under one id
    stay apart. Of rows with equal label and vector only the first six ids can be among a first five, so the others, which
    are anchors all the same, aren't searched. Ties: the smaller id. A positive with a negative score has no window; one
    of 0 has the scores 0. `is_anchor` is a condition on the column id. An empty table gives no rows.
    """
    own = _quantized(rows, id_col, vec_col, label_col)
    said = own.agg(F.max(F.size("vec")), F.max(F.aggregate("vec", F.lit(0).cast("long"), lambda a, c: a + c.cast("long") * c.cast("long")))).first()
    dims, bound = max(1, said[0] or 0), said[1] or 0
    padded = own.select("id", "label", F.concat("vec", F.array_repeat(F.lit(0), F.lit(dims) - F.size("vec"))).alias("vec")).withColumn("row", _row_id())
    equal = Window.partitionBy("label", "vec").orderBy("id")
    points = padded.withColumn("_k", F.dense_rank().over(equal)).filter(F.col("_k") <= max(POSITIVES, NEGATIVES) + 1).drop("_k").dropDuplicates(["row"])
    points = materialize(points, "points")
    index = _Index(points, points.count(), bound, dims)
    anchors = materialize(padded.filter(is_anchor).dropDuplicates(["row"]), "anchors")
    positives = index.best(anchors.withColumn("asked", F.lit(None).cast("array<long>")), POSITIVES, True)
    positives = materialize(positives.select("row", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    asked = positives.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))), lambda x: x["positive_score"]).alias("asked"))
    found = index.best(anchors.join(asked, "row"), NEGATIVES, False).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    # Positives of equal score share the window of the first of them.
    shared = positives.withColumn("place", F.first("rank").over(Window.partitionBy("row", "positive_score").orderBy("rank")) - 1).drop("rank")
    out = shared.join(found, ["row", "place"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of embeddings; labels of every seventh are moved on first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("id") % 100 == 0)


#: Every anchor against every row: for small tables.
OP12_SQL = """
WITH given AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), rows_ AS (SELECT DISTINCT * FROM given),
scored AS (
    SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.vec, b.vec) AS BIGINT) AS score
    FROM rows_ a JOIN rows_ b ON a.id <> b.id WHERE a.id % 100 = 0
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""
