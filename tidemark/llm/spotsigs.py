"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A word is a run of ASCII letters and digits and of other non-ASCII characters, in lower case. The common words below
are anchors; so that passages without any (tables, names, other languages) aren't skipped, a word whose GAP
predecessors include no common word is an anchor too. An anchor's signature is the chain of the CHAIN content words (words
that aren't common ones) that follow it, or of fewer at the end of a text. A fingerprint is the multiset of
32-bit signatures: the k-th occurrence of a chain counts as a value of its own, so Jaccard over sets is Jaccard over
multisets. It is stored as the sorted values in base64.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, mix, partitions, slices

#: Common words of English, German, French and Spanish (fixed values).
COMMON = (
    "a an and are as at be by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which will with you "
    "als am auf aus bei das dass dem den der des die ein eine einer er es für hat ich ihr im ist mit nicht nach noch oder sie sich sind so und von war wie zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il ils la le les leur mais ne ou par pas pour qu que qui sa se ses son sont sur un une "
    "al como con del el ella ellos era las lo los más no nos para pero por sin su sus también una y ya"
).split()
CHAIN = 2
GAP = 6
#: Bytes of text whose signatures are found at once.
STEP = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word, its hash)."""
    inside = _WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * _powers(BASE, len(data)), dtype=np.uint64)])
    return start, mix((sums[end] - sums[start]) * _powers(INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))


_COMMON = np.unique(np.concatenate([_word_hashes(np.frombuffer(w.encode(), np.uint8))[1] for w in COMMON]))


def _signatures(blobs: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    bounds = np.cumsum([len(b) + 1 for b in blobs])
    start, h = _word_hashes(data)
    if not len(h):
        return [np.zeros(0, np.uint32)] * len(blobs)
    doc = np.searchsorted(bounds, start, "right")
    n = len(h)
    at = np.arange(n)
    where = np.minimum(np.searchsorted(_COMMON, h), len(_COMMON) - 1)
    common = _COMMON[where] == h
    last = np.maximum.accumulate(np.where(common, at, -1))
    before = np.r_[-1, last[:-1]]
    first = np.r_[0, np.flatnonzero(np.diff(doc)) + 1]
    begin = np.repeat(first, np.diff(np.r_[first, n]))
    anchor = np.flatnonzero(common | (before < np.maximum(begin, at - GAP)))
    content = np.flatnonzero(~common)
    nxt = np.searchsorted(content, anchor, "right")
    sig = h[anchor].copy()
    for k in range(CHAIN):
        c = content[np.minimum(nxt + k, max(len(content) - 1, 0))] if len(content) else anchor
        ok = (nxt + k < len(content)) & (doc[c] == doc[anchor])
        sig = sig * BASE + np.where(ok, h[c], np.uint64(0))
    sig = mix(sig)
    owner = doc[anchor]
    order = np.lexsort((sig, owner))
    sig, owner = sig[order], owner[order]
    new = np.r_[True, (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])]
    run = np.arange(len(sig)) - np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))
    value = (mix(sig + run.astype(np.uint64) * INVERSE) >> np.uint64(32)).astype("<u4")
    return [np.unique(x) for x in np.split(value, np.searchsorted(owner, np.arange(1, len(blobs))))]


def signatures(texts: list[str]) -> list[np.ndarray]:
    """The sorted signature values of each text; empty for texts without words."""
    blobs = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    return [s for a, b in slices([len(x) for x in blobs], STEP) for s in _signatures(blobs[a:b])]


def pack(values: np.ndarray) -> str:
    return base64.b64encode(values.astype("<u4").tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 if their sizes alone rule out `least`. Two empty sets are alike (1)."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large or not small:
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (small + large - common)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_spots, fingerprint) for every row's whole text. Null texts count as empty: no spot, an empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = signatures(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([pack(s) for s in found], pa.string())], names=["doc_id", "n_spots", "fingerprint"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_spots long, fingerprint string")


def near_pairs(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(rep_a, rep_b, likeness) between representatives of equal fingerprints with Jaccard of at least `least`.

    rep is the smallest doc_id of a class of equal fingerprints (see classes()). Classes are told apart by a hash of the
    fingerprint, so ids may be null (the second of a pair) or repeated: each pair of classes is a row. Sets are partitioned by length: band k
    holds sizes in (1/least)**k up to the next power, and a set meets only its own and the band above. Within bands,
    sets meet through their rarest values (the first n - ceil(least * n) + 1 in ascending frequency), and the length bound
    is applied to every candidate before its sets are joined. Empty fingerprints form one class and match nothing else.
    """
    ids = classes(prints).groupBy("fingerprint").agg(F.min("rep").alias("id")).filter("fingerprint <> ''")
    reps = ids.select(F.xxhash64("fingerprint").alias("rep"), "id", "fingerprint")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rep, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = unpack(text).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), rep)), pa.array(v), pa.array(np.full(len(v), len(v)))], names=["rep", "value", "n"])

    flat = reps.select("rep", "fingerprint").mapInArrow(explode, "rep long, value long, n long")
    frequency = flat.groupBy("value").agg(F.count("*").alias("f"))
    rare = Window.partitionBy("rep").orderBy("f", "value")
    prefix = flat.join(frequency, "value").withColumn("at", F.row_number().over(rare)).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    band = F.floor(F.log(F.col("n").cast("double")) / -np.log(least) + 1e-9) if least < 1 else F.col("n")
    prefix = prefix.withColumn("band", band)
    other = prefix.withColumn("band", F.explode(F.array("band", F.col("band") + 1))).select("band", "value", F.col("rep").alias("rep_b"), F.col("n").alias("n_b"))
    found = prefix.join(other, ["band", "value"]).filter((F.col("rep") != F.col("rep_b")) & (F.col("n_b") <= F.col("n")) & (F.col("n_b") >= F.col("n") * least - 1e-9))
    found = found.select(F.least("rep", "rep_b").alias("rep_a"), F.greatest("rep", "rep_b").alias("rep_b")).distinct()
    sets = reps.select("rep", "fingerprint", "id")
    both = found.join(sets.toDF("rep_a", "fa", "a"), "rep_a").join(sets.toDF("rep_b", "fb", "b"), "rep_b")
    turned = F.coalesce(F.col("a") > F.col("b"), F.col("a").isNull())
    both = both.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("rep_a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("rep_b"), "fa", "fb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [jaccard(unpack(x), unpack(y), least) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], names=["rep_a", "rep_b", "likeness"])

    return both.select("rep_a", "rep_b", "fa", "fb").mapInArrow(verify, "rep_a long, rep_b long, likeness double").filter(F.col("likeness") >= least - 1e-12)


def classes(prints: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, rep): each document with the smallest doc_id of those with an equal fingerprint."""
    rep = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    return prints.select("doc_id", "fingerprint").join(rep, "fingerprint")


LOWEST = -(1 << 63)


def with_next(docs: DataFrame, fn, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fn(ids, texts, next texts) -> record batch, over all rows in ascending id (then text); the last row's next is the first.

    One shuffle of the rows into ranges of ids. The ranges come from approximate quantiles of the ids; the first row of each
    range also goes to the range before it, so no range needs another. Only one id for each range reaches the driver.
    Null ids come first.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = id_text(docs, id_col, text_col)
    order = rows.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("o"))
    cuts = order.agg(F.percentile_approx("o", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    cuts = sorted(set(cuts))[: n - 1]

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, int] = {}
        for b in batches:
            ids = b.column(0).to_numpy()
            part = np.searchsorted(cuts, ids, "right")
            for p in np.unique(part):
                low[int(p)] = min(low.get(int(p), ids.max()), ids[part == p].min())
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array([int(x) for x in low.values()], pa.int64())], names=["part", "low"])

    found = sorted(tuple(r) for r in order.mapInArrow(firsts, "part int, low long").groupBy("part").agg(F.min("low")).collect())
    lows = [low for _, low in found]
    parts = [part for part, _ in found]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o = b.column(0).fill_null(LOWEST).to_numpy()
            part = np.searchsorted(cuts, o, "right")
            at = np.searchsorted(lows, o)
            edge = np.flatnonzero((at < len(lows)) & (np.array(lows)[np.minimum(at, len(lows) - 1)] == o))
            to = np.array(parts)[at[edge] - 1]
            wrap = (at[edge] == 0).astype(np.int8)
            every = pa.array(np.r_[np.arange(len(o)), edge])
            ids, texts = b.column(0).take(every), b.column(1).take(every)
            copy = np.r_[np.zeros(len(o), np.int8), 1 + wrap]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[part, to].astype(np.int32)), pa.array(copy), pa.array(np.r_[o, o[edge]]), ids, texts], names=["part", "copy", "o", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "part int, copy byte, o long, doc_id long, text string").repartitionById(n, F.col("part"))
    dealt = dealt.sortWithinPartitions("part", "copy", "o", "text").select("copy", "doc_id", "text")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, done = 0, False
        for b in batches:
            for copy, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if done:
                    break
                t = t.as_py()
                if size > STEP:
                    yield fn(ids, texts, [*texts[1:], t])
                    ids, texts, size = [], [], 0
                if copy:
                    if texts:
                        yield fn(ids, texts, [*texts[1:], t])
                    ids, texts, done = [], [], True
                    break
                ids.append(i)
                texts.append(t)
                size += len(t)

    return dealt.mapInArrow(pairs, schema)


def op1_spotsigs(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next document's.

    Null and empty texts have an empty fingerprint and are alike (1) to each other alone. Rows with equal ids follow in order of their texts,
    null ids come first; the last row's next is the first, a single row's next is itself. Repeated rows give rows of their own, an empty
    table gives none, other columns aren't read, and texts are read whole.
    """
    from .common import documents

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def digest(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following, strict=True)]
        own, changed = signatures(texts), signatures(edited)
        after = [*own[1:], signatures(following[-1:])[0]]
        columns = [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
            pa.array([pack(s) for s in own]), pa.array([pack(s) for s in changed]), pa.array([jaccard(a, b) for a, b in zip(own, changed, strict=True)]), pa.array([jaccard(a, b) for a, b in zip(own, after, strict=True)]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return with_next(documents(spark, sf_dir), digest, schema)
