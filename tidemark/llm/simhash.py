"""SimHash near-duplicate groups found through fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last padded to 23). The (23, 12) Golay code is
perfect: every segment lies within 3 bits of one codeword. A segment's keys are the 12-bit index of that codeword
and, if it is 3 bits away, the indices of the five codewords 4 bits away. Segments that differ in one bit then share
a key. Fingerprints with at most 3 differing bits either agree in one whole segment, and one of the other two segments
differs in at most one bit: they share (whole segment, codeword index), 30 or 35 bits; or each segment differs in
exactly one bit: then of each segment one half is equal, and they share one of 8 triples of halves. So no link can be
missed. Candidates with a common key are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hex64, id_text, materialize
from .components import connected_components, forest

SHINGLE = 3
MAX_DISTANCE = 3
SEED = 42
#: Generator polynomial of the Golay code (fixed value).
GENERATOR = 0xAE3
#: Runs of up to this many fingerprints with one key are compared in blocks at once; larger ones are cut further first.
BLOCK = 2048
STEP = 1 << 20


def _remainder(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - 11)
    return v


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error pattern; the offsets from the nearest codeword to those at distance 4 (zeros if none)."""
    high = np.array([_remainder(m << 11) for m in range(4096)], np.int64)
    words = (np.arange(4096, dtype=np.int64) << 11) | high
    sevens = words[np.bitwise_count(words) == 7]
    error = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            error[high[e >> 11] ^ (e & 2047)] = e
    other = np.zeros((2048, 5), np.int64)
    for s in np.flatnonzero(np.bitwise_count(error) == 3):
        other[s] = sevens[sevens & error[s] == error[s]]
    return high, error, other


HIGH, ERROR, OTHER = _tables()


def codewords(segment: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords that are a segment's keys; where there is only one, it is repeated."""
    syndrome = HIGH[segment >> 11] ^ (segment & 2047)
    nearest = segment ^ ERROR[syndrome]
    return np.concatenate([nearest[:, None], nearest[:, None] ^ OTHER[syndrome]], axis=1) >> 11


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the fingerprint), each key of a fingerprint once."""
    v = fingerprints.astype(np.uint64)
    segment = [((v >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in ((0, 23), (23, 23), (46, 18))]
    index = [codewords(s) for s in segment]
    own = np.arange(len(v))
    out, owners = [], []
    for tag, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        single = index[j][:, 0] == index[j][:, 1]
        base = (np.int64(tag) << 40) | (segment[i] << 12)
        out.append(base | index[j][:, 0])
        owners.append(own)
        many = own[~single]
        out.append((base[many, None] | index[j][many, 1:]).ravel())
        owners.append(np.repeat(many, 5))
    halves = [(s & ((1 << low) - 1), s >> low) for s, low in zip(segment, (12, 12, 9), strict=True)]
    for t in range(8):
        out.append((np.int64(8 + t) << 40) | (halves[0][t & 1] << 24) | (halves[1][t >> 1 & 1] << 12) | halves[2][t >> 2])
        owners.append(own)
    return np.concatenate(out), np.concatenate(owners)


def _near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, v = [], []
    for i in range(0, len(a), BLOCK):
        x = a[i : i + BLOCK]
        for j in range(0, len(b), BLOCK):
            p, q = np.nonzero(np.bitwise_count(x[:, None] ^ b[None, j : j + BLOCK]) <= MAX_DISTANCE)
            p, q = forest(x[p], b[j + q])
            u.append(p)
            v.append(q)
    return (np.concatenate(u), np.concatenate(v)) if u else (a[:0], a[:0])


def links(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints. Large runs are cut by 16-bit quarters: linked ones agree in one."""
    if len(run) <= BLOCK:
        return _near(run, run)
    u, v = [], []
    for at in (0, 16, 32, 48):
        quarter = (run >> np.uint64(at)) & np.uint64(0xFFFF)
        order = np.argsort(quarter, kind="stable")
        cuts = np.flatnonzero(np.diff(quarter[order])) + 1
        for part in np.split(run[order], cuts):
            if len(part) > 1:
                p, q = _near(part, part)
                u.append(p)
                v.append(q)
    return forest(np.concatenate(u), np.concatenate(v)) if u else (run[:0], run[:0])


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Lists of words of which each but the first begins with the last SHINGLE - 1 words of the one before."""
    at, tail = 0, []
    while True:
        end = len(data)
        if end - at > STEP:
            end = at + STEP
            while end < len(data) and data[end] not in b" \t\n\v\f\r":
                end += 1
        words = tail + data[at:end].split()
        yield words
        if end >= len(data):
            return
        at, tail = end, words[-(SHINGLE - 1) :]


def ones(h: np.ndarray) -> np.ndarray:
    """How many of some hashes have each of the 64 bits set."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def majority(counts: np.ndarray, total: int) -> int:
    """The number whose bits are those that over half of `total` hashes have set."""
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included, as an unsigned number."""
    data = text.encode("utf-8", "surrogatepass").lower()
    total, counts, short = 0, np.zeros(64, np.int64), []
    digest = xxhash.xxh64_intdigest
    for words in _words(data):
        short = words if len(words) < SHINGLE else []
        h = np.array([digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(SHINGLE)), strict=False)], np.uint64)
        counts += ones(h)
        total += len(h)
    if not total:
        return digest(b" ".join(short), SEED) if short else 0
    return majority(counts, total)


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of every row's whole text as a signed long. Null and wordless texts give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy()
        for i in range(0, len(fp), 8192):
            key, own = keys(fp[i : i + 8192].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i : i + 8192][own])], names=["key", "fp"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges within runs of one key; rows come sorted by key, and a run may go on in the next batch."""
    key_left, fp_left = [], []

    def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        u, v = [fp[:0]], [fp[:0]]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        big = size > 64
        for s, n in zip(starts[big], size[big], strict=True):
            p, q = links(np.unique(fp[s : s + n]))
            u.append(p)
            v.append(q)
        small = ~np.repeat(big, size)
        key, fp = key[small], fp[small]
        for k in range(1, int(size[~big].max(initial=1))):
            at = np.flatnonzero(key[k:] == key[:-k])
            at = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= MAX_DISTANCE]
            u.append(fp[at])
            v.append(fp[at + k])
        a, b = forest(np.concatenate(u), np.concatenate(v))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    for b in batches:
        key, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield edges(np.concatenate([*key_left, key[:cut]]), np.concatenate([*fp_left, fp[:cut]]))
            key_left, fp_left = [], []
        elif key_left and key_left[-1][-1] != key[0]:
            yield edges(np.concatenate(key_left), np.concatenate(fp_left))
            key_left, fp_left = [], []
        key_left.append(key[cut:].copy())
        fp_left.append(fp[cut:].copy())
    if key_left:
        yield edges(np.concatenate(key_left), np.concatenate(fp_left))


def near_links(distinct: DataFrame, most: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect what links of at most 3 bits connect, from distinct fingerprints (fp).

    A key that more than `most` fingerprints have is split by their 16-bit quarters, of which linked ones share one, before they
    are dealt out, so that no task has to hold all fingerprints of a common key.
    """
    spread = distinct.select("fp").mapInArrow(_spread, "key long, fp long")
    hot = materialize(spread.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key"), "hot")
    parts = F.explode(F.array(*(F.xxhash64("key", F.lit(q), F.shiftrightunsigned("fp", 16 * q).bitwiseAND(0xFFFF)) for q in range(4))))
    split = spread.join(hot, "key").select(parts.alias("key"), "fp")
    every = spread.join(hot, "key", "left_anti").unionByName(split)
    return every.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "u long, v long")


def grouped(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows with a fingerprint (fp) and an id, with component_id: the smallest id among all rows that links of fingerprints reach."""
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("rep")), "nodes")
    found = connected_components(near_links(nodes))
    member = nodes.join(found, nodes.fp == found.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.join(member.join(lowest, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: its SimHash and the smallest id among all documents reachable by links.

    Rows with equal fingerprints are one node, so copies are never compared with each other. Null texts count as
    empty (fingerprint 0, linked like any other); repeated ids give repeated rows; a component whose ids are all null
    has a null component_id; an empty table gives an empty one.
    """
    prints = materialize(simhash(docs, id_col, text_col), "simhash")
    return grouped(prints).select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id that links lead to.

    Null, empty and wordless texts have fingerprint zero, linked like any other. Repeated rows and ids give rows of their own; null
    ids never name a component that has another id; an empty table gives none; other columns aren't read; texts are read whole.
    """
    from .common import documents

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
