"""Removal of byte strings that also occur in an earlier document, through suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. A suffix array of all
text would need many times the input in sorted records; most suffixes have no partner, and most that have one lie in
whole copies. So the text is cut down first, without losing a match:

1. Anchors. In every window of LENGTH bytes the (leftmost) GRAM-byte string with the smallest hash is an anchor; equal
   windows have equal anchors. Around an anchor lies its context: all bytes of the windows that can have it.
2. Anchors meet by hash. Where the whole contexts are equal too, all windows of the later documents are covered. An anchor
   with different contexts in different documents stays open, for the first document of each context only.
3. The contexts of open anchors that agree with another document's on more than the anchor, grouped by anchor, are suffix-sorted, by the difference-cover algorithm:
   sampled triples, recursion on names, merging of the rest. Neighbours with equal LENGTH-byte prefixes are the same
   string; the smallest document keeps it.
4. What is covered goes back to the documents.

Every step moves packed columns between hash partitions. A task compares its own anchors first, so that of a context it
holds many times only one document's travels. Anchors that stay open in very many contexts (the end of a line that a large
part of all documents shares) are not gathered in one task: their windows are dealt out by a 128-bit hash of their bytes.
Anchors' contexts are compared by 64-bit hashes within one 64-bit anchor hash.
"""

from __future__ import annotations

import gc
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, exchange, id_text, materialize, mix, packed, partitions, slices
from .spotsigs import BASE, INVERSE, LOWEST, _powers
from .suffix import equal_prefixes, suffix_array

LENGTH = 50
GRAM = 20
WINDOW = LENGTH - GRAM + 1
#: Bytes of text worked on at once, and of contexts sorted at once.
STEP = 2 << 20
SORT = 1 << 19
#: Different contexts of one anchor above which its windows are dealt out one by one.
HOT = 20_000

TEXT, ANCHOR, OPEN, HOT_OPEN, COVER, CONTEXT, WINDOW_HASH = range(7)
#: A cover record on its way through an exchange for something else: this plus the partition it is for.
VIA = 100
OTHER_BASE = np.uint64(0xD6E8FEB86659FD93)
OTHER_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def pack_columns(*columns: np.ndarray) -> bytes:
    """Columns of equal length, bytes of equal rank together, compressed."""
    parts = [np.array([len(columns[0])], "<u4").tobytes()]
    for c in columns:
        parts.append(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack_columns(data: bytes, *types: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, at, out = int(raw[:4].view("<u4")[0]), 4, []
    for t in map(np.dtype, types):
        out.append(np.ascontiguousarray(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).reshape(n))
        at += n * t.itemsize
    return out


def joined(blobs: list[bytes], *types: str) -> list[np.ndarray]:
    cols = [unpack_columns(b, *types) for b in blobs]
    return [np.concatenate([c[i] for c in cols]) if cols else np.zeros(0, t) for i, t in enumerate(types)]


def _split(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), order[cuts[p] : cuts[p + 1]]


def _doc_part(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _tag(data: bytes) -> int:
    return zlib.crc32(data)


def _key(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """One number for a document and the tag of one of its texts."""
    return mix(doc.astype(np.int64).view(np.uint64) * OTHER_BASE + tag.astype(np.uint64))


class Rolling:
    """Hashes of any substrings of an array of bytes."""

    def __init__(self, data: np.ndarray, base: np.uint64 = BASE, inverse: np.uint64 = INVERSE):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, len(data)), dtype=np.uint64)])
        self.back = _powers(inverse, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def anchors(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text index, position in it, anchor hash, context hash) of all anchors of some texts."""
    data = np.frombuffer(b"".join(blobs), np.uint8)
    size = np.array([len(b) for b in blobs], np.int64)
    ends = np.cumsum(size)
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    end_of = np.repeat(ends, size)
    rolling = Rolling(data)
    at = np.arange(n)
    value = np.full(n + WINDOW, NONE)
    m = n - GRAM + 1
    value[:m] = rolling(at[:m], at[:m] + GRAM)
    value[:n][at + GRAM > end_of] = NONE
    best = np.arange(n + WINDOW)
    low = value.copy()
    reach = 1
    while reach < WINDOW:
        s = min(reach, WINDOW - reach)
        right = low[s:] < low[:-s]
        best[:-s] = np.where(right, best[s:], best[:-s])
        low[:-s] = np.where(right, low[s:], low[:-s])
        reach += s
    chosen = np.zeros(n, bool)
    chosen[best[:n][at + LENGTH <= end_of]] = True
    a = np.flatnonzero(chosen)
    text = np.searchsorted(ends, a, "right")
    begin, end = ends[text] - size[text], ends[text]
    left, right = np.maximum(a - WINDOW + 1, begin), np.minimum(a + LENGTH, end)
    shape = ((a - left) << 8 | (right - a)).astype(np.uint64)
    return text, a - begin, value[a], mix(rolling(left, right) + shape * OTHER_BASE)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Number of the group of each row of sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _cover(rows: list, doc, tag, start, count, n: int, via: int | None = None) -> None:
    """Records that `count` windows from `start` on are covered, for the documents' partitions."""
    for p, i in _split(_doc_part(doc, n), n):
        data = pack_columns(doc[i], tag[i], start[i].astype("<u4"), count[i].astype("<u4"))
        rows.append((p, COVER, data) if via is None else (via % n, VIA + p, data))


def _earlier(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys and document, whether each row in that order is of a later document than the first of its key)."""
    order = np.lexsort((doc, *keys[::-1]))
    g = _groups(*(k[order] for k in keys))
    first = doc[order][np.searchsorted(g, g)]
    return order, doc[order] > first


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    for b in batches:
        ids = b.column(0).fill_null(LOWEST).to_numpy()
        blobs = [t.as_py().encode("utf-8", "surrogatepass") for t in b.column(1)]
        for i, j in slices([len(x) for x in blobs], STEP):
            yield ids[i:j], blobs[i:j]


#: Anchors that a task compares with each other before it sends them.
HELD = 1 << 20


def _send_anchors(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            doc, tag, pos, h, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order, later = _earlier([h, x], doc)
            rows: list = []
            o = order[later]
            start = np.maximum(pos[o] - WINDOW + 1, 0)
            _cover(rows, doc[o], tag[o], start, pos[o] - start + 1, n, int(h[order[0]] % np.uint64(n)) if len(order) else 0)
            o = order[~later]
            for p, i in _split((h[o] % np.uint64(n)).astype(np.int64), n):
                i = o[i]
                _, known, index = np.unique(_key(doc[i], tag[i]), return_index=True, return_inverse=True)
                known = i[known]
                rows.append((p, ANCHOR, len(known).to_bytes(4, "little") + b"".join(len(c).to_bytes(4, "little") + c for c in (pack_columns(doc[known], tag[known]), pack_columns(h[i], x[i], index.astype("<u4"), pos[i].astype("<u4"))))))
            return packed(rows)

        size = 0
        for ids, blobs in _texts(batches):
            text, pos, h, x = anchors(blobs)
            tags = np.array([_tag(b) for b in blobs], np.uint32)
            held.append((ids[text], tags[text], pos, h, x))
            size += len(pos)
            if size >= HELD:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _read_anchors(blobs: list[bytes]) -> list[np.ndarray]:
    cols = []
    for b in blobs:
        at, parts = 4, []
        for _ in range(2):
            size = int.from_bytes(b[at : at + 4], "little")
            parts.append(b[at + 4 : at + 4 + size])
            at += 4 + size
        doc, tag = unpack_columns(parts[0], "<i8", "<u4")
        h, x, index, pos = unpack_columns(parts[1], "<u8", "<u8", "<u4", "<u4")
        cols.append((h, x, doc[index], tag[index], pos))
    return [np.concatenate(c) for c in zip(*cols, strict=True)] if cols else [np.zeros(0, t) for t in ("<u8", "<u8", "<i8", "<u4", "<u4")]


def _by_kind(batches: Iterator[pa.RecordBatch]) -> dict[int, list[bytes]]:
    out = defaultdict(list)
    for b in batches:
        for kind, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            out[kind].append(data)
    return out


def _passed_on(got: dict[int, list[bytes]]) -> list[tuple[int, int, bytes]]:
    return [(kind - VIA, COVER, data) for kind, blobs in got.items() if kind >= VIA for data in blobs]


def _meet_anchors(n: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _by_kind(batches)
        rows = _passed_on(got)
        h, x, doc, tag, pos = _read_anchors(got[ANCHOR])
        if len(h):
            order, later = _earlier([h, x], doc)
            o = order[later]
            start = np.maximum(pos[o].astype(np.int64) - WINDOW + 1, 0)
            _cover(rows, doc[o], tag[o], start, pos[o] - start + 1, n)
            o = order[~later]
            g = _groups(h[o])
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            varied = (np.minimum.reduceat(doc[o], starts) != np.maximum.reduceat(doc[o], starts))[g]
            contexts = np.add.reduceat(np.r_[1, np.diff(_groups(h[o], x[o]))], starts)[g]
            for kind, mine in ((OPEN, varied & (contexts <= hot)), (HOT_OPEN, varied & (contexts > hot))):
                i = o[mine]
                for p, k in _split(_doc_part(doc[i], n), n):
                    k = i[k]
                    rows.append((p, kind, pack_columns(h[k], doc[k], tag[k], pos[k])))
        yield packed(rows)

    return run


def _send_texts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        blobs: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc, length = np.concatenate(ids), np.array([len(b) for b in blobs], "<u4")
            rows = []
            for p, i in _split(_doc_part(doc, n), n):
                body = zstandard.ZstdCompressor(level=3).compress(b"".join(blobs[k] for k in i))
                rows.append((p, TEXT, len(i).to_bytes(4, "little") + doc[i].astype("<i8").tobytes() + length[i].tobytes() + body))
            ids.clear()
            blobs.clear()
            return packed(rows)

        for more, found in _texts(batches):
            ids.append(more)
            blobs += found
            size += sum(map(len, found))
            if size >= 8 * STEP:
                yield flush()
                size = 0
        if blobs:
            yield flush()

    return run


def _read_texts(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
    for b in blobs:
        n = int.from_bytes(b[:4], "little")
        doc = np.frombuffer(b, "<i8", n, 4)
        length = np.frombuffer(b, "<u4", n, 4 + 8 * n)
        body, at = zstandard.ZstdDecompressor().decompress(b[4 + 12 * n :]), 0
        for d, k in zip(doc.tolist(), length.tolist(), strict=True):
            yield d, body[at : at + k]
            at += k


def _places(texts: list[tuple[int, bytes]], doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Index of the text of each (document, tag); of equal texts of one document always the same one."""
    known = _key(np.array([d for d, _ in texts], np.int64), np.array([_tag(b) for _, b in texts], np.uint32))
    order = np.argsort(known, kind="stable")
    return order[np.searchsorted(known[order], _key(doc, tag))]


def _send_contexts(n: int):
    """Texts and their open anchors -> contexts for the anchors' partitions; windows of hot anchors for those of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _by_kind(batches)
        texts = list(_read_texts(got[TEXT]))
        rows: list = []
        for kind in (OPEN, HOT_OPEN):
            h, doc, tag, pos = joined(got[kind], "<u8", "<i8", "<u4", "<u4")
            if not len(h):
                continue
            pos = pos.astype(np.int64)
            place = _places(texts, doc, tag)
            size = np.array([len(b) for _, b in texts], np.int64)
            begin = np.cumsum(size) - size
            data = np.frombuffer(b"".join(b for _, b in texts), np.uint8)
            left, right = np.maximum(pos - WINDOW + 1, 0), np.minimum(pos + LENGTH, size[place])
            if kind == OPEN:
                for p, i in _split((h % np.uint64(n)).astype(np.int64), n):
                    long = right[i] - left[i]
                    source = np.repeat(begin[place[i]] + left[i] - np.cumsum(long) + long, long) + np.arange(long.sum())
                    rows.append((p, CONTEXT, b"".join(len(c).to_bytes(4, "little") + c for c in (pack_columns(h[i], doc[i], tag[i], left[i].astype("<u4"), (pos[i] - left[i]).astype("<u1"), long.astype("<u1")), zstandard.ZstdCompressor(level=1).compress(data[source].tobytes())))))
            else:
                count = right - left - LENGTH + 1
                own = np.repeat(np.arange(len(h)), count)
                start = np.repeat(left - np.cumsum(count) + count, count) + np.arange(count.sum())
                seen = np.unique(np.rec.fromarrays([begin[place[own]] + start, own], names="at,own"))
                seen = seen[np.r_[True, seen["at"][1:] != seen["at"][:-1]]]
                at, own = seen["at"], seen["own"]
                a, b = Rolling(data)(at, at + LENGTH), Rolling(data, OTHER_BASE, OTHER_INVERSE)(at, at + LENGTH)
                start = (at - begin[place[own]]).astype("<u4")
                order, later = _earlier([a, b], doc[own])
                o = order[later]
                _cover(rows, doc[own[o]], tag[own[o]], start[o], np.ones(len(o), "<u4"), n, 0)
                o = order[~later]
                for p, i in _split((a[o] % np.uint64(n)).astype(np.int64), n):
                    i = o[i]
                    rows.append((p, WINDOW_HASH, pack_columns(a[i], b[i], doc[own[i]], tag[own[i]], start[i])))
        yield packed(rows)

    return run


def repeated_windows(contexts: list[bytes], doc: np.ndarray) -> list[tuple[int, int]]:
    """(context, start in it) of every LENGTH-byte string that also starts in a context of a smaller document."""
    size = np.array([len(c) for c in contexts], np.int64)
    text = np.empty(int(size.sum()) + len(contexts), np.int64)
    ends = np.cumsum(size + 1) - 1
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = np.frombuffer(b"".join(contexts), np.uint8)
    text[ends] = 256 + np.arange(len(contexts))
    order = suffix_array(text)
    own = np.repeat(np.arange(len(contexts)), size + 1)
    order = order[ends[own[order]] - order >= LENGTH]
    if not len(order):
        return []
    g = np.cumsum(np.r_[True, ~equal_prefixes(text, order, LENGTH)]) - 1
    d = doc[own[order]]
    low = np.minimum.reduceat(d, np.flatnonzero(np.r_[True, g[1:] != g[:-1]]))[g]
    hit = order[d > low]
    return list(zip(own[hit].tolist(), (hit - (ends - size)[own[hit]]).tolist(), strict=True))


def _may_match(data: np.ndarray, doc: np.ndarray, begin: np.ndarray, at: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which contexts share half a window's rest with a context of another document.

    A window has LENGTH - GRAM bytes beside its anchor, so at least half of them on one side: equal windows agree in the anchor
    with as many bytes before it, or in the anchor with as many after it.
    """
    half = (LENGTH - GRAM + 1) // 2
    rolling, out = Rolling(data), np.zeros(len(doc), bool)
    for there, start, end in ((at >= half, begin + at - half, begin + at + GRAM), (long - at - GRAM >= half, begin + at, begin + at + GRAM + half)):
        i = np.flatnonzero(there)
        key = rolling(start[i], end[i])
        order = np.lexsort((doc[i], key))
        if len(order):
            g = _groups(key[order])
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            d = doc[i][order]
            out[i[order[(np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts))[g]]]] = True
    return out


def _sort_contexts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _by_kind(batches)
        rows = _passed_on(got)
        head, body = [], []
        for b in got[CONTEXT]:
            size = int.from_bytes(b[:4], "little")
            head.append(b[4 : 4 + size])
            body.append(zstandard.ZstdDecompressor().decompress(b[8 + size :]))
        h, doc, tag, left, at, long = joined(head, "<u8", "<i8", "<u4", "<u4", "<u1", "<u1")
        data, long = b"".join(body), long.astype(np.int64)
        begin = np.cumsum(long) - long
        live = _may_match(np.frombuffer(data, np.uint8), doc, begin, at.astype(np.int64), long)
        h, doc, tag, left, long, begin = (c[live] for c in (h, doc, tag, left, long, begin))
        order = np.lexsort((begin, h))
        group = _groups(h[order]) if len(h) else h
        cuts = np.flatnonzero(np.diff(group, prepend=-1)) if len(h) else np.zeros(0, np.int64)
        bounds = np.r_[cuts, len(h)]
        per = np.add.reduceat(long[order], cuts) if len(h) else []
        for a, b in slices(per, SORT):
            mine = order[bounds[a] : bounds[b]]
            found = repeated_windows([data[begin[i] : begin[i] + long[i]] for i in mine], doc[mine])
            if found:
                i, s = (np.array(c, np.int64) for c in zip(*found, strict=True))
                i = mine[i]
                _cover(rows, doc[i], tag[i], left[i] + s, np.ones(len(i), "<u4"), n)
        a, b, doc, tag, start = joined(got[WINDOW_HASH], "<u8", "<u8", "<i8", "<u4", "<u4")
        if len(a):
            order, later = _earlier([a, b], doc)
            o = order[later]
            _cover(rows, doc[o], tag[o], start[o], np.ones(len(o), "<u4"), n)
        yield packed(rows)

    return run


SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary, kept_text string, text_hash long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _remove(digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _by_kind(batches)
        texts = list(_read_texts(got[TEXT]))
        doc, tag, start, count = joined(got[COVER], "<i8", "<u4", "<u4", "<u4")
        if not texts:
            return
        size = np.array([len(b) for _, b in texts], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        change = np.zeros(int((size + 1).sum()) + 1, np.int32)
        if len(doc):
            place = _places(texts, doc, tag)
            first = begin[place] + start
            # windows end with the text, also where an anchor's last ones don't exist
            last = begin[place] + np.minimum(start.astype(np.int64) + count + LENGTH - 1, size[place])
            np.add.at(change, first, 1)
            np.add.at(change, last, -1)
        gone = np.cumsum(change) > 0
        # equal texts of one id have equal records, all of them taken by one of these texts
        taker = _places(texts, np.array([d for d, _ in texts], np.int64), np.array([_tag(b) for _, b in texts], np.uint32))
        out: list[list] = [[] for _ in range(9)]
        weight = 0
        for k, (d, b) in enumerate(texts):
            j = taker[k]
            cut = gone[begin[j] : begin[j] + size[j]]
            edge = np.flatnonzero(np.diff(np.r_[False, cut, False].astype(np.int8)))
            kept = np.frombuffer(b, np.uint8)[~cut].tobytes()
            spans = [] if digests else [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()]
            for c, v in zip(out, (None if d == LOWEST else d, len(b), int(cut.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), spans, b"" if digests else kept, "" if digests else kept.decode("utf-8", "ignore"), _signed(xxhash.xxh64_intdigest(b, 42))), strict=True):
                c.append(v)
            weight += len(b)
            if weight > 8 * STEP:
                yield _batch(out)
                out, weight = [[] for _ in range(9)], 0
        yield _batch(out)

    def _batch(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "kept_text", "text_hash"])

    return run


def _finished(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; the shuffle files behind it, often larger than the input, are let go."""
    out = materialize(df, name)
    del df
    gc.collect()
    out.sparkSession._jvm.System.gc()
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, hot: int = HOT) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed, in bytes), kept and
    kept_text (without characters of which some bytes are gone), text_hash (Spark's xxhash64 of the whole text).

    digests leaves the last three empty. Null texts are empty texts. A null id counts as smaller than every other.
    Rows with the same id are one document: none of them removes bytes of another, and repeated rows get equal results.
    Matches never cross texts. An empty table gives an empty one.
    """
    n = partitions(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)
    met = _finished(exchange(rows.mapInArrow(_send_anchors(n), PACKED), n).mapInArrow(_meet_anchors(n, hot), PACKED), "anchors")
    texts = rows.mapInArrow(_send_texts(n), PACKED)
    contexts = exchange(texts.unionByName(met.filter(F.col("kind").isin(OPEN, HOT_OPEN))), n).mapInArrow(_send_contexts(n), PACKED)
    covers = _finished(exchange(contexts, n).mapInArrow(_sort_contexts(n), PACKED), "covers")
    every = texts.unionByName(met.filter(F.col("kind") == COVER)).unionByName(covers)
    return exchange(every, n).mapInArrow(_remove(digests), SPANS)


def op10_suffix_array(spark, sf_dir: str) -> DataFrame:
    """What earlier documents leave of every document's bytes.

    Null and empty texts have no bytes. Rows with the same id are one document; a null id comes before all others; repeated rows give
    equal rows; an empty table gives none; other columns aren't read; texts are read whole, and matches never cross them.
    """
    from .common import documents

    return remove_repeats(documents(spark, sf_dir), digests=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
