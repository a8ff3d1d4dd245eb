"""Encoding and decoding with SentencePiece vocabularies by a streaming Viterbi search.

The best segmentation of a text is the one whose pieces have the largest sum of scores. The search keeps only a window of
the text: once the backpointer paths of all positions from which a piece may still begin (as many as the longest piece has
characters) meet at one boundary, the ids before it are final and leave the window. Characters without a piece become
their UTF-8 bytes' pieces, at a score below all others. Of equally good segmentations of what lies before a boundary, the one
that ends in the longest piece is taken.

In most vocabularies no piece goes from one word into the next, so that all paths meet at every word's beginning; then what
a word's stretch of the stream commits depends on it alone. So each distinct stretch is searched once and numbered, and the ids of
texts are gathered by the numbers of their stretches. Where pieces do cross words, a text is one stretch.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: Characters of distinct stretches that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1 << 23
#: Characters of text encoded at once.
STEP = 1 << 20


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only vocabularies without text normalization are supported")
        kinds = proto.ModelProto.SentencePiece
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.text = [p.piece for p in model.pieces]
        self.scores: dict[str, tuple[float, int]] = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i, p in enumerate(model.pieces) if p.type in (kinds.CONTROL, kinds.UNKNOWN)}
        self.unknown_id = next((i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN), 0)
        self.longest = max((len(p) for p in self.scores), default=1)
        self.unknown = min((s for s, _ in self.scores.values()), default=0.0) - UNKNOWN_PENALTY
        #: Score of each piece; None for strings in which only longer pieces end. A string that isn't here ends no piece.
        self.endings: dict[str, float | None] = {p[i:]: None for p in self.scores for i in range(len(p))}
        self.endings |= {p: x for p, (x, _) in self.scores.items()}
        self.crosses = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.scores)
        shared = {c for p in self.scores if len(p) > 1 for c in p}
        inner = "".join(sorted(re.escape(c) for c in shared if c != BLANK))
        #: Stretches between boundaries at which all paths meet: blanks and characters of longer pieces, or one other character.
        self.stretch = re.compile(f"{BLANK}*[{inner}]+|{BLANK}+|[^{inner}{BLANK}]" if inner else f"{BLANK}+|[^{BLANK}]", re.S)

    def normalized(self, text: str) -> str:
        return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK)

    def ids_of(self, piece: str) -> list[int]:
        found = self.scores.get(piece)
        if found:
            return [found[1]]
        return [self.bytes.get(b, self.unknown_id) for b in piece.encode("utf-8", "surrogatepass")]


class StreamingViterbi:
    """feed() text in any portions, then finish(); both return the ids that became final."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.window, self.best, self.back, self.largest, self.checked = vocabulary, "", [0.0], [0], 0, 0

    def feed(self, text: str) -> list[int]:
        v, out = self.v, []
        endings, longest, unknown = v.endings, v.longest, v.unknown
        for c in text:
            window = self.window = self.window + c
            best, n = self.best, len(window)
            top, length = best[n - 1] + unknown, 1
            for k in range(1, min(longest, n) + 1):
                found = endings.get(window[n - k :], best)
                if found is best:
                    break
                if found is not None and ((score := best[n - k] + found) >= top or k == 1):
                    top, length = score, k
            best.append(top)
            self.back.append(length)
            if n - self.checked >= longest:
                self.largest = max(self.largest, n)
                out += self._commit(self._meeting(n))
                self.checked = len(self.window)
        self.largest = max(self.largest, len(self.window))
        return out

    def finish(self) -> list[int]:
        return self._commit(len(self.window))

    def _meeting(self, n: int) -> int:
        """The last boundary on the paths of all positions from which a piece may still begin."""
        live = set(range(max(0, n + 1 - self.v.longest), n + 1))
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(last - self.back[last])
        return live.pop()

    def _commit(self, at: int) -> list[int]:
        pieces, p = [], at
        while p:
            pieces.append(self.window[p - self.back[p] : p])
            p -= self.back[p]
        base = self.best[at]
        self.window = self.window[at:]
        self.best = [x - base for x in self.best[at:]]
        self.back = [0, *self.back[at + 1 :]]
        return [i for piece in reversed(pieces) for i in self.v.ids_of(piece)]


class Stretches(dict):
    """Numbers of the distinct stretches met so far; the ids of number k are ids[ends[k] : ends[k + 1]]."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.ids, self.ends, self.characters, self.largest = vocabulary, array("i"), array("q", [0]), 0, 0

    def __missing__(self, stretch: str) -> int:
        stream = StreamingViterbi(self.v)
        self.ids.extend(stream.feed(stretch))
        self.ids.extend(stream.finish())
        self.ends.append(len(self.ids))
        self.characters += len(stretch)
        self.largest = max(self.largest, stream.largest)
        self[stretch] = number = len(self)
        return number


def _gathered(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values[ends[k] : ends[k + 1]] for each k of which, one after the other; where each ends, from 0 on)."""
    size = np.diff(ends)[which]
    to = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    return values[np.repeat(ends[which] - to[:-1], size) + np.arange(to[-1])], to


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.known = Stretches(v)
        said = [bytes([v.byte_of[i]]) if i in v.byte_of else b"" if i in v.control else p.replace(BLANK, " ").encode() for i, p in enumerate(v.text)]
        self.said, self.said_ends = np.frombuffer(b"".join(said), np.uint8), np.cumsum([0, *map(len, said)])

    def _numbers(self, text: str) -> np.ndarray:
        text = self.v.normalized(text)
        if self.v.crosses:
            return np.array([self.known[text]] if text else [], np.int64)
        if len(text) <= STEP:
            found = self.v.stretch.findall(text)
            return np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        return np.fromiter((self.known[m[0]] for m in self.v.stretch.finditer(text)), np.int64)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where those of each text end, from 0 on)."""
        if self.known.characters > REMEMBERED:
            self.known = Stretches(self.v)
        numbers = [self._numbers(t) for t in texts]
        ids, to = _gathered(np.array(self.known.ids, np.int32), np.array(self.known.ends, np.int64), np.concatenate([np.zeros(0, np.int64), *numbers]))
        return ids, to[np.cumsum([0, *map(len, numbers)])]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each range of ids; bytes that byte pieces leave incomplete stay as they are."""
        data, to = _gathered(self.said, self.said_ends, ids)
        data, to = data.tobytes(), to[ends].tolist()
        skip = self.v.prefix
        return [data[a + (skip and data[a : a + 1] == b" " and a < b) : b] for a, b in zip(to[:-1], to[1:], strict=True)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.array(list(ids), np.int64)
        return self.decode_all(ids, np.array([0, len(ids)]))[0].decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def codec(model: str = MODEL) -> Codec:
    """The codec for a model file (a path, or a name that public_tokenizers knows), one for each process."""
    import public_tokenizers

    return Codec(Vocabulary(model if os.path.sep in model else public_tokenizers.path(model)))


def _portions(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of about STEP bytes at a time."""
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)).tolist() if texts.type == pa.string() else [len(t.as_py()) for t in texts]
    for a, b in slices(size, STEP):
        yield a, texts.slice(a, b - a).to_pylist()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, ids) for every row's whole text. Null and empty texts have no ids; repeated rows and ids give repeated rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            for at, texts in _portions(b.column(1)):
                ids, ends = c.encode_all(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Null ids give null texts, no ids an empty one; incomplete byte pieces become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else c.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op7_sentencepieces(spark, sf_dir: str) -> DataFrame:
    """Number and checksum of every document's ids, and whether they decode to the text.

    Null and empty texts have no ids, checksum 0 and a round trip; a text's own U+2581 decodes to a blank, as the vocabulary has it.
    Repeated rows, repeated and null ids give rows of their own; an empty table gives none; other columns aren't read.
    """
    from .common import documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(MODEL)
        for b in batches:
            for at, texts in _portions(b.column(1)):
                ids, ends = c.encode_all(texts)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                same = [x == t.replace(BLANK, " ").encode("utf-8", "surrogatepass") for x, t in zip(c.decode_all(ids, ends), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(np.diff(ends)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return id_text(documents(spark, sf_dir)).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
