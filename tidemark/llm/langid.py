"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
ALPHA = 0.5
#: Languages of one matrix (4 bytes for each language and bucket), which is broadcast. More languages are more matrices.
LANGUAGES = 64
#: Code points whose n-grams are hashed at once; bounds a worker's memory whatever the batch holds.
STEP = 1 << 19
#: First code points of n-grams in one portion of a very long text.
PIECE = 1 << 18


def _codes(text: str) -> np.ndarray:
    """The code points of a text in lower case with a blank at either end; runs of ASCII non-letters are single blanks."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (c < 128) & ((c < 97) | (c > 122))
    return np.where(blank, np.uint32(32), c)[~(blank & np.r_[False, blank[:-1]])]


def _features(pieces: list[np.ndarray], starts: list[int], orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, index of the piece) for each n-gram that lies in one piece and begins in its first `starts` code points."""
    size = [len(c) for c in pieces]
    c, own = np.concatenate(pieces).astype(np.uint64), np.repeat(np.arange(len(pieces), dtype=np.int32), size)
    first = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(starts, size)
    out, owners = [], []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(orders) + 1):
        if n > len(c):
            break
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
        if n in orders:
            mine = (own[: len(h)] == own[n - 1 :]) & first[: len(h)]
            out.append((mix(h[mine]) & np.uint64(buckets - 1)).astype(np.int64))
            owners.append(own[: len(h)][mine])
    return np.concatenate(out), np.concatenate(owners)


def _portions(texts: list[str], orders: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, index of the text) of all n-grams, about STEP code points at a time.

    A long text's pieces overlap by the length of an n-gram less one, so each of its n-grams is in just one portion.
    """
    own: list[int] = []
    pieces: list[np.ndarray] = []
    starts: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        c = _codes(t)
        for at in range(0, len(c), PIECE):
            if size and size + min(PIECE, len(c) - at) > STEP:
                feature, of = _features(pieces, starts, orders, buckets)
                yield feature, np.array(own)[of]
                own, pieces, starts, size = [], [], [], 0
            own.append(i)
            pieces.append(c[at : at + PIECE + max(orders) - 1])
            starts.append(PIECE)
            size += len(pieces[-1])
    if pieces:
        feature, of = _features(pieces, starts, orders, buckets)
        yield feature, np.array(own)[of]


def counts(docs: DataFrame, text_col: str, lang_col: str, orders=ORDERS, buckets: int = BUCKETS, languages: int = LANGUAGES) -> DataFrame:
    """(lang, feature, n): n-gram counts by language over all rows; feature -1 counts the documents.

    Each task sums over `languages` languages at a time, so it returns few rows for a language and feature where there are few
    languages, and its memory doesn't grow with their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, row in total.items():
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(at), pa.string()), pa.array(np.where(at == buckets, -1, at).astype(np.int32)), pa.array(row[at])], names=["lang", "feature", "n"])
            total.clear()

        for b in batches:
            every, code = np.unique(np.array(b.column(1).to_pylist(), object).astype(str), return_inverse=True)
            for first in range(0, len(every), languages):
                own = (code >= first) & (code < first + languages)
                names, mine = every[first : first + languages], code[own] - first
                if len(total.keys() | set(names)) > languages:
                    yield from emptied()
                for name, n in zip(names, np.bincount(mine, minlength=len(names)), strict=True):
                    total.setdefault(name, np.zeros(buckets + 1, np.int64))[buckets] += n
                texts = b.column(0).filter(pa.array(own)).to_pylist()
                for feature, of in _portions(texts, orders, buckets):
                    cell, n = np.unique(mine[of] * buckets + feature, return_counts=True)
                    cut = np.searchsorted(cell, np.arange(len(names) + 1) * buckets)
                    for k, name in enumerate(names):
                        total[name][cell[cut[k] : cut[k + 1]] - k * buckets] += n[cut[k] : cut[k + 1]]
        yield from emptied()

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log-probabilities (features x languages) and log-priors. Its size is the number of buckets times that of languages."""

    def __init__(self, langs: list[str], prior: np.ndarray, matrix: np.ndarray, orders: tuple[int, ...]):
        self.langs, self.prior, self.matrix, self.orders = langs, prior, matrix, orders

    @staticmethod
    def blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", orders=ORDERS, buckets: int = BUCKETS, alpha: float = ALPHA, languages: int = LANGUAGES) -> list[LanguageModel]:
        """Models of at most `languages` languages each, in sorted order, that share their priors' sum: together they are one model."""
        rows = materialize(counts(docs, text_col, lang_col, orders, buckets, languages), "ngrams")
        documents = rows.filter("feature = -1")
        total = documents.agg(F.sum("n")).first()[0] or 0
        out, last = [], None
        while True:
            following = documents if last is None else documents.filter(F.col("lang") > F.lit(last))
            known = following.orderBy("lang").limit(languages).select("lang", "n").collect()
            if not known:
                return out
            names = [r.lang for r in known]
            code = F.array_position(F.array(*map(F.lit, names)), F.col("lang")) - 1
            own = rows.filter(F.col("lang").between(names[0], names[-1]) & (F.col("feature") >= 0)).select("feature", code.cast("int").alias("code"), "n").toPandas()
            table = np.full((buckets, len(names)), alpha)
            table[own.feature.to_numpy(), own.code.to_numpy()] += own.n.to_numpy()
            prior = np.log(np.array([r.n for r in known]) / max(total, 1))
            out.append(LanguageModel(names, prior, np.log(table / table.sum(axis=0)).astype(np.float32), tuple(orders)))
            last = names[-1]

    @staticmethod
    def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", orders=ORDERS, buckets: int = BUCKETS, alpha: float = ALPHA) -> LanguageModel:
        """One model of all languages, for few of them."""
        found = LanguageModel.blocks(docs, text_col, lang_col, orders, buckets, alpha)
        if len(found) < 2:
            return found[0] if found else LanguageModel([], np.zeros(0), np.zeros((buckets, 0), np.float32), tuple(orders))
        return LanguageModel([x for m in found for x in m.langs], np.concatenate([m.prior for m in found]), np.concatenate([m.matrix for m in found], axis=1), tuple(orders))

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.tile(self.prior, (len(texts), 1))
        for feature, own in _portions(texts, self.orders, len(self.matrix)):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            np.add.at(out, own[starts], np.add.reduceat(self.matrix[feature], starts, axis=0, dtype=np.float64))
        return out


def predict(docs: DataFrame, model: LanguageModel | list[LanguageModel], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep`, lang_pred and score (the posterior of the predicted language, 0 to 1).

    lang_pred is `und` with score 0 if the text is null or has no letter, or if nothing was learned. Ties go to the
    first language in sorted order. With several models, of more and more languages, every text passes each of them: the best
    so far and the sum of the likelihoods are carried along, so the result is that of one model, whatever their number.
    """
    from pyspark.sql import types as T

    models = [m for m in (model if isinstance(model, list) else [model]) if m.langs]
    rows = docs.select(*keep, F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("_text"), F.lit("und").alias("lang_pred"), F.lit(float("-inf")).alias("_best"), F.lit(float("-inf")).alias("_sum"))
    fields = [f if f.name not in ("_best", "_sum", "lang_pred") else T.StructField(f.name, f.dataType) for f in rows.schema.fields]
    for m in models:
        rows = rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(m), len(fields)), T.StructType(fields))
    score = F.when(F.col("lang_pred") == "und", 0.0).otherwise(F.exp(F.col("_best") - F.col("_sum")))
    return rows.select(*keep, "lang_pred", score.alias("score"))


def _scorer(shared, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(width - 4).to_pylist()
            langs, best, total = (b.column(width - k).to_numpy(zero_copy_only=False).copy() for k in (3, 2, 1))
            own = [i for i, t in enumerate(texts) if t is not None]
            if own:
                x = m.logits([texts[i] for i in own])
                top = x.max(axis=1)
                better = top > best[own]
                at = np.array(own)
                langs[at[better]] = np.array(m.langs, object)[x.argmax(axis=1)][better]
                best[at[better]] = top[better]
                total[at] = np.logaddexp(total[at], top + np.log(np.exp(x - top[:, None]).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([*b.columns[: width - 3], pa.array(langs, pa.string()), pa.array(best), pa.array(total)], names=b.schema.names)

    return run


def op9_langid(spark, sf_dir: str) -> DataFrame:
    """Learns where crc32(doc_id) mod 3 is not 1 and lang is known; predicts every document, however long its text.

    A null id isn't held out. Null texts and texts without a letter are `und`; repeated rows count each and give rows of their
    own; an empty table gives none; other columns aren't read.
    """
    from .common import documents

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"))
    models = LanguageModel.blocks(docs.filter(~F.col("held_out")))
    return predict(docs, models, ["doc_id", "held_out"])
