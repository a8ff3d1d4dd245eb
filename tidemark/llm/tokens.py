"""Encoding with public tokenizers, and exact statistics of encoded lengths."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, materialize

TOKENIZER = "byte_bpe_50k.json"


@functools.lru_cache(maxsize=4)
def encoder(name: str = TOKENIZER) -> Callable[[str], np.ndarray]:
    """text -> ids of the tokenizer file `name` (a path, or a name that public_tokenizers knows), without special tokens.

    Where the vocabulary also lies beside it as ranks (.tiktoken), texts without a special token's string go through
    those, which give the same ids in a fifth of the time.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = name if os.path.sep in name else public_tokenizers.path(name)
    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) for every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            n = np.fromiter((len(encode(t.as_py())) for t in b.column(1)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=["doc_id", "n_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, col: str = "n_tokens", width: int = 256) -> DataFrame:
    """The exact histogram of lengths with prefix and suffix sums: one row for each length that occurs.

    limit_tokens is the length, n_docs the documents of it, docs_over and tokens_over the documents longer than it and
    their tokens, total_tokens all tokens, kept_tokens the total if every document is cut to limit_tokens, quantile the
    share of documents not longer. Between two rows kept_tokens is linear, so the table answers every context limit.
    Documents are counted before anything is ordered; the sums run within bands of `width` lengths and over the bands,
    so no task holds more than `width` lengths or one row for each band. Null lengths are left out; an empty table gives none.
    The histogram is written to the shared folder, so that what counts the lengths runs once.
    """
    hist = lengths.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("long").alias("limit_tokens")).agg(F.count("*").alias("n_docs"))
    hist = materialize(hist, "lengths")
    hist = hist.withColumn("band", F.floor(F.col("limit_tokens") / width)).withColumn("tokens", F.col("limit_tokens") * F.col("n_docs"))
    bands = hist.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy("band").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = bands.select("band", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_over"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_over"), F.sum("d").over(whole).alias("d_all"), F.sum("t").over(whole).alias("total_tokens"))
    inner = Window.partitionBy("band").orderBy("limit_tokens").rowsBetween(1, Window.unboundedFollowing)
    rows = hist.withColumn("d_in", F.coalesce(F.sum("n_docs").over(inner), F.lit(0))).withColumn("t_in", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(bands, "band")
    over, more = F.col("d_in") + F.col("d_over"), F.col("t_in") + F.col("t_over")
    return rows.select("limit_tokens", "n_docs", over.alias("docs_over"), more.alias("tokens_over"), "total_tokens", (F.col("total_tokens") - more + over * F.col("limit_tokens")).alias("kept_tokens"), (1 - over / F.col("d_all")).alias("quantile"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(limit_tokens, total_tokens, kept_tokens, docs_over) for any context limits, from the histogram's rows alone."""
    wanted = F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))).alias("wanted")
    cut = F.least("limit_tokens", "wanted") * F.col("n_docs")
    grouped = histogram.select("limit_tokens", "n_docs", wanted).groupBy("wanted").agg(F.sum(F.col("limit_tokens") * F.col("n_docs")).alias("total_tokens"), F.sum(cut).alias("kept_tokens"), F.sum(F.when(F.col("limit_tokens") > F.col("wanted"), F.col("n_docs")).otherwise(0)).alias("docs_over"))
    return grouped.withColumnRenamed("wanted", "limit_tokens")


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least the share q of all documents don't exceed."""
    return histogram.filter(F.col("quantile") >= q - 1e-12).agg(F.min("limit_tokens").alias("limit_tokens"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """The histogram of the documents' encoded lengths.

    Null and empty texts have length 0; repeated rows, repeated and null ids count each; an empty table gives no rows;
    other columns aren't read. Lengths are of whole texts, however long.
    """
    from .common import documents

    return length_histogram(token_lengths(documents(spark, sf_dir)))
