"""A corpus pipeline: quality rules, near-duplicates, repeated strings, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents. A document is a row: ids may be null or repeated, and after the near-duplicate stage every text occurs once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize
from tidemark.llm.near_copies import near_copies, node
from tidemark.llm.packing import pack
from tidemark.llm.pii import redact
from tidemark.llm.quality_rules import keep_good
from tidemark.llm.substrings import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KINDS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _whole(docs: DataFrame) -> DataFrame:
    """The columns of documents; those that are missing, but for the id and the text, are null."""
    return docs.select(*(F.col(c) if c in docs.columns or c in ("doc_id", "text") else F.lit(None).cast(KINDS[c]).alias(c) for c in COLUMNS))


def _edited(docs: DataFrame, text) -> DataFrame:
    """docs with a new text and its length."""
    return docs.select(*(text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts are rejected; repeated rows stay for the next stage; texts are read whole, however long.
    An empty table stays empty. Other columns than those of documents end here, missing ones are null."""
    return keep_good(_whole(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (5-word shingles, Jaccard of 0.8 or more); of rows with the same id and text, one.

    Of equal texts the smallest id stays, a null id last; texts without a word are copies of each other. Texts are compared whole."""
    rows, kept = near_copies(docs)
    kept = kept.toDF("_kept", "_id")
    own = docs.select(*COLUMNS, node(F.col("text")).alias("_node"))
    out = own.join(kept.hint("shuffle_hash"), (F.col("_node") == F.col("_kept")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    twice = rows.groupBy("node", "doc_id").count().filter("count > 1").limit(1).count()
    return (out.dropDuplicates(["_node"]) if twice else out).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that occur in an earlier document; documents of which nothing is left go. A null text has nothing left; repeated rows stay, each with what is left."""
    key = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none")]
    found = remove_repeats(docs).select(*key, F.col("text_hash").alias("_node"), F.col("kept_text").alias("text"))
    if docs.groupBy(*key, node(F.col("text"))).count().filter("count > 1").limit(1).count():
        found = found.dropDuplicates(["_id", "_none", "_node"])
    own = docs.select(*(c for c in COLUMNS if c != "text"), *key, node(F.col("text")).alias("_node"))
    both = own.hint("shuffle_hash").join(found, ["_id", "_none", "_node"])
    return _edited(both, F.col("text")).filter("text rlike '[^\\\\s]'")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which personal data is replaced by its kind. Every row stays; null texts stay null, empty ones empty; a long text is read whole."""
    clean = redact(docs)
    return _edited(clean, F.col("text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens. Null and empty texts are the end id alone; long texts are cut, whole, into pieces; rows with equal or null ids are packed apart."""
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeated_strings", repeated_strings), ("personal_data", personal_data), ("packing", packing)]

#: Fingerprints, suffix arrays and token ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
