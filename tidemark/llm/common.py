"""What the text operators share: reading, settings, durable intermediate tables, packed exchanges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.durable import place

#: Schema of a packed exchange: the target partition, what the bytes hold, the bytes.
PACKED = "part int, kind int, data binary"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it back. Survives lost executors."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by materialize() that no later plan reads."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def keyed(df: DataFrame, *cols: str) -> DataFrame:
    """Only the columns an operator reads, so that other columns can't clash with its own."""
    return df.select(*cols)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def hex64(c: Column) -> Column:
    """A 64-bit value as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def exchange(df: DataFrame, n: int) -> DataFrame:
    """Deal packed rows to the partitions they name."""
    return df.repartitionById(n, F.col("part"))


def packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["part", "kind", "data"])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(sizes, most: int):
    """Ranges of consecutive items of at most `most` in sum, or of one item."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > most:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)
