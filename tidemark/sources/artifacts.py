"""Sinks and scans of prediction, table and series artifacts; the source contract; append-only record tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import ranges
from .market import catalog
from .snapshots import latest_per_key


@dataclass(frozen=True)
class SeriesMeta:
    """What a source says of a series; reason is empty if it is available."""

    series_id: str
    is_available: bool
    reason: str
    n_rows: int


def load_series(spark: SparkSession, bars: DataFrame, symbol: str) -> tuple[DataFrame | None, SeriesMeta]:
    """(rows, meta) of a catalogued series. What can't be had is (None, meta with the reason), never an error."""
    known = catalog(spark).filter(F.col("series_id") == symbol).first()
    if known is None:
        return None, SeriesMeta(symbol, False, "not in the catalog", 0)
    if not known.available:
        return None, SeriesMeta(symbol, False, known.reason, 0)
    rows = bars.filter(F.col("symbol") == symbol)
    n = rows.count()
    return (rows, SeriesMeta(symbol, True, "", n)) if n else (None, SeriesMeta(symbol, False, "no rows", 0))


def write_predictions(df: DataFrame, path: str) -> None:
    """A prediction matrix as Parquet; a run replaces the one before."""
    df.write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, kind: str = "csv", schema: str | None = None) -> DataFrame | None:
    """A CSV (with a header), JSON or Parquet artifact; None if it is missing or can't be read as one."""
    try:
        reader = spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)
        return {"csv": reader.option("header", True).csv, "json": reader.json, "parquet": spark.read.parquet}[kind](path)
    except AnalysisException:
        return None


def artifact_status(spark: SparkSession, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """(artifact, status, n_rows) of artifacts given as name -> (path, kind): VERIFIED, EMPTY or UNAVAILABLE."""
    out = []
    for name, (path, kind) in paths.items():
        df = read_table(spark, path, kind)
        n = df.count() if df is not None else 0
        out.append((name, "UNAVAILABLE" if df is None else "VERIFIED" if n else "EMPTY", n))
    return spark.createDataFrame(out, "artifact string, status string, n_rows long")


def write_by_symbol(bars: DataFrame, path: str) -> None:
    """One folder for each symbol, named after it, all of them in one pass."""
    bars.write.mode("overwrite").partitionBy("symbol").parquet(path)


def scan_symbols(spark: SparkSession, path: str) -> DataFrame:
    """All tables of a folder as one, with the symbol that their names give; a filter on it reads that symbol's alone."""
    return spark.read.parquet(path)


def append_records(df: DataFrame, path: str) -> None:
    """Add records (runs, model cards) to an append-only table."""
    df.write.mode("append").parquet(path)


def current_records(spark: SparkSession, path: str, keys: list[str], at: str) -> DataFrame:
    """The newest record of each key of an append-only table."""
    return latest_per_key(spark.read.parquet(path), keys, at)


def frame_hash(df: DataFrame, at: str) -> DataFrame:
    """One row: the number of rows and a hash of a frame's content, whatever the order of its rows.

    Rows are hashed, then the hashes of each value of the column `at`, then those: no row holds more than one value's hashes.
    """
    line = F.concat_ws(",", *(F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.6f", F.col(c)) if t == "double" else F.col(c).cast("string")) for c, t in df.dtypes))
    hashed = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "").cast("binary"), 256)
    parts = df.select(at, F.sha2(line.cast("binary"), 256).alias("h")).groupBy(at).agg(F.count("*").alias("n"), hashed("h").alias("h"))
    return parts.agg(F.sum("n").alias("n_rows"), hashed("h").alias("sha256"))


def create_feature_snapshot(matrix: DataFrame, path: str, name: str, at: str = "date") -> None:
    """Write a feature matrix as Parquet and beside it what identifies it, as JSON: name, rows, columns and the content's hash."""
    matrix.write.mode("overwrite").parquet(f"{path}/{name}")
    stored = matrix.sparkSession.read.parquet(f"{path}/{name}")
    head = frame_hash(stored, at).select(F.lit(name).alias("name"), "n_rows", F.lit(len(matrix.columns)).alias("n_columns"), "sha256")
    head.coalesce(1).write.mode("overwrite").json(f"{path}/{name}_metadata")


def late_events(events: DataFrame, late: str = "1 hour", arrival: str = "event_id", at: str = "ts", key: str = "event_type") -> DataFrame:
    """(key, n, n_quarantined): events that a watermark of `late` behind the latest event before them would leave out, by key.

    The latest time so far is carried over ranges of (key, arrival): a key that holds most events is many tasks' work.
    """
    rows = events.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), arrival)
    rows = ranges.scan(rows, [key], [arrival], ranges.running_max("_at", "_seen"), name="late")
    limit = F.unix_micros(F.timestamp_micros("_seen") - F.expr(f"INTERVAL {late}"))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("_at") < limit).alias("n_quarantined"))
