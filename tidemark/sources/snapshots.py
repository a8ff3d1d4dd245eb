"""Immutable snapshots, manifests and append-only logs as Parquet and JSON tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BAR_COLUMNS = ["open", "high", "low", "close", "volume"]


def _line(columns: list[str]) -> Column:
    return F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), *(F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.6f", F.col(c))) for c in columns))


def series_hashes(bars: DataFrame, columns: list[str] = BAR_COLUMNS) -> DataFrame:
    """(symbol, n_rows, sha256 of the hashes of the symbol's days in date order).

    A day's hash is that of its lines in text order, so repeated rows count; a symbol's row holds one hash for each day.
    """
    hashed = lambda c, end: F.sha2(F.array_join(c, end).cast("binary"), 256)
    days = bars.select("symbol", "date", _line(columns).alias("line")).groupBy("symbol", "date").agg(F.count("*").alias("n"), hashed(F.sort_array(F.collect_list("line")), "\n").alias("h"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("date", "h"))), lambda x: x["h"])
    return days.groupBy("symbol").agg(F.sum("n").alias("n_rows"), hashed(in_order, "").alias("sha256"))


def master_hash(hashes: DataFrame) -> DataFrame:
    """One row: the hash of all series' hashes in order of their symbols, and the snapshot's id."""
    one = hashes.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("symbol", "sha256"))), lambda x: x["sha256"]), "").cast("binary"), 256).alias("master_sha256"), F.sum("n_rows").alias("n_rows"))
    return one.select(F.concat(F.lit("snap_"), F.substring("master_sha256", 1, 12)).alias("snapshot_id"), "master_sha256", "n_rows")


def create_snapshot(bars: DataFrame, path: str) -> str:
    """Write bars under their content's id, by symbol, and add a manifest row. Returns the id; the same content has the same id."""
    head = master_hash(series_hashes(bars)).withColumn("created_at", F.current_timestamp())
    row = head.first()
    bars.withColumn("snapshot_id", F.lit(row.snapshot_id)).write.mode("overwrite").partitionBy("snapshot_id", "symbol").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/bars")
    bars.sparkSession.createDataFrame([row], head.schema).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return row.snapshot_id


def load_snapshot(spark: SparkSession, path: str, snapshot_id: str) -> DataFrame:
    return spark.read.parquet(f"{path}/bars").filter(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")


def latest_snapshot(spark: SparkSession, path: str) -> str | None:
    return spark.read.parquet(f"{path}/manifest").agg(F.max_by("snapshot_id", "created_at")).first()[0]


def verify_snapshot(spark: SparkSession, path: str, snapshot_id: str) -> bool:
    """Whether the stored bars still have the manifest's hash; false if anything is missing or unreadable."""
    try:
        known = spark.read.parquet(f"{path}/manifest").filter(F.col("snapshot_id") == snapshot_id).agg(F.max("master_sha256")).first()[0]
        found = master_hash(series_hashes(load_snapshot(spark, path, snapshot_id))).first()
    except (AnalysisException, Exception):  # noqa: BLE001  a file that can't be read isn't intact
        return False
    return known is not None and found.master_sha256 == known


def latest_per_key(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key of an append-only table (experiments, model cards)."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def log_rows(spark: SparkSession, records: list[tuple], path: str) -> None:
    """Append interaction records (ts, kind, query, response, provider, model, bundle as JSON, trusted) as JSON lines."""
    df = spark.createDataFrame(records, "ts timestamp, kind string, query string, response string, provider string, model string, bundle string, trusted boolean")
    df.withColumn("bundle_hash", F.substring(F.sha2("bundle", 256), 1, 16)).withColumn("response_hash", F.substring(F.sha2("response", 256), 1, 16)).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def recent(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.col("ts").desc()).limit(n)


def quotes_from_json(payloads: DataFrame, column: str = "payload", zone: str = "Asia/Kolkata") -> DataFrame:
    """(symbol, date, open .. volume) from chart documents {symbol, timestamp: [...], quote: {open: [...], ...}}.

    Epoch seconds become dates in the exchange's zone; of several quotes of a day the first counts. NaN becomes null.
    """
    numbers = "array<double>"
    schema = f"symbol string, timestamp array<bigint>, quote struct<open:{numbers},high:{numbers},low:{numbers},close:{numbers},volume:{numbers}>"
    doc = payloads.select(F.from_json(column, schema).alias("d")).select("d.symbol", F.arrays_zip("d.timestamp", "d.quote.open", "d.quote.high", "d.quote.low", "d.quote.close", "d.quote.volume").alias("z"))
    rows = doc.select("symbol", F.posexplode("z").alias("n", "q")).select("symbol", "n", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("q.timestamp"), zone)).alias("date"), *(F.nanvl(F.col(f"q.{c}"), F.lit(None)).alias(c) for c in BAR_COLUMNS))
    first = Window.partitionBy("symbol", "date").orderBy("n")
    return rows.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "n")
