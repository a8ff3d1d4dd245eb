"""Data-quality audit of bars: one report row for each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

#: (name contains, lowest, highest, largest log jump): plausible values of special series (fixed values).
BOUNDS = [(("VIX", "VOL"), 5.0, 100.0, 0.85), (("INR", "FX"), 35.0, 100.0, 0.08)]
EQUITY_JUMP = 0.25
GAP_DAYS = 5
STALE_RUN = 3


def _by_kind(symbol: Column, values: list, other) -> Column:
    out = None
    for (names, *_), v in zip(BOUNDS, values, strict=True):
        hit = F.upper(symbol).rlike("|".join(names))
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out.otherwise(other)


def quality_report(bars: DataFrame, value: str = "close", arrival: str | None = None) -> DataFrame:
    """Counts of duplicates, gaps, missing, impossible and stale values, and a status, by symbol.

    arrival orders the rows as they came (by default the date, which makes order always right but for repeats).
    FAILED: an impossible value, or dates not strictly rising; WARNING: over 5 % missing or over 20 gaps.
    """
    dated = Window.partitionBy("symbol").orderBy("date", *([arrival] if arrival else []))
    so_far = dated.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    rows = bars.withColumn("_rising", F.col("date") > F.lag("date").over(Window.partitionBy("symbol").orderBy(arrival or "date"))).withColumn("_gap", F.datediff("date", F.lag("date").over(dated)) > GAP_DAYS)
    rows = rows.withColumn("_before", F.last(value, ignorenulls=True).over(dated.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_same", F.coalesce(v == F.lag(value).over(dated), F.lit(False)).cast("int")).withColumn("_island", F.sum(1 - F.col("_same")).over(so_far))
    rows = rows.withColumn("_streak", F.sum("_same").over(Window.partitionBy("symbol", "_island").orderBy("date", *([arrival] if arrival else [])).rowsBetween(Window.unboundedPreceding, 0)))
    return _report(rows, value, F.count("*") - F.count_distinct("date"))


def quality_report_spread(bars: DataFrame, value: str = "close", arrival: str | None = None, n: int | None = None) -> DataFrame:
    """quality_report where one symbol may hold most rows: two passes over ranges (by date, by arrival), no task for a symbol."""
    order = ["date", *([arrival] if arrival else [])]
    rows = bars.withColumn("_known", F.col(value).isNotNull())
    s = rows.schema
    states = [ranges.lagged(s, {"_date_before": "date"}), ranges.last_where(s, "_known", {"_before": value}, strictly=True), ranges.streak(s, value, "_streak")]
    rows = ranges.scan(rows, ["symbol"], order, *states, name="dated", ranges=n)
    if arrival:
        rows = ranges.scan(rows, ["symbol"], [arrival], ranges.lagged(s, {"_came_before": "date"}), name="arrived", ranges=n)
    rows = rows.withColumn("_rising", F.col("date") > F.col("_came_before" if arrival else "_date_before")).withColumn("_gap", F.datediff("date", "_date_before") > GAP_DAYS)
    # Rows of one date lie together, so a row repeats a date if its predecessor has it.
    return _report(rows, value, F.count_if(F.col("date").isNull() | F.coalesce(F.col("date") == F.col("_date_before"), F.lit(False))))


def _report(rows: DataFrame, value: str, duplicates: Column) -> DataFrame:
    v = F.col(value)
    low, high = _by_kind(F.col("symbol"), [F.lit(b[1]) for b in BOUNDS], F.lit(None)), _by_kind(F.col("symbol"), [F.lit(b[2]) for b in BOUNDS], F.lit(None))
    jump = _by_kind(F.col("symbol"), [F.lit(b[3]) for b in BOUNDS], F.lit(EQUITY_JUMP))
    bad = F.coalesce(v < 0, F.lit(False)).cast("int") + F.coalesce((v < low) | (v > high), F.lit(False)).cast("int") + F.coalesce((v > 0) & (F.col("_before") > 0) & (F.abs(F.log(v / F.col("_before"))) > jump), F.lit(False)).cast("int")
    out = rows.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), duplicates.alias("n_duplicates"), F.coalesce(F.bool_and("_rising"), F.lit(True)).alias("is_monotonic"),
        F.count_if(v.isNull()).alias("n_missing"), F.count_if("_gap").alias("n_gaps"), F.sum(bad).alias("n_impossible"), F.count_if(F.col("_streak") >= STALE_RUN).alias("n_stale"),
    )
    pct = F.round(100.0 * F.col("n_missing") / F.col("n_rows"), 4)
    status = F.when((F.col("n_impossible") > 0) | ~F.col("is_monotonic"), "FAILED").when((pct > 5) | (F.col("n_gaps") > 20), "WARNING").otherwise("PASSED")
    return out.select("*", pct.alias("pct_missing"), status.alias("status"))


def clean_bars(bars: DataFrame, arrival: str) -> DataFrame:
    """The first arrival of each symbol and date. Values stay as they are."""
    w = Window.partitionBy("symbol", "date").orderBy(arrival)
    return bars.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def valid_bar() -> Column:
    """Row constraints of a bar: no negative close, high not below low."""
    return F.coalesce(F.col("close") >= 0, F.lit(True)) & F.coalesce(F.col("high") >= F.col("low"), F.lit(True))


def availability_report(catalog: DataFrame, report: DataFrame) -> DataFrame:
    """Every catalogued series with its report; FAILED if it is available but has no rows, UNAVAILABLE with the reason otherwise."""
    joined = catalog.join(report, F.col("series_id") == F.col("symbol"), "left")
    status = F.when(~F.col("available"), "UNAVAILABLE").otherwise(F.coalesce("status", F.lit("FAILED")))
    return joined.select("series_id", "source", "units", "available", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), status.alias("status"), F.when(~F.col("available"), F.col("reason")).otherwise("").alias("reason"))
