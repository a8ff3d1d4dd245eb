"""Market series from the transaction tables: bars, panels, catalogs, episodes.

A symbol is the region of a line item's supplier, its price the extended price, its date the ship date. Bars come from one
hash aggregation with partial sums before the shuffle; everything after them has one row for each symbol and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Roles that the regions play in the panel (fixed values).
ROLES = {"MIDDLE EAST": "bench", "AFRICA": "bank", "AMERICA": "it", "ASIA": "midcap", "EUROPE": "broad"}
#: Stress episodes inside the tables' dates: id, name, start, end (fixed values).
EPISODES = [
    ("e1995", "1995 Opening Squeeze", "1995-05-22", "1995-08-30"),
    ("e1997", "1997 Liquidity Shock", "1997-09-01", "1997-12-31"),
    ("e1999", "1999 Spring Crash", "1999-02-15", "1999-05-15"),
    ("e2001", "2001 Election Shock", "2001-05-20", "2001-06-15"),
]
#: Series that can be asked for: id, source, units, available, reason if not (fixed values).
CATALOG = [
    ("AFRICA", "bars", "price", True, ""), ("AMERICA", "bars", "price", True, ""), ("ASIA", "bars", "price", True, ""),
    ("EUROPE", "bars", "price", True, ""), ("MIDDLE EAST", "bars", "price", True, ""), ("VIX_INDEX", "discounts", "percent", True, ""),
    ("FX_RATE", "taxes", "ratio", True, ""), ("GILT_10Y", "central bank", "percent", False, "no machine-readable endpoint"),
    ("FLOWS_NET", "regulator", "currency", False, "page needs a session"), ("FUND_AUM", "association", "currency", False, "published monthly as spreadsheets"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(high: str, middle: str | Column, low: str | Column) -> Column:
    """Three whole numbers as one that orders as they do: up to 18 digits, 4 and 15. Of fixed width, so that aggregates over it
    stay in a hash map; with a struct the fact table would be sorted."""
    number = lambda c, digits: (F.col(c) if isinstance(c, str) else c).cast(f"decimal({digits},0)")
    return ((number(high, 18) * 10000 + number(middle, 4)).cast("decimal(23,0)") * F.lit(10**15).cast("decimal(16,0)") + number(low, 15)).cast("decimal(38,0)")


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily_bars with what the indices are made of: line items, and whole hundredths of discounts and taxes."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax", F.to_date("l_shipdate").alias("date"))
    where = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    where = where.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    where = where.join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("symbol"))
    first = packed("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * 100).cast("long"))
    return line.join(where, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("symbol", "date").agg(
        F.min_by("l_extendedprice", first).alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"),
        F.max_by("l_extendedprice", first).alias("close"), F.sum("l_quantity").alias("volume"), F.count("*").alias("n"), _cents("l_discount").alias("discounts"), _cents("l_tax").alias("taxes"),
    )


def _cents(c: str) -> Column:
    return F.sum(F.round(100 * F.col(c)).cast("long"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, open, high, low, close, volume)."""
    return _bars(spark, sf_dir).select("symbol", "date", "open", "high", "low", "close", "volume")


def daily_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, vix, fx): a volatility index and an exchange rate, from whole hundredths, so that no order of summing matters."""
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg((_cents("l_discount") / F.count("*")).alias("vix"), (1 + _cents("l_tax") / F.count("*") / 100).alias("fx"))


def PANEL():
    return Window.partitionBy("panel").orderBy("date")


def panel(spark: SparkSession, sf_dir: str, name: str = "main") -> DataFrame:
    """(panel, date, bench, bench_high, bench_low, bank, it, midcap, broad, vix, fx) on the benchmark's dates, others carried forward.

    The indices are sums of the regions' sums, so the line items are read once.
    """
    n = F.sum("n")
    wide = _bars(spark, sf_dir).groupBy("date").agg(
        *(F.max(F.when(F.col("symbol") == s, F.col("close"))).alias(role) for s, role in ROLES.items()),
        F.max(F.when(F.col("symbol") == "MIDDLE EAST", F.col("high"))).alias("bench_high"), F.max(F.when(F.col("symbol") == "MIDDLE EAST", F.col("low"))).alias("bench_low"),
        (F.sum("discounts") / n).alias("vix"), (1 + F.sum("taxes") / n / 100).alias("fx"),
    ).filter("bench is not null").withColumn("panel", F.lit(name))
    carried = [F.last(c, ignorenulls=True).over(PANEL()).alias(c) for c in ("bank", "it", "midcap", "broad", "vix", "fx")]
    return wide.select("panel", "date", "bench", "bench_high", "bench_low", *carried)


def episodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EPISODES, "episode_id string, episode string, start_date string, end_date string").withColumns({c: F.to_date(c) for c in ("start_date", "end_date")})


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "series_id string, source string, units string, available boolean, reason string")


def in_time(at: Column, event: Column) -> Column:
    """Events in order of time, then number, as one number: microseconds of up to 17 digits, numbers of up to 18."""
    return (F.unix_micros(at).cast("decimal(17,0)") * F.lit(10**18).cast("decimal(19,0)") + event.cast("decimal(18,0)")).cast("decimal(38,0)")


def hourly_bars(events: DataFrame) -> DataFrame:
    """(symbol, hour, open, high, low, close, volume) of event values by type."""
    order = in_time(F.col("ts").cast("timestamp"), F.col("event_id"))
    return events.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume")
    )
