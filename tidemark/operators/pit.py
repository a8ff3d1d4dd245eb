"""Point-in-time operators: availability, as-of lookups, carrying forward, chronological splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

def available(df: DataFrame, lag_days: int, as_of: Column) -> DataFrame:
    """Rows whose date plus the publication lag is not after as_of."""
    return df.filter(F.date_add("date", lag_days) <= as_of)


def records_available(records: DataFrame, as_of: Column) -> DataFrame:
    return records.filter(F.col("effective_availability_date") <= as_of)


def assert_no_leak(features: DataFrame, as_of: Column) -> DataFrame:
    """features, or an error while running if a row lies after as_of."""
    ok = F.when(F.col("date") > as_of, F.raise_error(F.lit("a feature row lies after the as-of date"))).otherwise(F.lit(True))
    return features.filter(ok)


def leak_report(features: DataFrame, as_of: Column) -> DataFrame:
    """(n, n_leaking, first_leak, last_leak): what assert_no_leak() would stop at, counted instead. Rows without a date don't leak."""
    leaks = F.col("date") > as_of
    return features.agg(F.count("*").alias("n"), F.count_if(leaks).alias("n_leaking"), F.min(F.when(leaks, F.col("date"))).alias("first_leak"), F.max(F.when(leaks, F.col("date"))).alias("last_leak"))


def _united(probes: DataFrame, facts: DataFrame, key: str, probe_at: str, fact_at: str, values: list[str]) -> DataFrame:
    rows = facts.select(key, F.col(fact_at).alias("_at"), F.lit(0).alias("_probe"), F.struct(F.col(fact_at).alias("_fact_at"), *values).alias("_fact"), F.lit(None).cast(probes.schema[probe_at].dataType).alias(probe_at))
    asks = probes.select(key, F.col(probe_at).alias("_at"), F.lit(1).alias("_probe"), F.lit(None).cast(rows.schema["_fact"].dataType).alias("_fact"), probe_at)
    return rows.unionByName(asks)


def asof_backward(probes: DataFrame, facts: DataFrame, key: str, probe_at: str, fact_at: str, values: list[str]) -> DataFrame:
    """Each probe with the values of the last fact of its key at or before it; null if there is none.

    One shuffle by key of both sides together and one sort, instead of a join of all pairs.
    """
    w = Window.partitionBy(key).orderBy("_at", "_probe")
    found = _united(probes, facts, key, probe_at, fact_at, values).withColumn("_fact", F.last("_fact", ignorenulls=True).over(w)).filter("_probe = 1")
    return found.select(key, probe_at, F.col("_fact._fact_at").alias(fact_at), *(F.col(f"_fact.{v}").alias(v) for v in values))


def asof_nearest(probes: DataFrame, facts: DataFrame, key: str, probe_at: str, fact_at: str, values: list[str]) -> DataFrame:
    """Each probe with the fact nearest in time (the earlier one of two equally near) and whether it lies in the future.

    One shuffle, as for asof_backward, and two sorts: one for the facts before a probe, one for those after it.
    """
    found = _united(probes, facts, key, probe_at, fact_at, values)
    back = F.last("_fact", ignorenulls=True).over(Window.partitionBy(key).orderBy("_at", "_probe"))
    ahead = F.last("_fact", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.col("_at").desc(), "_probe"))
    found = found.withColumn("_b", back).withColumn("_a", ahead).filter("_probe = 1")
    near = F.datediff(F.col(probe_at), F.col("_b._fact_at")) <= F.datediff(F.col("_a._fact_at"), F.col(probe_at))
    pick = F.when(F.col("_b").isNotNull() & (F.col("_a").isNull() | near), F.col("_b")).otherwise(F.col("_a"))
    found = found.select(key, probe_at, pick.alias("_x"))
    return found.select(key, probe_at, F.col("_x._fact_at").alias(fact_at), *(F.col(f"_x.{v}").alias(v) for v in values), (F.col("_x._fact_at") > F.col(probe_at)).alias("is_future"))


def carry_forward(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(at)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def split_by_fraction(df: DataFrame, key: str, at: str, train: float = 0.6, calibration: float = 0.2) -> DataFrame:
    """split by position in time: the first int(n * train) rows, up to int(n * (train + calibration)), the rest."""
    n, k = F.count("*").over(Window.partitionBy(key)), F.row_number().over(Window.partitionBy(key).orderBy(at))
    first, second = F.floor(n * F.lit(train) + 1e-9), F.floor(n * F.lit(train + calibration) + 1e-9)
    return df.withColumn("split", F.when(k <= first, "train").when(k <= second, "calibration").otherwise("test"))


def split_by_date(df: DataFrame, at: str, calibration_from: str, test_from: str) -> DataFrame:
    return df.withColumn("split", F.when(F.col(at) < F.lit(calibration_from).cast("date"), "train").when(F.col(at) < F.lit(test_from).cast("date"), "calibration").otherwise("test"))


def in_episodes(df: DataFrame, episodes: DataFrame, at: str = "date") -> DataFrame:
    """Interval join with a table of a few episodes, which the optimizer broadcasts by its size; both ends count."""
    return df.join(episodes, (F.col(at) >= F.col("start_date")) & (F.col(at) <= F.col("end_date")))


def _spread(probes: DataFrame, facts: DataFrame, key: str, probe_at: str, fact_at: str, values: list[str]) -> DataFrame:
    return _united(probes, facts, key, probe_at, fact_at, values).withColumn("_is_fact", F.col("_probe") == 0)


def asof_backward_spread(probes: DataFrame, facts: DataFrame, key: str, probe_at: str, fact_at: str, values: list[str], n: int | None = None) -> DataFrame:
    """asof_backward for keys that may hold most rows: dealt by key and time, facts carried from range to range.

    Of facts at one time any may count as the last; give the time a tie-breaker (a struct) where that matters.
    """
    rows = _spread(probes, facts, key, probe_at, fact_at, values)
    found = ranges.scan(rows, [key], ["_at", "_probe"], ranges.last_where(rows.schema, "_is_fact", {"_x": "_fact"}), name="asof", ranges=n).filter("_probe = 1")
    return found.select(key, probe_at, F.col("_x._fact_at").alias(fact_at), *(F.col(f"_x.{v}").alias(v) for v in values))


def asof_nearest_spread(probes: DataFrame, facts: DataFrame, key: str, probe_at: str, fact_at: str, values: list[str], n: int | None = None) -> DataFrame:
    """asof_nearest for keys that may hold most rows: one pass over ranges forwards, one backwards."""
    rows = _spread(probes, facts, key, probe_at, fact_at, values)
    rows = ranges.scan(rows, [key], ["_at", "_probe"], ranges.last_where(rows.schema, "_is_fact", {"_b": "_fact"}), name="asof", ranges=n)
    found = ranges.scan(rows, [key], [F.col("_at").desc(), "_probe"], ranges.last_where(rows.schema, "_is_fact", {"_a": "_fact"}), name="asof", ranges=n).filter("_probe = 1")
    near = F.datediff(F.col(probe_at), F.col("_b._fact_at")) <= F.datediff(F.col("_a._fact_at"), F.col(probe_at))
    found = found.withColumn("_x", F.when(F.col("_b").isNotNull() & (F.col("_a").isNull() | near), F.col("_b")).otherwise(F.col("_a")))
    return found.select(key, probe_at, F.col("_x._fact_at").alias(fact_at), *(F.col(f"_x.{v}").alias(v) for v in values), (F.col("_x._fact_at") > F.col(probe_at)).alias("is_future"))


def carry_forward_spread(df: DataFrame, key: str, at: str, columns: list[str], n: int | None = None) -> DataFrame:
    """carry_forward for keys that may hold most rows."""
    rows = df.withColumns({f"_is_{c}": F.col(c).isNotNull() for c in columns})
    states = [ranges.last_where(rows.schema, f"_is_{c}", {f"_last_{c}": c}) for c in columns]
    found = ranges.scan(rows, [key], [at], *states, name="carried", ranges=n)
    return found.select(*(F.col(f"_last_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))
