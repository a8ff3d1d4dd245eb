"""Work inside hot keys: dealt over ranges it equals the windows and scans over whole keys, and no task gets most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pit, quality, ranges, technical
from tidemark.sources import artifacts, durable

N = 200


def day(i):
    return dt.date(2000, 1, 1) + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def series(spark):
    """One symbol with nearly all rows, some small ones and a null one; values repeat, some are missing, some days too."""
    rng = random.Random(4)
    rows, at = [], 0
    for i in range(3000):
        at += rng.choice([1, 1, 1, 2, 7])
        rows.append(("HOT", day(at), None if rng.random() < 0.1 else float(rng.choice([100, 100, 101, 140])), i))
    rows += [(s, day(i), float(i % 3 + 1), 5000 + i) for s in ("A", "B", None) for i in range(12)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, date date, close double, seq long")
    return spark.read.schema(df.schema).parquet(_kept(df))


def _kept(df):
    path = durable.place(df.sparkSession, "series")
    df.write.parquet(path)
    return path


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    key = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    a, b = key(a.select(cols).collect()), key(b.select(cols).collect())
    assert a == b and a


def test_asof_in_200_ranges(spark, series):
    probes = series.select("symbol", F.date_add("date", 3).alias("as_of")).distinct()
    facts = series.filter("seq % 5 = 0").withColumn("seq", F.col("seq").cast("string"))
    same(pit.asof_backward_spread(probes, facts, "symbol", "as_of", "date", ["close", "seq"], N), pit.asof_backward(probes, facts, "symbol", "as_of", "date", ["close", "seq"]))
    same(pit.asof_nearest_spread(probes, facts, "symbol", "as_of", "date", ["close", "seq"], N), pit.asof_nearest(probes, facts, "symbol", "as_of", "date", ["close", "seq"]))


def test_carry_in_200_ranges(series):
    gaps = series.withColumn("other", F.when(F.col("seq") % 97 == 0, F.col("seq")))
    same(pit.carry_forward_spread(gaps, "symbol", "date", ["close", "other"], N), pit.carry_forward(gaps, "symbol", "date", ["close", "other"]))


@pytest.mark.parametrize("arrival", [None, "seq"])
def test_quality_in_200_ranges(series, arrival):
    rows = series.unionByName(series.filter("seq % 50 = 0").withColumn("seq", F.col("seq") + 100_000)) if arrival else series
    same(quality.quality_report_spread(rows, arrival=arrival, n=N), quality.quality_report(rows, arrival=arrival))


def test_streaks_over_many_ranges(spark):
    """One value through many ranges: every range but the first is alike throughout."""
    df = spark.range(1000).select(F.lit("k").alias("k"), "id", F.when(F.col("id").between(100, 900), 7).otherwise(F.col("id")).cast("int").alias("v"))
    got = ranges.scan(df, ["k"], ["id"], ranges.streak(df.schema, "v"), ranges=50)
    assert {r.id: r.streak for r in got.collect()} == {i: i - 100 if 100 <= i <= 900 else 0 for i in range(1000)}


def test_recursions_in_200_ranges(series):
    panel = series.filter("symbol is not null").select(F.col("symbol").alias("panel"), "date", F.col("close").alias("bench"))
    same(technical.recursive_features_spread(panel, n=N), technical.recursive_features(panel))


def test_late_events_of_one_key(spark):
    rng = random.Random(2)
    rows = [("k", i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i - rng.choice([0, 0, 30, 200]))) for i in range(500)]
    seen, late = None, 0
    for _, _, at in rows:
        late += seen is not None and at < seen - dt.timedelta(hours=1)
        seen = max(seen or at, at)
    got = artifacts.late_events(spark.createDataFrame(rows, "event_type string, event_id long, ts timestamp")).collect()
    assert [tuple(r) for r in got] == [("k", 500, late)] and late


def test_no_task_gets_most_rows(spark, monkeypatch):
    """The table a scan writes says which range each row was in."""
    kept = []
    monkeypatch.setattr(ranges, "written", lambda df, name: kept.append(durable.written(df, name)) or kept[-1])
    df = spark.range(40_000).select(F.lit("hot").alias("k"), "id")
    got = ranges.scan(df, ["k"], ["id"], ranges.running_max("id", "top"), ranges=40)
    assert got.filter("top <> id").count() == 0
    sizes = sorted(r["count"] for r in kept[0].groupBy("_range").count().collect())
    assert len(sizes) >= 38 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
