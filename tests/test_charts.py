"""Chart documents through the data source."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.sources import charts, durable, market


def test_charts_hold_the_bars(spark, sf):
    bars = market.daily_bars(spark, sf)
    path = durable.place(spark, "charts")
    charts.write_charts(bars, path)
    back = charts.charts(spark, path)
    key = lambda df: sorted(map(tuple, df.select("symbol", "date", "open", "high", "low", "close", F.col("volume").cast("double")).collect()))
    assert key(back) == key(bars) and back.filter("status <> 'OK' or reason <> ''").count() == 0
    assert back.rdd.getNumPartitions() == bars.select("symbol", F.year("date")).distinct().count()


def test_filters_choose_files(spark, sf):
    path = durable.place(spark, "charts")
    charts.write_charts(market.daily_bars(spark, sf), path)
    reader = charts.FilteredReader(path)
    every = len(reader.partitions())
    kept = list(reader.pushFilters([charts.GreaterThanOrEqual(("date",), dt.date(1997, 5, 1)), charts.LessThan(("date",), dt.date(1999, 1, 1)), charts.EqualTo(("symbol",), "ASIA")]))
    assert len(kept) == 3 and {(p.symbol, p.year) for p in reader.partitions()} == {("ASIA", 1997), ("ASIA", 1998), ("ASIA", 1999)} and every > 20
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = charts.charts(spark, path).filter(F.col("date") >= F.lit("2000-01-01").cast("date"))
        assert 0 < some.rdd.getNumPartitions() < every and some.agg(F.min("date")).first()[0].year == 2000
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_what_cannot_be_read_is_a_row(spark, tmp_path):
    good = '{"symbol": "A", "timestamp": [946684800, 946771200], "quote": {"open": [1, null], "high": [2, 2], "low": [1, 1], "close": [2, 2], "volume": [5, 6]}}'
    texts = {"A/year=2000": good + "\n", "B/year=2000": "not json\n", "C/year=2001": '{"symbol": "C", "timestamp": [1], "quote": {"open": []}}\n', "D/year=2001": ""}
    for place, text in texts.items():
        (tmp_path / f"symbol={place}").mkdir(parents=True)
        (tmp_path / f"symbol={place}" / "part-0.txt").write_text(text)
    rows = charts.charts(spark, f"file://{tmp_path}").orderBy("symbol", "date").collect()
    assert [(r.symbol, str(r.date), r.open, r.status) for r in rows] == [("A", "2000-01-01", 1.0, "OK"), ("A", "2000-01-02", None, "OK"), ("B", "None", None, "FAILED"), ("C", "None", None, "FAILED")]
    assert rows[2].reason == "malformed: JSONDecodeError"
    (tmp_path / "none").mkdir()
    assert charts.charts(spark, f"file://{tmp_path}/none").count() == 0
