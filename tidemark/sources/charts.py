"""Chart documents as a Spark data source: spark.read.format("tidemark_charts").load(folder).

A folder holds one JSON document {symbol, timestamp: [epoch seconds], quote: {open: [...], ...}} a line under
symbol=.../year=.... A partition of the source is one file, so symbols and years are read side by side, and filters on
date and symbol choose files before any is opened. What can't be read is a row with a status, never an error.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .snapshots import BAR_COLUMNS

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double, status string, reason string"


def write_charts(bars: DataFrame, path: str) -> None:
    """bars as chart documents, a line for each symbol and year. A row of that aggregation holds one year of days."""
    seconds = F.unix_date("date").cast("long") * 86_400
    days = F.sort_array(F.collect_list(F.struct(seconds.alias("t"), *(F.col(c).cast("double").alias(c) for c in BAR_COLUMNS))))
    whole = bars.groupBy("symbol", F.year("date").alias("year")).agg(days.alias("d"))
    quote = F.struct(*(F.col(f"d.{c}").alias(c) for c in BAR_COLUMNS))
    document = F.to_json(F.struct("symbol", F.col("d.t").alias("timestamp"), quote.alias("quote")), {"ignoreNullFields": "false"})
    whole.select("symbol", "year", document.alias("value")).write.mode("overwrite").partitionBy("symbol", "year").text(path)


@dataclass
class Chart(InputPartition):
    """One file and what its path says of it."""

    path: str
    symbol: str
    year: int | None

    def __init__(self, path: str, symbol: str, year: int | None):
        super().__init__(path)
        self.path, self.symbol, self.year = path, symbol, year


class ChartReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.symbol, self.first, self.last = path, None, None, None

    def partitions(self) -> list[Chart]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        found = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            place = re.search(r"symbol=([^/]*)/year=(\d+)/[^/_.][^/]*$", info.path)
            if not info.is_file or not place:
                continue
            symbol, year = unquote(place[1]), int(place[2])
            if (self.symbol or symbol) == symbol and (self.first or year) <= year <= (self.last or year):
                found.append(Chart(info.path, symbol, year))
        return found or [Chart("", "", None)]

    def read(self, partition: Chart) -> Iterator[tuple]:
        if not partition.path:
            return
        from pyarrow import fs

        failed = lambda why: (partition.symbol, None, *(None for _ in BAR_COLUMNS), "FAILED", why)
        try:
            with fs.FileSystem.from_uri(self.path)[0].open_input_stream(partition.path) as f:
                lines = f.read().decode().splitlines()
        except (OSError, UnicodeDecodeError) as error:
            yield failed(f"unreadable: {type(error).__name__}")
            return
        for line in lines:
            try:
                document = json.loads(line)
                quote = document["quote"]
                rows = list(zip(document["timestamp"], *(quote[c] for c in BAR_COLUMNS), strict=True))
                out = [(document["symbol"], dt.date(1970, 1, 1) + dt.timedelta(seconds=int(t)), *(None if v is None or v != v else float(v) for v in values), "OK", "") for t, *values in rows]
            except (ValueError, KeyError, TypeError, OverflowError) as error:
                yield failed(f"malformed: {type(error).__name__}")
                continue
            yield from out


class FilteredReader(ChartReader):
    """Chooses files by filters: for sessions in which Spark hands them to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Years and symbols that can't fit are left out; Spark still applies every filter to the rows."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("date",) and isinstance(value, dt.date):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.first = max(self.first or value.year, value.year)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.last = min(self.last or value.year, value.year)
            if name == ("symbol",) and isinstance(f, EqualTo):
                self.symbol = value
            yield f


class ChartSource(DataSource):
    """spark.dataSource.register(ChartSource), or `charts`. Filters choose files with the option filtered=true, in a session that
    has spark.sql.python.filterPushdown.enabled."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_charts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChartReader:
        return (FilteredReader if self.options.get("filtered") == "true" else ChartReader)(self.options["path"])


def charts(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder as rows: bars with status OK, and a row with status FAILED and the reason for what can't be read."""
    spark.dataSource.register(ChartSource)
    return spark.read.format(ChartSource.name()).option("filtered", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load(path)
