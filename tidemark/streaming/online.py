"""The online models over tables and streams: state is kept by series, rows are taken in order of time.

A batch is one group for each series; a stream keeps the pickled state of a series in the state store, so a restart from the
checkpoint goes on where it stopped and replays the same numbers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import simplex as S
from ..operators.pit import asof_backward
from ..sources.market import in_time
from .kernels import Changepoints, DirichletCounts, ParticleFilter

OUT = "series string, at timestamp, p0 double, p1 double, p2 double, p3 double, p4 double, cp_zero double, cp_short double, run_length int"
NAMES = [f.split()[0] for f in OUT.split(", ")]


def _scored(filter_: ParticleFilter, changes: Changepoints, series: str, pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [(series, at, *filter_.update(x), *changes.update(x)) for at, x in zip(pdf["at"], pdf["x"], strict=True)]
    return pd.DataFrame(rows, columns=NAMES)


def score_batch(rows: DataFrame, particles: int = 1000, seed: int = 42) -> DataFrame:
    """Regime probabilities and changepoint measures of each row of (series, at, x). Null x are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _scored(ParticleFilter(particles, seed), Changepoints(), pdf["series"].iloc[0], pdf.sort_values("at"))

    return rows.filter("x is not null").select("series", F.col("at").cast("timestamp").alias("at"), "x").groupBy("series").applyInPandas(run, OUT)


def changepoints_batch(rows: DataFrame) -> DataFrame:
    """(series, at, cp_zero, cp_short, run_length): the changepoint measures alone of (series, at, x). Null x are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, changes = pdf.sort_values("at"), Changepoints()
        out = pd.DataFrame([changes.update(x) for x in pdf["x"]], columns=["cp_zero", "cp_short", "run_length"])
        return pdf[["series", "at"]].reset_index(drop=True).join(out)

    return rows.filter("x is not null").select("series", F.col("at").cast("timestamp").alias("at"), "x").groupBy("series").applyInPandas(run, "series string, at timestamp, cp_zero double, cp_short double, run_length int")


def score_stream(rows: DataFrame, particles: int = 1000, seed: int = 42) -> DataFrame:
    """The same of a stream; within a micro-batch a series' rows are taken in order of time."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        models = pickle.loads(state.get[0]) if state.exists else (ParticleFilter(particles, seed), Changepoints())
        pdf = pd.concat(list(parts)).sort_values("at")
        out = _scored(*models, key[0], pdf)
        state.update((pickle.dumps(models),))
        yield out

    source = rows.filter("x is not null").select("series", F.col("at").cast("timestamp").alias("at"), "x")
    return source.groupBy("series").applyInPandasWithState(run, OUT, "state binary", "append", GroupStateTimeout.NoTimeout)


def windowed_bars(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Bars of event values by type over tumbling windows; events later than the watermark are left out."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    order = in_time(F.col("at"), F.col("event_id"))
    out = e.groupBy(F.window("at", size), "event_type").agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume"))
    return out.select(F.col("event_type").alias("symbol"), F.col("window.start").alias("hour"), "open", "high", "low", "close", "volume")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of users' sessions."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def enriched(events: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """events, a stream or a table, with the columns of a static table of their key; events without one keep nulls."""
    return events.join(static, key, "left")


def decayed_counts(predictions: DataFrame, decay: float = 0.99, prior: float = 1.0) -> DataFrame:
    """(panel, date, p): the mean of a Dirichlet whose counts decay and gain each day's probabilities, one scan a panel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, counts = pdf.sort_values("date"), DirichletCounts(decay, prior)
        return pd.DataFrame({"panel": pdf["panel"].to_numpy(), "date": pdf["date"].to_numpy(), "p": [counts.update(np.array(list(p))) for p in pdf["p"]]})

    return predictions.select("panel", "date", "p").groupBy("panel").applyInPandas(run, "panel string, date date, p array<double>")


def online_report(rows: DataFrame, batch: DataFrame, alpha: float = 0.1, max_kl: float = 0.25, particles: int = 1000) -> DataFrame:
    """What a scoring request returns, for every row of (series, at, x): the online filter's probabilities, dominant regime, entropy
    and prediction set, the changepoint measures, and how far they are from the batch model (panel, date, p) at or before that day."""
    scored = score_batch(rows, particles).select("series", F.to_date("at").alias("date"), F.array(*(f"p{k}" for k in range(5))).alias("p"), "cp_zero", "cp_short", "run_length")
    facts = batch.select(F.col("panel").alias("series"), F.col("date").alias("known"), F.col("p").alias("q"))
    probes = scored.select("series", F.col("date").alias("as_of")).distinct()
    in_force = asof_backward(probes, facts, "series", "as_of", "known", ["q"])
    both = scored.join(in_force.withColumnRenamed("as_of", "date"), ["series", "date"])
    p, q = F.col("p"), F.col("q")
    kl = S.kl(p, q)
    return both.select("series", "date", *(F.get(p, F.lit(k)).alias(f"p{k}") for k in range(5)), S.label(S.argmax(p)).alias("regime"), S.entropy(p).alias("entropy"), F.size(S.prediction_set(p, F.lit(1 - alpha))).alias("set_size"),
                       "cp_zero", "cp_short", "run_length", F.when(q.isNotNull(), kl).alias("kl"), F.when(q.isNotNull(), S.total_variation(p, q)).alias("tvd"), F.coalesce(kl <= max_kl, F.lit(False)).alias("is_consistent"))


def run_to_end(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what its source holds and return the rows it emitted."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return spark.table(name)
