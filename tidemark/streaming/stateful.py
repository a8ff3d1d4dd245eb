"""Stateful streams on typed state variables: scores, adaptive conformal sets with delayed labels, quarantine, reconciliation.

State is kept by series in named variables of plain types, can start from a table, and is dropped by a timer when a series
falls silent. A restart from the checkpoint goes on where it stopped; what a micro-batch writes is replaced as a whole when
it is run again. These streams need the RocksDB state store (`with_state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import simplex as S
from ..operators.pit import asof_backward
from ..operators.scoring import aci_set, aci_update
from .kernels import Changepoints, ParticleFilter

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MODEL = "step long, particles array<int>, weights array<double>, runs array<double>, mu array<double>, kappa array<double>, alpha array<double>, beta array<double>"
SCORES = "series string, at timestamp, p0 double, p1 double, p2 double, p3 double, p4 double, cp_zero double, cp_short double, run_length int"
SETS = "series string, at timestamp, alpha_t double, set_size int, chosen array<int>"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, set to keep stream state in RocksDB; a running stream isn't affected."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def _whole(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True)


def model_state(series: str, filter_: ParticleFilter, changes: Changepoints) -> tuple:
    """A row of MODEL with the series before it: what an initial state table holds."""
    return (series, *_packed(filter_, changes))


def _packed(f: ParticleFilter, c: Changepoints) -> tuple:
    return (f.step, [int(x) for x in f.particles], *([float(x) for x in v] for v in (f.weights, c.runs, c.mu, c.kappa, c.alpha, c.beta)))


class Scores(StatefulProcessor):
    """The particle filter and the changepoint detector of a series."""

    def __init__(self, particles: int = 1000, seed: int = 42, idle_days: float | None = None):
        self.particles, self.seed, self.idle_ms = particles, seed, None if idle_days is None else int(idle_days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.model = handle.getValueState("model", MODEL)

    def _models(self) -> tuple[ParticleFilter, Changepoints]:
        f, c = ParticleFilter(self.particles, self.seed), Changepoints()
        if self.model.exists():
            f.step, particles, weights, *rest = self.model.get()
            f.particles, f.weights = np.array(particles, int), np.array(weights)
            c.runs, c.mu, c.kappa, c.alpha, c.beta = (np.array(x) for x in rest)
        return f, c

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.iloc[0]
        self.model.update(tuple(int(first[c]) if c == "step" else [int(x) for x in first[c]] if c == "particles" else [float(x) for x in first[c]] for c in (f.split()[0] for f in MODEL.split(", "))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        f, c = self._models()
        pdf = _whole(rows).sort_values("at")
        out = [(key[0], at, *f.update(x), *c.update(x)) for at, x in zip(pdf["at"], pdf["x"], strict=True)]
        self.model.update(_packed(f, c))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(pd.Timestamp(pdf["at"].iloc[-1]).timestamp() * 1000) + self.idle_ms)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in SCORES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.model.clear()
        return iter(())

    def close(self) -> None:
        pass


def score_stream(rows: DataFrame, particles: int = 1000, seed: int = 42, initial: DataFrame | None = None, idle_days: float | None = None, late: str = "1 hour") -> DataFrame:
    """Regime probabilities and changepoint measures of a stream of (series, at, x), rows of a micro-batch in order of time.

    `initial` (series and the columns of MODEL) gives series a state to begin with. After `idle_days` of event time
    without a row a series' state is dropped, and it begins anew. Null x are left out.
    """
    source = rows.filter("x is not null").select("series", F.col("at").cast("timestamp").alias("at"), "x")
    source = source.withWatermark("at", late) if idle_days else source
    begun = initial.select("series", *(f.split()[0] for f in MODEL.split(", "))).groupBy("series") if initial is not None else None
    return source.groupBy("series").transformWithStateInPandas(Scores(particles, seed, idle_days), SCORES, "Append", "EventTime" if idle_days else "None", begun)


class ConformalLevel(StatefulProcessor):
    """The adaptive level of a series, and the sets that still wait for their labels."""

    def __init__(self, alpha: float = 0.1, gamma: float = 0.015):
        self.alpha, self.gamma = alpha, gamma

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "alpha double")
        self.pending = handle.getMapState("pending", "of long", "chosen array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _whole(rows).sort_values(["at", "is_set", "of"])  # at one time, labels come before the set that they serve
        now, out = self.level.get()[0] if self.level.exists() else self.alpha, []
        for at, of, p, y, is_set in zip(pdf["at"], pdf["of"], pdf["p"], pdf["y"], pdf["is_set"], strict=True):
            due = (int(of),)
            if is_set:
                chosen = aci_set(list(p), now)
                self.pending.updateValue(due, (chosen,))
                out.append((key[0], at, now, len(chosen), chosen))
            elif self.pending.containsKey(due):
                now = aci_update(int(y) in self.pending.getValue(due)[0], now, self.alpha, self.gamma)
                self.pending.removeKey(due)
        self.level.update((now,))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in SETS.split(", ")])

    def close(self) -> None:
        pass


def conformal_stream(predictions: DataFrame, labels: DataFrame, alpha: float = 0.1, gamma: float = 0.015, wait: str = "30 days") -> DataFrame:
    """Prediction sets of a stream (series, at, p) whose labels (series, of, y, at: when they are known) come days later.

    An interval join meets each label with its prediction, as long as it comes within `wait`; what comes of it moves the
    level of the series from that time on. A set holds the level at its own time, so nothing looks ahead. Both streams
    are taken in order of time within a micro-batch; a label without a prediction, or after `wait`, changes nothing.
    """
    p = predictions.select(F.col("series"), F.col("at").cast("timestamp").alias("at"), "p").withWatermark("at", wait)
    y = labels.select(F.col("series").alias("_series"), F.col("of").cast("timestamp").alias("of"), "y", F.col("at").cast("timestamp").alias("known")).withWatermark("known", wait)
    met = p.join(y, (F.col("series") == F.col("_series")) & (F.col("at") == F.col("of")) & (F.col("known") >= F.col("at")) & (F.col("known") <= F.col("at") + F.expr(f"INTERVAL {wait}")))
    feedback = met.select("series", F.col("known").alias("at"), F.unix_micros("of").alias("of"), F.col("p"), F.col("y").cast("int").alias("y"), F.lit(False).alias("is_set"))
    asked = p.select("series", "at", F.unix_micros("at").alias("of"), "p", F.lit(None).cast("int").alias("y"), F.lit(True).alias("is_set"))
    return asked.unionByName(feedback).groupBy("series").transformWithStateInPandas(ConformalLevel(alpha, gamma), SETS, "Append", "None")


class Watermark(StatefulProcessor):
    """The latest time of a key; rows that lie further behind it than allowed are marked."""

    def __init__(self, late_us: int, columns: list[str], arrival: str):
        self.late_us, self.columns, self.arrival = late_us, columns, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else None
        pdf = _whole(rows)
        pdf = pdf.sort_values(self.arrival)
        at = pdf["watermark_us"].to_numpy(np.int64)
        upto = np.maximum.accumulate(at) if seen is None else np.maximum(np.maximum.accumulate(at), seen)
        self.seen.update((int(upto[-1]),))
        yield pdf[self.columns].assign(is_late=at < upto - self.late_us)

    def close(self) -> None:
        pass


def marked_late(events: DataFrame, late: str = "1 hour", arrival: str = "event_id", at: str = "ts", key: str = "event_type") -> DataFrame:
    """events, a stream, with is_late: whether a watermark of `late` behind the latest event of its key before it leaves it out. Null times are an error."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    late_us = events.sparkSession.range(1).select((F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {late}"))).alias("us")).first()[0]
    rows = events.withColumn("watermark_us", F.unix_micros(F.col(at).cast("timestamp")))
    return rows.groupBy(key).transformWithStateInPandas(Watermark(late_us, events.columns, arrival), f"{kinds}, is_late boolean", "Append", "None")


def split_stream(marked: DataFrame, kept: str, quarantine: str, checkpoint: str, key: str = "event_type"):
    """Start a stream that writes rows of marked_late to two tables, and how many of each key went where to `quarantine`_counts.

    Each micro-batch replaces its own parts of the tables, so one that is run again after a failure adds nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for path, rows in ((kept, batch.filter("not is_late")), (quarantine, batch.filter("is_late"))):
                rows.drop("is_late").write.mode("overwrite").parquet(f"{path}/batch={number}")
            batch.groupBy(key).agg(F.count("*").alias("n"), F.count_if("is_late").alias("n_quarantined")).write.mode("overwrite").parquet(f"{quarantine}_counts/batch={number}")
        finally:
            batch.unpersist()

    return marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_version(spark: SparkSession, path: str) -> int | None:
    """The greatest N of the folders version=N of a table; None if there is none yet."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    complete = [n for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max((int(n.split("=")[1]) for n in complete), default=None)


def reconciled(scored: DataFrame, batch: DataFrame, alpha: float = 0.1, max_kl: float = 0.25) -> DataFrame:
    """Scores (series, at, p0.., changepoint measures) beside the batch posterior (panel, date, p) in force: dominant regime,
    entropy, size of the prediction set, divergence and distance from the batch model, and whether they agree."""
    own = scored.select("series", "at", F.to_date("at").alias("date"), F.array(*(f"p{k}" for k in range(5))).alias("p"), "cp_zero", "cp_short", "run_length")
    facts = batch.select(F.col("panel").alias("series"), F.col("date").alias("known"), F.col("p").alias("q"))
    in_force = asof_backward(own.select("series", F.col("date").alias("as_of")).distinct(), facts, "series", "as_of", "known", ["q"])
    both = own.join(in_force.withColumnRenamed("as_of", "date"), ["series", "date"])
    p, q = F.col("p"), F.col("q")
    kl = S.kl(p, q)
    return both.select("series", "at", "known", *(F.get(p, F.lit(k)).alias(f"p{k}") for k in range(5)), S.label(S.argmax(p)).alias("regime"), S.entropy(p).alias("entropy"), F.size(S.prediction_set(p, F.lit(1 - alpha))).alias("set_size"),
                       "cp_zero", "cp_short", "run_length", F.when(q.isNotNull(), kl).alias("kl"), F.when(q.isNotNull(), S.total_variation(p, q)).alias("tvd"), F.coalesce(kl <= max_kl, F.lit(False)).alias("is_consistent"))


def report_stream(scores: DataFrame, posteriors: str, out: str, checkpoint: str, alpha: float = 0.1, max_kl: float = 0.25):
    """Start a stream that writes each micro-batch of scores, reconciled with the newest version of the batch posterior then, to out.

    `posteriors` holds version=N folders of (panel, date, p); a version written while the stream runs serves from the next
    micro-batch on. A micro-batch that was written to its end isn't written again, so a restart can't change its version.
    """
    spark = scores.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        jvm = spark._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{out}/batch={number}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            batch.write.format("noop").mode("overwrite").save()  # the state that belongs to it is still to be committed
            return
        version = newest_version(spark, posteriors)
        known = spark.read.parquet(f"{posteriors}/version={version}") if version is not None else spark.createDataFrame([], "panel string, date date, p array<double>")
        reconciled(batch, known, alpha, max_kl).withColumn("version", F.lit(version).cast("int")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return scores.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
