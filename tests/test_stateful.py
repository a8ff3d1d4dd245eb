"""Stateful streams equal their batches, go on after a restart, take an initial state and lose nothing."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scoring
from tidemark.sources import artifacts
from tidemark.streaming import online, stateful
from tidemark.streaming.kernels import Changepoints, ParticleFilter


@pytest.fixture(scope="module")
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield stateful.with_state_store(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def day(i):
    return dt.datetime(2001, 1, 1) + dt.timedelta(days=i)


def put(spark, folder, rows, schema, name):
    """One file, which a stream reads as one micro-batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / name))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


def sink(df, path, checkpoint):
    query = df.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.parquet(str(path))


ROWS = "series string, at timestamp, x double"


def test_scores_equal_the_batch_also_after_a_restart(store, tmp_path):
    rng = random.Random(1)
    rows = [(s, day(i), rng.gauss(0, 0.01)) for i in range(40) for s in ("a", "b")]
    (tmp_path / "in").mkdir()
    put(store, tmp_path / "in", rows[:30], ROWS, "1")
    scored = stateful.score_stream(stream(store, tmp_path / "in", ROWS), particles=50)
    sink(scored, tmp_path / "out", tmp_path / "cp")
    put(store, tmp_path / "in", rows[30:], ROWS, "2")
    got = sink(stateful.score_stream(stream(store, tmp_path / "in", ROWS), particles=50), tmp_path / "out", tmp_path / "cp")
    want = online.score_batch(store.createDataFrame(rows, ROWS), particles=50)
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(online.NAMES).collect())
    assert key(got) == key(want) and got.count() == 80


def test_scores_from_an_initial_state(store, tmp_path):
    rng = random.Random(2)
    rows = [("a", day(i), rng.gauss(0, 0.01)) for i in range(30)]
    f, c = ParticleFilter(50, 42), Changepoints()
    for _, _, x in rows[:20]:
        f.update(x), c.update(x)
    initial = store.createDataFrame([stateful.model_state("a", f, c)], f"series string, {stateful.MODEL}")
    (tmp_path / "in").mkdir()
    put(store, tmp_path / "in", rows[20:], ROWS, "1")
    got = sink(stateful.score_stream(stream(store, tmp_path / "in", ROWS), particles=50, initial=initial), tmp_path / "out", tmp_path / "cp")
    want = online.score_batch(store.createDataFrame(rows, ROWS), particles=50).filter(F.col("at") >= F.lit(day(20)))
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(online.NAMES).collect())
    assert key(got) == key(want)


def test_idle_series_begin_anew(store, tmp_path):
    """b goes on while a is silent for 50 days, so a's state is dropped before its next row."""
    (tmp_path / "in").mkdir()
    parts = [[("a", day(0), 0.01), ("b", day(0), 0.02)], [("b", day(40), 0.02)], [("b", day(45), 0.01)], [("a", day(50), 0.03), ("b", day(50), 0.01)]]
    for i, rows in enumerate(parts):
        put(store, tmp_path / "in", rows, ROWS, str(i))
    got = sink(stateful.score_stream(stream(store, tmp_path / "in", ROWS), particles=50, idle_days=10), tmp_path / "out", tmp_path / "cp")
    fresh = online.score_batch(store.createDataFrame([("a", day(50), 0.03)], ROWS), particles=50).first()
    later = got.filter(F.col("series") == "a").filter(F.col("at") == F.lit(day(50))).first()
    assert (later.p0, later.run_length) == (pytest.approx(fresh.p0), fresh.run_length)


def test_conformal_stream_equals_the_delayed_batch(store, tmp_path):
    """Labels come five days after their predictions; half of both before a restart."""
    rng = random.Random(3)
    sets, labels, truth = [], [], []
    for i in range(60):
        w = [rng.random() for _ in range(5)]
        p, y = [x / sum(w) for x in w], rng.randrange(5)
        sets.append(("a", day(i), p))
        labels.append(("a", day(i), y, day(i + 5)))
        truth.append(("a", day(i).date(), y))
    P, Y = "series string, at timestamp, p array<double>", "series string, of timestamp, y int, at timestamp"
    for d in ("p", "y"):
        (tmp_path / d).mkdir()
    for part in range(4):
        put(store, tmp_path / "p", sets[part * 15 : part * 15 + 15], P, str(part))
        put(store, tmp_path / "y", [r for r in labels if part * 15 <= (r[3] - day(0)).days < part * 15 + 15] or labels[:0], Y, str(part))
        if part % 2:
            got = sink(stateful.conformal_stream(stream(store, tmp_path / "p", P), stream(store, tmp_path / "y", Y), gamma=0.05), tmp_path / "out", tmp_path / "cp")
    predictions = store.createDataFrame([(s, at.date(), "m", p) for s, at, p in sets], "panel string, date date, model string, p array<double>")
    want = scoring.adaptive_conformal(predictions, store.createDataFrame(truth, "panel string, date date, y int"), gamma=0.05, delay_days=5)
    assert sorted((r.at.date(), round(r.alpha_t, 9), r.set_size) for r in got.collect()) == sorted((r.date, round(r.alpha_t, 9), r.set_size) for r in want.collect())
    assert got.select("alpha_t").distinct().count() > 10


def test_quarantine_adds_up(store, tmp_path):
    rng = random.Random(4)
    E = "event_type string, event_id long, ts timestamp, value double"
    rows = [(rng.choice("ab"), i, day(0) + dt.timedelta(minutes=10 * i - rng.choice([0, 0, 0, 30, 300])), float(i)) for i in range(200)]
    (tmp_path / "in").mkdir()
    out = [str(tmp_path / n) for n in ("kept", "late", "cp")]
    for part in range(2):
        put(store, tmp_path / "in", rows[part * 100 : part * 100 + 100], E, str(part))
        stateful.split_stream(stateful.marked_late(stream(store, tmp_path / "in", E)), *out).awaitTermination()
    kept, late = (store.read.parquet(p) for p in out[:2])
    assert sorted(r.event_id for r in kept.unionByName(late).collect()) == list(range(200))
    want = {r.event_type: (r.n, r.n_quarantined) for r in artifacts.late_events(store.createDataFrame(rows, E)).collect()}
    counts = store.read.parquet(f"{out[1]}_counts").groupBy("event_type").agg(F.sum("n"), F.sum("n_quarantined"))
    assert {r[0]: tuple(r[1:]) for r in counts.collect()} == want and late.count() > 10


def test_reports_take_new_versions_between_micro_batches(store, tmp_path):
    rng = random.Random(5)
    rows = [("a", day(i), rng.gauss(0, 0.01)) for i in range(20)]
    (tmp_path / "in").mkdir()
    scores = lambda: stateful.score_stream(stream(store, tmp_path / "in", ROWS), particles=50)
    posteriors, out, checkpoint = (str(tmp_path / n) for n in ("posteriors", "out", "cp"))
    for version in (1, 2):
        p = [0.6, 0.1, 0.1, 0.1, 0.1] if version == 1 else [0.1, 0.1, 0.1, 0.1, 0.6]
        store.createDataFrame([("a", day(2).date(), p)], "panel string, date date, p array<double>").write.parquet(f"{posteriors}/version={version}")
        put(store, tmp_path / "in", rows[10 * version - 10 : 10 * version], ROWS, str(version))
        stateful.report_stream(scores(), posteriors, out, checkpoint).awaitTermination()
    got = store.read.parquet(out).orderBy("at").collect()
    assert [r.version for r in got] == [1] * 10 + [2] * 10 and [r.known is None for r in got[:3]] == [True, True, False]
    batch = stateful.reconciled(online.score_batch(store.createDataFrame(rows[:10], ROWS), 50), store.read.parquet(f"{posteriors}/version=1")).orderBy("at").collect()
    assert [(r.regime, round(r.kl or 0, 9), r.is_consistent) for r in got[:10]] == [(r.regime, round(r.kl or 0, 9), r.is_consistent) for r in batch]
    # The last micro-batch is run again: it keeps its rows.
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda x: int(x.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    store.createDataFrame([("a", day(2).date(), [0.2] * 5)], "panel string, date date, p array<double>").write.parquet(f"{posteriors}/version=3")
    stateful.report_stream(scores(), posteriors, out, checkpoint).awaitTermination()
    assert [tuple(r) for r in store.read.parquet(out).orderBy("at").collect()] == [tuple(r) for r in got]
    shutil.rmtree(tmp_path / "in")
