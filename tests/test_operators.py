"""Small fixtures with known results, invariants, and future-perturbation tests."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import simplex as S
from tidemark.operators import audit, duration, governance, network, portfolio, quality, scoring, simulation, technical
from tidemark.operators.models import kernels as K
from tidemark.sources import market, snapshots
from tidemark.streaming import kernels as online_kernels
from tidemark.streaming import online


def day(i: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def bars(spark, closes, symbol="X", dates=None):
    return spark.createDataFrame([(symbol, (dates or [day(i) for i in range(len(closes))])[i], c, i) for i, c in enumerate(closes)], "symbol string, date date, close double, seq int")


def test_quality_counts(spark):
    r = quality.quality_report(bars(spark, [100.0, 100.0, 100.0, 100.0, 101.0, 102.0])).first()
    assert (r.n_stale, r.status) == (1, "PASSED")
    r = quality.quality_report(bars(spark, [1.0, None, 1.0, 1.0, None, 1.0, 1.01, 1.0, 1.0, 1.0])).first()
    assert (r.n_missing, r.pct_missing, r.status) == (2, 20.0, "WARNING")
    r = quality.quality_report(bars(spark, [1.0, 2.0, -1.0], dates=[day(0), day(1), day(1)]), arrival="seq").first()
    assert (r.n_duplicates, r.is_monotonic, r.status) == (1, False, "FAILED")
    assert quality.quality_report(bars(spark, [1.0]).limit(0)).count() == 0


def test_spells(spark):
    states = [0, 0, 0, 1, 1, 4, 4, 4, 4, 2, 2, 3]
    df = spark.createDataFrame([("p", day(i), s) for i, s in enumerate(states)], "panel string, date date, y int")
    assert sorted((r.state, r.days) for r in duration.spells(df).collect()) == [(0, 3), (1, 2), (2, 2), (3, 1), (4, 4)]
    assert duration.duration_audit(df).count() == 5


def test_exponential_mean_with_gap():
    out = technical.ewm(np.array([np.nan, 1, 2, np.nan, 4.0]), 0.06)
    assert np.isnan(out[0]) and out[1:] == pytest.approx([1, 1.06, 1.06, 1.2469436201780417])
    x = pd.Series(np.random.RandomState(0).normal(size=60)).mask(lambda s: s > 1)
    assert technical.ewm(x.to_numpy(), 0.1, 5) == pytest.approx(x.ewm(alpha=0.1, min_periods=5, adjust=False).mean().to_numpy(), nan_ok=True)


def panel(spark, sf, factor=1.0, after="1998-01-01"):
    p = market.panel(spark, sf)
    grow = F.when(F.col("date") > after, factor).otherwise(1.0)
    return p.withColumns({c: F.col(c) * grow for c in ("bench", "bench_high", "bench_low", "bank", "it", "midcap", "broad", "vix", "fx")})


def test_features_do_not_look_ahead(spark, sf):
    def before(p):
        f = technical.technical_features(p).join(network.graph_features(p), ["panel", "date"], "left").filter("date <= '1998-01-01'")
        return f.toPandas().sort_values("date").drop(columns="panel").set_index("date").astype(float)

    pd.testing.assert_frame_equal(before(panel(spark, sf)), before(panel(spark, sf, 5.0)))


def test_simplex_functions(spark):
    df = spark.createDataFrame([([0.5, 0.2, 0.15, 0.1, 0.05], [0.48, 0.22, 0.15, 0.1, 0.05], [0.05, 0.05, 0.1, 0.2, 0.6], 0)], "p array<double>, q array<double>, r array<double>, y int")
    row = df.select(S.kl(F.col("p"), F.col("q")).alias("near"), S.kl(F.col("p"), F.col("r")).alias("far"), S.prediction_set(F.col("p"), F.lit(0.6)).alias("s"), S.brier(F.col("p"), F.col("y")).alias("b"), S.ranked_probability(F.col("p"), F.col("y")).alias("rps"), S.is_simplex(F.col("p")).alias("ok"), S.jensen_shannon(F.col("p"), F.col("p")).alias("zero")).first()
    assert row.near < 0.25 < row.far and row.s == [0, 1] and row.ok and row.zero == 0
    assert row.b == pytest.approx(0.25 + 0.04 + 0.0225 + 0.01 + 0.0025)
    assert row.rps == pytest.approx((0.25 + 0.09 + 0.0225 + 0.0025) / 4)
    tie = spark.createDataFrame([([0.2] * 5,)], "p array<double>").select(S.prediction_set(F.col("p"), F.lit(0.3))).first()[0]
    assert tie == [4, 3]


def test_snapshot_round_trip(spark, sf, tmp_path):
    b = market.daily_bars(spark, sf).filter("date < '1995-03-01'")
    path = f"file://{tmp_path}"
    name = snapshots.create_snapshot(b, path)
    assert snapshots.latest_snapshot(spark, path) == name and snapshots.verify_snapshot(spark, path, name)
    assert snapshots.load_snapshot(spark, path, name).count() == b.count()
    victim = next(tmp_path.glob("bars/*/*/*.parquet"))
    victim.unlink()
    assert not snapshots.verify_snapshot(spark, path, name)
    assert not snapshots.verify_snapshot(spark, path, "snap_none")


def test_quotes_from_json(spark):
    doc = '{"symbol":"A","timestamp":[1577939400,1577939500,1578025800],"quote":{"open":[1,9,2],"high":[1,9,2],"low":[1,9,2],"close":[1.5,9,null],"volume":[1,1,1]}}'
    rows = snapshots.quotes_from_json(spark.createDataFrame([(doc,)], "payload string")).orderBy("date").collect()
    assert [(str(r.date), r.close) for r in rows] == [("2020-01-02", 1.5), ("2020-01-03", None)]


def test_backtest_by_hand(spark):
    w = spark.createDataFrame([("p", day(i), x, 0.9) for i, x in enumerate([0.5, 0.9, 0.52, 0.5])], "panel string, date date, target_weight double, conviction double")
    held = [r.equity_weight for r in portfolio.held_weights(w).orderBy("date").collect()]
    assert held == pytest.approx([0.5, 0.65, 0.52, 0.52])
    r = spark.createDataFrame([("p", day(i), x, x) for i, x in enumerate([0.01, -0.02, 0.03, 0.0])], "panel string, date date, equity_return double, benchmark_return double")
    path = portfolio.backtest_paths(portfolio.held_weights(w), r, delay=0).orderBy("date").collect()
    want = np.array(held) * [0.01, -0.02, 0.03, 0.0] + (1 - np.array(held)) * 0.065 / 252 - np.array([0, 0.15, 0.13, 0]) * 0.0015
    assert [x.strategy_return for x in path] == pytest.approx(want)
    assert [x.strategy_wealth for x in path] == pytest.approx(np.cumprod(1 + want))


def test_psi(spark):
    rng = np.random.RandomState(0)
    a = spark.createDataFrame([(float(x), float(x)) for x in rng.normal(size=500)], "same double, moved double")
    b = spark.createDataFrame([(float(x), float(x) + 2) for x in rng.normal(size=500)], "same double, moved double")
    found = {r.feature: r for r in audit.psi_report(a, b, ["same", "moved"]).collect()}
    assert found["same"].psi < 0.15 and found["moved"].alarm_triggered


def test_dickey_fuller():
    rng = np.random.RandomState(1)
    assert audit.dickey_fuller(rng.normal(size=400))[1] < 0.01
    assert audit.dickey_fuller(rng.normal(size=400).cumsum())[1] > 0.05


def test_hidden_markov_filter_recovers_states():
    rng = np.random.RandomState(3)
    s = np.repeat(rng.randint(0, 2, 20), 25)
    x = np.column_stack([np.where(s, 2.0, -2.0) + 0.3 * rng.normal(size=500), rng.normal(size=500)])
    m = K.fit_hmm(x, k=2)
    p = K.hmm_proba(x, m, causal=True)
    assert p.sum(1) == pytest.approx(np.ones(500))
    assert ((p[:, 0] > 0.5) == (s == 1)).mean() > 0.97
    assert K.hmm_proba(np.r_[x[:300], 9 * x[300:]], m, causal=True)[:300] == pytest.approx(p[:300])


def test_kernels():
    assert K.gelman_rubin(np.random.RandomState(0).normal(size=(2, 500))) < 1.05
    assert K.pelt(np.r_[np.random.RandomState(0).normal(size=200), 5 + np.random.RandomState(1).normal(size=200)]) == [200, 400]
    assert abs(duration.weibull_shape(np.random.RandomState(2).weibull(1.7, 4000)) - 1.7) < 0.1
    ll = np.random.RandomState(0).normal(-1, 0.1, (400, 20))
    e, k = K.psis(ll)
    assert np.allclose(e, -1, atol=0.1) and (k < 0.7).all()
    net = K.Network(2, 0)
    x = np.random.RandomState(0).normal(size=(300, 2))
    y = np.eye(5)[(x[:, 0] > 0).astype(int)]
    net.fit(x, y, epochs=200)
    assert (net.sample(x, 1)[0].argmax(1) == y.argmax(1)).mean() > 0.95


def test_changepoint_state():
    c = online_kernels.Changepoints()
    out = [c.update(x) for x in np.r_[np.random.RandomState(0).normal(0, 0.01, 80), np.random.RandomState(1).normal(0.5, 0.01, 10)]]
    assert all(abs(o[0] - 0.01) < 1e-12 for o in out)
    assert out[79][2] > 25 and out[-1][2] < 15


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.RandomState(0)
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(rng.normal(0, 0.01))) for i in range(30) for s in ("a", "b")]
    df = spark.createDataFrame(rows, "series string, at timestamp, x double")
    for part in (0, 1):
        df.filter((F.hour("at") % 24 < 12) == (part == 0)).filter("at < '2024-01-02'" if part == 0 else "at >= '2024-01-01 12:00:00' and hour(at) >= 12").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    streamed = online.run_to_end(spark, online.score_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), particles=50), "scored").toPandas()
    batch = online.score_batch(source, particles=50).toPandas()
    key = ["series", "at"]
    pd.testing.assert_frame_equal(streamed.sort_values(key, ignore_index=True), batch.sort_values(key, ignore_index=True), check_dtype=False)


def test_windowed_bars_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = online.run_to_end(spark, online.windowed_bars(stream), "bars_stream").toPandas()
    last = events.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    # a window is final once the watermark, an hour behind the latest event, has passed its end
    want = market.hourly_bars(events).filter(F.col("hour") + F.expr("INTERVAL 1 HOUR") <= F.lit(last).cast("timestamp")).toPandas()
    key = ["symbol", "hour"]
    assert len(want) > 400
    pd.testing.assert_frame_equal(got[want.columns].sort_values(key, ignore_index=True), want.sort_values(key, ignore_index=True), check_dtype=False)


def test_governance_and_validator(spark):
    cols = "id int, text string, regime string, p array<double>, set_size int, changepoint double"
    p = [0.6, 0.2, 0.1, 0.05, 0.05]
    rows = [
        (1, "The dominant regime is Risk-On at 60.0%.", "Risk-On", p, 2, 0.1), (2, "The dominant regime is Risk-Off.", "Risk-On", p, 2, 0.1), (3, "Risk-On probability is 80%", "Risk-On", p, 2, 0.1),
        (4, "changepoint probability is 50%", "Risk-On", p, 2, 0.1), (5, "conformal set of size 3", "Risk-On", p, 2, 0.1), (6, "RPS of 0.0003", None, None, None, None), (7, None, None, None, None, None),
    ]
    got = {r.id: r.is_trusted for r in governance.validate_responses(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True}


def test_scenarios_run_paths_from_stressed_probabilities(spark):
    data = [(1, {"usdinr_ret_21d": 0.03}), (2, {"vix_level": 30.0}), (3, {"nifty_ret_1d": -0.03}), (4, {"usdinr_ret_21d": 0.01})]
    vectors = spark.createDataFrame(data, "id long, shocks map<string,double>")
    start = [0.3, 0.25, 0.2, 0.1, 0.15]
    got = {r.id: r for r in simulation.simulate_scenarios(vectors, start).collect()}
    assert sorted(got) == [1, 2, 3, 4] and len({got[i].var_95 for i in (1, 2, 3)}) == 3 and got[1].var_95 == got[4].var_95
    for i in (1, 2):
        r = simulation.tail_risk(simulation.simulate(spark, [got[i][f"p{k}"] for k in range(5)], paths=5000)).first()
        assert (got[i].var_95, got[i].cvar_95, got[i].expected_return) == pytest.approx((r.var_95, r.cvar_95, r.expected_return), abs=1e-12)
    assert got[2].var_95 < got[1].var_95 and got[2].expected_return < got[1].expected_return
    fixed = {r.id: r for r in simulation.simulate_scenarios(vectors, start, parametric=True).collect()}
    assert fixed[2].var_95 == pytest.approx(-1.645 * 0.15 * (21 / 252) ** 0.5) and fixed[3].expected_return == pytest.approx(-0.63)


def test_simulation_is_partition_independent(spark):
    a = simulation.simulate(spark, [0.2] * 5, days=5, paths=50).orderBy("path", "day").collect()
    b = simulation.simulate(spark, [0.2] * 5, days=5, paths=50).repartition(3).orderBy("path", "day").collect()
    assert a == b
    off = simulation.tail_risk(simulation.simulate(spark, [0, 0, 0, 0, 1.0], paths=500)).first()
    on = simulation.tail_risk(simulation.simulate(spark, [1.0, 0, 0, 0, 0], paths=500)).first()
    assert off.var_95 < on.var_95 and off.cvar_95 <= off.var_95


def test_temperature_recovers(spark):
    rng = np.random.RandomState(0)
    rows, truth = [], []
    for i in range(400):
        p = rng.dirichlet(np.ones(5))
        y = int(rng.choice(5, p=p))
        sharp = p**2 / (p**2).sum()
        rows.append(("m", day(i), "sharp", [float(v) for v in sharp]))
        truth.append(("m", day(i), y))
    t = scoring.fit_temperature(spark.createDataFrame(rows, "panel string, date date, model string, p array<double>"), spark.createDataFrame(truth, "panel string, date date, y int"), rounds=3).first()
    assert 1.5 < t.temperature < 2.7
