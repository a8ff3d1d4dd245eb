"""Contracts, artifacts, claims, model kernels and plans against small cases and brute force."""

import datetime as dt
import itertools
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.operators import contracts, ensemble, governance, network, pit, scoring, simulation, technical
from tidemark.operators.models import kernels as K
from tidemark.operators.models import latent
from tidemark.plans import fitted
from tidemark.sources import artifacts, durable, market
from tidemark.streaming import kernels as online_kernels
from tidemark.streaming import online


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_settings():
    s = settings.load({"paths": "500", "alpha": 0.2})
    assert (s.paths, s.alpha, s.seed) == (500, 0.2, 42) and settings.load() == settings.Settings()
    with pytest.raises(KeyError, match="colour"):
        settings.load({"colour": 1})


def test_unique_columns_and_pipeline(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    twice = df.select("a", "b", F.col("c").alias("a"))
    assert [tuple(r) for r in contracts.unique_columns(twice).collect()] == [(1, 2)]
    panel = spark.createDataFrame([("m", day(i), float(i)) for i in range(3)], "panel string, date date, x double")
    steps = [contracts.Stateless(lambda p: p.select("panel", "date", (2 * F.col("x")).alias("y"))), contracts.Stateless(lambda p: p.filter("x > 0").select("panel", "date", F.lit(9).alias("y"), (3 * F.col("x")).alias("z")))]
    out = contracts.FeaturePipeline(steps).fit(panel).transform(panel)
    assert sorted((r.y, r.z) for r in out.collect() if r.z is not None) == [(2.0, 3.0), (4.0, 6.0)] and out.count() == 3
    for broken in (lambda: technical.window_features(panel), lambda: contracts.full_feature_matrix(panel)):
        with pytest.raises(ValueError, match="lacks"):
            broken()
    found = {r.adapter: r.is_available for r in contracts.capabilities(spark).collect()}
    assert found["context_projection"] and len(found) == len(contracts.ADAPTERS)


def test_leaks_are_errors(spark):
    f = spark.createDataFrame([(day(i),) for i in range(5)], "date date")
    assert pit.assert_no_leak(f, F.lit(day(4))).count() == 5
    with pytest.raises(Exception, match="as-of"):
        pit.assert_no_leak(f, F.lit(day(3))).collect()


def test_artifacts(spark, tmp_path):
    base = f"file://{tmp_path}"
    assert artifacts.read_table(spark, f"{base}/nothing") is None
    for state, at in (("EXPERIMENTAL", 1), ("CHAMPION", 2)):
        artifacts.append_records(spark.createDataFrame([("m", state, at)], "model string, state string, at int"), f"{base}/cards")
    assert [r.state for r in artifacts.current_records(spark, f"{base}/cards", ["model"], "at").collect()] == ["CHAMPION"]
    a = spark.createDataFrame([(day(0), 1.0, None), (day(0), 2.0, "x"), (day(1), 3.0, "y")], "date date, v double, s string")
    assert artifacts.frame_hash(a, "date").first() == artifacts.frame_hash(a.orderBy(F.col("v").desc()).repartition(2), "date").first()
    assert artifacts.frame_hash(a, "date").first().sha256 != artifacts.frame_hash(a.withColumn("v", F.col("v") + 1), "date").first().sha256


def test_shared_folder_is_asked_for_on_clusters():
    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: folder), sparkContext=SimpleNamespace(master=master))

    assert durable.folder(session("spark://host:7077", "s3://shared/")) == "s3://shared"
    assert durable.folder(session("local[4]", None)).startswith("file://")
    for master in ("spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            durable.folder(session(master, None))


P = [0.30, 0.25, 0.20, 0.10, 0.15]


@pytest.mark.parametrize(
    ("text", "trusted"),
    [
        ("Risk-On is at 30%, Risk-Off at 15%.", True), ("Risk-On is at 30% and stands at 99% by now.", False), ("There is 30% for Risk-On and 15% Risk-Off.", True), ("Risk-Off at 30%", False),
        ("Sales rose 70% last year, which says nothing of regimes of this kind at all. Risk-On.", True), ("The changepoint probability is 10%.", True), ("A change-point is 40% likely", False),
        ("The current regime is Risk-On.", True), ("We are calling regime Risk-Off now.", False), ("The prediction set contains 2 regimes.", True), ("The conformal set is of size 4.", False),
        ("Log loss of 0.0011", False), ("Log loss of 10.00112", True), ("", True), (None, True),
    ],
)
def test_claims(spark, text, trusted):
    rows = spark.createDataFrame([(1, text, "Risk-On", P, 2, 0.1)], "id int, text string, regime string, p array<double>, set_size int, changepoint double")
    assert governance.validate_responses(rows).first().is_trusted == trusted


def test_superseded_figures_are_a_parameter(spark):
    rows = spark.createDataFrame([(1, "about 7.5", None, None, None, None)], "id int, text string, regime string, p array<double>, set_size int, changepoint double")
    assert governance.validate_responses(rows).first().is_trusted and not governance.validate_responses(rows, superseded=("7.5",)).first().is_trusted


def test_narrative_ranks_drivers(spark):
    row = spark.createDataFrame([(25.0, 0.02, -0.04, 0.01)], "v double, b double, t double, r double")
    features = {"vix_level": F.col("v"), "breadth_midcap_ret_21d": F.col("b"), "nifty_dist_sma50": F.col("t"), "nifty_ret_1d": F.col("r")}
    shares = {"vix_level": F.lit(0.2), "breadth_midcap_ret_21d": F.lit(0.4), "nifty_dist_sma50": F.lit(-0.3), "nifty_ret_1d": F.lit(0.01)}
    text = row.select(governance.narrative(F.lit("Risk-On"), F.lit(0.62), features, shares, F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")), F.lit(0.5)).alias("t")).first().t
    assert text == "Risk-On at 62.0 %. It rests on midcaps in the lead, a tense volatility index. Against it: prices below their 50-day mean. 2 of 3 models agree; not c. A break is 50.0 % likely."
    brief = lambda *x: row.select(governance.commentary(*map(F.lit, x)).alias("t")).first().t.split(":")[0]
    assert [brief("Risk-On", 0.6, 0.5, -0.1, 0.1), brief("Risk-Off", 0.6, 0.1, -0.1, 0.1), brief("Risk-On", 0.6, 0.1, -0.1, 0.1), brief("Late-Cycle", 0.6, 0.1, -0.1, 0.1)] == ["Stay cautious", "Protect capital", "Lean in", "Keep hedges"]


def test_presets_can_be_read(spark):
    parsed = simulation.parse_scenarios(spark.createDataFrame(list(enumerate(simulation.PRESETS.values())), "id int, text string"))
    assert parsed.filter("feature is null").count() == 0 and parsed.select("id").distinct().count() == len(simulation.PRESETS)


def test_ranks_of_equal_models(spark):
    rows = spark.createDataFrame([("p", m, e) for m, e in (("a", -1.0), ("b", -3.0), ("c", -1.0), ("d", -1.0), ("e", -5.0))], "panel string, model string, elpd double")
    assert {r.model: (r.rank, r.delta) for r in scoring.ic_ranking(rows, "elpd").collect()} == {"a": (2, 0), "c": (2, 0), "d": (2, 0), "b": (4, 2), "e": (5, 4)}


def test_information_criterion(spark):
    ll = np.random.RandomState(0).normal(-1, 0.3, (50, 12))
    rows = spark.createDataFrame([("p", "m", o, d, float(ll[d, o])) for d in range(50) for o in range(12)], "panel string, model string, obs long, draw long, ll double")
    r = scoring.waic(rows).first()
    lppd, p = np.log(np.exp(ll).mean(0)), ll.var(0, ddof=1)
    assert (r.lppd, r.p_waic, r.waic) == pytest.approx((lppd.sum(), p.sum(), -2 * (lppd - p).sum()))
    assert r.waic_se == pytest.approx(2 * math.sqrt(12 * (-2 * (lppd - p)).var()))


def plain_smooth(filtered, predicted, trans):
    smoothed, counts = filtered.copy(), np.zeros_like(trans)
    for t in range(len(filtered) - 2, -1, -1):
        joint = filtered[t][:, None] * trans * (smoothed[t + 1] / predicted[t + 1])[None]
        counts += joint / joint.sum()
        smoothed[t] = joint.sum(1) / joint.sum()
    return smoothed, counts


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 250, 1001])
def test_blocked_recursions(n):
    rng = np.random.default_rng(n)
    log_b, trans, start = 5 * rng.normal(size=(n, 5)), rng.dirichlet(np.ones(5), 5), rng.dirichlet(np.ones(5))
    plain, ours = K.forward_plain(log_b, trans, start), K.forward(log_b, trans, start)
    for a, b in zip((*plain, *plain_smooth(*plain[:2], trans)), (*ours, *K.smooth(*ours[:2], trans)), strict=True):
        assert a == pytest.approx(b, abs=1e-9)


def test_forward_sums_out_all_paths():
    rng = np.random.default_rng(0)
    log_b, trans, start = rng.normal(size=(6, 3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(3))
    total = sum(start[s[0]] * np.exp(log_b[range(6), s].sum()) * np.prod([trans[a, b] for a, b in itertools.pairwise(s)]) for s in itertools.product(range(3), repeat=6))
    assert K.forward(log_b, trans, start)[2] == pytest.approx(np.log(total))


def test_regression_by_sampling():
    rng = np.random.RandomState(0)
    x = np.column_stack([np.ones(400), rng.normal(size=(400, 2))])
    y = x @ [1.0, 2.0, -3.0] + 0.5 * rng.normal(size=400)
    flat, tight = K.gibbs_regression(x, y, 1), K.gibbs_regression(x, y, 1, np.array([np.inf, 1e-3, np.inf]))
    assert flat.mean(0) == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0], abs=0.01) and abs(tight[:, 1].mean()) < 0.05


def test_graph_features_by_hand():
    x = np.random.RandomState(1).normal(size=(60, 5))
    x[:, 1] += x[:, 0]
    a = np.maximum(np.corrcoef(x.T), 0) - np.eye(5)
    values, vectors = np.linalg.eig(a)
    top = np.abs(vectors[:, values.argmax()]) / np.abs(vectors[:, values.argmax()]).sum()
    laplacian = np.sort(np.linalg.eigvals(np.diag(a.sum(1)) - a).real)
    share = laplacian[laplacian > 1e-9] / laplacian.sum()
    got = network.graph_metrics(x)
    assert got[:5] == pytest.approx([np.abs(values).max(), laplacian[1], -(share * np.log(share)).sum(), top[0], top[1]], abs=1e-6)


def plain_tree(d):
    """Weights of a minimum spanning tree by Kruskal's algorithm."""
    group, out = list(range(len(d))), []
    for w, i, j in sorted((d[i, j], i, j) for i in range(len(d)) for j in range(i)):
        if group[i] != group[j]:
            group = [group[i] if g == group[j] else g for g in group]
            out.append(w)
    return out


def test_topology_by_brute_force():
    x = np.random.RandomState(2).normal(size=(25, 3))
    z = (x - x.mean(0)) / (x.std(0) + 1e-8)
    d = np.array([[math.dist(a, b) for b in z] for a in z])
    tree = plain_tree(d)
    limit, lives = 1.5 * max(tree), []
    for i in range(20):
        for j in range(i + 1, 20):
            peaks = [max(d[i, k], d[j, k], d[i, j]) for k in range(25) if k not in (i, j) and d[i, k] <= limit and d[j, k] <= limit] if d[i, j] <= limit else []
            if peaks and max(peaks) - min(peaks) > 1e-4:
                lives.append(max(peaks) - min(peaks))
    entropy = lambda v: -sum(a / sum(v) * math.log(a / sum(v) + 1e-12) for a in v)
    want = [entropy(tree), entropy(lives), sum(tree), max(lives), 0.5 * sum(v * v for v in sorted(lives)[-5:])]
    assert network.topology_metrics(x) == pytest.approx(want, abs=1e-9)


def test_fits_do_not_see_later_rows(spark):
    rng = np.random.RandomState(4)
    rows = [("p", day(i), float(rng.normal()), float(rng.normal())) for i in range(160)]
    f = spark.createDataFrame(rows, "panel string, date date, a double, b double")
    later = f.withColumns({c: F.when(F.col("date") >= F.lit(day(120)), 9 * F.col(c)).otherwise(F.col(c)) for c in "ab"})
    for model in ("hmm", "rsvar", "mixture"):
        a, b = (latent.posterior(x, ["a", "b"], model, rounds=5, until=str(day(100))).filter(F.col("date") < F.lit(day(120))).orderBy("date").toPandas() for x in (f, later))
        assert len(a) == 120 and np.allclose(np.array(a.p.tolist()), np.array(b.p.tolist()))


def test_ensemble_learns_from_the_calibration_part_alone(spark):
    s = settings.load({"train_until": str(day(50)), "calibrate_until": str(day(100))})
    rng = np.random.RandomState(5)
    y = rng.randint(0, 5, 150)
    good = [[0.8 if k == v else 0.05 for k in range(5)] for v in y]
    predictions = spark.createDataFrame([("p", day(i), m, good[i] if m == "good" else [0.2] * 5) for i in range(150) for m in ("good", "flat")], "panel string, date date, model string, p array<double>")
    truth = spark.createDataFrame([("p", day(i), int(v)) for i, v in enumerate(y)], "panel string, date date, y int")
    broken = truth.withColumn("y", F.when(F.col("date") >= F.lit(day(100)), 4 - F.col("y")).otherwise(F.col("y")))
    both = [fitted.combined(predictions, t, s).filter("model in ('stacked', 'calibrated')").orderBy("model", "date").collect() for t in (truth, broken)]
    assert both[0] == both[1] and len(both[0]) == 300
    test = scoring.scores(fitted.between(fitted.combined(predictions, truth, s), str(day(100))), truth).collect()
    assert {r.n for r in test} == {50} and min(test, key=lambda r: r.log_loss).model in ("calibrated", "stacked", "good")


def test_stream_static_join(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").limit(300)
    events.write.parquet(str(tmp_path / "e"))
    static = spark.createDataFrame([(i, f"s{i % 3}") for i in range(0, 2000, 2)], "user_id long, segment string")
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = online.run_to_end(spark, online.enriched(stream, static, "user_id").select("event_id", "segment"), "enriched_stream")
    want = online.enriched(spark.read.parquet(str(tmp_path / "e")), static, "user_id").select("event_id", "segment")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.filter("segment is null").count() > 0


def test_sessions_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "s"))
    got = online.run_to_end(spark, online.sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "s"))), "sessions_stream")
    last = events.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    want = online.sessions(events).filter(F.col("end") <= F.lit(last).cast("timestamp"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 100


def test_changepoints_reset():
    fresh, used = online_kernels.Changepoints(), online_kernels.Changepoints()
    for x in (0.1, 0.2, -3.0):
        used.update(x)
    assert used.runs.shape != fresh.runs.shape and online_kernels.Changepoints().update(0.3) == fresh.update(0.3)


def test_bars_are_aggregated_by_hash(spark, sf):
    for df in (market.daily_bars(spark, sf), market.hourly_bars(market.table(spark, sf, "events"))):
        assert "HashAggregate" in plan(df) and "SortAggregate" not in plan(df)


def test_nearest_facts_take_one_exchange(spark):
    probes = spark.createDataFrame([("a", day(i)) for i in range(0, 40, 7)], "k string, as_of date")
    facts = spark.createDataFrame([("a", day(i), i) for i in (3, 3, 9, 30)], "k string, date date, v int")
    out = pit.asof_nearest(probes, facts, "k", "as_of", "date", ["v"])
    assert plan(out).count("Exchange hashpartitioning") == 1
    got = {r.as_of: (r.v, r.is_future) for r in out.collect()}
    for i in range(0, 40, 7):
        v = min((3, 9, 30), key=lambda f: (abs(f - i), f))
        assert got[day(i)] == (v, v > i)


def test_scores_take_one_pass(spark):
    predictions = spark.createDataFrame([("p", day(i), "m", [0.2] * 5) for i in range(10)], "panel string, date date, model string, p array<double>")
    truth = spark.createDataFrame([("p", day(i), i % 5) for i in range(10)], "panel string, date date, y int")
    assert plan(scoring.tournament(predictions, truth)).count("Scan ExistingRDD") <= 8
    q = scoring.conformal_quantile(predictions, truth)
    assert "collect_list" not in plan(q) and q.first().q_hat == pytest.approx(1.0)


def test_reconciled_estimates(spark):
    a = spark.createDataFrame([("x", 1.0, [[1.0, 0.0], [0.0, 1.0]]), ("alone", 1.0, [[1.0]])], "model string, ll double, trans array<array<double>>")
    b = spark.createDataFrame([("x", 2.0, [[0.9, 0.1], [0.0, 1.0]])], "model string, ll double, trans array<array<double>>")
    assert {r.model: (r.is_reconciled, r.frobenius and round(r.frobenius, 6)) for r in ensemble.reconcile_estimates(a, b).collect()} == {"x": (True, round(math.sqrt(0.02), 6)), "alone": (False, None)}


@pytest.mark.parametrize("kind", ["variance", "mean_variance"])
@pytest.mark.parametrize("penalty", [None, "mbic", 4.0])
def test_changepoints_are_the_best_of_all(kind, penalty):
    for seed in range(6):
        rng = np.random.RandomState(seed)
        x = np.concatenate([rng.normal(rng.choice([0.0, 1.5]), rng.choice([0.3, 1.0, 4.0]), rng.randint(4, 40)) for _ in range(5)])
        n, least = len(x), 4
        value = {None: 3 * np.log(n), "mbic": (4 if kind == "mean_variance" else 3) * np.log(n)}.get(penalty, penalty)

        def cost(a, b):
            part = x[a:b] - (x.mean() if kind == "variance" else x[a:b].mean())
            return (b - a) * np.log(max((part**2).mean(), 1e-12)) + value + (np.log(b - a) if penalty == "mbic" else 0.0)

        best = np.r_[0.0, np.full(n, np.inf)]
        for t in range(least, n + 1):
            best[t] = min((best[s] + cost(s, t) for s in range(t - least + 1)), default=np.inf)
        ends = K.pelt(x, penalty, least, kind)
        assert ends[-1] == n and min(np.diff([0, *ends])) >= least
        assert sum(cost(a, b) for a, b in zip([0, *ends], ends, strict=False)) == pytest.approx(best[n])


def test_changepoints_of_short_series():
    assert K.pelt(np.zeros(0)) == [] and K.pelt(np.ones(5)) == [5] and K.pelt(np.ones(5), "mbic") == [5]
    with pytest.raises(ValueError):
        K.segment_cost(np.ones(5), "median")


def test_regression_mean_is_least_squares(spark):
    rng = np.random.RandomState(3)
    v = rng.normal(size=300)
    rows = spark.createDataFrame([("p", k, float(a), float(b)) for k, (a, b) in enumerate(zip(v, 1 + 2 * v + rng.normal(size=300), strict=True))], "panel string, date int, v double, y double")
    found = {r["term"]: r["mean"] for r in latent.bayes_regression(rows, ["v"], "y").collect()}
    plain = np.linalg.lstsq(np.column_stack([np.ones(300), v]), np.array([r.y for r in rows.orderBy("date").collect()]), rcond=None)[0]
    assert [found["intercept"], found["v"]] == pytest.approx(plain.tolist(), abs=1e-8)


def test_leaks_are_counted(spark):
    rows = spark.createDataFrame([("1998-06-29",), ("1998-06-30",), ("1998-07-02",), ("1998-07-05",), (None,)], "date string").select(F.to_date("date").alias("date"))
    day = F.lit("1998-06-30").cast("date")
    found = pit.leak_report(rows, day).first()
    assert (found.n, found.n_leaking, str(found.first_leak), str(found.last_leak)) == (5, 2, "1998-07-02", "1998-07-05")
    with pytest.raises(Exception, match="as-of"):
        pit.assert_no_leak(rows, day).collect()


def test_lookup_of_records(spark):
    records = spark.createDataFrame([("a", "1", 0.5), ("a", "1", 0.5), ("b", "1", 0.5), ("b", "1", 0.6), ("c", "1", None), ("d", "1", float("nan")), ("e", "1", float("inf")), (None, "1", 1.0)], "model string, version string, score double")
    asked = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"), ("d", "1"), ("e", "1"), (None, "1")], "model string, version string")
    found = sorted(((r.model or "", r.version, r.score, r.status) for r in governance.record_lookup(asked, records, ["model", "version"], ["score"]).collect()), key=str)
    assert found == [("", "1", None, "UNAVAILABLE"), ("a", "1", 0.5, "VERIFIED"), ("a", "1", 0.5, "VERIFIED"), ("a", "2", None, "UNAVAILABLE"), *((m, "1", None, "QUARANTINED") for m in "bcde")]
    assert governance.record_lookup(asked, records.limit(0), ["model", "version"], ["score"]).filter("status <> 'UNAVAILABLE'").count() == 0


def test_written_tables_can_be_released(spark, sf):
    kept = durable.written(spark.range(10).toDF("x"), "kept")
    once = durable.written(spark.range(5).toDF("x"), "once")
    assert durable.tables(once) == [p for p in durable.tables(once.union(kept)) if "/once-" in p] and len(durable.tables(once)) == 1
    assert durable.tables(spark.read.parquet(f"{sf}/region.parquet")) == []
    assert durable.release(spark, [*durable.tables(once), f"{sf}/region.parquet", durable.folder(spark), durable.folder(spark) + "/../x"]) == 1
    assert durable.release(spark, ["nowhere"]) == 0 and kept.count() == 10
    with pytest.raises(Exception, match="(?i)exist|not found"):
        once.count()


def test_graphs_without_edges():
    values = network.graph_metrics(np.zeros((60, 5)))
    assert values[:3] == [0.0, 0.0, 0.0] and values[3] == 1.0 and values[4] == 0.0
