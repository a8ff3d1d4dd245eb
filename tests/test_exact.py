"""Exact loops, silhouettes and samplers against plain definitions, and folds that can't see ahead."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import network, walkforward
from tidemark.operators.models import hamiltonian, kernels, latent, neural


def rank2(rows):
    """Rank of a matrix modulo 2, rows as whole numbers."""
    pivots = {}
    for r in rows:
        while r:
            top = r.bit_length()
            if top not in pivots:
                pivots[top] = r
                break
            r ^= pivots[top]
    return len(pivots)


def betti1(d, a, b):
    """Loops of the complex at length a that are still open at length b: dim Z1(a) - dim(Z1(a) and B1(b)), by ranks alone."""
    n = len(d)
    edges = list(itertools.combinations(range(n), 2))
    index = {e: i for i, e in enumerate(edges)}
    early = [e for e in edges if d[e] <= a]
    cycles = len(early) - rank2([1 << i | 1 << j for i, j in early])
    bounds = [1 << index[x, y] | 1 << index[x, z] | 1 << index[y, z] for x, y, z in itertools.combinations(range(n), 3) if max(d[x, y], d[x, z], d[y, z]) <= b]
    late = [1 << index[e] for e in edges if d[e] > a]
    # The boundaries that use early edges alone: all boundaries, less what is seen of them on the late edges.
    seen = sum(late)
    return cycles - (rank2(bounds) - rank2([x & seen for x in bounds]))


@pytest.mark.parametrize("seed", range(4))
def test_loops_against_ranks(seed):
    rng = np.random.RandomState(seed)
    x = rng.normal(size=(9, 2)) if seed else np.array([[math.cos(t), math.sin(t)] for t in np.linspace(0, 2 * math.pi, 9)[:-1]] + [[5.0, 0.0]])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    lengths = sorted({round(v, 12) for v in d[np.triu_indices(9, 1)]})
    d = np.round(d, 12)
    # Each loop's lifetime adds, for every pair of neighbouring lengths it is open over, their difference.
    total = sum((b - a) * betti1(d, a, a) for a, b in zip(lengths, lengths[1:], strict=False))
    assert network.loop_lifetimes(d).sum() == pytest.approx(total)
    if seed == 0:
        assert len(network.loop_lifetimes(d)) == 1


def test_loops_use_all_points():
    """A circle whose points come after twenty others far from it: the variant of the first points can't see it."""
    rng = np.random.RandomState(1)
    circle = np.array([[math.cos(t), math.sin(t)] for t in np.linspace(0, 2 * math.pi, 31)[:-1]])
    x = np.vstack([rng.normal(scale=0.01, size=(20, 2)) + 1.2, circle])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert network.loop_lifetimes(d).max() > 1


def plain_silhouettes(y, e):
    out = []
    for i in range(len(y)):
        mean = {c: np.mean([math.dist(e[i], e[j]) for j in range(len(y)) if y[j] == c and j != i] or [math.nan]) for c in set(y)}
        a, b = mean.pop(y[i]), min(mean.values(), default=math.nan)
        out.append(0.0 if math.isnan(a) or math.isnan(b) or max(a, b) == 0 else (b - a) / max(a, b))
    return out


def test_silhouettes_of_all_rows(spark):
    """Above the 1,500 rows that a sample had, a hot class, equal rows, a class of one row."""
    rng = np.random.RandomState(2)
    n = 2000
    y = np.where(rng.rand(n) < 0.6, 0, rng.randint(0, 4, n))
    y[0] = 9
    e = rng.normal(size=(n, 3)) + y[:, None] * 0.3
    e[10:20] = e[10]
    df = spark.createDataFrame([(i, int(y[i]), e[i].tolist()) for i in range(n)], "id long, y int, embedding array<double>")
    got = {r.id: r.silhouette for r in neural.silhouettes(df, block=300).collect()}
    d = np.sqrt(((e[:, None] - e[None]) ** 2).sum(-1))
    assert len(got) == n
    for i in (0, 1, 10, 11, 500, 1999):
        mean = {c: d[i, (y == c) & (np.arange(n) != i)].mean() if ((y == c) & (np.arange(n) != i)).any() else math.nan for c in set(y.tolist())}
        a, b = mean.pop(int(y[i])), min(mean.values())
        assert got[i] == pytest.approx(0.0 if math.isnan(a) else (b - a) / max(a, b))
    some = [(i, int(y[i]), e[i].tolist()) for i in range(60)]
    small = neural.silhouettes(spark.createDataFrame(some, df.schema), block=7).collect()
    assert [r.silhouette for r in sorted(small)] == pytest.approx(plain_silhouettes([r[1] for r in some], [r[2] for r in some]))
    assert {r.silhouette for r in neural.silhouettes(df.filter("y = 0").limit(20)).collect()} == {0.0}


def test_density_gradient_and_gibbs_agree():
    rng = np.random.RandomState(0)
    x = np.concatenate([rng.normal(-1, 0.3, 200), rng.normal(0.2, 0.2, 250), rng.normal(1.5, 0.5, 150)])
    f, z = hamiltonian.mixture_density(x, 3), rng.normal(size=8) * 0.3
    value, grad = f(z)
    numeric = [(f(z + 1e-5 * np.eye(8)[i])[0] - f(z - 1e-5 * np.eye(8)[i])[0]) / 2e-5 for i in range(8)]
    assert grad == pytest.approx(numeric, rel=1e-5, abs=1e-3)
    a, b = hamiltonian.mixture(x, 1, 3), kernels.gibbs_mixture(x, 1, k=3, rounds=1500, burn=500)
    for name in ("weights", "means", "sds"):
        for j in range(3):
            error = math.sqrt(sum(s[name][:, j].var() / kernels.effective_size(s[name][:, j]) for s in (a, b)))
            assert abs(a[name][:, j].mean() - b[name][:, j].mean()) < 4 * error, (name, j)
    assert not a["diverged"].any()


def test_divergences_of_a_funnel():
    def funnel(z):
        v, e = z[0], math.exp(min(-z[0], 700))
        s = float((z[1:] ** 2).sum())
        return -v * v / 18 - (len(z) - 1) * v / 2 - e * s / 2, np.r_[-v / 9 - (len(z) - 1) / 2 + e * s / 2, -e * z[1:]]

    def smooth(z):
        return -0.5 * float(z @ z), -z

    assert hamiltonian.NoUTurn(funnel, np.zeros(31), 3, target=0.6).run(200, 500)[1].any()
    draws, diverged = hamiltonian.NoUTurn(smooth, np.zeros(5), 3).run(300, 1000)
    assert not diverged.any() and draws.var(0) == pytest.approx(np.ones(5), abs=0.2)


def test_sampler_report(spark):
    rng = random.Random(3)
    rows = [("p", f"2000-01-{1 + i % 28:02d}", rng.gauss(-1 if i % 2 else 1, 0.3)) for i in range(120)]
    df = spark.createDataFrame(rows, "panel string, date string, x double")
    report = latent.sampler_report(latent.hamiltonian_chains(df, "x", components=2, warm_up=150, draws=150)).orderBy("state").collect()
    assert [round(r["mean"]) for r in report] == [-1, 1] and all(r.n_divergent == 0 and r.r_hat < 1.1 for r in report)


def test_folds_see_nothing_ahead(spark):
    """Rows after a fold's first day, and labels that weren't complete before it, change nothing that the fold says of that day."""
    rng = random.Random(4)
    days = [f"{1997 + i // 300}-{1 + i % 300 // 25:02d}-{1 + i % 25:02d}" for i in range(900)]
    rows = [("p", d, rng.gauss(0, 1), rng.gauss(0, 1)) for d in days]
    truth = [("p", d, rng.randrange(5)) for d in days]
    starts, cut = ["1998-06-01", "1999-01-01"], days.index("1999-01-01")
    F_, T_ = "panel string, date string, a double, b double", "panel string, date string, y int"
    frame = lambda r, s: spark.createDataFrame(r, s).withColumn("date", F.to_date("date"))
    parts = walkforward.folds(frame(rows, F_), starts).groupBy("fold", "part").agg(F.min("date"), F.max("date"), F.count("*").alias("n")).collect()
    by = {(r.fold, r.part): r for r in parts}
    assert by[1, "gap"].n == 5 and by[1, "train"].n == cut - 5 and by[0, "test"].n == cut - days.index("1998-06-01") and by[1, "test"].n == 900 - cut
    for model in ("hmm", "network"):
        run = lambda r, t: {(x.fold, str(x.date)): x.p for x in walkforward.refitted(frame(r, F_), frame(t, T_), ["a", "b"], starts, model, rounds=5, epochs=5).collect()}  # noqa: E731, B023
        one = run(rows, truth)
        changed = run(rows[: cut + 1] + [(p, d, 9.0 + a, -b) for p, d, a, b in rows[cut + 1 :]], truth[: cut - 5] + [(p, d, (y + 1) % 5) for p, d, y in truth[cut - 5 :]])
        assert one[1, "1999-01-01"] == changed[1, "1999-01-01"] and one[0, "1998-06-01"] == changed[0, "1998-06-01"]
        assert {k: v for k, v in one.items() if k[0] == 0} == {k: v for k, v in changed.items() if k[0] == 0}
        assert len(one) == 900 - days.index("1998-06-01")


def test_probe_predicts_days_it_has_not_seen(spark):
    rng = np.random.RandomState(5)
    y = rng.randint(0, 3, 200)
    rows = [("p", f"2000-{1 + i // 25:02d}-{1 + i % 25:02d}", (rng.normal(size=2) + 4 * np.eye(3, 2)[y[i]]).tolist(), int(y[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "panel string, date string, embedding array<double>, y int").withColumn("date", F.to_date("date"))
    out = neural.probe(df.drop("y"), df.drop("embedding"), train_before="2000-05-01").collect()
    assert len(out) == 100 and min(str(r.date) for r in out) == "2000-05-01" and np.mean([r.y == r.predicted for r in out]) > 0.9


def test_weights_earn_from_the_next_day_on(spark):
    """Changing a day's return changes what is decided after it, never what it earns itself."""
    from tidemark.operators import portfolio

    days = [f"2001-01-{d:02d}" for d in range(1, 9)]
    weights = spark.createDataFrame([("p", d, w, 0.5) for d, w in zip(days, (0.2, 0.8, 0.8, 0.1, 0.5, 0.5, 1.0, 0.0), strict=True)], "panel string, date string, equity_weight double, conviction double")
    returns = spark.createDataFrame([("p", d, 0.01 * i, 0.01 * i) for i, d in enumerate(days)], "panel string, date string, equity_return double, benchmark_return double")
    frame = lambda df: df.withColumn("date", F.to_date("date"))
    got = portfolio.backtest_paths(frame(weights), frame(returns), cost_bps=0, risk_free=0).orderBy("date").collect()
    assert [str(r.date) for r in got] == days[1:]
    assert [r.strategy_return for r in got] == pytest.approx([0.2 * 0.01, 0.8 * 0.02, 0.8 * 0.03, 0.1 * 0.04, 0.5 * 0.05, 0.5 * 0.06, 1.0 * 0.07])


def test_windows_are_dealt_out(spark):
    """One panel's windows come out of one task; most tasks of what is computed from them must have some."""
    days = spark.range(120).selectExpr("'main' AS panel", "date_add(date'2000-01-01', CAST(id AS int)) AS date", *(f"100 + pmod(hash(id, {k}), 50) AS {n}" for k, n in enumerate(network.NODES)))
    for found in (network.topology_features(days), network.graph_features(days)):
        rows = found.select("date", F.spark_partition_id().alias("part")).collect()
        assert len({r.date for r in rows}) == len(rows) == 60 and len({r.part for r in rows}) >= 3


def test_exact_topology_of_every_window(spark, sf):
    """Each day's values are those of its own sixty days, none carried forward from an earlier window."""
    from tidemark.plans import fitted
    from tidemark.plans.queries import QUERIES

    days = fitted.market.panel(spark, sf).orderBy("date").select("date", "bench", "midcap", "bank", "it").collect()
    prices = np.array([r[1:] for r in days], float)
    moves = np.vstack([np.zeros(4), np.nan_to_num(np.log(prices[1:] / prices[:-1]))])
    rows = QUERIES["topology_exact"](spark, sf).orderBy("date").collect()
    assert len(rows) > 60 and [r.date for r in rows] == [str(r.date) for r in days[60:]]
    for k, row in enumerate(rows):
        z = moves[k : k + 60]
        z = (z - z.mean(0)) / (z.std(0) + 1e-8)
        d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
        assert row.tda_h0_amplitude == pytest.approx(network.tree_weights(d).sum(), abs=2e-6), row.date
        if k < 30:
            loops = network.loop_lifetimes(d)
            want = [loops.max(), 0.5 * sum(v * v for v in sorted(loops)[-5:]), -sum(v / loops.sum() * math.log(v / loops.sum()) for v in loops if v > 1e-8)]
            assert [row.tda_h1_max_lifetime, row.tda_landscape_l1, row.tda_persistence_entropy_h1] == pytest.approx(want, abs=2e-6), row.date
