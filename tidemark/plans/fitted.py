"""The run from fitted models to decisions: fit on the first part of the panel, stack and calibrate on the second, score on the third."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import simplex as S
from ..operators import contracts, ensemble, network, pit, portfolio, scoring, targets, walkforward
from ..operators.models import latent, neural
from ..settings import Settings
from ..sources import market
from ..sources.durable import written
from .queries import INPUTS, _features, _five, query

SETTINGS = Settings()


def members(features: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(panel, date, model, p) of seven models that have seen nothing on or after settings.train_until."""
    until = settings.train_until
    draws = written(latent.gibbs_draws(features, INPUTS[:2], seed=settings.seed, until=until), "draws")
    soft = targets.soft_targets(features.filter(F.col("date") < F.lit(until).cast("date")))
    split = pit.split_by_date(features, "date", until, settings.calibrate_until)
    rows = split.join(soft, ["panel", "date"], "left").withColumn("p", F.coalesce("p", F.array(*(F.lit(0.2) for _ in range(5)))))
    parts = [latent.posterior(features, INPUTS, "hmm", until=until), latent.posterior(features, INPUTS[:3], "rsvar", until=until), latent.posterior(features, INPUTS[:1], "mixture", until=until),
             latent.gibbs_posterior(features, INPUTS[:2], draws, until=until), *(neural.network_posterior(rows, INPUTS, kind, seed=settings.seed) for kind in ("deep", "dropout", "variational"))]
    return reduce(DataFrame.unionByName, [d.select("panel", "date", "model", "p") for d in parts])


def settled(truth: DataFrame, until: str, horizon: int = 5) -> DataFrame:
    """Labels that were complete before a date: those whose `horizon`-th following row lies before it."""
    known = F.lead("date", horizon).over(Window.partitionBy("panel").orderBy("date"))
    return truth.withColumn("_known", known).filter(F.col("_known") < F.lit(until).cast("date")).drop("_known")


def between(df: DataFrame, start: str, end: str | None = None) -> DataFrame:
    df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    return df.filter(F.col("date") < F.lit(end).cast("date")) if end else df


def combined(predictions: DataFrame, truth: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """predictions with `stacked`, their mixture by weights of the calibration part, and `calibrated`, that at the temperature of the same part."""
    from_, to = settings.train_until, settings.calibrate_until
    known, labels = between(predictions, from_, to), between(settled(truth, to), from_, to)
    weights = ensemble.stacking_weights(known, labels)
    stacked = written(ensemble.mixture(predictions, weights).select("panel", "date", F.lit("stacked").alias("model"), "p"), "stacked")
    temperature = scoring.fit_temperature(between(stacked, from_, to), labels).select("panel", "temperature")
    calibrated = stacked.join(temperature, "panel").select("panel", "date", F.lit("calibrated").alias("model"), S.tempered(F.col("p"), F.col("temperature")).alias("p"))
    return predictions.select("panel", "date", "model", "p").unionByName(stacked).unionByName(calibrated)


def _run(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, predictions of all members and both ensembles, truth)."""
    f = _features(spark, sf_dir, often=True)
    truth = written(targets.forward_target(f, train_before=SETTINGS.train_until), "truth")
    return f, written(combined(written(members(f), "members"), truth), "predictions"), truth


@query()
def fitted_scores(spark, sf_dir):
    """The tournament of fitted models and ensembles on the test part alone."""
    _, predictions, truth = _run(spark, sf_dir)
    from_ = SETTINGS.calibrate_until
    return scoring.tournament(between(predictions, from_), between(truth, from_)).drop("panel")


@query()
def fitted_sets(spark, sf_dir):
    """Adaptive prediction sets of the calibrated ensemble over the test part, with what each of its members' contracts says."""
    _, predictions, truth = _run(spark, sf_dir)
    test = between(predictions, SETTINGS.calibrate_until).filter("model = 'calibrated'")
    sets = scoring.adaptive_conformal(test, truth, SETTINGS.alpha, SETTINGS.gamma, delay_days=7)  # five trading days
    rows = sets.join(test.select("panel", "date", "p"), ["panel", "date"])
    return rows.select("date", "alpha_t", "set_size", "error", F.size(contracts.prediction_faults(F.col("p"), F.lit(0.0), F.array(F.lit(0)))).alias("faults"))


@query()
def fitted_backtest(spark, sf_dir):
    """The test part's backtest on the calibrated ensemble's weights, which are held a day before they earn."""
    f, predictions, _ = _run(spark, sf_dir)
    weights = portfolio.allocate(between(predictions, SETTINGS.calibrate_until).filter("model = 'calibrated'"))
    r = F.expm1(0.02 * F.col("nifty_ret_1d"))
    returns = f.select("panel", "date", r.alias("equity_return"), r.alias("benchmark_return")).na.drop()
    return portfolio.backtest_metrics(portfolio.backtest_paths(weights, returns, SETTINGS.cost_bps, SETTINGS.risk_free)).drop("panel")


@query()
def fitted_members(spark, sf_dir):
    """Probabilities of the seven fitted models."""
    return _five(members(_features(spark, sf_dir, often=True)), ["model", "date"])


#: Starts of the folds of the walk-forward queries.
FOLDS = ["1998-01-01", "1999-01-01", "2000-01-01", "2001-01-01"]


@query()
def walk_forward_scores(spark, sf_dir):
    """Scores, fold by fold, of a hidden Markov model and a network that are fitted anew each year on what was known then."""
    f = _features(spark, sf_dir, often=True)
    truth = written(targets.forward_target(f, train_before=FOLDS[0]), "truth")
    both = walkforward.refitted(f, truth, INPUTS, FOLDS).unionByName(walkforward.refitted(f, truth, INPUTS, FOLDS, "network"))
    rows = both.join(truth.filter("y is not null").select("panel", "date", "y"), ["panel", "date"])
    p, y = F.col("p"), F.col("y")
    return rows.groupBy("fold", "model").agg(F.count("*").alias("n"), F.avg(S.log_loss(p, y)).alias("log_loss"), F.avg(S.brier(p, y)).alias("brier_score"), F.avg((S.argmax(p) == y).cast("double")).alias("accuracy"))


@query()
def hamiltonian_convergence(spark, sf_dir):
    """Agreement, effective draws and divergences of the no-U-turn sampler's chains on a mixture of two normals."""
    return latent.sampler_report(latent.hamiltonian_chains(_features(spark, sf_dir), "nifty_ret_1d")).drop("panel")


@query()
def topology_exact(spark, sf_dir):
    """Topological features of every window with the loops of all its sixty points."""
    return network.topology_features(market.panel(spark, sf_dir), exact=True).drop("panel")
