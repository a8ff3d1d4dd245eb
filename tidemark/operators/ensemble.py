"""Combining models: admission, information-criterion weights, stacking, mixtures, disagreement, uncertainty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import simplex as S


def admitted(registry: DataFrame, max_r_hat: float = 1.05) -> DataFrame:
    """Fitted models that didn't fail to converge; (model, is_fitted, r_hat, divergences, ...). A model without chains has null r_hat."""
    return registry.filter(F.col("is_fitted") & (F.coalesce("r_hat", F.lit(1.0)) <= max_r_hat) & (F.coalesce("divergences", F.lit(0)) == 0))


def bma_weights(registry: DataFrame) -> DataFrame:
    """(model, bic, weight) proportional to exp(-min(delta BIC, 50) / 2). Models without a BIC are an error."""
    w = Window.partitionBy(F.lit(0))
    bic = F.when(F.col("bic").isNull(), F.raise_error(F.lit("a model has no BIC"))).otherwise(F.col("bic"))
    raw = registry.select("model", bic.alias("bic")).withColumn("raw", F.exp(-0.5 * F.least(F.lit(50.0), F.col("bic") - F.min("bic").over(w))))
    return raw.select("model", "bic", (F.col("raw") / F.sum("raw").over(w)).alias("weight"))


def stacking_weights(predictions: DataFrame, truth: DataFrame, rounds: int = 25) -> DataFrame:
    """(model, weight) on the simplex with the least log loss of the mixture, by expectation maximization.

    The likelihoods of the true classes are one row for each date; each round is one small aggregation of them.
    """
    models = sorted(r[0] for r in predictions.select("model").distinct().collect())
    rows = predictions.join(truth.filter("y is not null"), ["panel", "date"]).select("panel", "date", "model", S.at(F.col("p"), F.col("y")).alias("q"))
    wide = rows.groupBy("panel", "date").agg(*(F.max(F.when(F.col("model") == m, F.greatest("q", F.lit(1e-12)))).alias(f"q{i}") for i, m in enumerate(models))).na.drop().persist()
    weights = [1 / len(models)] * len(models)
    try:
        for _ in range(rounds):
            total = sum((F.lit(w) * F.col(f"q{i}") for i, w in enumerate(weights)), F.lit(0.0))
            found = wide.agg(*(F.avg(F.lit(w) * F.col(f"q{i}") / total) for i, w in enumerate(weights))).first()
            if found[0] is None:
                break
            done = max(abs(a - b) for a, b in zip(found, weights, strict=True)) < 1e-5
            weights = list(found)
            if done:
                break
    finally:
        wide.unpersist()
    return predictions.sparkSession.createDataFrame(list(zip(models, map(float, weights), strict=True)), "model string, weight double")


def mixture(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """(panel, date, p): the weighted mean of the models' probabilities, over the models that have the date."""
    rows = predictions.join(weights.select("model", "weight"), "model")
    sums = rows.groupBy("panel", "date").agg(F.sum("weight").alias("w"), *(F.sum(F.col("weight") * F.get("p", F.lit(k))).alias(f"s{k}") for k in range(5)))
    return sums.select("panel", "date", F.array(*(F.col(f"s{k}") / F.col("w") for k in range(5))).alias("p"))


def uncertainty(predictions: DataFrame) -> DataFrame:
    """(panel, date, total_entropy, aleatoric, epistemic): entropy of the mean, mean of the entropies, their difference."""
    per = predictions.groupBy("panel", "date").agg(F.array(*(F.avg(F.get("p", F.lit(k))) for k in range(5))).alias("m"), F.avg(S.entropy(F.col("p"))).alias("aleatoric"))
    return per.select("panel", "date", S.entropy(F.col("m")).alias("total_entropy"), "aleatoric", F.greatest(F.lit(0.0), S.entropy(F.col("m")) - F.col("aleatoric")).alias("epistemic"))


def pairwise_distance(predictions: DataFrame) -> DataFrame:
    """(panel, model_a, model_b, js): mean Jensen-Shannon distance of each pair of models over their common dates."""
    a = predictions.select("panel", "date", F.col("model").alias("model_a"), F.col("p").alias("pa"))
    b = predictions.select("panel", "date", F.col("model").alias("model_b"), F.col("p").alias("pb"))
    return a.join(b, ["panel", "date"]).filter("model_a < model_b").groupBy("panel", "model_a", "model_b").agg(F.avg(S.jensen_shannon(F.col("pa"), F.col("pb"))).alias("js"))


def disagreement(predictions: DataFrame) -> DataFrame:
    per = pairwise_distance(predictions).groupBy("panel").agg(F.avg("js").alias("mean_js"), F.max("js").alias("max_js"))
    return per.select("panel", "mean_js", "max_js", F.greatest(F.lit(0.0), 1 - F.col("mean_js")).alias("concordance"))


def reconcile_estimates(ours: DataFrame, theirs: DataFrame, max_distance: float = 0.15, max_difference: float = 50.0) -> DataFrame:
    """(model, frobenius, delta_ll, is_reconciled) of two implementations' estimates (model, ll, trans): the distance of their transition
    matrices and the difference of their log-likelihoods. A model that only one of them has isn't reconciled."""
    both = ours.select("model", F.col("ll").alias("a"), F.flatten("trans").alias("p")).join(theirs.select("model", F.col("ll").alias("b"), F.flatten("trans").alias("q")), "model", "full")
    distance = F.sqrt(S.fold(F.zip_with("p", "q", lambda x, y: (x - y) * (x - y)), lambda x: x))
    rows = both.select("model", distance.alias("frobenius"), F.abs(F.col("a") - F.col("b")).alias("delta_ll"))
    return rows.withColumn("is_reconciled", F.coalesce((F.col("frobenius") < max_distance) & (F.col("delta_ll") < max_difference), F.lit(False)))


def reconcile(online: DataFrame, batch: DataFrame, max_kl: float = 0.25) -> DataFrame:
    """(panel, date, kl, tvd, is_consistent) of the online against the batch probabilities."""
    rows = online.select("panel", "date", F.col("p").alias("a")).join(batch.select("panel", "date", F.col("p").alias("b")), ["panel", "date"])
    return rows.select("panel", "date", S.kl(F.col("a"), F.col("b")).alias("kl"), S.total_variation(F.col("a"), F.col("b")).alias("tvd")).withColumn("is_consistent", F.col("kl") <= max_kl)
