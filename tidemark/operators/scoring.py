"""Proper scores, baselines, tournaments, calibration tables and conformal sets.

Predictions are long: (panel, date, model, p) and truth is (panel, date, y).
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import simplex as S


def IN_TIME():
    return Window.partitionBy("panel").orderBy("date")




def climatology(truth: DataFrame) -> DataFrame:
    """(panel, p): marginal shares of the classes; classes that never occur have 0."""
    counts = truth.filter("y is not null").groupBy("panel").agg(F.count("*").alias("n"), *(F.count_if(F.col("y") == k).alias(f"c{k}") for k in range(5)))
    return counts.select("panel", F.array(*(F.col(f"c{k}") / F.col("n") for k in range(5))).alias("p"))


def persistence(truth: DataFrame, lag: int = 1, share: float = 0.02) -> DataFrame:
    """(panel, date, p): the label `lag` rows before with probability 1 - share; the first rows take their own."""
    y = F.coalesce(F.lag("y", lag).over(IN_TIME()), F.col("y"))
    return truth.filter("y is not null").select("panel", "date", y.alias("k")).select("panel", "date", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == F.col("k"), 1 - share).otherwise(share / 4)).alias("p"))


def scores(predictions: DataFrame, truth: DataFrame, order: list[int] | None = None) -> DataFrame:
    """(panel, model, n, log_loss, brier_score, rps)."""
    rows = predictions.join(truth.filter("y is not null"), ["panel", "date"])
    p, y = F.col("p"), F.col("y")
    return rows.groupBy("panel", "model").agg(F.count("*").alias("n"), F.avg(S.log_loss(p, y)).alias("log_loss"), F.avg(S.brier(p, y)).alias("brier_score"), F.avg(S.ranked_probability(p, y, order)).alias("rps"))


def tournament(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Scores of all models and of both baselines, skills against the baselines, and which beat persistence."""
    clim = truth.filter("y is not null").select("panel", "date").join(climatology(truth), "panel").withColumn("model", F.lit("climatology"))
    pers = persistence(truth).withColumn("model", F.lit("persistence"))
    every = predictions.select("panel", "date", "model", "p").unionByName(clim.select("panel", "date", "model", "p")).unionByName(pers.select("panel", "date", "model", "p"))
    table = scores(every, truth)
    names = ["log_loss", "brier_score", "rps"]
    panel = Window.partitionBy("panel")
    table = table.withColumns({f"{b}_{c}": F.max(F.when(F.col("model") == b, F.col(c))).over(panel) for b in ("climatology", "persistence") for c in names})
    skills = [(1 - F.col(c) / F.greatest(F.col(f"{b}_{c}"), F.lit(1e-6))).alias(f"skill_vs_{b}_{c}") for b in ("climatology", "persistence") for c in names]
    beats = [(F.col(c) < F.col(f"persistence_{c}")).alias(f"beats_persistence_{c}") for c in names]
    return table.select("panel", "model", "n", *names, *skills, *beats)


def reliability(predictions: DataFrame, truth: DataFrame, bins: int = 10) -> DataFrame:
    """(panel, model, bin, n, confidence, accuracy, gap) with bins (lo, hi] of the largest probability; empty bins have nulls."""
    rows = predictions.join(truth.filter("y is not null"), ["panel", "date"])
    top = F.array_max("p")
    rows = rows.select("panel", "model", F.greatest(F.lit(1), F.ceil(top * bins)).cast("int").alias("bin"), top.alias("c"), (S.argmax(F.col("p")) == F.col("y")).cast("double").alias("a"))
    found = rows.groupBy("panel", "model", "bin").agg(F.count("*").alias("n"), F.avg("c").alias("confidence"), F.avg("a").alias("accuracy"))
    every = rows.select("panel", "model").distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return every.join(found, ["panel", "model", "bin"], "left").select("panel", "model", "bin", F.coalesce("n", F.lit(0)).alias("n"), "confidence", "accuracy", F.abs(F.col("confidence") - F.col("accuracy")).alias("gap"))


def calibration_error(table: DataFrame) -> DataFrame:
    """(panel, model, ece, mce) from a reliability table."""
    return table.groupBy("panel", "model").agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def directional_accuracy(predictions: DataFrame, forward: DataFrame) -> DataFrame:
    rows = predictions.join(forward.filter("fwd_ret is not null"), ["panel", "date"])
    up = F.get("p", F.lit(0)) + 0.5 * F.get("p", F.lit(1)) > F.get("p", F.lit(4))
    return rows.groupBy("panel", "model").agg(F.avg((up == (F.col("fwd_ret") > 0)).cast("double")).alias("directional_accuracy"))


def _ranked(rows: DataFrame, value: str) -> DataFrame:
    """rows with k, the rank of a value among those of its panel and model from 0 on, and n, their number: a sort, not a list in a row."""
    group = Window.partitionBy("panel", "model")
    return rows.withColumn("k", F.row_number().over(group.orderBy(value)) - 1).withColumn("n", F.count("*").over(group))


def conformal_quantile(predictions: DataFrame, truth: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(panel, model, n, q_hat): the adjusted quantile of the calibration scores, linear between them."""
    rows = predictions.join(truth.filter("y is not null"), ["panel", "date"]).select("panel", "model", S.aps_score(F.col("p"), F.col("y")).alias("s"))
    ranked = _ranked(rows, "s")
    at = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n")) * (F.col("n") - 1)
    low = F.floor(at)
    share = F.when(F.col("k") == low, 1 - (at - low)).when(F.col("k") == low + 1, at - low)
    return ranked.filter(share > 0).groupBy("panel", "model").agg(F.max("n").alias("n"), F.sum(F.col("s") * share).alias("q_hat"))


def conformal_sets(predictions: DataFrame, alpha: Column | float = 0.1) -> DataFrame:
    mass = F.least(F.lit(0.99), F.greatest(F.lit(0.10), 1 - (alpha if isinstance(alpha, Column) else F.lit(alpha))))
    return predictions.withColumn("set", S.prediction_set(F.col("p"), mass)).withColumn("set_size", F.size("set"))


def conformal_efficiency(sets: DataFrame, truth: DataFrame) -> DataFrame:
    rows = sets.join(truth.filter("y is not null"), ["panel", "date"])
    return rows.groupBy("panel", "model").agg(
        F.avg(F.array_contains("set", F.col("y")).cast("double")).alias("empirical_coverage"), F.avg("set_size").alias("average_set_size"),
        F.avg((F.col("set_size") == 1).cast("double")).alias("single_regime_rate"), F.avg((F.col("set_size") == 0).cast("double")).alias("empty_set_rate"),
    )


def split_conformal(predictions: DataFrame, truth: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Split conformal sets {k: 1 - p_k <= q} of the second half, q from the first half's scores; sets may be empty."""
    rows = predictions.join(truth.filter("y is not null"), ["panel", "date"])
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("panel", "model").orderBy("date"))).withColumn("n", F.count("*").over(Window.partitionBy("panel", "model")))
    half = F.floor(F.col("n") / 2)
    first = _ranked(rows.filter(F.col("k") <= half).select("panel", "model", (1 - S.at(F.col("p"), F.col("y"))).alias("s")), "s")
    q = first.filter(F.col("k") + 1 == F.least(F.col("n"), F.ceil((F.col("n") + 1) * (1 - alpha)))).select("panel", "model", F.col("s").alias("q"))
    sets = rows.filter(F.col("k") > half).join(q, ["panel", "model"])
    return sets.select("panel", "model", "date", "y", F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: 1 - F.get("p", i) <= F.col("q")).alias("set"))


def aci_set(p: list[float], alpha_t: float) -> list[int]:
    """The set of one step of adaptive conformal inference: likeliest classes up to the mass that the level asks for."""
    mass = min(max(1 - alpha_t, 0.10), 0.99)
    chosen, total = [], 0.0
    for k in sorted(range(len(p)), key=lambda i: (-p[i], -i)):
        chosen.append(k)
        total += p[k]
        if total >= mass:
            break
    return chosen


def aci_update(covered: bool, alpha_t: float, alpha: float, gamma: float) -> float:
    """The level after a set whose label is known."""
    return min(max(alpha_t + gamma * (alpha - (not covered)), 0.01), 0.50)


def adaptive_conformal(predictions: DataFrame, truth: DataFrame, alpha: float = 0.1, gamma: float = 0.015, delay_days: int = 0) -> DataFrame:
    """(panel, model, date, alpha_t, set_size, error): the online trajectory, one linear scan for each panel and model.

    A label is known `delay_days` after its date: a set's level rests on labels of that many days before it at the latest.
    0 lets the level of a row rest on the label of the row before, which five-day forward labels don't allow in use.
    """
    rows = predictions.join(truth.filter("y is not null"), ["panel", "date"]).select("panel", "model", "date", "p", "y")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        now, out, waiting = alpha, [], deque()
        for at, p, y in zip(pd.to_datetime(pdf["date"]), pdf["p"], pdf["y"], strict=True):
            while waiting and waiting[0][0] <= at:
                now = aci_update(waiting.popleft()[1], now, alpha, gamma)
            chosen = aci_set(list(p), now)
            out.append((now, len(chosen), 0.0 if int(y) in chosen else 1.0))
            waiting.append((at + pd.Timedelta(days=delay_days), int(y) in chosen))
        return pdf[["panel", "model", "date"]].reset_index(drop=True).join(pd.DataFrame(out, columns=["alpha_t", "set_size", "error"]))

    return rows.groupBy("panel", "model").applyInPandas(scan, "panel string, model string, date date, alpha_t double, set_size int, error double")


def waic(log_likelihood: DataFrame) -> DataFrame:
    """(panel, model, lppd, p_waic, waic, waic_se) from (panel, model, obs, draw, ll)."""
    per = log_likelihood.groupBy("panel", "model", "obs").agg(F.max("ll").alias("m"), F.var_samp("ll").alias("v"), F.collect_list("ll").alias("all"), F.count("*").alias("s"))
    per = per.withColumn("lpd", F.col("m") + F.log(F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m"))) / F.col("s")))
    return per.groupBy("panel", "model").agg(
        F.sum("lpd").alias("lppd"), F.sum("v").alias("p_waic"), (-2 * (F.sum("lpd") - F.sum("v"))).alias("waic"), (2 * F.sqrt(F.count("*") * F.var_pop(-2 * (F.col("lpd") - F.col("v"))))).alias("waic_se")
    )


def ic_ranking(criteria: DataFrame, value: str = "elpd_loo") -> DataFrame:
    """criteria (panel, model, ...) with delta, the distance to the best expected log predictive density, and rank.

    Models with equal values share the mean of their ranks, cut to a whole number.
    """
    panel = Window.partitionBy("panel")
    place = F.rank().over(panel.orderBy(F.col(value).desc()))
    ties = F.count("*").over(Window.partitionBy("panel", value))
    return criteria.withColumn("delta", F.max(value).over(panel) - F.col(value)).withColumn("rank", F.floor(place + (ties - 1) / 2).cast("int"))


def fit_temperature(predictions: DataFrame, truth: DataFrame, low: float = 0.05, high: float = 10.0, grid: int = 12, rounds: int = 5) -> DataFrame:
    """(panel, model, temperature, nll): the temperature with the least log loss.

    Each round is one aggregation over a grid of logarithms that narrows around the best point of the round before; the loss
    has one minimum, so it can't be missed. Only one row for each panel and model reaches the driver.
    """
    spark = predictions.sparkSession
    rows = predictions.join(truth.filter("y is not null"), ["panel", "date"]).select("panel", "model", "p", "y").persist()
    try:
        bounds = [(*r, math.log(low), math.log(high)) for r in rows.select("panel", "model").distinct().collect()]
        found: list[tuple] = []
        for _ in range(rounds if bounds else 0):
            asked = [(panel, model, lo + i * (hi - lo) / grid, (hi - lo) / grid) for panel, model, lo, hi in bounds for i in range(grid + 1)]
            asked = spark.createDataFrame(asked, "panel string, model string, t double, step double")
            loss = rows.join(asked, ["panel", "model"]).groupBy("panel", "model", "t", "step").agg(F.avg(S.log_loss(S.tempered(F.col("p"), F.exp("t")), F.col("y"))).alias("nll"))
            best = loss.groupBy("panel", "model").agg(F.min_by(F.struct("t", "step", "nll"), "nll").alias("b")).select("panel", "model", "b.*").collect()
            bounds = [(r.panel, r.model, max(math.log(low), r.t - r.step), min(math.log(high), r.t + r.step)) for r in best]
            found = [(r.panel, r.model, math.exp(r.t), r.nll) for r in best]
        return spark.createDataFrame(found, "panel string, model string, temperature double, nll double")
    finally:
        rows.unpersist()
