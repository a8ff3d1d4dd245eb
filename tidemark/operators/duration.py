"""Spells and transitions of a state sequence."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.simplex import REGIMES


def IN_TIME():
    return Window.partitionBy("panel").orderBy("date")




def spells(states: DataFrame) -> DataFrame:
    """(panel, state, start_date, end_date, days) of runs of equal states; rows with null states are left out."""
    rows = states.filter("y is not null")
    new = F.coalesce((F.col("y") != F.lag("y").over(IN_TIME())).cast("int"), F.lit(1))
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(IN_TIME()))
    return runs.groupBy("panel", "_run", F.col("y").alias("state")).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("days")).drop("_run")


def transition_matrix(states: DataFrame, ahead: int = 1) -> DataFrame:
    """(panel, i, j, n, share) of the states `ahead` rows apart."""
    rows = states.filter("y is not null").select("panel", F.col("y").alias("i"), F.lead("y", ahead).over(IN_TIME()).alias("j")).filter("j is not null")
    counts = rows.groupBy("panel", "i", "j").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("panel", "i")))


def kolmogorov_p(d: float, n: int) -> float:
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.2 else 1.0


def weibull_shape(x: np.ndarray) -> float:
    """Maximum-likelihood shape with location 0 (Newton); equal values have none and give 1."""
    logs = np.log(x)
    if np.ptp(logs) == 0:
        return 1.0
    k = 1.0
    for _ in range(100):
        w = x**k
        a, b, c = w.sum(), (w * logs).sum(), (w * logs**2).sum()
        f, slope = b / a - 1 / k - logs.mean(), (c * a - b * b) / a**2 + 1 / k**2
        new = max(k - f / slope, k / 10)
        if abs(new - k) < 1e-10:
            break
        k = new
    return float(k)


def duration_audit(states: DataFrame, least: int = 5) -> DataFrame:
    """One row for each panel and regime: spells, durations, a Kolmogorov-Smirnov test against the geometric law, Weibull shape."""
    runs = spells(states)
    every = runs.select("panel").distinct().withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(len(REGIMES) - 1))))
    rows = every.join(runs.select("panel", "state", "days"), ["panel", "state"], "left")
    schema = "panel string, state int, regime string, n_spells long, mean_days double, median_days double, max_days long, geometric_p double, ks_stat double, p_value double, weibull_shape double, dependence string"

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        panel, state = pdf["panel"].iloc[0], int(pdf["state"].iloc[0])
        x = np.sort(pdf["days"].dropna().to_numpy(float))
        head = [panel, state, REGIMES[state], len(x)]
        if len(x) < least:
            row = [*head, None, None, None, None, None, None, None, "INSUFFICIENT"]
        else:
            p = float(np.clip(1 / max(1.0, x.mean()), 0.001, 0.999))
            cdf, n = 1 - (1 - p) ** np.floor(x), len(x)
            d = float(max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max()))
            k = weibull_shape(x)
            row = [*head, round(x.mean(), 4), float(np.median(x)), int(x.max()), round(p, 4), round(d, 4), round(kolmogorov_p(d, n), 4), round(k, 4), "AGING" if k > 1.1 else "MEMORYLESS" if k >= 0.9 else "EARLY_EXIT"]
        return pd.DataFrame([row], columns=[f.split()[0] for f in schema.split(", ")])

    return rows.groupBy("panel", "state").applyInPandas(test, schema)
