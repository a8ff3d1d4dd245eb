"""Audits of features: stationarity, collinearity, drift."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: MacKinnon (1994) approximations of the p-value for a regression with constant (fixed values).
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def mackinnon_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    return normal_cdf(sum(c * tau**i for i, c in enumerate(SMALL_P if tau <= TAU_STAR else LARGE_P)))


def _regress(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    return beta, float(((y - x @ beta) ** 2).sum()), inverse


def dickey_fuller(x: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p-value, lags) of the augmented test with constant; lags by AIC over a common sample."""
    n = len(x)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    d = np.diff(x)

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(skip, len(d))
        return d[rows], np.column_stack([x[rows], *(d[rows - k] for k in range(1, lags + 1)), np.ones(len(rows))])

    def aic(lags: int) -> float:
        y, m = design(lags, most)
        _, rss, _ = _regress(y, m)
        return len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * m.shape[1]

    lags = min(range(most + 1), key=aic)
    y, m = design(lags, lags)
    beta, rss, inverse = _regress(y, m)
    tau = beta[0] / math.sqrt(max(rss / (len(y) - m.shape[1]) * inverse[0, 0], 1e-300))
    return tau, mackinnon_p(tau), lags


def stationarity(features: DataFrame, columns: list[str], level: float = 0.05) -> DataFrame:
    """One row for each feature: statistic, p-value, lags, is_stationary, status."""
    long = features.unpivot(["date"], columns, "feature", "value").filter("value is not null")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")["value"].to_numpy(float)
        if len(x) < 30 or len(np.unique(x)) <= 1:
            row = (pdf["feature"].iloc[0], len(x), None, 1.0, None, False, "INSUFFICIENT_VARIANCE")
        else:
            tau, p, lags = dickey_fuller(x)
            row = (pdf["feature"].iloc[0], len(x), round(tau, 4), round(p, 6), lags, p < level, "STATIONARY" if p < level else "NON_STATIONARY")
        return pd.DataFrame([row], columns=["feature", "n", "adf_statistic", "p_value", "lags", "is_stationary", "status"])

    return long.groupBy("feature").applyInPandas(test, "feature string, n long, adf_statistic double, p_value double, lags int, is_stationary boolean, status string")


def variance_inflation(features: DataFrame, columns: list[str], limit: float = 10.0) -> DataFrame:
    """(feature, vif, is_collinear), largest first: 1 / (1 - R2) of each z-scored feature on the others, without intercept.

    One pass gathers the matrix of cross products, of as many rows and columns as there are features; constant features go.
    """
    rows = features.select(*columns).na.drop()
    stats = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    live = [i for i in range(len(columns)) if stats[f"s{i}"]]
    z = {i: (F.col(columns[i]) - stats[f"m{i}"]) / (stats[f"s{i}"] + 1e-8) for i in live}
    pairs = [(i, j) for i in live for j in live if i <= j]
    sums = rows.agg(*(F.sum(z[i] * z[j]).alias(f"{i}_{j}") for i, j in pairs)).first() if pairs else {}
    gram = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"{i}_{j}"]
    gram = gram[np.ix_(live, live)]
    inverse = np.linalg.pinv(gram)
    out = [(columns[i], round(float(inverse[k, k] * gram[k, k]), 4)) for k, i in enumerate(live)]
    return features.sparkSession.createDataFrame([(c, v, v > limit) for c, v in sorted(out, key=lambda x: -x[1])], "feature string, vif double, is_collinear boolean")


def psi_report(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """(feature, psi, status, alarm_triggered): stability of each feature's distribution over the reference's quantile bins.

    Under 20 rows on a side, or under two distinct bins: 0. Edges come from one exact aggregation, the counts from another.
    """
    long = lambda df, side: df.unpivot([], [F.col(c) for c in columns], "feature", "value").filter("value is not null and not isnan(value)").withColumn("side", F.lit(side))
    ref, cur = long(reference.select(*columns), 0), long(current.select(*columns), 1)
    inner = [i / bins for i in range(bins + 1)]
    edges = ref.groupBy("feature").agg(F.percentile("value", inner).alias("q")).select("feature", F.array_distinct(F.slice("q", 2, bins - 1)).alias("edges"))
    both = ref.unionByName(cur).join(edges, "feature")
    bin_of = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    counts = both.groupBy("feature", "edges", bin_of.alias("bin")).agg(F.sum(1 - F.col("side")).alias("r"), F.sum("side").alias("c"))
    per = counts.groupBy("feature").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.first("edges").alias("edges"), F.collect_list(F.struct("bin", "r", "c")).alias("found"))
    k = F.size("edges") + 1
    every = F.transform(F.sequence(F.lit(0), F.size("edges")), lambda b: F.coalesce(F.get(F.filter("found", lambda x: x["bin"] == b), 0), F.struct(b.alias("bin"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("c"))))
    share = lambda n, of: (n + eps) / (of + eps * k)
    psi = F.aggregate(every, F.lit(0.0), lambda a, x: a + (share(x["r"], F.col("nr")) - share(x["c"], F.col("nc"))) * F.log(share(x["r"], F.col("nr")) / share(x["c"], F.col("nc"))))
    out = per.select("feature", F.when((F.col("nr") < 20) | (F.col("nc") < 20) | (k < 2), F.lit(0.0)).otherwise(psi).alias("psi"))
    return out.select("feature", "psi", F.when(F.col("psi") < 0.10, "STABLE").when(F.col("psi") < 0.25, "MODERATE_SHIFT").otherwise("SIGNIFICANT_DRIFT").alias("status"), (F.col("psi") >= 0.25).alias("alarm_triggered"))
