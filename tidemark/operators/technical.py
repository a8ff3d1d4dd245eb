"""Technical features of a panel: window expressions where frames suffice, a grouped scan for exponential recursions.

Every window has one specification (panel, by date), so one exchange and one sort serve all of them. Nothing looks ahead.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def W():
    """The one window of a panel. Workers import this module without a session, so it isn't made on import."""
    return Window.partitionBy("panel").orderBy("date")


FEATURES = [
    "nifty_ret_1d", "nifty_ret_5d", "nifty_ret_21d", "nifty_vol_ewma_21d", "nifty_vol_realized_21d", "nifty_vol_parkinson_21d", "nifty_dist_sma200", "nifty_dist_sma50",
    "nifty_rsi_14", "vix_level", "vix_ret_5d", "usdinr_ret_21d", "breadth_midcap_ret_21d", "breadth_midcap_ratio", "breadth_broad_ret_21d", "sector_bank_it_divergence_21d",
]


def log_return(c: str | Column, k: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.log(c / F.lag(c, k).over(W()))


def rolling(fn, c: str | Column, n: int, frame_end: int = 0) -> Column:
    """fn over the last n rows; null unless all n are there and not null."""
    w = W().rowsBetween(frame_end - n + 1, frame_end)
    return F.when(F.count(c).over(w) == n, fn(c).over(w))


def correlation(a: str, b: str, w) -> Column:
    """Correlation over a window; null where a side doesn't vary (F.corr divides by zero there in ANSI mode)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(a))).over(w) * F.stddev_pop(F.when(both, F.col(b))).over(w)
    return F.when(spread > 0, F.covar_pop(a, b).over(w) / F.nullif(spread, F.lit(0.0)))


def window_features(panel: DataFrame) -> DataFrame:
    """(panel, date, ...) with all features that fixed frames express. A panel without a benchmark is an error while planning."""
    if "bench" not in panel.columns:
        raise ValueError("the panel lacks bench")
    p = panel.withColumn("nifty_ret_1d", log_return("bench", 1))
    hl = F.pow(F.log(F.greatest("bench_high", F.lit(1e-6)) / F.greatest("bench_low", F.lit(1e-6))), 2)
    ret21 = log_return("bench", 21)
    vix5 = F.lag("vix", 5).over(W())
    return p.select(
        "panel", "date", "nifty_ret_1d", log_return("bench", 5).alias("nifty_ret_5d"), ret21.alias("nifty_ret_21d"),
        (rolling(F.stddev_samp, "nifty_ret_1d", 21) * math.sqrt(252)).alias("nifty_vol_realized_21d"),
        F.sqrt(rolling(F.sum, hl, 21) * (252 / (21 * 4 * math.log(2)))).alias("nifty_vol_parkinson_21d"),
        (F.col("bench") / rolling(F.avg, "bench", 200) - 1).alias("nifty_dist_sma200"), (F.col("bench") / rolling(F.avg, "bench", 50) - 1).alias("nifty_dist_sma50"),
        F.col("vix").alias("vix_level"), ((F.col("vix") - vix5) / F.greatest(vix5, F.lit(1e-4))).alias("vix_ret_5d"), log_return("fx", 21).alias("usdinr_ret_21d"),
        (log_return("midcap", 21) - ret21).alias("breadth_midcap_ret_21d"), F.log(F.col("midcap") / F.col("bench")).alias("breadth_midcap_ratio"),
        (log_return("broad", 21) - ret21).alias("breadth_broad_ret_21d"), (log_return("bank", 21) - log_return("it", 21)).alias("sector_bank_it_divergence_21d"),
    )


def ewm(x: np.ndarray, alpha: float, min_periods: int = 0) -> np.ndarray:
    """Exponential mean from the first value on; carried over nulls, the weights renewed after a gap."""
    out, mean, old, seen = np.full(len(x), np.nan), np.nan, 1.0, 0
    for i, v in enumerate(x):
        if not np.isnan(mean):
            old *= 1 - alpha
        if not np.isnan(v):
            seen += 1
            mean = v if np.isnan(mean) else (old * mean + alpha * v) / (old + alpha)
            old = 1.0
        if seen >= max(min_periods, 1):
            out[i] = mean
    return out


def recursive_features(panel: DataFrame, decay: float = 0.94, window: int = 14) -> DataFrame:
    """(panel, date, nifty_vol_ewma_21d, nifty_rsi_14): one linear scan for each panel."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        c = pdf["bench"].to_numpy(float)
        ret = np.r_[np.nan, np.log(c[1:] / c[:-1])] if len(c) else c
        diff = np.r_[np.nan, np.diff(c)] if len(c) else c
        gain, loss = ewm(np.maximum(diff, 0), 1 / window, window), ewm(np.maximum(-diff, 0), 1 / window, window)
        vol = np.sqrt(np.maximum(ewm(ret**2, 1 - decay), 1e-12) * 252)
        out = pd.DataFrame({"panel": pdf["panel"].to_numpy(), "date": pdf["date"].to_numpy(), "nifty_vol_ewma_21d": vol, "nifty_rsi_14": 100 - 100 / (1 + gain / (loss + 1e-12))})
        return out.astype(object).where(out.notna(), None)

    return panel.select("panel", "date", "bench").groupBy("panel").applyInPandas(scan, "panel string, date date, nifty_vol_ewma_21d double, nifty_rsi_14 double")


def recursive_features_spread(panel: DataFrame, decay: float = 0.94, window: int = 14, n: int | None = None) -> DataFrame:
    """recursive_features for panels that may hold most rows: the recursions as affine maps over ranges, composed between them."""
    rows = panel.select("panel", "date", F.col("bench").cast("double").alias("bench"))
    rows = ranges.scan(rows, ["panel"], ["date"], ranges.lagged(rows.schema, {"_prior": "bench"}), name="lagged", ranges=n)
    diff = F.col("bench") - F.col("_prior")
    rows = rows.select("panel", "date", F.pow(F.log(F.col("bench") / F.col("_prior")), F.lit(2.0)).alias("_square"), F.greatest(diff, F.lit(0.0)).alias("_up"), F.greatest(-diff, F.lit(0.0)).alias("_down"))
    rows = rows.withColumns({c: F.when(diff_known, F.col(c)) for c, diff_known in (("_up", F.col("_square").isNotNull()), ("_down", F.col("_square").isNotNull()))})
    means = ranges.decayed_means({"vol": ("_square", 1 - decay), "gain": ("_up", 1 / window), "loss": ("_down", 1 / window)})
    out = ranges.scan(rows, ["panel"], ["date"], means, name="decayed", ranges=n)
    rsi = 100 - 100 / (1 + F.col("gain") / (F.col("loss") + 1e-12))
    return out.select("panel", "date", F.when(F.col("vol").isNotNull(), F.sqrt(F.greatest("vol", F.lit(1e-12)) * 252)).alias("nifty_vol_ewma_21d"), F.when(F.col("gain_n") >= window, rsi).alias("nifty_rsi_14"))


def technical_features(panel: DataFrame) -> DataFrame:
    return window_features(panel).join(recursive_features(panel), ["panel", "date"], "full").select("panel", "date", *FEATURES)


def feature_matrix(features: DataFrame, warm_up: int = 200) -> DataFrame:
    """Rows after the warm-up, carried forward, then zero: what models are given."""
    names = [c for c in features.columns if c not in ("panel", "date")]
    rows = features.withColumn("_k", F.row_number().over(W())).filter(F.col("_k") > warm_up).drop("_k")
    return rows.select("panel", "date", *(F.coalesce(F.last(c, ignorenulls=True).over(W()), F.lit(0.0)).alias(c) for c in names))


def return_moments(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Moments of daily log returns by series: population skewness and excess kurtosis, Jarque-Bera and its chi-square tail."""
    long = panel.select("panel", "date", *(log_return(c, 1).alias(c) for c in columns)).unpivot(["panel", "date"], columns, "symbol", "r").filter("r is not null")
    m = long.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("r").alias("mean_daily"), F.stddev_samp("r").alias("std_daily"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurt"))
    m = m.withColumn("jarque_bera", F.col("n") / 6 * (F.pow("skew", F.lit(2)) + F.pow("kurt", F.lit(2)) / 4)).withColumn("jb_p_value", F.exp(-F.col("jarque_bera") / 2))
    return m.select("*", (F.col("mean_daily") * 252).alias("mean_annual"), (F.col("std_daily") * math.sqrt(252)).alias("vol_annual"), (F.col("jb_p_value") > 0.05).alias("is_gaussian"))


def rolling_correlation(panel: DataFrame, a: str, b: str, n: int = 63) -> DataFrame:
    r = panel.select("panel", "date", log_return(a, 1).alias("a"), log_return(b, 1).alias("b"))
    w = W().rowsBetween(1 - n, 0)
    both = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)
    return r.select("panel", "date", F.when(F.count(both).over(w) == n, correlation("a", "b", w)).alias("corr"))


def rebased(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Prices in percent of each series' first."""
    return panel.select("panel", "date", *((100 * F.col(c) / F.first(c, ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias(c) for c in columns))
