"""Allocation from regime probabilities, backtests, and their attribution."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import simplex as S
from .pit import in_episodes


def IN_TIME():
    return Window.partitionBy("panel").orderBy("date")


#: Equity share of each regime (fixed values).
EQUITY = [0.95, 0.70, 0.50, 0.80, 0.25]


def conviction(p: Column, set_size: Column | None = None, epistemic: Column | None = None) -> Column:
    out = F.array_max(p)
    if set_size is not None:
        out = out * F.least(F.lit(1.0), F.greatest(F.lit(0.1), 1 - (set_size - 1) / 4))
    if epistemic is not None:
        out = out * F.exp(-F.least(F.lit(3.0), F.greatest(F.lit(0.0), epistemic)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def target_weight(p: Column, conv: Column, base: float = 0.6, low: float = 0.2, high: float = 1.0) -> Column:
    raw = S.fold(F.zip_with(p, F.array(*map(F.lit, EQUITY)), lambda a, b: a * b), lambda x: x)
    return F.least(F.lit(high), F.greatest(F.lit(low), base + conv * (raw - base)))


def held_weights(targets: DataFrame, band: float = 0.05, cap: float = 0.15) -> DataFrame:
    """targets with equity_weight: held while within the band of the weight before, else moved by at most cap. One scan a panel."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        out: list[float] = []
        for t in pdf["target_weight"]:
            if not out:
                out.append(t)
            else:
                delta = t - out[-1]
                out.append(out[-1] if abs(delta) < band else out[-1] + min(max(delta, -cap), cap))
        return pdf.assign(equity_weight=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in targets.schema)
    return targets.groupBy("panel").applyInPandas(scan, f"{fields}, equity_weight double")


def allocate(predictions: DataFrame) -> DataFrame:
    """(panel, date, conviction, target_weight, equity_weight, cash_weight) from (panel, date, p).

    Columns set_size and epistemic, where predictions have them, lower the conviction.
    """
    known = {c: F.col(c) for c in ("set_size", "epistemic") if c in predictions.columns}
    rows = predictions.select("panel", "date", "p", conviction(F.col("p"), **known).alias("conviction"))
    rows = rows.select("panel", "date", "conviction", target_weight(F.col("p"), F.col("conviction")).alias("target_weight"))
    return held_weights(rows).withColumn("cash_weight", 1 - F.col("equity_weight"))


def backtest_paths(weights: DataFrame, returns: DataFrame, cost_bps: float = 15.0, risk_free: float = 0.065, delay: int = 1) -> DataFrame:
    """Daily path: returns gross and net of costs, wealth, drawdown. returns: (panel, date, equity_return, benchmark_return).

    A weight is known at its day's end, so it earns from `delay` days later on; days before a weight was known are left out.
    0 lets a weight earn the return that it was made from, as what this is modelled on does.
    """
    rows = weights.select("panel", "date", "equity_weight", "conviction").join(returns, ["panel", "date"])
    if delay:
        rows = rows.withColumns({c: F.lag(c, delay).over(IN_TIME()) for c in ("equity_weight", "conviction")}).filter("equity_weight is not null")
    w = F.col("equity_weight")
    rows = rows.withColumn("turnover", F.coalesce(F.abs(w - F.lag(w).over(IN_TIME())), F.lit(0.0))).withColumn("gross_return", w * F.col("equity_return") + (1 - w) * (risk_free / 252))
    rows = rows.withColumn("strategy_return", F.col("gross_return") - F.col("turnover") * (cost_bps / 10000))
    to_date = IN_TIME().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("strategy_wealth", F.product(1 + F.col("strategy_return")).over(to_date)).withColumn("benchmark_wealth", F.product(1 + F.col("benchmark_return")).over(to_date))
    return rows.withColumn("drawdown", F.col("strategy_wealth") / F.max("strategy_wealth").over(to_date) - 1)


def monthly_win_rate(paths: DataFrame, col: str = "strategy_return") -> DataFrame:
    """(panel, months, win_rate); months without a day between the first and the last count as not won."""
    per = paths.groupBy("panel", F.trunc("date", "month").alias("month")).agg(F.sum(col).alias("net"))
    return per.groupBy("panel").agg((F.months_between(F.max("month"), F.min("month")) + 1).cast("long").alias("months"), F.count_if(F.col("net") > 0).alias("won")).select("panel", "months", (F.col("won") / F.col("months")).alias("win_rate"))


def backtest_metrics(paths: DataFrame, side: str = "strategy", risk_free: float = 0.065) -> DataFrame:
    """One row a panel of returns, risk, ratios, drawdown, turnover and monthly wins; side: strategy or benchmark."""
    r, wealth = F.col(f"{side}_return"), f"{side}_wealth"
    to_date = IN_TIME().rowsBetween(Window.unboundedPreceding, 0)
    rows = paths.withColumn("_dd", F.col(wealth) / F.max(wealth).over(to_date) - 1)
    active = r - F.col("benchmark_return")
    m = rows.groupBy("panel").agg(
        F.count("*").alias("n"), F.max_by(wealth, "date").alias("final"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.stddev_pop(F.when(r < 0, r)).alias("down"), F.count_if(r < 0).alias("n_down"),
        F.min("_dd").alias("max_drawdown"), F.avg(active).alias("active"), F.stddev_pop(active).alias("te"), F.avg("turnover").alias("turn"), F.sum("turnover").alias("turn_sum"),
        F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurt"),
    )
    excess, year = F.col("mean") - risk_free / 252, math.sqrt(252)
    cagr = F.pow("final", 1 / F.greatest(F.col("n") / 252, F.lit(0.1))) - 1
    downside = F.when(F.col("n_down") > 0, F.col("down") * year).otherwise(1e-6)
    out = m.select(
        "panel", "n", (F.col("final") - 1).alias("total_return"), cagr.alias("cagr"), (F.col("std") * year).alias("annualized_volatility"), (excess / (F.col("std") + 1e-8) * year).alias("sharpe_ratio"),
        (excess * 252 / downside).alias("sortino_ratio"), "max_drawdown", F.when(F.col("max_drawdown") != 0, cagr / F.abs("max_drawdown")).alias("calmar_ratio"),
        (F.col("active") * 252 / F.greatest(F.col("te") * year, F.lit(1e-6))).alias("information_ratio"), (F.col("te") * year).alias("tracking_error"), (F.col("turn") * 252).alias("turnover_annual"),
        (F.col("turn_sum") * 0.0015).alias("total_transaction_costs"), "skew", (F.col("kurt") + 3).alias("kurtosis_pearson"), (excess / (F.col("std") + 1e-8)).alias("sharpe_daily"),
    )
    return out.join(monthly_win_rate(paths, f"{side}_return").select("panel", F.col("win_rate").alias("win_rate_monthly")), "panel")


def deflated_sharpe(metrics: DataFrame, trials: int = 10, variance: float = 0.15) -> DataFrame:
    """(panel, deflated_sharpe): probability that the Sharpe ratio beats the best of `trials` skill-less ones; one half under 30 days.

    The normal distribution function is Abramowitz and Stegun's 7.1.26, within 1.5e-7.
    """
    n = max(2, trials)
    best = (math.sqrt(2 * math.log(n)) + 0.5772156649 / math.sqrt(2 * math.log(n))) * math.sqrt(variance) / math.sqrt(252)
    sr = F.col("sharpe_daily")
    scale = F.sqrt(F.greatest(F.lit(1e-6), 1 - F.col("skew") * sr + (F.col("kurtosis_pearson") - 1) / 4 * sr * sr))
    return metrics.select("panel", F.when(F.col("n") < 30, 0.5).otherwise(normal_cdf((sr - best) * F.sqrt(F.col("n") - 1) / scale)).alias("deflated_sharpe"))


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, 1 - tail / 2).otherwise(tail / 2)


def conviction_tiers(paths: DataFrame, least: int = 10) -> DataFrame:
    """Performance by tier of conviction; tiers of no more than `least` days are left out."""
    tier = F.when(F.col("conviction") >= 0.75, "High").when(F.col("conviction") >= 0.5, "Medium").otherwise("Low")
    r, active = F.col("strategy_return"), F.col("strategy_return") - F.col("benchmark_return")
    rows = paths.withColumn("tier", tier).withColumn("days", F.count("*").over(Window.partitionBy("panel")))
    out = rows.groupBy("panel", "tier").agg(F.count("*").alias("trading_days"), (100 * F.count("*") / F.first("days")).alias("pct_of_time"), (F.avg(r) * 252).alias("annualized_return"), (F.stddev_pop(r) * math.sqrt(252)).alias("annualized_vol"), (F.avg(active) * math.sqrt(252) / (F.stddev_pop(active) + 1e-8)).alias("information_ratio"))
    return out.filter(F.col("trading_days") > least)


def crisis_episodes(paths: DataFrame, episodes: DataFrame) -> DataFrame:
    s, b = F.product(1 + F.col("strategy_return")) - 1, F.product(1 + F.col("benchmark_return")) - 1
    return in_episodes(paths, episodes).groupBy("panel", "episode").agg(F.count("*").alias("days"), s.alias("strategy_total_return"), b.alias("benchmark_total_return"), (s - b).alias("alpha_protection"), F.min("drawdown").alias("strategy_max_dd"))


def target_table(weights: DataFrame, value: float) -> DataFrame:
    """(panel, date, sleeve, weight, amount): what the newest weights make of a portfolio's value."""
    newest = weights.groupBy("panel").agg(F.max("date").alias("date"), F.max_by("equity_weight", "date").alias("w"))
    parts = F.array(F.struct(F.lit("equity").alias("sleeve"), F.col("w").alias("weight")), F.struct(F.lit("cash").alias("sleeve"), (1 - F.col("w")).alias("weight")))
    return newest.select("panel", "date", F.explode(parts).alias("x")).select("panel", "date", "x.*", (value * F.col("x.weight")).alias("amount"))


def position_risk(value: float, tail: DataFrame) -> DataFrame:
    """Amounts at risk of a position from a tail-risk row."""
    return tail.select(*((F.lit(value) * F.col(c)).alias(f"{c}_amount") for c in ("expected_return", "var_95", "cvar_95", "var_99", "cvar_99")))
