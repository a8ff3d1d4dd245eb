"""Deterministic baseline models and targets over returns and volatilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.simplex import normalized
from .technical import W


def ALL():
    return Window.partitionBy("panel")




def z_score(c: str) -> Column:
    return (F.col(c) - F.avg(c).over(ALL())) / (F.stddev_pop(c).over(ALL()) + 1e-8)


def soft_targets(features: DataFrame, ret: str = "nifty_ret_1d", vol: str = "nifty_vol_realized_21d") -> DataFrame:
    """(panel, date, p): smooth regime shares from the z-scores of return and volatility; rows with a null are left out."""
    z = features.filter(F.col(ret).isNotNull() & F.col(vol).isNotNull()).select("panel", "date", z_score(ret).alias("r"), z_score(vol).alias("v"))
    r, v = F.col("r"), F.col("v")
    scores = F.array(F.exp(1.2 * r - 0.8 * v), F.exp(0.8 * r + 0.8 * v), F.exp(-1.5 * r * r), F.exp(0.5 * r + 1.5 * v), F.exp(-1.5 * r + 1.0 * v))
    return z.select("panel", "date", scores.alias("s")).select("panel", "date", normalized(F.col("s")).alias("p"))


def bucket_targets(features: DataFrame, ret: str = "nifty_ret_1d") -> DataFrame:
    """(panel, date, y): fifth of the return's distribution, the highest is 0."""
    rows = features.filter(F.col(ret).isNotNull())
    cuts = rows.groupBy("panel").agg(F.percentile(ret, [0.2, 0.4, 0.6, 0.8]).alias("q"))
    return rows.join(cuts, "panel").select("panel", "date", (4 - F.size(F.filter("q", lambda c: c <= F.col(ret)))).alias("y"))


def bucket_model(buckets: DataFrame, hit: float = 0.8) -> DataFrame:
    """(panel, date, p): probability `hit` on the bucket, the rest shared."""
    rest = (1 - hit) / 4
    return buckets.select("panel", "date", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.when(k == F.col("y"), hit).otherwise(rest)).alias("p"))


def trend_model(features: DataFrame, trend: str = "nifty_dist_sma50", slope: float = 0.6) -> DataFrame:
    """(panel, date, p): softmax of equally spaced slopes times the trend's z-score."""
    z = features.filter(F.col(trend).isNotNull()).select("panel", "date", z_score(trend).alias("z"))
    scores = F.array(*(F.exp(slope * (2 - k) * F.col("z")) for k in range(5)))
    return z.select("panel", "date", scores.alias("s")).select("panel", "date", normalized(F.col("s")).alias("p"))


def forward_target(features: DataFrame, ret: str = "nifty_ret_1d", days: int = 5, train_before: str | None = None, legacy: bool = False) -> DataFrame:
    """(panel, date, fwd_ret, fwd_vol, y): regime of the next days' return and volatility.

    The last rows, whose days aren't complete, have nulls; with legacy they have return 0 and the mean volatility. The
    median volatility is that of rows before train_before (all by default). The strong recovery (3) is tested before the
    milder one, so it can occur; with legacy it is tested after it, and never does.
    """
    ahead = W().rowsBetween(1, days)
    rows = features.filter(F.col(ret).isNotNull()).select("panel", "date", F.count(ret).over(ahead).alias("n"), F.sum(ret).over(ahead).alias("s"), F.stddev_pop(ret).over(ahead).alias("v"))
    full = F.col("n") == days
    r, v = F.when(full, F.col("s")), F.when(full, F.col("v"))
    if legacy:
        r, v = F.coalesce(r, F.lit(0.0)), F.coalesce(v, F.avg(v).over(ALL()))
    rows = rows.select("panel", "date", r.alias("fwd_ret"), v.alias("fwd_vol"))
    known = rows.filter(F.col("date") < F.lit(train_before).cast("date")) if train_before else rows
    rows = rows.join(known.groupBy("panel").agg(F.percentile("fwd_vol", 0.5).alias("med")), "panel", "left")
    r, v, m = F.col("fwd_ret"), F.col("fwd_vol"), F.col("med")
    y = F.when(r.isNull(), F.lit(None).cast("int"))
    if not legacy:
        y = y.when((r > 0.02) & (v > 1.5 * m), 3)
    y = y.when((r > 0.01) & (v <= m), 0).when(r > 0.01, 1).when(F.abs(r) <= 0.01, 2).otherwise(4)
    return rows.select("panel", "date", "fwd_ret", "fwd_vol", y.alias("y"))
