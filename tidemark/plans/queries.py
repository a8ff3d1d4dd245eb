"""Named queries over the test tables, each with DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import simplex as S
from ..operators import audit, duration, ensemble, governance, network, pit, portfolio, quality, scoring, simulation, targets, technical
from ..operators.models import latent, neural
from ..sources import market, snapshots
from ..sources.durable import written
from ..streaming import online
from .oracle import BARS, BASE, EVAL, PANEL, SCORED, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name. Doubles are rounded to 6 digits and dates become strings, as in the SQL."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Unions of children that adaptive execution coalesces differently may otherwise be taken as dealt alike by key.
            spark.conf.set("spark.sql.unionOutputPartitioning", "false")
            df = fn(spark, sf_dir)
            kinds = dict(df.dtypes)
            return df.select(*(F.round(c, 6).alias(c) if kinds[c] == "double" else F.date_format(c, "yyyy-MM-dd").alias(c) if kinds[c] == "date" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint") else F.col(c) for c in df.columns))

        run.__name__ = fn.__name__
        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def rounded(columns: str, source: str) -> str:
    """SELECT list of 'name' (as it is), '#name' (double, rounded), '@name' (date as text) and '%name' (as a long)."""
    out = []
    for c in columns.split():
        name = c.lstrip("#@%")
        out.append({"#": f"round({name}, 6) AS {name}", "@": f"strftime({name}, '%Y-%m-%d') AS {name}", "%": f"CAST({name} AS BIGINT) AS {name}"}.get(c[0], name))
    return f"SELECT {', '.join(out)} FROM {source}"


def _features(spark, sf_dir, often: bool = False):
    """Features of the panel; where a plan reads them often, they (a row for each day) are written first."""
    features = technical.window_features(market.panel(spark, sf_dir))
    return written(features, "features") if often else features


def _models(features: DataFrame) -> DataFrame:
    parts = {"soft": targets.soft_targets(features), "bucket": targets.bucket_model(targets.bucket_targets(features)), "trend": targets.trend_model(features)}
    out = None
    for name, df in parts.items():
        df = df.select("panel", "date", F.lit(name).alias("model"), "p")
        out = df if out is None else out.unionByName(df)
    return out


def _truth(features: DataFrame) -> DataFrame:
    return targets.forward_target(features)


def _setup(spark, sf_dir):
    f = _features(spark, sf_dir, often=True)
    return _models(f), written(_truth(f), "truth")


def _five(df: DataFrame, keep: list[str], p: str = "p") -> DataFrame:
    return df.select(*keep, *(F.get(p, F.lit(k)).alias(f"p{k}") for k in range(5)))


WIDE5 = "max(p) FILTER (k = 0) AS p0, max(p) FILTER (k = 1) AS p1, max(p) FILTER (k = 2) AS p2, max(p) FILTER (k = 3) AS p3, max(p) FILTER (k = 4) AS p4"
P5 = "#p0 #p1 #p2 #p3 #p4"

# --- sources, quality, point in time ---------------------------------------------------------------------------------


@query(with_(BARS) + rounded("symbol @date #open #high #low #close #volume", "bars"))
def daily_bars(spark, sf_dir):
    return market.daily_bars(spark, sf_dir)


@query("""WITH b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS h, arg_min(value, {'a': ts, 'b': event_id}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {'a': ts, 'b': event_id}) AS close, count(*) AS volume FROM events GROUP BY 1, 2)
SELECT symbol, strftime(h, '%Y-%m-%d %H') AS hour, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM b""")
def hourly_bars(spark, sf_dir):
    return market.hourly_bars(market.table(spark, sf_dir, "events")).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


QUALITY = """x AS (SELECT *, lag(close) OVER w AS before, date > lag(date) OVER w AS rising, date - lag(date) OVER w > 5 AS gap, coalesce(close = lag(close) OVER w, FALSE)::INT AS same FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
y AS (SELECT *, sum(1 - same) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM x),
z AS (SELECT *, sum(same) OVER (PARTITION BY symbol, island ORDER BY date ROWS UNBOUNDED PRECEDING) AS streak FROM y),
q AS (SELECT symbol, count(*) AS n_rows, count(*) - count(DISTINCT date) AS n_duplicates, coalesce(bool_and(rising), TRUE) AS is_monotonic, count(*) FILTER (close IS NULL) AS n_missing,
  count(*) FILTER (gap) AS n_gaps, sum((close < 0)::INT + coalesce((close > 0 AND before > 0 AND abs(ln(close / before)) > 0.25)::INT, 0)) AS n_impossible, count(*) FILTER (streak >= 3) AS n_stale FROM z GROUP BY symbol)"""
REPORT = """report AS (SELECT *, 100.0 * n_missing / n_rows AS pct_missing, CASE WHEN n_impossible > 0 OR NOT is_monotonic THEN 'FAILED' WHEN 100.0 * n_missing / n_rows > 5 OR n_gaps > 20 THEN 'WARNING' ELSE 'PASSED' END AS status FROM q)"""


@query(with_(BARS, QUALITY, REPORT) + rounded("symbol n_rows n_duplicates is_monotonic n_missing n_gaps %n_impossible n_stale #pct_missing status", "report"))
def quality_report(spark, sf_dir):
    return quality.quality_report(market.daily_bars(spark, sf_dir))


@query(with_(BARS, QUALITY, REPORT, "c(series_id, source, units, available, reason) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}, '{e}')" for a, b, c, d, e in market.CATALOG) + ")")
       + "SELECT series_id, source, units, available, coalesce(n_rows, 0) AS n_rows, CASE WHEN NOT available THEN 'UNAVAILABLE' ELSE coalesce(status, 'FAILED') END AS status, CASE WHEN NOT available THEN reason ELSE '' END AS reason FROM c LEFT JOIN report ON series_id = symbol")
def series_availability(spark, sf_dir):
    return quality.availability_report(market.catalog(spark), quality.quality_report(market.daily_bars(spark, sf_dir)))


@query("""SELECT DISTINCT ON (l_suppkey, d) l_suppkey AS symbol, strftime(d, '%Y-%m-%d') AS date, round(l_extendedprice, 6) AS close FROM (SELECT *, CAST(l_shipdate AS DATE) AS d FROM lineitem) ORDER BY l_suppkey, d, l_orderkey, l_linenumber, l_extendedprice""")
def clean_bars(spark, sf_dir):
    raw = market.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("close"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("seq"))
    return quality.clean_bars(raw, "seq").select("symbol", "date", "close")


@query(with_(BARS) + "SELECT symbol, count(*) AS n, strftime(max(date), '%Y-%m-%d') AS last_date FROM bars WHERE date + 3 <= DATE '1998-06-30' AND close >= 0 AND high >= low GROUP BY symbol")
def pit_available(spark, sf_dir):
    bars = market.daily_bars(spark, sf_dir).filter(quality.valid_bar())
    return pit.available(bars, 3, F.lit("1998-06-30").cast("date")).groupBy("symbol").agg(F.count("*").alias("n"), F.max("date").alias("last_date"))


PROBES = "probes AS (SELECT symbol, CAST(d AS DATE) AS as_of FROM (SELECT DISTINCT symbol FROM bars), (SELECT unnest(generate_series(DATE '1994-12-15', DATE '2001-12-15', INTERVAL 37 DAY)) AS d))"


def _probes(spark, bars):
    dates = F.explode(F.expr("sequence(DATE '1994-12-15', DATE '2001-12-15', INTERVAL 37 DAY)"))
    return bars.select("symbol").distinct().select("symbol", dates.alias("as_of"))


@query(with_(BARS, PROBES) + "SELECT p.symbol, strftime(as_of, '%Y-%m-%d') AS as_of, strftime(b.date, '%Y-%m-%d') AS date, round(b.close, 6) AS close FROM probes p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.as_of >= b.date")
def asof_backward(spark, sf_dir):
    bars = market.daily_bars(spark, sf_dir)
    return pit.asof_backward(_probes(spark, bars), bars, "symbol", "as_of", "date", ["close"])


@query(with_(BARS, PROBES) + """SELECT symbol, strftime(as_of, '%Y-%m-%d') AS as_of, strftime(date, '%Y-%m-%d') AS date, round(close, 6) AS close, date > as_of AS is_future
FROM (SELECT p.symbol, as_of, date, close, row_number() OVER (PARTITION BY p.symbol, as_of ORDER BY abs(date - as_of), date) AS k FROM probes p JOIN bars b USING (symbol)) WHERE k = 1""")
def asof_nearest(spark, sf_dir):
    bars = market.daily_bars(spark, sf_dir)
    return pit.asof_nearest(_probes(spark, bars), bars, "symbol", "as_of", "date", ["close"])


@query(with_(BARS, PANEL) + "SELECT strftime(date, '%Y-%m-%d') AS date, bench, bank, it, midcap, broad, round(vix + 1e-9, 6) AS vix, round(fx + 1e-9, 6) AS fx FROM panel")
def carried_panel(spark, sf_dir):
    return market.panel(spark, sf_dir).select("date", "bench", "bank", "it", "midcap", "broad", (F.col("vix") + 1e-9).alias("vix"), (F.col("fx") + 1e-9).alias("fx"))


EPISODES = "episodes(episode, start_date, end_date) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for _, n, a, b in market.EPISODES) + ")"


@query(with_(BARS, EPISODES) + "SELECT symbol, episode, count(*) AS n, round(min(close), 6) AS low, round(max(close), 6) AS high FROM bars JOIN episodes ON date BETWEEN start_date AND end_date GROUP BY 1, 2")
def episode_slices(spark, sf_dir):
    rows = pit.in_episodes(market.daily_bars(spark, sf_dir), market.episodes(spark))
    return rows.groupBy("symbol", "episode").agg(F.count("*").alias("n"), F.min("close").alias("low"), F.max("close").alias("high"))


@query(with_(BARS, "x AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars)",
             "y AS (SELECT symbol, date, CASE WHEN k <= floor(n * 0.6 + 1e-9) THEN 'train' WHEN k <= floor(n * 0.8 + 1e-9) THEN 'calibration' ELSE 'test' END AS split, CASE WHEN date < DATE '1999-01-01' THEN 'train' WHEN date < DATE '2000-06-01' THEN 'calibration' ELSE 'test' END AS by_date FROM x)")
       + "SELECT symbol, split, by_date, count(*) AS n FROM y GROUP BY ALL")
def chronological_splits(spark, sf_dir):
    rows = pit.split_by_fraction(market.daily_bars(spark, sf_dir), "symbol", "date")
    rows = pit.split_by_date(rows.withColumnRenamed("split", "s"), "date", "1999-01-01", "2000-06-01").withColumnRenamed("split", "by_date").withColumnRenamed("s", "split")
    return rows.groupBy("symbol", "split", "by_date").agg(F.count("*").alias("n"))


@query(with_(BARS, "lines AS (SELECT symbol, date, concat_ws(',', strftime(date, '%Y-%m-%d'), printf('%.6f', open), printf('%.6f', high), printf('%.6f', low), printf('%.6f', close), printf('%.6f', volume)) AS line FROM bars)")
       + "SELECT symbol, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(h, '' ORDER BY date)) AS sha256 FROM (SELECT symbol, date, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM lines GROUP BY 1, 2) GROUP BY symbol")
def snapshot_hashes(spark, sf_dir):
    return snapshots.series_hashes(market.daily_bars(spark, sf_dir))


# --- features --------------------------------------------------------------------------------------------------------


@query(with_(*BASE) + rounded("@date " + " ".join("#" + c for c in technical.FEATURES if c not in ("nifty_vol_ewma_21d", "nifty_rsi_14")), "feat"))
def technical_features(spark, sf_dir):
    return _features(spark, sf_dir).drop("panel")


RECURSION = """s AS (SELECT *, row_number() OVER (ORDER BY date) AS k FROM (SELECT date, r1, bench - lag(bench) OVER (ORDER BY date) AS d FROM ret) WHERE r1 IS NOT NULL),
e AS (SELECT k, date, r1 * r1 AS v, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM s WHERE k = 1 UNION ALL
  SELECT s.k, s.date, 0.94 * e.v + (1 - 0.94) * s.r1 * s.r1, 13 * e.g / 14 + greatest(s.d, 0) / 14, 13 * e.l / 14 + greatest(-s.d, 0) / 14 FROM e JOIN s ON s.k = e.k + 1)"""


@query(with_(*BASE, RECURSION, recursive=True) + "SELECT strftime(p.date, '%Y-%m-%d') AS date, round(CASE WHEN v IS NOT NULL THEN sqrt(greatest(v, 1e-12) * 252) END, 6) AS nifty_vol_ewma_21d, round(CASE WHEN k >= 14 THEN 100 - 100 / (1 + g / (l + 1e-12)) END, 6) AS nifty_rsi_14 FROM panel p LEFT JOIN e USING (date)")
def recursive_features(spark, sf_dir):
    return technical.recursive_features(market.panel(spark, sf_dir)).drop("panel")


@query(with_(*BASE, "m AS (SELECT *, row_number() OVER (ORDER BY date) AS k FROM feat)")
       + "SELECT strftime(date, '%Y-%m-%d') AS date, round(coalesce(nifty_ret_1d, 0), 6) AS nifty_ret_1d, round(coalesce(nifty_dist_sma200, 0), 6) AS nifty_dist_sma200, round(coalesce(vix_level, 0), 6) AS vix_level FROM m WHERE k > 200")
def feature_matrix(spark, sf_dir):
    return technical.feature_matrix(technical.technical_features(market.panel(spark, sf_dir))).select("date", "nifty_ret_1d", "nifty_dist_sma200", "vix_level")


SERIES = ["bench", "bank", "it", "midcap", "broad"]


@query(with_(BARS, PANEL, "u AS (UNPIVOT (SELECT date, " + ", ".join(f"ln({c} / lag({c}) OVER (ORDER BY date)) AS {c}" for c in SERIES) + " FROM panel) ON bench, bank, it, midcap, broad INTO NAME symbol VALUE r)",
             "m0 AS (SELECT symbol, count(*) AS n, avg(r) AS mean_daily, stddev_samp(r) AS std_daily, avg(r) AS mu, stddev_pop(r) AS sp, kurtosis_pop(r) AS kurt FROM u GROUP BY symbol)",
             "m AS (SELECT m0.*, (SELECT avg(((r - mu) / sp) ^ 3) FROM u WHERE u.symbol = m0.symbol) AS skew FROM m0)",
             "j AS (SELECT *, n / 6.0 * (skew ^ 2 + kurt ^ 2 / 4) AS jarque_bera, mean_daily * 252 AS mean_annual, std_daily * sqrt(252) AS vol_annual FROM m)",
             "f AS (SELECT *, exp(-jarque_bera / 2) AS jb_p_value, exp(-jarque_bera / 2) > 0.05 AS is_gaussian FROM j)")
       + rounded("symbol n #mean_daily #std_daily #skew #kurt #jarque_bera #jb_p_value #mean_annual #vol_annual is_gaussian", "f"))
def return_moments(spark, sf_dir):
    return technical.return_moments(market.panel(spark, sf_dir), SERIES)


@query(with_(BARS, PANEL, "r AS (SELECT date, ln(bench / lag(bench) OVER (ORDER BY date)) AS a, ln(midcap / lag(midcap) OVER (ORDER BY date)) AS b FROM panel)")
       + "SELECT strftime(date, '%Y-%m-%d') AS date, round(CASE WHEN count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) OVER w = 63 THEN corr(a, b) OVER w END, 6) AS corr FROM r WINDOW w AS (ORDER BY date ROWS 62 PRECEDING)")
def rolling_correlation(spark, sf_dir):
    return technical.rolling_correlation(market.panel(spark, sf_dir), "bench", "midcap").drop("panel")


@query(with_(BARS, PANEL) + "SELECT strftime(date, '%Y-%m-%d') AS date, " + ", ".join(f"round(100 * {c} / first_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS {c}" for c in SERIES) + " FROM panel")
def rebased_prices(spark, sf_dir):
    return technical.rebased(market.panel(spark, sf_dir), SERIES).drop("panel")


PAIRS = [(a, b) for i, a in enumerate(network.NODES) for b in network.NODES[i + 1 :]]


@query(with_(BARS, PANEL, "r AS (SELECT date, " + ", ".join(f"coalesce(ln({c} / lag({c}) OVER (ORDER BY date)), 0) AS {c}" for c in network.NODES) + " FROM panel)",
             "a AS (SELECT date, count(*) OVER w AS n, " + ", ".join(f"corr({a}, {b}) OVER w AS {a}_{b}" for a, b in PAIRS) + " FROM r WINDOW w AS (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))",
             "g AS (" + " UNION ALL ".join(f"SELECT date, '{a}' AS i, '{b}' AS j, greatest(0.0, coalesce({a}_{b}, 0)) AS weight FROM a WHERE n = 60" for a, b in PAIRS) + ")") + rounded("@date i j #weight", "g"))
def graph_adjacency(spark, sf_dir):
    return network.adjacency(market.panel(spark, sf_dir)).drop("panel")


@query()
def topology_features(spark, sf_dir):
    return network.topology_features(market.panel(spark, sf_dir)).drop("panel")


@query()
def stationarity(spark, sf_dir):
    return audit.stationarity(technical.technical_features(market.panel(spark, sf_dir)), technical.FEATURES)


THREE = ["nifty_ret_1d", "vix_level", "nifty_dist_sma50"]


@query(with_(*BASE, "v AS (SELECT corr(nifty_ret_1d, vix_level) AS a, corr(nifty_ret_1d, nifty_dist_sma50) AS b, corr(vix_level, nifty_dist_sma50) AS c FROM feat WHERE nifty_ret_1d IS NOT NULL AND nifty_dist_sma50 IS NOT NULL AND vix_level IS NOT NULL)",
             "d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM v)",
             "o AS (SELECT 'nifty_ret_1d' AS feature, (1 - c * c) / det AS vif FROM d UNION ALL SELECT 'vix_level', (1 - b * b) / det FROM d UNION ALL SELECT 'nifty_dist_sma50', (1 - a * a) / det FROM d)")
       + "SELECT feature, round(vif, 4) AS vif, vif > 10 AS is_collinear FROM o")
def variance_inflation(spark, sf_dir):
    return audit.variance_inflation(_features(spark, sf_dir), THREE)


# --- baseline models, targets, scores --------------------------------------------------------------------------------


@query(with_(*EVAL, f"w AS (SELECT model, date, {WIDE5} FROM preds GROUP BY model, date)") + rounded(f"model @date {P5}", "w"))
def baseline_models(spark, sf_dir):
    return _five(_models(_features(spark, sf_dir, often=True)), ["model", "date"])


@query(with_(*EVAL) + rounded("@date #fwd_ret #fwd_vol %y", "fwd"))
def forward_target(spark, sf_dir):
    return _truth(_features(spark, sf_dir)).drop("panel")


@query(with_(*EVAL) + rounded("@date %y", "buckets"))
def bucket_targets(spark, sf_dir):
    return targets.bucket_targets(_features(spark, sf_dir)).drop("panel")


@query(with_(*EVAL, SCORED) + "SELECT CAST(k AS BIGINT) AS k, round(p, 6) AS p FROM climk")
def climatology(spark, sf_dir):
    return scoring.climatology(_truth(_features(spark, sf_dir))).select(F.posexplode("p").alias("k", "p"))


@query(with_(*EVAL, SCORED, "b AS (SELECT c.log_loss AS cl, c.brier_score AS cb, c.rps AS cr, p.log_loss AS pl, p.brier_score AS pb, p.rps AS pr FROM scored c, scored p WHERE c.model = 'climatology' AND p.model = 'persistence')")
       + """SELECT model, n, round(log_loss, 6) AS log_loss, round(brier_score, 6) AS brier_score, round(rps, 6) AS rps,
  round(1 - log_loss / greatest(cl, 1e-6), 6) AS skill_vs_climatology_log_loss, round(1 - brier_score / greatest(cb, 1e-6), 6) AS skill_vs_climatology_brier_score, round(1 - rps / greatest(cr, 1e-6), 6) AS skill_vs_climatology_rps,
  round(1 - log_loss / greatest(pl, 1e-6), 6) AS skill_vs_persistence_log_loss, round(1 - brier_score / greatest(pb, 1e-6), 6) AS skill_vs_persistence_brier_score, round(1 - rps / greatest(pr, 1e-6), 6) AS skill_vs_persistence_rps,
  log_loss < pl AS beats_persistence_log_loss, brier_score < pb AS beats_persistence_brier_score, rps < pr AS beats_persistence_rps FROM scored, b""")
def tournament(spark, sf_dir):
    return scoring.tournament(*_setup(spark, sf_dir)).drop("panel")


RELIABILITY = """tops AS (SELECT model, date, max(p) AS c, arg_max(k, p * 1e9 - k) AS top FROM preds GROUP BY model, date),
binned AS (SELECT model, CAST(greatest(1, ceil(c * 10)) AS INT) AS bin, c, (top = y)::INT AS a FROM tops JOIN truth USING (date)),
tab AS (SELECT model, bin, count(*) AS n, avg(c) AS confidence, avg(a) AS accuracy FROM binned GROUP BY 1, 2),
alltab AS (SELECT m.model, b.bin, coalesce(n, 0) AS n, confidence, accuracy, abs(confidence - accuracy) AS gap FROM (SELECT DISTINCT model FROM binned) m CROSS JOIN (SELECT unnest(range(1, 11)) AS bin) b LEFT JOIN tab t ON t.model = m.model AND t.bin = b.bin)"""


@query(with_(*EVAL, RELIABILITY) + rounded("model %bin n #confidence #accuracy #gap", "alltab"))
def reliability_table(spark, sf_dir):
    return scoring.reliability(*_setup(spark, sf_dir)).drop("panel")


@query(with_(*EVAL, RELIABILITY) + "SELECT model, round(sum(gap * n) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM alltab GROUP BY model")
def calibration_error(spark, sf_dir):
    return scoring.calibration_error(scoring.reliability(*_setup(spark, sf_dir))).drop("panel")


@query(with_(*EVAL, f"w AS (SELECT model, date, {WIDE5} FROM preds GROUP BY model, date)") + "SELECT model, round(avg(((p0 + 0.5 * p1 > p4) = (fwd_ret > 0))::INT), 6) AS directional_accuracy FROM w JOIN truth USING (date) GROUP BY model")
def directional_accuracy(spark, sf_dir):
    return scoring.directional_accuracy(*_setup(spark, sf_dir)).drop("panel")


APS = """t AS (SELECT model, date, y, max(p) FILTER (k = y) AS pt FROM preds JOIN truth USING (date) GROUP BY ALL),
aps AS (SELECT model, date, sum(p) FILTER (p >= pt) AS s FROM preds JOIN t USING (model, date) GROUP BY ALL)"""


@query(with_(*EVAL, APS, "c AS (SELECT model, count(*) AS n, list_sort(list(s)) AS a FROM aps GROUP BY model)", "l AS (SELECT *, least(1.0, ceil((n + 1) * (1 - 0.1)) / n) * (n - 1) AS pos FROM c)")
       + "SELECT model, n, round(a[floor(pos)::INT + 1] + (pos - floor(pos)) * (coalesce(a[floor(pos)::INT + 2], a[floor(pos)::INT + 1]) - a[floor(pos)::INT + 1]), 6) AS q_hat FROM l")
def conformal_quantile(spark, sf_dir):
    return scoring.conformal_quantile(*_setup(spark, sf_dir)).drop("panel")


SETS = """ranked AS (SELECT model, date, k, p, row_number() OVER w AS pos, coalesce(sum(p) OVER (PARTITION BY model, date ORDER BY p DESC, k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM preds WINDOW w AS (PARTITION BY model, date ORDER BY p DESC, k DESC)),
sets AS (SELECT model, date, string_agg(k::VARCHAR, ',' ORDER BY pos) AS members, list(k) AS ks, count(*) AS set_size FROM ranked WHERE before < 0.9 - 1e-12 OR pos = 1 GROUP BY model, date)"""


@query(with_(*EVAL, SETS) + rounded("model @date members set_size", "sets"))
def conformal_sets(spark, sf_dir):
    sets = scoring.conformal_sets(_models(_features(spark, sf_dir, often=True)), 0.1 + 1e-12)
    return sets.select("model", "date", F.array_join(F.col("set").cast("array<string>"), ",").alias("members"), "set_size")


@query(with_(*EVAL, SETS) + """SELECT model, round(avg(list_contains(ks, y)::INT), 6) AS empirical_coverage, round(avg(set_size), 6) AS average_set_size, round(avg((set_size = 1)::INT), 6) AS single_regime_rate, round(avg((set_size = 0)::INT), 6) AS empty_set_rate
FROM sets JOIN truth USING (date) GROUP BY model""")
def conformal_efficiency(spark, sf_dir):
    models, truth = _setup(spark, sf_dir)
    return scoring.conformal_efficiency(scoring.conformal_sets(models, 0.1 + 1e-12), truth).drop("panel")


@query(with_(*EVAL, SETS) + """SELECT model, round(avg(list_contains(ks, y)::INT), 6) AS realized_coverage, round(avg(list_contains(ks, y)::INT) - 0.9, 6) AS coverage_gap, avg(list_contains(ks, y)::INT) >= 0.8 AS is_healthy,
  CASE WHEN avg(list_contains(ks, y)::INT) >= 0.8 THEN 'NONE' ELSE 'RECALIBRATE_CONFORMAL_LAYER' END AS action_required FROM sets JOIN truth USING (date) GROUP BY model""")
def conformal_health(spark, sf_dir):
    models, truth = _setup(spark, sf_dir)
    return governance.conformal_health(scoring.conformal_efficiency(scoring.conformal_sets(models, 0.1 + 1e-12), truth)).drop("panel")


@query(with_(*EVAL, "t0 AS (SELECT date, y, max(p) FILTER (k = y) AS pt, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM soft JOIN truth USING (date) GROUP BY date, y)",
             "f AS (SELECT count(*) AS m, list_sort(list(1 - pt)) AS s FROM t0 WHERE i <= floor(n / 2))", "q AS (SELECT s[least(m, ceil((m + 1) * (1 - 0.1)))::INT] AS q FROM f)")
       + "SELECT strftime(date, '%Y-%m-%d') AS date, y, coalesce(string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (1 - p <= q), '') AS members FROM t0 JOIN soft USING (date), q WHERE i > floor(n / 2) GROUP BY date, y".replace(" y,", " CAST(y AS BIGINT) AS y,", 1))
def split_conformal(spark, sf_dir):
    models, truth = _setup(spark, sf_dir)
    sets = scoring.split_conformal(models.filter("model = 'soft'"), truth)
    return sets.select("date", "y", F.array_join(F.col("set").cast("array<string>"), ",").alias("members"))


ACI = """rk AS (SELECT date, y, k, p, row_number() OVER (PARTITION BY date ORDER BY p DESC, k DESC) AS pos, sum(p) OVER (PARTITION BY date ORDER BY p DESC, k DESC ROWS UNBOUNDED PRECEDING) AS cum FROM soft JOIN truth USING (date)),
days AS (SELECT date, y, list(k ORDER BY pos) AS ks, list(cum ORDER BY pos) AS cs, row_number() OVER (ORDER BY date) AS t FROM rk GROUP BY date, y),
al AS (SELECT t, date, CAST(0.1 AS DOUBLE) AS alpha_t, least(5, len(list_filter(cs, lambda c: c < least(0.99, greatest(0.1, 1 - 0.1)))) + 1) AS set_size, ks, y FROM days WHERE t = 1 UNION ALL
  SELECT t, date, a, least(5, len(list_filter(cs, lambda c: c < least(0.99, greatest(0.1, 1 - a)))) + 1), ks, y FROM (
    SELECT d.t, d.date, d.ks, d.cs, d.y, least(0.5, greatest(0.01, alpha_t + 0.015 * (0.1 - (NOT list_contains(al.ks[1:al.set_size], al.y))::INT))) AS a FROM al JOIN days d ON d.t = al.t + 1))"""


@query(with_(*EVAL, ACI, recursive=True) + "SELECT strftime(date, '%Y-%m-%d') AS date, round(alpha_t, 6) AS alpha_t, set_size, CAST((NOT list_contains(ks[1:set_size], y))::INT AS DOUBLE) AS error FROM al")
def adaptive_conformal(spark, sf_dir):
    models, truth = _setup(spark, sf_dir)
    return scoring.adaptive_conformal(models.filter("model = 'soft'"), truth).drop("panel", "model")


@query(with_(*EVAL, "e AS (SELECT date, k, exp(ln(least(greatest(p, 1e-12), 1.0)) / 1.5) AS e FROM soft)", "n AS (SELECT date, k, e / sum(e) OVER (PARTITION BY date) AS p FROM e)", f"w AS (SELECT date, {WIDE5} FROM n GROUP BY date)") + rounded(f"@date {P5}", "w"))
def temperature_scaled(spark, sf_dir):
    soft = _models(_features(spark, sf_dir, often=True)).filter("model = 'soft'")
    return _five(soft.select("date", S.tempered(F.col("p"), 1.5).alias("p")), ["date"])


#: Parameters of the baseline models: what their information criteria count (fixed values).
PARAMETERS = {"soft": 10, "bucket": 4, "trend": 1}
HALVES = """days AS (SELECT model, date, -ln(greatest(p, 1e-12)) AS ll, date >= DATE '1998-06-30' AS late FROM preds JOIN truth USING (date) WHERE k = y),
hv AS (SELECT model, late, count(*) AS n, avg(ll) AS m, var_samp(ll) AS v FROM days GROUP BY model, late),
rg AS (SELECT model, CAST(sum(n) AS BIGINT) AS n, sum(n * m) AS nll, sqrt((avg(v) * (min(n) - 1) / min(n) + var_samp(m)) / avg(v)) AS r_hat FROM hv GROUP BY model),
rb AS (SELECT model, r_hat, 2 * nll + CASE model """ + " ".join(f"WHEN '{m}' THEN {k}" for m, k in PARAMETERS.items()) + """ END * ln(n) AS bic FROM rg)"""


def _registry(models, truth):
    """(model, is_fitted, r_hat, divergences, bic): criteria of the models' daily log losses, and whether both halves of the panel agree as two chains would."""
    days = models.join(truth.filter("y is not null"), ["panel", "date"]).select("model", (F.col("date") >= F.lit("1998-06-30").cast("date")).alias("late"), S.log_loss(F.col("p"), F.col("y")).alias("ll"))
    half = days.groupBy("model", "late").agg(F.count("*").alias("n"), F.avg("ll").alias("m"), F.var_samp("ll").alias("v"))
    both = half.groupBy("model").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nll"), F.sqrt((F.avg("v") * (F.min("n") - 1) / F.min("n") + F.var_samp("m")) / F.avg("v")).alias("r_hat"))
    k = F.element_at(F.create_map(*(F.lit(x) for pair in PARAMETERS.items() for x in pair)), F.col("model"))
    return both.select("model", F.lit(True).alias("is_fitted"), "r_hat", F.lit(0).alias("divergences"), (2 * F.col("nll") + k * F.log("n")).alias("bic"))


@query(with_(*EVAL, HALVES, "a AS (SELECT model, bic FROM rb WHERE r_hat <= 1.05), b AS (SELECT *, exp(-0.5 * least(50, bic - min(bic) OVER ())) AS raw FROM a)") + "SELECT model, round(bic, 4) AS bic, round(raw / sum(raw) OVER (), 6) AS weight FROM b")
def bma_weights(spark, sf_dir):
    return ensemble.bma_weights(ensemble.admitted(_registry(*_setup(spark, sf_dir)))).withColumn("bic", F.round("bic", 4))


MIXED = "m(model, weight) AS (VALUES ('soft', 0.5), ('bucket', 0.3), ('trend', 0.2)), mixk AS (SELECT date, k, sum(weight * p) / sum(weight) AS p FROM preds JOIN m USING (model) GROUP BY date, k)"
WEIGHTS = [("soft", 0.5), ("bucket", 0.3), ("trend", 0.2)]


def _mixture(spark, models):
    return ensemble.mixture(models, spark.createDataFrame(WEIGHTS, "model string, weight double"))


@query(with_(*EVAL, MIXED, f"w AS (SELECT date, {WIDE5} FROM mixk GROUP BY date)") + rounded(f"@date {P5}", "w"))
def model_mixture(spark, sf_dir):
    return _five(_mixture(spark, _models(_features(spark, sf_dir, often=True))), ["date"])


@query(with_(*EVAL, "h AS (SELECT model, date, -sum(p * ln(greatest(p, 1e-12))) AS h FROM preds GROUP BY ALL)", "a AS (SELECT date, avg(h) AS aleatoric FROM h GROUP BY date)", "mk AS (SELECT date, k, avg(p) AS m FROM preds GROUP BY ALL)",
             "t AS (SELECT date, -sum(m * ln(greatest(m, 1e-12))) AS total_entropy FROM mk GROUP BY date)", "u AS (SELECT date, total_entropy, aleatoric, greatest(0.0, total_entropy - aleatoric) AS epistemic FROM t JOIN a USING (date))") + rounded("@date #total_entropy #aleatoric #epistemic", "u"))
def uncertainty(spark, sf_dir):
    return ensemble.uncertainty(_models(_features(spark, sf_dir, often=True))).drop("panel")


JS = """js AS (SELECT a.model AS model_a, b.model AS model_b, date, sqrt(greatest(0, sum((CASE WHEN a.p > 0 THEN a.p * ln(2 * a.p / (a.p + b.p)) ELSE 0 END) + (CASE WHEN b.p > 0 THEN b.p * ln(2 * b.p / (a.p + b.p)) ELSE 0 END)) / 2)) AS d
  FROM preds a JOIN preds b USING (date, k) WHERE a.model < b.model GROUP BY ALL), jm AS (SELECT model_a, model_b, avg(d) AS js FROM js GROUP BY ALL)"""


@query(with_(*EVAL, JS) + rounded("model_a model_b #js", "jm"))
def model_distance(spark, sf_dir):
    return ensemble.pairwise_distance(_models(_features(spark, sf_dir, often=True))).drop("panel")


@query(with_(*EVAL, JS) + "SELECT round(avg(js), 6) AS mean_js, round(max(js), 6) AS max_js, round(greatest(0, 1 - avg(js)), 6) AS concordance FROM jm")
def model_disagreement(spark, sf_dir):
    return ensemble.disagreement(_models(_features(spark, sf_dir, often=True))).drop("panel")


@query(with_(*EVAL, "x AS (SELECT date, k, (t.p + 1e-12) / sum(t.p + 1e-12) OVER (PARTITION BY date) AS a, (s.p + 1e-12) / sum(s.p + 1e-12) OVER (PARTITION BY date) AS b FROM trend t JOIN soft s USING (date, k))",
             "r AS (SELECT date, sum(a * ln(a / b)) AS kl FROM x GROUP BY date)", "v AS (SELECT date, 0.5 * sum(abs(t.p - s.p)) AS tvd FROM trend t JOIN soft s USING (date, k) GROUP BY date)")
       + "SELECT strftime(date, '%Y-%m-%d') AS date, round(kl, 6) AS kl, round(tvd, 6) AS tvd, kl <= 0.25 AS is_consistent FROM r JOIN v USING (date)")
def two_speed_reconcile(spark, sf_dir):
    m = _models(_features(spark, sf_dir, often=True))
    return ensemble.reconcile(m.filter("model = 'trend'"), m.filter("model = 'soft'")).drop("panel")


# --- durations, governance -------------------------------------------------------------------------------------------

SPELLS = """sn AS (SELECT date, y, coalesce((y <> lag(y) OVER (ORDER BY date))::INT, 1) AS fresh FROM truth), sr AS (SELECT *, sum(fresh) OVER (ORDER BY date) AS run FROM sn),
spells AS (SELECT y AS state, min(date) AS start_date, max(date) AS end_date, count(*) AS days FROM sr GROUP BY run, y)"""


@query(with_(*EVAL, SPELLS) + rounded("%state @start_date @end_date days", "spells"))
def regime_spells(spark, sf_dir):
    return duration.spells(_truth(_features(spark, sf_dir))).drop("panel")


@query(with_(*EVAL, "tm AS (SELECT y AS i, lead(y) OVER (ORDER BY date) AS j FROM truth)", "tc AS (SELECT i, j, count(*) AS n FROM tm WHERE j IS NOT NULL GROUP BY 1, 2)") + "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, n, round(n / sum(n) OVER (PARTITION BY i), 6) AS share FROM tc")
def transition_matrix(spark, sf_dir):
    return duration.transition_matrix(_truth(_features(spark, sf_dir))).drop("panel")


@query(with_(*EVAL, "tm AS (SELECT y AS i, lead(y, 21) OVER (ORDER BY date) AS j FROM truth)", "tc AS (SELECT i, j, count(*) AS n FROM tm WHERE j IS NOT NULL GROUP BY 1, 2)") + "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, n, round(n / sum(n) OVER (PARTITION BY i), 6) AS share FROM tc")
def transition_matrix_21d(spark, sf_dir):
    return duration.transition_matrix(_truth(_features(spark, sf_dir)), 21).drop("panel")


DRIFTED = ["nifty_ret_1d", "vix_level", "nifty_dist_sma50", "usdinr_ret_21d"]


@query(with_(*BASE, "u AS (UNPIVOT (SELECT date, nifty_ret_1d, vix_level, nifty_dist_sma50, usdinr_ret_21d FROM feat) ON nifty_ret_1d, vix_level, nifty_dist_sma50, usdinr_ret_21d INTO NAME feature VALUE value)",
             "s AS (SELECT feature, value, date >= DATE '1999-01-01' AS late FROM u)", "e AS (SELECT feature, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM s WHERE NOT late GROUP BY feature)",
             "b AS (SELECT feature, late, len(list_filter(edges, lambda x: x <= value)) AS bin FROM s JOIN e USING (feature))", "k AS (SELECT feature, unnest(range(0, len(edges) + 1)) AS bin, len(edges) + 1 AS nb FROM e)",
             "t AS (SELECT feature, count(*) FILTER (NOT late) AS nr, count(*) FILTER (late) AS nc FROM b GROUP BY feature)",
             "h AS (SELECT k.feature, k.bin, nb, nr, nc, count(*) FILTER (late = FALSE) AS r, count(*) FILTER (late) AS c FROM k JOIN t USING (feature) LEFT JOIN b ON b.feature = k.feature AND b.bin = k.bin GROUP BY ALL)",
             "p AS (SELECT feature, sum(((r + 1e-4) / (nr + 1e-4 * nb) - (c + 1e-4) / (nc + 1e-4 * nb)) * ln(((r + 1e-4) / (nr + 1e-4 * nb)) / ((c + 1e-4) / (nc + 1e-4 * nb)))) AS psi FROM h GROUP BY feature)")
       + "SELECT feature, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'STABLE' WHEN psi < 0.25 THEN 'MODERATE_SHIFT' ELSE 'SIGNIFICANT_DRIFT' END AS status, psi >= 0.25 AS alarm_triggered FROM p")
def psi_report(spark, sf_dir):
    f = _features(spark, sf_dir)
    return audit.psi_report(f.filter("date < '1999-01-01'"), f.filter("date >= '1999-01-01'"), DRIFTED)


CARDS = """ly AS (SELECT model, year(date) AS version, avg(-ln(greatest(p, 1e-12))) AS loss, avg(-ln(greatest(p, 1e-12))) FILTER (month(date) <= 6) AS early FROM preds JOIN truth USING (date) WHERE k = y GROUP BY 1, 2),
cards AS (SELECT model, CAST(version AS VARCHAR) AS version, row_number() OVER (PARTITION BY version ORDER BY round(loss, 9), model) AS place FROM ly)"""


@query(with_(*EVAL, CARDS) + """SELECT model, version, CASE WHEN model = 'trend' AND version = '2000' THEN 'CHAMPION' WHEN place = 1 THEN 'CHALLENGER' WHEN place = 2 THEN 'VALIDATED' ELSE 'EXPERIMENTAL' END AS state FROM cards""")
def champion_registry(spark, sf_dir):
    """Cards of each model and year by its log loss, one at mid-year and one at its end; then one model is promoted."""
    models, truth = _setup(spark, sf_dir)
    days = models.join(truth.filter("y is not null"), ["panel", "date"]).select("model", F.year("date").alias("v"), F.month("date").alias("month"), S.log_loss(F.col("p"), F.col("y")).alias("ll"))
    cards = None
    for until, stamp in ((6, "06-30"), (12, "12-31")):
        loss = days.filter(F.col("month") <= until).groupBy("model", "v").agg(F.round(F.avg("ll"), 9).alias("loss"))
        place = F.row_number().over(Window.partitionBy("v").orderBy("loss", "model"))
        part = loss.select("model", F.col("v").cast("string").alias("version"), F.when(place == 1, "CHAMPION").when(place == 2, "VALIDATED").otherwise("EXPERIMENTAL").alias("state"), F.concat("v", F.lit(f"-{stamp}")).cast("timestamp").alias("updated_at"))
        cards = part if cards is None else cards.unionByName(part)
    return governance.promote(cards, "trend", "2000", "2024-02-01 00:00:00", "better log loss").select("model", "version", "state")


ASKED = "asked AS (SELECT CAST(unnest(generate_series(DATE '1994-12-25', DATE '2001-12-15', INTERVAL 61 DAY)) AS DATE) AS as_of)"


def _asked(spark):
    return spark.sql("SELECT 'main' AS panel, explode(sequence(DATE '1994-12-25', DATE '2001-12-15', INTERVAL 61 DAY)) AS as_of")


STATE = """ent AS (SELECT date, max(p) AS probability, arg_max(k, p * 1e9 - k) AS top, -sum(p * ln(greatest(p, 1e-12))) AS entropy FROM soft GROUP BY date),
names AS (SELECT ['Risk-On', 'Late-Cycle', 'Transitional', 'Post-Shock', 'Risk-Off'] AS n)"""


@query(with_(*EVAL, SETS, STATE, ASKED) + """SELECT strftime(as_of, '%Y-%m-%d') AS as_of, strftime(e.date, '%Y-%m-%d') AS date, n[top + 1] AS regime, round(probability, 6) AS probability, round(entropy, 6) AS entropy, set_size, FALSE AS is_future, CASE WHEN e.date IS NULL THEN 'UNAVAILABLE' ELSE 'VERIFIED' END AS status
FROM asked a ASOF LEFT JOIN ent e ON a.as_of >= e.date LEFT JOIN (SELECT date AS sd, set_size FROM sets WHERE model = 'soft') ON sd = e.date, names""")
def audit_replay(spark, sf_dir):
    soft = _models(_features(spark, sf_dir, often=True)).filter("model = 'soft'")
    return governance.regime_state(soft, _asked(spark)).drop("panel")


@query(with_(*EVAL, SETS, STATE, ASKED, "near AS (SELECT as_of, e.*, row_number() OVER (PARTITION BY as_of ORDER BY abs(e.date - as_of), e.date) AS i FROM asked, ent e)")
       + "SELECT strftime(as_of, '%Y-%m-%d') AS as_of, strftime(near.date, '%Y-%m-%d') AS date, n[top + 1] AS regime, round(probability, 6) AS probability, round(entropy, 6) AS entropy, set_size, near.date > as_of AS is_future, 'VERIFIED' AS status FROM near JOIN sets s ON s.date = near.date AND s.model = 'soft', names WHERE i = 1")
def regime_state_nearest(spark, sf_dir):
    soft = _models(_features(spark, sf_dir, often=True)).filter("model = 'soft'")
    return governance.regime_state(soft, _asked(spark), nearest=True).drop("panel")


@query(with_(*EVAL, STATE, MIXED) + """SELECT strftime(date, '%Y-%m-%d') AS date, round(probability, 6) AS probability, CASE WHEN entropy < 0.0005 THEN 'near-certain' WHEN entropy < 0.05 THEN 'very low' WHEN entropy < 0.2 THEN 'low' WHEN entropy < 0.6 THEN 'moderate' ELSE 'high' END AS band FROM ent""")
def entropy_bands(spark, sf_dir):
    soft = _models(_features(spark, sf_dir, often=True)).filter("model = 'soft'")
    return soft.select("date", F.array_max("p").alias("probability"), governance.entropy_band(S.entropy(F.col("p"))).alias("band"))


LINEAR = {"nifty_ret_1d": 0.5, "vix_level": -0.3, "nifty_dist_sma50": 0.8, "breadth_midcap_ret_21d": 0.2}


@query(with_(*BASE, "b AS (SELECT " + ", ".join(f"{c} * ({w}) AS {c}" for c, w in LINEAR.items()) + ", date FROM feat WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in LINEAR) + ")",
             "u AS (UNPIVOT b ON " + ", ".join(LINEAR) + " INTO NAME feature VALUE d)") + "SELECT strftime(date, '%Y-%m-%d') AS date, feature, round(coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY date), 0), 0), 6) AS attribution FROM u")
def feature_attribution(spark, sf_dir):
    rows = _features(spark, sf_dir).na.drop(subset=list(LINEAR))
    score = lambda x: sum((x[c] * w for c, w in LINEAR.items()), F.lit(0.0))
    return governance.ablation(rows, score, list(LINEAR), dict.fromkeys(LINEAR, 0.0)).drop("panel")


# --- portfolio -------------------------------------------------------------------------------------------------------

ALLOC = """eqw(k, w) AS (VALUES (0, 0.95), (1, 0.70), (2, 0.50), (3, 0.80), (4, 0.25)),
tgt AS (SELECT date, row_number() OVER (ORDER BY date) AS t, max(p) AS conviction, least(1.0, greatest(0.2, 0.6 + max(p) * (sum(p * w) - 0.6))) AS target_weight FROM soft JOIN eqw USING (k) GROUP BY date),
held AS (SELECT t, date, conviction, target_weight, target_weight AS equity_weight FROM tgt WHERE t = 1 UNION ALL
  SELECT g.t, g.date, g.conviction, g.target_weight, CASE WHEN abs(g.target_weight - h.equity_weight) < 0.05 THEN h.equity_weight ELSE h.equity_weight + least(0.15, greatest(-0.15, g.target_weight - h.equity_weight)) END FROM held h JOIN tgt g ON g.t = h.t + 1)"""
#: Returns are shrunk, as the test tables' prices jump by tens of percent a day.
PATHS = """rr AS (SELECT date, exp(0.02 * nifty_ret_1d) - 1 AS er, exp(0.02 * nifty_ret_1d) - 1 AS br FROM feat),
px AS (SELECT date, lag(conviction) OVER (ORDER BY date) AS conviction, lag(equity_weight) OVER (ORDER BY date) AS equity_weight, er, br FROM held JOIN rr USING (date)),
p0 AS (SELECT date, conviction, equity_weight, er, br, coalesce(abs(equity_weight - lag(equity_weight) OVER (ORDER BY date)), 0) AS turnover FROM px WHERE equity_weight IS NOT NULL),
p1 AS (SELECT *, equity_weight * er + (1 - equity_weight) * (0.065 / 252) - turnover * 0.0015 AS strategy_return FROM p0),
p2 AS (SELECT *, exp(sum(ln(1 + strategy_return)) OVER (ORDER BY date)) AS strategy_wealth, exp(sum(ln(1 + br)) OVER (ORDER BY date)) AS benchmark_wealth FROM p1),
paths AS (SELECT *, strategy_wealth / max(strategy_wealth) OVER (ORDER BY date) - 1 AS drawdown, benchmark_wealth / max(benchmark_wealth) OVER (ORDER BY date) - 1 AS bdrawdown, br AS benchmark_return FROM p2)"""


def _paths(spark, sf_dir):
    f = _features(spark, sf_dir, often=True)
    weights = portfolio.allocate(_models(f).filter("model = 'soft'"))
    r = F.expm1(0.02 * F.col("nifty_ret_1d"))
    return portfolio.backtest_paths(weights, f.select("panel", "date", r.alias("equity_return"), r.alias("benchmark_return")))


@query(with_(*EVAL, ALLOC, recursive=True) + "SELECT strftime(date, '%Y-%m-%d') AS date, round(conviction, 6) AS conviction, round(target_weight, 6) AS target_weight, round(equity_weight, 6) AS equity_weight, round(1 - equity_weight, 6) AS cash_weight FROM held")
def allocation(spark, sf_dir):
    return portfolio.allocate(_models(_features(spark, sf_dir, often=True)).filter("model = 'soft'")).drop("panel")


@query(with_(*EVAL, ALLOC, PATHS, recursive=True) + rounded("@date #turnover #strategy_return #strategy_wealth #benchmark_wealth #drawdown", "paths"))
def backtest_paths(spark, sf_dir):
    return _paths(spark, sf_dir).select("date", "turnover", "strategy_return", "strategy_wealth", "benchmark_wealth", "drawdown")


METRICS = """months AS (SELECT date_trunc('month', date) AS mo, sum(strategy_return) AS net FROM paths GROUP BY 1), win AS (SELECT count(*) FILTER (net > 0) / (date_diff('month', min(mo), max(mo)) + 1) AS win_rate_monthly FROM months),
mm AS (SELECT count(*) AS n, arg_max(strategy_wealth, date) AS final, avg(strategy_return) AS mu, stddev_pop(strategy_return) AS sd, stddev_pop(CASE WHEN strategy_return < 0 THEN strategy_return END) AS dn, min(drawdown) AS max_drawdown,
  avg(strategy_return - br) AS act, stddev_pop(strategy_return - br) AS te, avg(turnover) AS tu, kurtosis_pop(strategy_return) AS kp FROM paths),
met AS (SELECT n, final - 1 AS total_return, final ^ (1 / greatest(n / 252, 0.1)) - 1 AS cagr, sd * sqrt(252) AS annualized_volatility, (mu - 0.065 / 252) / (sd + 1e-8) * sqrt(252) AS sharpe_ratio, (mu - 0.065 / 252) * 252 / (dn * sqrt(252)) AS sortino_ratio, max_drawdown,
  act * 252 / greatest(te * sqrt(252), 1e-6) AS information_ratio, te * sqrt(252) AS tracking_error, tu * 252 AS turnover_annual, kp + 3 AS kurtosis_pearson, win_rate_monthly FROM mm, win)"""
METRIC_COLUMNS = "n total_return cagr annualized_volatility sharpe_ratio sortino_ratio max_drawdown information_ratio tracking_error turnover_annual kurtosis_pearson win_rate_monthly".split()


@query(with_(*EVAL, ALLOC, PATHS, METRICS, recursive=True) + rounded(" ".join("n" if c == "n" else "#" + c for c in METRIC_COLUMNS), "met"))
def backtest_metrics(spark, sf_dir):
    return portfolio.backtest_metrics(_paths(spark, sf_dir)).select(*METRIC_COLUMNS)


@query(with_(*EVAL, ALLOC, PATHS, "tiers AS (SELECT CASE WHEN conviction >= 0.75 THEN 'High' WHEN conviction >= 0.5 THEN 'Medium' ELSE 'Low' END AS tier, * FROM paths)",
             "tt AS (SELECT tier, count(*) AS trading_days, 100 * count(*) / (SELECT count(*) FROM paths) AS pct_of_time, avg(strategy_return) * 252 AS annualized_return, stddev_pop(strategy_return) * sqrt(252) AS annualized_vol, avg(strategy_return - br) * sqrt(252) / (stddev_pop(strategy_return - br) + 1e-8) AS information_ratio FROM tiers GROUP BY tier HAVING count(*) > 10)", recursive=True)
       + rounded("tier trading_days #pct_of_time #annualized_return #annualized_vol #information_ratio", "tt"))
def conviction_tiers(spark, sf_dir):
    return portfolio.conviction_tiers(_paths(spark, sf_dir)).drop("panel")


@query(with_(*EVAL, ALLOC, PATHS, EPISODES, "ce AS (SELECT episode, count(*) AS days, exp(sum(ln(1 + strategy_return))) - 1 AS s, exp(sum(ln(1 + br))) - 1 AS b, min(drawdown) AS strategy_max_dd FROM paths JOIN episodes ON date BETWEEN start_date AND end_date GROUP BY episode)", recursive=True)
       + "SELECT episode, days, round(s, 6) AS strategy_total_return, round(b, 6) AS benchmark_total_return, round(s - b, 6) AS alpha_protection, round(strategy_max_dd, 6) AS strategy_max_dd FROM ce")
def crisis_episodes(spark, sf_dir):
    return portfolio.crisis_episodes(_paths(spark, sf_dir), market.episodes(spark)).drop("panel")


# --- simulation and scenarios ----------------------------------------------------------------------------------------

START = [0.3, 0.25, 0.2, 0.1, 0.15]


def _start(spark, sf_dir):
    """The soft model's probabilities on the panel's last day: one row."""
    return written(simulation.last_known(_models(_features(spark, sf_dir, often=True)).filter("model = 'soft'")), "start")


def _cases(values: list[float], k: str) -> str:
    return f"[{', '.join(map(str, values))}][{k} + 1]"


U = "((('0x' || substr(sha256('42|' || path || '|' || day), {at}, 8))::BIGINT + 0.5) / 4294967296.0)"
CUM = [[round(sum(row[: i + 1]), 12) for i in range(5)] for row in simulation.TRANSITION]
LAST = "start_p AS (SELECT k, p, sum(p) OVER (ORDER BY k) AS c FROM soft WHERE date = (SELECT max(date) FROM soft)), start_c AS (SELECT list(c ORDER BY k) AS cum FROM start_p)"
MC = f"""{LAST}, grid AS (SELECT path, day, {U.format(at=1)} AS u0, {U.format(at=9)} AS u1, {U.format(at=17)} AS u2, {U.format(at=25)} AS u3, {U.format(at=33)} AS u4 FROM (SELECT unnest(range(0, 10000)) AS path), (SELECT unnest(range(0, 21)) AS day)),
st AS (SELECT path, day, least(4, len(list_filter(cum, lambda c: c < u0))) AS state FROM grid, start_c WHERE day = 0 UNION ALL
  SELECT g.path, g.day, least(4, len(list_filter({CUM}[st.state + 1], lambda c: c < g.u0))) FROM st JOIN grid g ON g.path = st.path AND g.day = st.day + 1),
mc AS (SELECT path, day, state, {_cases(simulation.MEANS, 'state')} / 252 + {_cases(simulation.VOLS, 'state')} / sqrt(252) * (sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) / sqrt((-2 * ln(u3) - 2 * ln(u4) + (sqrt(-2 * ln(u1)) * sin(2 * pi() * u2)) ^ 2) / 5) / sqrt(5 / 3.0)) AS ret FROM st JOIN grid USING (path, day)),
tot AS (SELECT path, exp(sum(ln(1 + ret))) - 1 AS r FROM mc GROUP BY path), vq AS (SELECT quantile_cont(r, 0.05) AS a, quantile_cont(r, 0.01) AS b FROM tot)"""


@query(with_(*EVAL, MC, recursive=True) + "SELECT path, day, CAST(state AS BIGINT) AS state, round(ret, 6) + 0.0 AS ret FROM mc")
def regime_paths(spark, sf_dir):
    return simulation.simulate(spark, _start(spark, sf_dir))


@query(with_(*EVAL, MC, recursive=True) + "SELECT round(any_value(a), 6) AS var_95, round(avg(r) FILTER (r <= a), 6) AS cvar_95, round(any_value(b), 6) AS var_99, round(avg(r) FILTER (r <= b), 6) AS cvar_99, round(avg(r), 6) AS expected_return, round(stddev_pop(r), 6) AS path_volatility FROM tot, vq")
def tail_risk(spark, sf_dir):
    return simulation.tail_risk(simulation.simulate(spark, _start(spark, sf_dir)))


@query(with_(*EVAL, MC, "wl AS (SELECT path, day, exp(sum(ln(1 + ret)) OVER (PARTITION BY path ORDER BY day)) AS x FROM mc)", recursive=True)
       + "SELECT day, " + ", ".join(f"round(quantile_cont(x, {q}), 6) AS q{round(100 * q):02d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM wl GROUP BY day")
def fan_chart(spark, sf_dir):
    return simulation.fan_chart(simulation.simulate(spark, _start(spark, sf_dir)))


@query(with_(*BASE, "sc(scenario, r, v, b, u) AS (VALUES " + ", ".join(f"('{n}', {s['nifty_ret_1d']}, {s['vix_level']}, {s['breadth_midcap_ret_21d']}, {s['usdinr_ret_21d']})" for n, s in simulation.SHOCKS.items()) + ")")
       + "SELECT strftime(date, '%Y-%m-%d') AS date, scenario, round(nifty_ret_1d + r, 6) AS nifty_ret_1d, round(greatest(8.0, vix_level + v), 6) AS vix_level, round(breadth_midcap_ret_21d + b, 6) AS breadth_midcap_ret_21d, round(usdinr_ret_21d + u, 6) AS usdinr_ret_21d FROM feat, sc")
def shock_injection(spark, sf_dir):
    f = _features(spark, sf_dir)
    out = None
    for name, shocks in simulation.SHOCKS.items():
        part = simulation.inject_shock(f, shocks).select("date", F.lit(name).alias("scenario"), *shocks)
        out = part if out is None else out.unionByName(part)
    return out


#: Forms of stress descriptions; {} is a whole number n from 1 to 3. Beside them, read by hand from the rules: feature and shock of each clause in SQL.
SCENARIOS = [
    ("Increase India VIX by {}0% and drop NIFTY {}%", [("vix_level", "1.5 * n"), ("nifty_ret_1d", "-0.01 * n")]), ("USD/INR +{}%", [("usdinr_ret_21d", "0.01 * n")]), ("Rupee appreciation", [("usdinr_ret_21d", "-0.03")]),
    ("Spike VIX to {}5, midcap breadth falls {}50 bps; sma +{}%", [("vix_level", "10 * n - 10"), ("breadth_midcap_ret_21d", "-0.01 * n - 0.005"), ("nifty_dist_sma50", "0.01 * n")]), ("Rupee weakens {}%", [("usdinr_ret_21d", "0.01 * n")]),
    ("realized vol up {} points", [("nifty_vol_ewma_21d", "0.01 * n")]), ("something unclear", []), ("nifty crash", [("nifty_ret_1d", "-0.03")]), ("INR -{}%", [("usdinr_ret_21d", "0.01 * n")]),
    ("vix falls {} pts and dollar rises {} percent", [("vix_level", "-1.0 * n"), ("usdinr_ret_21d", "0.01 * n")]),
]
PARSED = "said AS (SELECT concat_ws('-', conv_id, turn) AS id, CAST((conv_id + turn) % 10 AS BIGINT) AS form, 1 + coalesce(length(text), 0) % 3 AS n FROM conversations),\npr AS (" + " UNION ALL ".join(
    f"SELECT id, form, n, '{feature}' AS feature, round(CAST({shock} AS DOUBLE), 6) AS shock FROM said WHERE form = {k}" for k, (_, clauses) in enumerate(SCENARIOS) for feature, shock in clauses) + ")"


def _scenarios(spark, sf_dir):
    """(id, text): what each turn of `conversations` asks to be stressed, a form by its numbers with an amount by its length."""
    forms = F.array(*(F.lit(form) for form, _ in SCENARIOS))
    amount = (1 + F.coalesce(F.length("text"), F.lit(0)) % 3).cast("string")
    text = F.replace(F.get(forms, ((F.col("conv_id") + F.col("turn")) % 10).cast("int")), F.lit("{}"), amount)
    return market.table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), text.alias("text"))


@query(f"WITH {PARSED} SELECT id, feature, shock FROM pr")
def scenario_parse(spark, sf_dir):
    return simulation.parse_scenarios(_scenarios(spark, sf_dir)).filter("feature is not null").select("id", "feature", "shock")


@query("SELECT conv_id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS chars, substr(sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY turn, sha256(coalesce(text, '')))), 1, 16) AS response_hash FROM conversations GROUP BY conv_id")
def interaction_log(spark, sf_dir):
    """Of a conversation, a row holds the hashes of its turns, not their texts."""
    rows = market.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    hashes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "h"))), lambda x: x["h"]), "")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("chars"), F.substring(F.sha2(hashes.cast("binary"), 256), 1, 16).alias("response_hash"))


# --- models ----------------------------------------------------------------------------------------------------------

INPUTS = ["nifty_ret_1d", "nifty_vol_realized_21d", "nifty_dist_sma50", "vix_level", "breadth_midcap_ret_21d"]


@query()
def hmm_filter(spark, sf_dir):
    return _five(latent.posterior(_features(spark, sf_dir), INPUTS, "hmm"), ["date"])


@query()
def rsvar_filter(spark, sf_dir):
    return _five(latent.posterior(_features(spark, sf_dir), INPUTS[:3], "rsvar"), ["date"])


@query()
def mixture_posterior(spark, sf_dir):
    return _five(latent.posterior(_features(spark, sf_dir), INPUTS[:1], "mixture"), ["date"])


@query()
def model_diagnostics(spark, sf_dir):
    return latent.diagnostics(_features(spark, sf_dir), INPUTS[:3]).drop("panel")


def _draws(f):
    return written(latent.gibbs_draws(f, INPUTS[:2]), "draws")


@query()
def gibbs_convergence(spark, sf_dir):
    return latent.convergence(_draws(_features(spark, sf_dir))).drop("panel")


@query()
def gibbs_posterior(spark, sf_dir):
    f = _features(spark, sf_dir, often=True)
    out = latent.gibbs_posterior(f, INPUTS[:2], _draws(f))
    return _five(out, ["date", "total_entropy", "aleatoric", "epistemic"])


def _network(spark, sf_dir, kind):
    f = _features(spark, sf_dir, often=True)
    out = neural.network_posterior(f.join(targets.soft_targets(f), ["panel", "date"]), INPUTS, kind)
    return _five(out, ["date", "total_entropy", "aleatoric", "epistemic"])


@query()
def deep_ensemble(spark, sf_dir):
    return _network(spark, sf_dir, "deep")


@query()
def dropout_network(spark, sf_dir):
    return _network(spark, sf_dir, "dropout")


@query()
def variational_network(spark, sf_dir):
    return _network(spark, sf_dir, "variational")


def _embedded(spark, sf_dir, **how):
    f = _features(spark, sf_dir, often=True)
    return written(neural.embeddings(f, "nifty_ret_1d", **how), "embedded"), targets.bucket_targets(f)


@query()
def context_probe(spark, sf_dir):
    """A probe fitted before 1999, on the days after."""
    return _five(neural.probe(*_embedded(spark, sf_dir), train_before="1999-01-01"), ["date", "y", "predicted"])


@query()
def patch_probe(spark, sf_dir):
    return _five(neural.probe(*_embedded(spark, sf_dir, patch=16, dims=32), train_before="1999-01-01"), ["date", "y", "predicted"])


@query()
def embedding_separation(spark, sf_dir):
    return neural.separation(*_embedded(spark, sf_dir))


@query()
def information_criteria(spark, sf_dir):
    f = _features(spark, sf_dir, often=True)
    draws = written(latent.mixture_draws(f, "nifty_ret_1d"), "draws")
    ll = written(latent.mixture_log_likelihood(f, "nifty_ret_1d", draws), "ll")
    return scoring.ic_ranking(scoring.waic(ll).join(latent.psis_loo(ll), ["panel", "model"])).drop("panel")


@query()
def mixture_convergence(spark, sf_dir):
    return latent.convergence(latent.mixture_chains(_features(spark, sf_dir), "nifty_ret_1d")).drop("panel")


@query()
def changepoint_segments(spark, sf_dir):
    return latent.changepoints(_features(spark, sf_dir), "nifty_ret_1d").drop("panel")


@query()
def changepoint_costs(spark, sf_dir):
    """Segments of constant variance, and of constant mean and variance, under the modified information criterion."""
    f = _features(spark, sf_dir, often=True)
    found = [latent.changepoints(f, "nifty_ret_1d", kind, "mbic").withColumn("cost", F.lit(kind)) for kind in ("variance", "mean_variance")]
    return found[0].unionByName(found[1]).drop("panel")


@query()
def online_scores(spark, sf_dir):
    bars = market.hourly_bars(market.table(spark, sf_dir, "events"))
    rows = bars.select(F.col("symbol").alias("series"), F.col("hour").alias("at"), F.log(F.col("close") / F.col("open")).alias("x"))
    return online.score_batch(rows).withColumn("at", F.date_format("at", "yyyy-MM-dd HH"))


# --- text forms ------------------------------------------------------------------------------------------------------


def _changes(f: DataFrame) -> DataFrame:
    rows = f.filter("nifty_ret_1d is not null").select(F.col("panel").alias("series"), F.col("date").alias("at"), (0.02 * F.col("nifty_ret_1d")).alias("x"))
    return online.changepoints_batch(rows).select(F.col("series").alias("panel"), F.to_date("at").alias("date"), F.col("cp_short").alias("changepoint"), "cp_zero", "run_length")


@query()
def evidence_bundles(spark, sf_dir):
    """What is known at each probe date, as JSON with a hash."""
    f = _features(spark, sf_dir, often=True)
    state = governance.regime_state(_models(f).filter("model = 'soft'"), _asked(spark))
    return governance.evidence_bundle(state, f.select("panel", "date", *LINEAR), _changes(f)).drop("panel")


@query(with_(*EVAL, MC, recursive=True) + "SELECT round(1e6 * avg(r), 3) AS expected_return_amount, round(1e6 * any_value(a), 3) AS var_95_amount, round(1e6 * avg(r) FILTER (r <= a), 3) AS cvar_95_amount, round(1e6 * any_value(b), 3) AS var_99_amount, round(1e6 * avg(r) FILTER (r <= b), 3) AS cvar_99_amount FROM tot, vq")
def position_at_risk(spark, sf_dir):
    amounts = portfolio.position_risk(1e6, simulation.tail_risk(simulation.simulate(spark, _start(spark, sf_dir))))
    return amounts.select(*(F.round(c, 3).alias(c) for c in amounts.columns))
