"""More named queries: artifacts, contracts, lookups, briefs, online measures. Registered beside those of queries.py."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import simplex as S
from ..operators import contracts, duration, ensemble, governance, network, pit, portfolio, quality, scoring, simulation, technical
from ..operators.models import latent
from ..sources import artifacts, charts, market, snapshots
from ..sources.durable import place, written
from ..streaming import online
from .oracle import BARS, BASE, EVAL, PANEL, SCORED, with_
from .queries import (
    ALLOC, ASKED, CUM, INPUTS, LINEAR, MC, METRIC_COLUMNS, METRICS, P5, LAST, PARSED, PATHS, SETS, SPELLS, START, STATE, U, WIDE5, _asked, _cases, _changes, _features, _five, _models, _paths, _scenarios, _setup, _start, _truth, query, rounded,
)

# --- sources and artifacts -------------------------------------------------------------------------------------------

NAMES5 = "['Risk-On', 'Late-Cycle', 'Transitional', 'Post-Shock', 'Risk-Off']"


@query(with_(BARS) + rounded("symbol @date #open #high #low #close #volume", "bars"))
def stored_bars(spark, sf_dir):
    """Bars written as one table for each symbol and scanned again, the symbol taken from the tables' names."""
    path = place(spark, "symbols")
    artifacts.write_by_symbol(market.daily_bars(spark, sf_dir), path)
    return artifacts.scan_symbols(spark, path).select("symbol", "date", "open", "high", "low", "close", "volume")


@query(with_(BARS) + "SELECT symbol, strftime(date, '%Y-%m-%d') AS date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, 'OK' AS status FROM bars WHERE date >= DATE '1997-01-01'")
def chart_bars(spark, sf_dir):
    """Bars written as chart documents and read back through the data source, from a year on."""
    path = place(spark, "charts")
    charts.write_charts(market.daily_bars(spark, sf_dir), path)
    return charts.charts(spark, path).filter(F.col("date") >= F.lit("1997-01-01").cast("date")).drop("reason")


@query(with_(*EVAL, f"w AS (SELECT model, date, {WIDE5} FROM preds GROUP BY model, date)") + rounded(f"model @date {P5}", "w"))
def stored_predictions(spark, sf_dir):
    """The prediction matrix through a Parquet sink."""
    path = place(spark, "predictions")
    artifacts.write_predictions(_five(_models(_features(spark, sf_dir, often=True)), ["model", "date"]), path)
    return artifacts.read_table(spark, path, "parquet")


@query(with_(*EVAL, SCORED) + "SELECT model, n, round(log_loss, 6) AS log_loss, round(brier_score, 6) AS brier_score, round(rps, 6) AS rps FROM scored WHERE model IN ('soft', 'bucket', 'trend')")
def stored_scores(spark, sf_dir):
    """Score tables through a CSV sink with a header."""
    path = place(spark, "scores")
    artifacts.write_table(scoring.scores(*_setup(spark, sf_dir)).drop("panel"), path)
    return artifacts.read_table(spark, path, "csv", "model string, n long, log_loss double, brier_score double, rps double")


@query(with_(BARS) + "SELECT 'bars' AS artifact, 'VERIFIED' AS status, count(*) AS n_rows FROM bars UNION ALL SELECT 'nothing', 'UNAVAILABLE', 0 UNION ALL SELECT 'negative', CASE WHEN count(*) > 0 THEN 'VERIFIED' ELSE 'EMPTY' END, count(*) FROM bars WHERE close < 0")
def artifact_status(spark, sf_dir):
    """Whether written artifacts are there: all bars, those with a negative close, and one that nobody wrote."""
    full, blank, bars = place(spark, "table"), place(spark, "blank"), written(market.daily_bars(spark, sf_dir), "bars")
    artifacts.write_table(bars, full)
    artifacts.write_predictions(bars.filter("close < 0"), blank)
    return artifacts.artifact_status(spark, {"bars": (full, "csv"), "nothing": (place(spark, "nothing"), "csv"), "negative": (blank, "parquet")})


ASKED_SERIES = ["AFRICA", "EUROPE", "VIX_INDEX", "GILT_10Y", "NO_SUCH_SERIES"]


@query(with_(BARS, "s AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol)", "a(series_id, why) AS (VALUES ('AFRICA', 'no rows'), ('EUROPE', 'no rows'), ('VIX_INDEX', 'no rows'), ('GILT_10Y', 'no machine-readable endpoint'), ('NO_SUCH_SERIES', 'not in the catalog'))")
       + "SELECT series_id, n IS NOT NULL AS is_available, CASE WHEN n IS NULL THEN why ELSE '' END AS reason, coalesce(n, 0) AS n_rows FROM a LEFT JOIN s ON symbol = series_id")
def series_contract(spark, sf_dir):
    bars = written(market.daily_bars(spark, sf_dir), "bars")
    found = [artifacts.load_series(spark, bars, s)[1] for s in ASKED_SERIES]
    return spark.createDataFrame([(m.series_id, m.is_available, m.reason, m.n_rows) for m in found], "series_id string, is_available boolean, reason string, n_rows long")


HASHED = ["date", "nifty_ret_1d", "vix_level", "nifty_dist_sma50"]
LINE = "concat_ws(',', strftime(date, '%Y-%m-%d'), " + ", ".join(f"CASE WHEN {c} IS NULL THEN '' ELSE printf('%.6f', {c}) END" for c in HASHED[1:]) + ")"


@query(with_(*BASE, f"f AS (SELECT date, round({HASHED[1]}, 4) + 0.0 AS {HASHED[1]}, round({HASHED[2]}, 4) + 0.0 AS {HASHED[2]}, round({HASHED[3]}, 4) + 0.0 AS {HASHED[3]} FROM feat)", f"h AS (SELECT date, sha256(sha256({LINE})) AS h FROM f)")
       + "SELECT count(*) AS n_rows, sha256(string_agg(h, '' ORDER BY h)) AS sha256 FROM h")
def frame_hash(spark, sf_dir):
    f = _features(spark, sf_dir).select("date", *((F.round(c, 4) + 0.0).alias(c) for c in HASHED[1:]))
    return artifacts.frame_hash(f, "date")


@query(with_(BARS, "lines AS (SELECT symbol, date, concat_ws(',', strftime(date, '%Y-%m-%d'), printf('%.6f', open), printf('%.6f', high), printf('%.6f', low), printf('%.6f', close), printf('%.6f', volume)) AS line FROM bars)",
             "d AS (SELECT symbol, date, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM lines GROUP BY 1, 2)", "s AS (SELECT symbol, sha256(string_agg(h, '' ORDER BY date)) AS h FROM d GROUP BY symbol)", "m AS (SELECT sha256(string_agg(h, '' ORDER BY symbol)) AS h FROM s)")
       + "SELECT model, 42 AS seed, 'snap_' || substr(h, 1, 12) AS snapshot_id FROM m, (SELECT unnest(['bucket', 'soft', 'trend']) AS model)")
def model_lineage(spark, sf_dir):
    """What each model's numbers come from: the snapshot's id and the seed."""
    head = snapshots.master_hash(snapshots.series_hashes(market.daily_bars(spark, sf_dir)))
    lineage = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(42).alias("seed")) for m in ("bucket", "soft", "trend")))).alias("x")
    return head.select("snapshot_id", lineage).select("x.model", "x.seed", "snapshot_id")


# --- quality of raw rows ---------------------------------------------------------------------------------------------

SEQ = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_partkey"]
Q_TAIL = """y AS (SELECT *, sum(1 - same) OVER (PARTITION BY symbol ORDER BY date, seq ROWS UNBOUNDED PRECEDING) AS island FROM x),
z AS (SELECT *, sum(same) OVER (PARTITION BY symbol, island ORDER BY date, seq ROWS UNBOUNDED PRECEDING) AS streak FROM y),
q AS (SELECT symbol, count(*) AS n_rows, count(*) - count(DISTINCT date) AS n_duplicates, coalesce(bool_and(rising), TRUE) AS is_monotonic, count(*) FILTER (close IS NULL) AS n_missing, count(*) FILTER (gap) AS n_gaps,
  sum(coalesce(close < 0, FALSE)::INT + coalesce(close < low OR close > high, FALSE)::INT + coalesce((close > 0 AND before > 0 AND abs(ln(close / before)) > jump)::INT, 0)) AS n_impossible, count(*) FILTER (streak >= 3) AS n_stale, round(100.0 * count(*) FILTER (close IS NULL) / count(*), 4) AS pct_missing FROM z GROUP BY symbol),
report AS (SELECT *, CASE WHEN n_impossible > 0 OR NOT is_monotonic THEN 'FAILED' WHEN pct_missing > 5 OR n_gaps > 20 THEN 'WARNING' ELSE 'PASSED' END AS status FROM q)"""
Q_ROWS = """x AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, date > lag(date) OVER (PARTITION BY symbol ORDER BY seq) AS rising,
  date - lag(date) OVER d > 5 AS gap, coalesce(close = lag(close) OVER d, FALSE)::INT AS same FROM raw WINDOW d AS (PARTITION BY symbol ORDER BY date, seq))"""
Q_COLUMNS = "symbol n_rows n_duplicates is_monotonic n_missing n_gaps %n_impossible n_stale #pct_missing status"


@query(with_(f"raw AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_discount > 0 THEN l_extendedprice END AS close, row_number() OVER (ORDER BY {', '.join(SEQ)}) AS seq, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, 0.25 AS jump FROM lineitem)", Q_ROWS, Q_TAIL) + rounded(Q_COLUMNS, "report"))
def raw_quality(spark, sf_dir):
    """The audit of line items as they came: repeated days, days out of order, missing prices."""
    line = market.table(spark, sf_dir, "lineitem")
    raw = line.select(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("date"), F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("close"), F.struct(*SEQ).alias("seq"))
    return quality.quality_report(raw, arrival="seq")


@query(with_(f"raw AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_discount > 0 THEN l_extendedprice END AS close, row_number() OVER (ORDER BY {', '.join(SEQ)}) AS seq, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, 0.25 AS jump FROM lineitem)", Q_ROWS, Q_TAIL) + rounded(Q_COLUMNS, "report"))
def spread_quality(spark, sf_dir):
    """raw_quality by two passes over ranges of line items, which need no task for a supplier."""
    line = market.table(spark, sf_dir, "lineitem")
    raw = line.select(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("date"), F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("close"), F.struct(*SEQ).alias("seq"))
    return quality.quality_report_spread(raw, arrival="seq")


@query(with_("idx AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(round(100 * l_discount)::BIGINT)::BIGINT / count(*) AS vix, 1 + sum(round(100 * l_tax)::BIGINT)::BIGINT / count(*) / 100 AS fx FROM lineitem GROUP BY 1)",
             "raw AS (SELECT 'VIX_INDEX' AS symbol, date, 2 * vix AS close, date AS seq, 5.0 AS low, 100.0 AS high, 0.85 AS jump FROM idx UNION ALL SELECT 'FX_RATE', date, 34 * fx, date, 35.0, 100.0, 0.08 FROM idx)", Q_ROWS, Q_TAIL) + rounded(Q_COLUMNS, "report"))
def index_quality(spark, sf_dir):
    """The audit with the bounds of volatility indices and exchange rates."""
    idx = market.daily_indices(spark, sf_dir)
    rows = idx.select(F.lit("VIX_INDEX").alias("symbol"), "date", (2 * F.col("vix")).alias("close")).unionByName(idx.select(F.lit("FX_RATE").alias("symbol"), "date", (34 * F.col("fx")).alias("close")))
    return quality.quality_report(rows)


# --- point in time and contracts -------------------------------------------------------------------------------------


@query(with_(BARS) + "SELECT symbol, count(*) AS n, strftime(max(date), '%Y-%m-%d') AS last_date FROM bars WHERE date + CAST(length(symbol) % 7 AS INTEGER) <= DATE '1998-06-30' GROUP BY symbol")
def records_available(spark, sf_dir):
    """Records with publication lags of their own, as of a day."""
    records = market.daily_bars(spark, sf_dir).withColumn("effective_availability_date", F.date_add("date", F.length("symbol") % 7))
    return pit.records_available(records, F.lit("1998-06-30").cast("date")).groupBy("symbol").agg(F.count("*").alias("n"), F.max("date").alias("last_date"))


@query(with_(*BASE, "lk AS (SELECT date, date > DATE '1998-06-30' AS late FROM feat)") + """SELECT 'available' AS rows, count(*) FILTER (NOT late) AS n, 0 AS n_leaking, NULL AS first_leak, NULL AS last_leak FROM lk UNION ALL
SELECT 'all', count(*), count(*) FILTER (late), strftime(min(date) FILTER (late), '%Y-%m-%d'), strftime(max(date) FILTER (late), '%Y-%m-%d') FROM lk""")
def leak_free_features(spark, sf_dir):
    """Features as of a day, with the guard on, beside what the guard would stop at among all of them."""
    day, f = F.lit("1998-06-30").cast("date"), _features(spark, sf_dir, often=True)
    known = pit.leak_report(pit.assert_no_leak(pit.available(f, 0, day), day), day).withColumn("rows", F.lit("available"))
    return known.unionByName(pit.leak_report(f, day).withColumn("rows", F.lit("all")))


ATTR = ("b AS (SELECT " + ", ".join(f"{c} * ({w}) AS {c}" for c, w in LINEAR.items()) + ", date FROM feat WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in LINEAR) + "), u AS (UNPIVOT b ON " + ", ".join(LINEAR) + " INTO NAME feature VALUE d), "
        "attr AS (SELECT date, feature, coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY date), 0), 0) AS attribution FROM u), "
        "tops AS (SELECT date, 'up' AS side, row_number() OVER (PARTITION BY date ORDER BY attribution DESC, feature) AS place, feature, attribution FROM attr WHERE attribution > 0 QUALIFY place <= 3 UNION ALL "
        "SELECT date, 'down', row_number() OVER (PARTITION BY date ORDER BY attribution, feature) AS place, feature, attribution FROM attr WHERE attribution < 0 QUALIFY place <= 2)")


def _attributions(f):
    return governance.ablation(f.na.drop(subset=list(LINEAR)), lambda x: sum((x[c] * w for c, w in LINEAR.items()), F.lit(0.0)), list(LINEAR), dict.fromkeys(LINEAR, 0.0))


@query(with_(*BASE, ATTR) + rounded("@date side %place feature #attribution", "tops"))
def top_drivers(spark, sf_dir):
    return governance.top_drivers(_attributions(_features(spark, sf_dir))).drop("panel")


@query(with_(*BASE, ATTR, ASKED) + "SELECT strftime(as_of, '%Y-%m-%d') AS as_of, feature, round(attribution, 6) AS attribution, CASE WHEN date IS NULL THEN 'UNAVAILABLE' ELSE 'VERIFIED' END AS status FROM asked LEFT JOIN (SELECT * FROM tops WHERE side = 'up' AND place = 1) ON date = as_of")
def attribution_lookup(spark, sf_dir):
    """The strongest driver of the very day that is asked for."""
    first = governance.top_drivers(_attributions(_features(spark, sf_dir))).filter("side = 'up' and place = 1")
    return governance.exact_lookup(_asked(spark), first, ["feature", "attribution"]).drop("panel")


ASKED_METRICS = [c for c in METRIC_COLUMNS if c != "n"] + ["omega_ratio", "proper_rps"]


@query(with_(*EVAL, ALLOC, PATHS, METRICS, "mu AS (UNPIVOT (SELECT " + ", ".join(c for c in METRIC_COLUMNS if c != "n") + " FROM met) ON COLUMNS(*) INTO NAME metric VALUE value)", recursive=True)
       + f"SELECT a.metric, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'UNAVAILABLE' ELSE 'VERIFIED' END AS status, CASE WHEN value IS NULL THEN 'no record' ELSE '' END AS reason FROM (SELECT unnest({ASKED_METRICS}) AS metric) a LEFT JOIN mu USING (metric)")
def backtest_lookup(spark, sf_dir):
    """Figures of the stored backtest by name, and what isn't there."""
    names = [c for c in METRIC_COLUMNS if c != "n"]
    found = written(portfolio.backtest_metrics(_paths(spark, sf_dir)).select(*names), "metrics").unpivot([], names, "metric", "value")
    return governance.record_lookup(spark.createDataFrame([(m,) for m in ASKED_METRICS], "metric string"), found, ["metric"], ["value"])


ASKED_CARDS = [("soft", "1996"), ("trend", "2000"), ("bucket", "1998"), ("gibbs", "2000"), ("soft", "2035")]


@query(with_(*EVAL, "cl AS (SELECT model, CAST(year(date) AS VARCHAR) AS version, count(*) AS n, avg(-ln(greatest(p, 1e-12))) AS log_loss FROM preds JOIN truth USING (date) WHERE k = y GROUP BY 1, 2)", "ca(model, version) AS (VALUES " + ", ".join(map(str, ASKED_CARDS)) + ")")
       + "SELECT model, version, n, round(log_loss, 6) AS log_loss, CASE WHEN n IS NULL THEN 'UNAVAILABLE' ELSE 'VERIFIED' END AS status, CASE WHEN n IS NULL THEN 'no record' ELSE '' END AS reason FROM ca LEFT JOIN cl USING (model, version)")
def governance_lookup(spark, sf_dir):
    """Cards of models and years, computed and stored, by model and version."""
    models, truth = _setup(spark, sf_dir)
    days = models.join(truth.filter("y is not null"), ["panel", "date"]).select("model", F.year("date").cast("string").alias("version"), S.log_loss(F.col("p"), F.col("y")).alias("ll"))
    cards = written(days.groupBy("model", "version").agg(F.count("*").alias("n"), F.avg("ll").alias("log_loss")), "cards")
    return governance.record_lookup(spark.createDataFrame(ASKED_CARDS, "model string, version string"), cards, ["model", "version"], ["n", "log_loss"])


BROKEN = """br AS (SELECT date, list(CASE WHEN day(date) % 7 = 0 THEN 1.1 * p ELSE p END ORDER BY k) AS p, (day(date) % 10) / 8.0 - 0.05 AS cp, CASE WHEN day(date) % 11 = 0 THEN 0 ELSE 1 END AS m FROM soft GROUP BY date),
fl AS (SELECT date, concat_ws(',', CASE WHEN abs(list_sum(p) - 1) > 1e-4 OR list_max(p) > 1 THEN 'probabilities' END, CASE WHEN cp < 0 OR cp > 1 THEN 'changepoint' END, CASE WHEN m = 0 THEN 'set' END) AS faults FROM br)"""


@query(with_(*EVAL, BROKEN) + "SELECT faults, count(*) AS n FROM fl GROUP BY faults")
def prediction_contracts(spark, sf_dir):
    """Predictions of which some are broken on purpose, by the invariants that they break."""
    soft = _models(_features(spark, sf_dir, often=True)).filter("model = 'soft'")
    day = F.dayofmonth("date")
    p = F.transform("p", lambda x: F.when(day % 7 == 0, 1.1 * x).otherwise(x))
    members = F.when(day % 11 == 0, F.array().cast("array<int>")).otherwise(S.prediction_set(F.col("p"), F.lit(0.9)).cast("array<int>"))
    return soft.select(F.array_join(contracts.prediction_faults(p, (day % 10) / 8.0 - 0.05, members), ",").alias("faults")).groupBy("faults").agg(F.count("*").alias("n"))


UNC = """ah AS (SELECT date, avg(h) AS aleatoric FROM (SELECT model, date, -sum(p * ln(greatest(p, 1e-12))) AS h FROM preds GROUP BY ALL) GROUP BY date), th AS (SELECT date, -sum(m * ln(greatest(m, 1e-12))) AS total FROM (SELECT date, k, avg(p) AS m FROM preds GROUP BY ALL) GROUP BY date)"""


@query(with_(*EVAL, UNC) + """SELECT concat_ws(',', CASE WHEN total - 0.9 < -1e-6 THEN 'total' END, CASE WHEN aleatoric - 0.7 < -1e-6 THEN 'aleatoric' END) AS faults, count(*) AS n FROM ah JOIN th USING (date) GROUP BY 1""")
def uncertainty_contracts(spark, sf_dir):
    """Uncertainties shifted so that some turn negative, by the measures that do."""
    u = ensemble.uncertainty(_models(_features(spark, sf_dir, often=True)))
    faults = contracts.uncertainty_faults(F.col("total_entropy") - 0.9, F.col("aleatoric") - 0.7, F.col("epistemic"))
    return u.select(F.array_join(faults, ",").alias("faults")).groupBy("faults").agg(F.count("*").alias("n"))


@query(with_(BARS, PANEL, "r AS (SELECT date, " + ", ".join(f"coalesce(ln({c} / lag({c}) OVER (ORDER BY date)), 0) AS {c}" for c in network.NODES) + " FROM panel)", f"u AS (UNPIVOT r ON {', '.join(network.NODES)} INTO NAME node VALUE ret)") + rounded("@date node #ret", "u"))
def node_returns(spark, sf_dir):
    """The graph's inputs, one row for each node and day."""
    return network.returns(market.panel(spark, sf_dir)).unpivot(["panel", "date"], network.NODES, "node", "ret").drop("panel")


def _squared(m: str) -> str:
    """SQL for the square of a 5 by 5 matrix kept as a list."""
    return "[" + ", ".join(" + ".join(f"{m}[{5 * i + k + 1}] * {m}[{5 * k + j + 1}]" for k in range(5)) for i in range(5) for j in range(5)) + "]"


def _matrix(entry) -> str:
    return "[" + ", ".join(entry(i, j) for i in range(5) for j in range(5)) + "]"


def _leading(level: str, source: str) -> tuple[str, str]:
    """SQL for the largest eigenvalue `top` of each matrix m0 of source and the projection q onto its d vectors, by d, as sp<level>: squared thirty times, by traces."""
    trace = "(" + " + ".join(f"m[{6 * i + 1}]" for i in range(5)) + ")"
    return (
        f"pw{level} AS (SELECT 0 AS t, date, what, m0 AS m FROM {source} UNION ALL SELECT t + 1, date, what, " + _squared("x") + f" FROM (SELECT t, date, what, list_transform(m, lambda v: v / s) AS x FROM (SELECT *, list_max(m) AS s FROM pw{level} WHERE t < 30)))",
        f"sp{level} AS (SELECT *, round(1 / list_sum(list_transform(q, lambda v: v * v))) AS d FROM (SELECT date, what, c, m0, (" + " + ".join(f"m0[{5 * i + j + 1}] * m[{5 * j + i + 1}]" for i in range(5) for j in range(5)) + f") / {trace} AS top, list_transform(m, lambda v: v / {trace}) AS q FROM pw{level} JOIN {source} USING (date, what) WHERE t = 30))",
    )


NODES = network.NODES
_EDGE = lambda i, j: f"{NODES[min(i, j)]}_{NODES[max(i, j)]}"
_DEGREE = lambda i: "(" + " + ".join(_EDGE(i, j) for j in range(5) if j != i) + ")"
#: The graph's largest eigenvalue and its Laplacian's second least, from traces of a matrix squared again and again: A + 1, and
#: c (1 - J / 5) - L with c above all of L's eigenvalues.
SPECTRUM = ("r AS (SELECT date, " + ", ".join(f"coalesce(ln({c} / lag({c}) OVER (ORDER BY date)), 0) AS {c}" for c in NODES) + " FROM panel)",
    "ew0 AS (SELECT date, count(*) OVER w AS n, " + ", ".join(f"CASE WHEN least(stddev_pop({a}) OVER w, stddev_pop({b}) OVER w) > 0 THEN corr({a}, {b}) OVER w * (stddev_pop({a}) OVER w / (stddev_pop({a}) OVER w + 1e-8)) * (stddev_pop({b}) OVER w / (stddev_pop({b}) OVER w + 1e-8)) END AS {a}_{b}" for i, a in enumerate(NODES) for b in NODES[i + 1 :]) + " FROM r WINDOW w AS (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))",
    "ew AS (SELECT date, " + ", ".join(f"greatest(0.0, coalesce({a}_{b}, 0)) AS {a}_{b}" for i, a in enumerate(NODES) for b in NODES[i + 1 :]) + " FROM ew0 WHERE n = 60)",
    "gm0 AS (SELECT *, 2 * greatest(" + ", ".join(_DEGREE(i) for i in range(5)) + ") + 1 AS c FROM ew)",
    "gm AS (SELECT date, 'radius' AS what, " + _matrix(lambda i, j: "1.0::DOUBLE" if i == j else _EDGE(i, j)) + " AS m0, c FROM gm0 UNION ALL SELECT date, 'gap', " + _matrix(lambda i, j: f"0.8 * c - {_DEGREE(i)}" if i == j else f"{_EDGE(i, j)} - 0.2 * c") + ", c FROM gm0)",
    *_leading("1", "gm"))


@query(with_(*BASE, *SPECTRUM, "n AS (SELECT date, count(*) OVER (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) = 60 AS full_window FROM panel)", recursive=True)
       + "SELECT strftime(feat.date, '%Y-%m-%d') AS date, round(nifty_ret_1d, 6) AS nifty_ret_1d, round(vix_level, 6) AS vix_level, round(a.top - 1, 6) AS gnn_spectral_radius, round(b.c - b.top, 6) AS gnn_algebraic_connectivity, full_window AS has_topology FROM feat JOIN n USING (date) LEFT JOIN sp1 a ON a.date = feat.date AND a.what = 'radius' LEFT JOIN sp1 b ON b.date = feat.date AND b.what = 'gap'")
def full_feature_matrix(spark, sf_dir):
    f = contracts.full_feature_matrix(written(market.panel(spark, sf_dir), "panel"))
    return f.select("date", "nifty_ret_1d", "vix_level", "gnn_spectral_radius", "gnn_algebraic_connectivity", F.col("tda_h0_amplitude").isNotNull().alias("has_topology"))


def _embedding() -> tuple[str, str]:
    """SQL for the means over nodes of two rounds of spreading over the graph with loops, with the operator's fixed weights."""
    rng = np.random.RandomState(42)
    w0, w1 = rng.normal(0, 0.5, (3, 8)), rng.normal(0, 0.5, (8, 4))
    spread = lambda i, j: f"s[{5 * i + j + 1}]"
    inputs = [[f"{n}_mean * 252", f"{n}_sd * sqrt(252)", f"{n}_last"] for n in NODES]
    one = ", ".join("(" + " + ".join(f"{spread(i, j)} * {inputs[j][f]}" for j in range(5)) + f") AS x{i}{f}" for i in range(5) for f in range(3))
    share = [" + ".join(spread(i, j) for i in range(5)) for j in range(5)]
    two = ", ".join("(" + " + ".join(f"({share[j]}) / 5 * (" + " + ".join(f"{w1[h, m]!s} * greatest(0, " + " + ".join(f"{w0[f, h]!s} * x{j}{f}" for f in range(3)) + ")" for h in range(8)) + ")" for j in range(5)) + f") AS gnn_emb_{m}" for m in range(4))
    root = lambda i: f"sqrt(1 + {_DEGREE(i)})"
    loops = _matrix(lambda i, j: f"1 / (1 + {_DEGREE(i)})" if i == j else f"{_EDGE(i, j)} / {root(i)} / {root(j)}")
    stats = ", ".join(f"avg({n}) OVER w AS {n}_mean, stddev_pop({n}) OVER w AS {n}_sd, lag({n}) OVER (ORDER BY date) AS {n}_last" for n in NODES)
    return f"em0 AS (SELECT date, {loops} AS s FROM ew)", f"em1 AS (SELECT date, {stats} FROM r WINDOW w AS (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))", f"em AS (SELECT date, {two} FROM (SELECT date, s, {one} FROM em0 JOIN em1 USING (date)))"


def _rest(level: int) -> str:
    """The Laplacian's matrices without the eigenvalues found so far."""
    return f"ds{level} AS (SELECT date, what, c, list_transform(list_zip(m0, q), lambda v: v[1] - top * d * v[2]) AS m0 FROM sp{level} WHERE what = 'gap')"


#: The Laplacian's eigenvalues one after the other, equal ones at once, the last by the trace; shares of their sum.
#: In a graph without edges the first node holds all centrality, as in what this is modelled on.
LAPLACIAN = (
    *SPECTRUM, _rest(1), *_leading("2", "ds1"), _rest(2), *_leading("3", "ds2"), "lp0 AS (SELECT g.date, " + " + ".join(_DEGREE(i) for i in range(5)) + " AS total, a.c - a.top AS l2, a.c - b.top AS l3, a.c - e.top AS l4, a.d AS d2, least(b.d, 4 - d2) AS d3, least(e.d, 4 - d2 - d3) AS d4 FROM gm0 g JOIN sp1 a ON a.date = g.date AND a.what = 'gap' JOIN sp2 b ON b.date = g.date JOIN sp3 e ON e.date = g.date)",
    "lp1 AS (SELECT *, d2 * l2 + CASE WHEN d3 > 0 THEN d3 * l3 ELSE 0 END + CASE WHEN d4 > 0 THEN d4 * l4 ELSE 0 END AS known FROM lp0)",
    "lp AS (SELECT date, l2 AS gnn_algebraic_connectivity, CASE WHEN total > 0 THEN -list_sum(list_transform([[d2, l2 / total], [d3, l3 / total], [d4, l4 / total], [4 - d2 - d3 - d4, 1 - known / total]], lambda v: CASE WHEN v[1] > 0 AND v[2] > 1e-10 THEN v[1] * v[2] * ln(v[2]) ELSE 0 END)) ELSE 0 END AS gnn_graph_entropy FROM lp1)",
    "ce AS (SELECT date, top - 1 AS gnn_spectral_radius, CASE WHEN top - 1 < 1e-12 THEN [1.0, 0.0] ELSE list_transform([1, 7, 13, 19, 25], lambda k: sqrt(q[k])) END AS v FROM sp1 WHERE what = 'radius')",
)


@query(with_(*BASE[:2], *LAPLACIAN, *_embedding(), "gf AS (SELECT *, v[1] / list_sum(v) AS gnn_bank_centrality, v[2] / list_sum(v) AS gnn_it_centrality FROM ce JOIN lp USING (date) JOIN em USING (date))", recursive=True) + rounded("@date " + " ".join("#" + c for c in network.GRAPH), "gf"))
def graph_features(spark, sf_dir):
    """Spectrum, entropy, centralities and embedding of each window's graph."""
    return network.graph_features(market.panel(spark, sf_dir)).drop("panel")


EWMA = """br AS (SELECT symbol, date, close, row_number() OVER w AS k, ln(close / lag(close) OVER w) AS r, close - lag(close) OVER w AS d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
er AS (SELECT symbol, k, date, r * r AS v, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM br WHERE k = 2 UNION ALL
  SELECT b.symbol, b.k, b.date, 0.94 * e.v + (1 - 0.94) * b.r * b.r, 13 * e.g / 14 + greatest(b.d, 0) / 14, 13 * e.l / 14 + greatest(-b.d, 0) / 14 FROM er e JOIN br b ON b.symbol = e.symbol AND b.k = e.k + 1)"""


@query(with_(BARS, EWMA, recursive=True) + "SELECT b.symbol AS panel, strftime(b.date, '%Y-%m-%d') AS date, round(CASE WHEN v IS NOT NULL THEN sqrt(greatest(v, 1e-12) * 252) END, 6) AS nifty_vol_ewma_21d, round(CASE WHEN e.k > 14 THEN 100 - 100 / (1 + g / (l + 1e-12)) END, 6) AS nifty_rsi_14 FROM br b LEFT JOIN er e ON e.symbol = b.symbol AND e.k = b.k")
def symbol_recursions(spark, sf_dir):
    """The order-dependent features of every symbol: one scan each, side by side."""
    bars = market.daily_bars(spark, sf_dir).select(F.col("symbol").alias("panel"), "date", F.col("close").alias("bench"))
    return technical.recursive_features(bars)


@query(with_(BARS, EWMA, recursive=True) + "SELECT b.symbol AS panel, strftime(b.date, '%Y-%m-%d') AS date, round(CASE WHEN v IS NOT NULL THEN sqrt(greatest(v, 1e-12) * 252) END, 6) AS nifty_vol_ewma_21d, round(CASE WHEN e.k > 14 THEN 100 - 100 / (1 + g / (l + 1e-12)) END, 6) AS nifty_rsi_14 FROM br b LEFT JOIN er e ON e.symbol = b.symbol AND e.k = b.k")
def spread_recursions(spark, sf_dir):
    """symbol_recursions by affine maps over ranges of days, which don't need a symbol in one task."""
    bars = market.daily_bars(spark, sf_dir).select(F.col("symbol").alias("panel"), "date", F.col("close").alias("bench"))
    return technical.recursive_features_spread(written(bars, "bars"))


@query("""WITH f AS (SELECT CAST(l_shipdate AS DATE) AS d, l_orderkey AS k, l_linenumber AS n, l_extendedprice AS price FROM lineitem),
last AS (SELECT d, arg_max(price, {'k': k, 'n': n}) AS price, max({'k': k, 'n': n}) AS item FROM f GROUP BY d)
SELECT o_orderkey, strftime(last.d, '%Y-%m-%d') AS date, round(price, 6) AS price, item.k AS item FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) ASOF LEFT JOIN last ON day >= last.d""")
def spread_asof(spark, sf_dir):
    """For each order the last line item that was shipped by its day, over the whole table as one series: one key that holds every row."""
    line = market.table(spark, sf_dir, "lineitem")
    facts = line.select(F.lit("all").alias("series"), F.struct(F.to_date("l_shipdate").alias("d"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("n")).alias("at"), F.col("l_extendedprice").alias("price"), F.col("l_orderkey").alias("item"))
    asked = F.struct(F.to_date("o_orderdate").alias("d"), F.lit(2**63 - 1).alias("k"), F.lit(2**31 - 1).alias("n"))
    keyed = market.table(spark, sf_dir, "orders").select(F.lit("all").alias("series"), asked.alias("asked"), "o_orderkey")
    found = pit.asof_backward_spread(keyed.select("series", "asked").distinct(), facts, "series", "asked", "at", ["price", "item"])
    out = keyed.join(found.drop("series"), "asked")
    return out.select("o_orderkey", F.col("at.d").alias("date"), "price", "item")


@query(with_(BARS) + rounded("symbol @date #open #high #low #close #volume", "bars"))
def snapshot_cycle(spark, sf_dir):
    """Bars through an immutable snapshot: written under their content's hash, found as the latest, verified, loaded."""
    path = place(spark, "snapshots")
    name = snapshots.create_snapshot(written(market.daily_bars(spark, sf_dir), "bars"), path)
    if snapshots.latest_snapshot(spark, path) != name or not snapshots.verify_snapshot(spark, path, name):
        raise ValueError(f"snapshot {name} isn't intact")
    return snapshots.load_snapshot(spark, path, name).select("symbol", "date", "open", "high", "low", "close", "volume")


@query(with_(BARS) + rounded("symbol @date #open #high #low #close #volume", "bars"))
def quote_documents(spark, sf_dir):
    """Bars packed into one chart document for each symbol and month, and read from these."""
    bars = market.daily_bars(spark, sf_dir)
    rows = bars.groupBy("symbol", F.trunc("date", "month")).agg(F.sort_array(F.collect_list(F.struct(F.unix_timestamp(F.col("date").cast("timestamp")).alias("at"), *snapshots.BAR_COLUMNS))).alias("q"))
    each = lambda c: F.transform("q", lambda x: x[c]).alias(c)
    doc = F.to_json(F.struct("symbol", each("at").alias("timestamp"), F.struct(*map(each, snapshots.BAR_COLUMNS)).alias("quote")))
    return snapshots.quotes_from_json(rows.select(doc.alias("payload"))).select("symbol", "date", "open", "high", "low", "close", "volume")


MATRIX = ("fm AS (SELECT *, row_number() OVER (ORDER BY date) AS k FROM feat), fs AS (SELECT date, " + ", ".join(f"round(coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 0), 4) + 0.0 AS {c}" for c in HASHED[1:]) + f" FROM fm WHERE k > 200), h AS (SELECT date, sha256(sha256({LINE})) AS h FROM fs)")


@query(with_(*BASE, MATRIX) + "SELECT 'features' AS name, count(*) AS n_rows, CAST(4 AS BIGINT) AS n_columns, sha256(string_agg(h, '' ORDER BY h)) AS sha256 FROM h")
def feature_snapshot(spark, sf_dir):
    """The model's feature matrix as a stored, hashed snapshot: its metadata."""
    path = place(spark, "matrix")
    matrix = technical.feature_matrix(_features(spark, sf_dir).select("panel", *HASHED))
    artifacts.create_feature_snapshot(matrix.select("date", *((F.round(c, 4) + 0.0).alias(c) for c in HASHED[1:])), path, "features")
    return artifacts.read_table(spark, f"{path}/features_metadata", "json", "name string, n_rows long, n_columns long, sha256 string")


# --- scores, weights, briefs -----------------------------------------------------------------------------------------


@query(with_(*EVAL, SCORED, "v AS (SELECT model, n, -log_loss AS elpd FROM scored UNION ALL SELECT 'soft again', n, -log_loss FROM scored WHERE model = 'soft')")
       + "SELECT model, round(elpd, 6) AS elpd, round(max(elpd) OVER () - elpd, 6) AS delta, CAST(floor(rank() OVER (ORDER BY elpd DESC) + (count(*) OVER (PARTITION BY elpd) - 1) / 2) AS BIGINT) AS rank FROM v")
def score_ranking(spark, sf_dir):
    """Models ranked by their mean log predictive density; equal ones share the mean rank."""
    table = written(scoring.tournament(*_setup(spark, sf_dir)).select("panel", "model", (-F.col("log_loss")).alias("elpd")), "scores")
    both = table.unionByName(table.filter("model = 'soft'").withColumn("model", F.lit("soft again")))
    return scoring.ic_ranking(both, "elpd").drop("panel")


@query(with_(*EVAL, "tw AS (SELECT date, y, max(p) FILTER (model = 'bucket' AND k = y) AS a, max(p) FILTER (model = 'soft' AND k = y) AS b, max(p) FILTER (model = 'trend' AND k = y) AS c FROM preds JOIN truth USING (date) GROUP BY ALL)",
             "ls AS (SELECT list([greatest(a, 1e-12), greatest(b, 1e-12), greatest(c, 1e-12)]) AS q, count(*) AS n FROM tw WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)",
             """em AS (SELECT 0 AS r, 1 / 3.0::DOUBLE AS wa, 1 / 3.0::DOUBLE AS wb, 1 / 3.0::DOUBLE AS wc, FALSE AS done UNION ALL
  SELECT r + 1, na, nb, nc, greatest(abs(na - wa), abs(nb - wb), abs(nc - wc)) < 1e-5 FROM (SELECT r, wa, wb, wc, list_sum(list_transform(q, lambda x: wa * x[1] / (wa * x[1] + wb * x[2] + wc * x[3]))) / n AS na,
    list_sum(list_transform(q, lambda x: wb * x[2] / (wa * x[1] + wb * x[2] + wc * x[3]))) / n AS nb, list_sum(list_transform(q, lambda x: wc * x[3] / (wa * x[1] + wb * x[2] + wc * x[3]))) / n AS nc FROM em, ls WHERE NOT done AND r < 25))""", recursive=True)
       + "SELECT unnest(['bucket', 'soft', 'trend']) AS model, round(unnest([wa, wb, wc]), 6) AS weight FROM em WHERE r = (SELECT max(r) FROM em)")
def stacking_weights(spark, sf_dir):
    return ensemble.stacking_weights(*_setup(spark, sf_dir))


ECE = """t15 AS (SELECT 'soft' AS model, date, k, exp(ln(least(greatest(p, 1e-12), 1.0)) / 1.5) AS e FROM soft), after15 AS (SELECT date, k, e / sum(e) OVER (PARTITION BY date) AS p FROM t15),
both15 AS (SELECT 'before' AS stage, date, k, p FROM soft UNION ALL SELECT 'after', date, k, p FROM after15), tp AS (SELECT stage, date, max(p) AS c, arg_max(k, p * 1e9 - k) AS top FROM both15 GROUP BY stage, date),
bn AS (SELECT stage, greatest(1, ceil(c * 10)) AS bin, count(*) AS n, abs(avg(c) - avg((top = y)::INT)) AS gap FROM tp JOIN truth USING (date) GROUP BY 1, 2), ec AS (SELECT stage, sum(gap * n) / sum(n) AS ece FROM bn GROUP BY stage)"""


@query(with_(*EVAL, ECE) + "SELECT round(max(ece) FILTER (stage = 'before'), 6) AS ece_before, round(max(ece) FILTER (stage = 'after'), 6) AS ece_after, round(1 - max(ece) FILTER (stage = 'after') / max(ece) FILTER (stage = 'before'), 6) AS improvement FROM ec")
def calibration_gain(spark, sf_dir):
    """Calibration error before and after tempering by 1.5, and the share that is gone."""
    models, truth = _setup(spark, sf_dir)
    soft = models.filter("model = 'soft'")
    every = soft.withColumn("model", F.lit("before")).unionByName(soft.select("panel", "date", F.lit("after").alias("model"), S.tempered(F.col("p"), 1.5).alias("p")))
    e = scoring.calibration_error(scoring.reliability(every, truth)).groupBy().agg(*(F.max(F.when(F.col("model") == m, F.col("ece"))).alias(f"ece_{m}") for m in ("before", "after")))
    return e.withColumn("improvement", 1 - F.col("ece_after") / F.col("ece_before"))


@query(with_(*EVAL, SETS, UNC, "cv AS (SELECT date, max(p) AS top, sum(p * w) AS raw FROM soft JOIN (VALUES (0, 0.95), (1, 0.70), (2, 0.50), (3, 0.80), (4, 0.25)) e(k, w) USING (k) GROUP BY date)",
             "cf AS (SELECT date, raw, top * least(1.0, greatest(0.1, 1 - (set_size - 1) / 4)) * exp(-least(3.0, greatest(0.0, greatest(0.0, total - aleatoric)))) AS conviction FROM cv JOIN sets USING (date) JOIN ah USING (date) JOIN th USING (date) WHERE sets.model = 'soft')")
       + "SELECT strftime(date, '%Y-%m-%d') AS date, round(conviction, 6) AS conviction, round(least(1.0, greatest(0.2, 0.6 + conviction * (raw - 0.6))), 6) AS target_weight FROM cf")
def full_conviction(spark, sf_dir):
    """Conviction lowered by large prediction sets and by models that disagree."""
    models = written(_models(_features(spark, sf_dir, often=True)), "models")
    soft = scoring.conformal_sets(models.filter("model = 'soft'"), 0.1 + 1e-12).join(ensemble.uncertainty(models).select("panel", "date", "epistemic"), ["panel", "date"])
    return portfolio.allocate(soft).select("date", "conviction", "target_weight")


BENCH = METRICS.replace("strategy_return - br", "br - br").replace("strategy_return", "br").replace("strategy_wealth", "benchmark_wealth").replace("min(drawdown)", "min(bdrawdown)")
SIDE = ["n", "total_return", "cagr", "annualized_volatility", "sharpe_ratio", "max_drawdown", "calmar_ratio", "win_rate_monthly"]


@query(with_(*EVAL, ALLOC, PATHS, BENCH, recursive=True) + "SELECT n, " + ", ".join(f"round({c}, 6) AS {c}" for c in SIDE[1:] if c != "calmar_ratio") + ", round(cagr / abs(max_drawdown), 6) AS calmar_ratio FROM met")
def benchmark_metrics(spark, sf_dir):
    return portfolio.backtest_metrics(_paths(spark, sf_dir), side="benchmark").select(*SIDE)


@query(with_(*EVAL, ALLOC, recursive=True) + "SELECT strftime(date, '%Y-%m-%d') AS date, unnest(['equity', 'cash']) AS sleeve, round(unnest([equity_weight, 1 - equity_weight]), 6) AS weight, round(1e6 * unnest([equity_weight, 1 - equity_weight]), 3) AS amount FROM (SELECT * FROM held ORDER BY date DESC LIMIT 1)")
def target_table(spark, sf_dir):
    weights = portfolio.allocate(_models(_features(spark, sf_dir, often=True)).filter("model = 'soft'"))
    return portfolio.target_table(weights, 1e6).select("date", "sleeve", "weight", F.round("amount", 3).alias("amount"))


DSR = """sk AS (SELECT count(*) AS n, avg(strategy_return) AS mu, stddev_pop(strategy_return) AS sd FROM paths), sm AS (SELECT n, mu, sd, (SELECT avg(((strategy_return - mu) / sd) ^ 3) FROM paths, sk) AS skew, (SELECT avg(((strategy_return - mu) / sd) ^ 4) FROM paths, sk) AS kurt FROM sk),
sz AS (SELECT n, ((mu - 0.065 / 252) / (sd + 1e-8)) AS sr, skew, kurt, (sqrt(2 * ln(10)) + 0.5772156649 / sqrt(2 * ln(10))) * sqrt(0.15) / sqrt(252) AS best FROM sm),
zz AS (SELECT n, (sr - best) * sqrt(n - 1) / sqrt(greatest(1e-6, 1 - skew * sr + (kurt - 1) / 4 * sr * sr)) AS z FROM sz), tt0 AS (SELECT n, z, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM zz),
er AS (SELECT n, z, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2) AS tail FROM tt0)"""


@query(with_(*EVAL, ALLOC, PATHS, DSR, recursive=True) + "SELECT round(CASE WHEN n < 30 THEN 0.5 WHEN z >= 0 THEN 1 - tail / 2 ELSE tail / 2 END, 6) AS deflated_sharpe FROM er")
def deflated_sharpe(spark, sf_dir):
    return portfolio.deflated_sharpe(portfolio.backtest_metrics(_paths(spark, sf_dir))).drop("panel")


@query(with_(*EVAL, STATE, ASKED, SETS, "r AS (SELECT as_of, e.date, n[top + 1] AS regime, probability, set_size FROM asked a ASOF LEFT JOIN ent e ON a.as_of >= e.date LEFT JOIN (SELECT date AS sd, set_size FROM sets WHERE model = 'soft') ON sd = e.date, names)",
             "t AS (SELECT *, CASE WHEN date IS NULL THEN 'UNAVAILABLE' ELSE 'VERIFIED' END AS status, CASE WHEN date IS NULL THEN 'Nothing was known.' ELSE regime || ' at ' || printf('%.1f', 100 * probability) || ' %' END AS narrative FROM r)")
       + "SELECT strftime(as_of, '%Y-%m-%d') AS as_of, narrative, substr(sha256(concat_ws('|', 'main', strftime(as_of, '%Y-%m-%d'), coalesce(strftime(date, '%Y-%m-%d'), ''), coalesce(regime, ''), status, coalesce(printf('%.6f', probability), ''), coalesce(CAST(set_size AS VARCHAR), ''), narrative)), 1, 16) AS record_id FROM t")
def audit_records(spark, sf_dir):
    """Replayed states with a sentence and an id that any change of the record changes."""
    state = governance.regime_state(_models(_features(spark, sf_dir, often=True)).filter("model = 'soft'"), _asked(spark))
    text = F.when(F.col("regime").isNull(), "Nothing was known.").otherwise(F.concat("regime", F.lit(" at "), F.format_string("%.1f", 100 * F.col("probability")), F.lit(" %")))
    return governance.audit_records(state, text).select("as_of", "narrative", "record_id")


TAIL = "tr AS (SELECT any_value(a) AS var_95, avg(r) FILTER (r <= a) AS cvar_95 FROM tot, vq)"


@query(with_(*EVAL, SETS, STATE, ASKED, MC, TAIL, "tilt(regime, words) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in governance.TILTS.items()) + ")", recursive=True)
       + """SELECT strftime(as_of, '%Y-%m-%d') AS as_of, '# Regime memo, ' || strftime(as_of, '%Y-%m-%d') || chr(10) || chr(10) || '- Regime: **' || regime || '** (' || printf('%.1f', 100 * probability) || ' %)' || chr(10) || '- Tilt: ' || words || chr(10) || '- Month ahead: VaR ' || printf('%.1f', 100 * var_95) || ' %, CVaR ' || printf('%.1f', 100 * cvar_95) || ' %' AS memo
FROM asked a ASOF JOIN ent e ON a.as_of >= e.date, names, tr, tilt WHERE tilt.regime = n[top + 1]""")
def committee_memos(spark, sf_dir):
    state = governance.regime_state(_models(_features(spark, sf_dir, often=True)).filter("model = 'soft'"), _asked(spark))
    return governance.committee_memo(state, simulation.tail_risk(simulation.simulate(spark, _start(spark, sf_dir)))).drop("panel")


BOCPD = """xs AS MATERIALIZED (SELECT date, 0.02 * nifty_ret_1d AS x, row_number() OVER (ORDER BY date) AS t FROM feat WHERE nifty_ret_1d IS NOT NULL),
bo AS (SELECT CAST(0 AS BIGINT) AS t, CAST(NULL AS DATE) AS date, [{'r': 1.0::DOUBLE, 'm': 0.0::DOUBLE, 'k': 1.0::DOUBLE, 'a': 1.0::DOUBLE, 'b': 1e-4::DOUBLE}] AS st, 0.0::DOUBLE AS cp_zero, 0.0::DOUBLE AS changepoint, CAST(0 AS BIGINT) AS run_length UNION ALL
  SELECT t, date, st, rs[1], list_sum(rs[1:6]), list_position(rs, list_max(rs)) - 1 FROM (SELECT t, date, st, list_transform(st, lambda s: s.r) AS rs FROM (
  SELECT t, date, list_transform(st, lambda s: {'r': s.r / z, 'm': s.m, 'k': s.k, 'a': s.a, 'b': s.b}) AS st FROM (SELECT t, date, st, list_sum(list_transform(st, lambda s: s.r)) AS z FROM (
    SELECT t, date, list_concat([{'r': 0.01 * list_sum(list_transform(j, lambda s: s.r)), 'm': 0.0::DOUBLE, 'k': 1.0::DOUBLE, 'a': 1.0::DOUBLE, 'b': 1e-4::DOUBLE}], list_transform(j, lambda s: {'r': 0.99 * s.r, 'm': s.m, 'k': s.k, 'a': s.a, 'b': s.b}))[1:500] AS st FROM (
      SELECT n.t, n.date, list_transform(st, lambda s: {'r': s.r * greatest(1e-12, exp(lgamma(s.a + 0.5) - lgamma(s.a) - 0.5 * ln(2 * s.a * pi()) - 0.5 * ln(greatest(1e-12, s.b * (s.k + 1) / (s.a * s.k))) - (s.a + 0.5) * ln(1 + (n.x - s.m) ^ 2 / greatest(1e-12, s.b * (s.k + 1) / (s.a * s.k)) / (2 * s.a)))),
        'm': (s.k * s.m + n.x) / (s.k + 1), 'k': s.k + 1, 'a': s.a + 0.5, 'b': s.b + 0.5 * s.k / (s.k + 1) * (n.x - s.m) ^ 2}) AS j FROM bo JOIN xs n ON n.t = bo.t + 1)))))),
cp AS (SELECT date, cp_zero, changepoint, run_length FROM bo WHERE t > 0)"""


@query(with_(*BASE, BOCPD, recursive=True) + rounded("@date #changepoint #cp_zero %run_length", "cp"))
def changepoint_scores(spark, sf_dir):
    """Online changepoint detection over the panel's returns."""
    return _changes(_features(spark, sf_dir)).drop("panel")


@query(with_(*EVAL, UNC, STATE, MC, TAIL, BOCPD, recursive=True) + """SELECT strftime(date, '%Y-%m-%d') AS date, n[top + 1] AS regime, CASE WHEN greatest(0, total - aleatoric) > 0.4 THEN 'Stay cautious: the models part ways (epistemic uncertainty ' || printf('%.2f', total - aleatoric) || ').'
  WHEN top = 4 THEN 'Protect capital: Risk-Off holds ' || printf('%.1f', 100 * probability) || ' % of the probability and the worst twentieth of months loses ' || printf('%.2f', 100 * cvar_95) || ' % on average.'
  WHEN top = 0 THEN 'Lean in: Risk-On holds ' || printf('%.1f', 100 * probability) || ' % of the probability.' ELSE 'Keep hedges: no side prevails, a break is ' || printf('%.1f', 100 * changepoint) || ' % likely.' END AS commentary FROM ent JOIN ah USING (date) JOIN th USING (date) JOIN cp USING (date), names, tr""")
def committee_brief(spark, sf_dir):
    """The stance of each day; the tail risk is simulated, the break's probability is the online detector's mass of short runs."""
    f = _features(spark, sf_dir, often=True)
    m = written(_models(f), "models")
    rows = m.filter("model = 'soft'").join(ensemble.uncertainty(m), ["panel", "date"]).join(_changes(f), ["panel", "date"]).join(F.broadcast(simulation.tail_risk(simulation.simulate(spark, _start(spark, sf_dir))).select("cvar_95")))
    regime = S.label(S.argmax(F.col("p")))
    return rows.select("date", regime.alias("regime"), governance.commentary(regime, F.array_max("p"), F.col("epistemic"), F.col("cvar_95"), F.col("changepoint")).alias("commentary"))


@query(with_(*EVAL, "sa AS (SELECT date, max(p) AS probability, arg_max(k, p * 1e9 - k) AS top FROM soft GROUP BY date)", "pl AS (SELECT *, row_number() OVER (PARTITION BY top ORDER BY probability DESC, date) AS place FROM sa QUALIFY place <= 5)")
       + "SELECT ['Risk-On', 'Late-Cycle', 'Transitional', 'Post-Shock', 'Risk-Off'][top + 1] AS regime, place, strftime(pl.date, '%Y-%m-%d') AS date, round(probability, 6) AS probability, round(fwd_ret, 6) AS fwd_ret FROM pl LEFT JOIN fwd USING (date)")
def analogs(spark, sf_dir):
    f = _features(spark, sf_dir, often=True)
    return governance.analogs(_models(f).filter("model = 'soft'"), _truth(f)).drop("panel")


QUESTIONS = ["What is the current regime?", "How large is the prediction set?", "What is the tail risk?", "Hello"]
ANSWERS = ("'The regime is ' || n[top + 1] || ' at ' || printf('%.1f', 100 * probability) || ' %.'", "'The prediction set has ' || set_size || ' members.'", "'The month''s CVaR is ' || printf('%.1f', 100 * cvar_95) || ' %.'")


@query(with_(*EVAL, SETS, STATE, MC, TAIL, f"aw AS (SELECT date, dayofyear(date) % 4 AS q, {ANSWERS[0]} AS a, {ANSWERS[1]} AS b, {ANSWERS[2]} AS c FROM ent JOIN sets USING (date), names, tr WHERE model = 'soft')", recursive=True)
       + "SELECT strftime(date, '%Y-%m-%d') AS date, CASE q WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE a || ' ' || b || ' ' || c END AS answer FROM aw")
def template_answers(spark, sf_dir):
    """Each day's answer to one of four questions, from that day's regime and prediction set and the tail risk of the last day."""
    f = _features(spark, sf_dir, often=True)
    rows = scoring.conformal_sets(_models(f).filter("model = 'soft'")).join(F.broadcast(simulation.tail_risk(simulation.simulate(spark, _start(spark, sf_dir))).select("cvar_95")))
    question = F.get(F.array(*map(F.lit, QUESTIONS)), F.dayofyear("date") % 4)
    state = {"regime": S.label(S.argmax(F.col("p"))), "probability": F.array_max("p"), "set_size": F.col("set_size"), "cvar": F.col("cvar_95")}
    return rows.select("date", governance.template_answer(question, state).alias("answer"))


WAIC = """ob AS (SELECT row_number() OVER (ORDER BY date) AS obs, nifty_ret_1d AS x FROM feat WHERE nifty_ret_1d IS NOT NULL), dr AS (SELECT d, 0.01 * (d - 10) AS m, 0.3 + 0.01 * d AS s FROM (SELECT unnest(range(0, 20)) AS d)),
lw AS (SELECT obs, -ln(s) - 0.5 * ((x - m) / s) ^ 2 - 0.5 * ln(2 * pi()) AS ll FROM ob, dr), po AS (SELECT obs, ln(avg(exp(ll))) AS lpd, var_samp(ll) AS v FROM lw GROUP BY obs),
wa AS (SELECT sum(lpd) AS lppd, sum(v) AS p_waic, -2 * (sum(lpd) - sum(v)) AS waic, 2 * sqrt(count(*) * var_pop(-2 * (lpd - v))) AS waic_se FROM po)"""


@query(with_(*BASE, WAIC) + rounded("#lppd #p_waic #waic #waic_se", "wa"))
def waic_of_grid(spark, sf_dir):
    """The information criterion of a normal model over a grid of means and deviations, as if they were posterior draws."""
    f = _features(spark, sf_dir).filter("nifty_ret_1d is not null")
    draws = spark.range(20).select(F.lit("main").alias("panel"), F.lit("normal").alias("model"), F.col("id").alias("draw"), F.array(F.struct(F.lit(1.0).alias("w"), (0.01 * (F.col("id") - 10)).alias("m"), (0.3 + 0.01 * F.col("id")).alias("s"))).alias("parts"))
    return scoring.waic(latent.mixture_log_likelihood(f, "nifty_ret_1d", draws)).drop("panel", "model")


FIT = """fd AS (SELECT model, list({'l': ls, 'y': y}) AS data FROM (SELECT model, date, y, list(ln(least(greatest(p, 1e-12), 1.0)) ORDER BY k) AS ls FROM preds JOIN truth USING (date) GROUP BY ALL) GROUP BY model),
ft AS (SELECT model, data, 0 AS r, ln(0.05) AS lo, ln(10.0) AS hi, 0.0::DOUBLE AS t, 0.0::DOUBLE AS nll FROM fd UNION ALL
  SELECT model, data, r + 1, greatest(ln(0.05), b.t - step), least(ln(10.0), b.t + step), b.t, b.nll FROM (SELECT model, data, r, (hi - lo) / 12 AS step, list_sort(list_transform(range(0, 13), lambda i: {'nll': list_avg(list_transform(data, lambda d:
    -ln(greatest(exp(d.l[d.y + 1] / exp(lo + i * (hi - lo) / 12)) / list_sum(list_transform(d.l, lambda v: exp(v / exp(lo + i * (hi - lo) / 12)))), 1e-12)))), 't': lo + i * (hi - lo) / 12}))[1] AS b FROM ft WHERE r < 5))"""


@query(with_(*EVAL, FIT, recursive=True) + "SELECT model, round(exp(t), 4) AS temperature, round(nll, 6) AS nll FROM ft WHERE r = 5")
def temperature_fit(spark, sf_dir):
    return scoring.fit_temperature(*_setup(spark, sf_dir)).select("model", F.round("temperature", 4).alias("temperature"), "nll")


DURATIONS = """dl AS (SELECT state, list(CAST(days AS DOUBLE) ORDER BY days) AS x, count(*) AS n, avg(days) AS m, median(days) AS md, max(days) AS mx, least(0.999, greatest(0.001, 1 / greatest(1.0, avg(days)))) AS p FROM spells GROUP BY state),
kst0 AS (SELECT state, n, generate_subscripts(x, 1) AS i, 1 - (1 - p) ^ floor(unnest(x)) AS c FROM dl), kst AS (SELECT state, max(greatest(i / n - c, c - (i - 1) / n)) AS d FROM kst0 GROUP BY state),
kp AS (SELECT state, d, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS z FROM kst JOIN dl USING (state)), kv AS (SELECT state, d, CASE WHEN z > 0.2 THEN least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda j: (-1) ^ (j - 1) * exp(-2 * j * j * z * z))))) ELSE 1.0 END AS pv FROM kp),
nw AS (SELECT state, 0 AS it, 1.0::DOUBLE AS k FROM dl WHERE n >= 5 AND x[1] < x[-1] UNION ALL
  SELECT state, it + 1, greatest(k - (b / a - 1 / k - ml) / ((c * a - b * b) / (a * a) + 1 / (k * k)), k / 10) FROM (SELECT state, it, k, list_sum(list_transform(x, lambda v: v ^ k)) AS a, list_sum(list_transform(x, lambda v: v ^ k * ln(v))) AS b, list_sum(list_transform(x, lambda v: v ^ k * ln(v) ^ 2)) AS c, list_avg(list_transform(x, lambda v: ln(v))) AS ml FROM nw JOIN dl USING (state) WHERE it < 40)),
ws AS (SELECT state, k FROM nw WHERE it = 40)"""
ENOUGH = "CASE WHEN coalesce(n, 0) >= 5 THEN {} END"


@query(with_(*EVAL, SPELLS, DURATIONS, recursive=True) + f"SELECT CAST(s AS BIGINT) AS state, {NAMES5}[s + 1] AS regime, coalesce(n, 0) AS n_spells, "
       + ", ".join(ENOUGH.format(v) + f" AS {c}" for c, v in (("mean_days", "round(m, 4)"), ("median_days", "md"), ("max_days", "CAST(mx AS BIGINT)"), ("geometric_p", "round(p, 4)"), ("ks_stat", "round(d, 4)"), ("p_value", "round(pv, 4)"), ("weibull_shape", "round(coalesce(k, 1.0), 4)")))
       + ", CASE WHEN coalesce(n, 0) < 5 THEN 'INSUFFICIENT' WHEN coalesce(k, 1.0) > 1.1 THEN 'AGING' WHEN coalesce(k, 1.0) >= 0.9 THEN 'MEMORYLESS' ELSE 'EARLY_EXIT' END AS dependence FROM (SELECT unnest(range(0, 5)) AS s) LEFT JOIN dl ON state = s LEFT JOIN kv USING (state) LEFT JOIN ws USING (state)")
def duration_audit(spark, sf_dir):
    return duration.duration_audit(_truth(_features(spark, sf_dir))).drop("panel")


# --- claims and scenarios --------------------------------------------------------------------------------------------



@query(f"""WITH c AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, (conv_id + turn) % 5 AS k, 25 + conv_id % 12 AS a, 10 + turn % 9 AS b, 1 + conv_id % 3 AS s, conv_id % 4 = 0 AS old FROM conversations),
v AS (SELECT id, CASE WHEN k <> 0 THEN 1 ELSE 0 END AS claim, CASE WHEN abs(a - 30) > 2.5 THEN 1 ELSE 0 END AS p_on, CASE WHEN abs(b - 15) > 2.5 THEN 1 ELSE 0 END AS p_off, CASE WHEN s <> 2 THEN 1 ELSE 0 END AS size, old::INT AS old FROM c)
SELECT id, CAST(claim + p_on + p_off + size + old AS BIGINT) AS n_violations, claim + p_on + p_off + size + old = 0 AS is_trusted FROM v""")
def response_claims(spark, sf_dir):
    """Conversations with claims put into them, of which the evidence bears out some: a regime, two percentages side by side, a set's size, an old figure."""
    rows = market.table(spark, sf_dir, "conversations")
    c, t, names = F.col("conv_id"), F.col("turn"), F.array(*map(F.lit, S.REGIMES))
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" The dominant regime is "), F.get(names, ((c + t) % 5).cast("int")), F.lit(". Risk-On is at "), (25 + c % 12).cast("string"), F.lit("%, Risk-Off at "), (10 + t % 9).cast("string"),
                    F.lit("%. The conformal prediction set is of size "), (1 + c % 3).cast("string"), F.lit("."), F.when(c % 4 == 0, " Log loss was 0.0011.").otherwise(""))
    rows = rows.select((c * 1000 + t).alias("id"), said.alias("text"), F.lit("Risk-On").alias("regime"), F.array(*map(F.lit, START)).alias("p"), F.lit(2).alias("set_size"), F.lit(0.1).alias("changepoint"))
    return governance.validate_responses(rows).select("id", F.size("violations").alias("n_violations"), "is_trusted")


GRID = [("VIX rises {} pts", "vix_level", 1.0), ("vix falls {} points", "vix_level", -1.0), ("India VIX down {}%", "vix_level", -0.15), ("NIFTY up {} percent", "nifty_ret_1d", 0.01), ("nifty drops {} bps", "nifty_ret_1d", -0.0001),
        ("USD/INR -{}%", "usdinr_ret_21d", -0.01), ("rupee strengthens {}%", "usdinr_ret_21d", -0.01), ("midcap breadth falls {} basis points", "breadth_midcap_ret_21d", -0.0001), ("realized vol up {} pts", "nifty_vol_ewma_21d", 0.01), ("Spike VIX to {}", "vix_level", None)]


@query("WITH g(k, feature, f) AS (VALUES " + ", ".join(f"({k}, '{feature}', {'NULL' if f is None else f}::DOUBLE)" for k, (_, feature, f) in enumerate(GRID)) + "), n AS (SELECT o_orderkey, 1 + o_custkey % 50 AS n, o_orderkey % 10 AS k FROM orders) SELECT o_orderkey AS id, feature, round(CASE WHEN f IS NULL THEN n - 15 ELSE n * f END, 6) AS shock FROM n JOIN g USING (k)")
def scenario_grid(spark, sf_dir):
    """A sentence for each order: its form by the order's number, its amount, from 1 to 50, by the customer's."""
    forms = F.array(*(F.lit(form) for form, *_ in GRID))
    orders = market.table(spark, sf_dir, "orders")
    texts = orders.select(F.col("o_orderkey").alias("id"), F.replace(F.get(forms, (F.col("o_orderkey") % 10).cast("int")), F.lit("{}"), (1 + F.col("o_custkey") % 50).cast("string")).alias("text"))
    return simulation.parse_scenarios(texts).select("id", "feature", "shock")


@query(f"WITH {PARSED} SELECT id, feature, printf('%+.4f', shock) AS shock FROM pr")
def scenario_display(spark, sf_dir):
    return simulation.display_rows(simulation.parse_scenarios(_scenarios(spark, sf_dir))).filter("feature <> 'not understood'").select("id", "feature", "shock")


#: Words of the drivers that the linear score has, above and below their parting value.
SAID = ", ".join(f"'{c}', CASE WHEN {c} > {mid} THEN '{high}' ELSE '{low}' END" for c, (high, low, mid) in governance.DRIVERS.items() if c in LINEAR)
TOLD = f"""wd AS (SELECT date, feature, attribution AS a, map_extract(MAP {{{SAID.replace("', CASE", "': CASE")}}}, feature)[1] AS words FROM attr JOIN feat USING (date)),
wr AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY a DESC, feature DESC) AS up, row_number() OVER (PARTITION BY date ORDER BY a, feature) AS down FROM wd),
wy AS (SELECT date, string_agg(words, ', ' ORDER BY up) FILTER (a > 0.05 AND up <= 3) AS why, string_agg(words, ', ' ORDER BY down) FILTER (a < -0.05 AND down <= 2) AS why_not FROM wr GROUP BY date),
tp AS (SELECT model, date, arg_max(k, p * 1e9 - k) AS top FROM preds GROUP BY ALL),
vt AS (SELECT t.date, count(*) FILTER (t.top = s.top) AS agree, count(*) AS votes, list(t.model ORDER BY t.model) FILTER (t.top <> s.top) AS differ FROM tp t JOIN tp s ON s.date = t.date AND s.model = 'soft' GROUP BY t.date)"""


@query(with_(*EVAL, STATE, ATTR, BOCPD, TOLD, recursive=True) + """SELECT strftime(ent.date, '%Y-%m-%d') AS date, n[top + 1] AS regime, n[top + 1] || ' at ' || printf('%.1f', 100 * probability) || ' %.' || coalesce(' It rests on ' || why || '.', ' No single feature carries it.') || coalesce(' Against it: ' || why_not || '.', '')
  || ' ' || agree || ' of ' || votes || ' models agree' || coalesce('; not ' || array_to_string(differ[1:2], ', '), '') || '.' || CASE WHEN coalesce(changepoint, 0) > 0.3 THEN ' A break is ' || printf('%.1f', 100 * changepoint) || ' % likely.' ELSE '' END AS narrative
FROM ent JOIN wy USING (date) JOIN vt USING (date) LEFT JOIN cp USING (date), names""")
def narratives(spark, sf_dir):
    """A paragraph for each day from attributions, model votes and changepoints."""
    f = _features(spark, sf_dir, often=True)
    models = _models(f)
    shares = governance.ablation(f.na.drop(subset=list(LINEAR)), lambda x: sum((x[c] * w for c, w in LINEAR.items()), F.lit(0.0)), list(LINEAR), dict.fromkeys(LINEAR, 0.0))
    shares = shares.groupBy("panel", "date").agg(*(F.max(F.when(F.col("feature") == c, F.col("attribution"))).alias(f"a_{c}") for c in LINEAR))
    votes = models.groupBy("panel", "date").agg(F.map_from_entries(F.collect_list(F.struct("model", S.label(S.argmax(F.col("p"))).alias("r")))).alias("votes"))
    soft = models.filter("model = 'soft'").select("panel", "date", S.label(S.argmax(F.col("p"))).alias("regime"), F.array_max("p").alias("probability"))
    rows = soft.join(f, ["panel", "date"]).join(shares, ["panel", "date"]).join(votes, ["panel", "date"]).join(_changes(f), ["panel", "date"], "left")
    agree = F.sort_array(F.map_keys(F.map_filter("votes", lambda k, v: v == F.col("regime"))))
    differ = F.sort_array(F.map_keys(F.map_filter("votes", lambda k, v: v != F.col("regime"))))
    features = {c: F.col(c) for c in LINEAR} | {"nifty_vol_ewma_21d": F.col("nifty_vol_realized_21d")}
    attributions = {c: F.col(f"a_{c}") for c in LINEAR} | {"nifty_vol_ewma_21d": F.lit(0.0)}
    text = governance.narrative(F.col("regime"), F.col("probability"), features, attributions, agree, differ, F.coalesce("changepoint", F.lit(0.0)))
    return rows.select("date", "regime", text.alias("narrative"))


#: Shock vectors that are equal share one group g, which is what is simulated.
STRESS = LAST + ", " + PARSED + """, sv0 AS (SELECT id, min(form) AS form, min(n) AS n, sum(abs(shock)) AS sev, coalesce(max(shock) FILTER (feature = 'vix_level'), 0) AS vix, coalesce(max(shock) FILTER (feature = 'nifty_ret_1d'), 0) AS ret FROM pr GROUP BY id),
sv AS (SELECT DISTINCT form * 10 + n AS g, sev, vix, ret FROM sv0), sg AS (SELECT id, form * 10 + n AS g FROM sv0),
bs AS (SELECT k, p AS b, [-0.7, -0.3, 0.1, 0.3, 0.6][k + 1] AS dn, [0.7, 0.2, -0.1, -0.3, -0.6][k + 1] AS up FROM start_p),
mv0 AS (SELECT g, k, b, least(1.0, greatest(0.001, b + CASE WHEN vix > 2 OR ret < -0.02 THEN least(0.45, sev * 0.15) * dn WHEN vix < -2 OR ret > 0.02 THEN least(0.35, sev * 0.15) * up ELSE 0 END)) AS m FROM sv, bs),
mv AS (SELECT g AS gid, k, b, m / sum(m) OVER (PARTITION BY g) AS p FROM mv0)"""


@query(with_(*EVAL, STRESS) + f"SELECT id, {NAMES5}[k + 1] AS regime, round(b, 6) AS baseline, round(p, 6) AS stressed, round(100 * (p - b), 6) AS shift_pp FROM mv JOIN sg ON g = gid")
def probability_shift(spark, sf_dir):
    start = _start(spark, sf_dir)
    vectors = simulation.shock_vectors(simulation.parse_scenarios(_scenarios(spark, sf_dir)))
    return simulation.probability_shift(simulation.simulate_scenarios(vectors, start, parametric=True), start)


#: What each preset asks for, read by hand from the rules: feature and shock of its clauses.
READ = {
    "Volatility up by a third": [("vix_level", 4.5)], "Volatility at a crisis level": [("vix_level", 30)], "Market fall in a day": [("nifty_ret_1d", -0.05)], "Dollar up": [("usdinr_ret_21d", 0.03)], "Dollar down": [("usdinr_ret_21d", -0.03)],
    "Rupee stronger": [("usdinr_ret_21d", -0.03)], "Rupee weaker": [("usdinr_ret_21d", 0.03)], "Volatility up, market down": [("vix_level", 3.75), ("nifty_ret_1d", -0.04)], "Recovery": [("vix_level", -3), ("nifty_ret_1d", 0.03)],
    "Volatility spike": [("vix_level", 20), ("nifty_ret_1d", -0.03)], "Currency stress": [("usdinr_ret_21d", 0.04), ("breadth_midcap_ret_21d", -0.02)], "Relief rally": [("nifty_ret_1d", 0.03), ("vix_level", -4)], "Slow grind": [("nifty_ret_1d", -0.01), ("nifty_vol_ewma_21d", 0.03)],
}
PRESET_ROWS = "pr(id, form, n, feature, shock) AS (VALUES " + ", ".join(f"('{name}', {k}, 0, '{feature}', {shock}::DOUBLE)" for k, (name, clauses) in enumerate(READ.items()) for feature, shock in clauses) + ")"


PATHS5 = f"""cm AS (SELECT gid AS id, list(c ORDER BY k) AS cum FROM (SELECT gid, k, sum(p) OVER (PARTITION BY gid ORDER BY k) AS c FROM mv) GROUP BY gid),
sgrid AS (SELECT path, day, {U.format(at=1)} AS u0, {U.format(at=9)} AS u1, {U.format(at=17)} AS u2, {U.format(at=25)} AS u3, {U.format(at=33)} AS u4 FROM (SELECT unnest(range(0, 5000)) AS path), (SELECT unnest(range(0, 21)) AS day)),
sst AS (SELECT id, path, day, least(4, len(list_filter(cum, lambda c: c < u0))) AS state FROM sgrid, cm WHERE day = 0 UNION ALL SELECT s.id, g.path, g.day, least(4, len(list_filter({CUM}[s.state + 1], lambda c: c < g.u0))) FROM sst s JOIN sgrid g ON g.path = s.path AND g.day = s.day + 1),
sret AS (SELECT id, path, {_cases(simulation.MEANS, 'state')} / 252 + {_cases(simulation.VOLS, 'state')} / sqrt(252) * (sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) / sqrt((-2 * ln(u3) - 2 * ln(u4) + (sqrt(-2 * ln(u1)) * sin(2 * pi() * u2)) ^ 2) / 5) / sqrt(5 / 3.0)) AS ret FROM sst JOIN sgrid USING (path, day)),
stot AS (SELECT id, path, exp(sum(ln(1 + ret))) - 1 AS r FROM sret GROUP BY id, path), sq AS (SELECT id, quantile_cont(r, 0.05) AS a FROM stot GROUP BY id), srk AS (SELECT id, any_value(a) AS var_95, avg(r) FILTER (r <= a) AS cvar_95, avg(r) AS expected_return FROM stot JOIN sq USING (id) GROUP BY id),
sp AS (SELECT gid AS id, {WIDE5}, arg_max(k, p * 1e9 - k) AS top, -sum(p * ln(greatest(p, 1e-12))) AS entropy FROM mv GROUP BY gid)"""


@query(with_(*EVAL, STRESS, PATHS5, recursive=True) + f"SELECT sg.id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4, {NAMES5}[top + 1] AS dominant_regime, round(entropy, 6) AS entropy, round(var_95, 6) AS var_95, round(cvar_95, 6) AS cvar_95, round(expected_return, 6) AS expected_return FROM sg JOIN sp ON sp.id = g JOIN srk ON srk.id = g")
def scenario_stress(spark, sf_dir):
    return simulation.simulate_scenarios(simulation.shock_vectors(simulation.parse_scenarios(_scenarios(spark, sf_dir))), _start(spark, sf_dir))


@query(with_(*EVAL, STRESS.replace(PARSED, PRESET_ROWS), PATHS5, recursive=True) + f"SELECT sg.id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4, {NAMES5}[top + 1] AS dominant_regime, round(entropy, 6) AS entropy, round(var_95, 6) AS var_95, round(cvar_95, 6) AS cvar_95, round(expected_return, 6) AS expected_return FROM sg JOIN sp ON sp.id = g JOIN srk ON srk.id = g")
def scenario_presets(spark, sf_dir):
    """The offered scenarios, each stressed from the last day's probabilities."""
    texts = spark.createDataFrame(list(simulation.PRESETS.items()), "id string, text string")
    return simulation.simulate_scenarios(simulation.shock_vectors(simulation.parse_scenarios(texts)), _start(spark, sf_dir))


# --- streams as tables -----------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, ts, coalesce((ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL)::INT, 1) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM r GROUP BY user_id, run""")
def user_sessions(spark, sf_dir):
    out = online.sessions(market.table(spark, sf_dir, "events"))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


@query("""WITH s AS (SELECT event_type, event_id, ts, max(ts) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT event_id, event_type, ts - INTERVAL 1 HOUR * (event_id % 7) * (event_id % 3) AS ts FROM events))
SELECT event_type, count(*) AS n, count(*) FILTER (ts < seen - INTERVAL 1 HOUR) AS n_quarantined FROM s GROUP BY event_type""")
def late_events(spark, sf_dir):
    """Events of which some are delayed by hours, counted by what a watermark of one hour leaves out."""
    e = market.table(spark, sf_dir, "events")
    return artifacts.late_events(e.select("event_id", "event_type", (F.col("ts").cast("timestamp") - F.make_dt_interval(hours=(F.col("event_id") % 7 * (F.col("event_id") % 3)).cast("int"))).alias("ts")))


@query("SELECT c_mktsegment AS segment, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY ALL")
def enriched_events(spark, sf_dir):
    """Events with their customer's segment: a stream-static join, here over the whole table."""
    static = market.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    out = online.enriched(market.table(spark, sf_dir, "events"), static, "user_id").groupBy("segment", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.withColumn("value", F.round("value", 4))


@query(with_(*EVAL, "dn AS (SELECT date, k, p, row_number() OVER (PARTITION BY k ORDER BY date) AS t FROM soft)", "dc AS (SELECT date, k, 0.99 ^ t * (1 + sum(p * 0.99 ^ (-t)) OVER (PARTITION BY k ORDER BY date)) AS c FROM dn)", "dp AS (SELECT date, k, c / sum(c) OVER (PARTITION BY date) AS p FROM dc)", f"w AS (SELECT date, {WIDE5} FROM dp GROUP BY date)") + rounded(f"@date {P5}", "w"))
def decayed_counts(spark, sf_dir):
    return _five(online.decayed_counts(_models(_features(spark, sf_dir, often=True)).filter("model = 'soft'")), ["date"])


ESTIMATES = """tops AS (SELECT model, date, (arg_max(k, p * 1e9 - k) > 1)::INT AS s FROM preds GROUP BY model, date), moves AS (SELECT model, date, lag(s) OVER (PARTITION BY model ORDER BY date) AS a, s AS b FROM tops),
counts AS (SELECT model, part, a, b, count(*) AS c FROM (SELECT model, 'all' AS part, a, b FROM moves WHERE a IS NOT NULL UNION ALL SELECT model, 'late', a, b FROM moves WHERE a IS NOT NULL AND date >= DATE '1998-06-30') GROUP BY ALL),
est AS (SELECT model, part, a, b, c, c / sum(c) OVER (PARTITION BY model, part, a) AS p FROM counts), lls AS (SELECT model, part, 1000 * sum(c * ln(p)) / sum(c) AS ll FROM est GROUP BY ALL),
cell AS (SELECT model, a, b, max(p) FILTER (part = 'all') AS p, max(p) FILTER (part = 'late') AS q FROM (SELECT e.model, part, e.a, e.b, p FROM est e UNION ALL SELECT model, part, x.a, x.b, 0 FROM (SELECT DISTINCT model, part FROM est), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) x(a, b)) GROUP BY ALL),
fd AS (SELECT model, sqrt(sum((p - q) ^ 2)) AS frobenius FROM cell GROUP BY model), dl AS (SELECT model, abs(max(ll) FILTER (part = 'all') - max(ll) FILTER (part = 'late')) AS delta_ll FROM lls GROUP BY model)"""


def _chain(models, late):
    """(model, ll, trans): transitions between calm and troubled regimes, counted over all days or the later ones, and the mean log-likelihood of 1,000 of them."""
    w = Window.partitionBy("model").orderBy("date")
    s = (S.argmax(F.col("p")) > 1).cast("int")
    moves = models.select("model", "date", s.alias("b")).withColumn("a", F.lag("b").over(w)).filter("a is not null")
    moves = moves.filter(F.col("date") >= F.lit("1998-06-30").cast("date")) if late else moves
    n = moves.groupBy("model").agg(*(F.count_if((F.col("a") == i) & (F.col("b") == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)))
    p = {(i, j): F.col(f"n{i}{j}") / (F.col(f"n{i}0") + F.col(f"n{i}1")) for i in (0, 1) for j in (0, 1)}
    ll = sum((F.when(F.col(f"n{i}{j}") > 0, F.col(f"n{i}{j}") * F.log(x)).otherwise(0.0) for (i, j), x in p.items()), F.lit(0.0))
    return n.select("model", (1000 * ll / sum((F.col(f"n{i}{j}") for i, j in p), F.lit(0))).alias("ll"), F.array(*(F.array(p[i, 0], p[i, 1]) for i in (0, 1))).alias("trans"))


@query(with_(*EVAL, ESTIMATES) + "SELECT model, round(frobenius, 6) AS frobenius, round(delta_ll, 6) AS delta_ll, frobenius < 0.15 AND delta_ll < 50 AS is_reconciled FROM fd JOIN dl USING (model)")
def estimate_reconciliation(spark, sf_dir):
    """Two estimates of each model's two-state chain, over the whole panel and over its later half."""
    models = _models(_features(spark, sf_dir, often=True))
    return ensemble.reconcile_estimates(_chain(models, False), _chain(models, True))


@query(with_(*BASE, "g AS (SELECT regr_slope(nifty_ret_1d, vix_level) AS slope, regr_intercept(nifty_ret_1d, vix_level) AS intercept FROM feat)") + "SELECT unnest(['intercept', 'vix_level']) AS term, round(unnest([intercept, slope]), 6) AS mean, TRUE AS covers_least_squares, TRUE AS converged FROM g")
def return_regression(spark, sf_dir):
    """A Bayesian regression by sampling, held against least squares: its mean is theirs, its interval covers them and its chains agree."""
    f = _features(spark, sf_dir, often=True)
    ols = f.agg(F.regr_slope("nifty_ret_1d", "vix_level").alias("s"), F.regr_intercept("nifty_ret_1d", "vix_level").alias("i"))
    out = latent.bayes_regression(f, ["vix_level"], "nifty_ret_1d").join(F.broadcast(ols))
    plain = F.when(F.col("term") == "intercept", F.col("i")).otherwise(F.col("s"))
    return out.select("term", "mean", plain.between(F.col("low"), F.col("high")).alias("covers_least_squares"), (F.col("r_hat") < 1.05).alias("converged"))


@query()
def series_likelihood(spark, sf_dir):
    """Log-likelihood of the whole series under posterior draws, states summed out."""
    f = _features(spark, sf_dir, often=True)
    return latent.marginal_likelihood(f, INPUTS[:2], written(latent.gibbs_draws(f, INPUTS[:2]), "draws")).drop("panel")


@query()
def online_report(spark, sf_dir):
    """What a scoring request returns, for every day of the panel."""
    f = _features(spark, sf_dir, often=True)
    rows = f.filter("nifty_ret_1d is not null").select(F.col("panel").alias("series"), F.col("date").alias("at"), (0.02 * F.col("nifty_ret_1d")).alias("x"))
    return online.online_report(rows, _models(f).filter("model = 'soft'")).drop("series")
