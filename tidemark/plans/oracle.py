"""DuckDB common table expressions that state the same base relations independently."""

from __future__ import annotations

BARS = """bars AS (
  SELECT r_name AS symbol, CAST(l_shipdate AS DATE) AS date,
    arg_min(l_extendedprice, {'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice}) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
    arg_max(l_extendedprice, {'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice}) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""
PANEL = """wide AS (
  SELECT date, max(close) FILTER (symbol = 'MIDDLE EAST') AS bench, max(high) FILTER (symbol = 'MIDDLE EAST') AS bench_high, max(low) FILTER (symbol = 'MIDDLE EAST') AS bench_low,
    max(close) FILTER (symbol = 'AFRICA') AS bank0, max(close) FILTER (symbol = 'AMERICA') AS it0, max(close) FILTER (symbol = 'ASIA') AS midcap0, max(close) FILTER (symbol = 'EUROPE') AS broad0
  FROM bars GROUP BY date HAVING max(close) FILTER (symbol = 'MIDDLE EAST') IS NOT NULL),
idx AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(round(100 * l_discount)::BIGINT)::BIGINT / count(*) AS vix0, 1 + sum(round(100 * l_tax)::BIGINT)::BIGINT / count(*) / 100 AS fx0 FROM lineitem GROUP BY 1),
panel AS (
  SELECT date, bench, bench_high, bench_low, last_value(bank0 IGNORE NULLS) OVER w AS bank, last_value(it0 IGNORE NULLS) OVER w AS it, last_value(midcap0 IGNORE NULLS) OVER w AS midcap,
    last_value(broad0 IGNORE NULLS) OVER w AS broad, last_value(vix0 IGNORE NULLS) OVER w AS vix, last_value(fx0 IGNORE NULLS) OVER w AS fx
  FROM wide LEFT JOIN idx USING (date) WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))"""
FEATURES = """ret AS (SELECT *, ln(bench / lag(bench) OVER (ORDER BY date)) AS r1, ln(greatest(bench_high, 1e-6) / greatest(bench_low, 1e-6)) ^ 2 AS hl FROM panel),
feat AS (
  SELECT date, r1 AS nifty_ret_1d, ln(bench / lag(bench, 5) OVER w) AS nifty_ret_5d, ln(bench / lag(bench, 21) OVER w) AS nifty_ret_21d,
    CASE WHEN count(r1) OVER w21 = 21 THEN stddev_samp(r1) OVER w21 * sqrt(252) END AS nifty_vol_realized_21d,
    CASE WHEN count(hl) OVER w21 = 21 THEN sqrt(sum(hl) OVER w21 * (252 / (21 * 4 * ln(2)))) END AS nifty_vol_parkinson_21d,
    CASE WHEN count(bench) OVER w200 = 200 THEN bench / avg(bench) OVER w200 - 1 END AS nifty_dist_sma200, CASE WHEN count(bench) OVER w50 = 50 THEN bench / avg(bench) OVER w50 - 1 END AS nifty_dist_sma50,
    vix AS vix_level, (vix - lag(vix, 5) OVER w) / greatest(lag(vix, 5) OVER w, 1e-4) AS vix_ret_5d, ln(fx / lag(fx, 21) OVER w) AS usdinr_ret_21d,
    ln(midcap / lag(midcap, 21) OVER w) - ln(bench / lag(bench, 21) OVER w) AS breadth_midcap_ret_21d, ln(midcap / bench) AS breadth_midcap_ratio,
    ln(broad / lag(broad, 21) OVER w) - ln(bench / lag(bench, 21) OVER w) AS breadth_broad_ret_21d, ln(bank / lag(bank, 21) OVER w) - ln(it / lag(it, 21) OVER w) AS sector_bank_it_divergence_21d
  FROM ret WINDOW w AS (ORDER BY date), w21 AS (ORDER BY date ROWS 20 PRECEDING), w50 AS (ORDER BY date ROWS 49 PRECEDING), w200 AS (ORDER BY date ROWS 199 PRECEDING))"""
#: The three baseline models, long: (model, date, k, p).
MODELS = """zs AS (
  SELECT date, (nifty_ret_1d - avg(nifty_ret_1d) OVER ()) / (stddev_pop(nifty_ret_1d) OVER () + 1e-8) AS r, (nifty_vol_realized_21d - avg(nifty_vol_realized_21d) OVER ()) / (stddev_pop(nifty_vol_realized_21d) OVER () + 1e-8) AS v
  FROM feat WHERE nifty_ret_1d IS NOT NULL AND nifty_vol_realized_21d IS NOT NULL),
soft0 AS (SELECT date, unnest([0, 1, 2, 3, 4]) AS k, unnest([exp(1.2 * r - 0.8 * v), exp(0.8 * r + 0.8 * v), exp(-1.5 * r * r), exp(0.5 * r + 1.5 * v), exp(-1.5 * r + v)]) AS s FROM zs),
soft AS (SELECT 'soft' AS model, date, k, s / sum(s) OVER (PARTITION BY date) AS p FROM soft0),
cut AS (SELECT quantile_cont(nifty_ret_1d, [0.2, 0.4, 0.6, 0.8]) AS q FROM feat WHERE nifty_ret_1d IS NOT NULL),
buckets AS (SELECT date, CASE WHEN nifty_ret_1d >= q[4] THEN 0 WHEN nifty_ret_1d >= q[3] THEN 1 WHEN nifty_ret_1d >= q[2] THEN 2 WHEN nifty_ret_1d >= q[1] THEN 3 ELSE 4 END AS y FROM feat, cut WHERE nifty_ret_1d IS NOT NULL),
ks AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
bucket AS (SELECT 'bucket' AS model, date, k, CASE WHEN k = y THEN 0.8 ELSE 0.05 END AS p FROM buckets, ks),
tz AS (SELECT date, (nifty_dist_sma50 - avg(nifty_dist_sma50) OVER ()) / (stddev_pop(nifty_dist_sma50) OVER () + 1e-8) AS z FROM feat WHERE nifty_dist_sma50 IS NOT NULL),
trend0 AS (SELECT date, k, exp(0.6 * (2 - k) * z) AS s FROM tz, ks),
trend AS (SELECT 'trend' AS model, date, k, s / sum(s) OVER (PARTITION BY date) AS p FROM trend0),
preds AS (SELECT * FROM soft UNION ALL SELECT * FROM bucket UNION ALL SELECT * FROM trend)"""
TRUTH = """fwd0 AS (
  SELECT date, count(nifty_ret_1d) OVER w AS n, sum(nifty_ret_1d) OVER w AS s, stddev_pop(nifty_ret_1d) OVER w AS v FROM feat WHERE nifty_ret_1d IS NOT NULL
  WINDOW w AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
fwd1 AS (SELECT date, CASE WHEN n = 5 THEN s END AS fwd_ret, CASE WHEN n = 5 THEN v END AS fwd_vol FROM fwd0),
med AS (SELECT quantile_cont(fwd_vol, 0.5) AS m FROM fwd1),
fwd AS (SELECT date, fwd_ret, fwd_vol, CAST(CASE WHEN fwd_ret IS NULL THEN NULL WHEN fwd_ret > 0.02 AND fwd_vol > 1.5 * m THEN 3 WHEN fwd_ret > 0.01 AND fwd_vol <= m THEN 0
  WHEN fwd_ret > 0.01 THEN 1 WHEN abs(fwd_ret) <= 0.01 THEN 2 ELSE 4 END AS INTEGER) AS y FROM fwd1, med),
truth AS (SELECT date, y, fwd_ret FROM fwd WHERE y IS NOT NULL)"""
SCORED = """climk AS (SELECT k, (SELECT count(*) FROM truth WHERE y = k) / (SELECT count(*) FROM truth) AS p FROM ks),
clim AS (SELECT 'climatology' AS model, date, k, p FROM truth, climk),
lagged AS (SELECT date, coalesce(lag(y) OVER (ORDER BY date), y) AS l FROM truth),
pers AS (SELECT 'persistence' AS model, date, k, CASE WHEN k = l THEN 0.98 ELSE 0.005 END AS p FROM lagged, ks),
every AS (SELECT * FROM preds UNION ALL SELECT * FROM clim UNION ALL SELECT * FROM pers),
cumd AS (SELECT model, date, k, y, p, sum(p - (k = y)::INT) OVER (PARTITION BY model, date ORDER BY k) AS c FROM every JOIN truth USING (date)),
perday AS (SELECT model, date, -ln(greatest(max(p) FILTER (k = y), 1e-12)) AS ll, sum((p - (k = y)::INT) ^ 2) AS bs, sum(c * c) FILTER (k < 4) / 4 AS rps FROM cumd GROUP BY model, date),
scored AS (SELECT model, count(*) AS n, avg(ll) AS log_loss, avg(bs) AS brier_score, avg(rps) AS rps FROM perday GROUP BY model)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


BASE = (BARS, PANEL, FEATURES)
EVAL = (*BASE, MODELS, TRUTH)
