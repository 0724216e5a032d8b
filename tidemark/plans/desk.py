"""Queries of whole scans, block resampling, calibration, the signal journal and display labels, with their SQL."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation, journal, labels, outcomes, scan, stress
from tidemark.plans import views
from tidemark.plans.registry import _FACTORS, _TRADES, _trades, query, rounded
from tidemark.sources import readers

FLOOR, TURNOVER, N_SECTORS, COHORT = 50_000.0, 1_000.0, 5, (5, 20)

# ---- whole scans

#: The gates before the ranks, put between the scores and the cohorts of the factor SQL.
_GATED = f"""fc AS (SELECT session, regime = 'PANIC' OR coalesce(lag(regime) OVER (ORDER BY session) = regime, false) AS confirmed FROM fg),
fo AS (SELECT f4.* FROM f4 JOIN f1 ON f1.ticker = f4.ticker AND f1.session = f4.session JOIN fc ON fc.session = f4.session
  WHERE f1.bar >= 50 AND f1.turnover_avg_20 >= {TURNOVER!r} AND CASE WHEN f1.super_up
    THEN f1.close > f1.ema_20 AND f1.close > f1.ema_200 AND confirmed AND NOT (f1.regime = 'TREND_DOWN' AND f4.rs_score < 0.7)
      AND (f1.regime IN ('TREND_UP', 'EXPANSION') OR (f1.regime = 'RANGE' AND coalesce(f1.rsi, 50) <= 55)
        OR (f1.regime = 'TREND_DOWN' AND f1.ema_20 > f1.ema_50 AND f1.ema_50 > f1.ema_200 AND coalesce(f1.rsi, 50) <= 72))
    ELSE f1.close < f1.ema_20 AND NOT f1.close > f1.ema_200 AND confirmed AND (f1.regime IN ('TREND_DOWN', 'EXPANSION') OR (f1.regime = 'RANGE' AND coalesce(f1.rsi, 50) >= 45)) END),
f5 AS (SELECT *, count(*)"""
_SCAN = _FACTORS.replace("f5 AS (SELECT *, count(*)", _GATED).replace("FROM f4 WINDOW k", "FROM fo WINDOW k")


@query(
    f"""WITH RECURSIVE {_SCAN},
kr AS (SELECT ticker, session, close / lag(close) OVER (PARTITION BY ticker ORDER BY session) - 1 AS ret FROM bars),
kk AS (SELECT ticker, session, CASE WHEN count(ret) OVER w >= 60 THEN least(20, greatest(0, kurtosis_pop(ret) OVER w)) ELSE 4 END AS ek FROM kr WINDOW w AS (PARTITION BY ticker ORDER BY session ROWS 251 PRECEDING)),
s1 AS (SELECT f8.ticker, f8.session, f8.direction, f8.regime, f1.open, f1.close, f1.atr, f1.atr_pctile, f1.sgn, ek,
  greatest(0.0, least(1.0, f8.composite * 1.05 * CASE WHEN f8.regime = 'RANGE' THEN 0.88 ELSE 1 END * CASE WHEN f8.regime = 'TREND_DOWN' AND f8.direction = 'LONG' THEN 0.9 ELSE 1 END)) AS adjusted
  FROM f8 JOIN f1 ON f1.ticker = f8.ticker AND f1.session = f8.session JOIN kk ON kk.ticker = f8.ticker AND kk.session = f8.session),
s2 AS (SELECT *, round(close - sgn * 1.5 * atr, 2) AS stop, round(abs(round(close + sgn * 3.8 * atr, 2) - close) / (1.5 * atr), 2) AS rr, 1 / (1 + exp(-4.0 * adjusted + 2.0)) AS p FROM s1),
s3 AS (SELECT *, CASE WHEN rr > 0 THEN greatest(0.0, (p * (rr + 1) - 1) / rr) ELSE 0 END * 0.5 * 3.0 / (3.0 + ek) AS kelly, abs(close - stop) AS per_share, round(p * rr - (1 - p), 4) AS expectancy,
  CASE regime WHEN 'TREND_UP' THEN 0.5 WHEN 'EXPANSION' THEN 0.52 WHEN 'RANGE' THEN 0.55 WHEN 'TREND_DOWN' THEN 0.58 ELSE 0.99 END AS least_p FROM s2),
s4 AS (SELECT *, trunc(greatest(1250.0, least(10000.0, 5000.0 * greatest(kelly, 0.01))) / per_share) AS whole,
  CASE WHEN p >= least_p AND expectancy >= 0.15 THEN 'SELECT' WHEN p < least_p AND p >= 0.45 AND expectancy >= 0 THEN 'WATCH' END AS tier FROM s3)
SELECT ticker, session, direction, regime, round(adjusted, 9) AS composite, round(p, 6) AS probability, rr, round(kelly, 5) AS kelly, expectancy, tier,
  CAST(CASE WHEN whole <= 0 AND per_share > 10000 THEN 0 ELSE greatest(whole, 1) END AS BIGINT) AS shares, CAST(CASE WHEN atr_pctile < 30 THEN 4 WHEN atr_pctile < 60 THEN 7 ELSE 12 END AS INTEGER) AS time_stop,
  CASE WHEN direction = 'LONG' THEN 'BUY' ELSE 'SELL' END AS action, round((close / open - 1) * 100, 2) AS change_percent FROM s4 WHERE tier IS NOT NULL"""
)
def scored_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's scan, from bars to sizes and tiers."""
    found = scan.score_universe(views.bars_walk(spark, sf_dir), N_SECTORS, FLOOR, TURNOVER, cohort=COHORT)
    shown = rounded(rounded(found, 9, "composite"), 6, "probability")
    names = ("direction", "regime", "composite", "probability", "rr", "kelly", "expectancy", "tier", "shares", "time_stop", "action", "change_percent")
    return shown.select("ticker", "session", *names)


# ---- resampling and calibration

_SIMULATIONS, _BLOCK, _FRACTION, _SEED = 1_000, 5, 0.01, 7


@query(
    f"""WITH {_TRADES}, z AS (SELECT net_r, row_number() OVER (ORDER BY entry_session, trade_id) - 1 AS pos, count(*) OVER () AS n FROM done),
k AS (SELECT sim, step, n, (('0x' || substr(md5('{_SEED}:' || sim || ':' || (step // {_BLOCK})), 1, 8))::BIGINT % n + step % {_BLOCK}) % n AS pos
  FROM (SELECT sim, n, unnest(range(n)) AS step FROM (SELECT DISTINCT n FROM z), range({_SIMULATIONS}) t(sim))),
p AS (SELECT sim, step, exp(sum(ln(1 + {_FRACTION} * net_r)) OVER (PARTITION BY sim ORDER BY step)) AS wealth FROM k JOIN z USING (pos)),
falls AS (SELECT *, 1 - wealth / greatest(1, max(wealth) OVER (PARTITION BY sim ORDER BY step)) AS fall FROM p),
s AS (SELECT sim, arg_max(wealth, step) AS final, max(fall) AS drawdown, least(1, min(wealth)) AS lowest FROM falls GROUP BY sim),
v AS (SELECT quantile_cont(1 - final, 0.95) AS v FROM s)
SELECT (SELECT count(*) FROM done) AS trades, round(max(drawdown), 8) AS worst_drawdown, round(quantile_cont(drawdown, 0.95), 8) AS drawdown_p95, round(greatest(0, max(v)), 8) AS loss_var95,
  round(greatest(0, avg(1 - final) FILTER (1 - final >= v - 1e-12)), 8) AS loss_shortfall95, avg(CASE WHEN lowest <= 0.5 THEN 1.0 ELSE 0.0 END) AS ruin_share,
  round(quantile_cont(final, 0.05), 8) AS final_p05, round(quantile_cont(final, 0.5), 8) AS final_median FROM s, v"""
)
def circular_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wealth, losses and ruin of the trades in resampled order."""
    trades, bars = _trades(spark, sf_dir)
    done = outcomes.outcomes(trades, bars).select("trade_id", F.col("entry_session").alias("exit_session"), "net_r")
    found = stress.circular_bootstrap(done, _SIMULATIONS, _BLOCK, _FRACTION, seed=_SEED)
    return rounded(found, 8, *(x for x in found.columns if x not in ("trades", "ruin_share")))


_WEIGHTS = {"trend": 0.5, "momentum": 0.3, "volume": 0.2}
_LOGGED = """l AS (SELECT o_orderkey AS trade_id, CASE o_orderkey % 4 WHEN 0 THEN 'PAPER' WHEN 1 THEN NULL ELSE 'EXECUTED' END AS source, CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice - 250000 END AS pnl,
  CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 11) / 10.0 END AS composite, (o_orderkey % 7) / 7.0 AS trend, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 5) / 5.0 END AS momentum, (o_orderkey % 13) / 13.0 AS volume, o_orderdate AS closed FROM orders),
c AS (SELECT trade_id, coalesce(composite, trend * 0.5 + coalesce(momentum, 0) * 0.3 + volume * 0.2) AS composite, CAST(pnl > 0 AS INTEGER) AS win, closed FROM l WHERE coalesce(source, 'EXECUTED') = 'EXECUTED' AND pnl IS NOT NULL)"""


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of trades out of orders: some on paper, some open, some without a composite."""
    k, part = F.col("o_orderkey"), lambda n: (F.col("o_orderkey") % n) / float(n)
    return views.table(spark, sf_dir, "orders").select(
        k.alias("trade_id"), F.when(k % 4 == 0, "PAPER").when(k % 4 != 1, "EXECUTED").alias("source"), F.when(k % 9 > 0, F.col("o_totalprice") - 250_000).alias("pnl"),
        F.when(k % 3 > 0, (k % 11) / 10.0).alias("composite"), part(7).alias("trend"), F.when(k % 5 > 0, part(5)).alias("momentum"), part(13).alias("volume"), F.col("o_orderdate").alias("closed"),
    )


@query(f"WITH {_LOGGED} SELECT trade_id, round(composite, 9) AS composite, win FROM c")
def calibration_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.calibration_set(_logged(spark, sf_dir), _WEIGHTS), 9, "composite")


@query(
    f"""WITH {_LOGGED}, h AS (SELECT 1 / (1 + exp(-4 * composite + 2)) AS p, win AS y FROM c ORDER BY closed DESC, trade_id DESC LIMIT 60)
SELECT count(*) AS n, round(avg((p - y) * (p - y)), 9) AS brier, round(avg(p), 9) AS mean_predicted, round(avg(y), 9) AS actual, round(avg(p) - avg(y), 9) AS error FROM h"""
)
def probability_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual probability on the 60 newest trades, which a fit would hold out."""
    log = _logged(spark, sf_dir)
    rows = evaluation.calibration_set(log, _WEIGHTS).join(log.select("trade_id", "closed"), "trade_id")
    held = evaluation.held_out(rows, 60, "closed", "trade_id").where("held")
    return rounded(evaluation.probability_check(held, -4.0, 2.0), 9, "brier", "mean_predicted", "actual", "error")


# ---- the signal journal

_PARAMETERS = hashlib.sha256(json.dumps({"max_sector_picks": 2, "risk": 5000}, sort_keys=True).encode()).hexdigest()


@query(
    f"""WITH r AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS scan_id, o_orderdate AS d, o_orderkey AS place, 'T' || o_custkey % 25 AS ticker, CASE o_orderkey % 3 WHEN 0 THEN 'SWING_BREAKOUT' WHEN 1 THEN 'SWING_PULLBACK' ELSE 'LEGACY' END AS strategy_id,
  strftime(date_trunc('week', o_orderdate), '%Y-%m-%dT%H:%M:%S') AS signal_time, o_orderkey % 10 = 0 AS held, o_orderkey % 4 > 0 AS selected, o_totalprice AS entry, o_orderkey % 50 + 1 AS shares, o_orderstatus AS s FROM orders),
n AS (SELECT scan_id, count(*) AS q, count(*) FILTER (selected) AS z FROM r WHERE s = 'F' GROUP BY scan_id),
g AS (SELECT sha256(ticker || '|' || strategy_id || '|' || signal_time || '|{_PARAMETERS}') AS id, *, row_number() OVER (PARTITION BY ticker, strategy_id, signal_time ORDER BY d, place) AS nth FROM r WHERE s = 'F' AND NOT held AND strategy_id LIKE 'SWING_%')
SELECT 'scan:' || sha256(scan_id) AS event_id, 'SCAN' AS event_type, d AS recorded_at, NULL::VARCHAR AS ticker, NULL::DOUBLE AS entry, NULL::BIGINT AS shares, coalesce(max(q), 0) AS qualified, coalesce(max(z), 0)::VARCHAR AS selected
  FROM (SELECT DISTINCT scan_id, d FROM r) LEFT JOIN n USING (scan_id) GROUP BY scan_id, d
UNION ALL SELECT 'signal:' || id, 'SIGNAL', d, ticker, entry, shares, NULL, CASE WHEN selected THEN 'true' ELSE 'false' END FROM g WHERE nth = 1"""
)
def signal_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan on every day with orders, and the first observation of each swing signal among them."""
    o, k = views.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("scan_id")
    scans = o.select(day, F.col("o_orderdate").alias("market_date"), F.col("o_orderdate").alias("recorded_at")).distinct()
    results = o.where("o_orderstatus = 'F'").select(
        day, k.alias("place"), F.concat(F.lit("T"), F.col("o_custkey") % 25).alias("ticker"), F.when(k % 3 == 0, "SWING_BREAKOUT").when(k % 3 == 1, "SWING_PULLBACK").otherwise("LEGACY").alias("strategy_id"),
        F.date_trunc("week", "o_orderdate").alias("signal_time"), (k % 10 == 0).alias("held"), (k % 4 > 0).alias("selected"), F.col("o_totalprice").alias("entry"), (k % 50 + 1).alias("shares"),
    )
    fields = F.from_json("payload", "ticker string, entry double, shares bigint, qualified_signals bigint, selected string")
    rows = journal.build(scans, results, _PARAMETERS).withColumn("p", fields)
    return rows.select("event_id", "event_type", "recorded_at", "p.ticker", "p.entry", "p.shares", F.col("p.qualified_signals").alias("qualified"), "p.selected")


@query(
    """SELECT 't' || o_orderkey AS ts, o_orderkey % 6 AS size, (o_orderkey % 100) / 100.0 AS mean_prob_win, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END::INTEGER AS n_tickers FROM orders
WHERE o_orderkey % 13 > 0 AND o_orderkey % 5 > 0 AND o_orderkey % 6 > 0 AND (o_orderkey % 100) / 100.0 >= 0.55"""
)
def portfolio_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolios in a log of one line an order, some of them cut off or of another event."""
    k = F.col("o_orderkey")
    event = F.when(k % 5 == 0, "scan_started").otherwise("portfolio_built")
    tickers = F.when(k % 3 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    line = F.to_json(F.struct(event.alias("event"), F.concat(F.lit("t"), k).alias("ts"), (k % 6).alias("size"), ((k % 100) / 100.0).alias("mean_prob_win"), tickers.alias("tickers")))
    lines = views.table(spark, sf_dir, "orders").select(F.when(k % 13 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    return readers.portfolio_log(lines).select("ts", "size", "mean_prob_win", F.size("tickers").alias("n_tickers"))


# ---- labels

_STATUSES = ("CALIBRATED", "UNUSED", "HEURISTIC_UNVALIDATED", "", "OTHER")


@query(
    """WITH e AS (SELECT *, event_id % 5 AS s, (event_id % 103) / 100.0 AS v, event_id % 40 - 3 AS old FROM events), u AS (SELECT *, s <> 1 AND v <= 1 AND event_id % 17 > 0 AS ok FROM e)
SELECT CASE WHEN NOT ok THEN 'Unavailable' WHEN s = 0 THEN (round(v * 100)::BIGINT)::VARCHAR || '%' ELSE format('{:.2f}', v::DOUBLE) END AS text,
  CASE WHEN NOT ok THEN 'Probability unavailable' WHEN s = 0 THEN 'Calibrated estimate' WHEN s = 2 THEN 'Heuristic · unvalidated' ELSE 'Unverified model output' END AS label, CASE WHEN NOT ok THEN 'muted' WHEN s = 0 THEN 'cyan' ELSE 'amber' END AS tone,
  CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN old < -1 THEN 'future' WHEN old > 15 THEN 'stale' ELSE 'recent' END AS state, count(*) AS n, sum(CASE WHEN event_id % 7 > 0 AND old >= -1 THEN greatest(0, old) END)::BIGINT AS minutes FROM u GROUP BY ALL"""
)
def evidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by what their status, value and time may be called."""
    i = F.col("event_id")
    status = F.element_at(F.array(*(F.lit(x) for x in _STATUSES)), (i % 5 + 1).cast("int"))
    value = F.when(i % 17 == 0, None).otherwise((i % 103) / 100.0)
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(i % 7 == 0, "").otherwise("Z"))
    now = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (i % 40 - 3) * 60_000_000)
    shown, age = labels.probability_evidence(status, value), labels.snapshot_freshness(text, now)
    rows = views.table(spark, sf_dir, "events").select(*(shown[x].alias(x) for x in ("text", "label", "tone")), *(v.alias(k) for k, v in age.items()))
    return rows.groupBy("text", "label", "tone", "state").agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes"))


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first order."""
    rows = views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return labels.ordered_unique(rows, "o_custkey", "o_orderdate", "o_orderkey")
