"""Registered queries of gates, exit policies, evidence models, fits and walk-forward screens, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.statistics import exact_mean
from tidemark.operators import alpha, coverage, evaluation, exits, factors, fitting, gates, indicators, market, outcomes, selection, sizing
from tidemark.plans import registry, views
from tidemark.plans.registry import _BARS, _INDICATORS, _TRADES, _candidates, _trades, query, rounded

_REGIMES = """m AS (SELECT session, coalesce(avg(CASE WHEN close > ema_50 THEN 1.0 ELSE 0.0 END), 0.5) AS breadth, coalesce(median(adx), 20) AS adx_median,
  coalesce(median(CASE WHEN atr_50_mean > 0 THEN atr / atr_50_mean END), 1) AS atr_ratio FROM ind GROUP BY session),
p AS (SELECT *, coalesce(last_value(CASE WHEN breadth < 0.25 THEN true WHEN breadth >= 0.35 THEN false END IGNORE NULLS) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING), false) AS panic FROM m),
r AS (SELECT *, CASE WHEN panic THEN 'PANIC' WHEN atr_ratio >= 1.3 AND adx_median >= 25 THEN 'EXPANSION' WHEN adx_median < 18 THEN 'RANGE' WHEN breadth >= 0.55 THEN 'TREND_UP' WHEN breadth < 0.45 THEN 'TREND_DOWN' ELSE 'RANGE' END AS regime FROM p),
state AS (SELECT session, regime, regime = 'PANIC' OR coalesce(lag(regime) OVER (ORDER BY session) = regime, false) AS confirmed FROM r)"""


@query(
    f"""WITH {_INDICATORS}, {_REGIMES}, c AS (SELECT i.*, regime, confirmed, CASE WHEN ema_20 > ema_50 AND close > ema_20 THEN 'LONG' WHEN ema_20 <= ema_50 AND close < ema_20 THEN 'SHORT' END AS side FROM ind i JOIN state USING (session)),
g AS (SELECT *, CASE WHEN side = 'LONG' THEN confirmed AND (regime IN ('TREND_UP', 'EXPANSION') OR (regime = 'RANGE' AND coalesce(rsi, 50) <= 55) OR (regime = 'TREND_DOWN' AND close > ema_20 AND ema_20 > ema_50 AND ema_50 > ema_200 AND coalesce(rsi, 50) <= 72))
  ELSE confirmed AND (regime IN ('TREND_DOWN', 'EXPANSION') OR (regime = 'RANGE' AND coalesce(rsi, 50) >= 45)) END AS regime_ok, CASE WHEN side = 'LONG' THEN close > ema_200 ELSE NOT close > ema_200 END AS structure_ok,
  CASE WHEN side = 'SHORT' OR adx < 20 THEN 'INTRADAY' ELSE 'SWING' END AS horizon, CASE regime WHEN 'TREND_UP' THEN 0.5 WHEN 'EXPANSION' THEN 0.52 WHEN 'RANGE' THEN 0.55 WHEN 'TREND_DOWN' THEN 0.58 ELSE 0.99 END AS threshold FROM c WHERE side IS NOT NULL)
SELECT ticker, session, side, regime, regime_ok, structure_ok, horizon, CAST(threshold AS DOUBLE) AS threshold,
  CASE WHEN close / ema_50 - 0.5 >= threshold AND close / ema_20 - 0.85 >= 0.15 THEN 'SELECT' WHEN close / ema_50 - 0.5 < threshold AND close / ema_50 - 0.5 >= 0.45 AND close / ema_20 - 0.85 >= 0 THEN 'WATCH' ELSE 'REJECT' END AS tier,
  concat_ws(',', CASE WHEN adx >= 25 THEN 'strong' END, CASE WHEN NOT regime_ok THEN 'regime' END, CASE WHEN NOT structure_ok THEN 'structure' END) AS notes FROM g"""
)
def candidate_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar's side by its means, then the gates; stand-ins for probability and expectancy are ratios of prices."""
    c = F.col
    found = indicators.add_indicators(views.bars_walk(spark, sf_dir), complete=False)
    state = market.regimes(market.session_metrics(found)).select("session", "regime", "confirmed")
    rows = found.join(state, "session").withColumn("side", gates.direction(c("ema_20") > c("ema_50"), c("close"), c("ema_20"))).where("side is not null")
    rows = rows.withColumns(
        {
            "regime_ok": gates.regime_gate(c("side"), c("regime"), c("confirmed"), c("rsi"), c("close"), c("ema_20"), c("ema_50"), c("ema_200")),
            "structure_ok": gates.structure_gate(c("side"), c("close"), c("ema_200")),
            "horizon": gates.horizon(c("side"), F.lit("MORNING"), c("adx"), intraday=True),
            "threshold": gates.regime_threshold(c("regime")),
        }
    )
    notes = gates.reasons((c("adx") >= 25, "strong"), (~c("regime_ok"), "regime"), (~c("structure_ok"), "structure"))
    tier = gates.tier(c("close") / c("ema_50") - 0.5, c("close") / c("ema_20") - 0.85, F.lit(False), least=c("threshold"))
    return rows.select("ticker", "session", "side", "regime", "regime_ok", "structure_ok", "horizon", "threshold", tier.alias("tier"), F.concat_ws(",", notes).alias("notes"))


_LONGS = f"""{_INDICATORS}, o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY session) AS ord FROM ind),
tr AS (SELECT ticker || '-' || ord AS trade_id, ticker, ord AS sig, close AS entry, close * 0.97 AS stop, close * 1.06 AS target FROM o WHERE ord % 5 = 0)"""


@query(
    f"""WITH RECURSIVE {_LONGS}, pol AS (SELECT unnest(['FIXED', 'ATR_TRAIL', 'CHANDELIER', 'SCALE_OUT']) AS policy),
h AS (SELECT trade_id, policy, entry, stop, CASE policy WHEN 'SCALE_OUT' THEN entry + 3 * (entry - stop) WHEN 'FIXED' THEN target END AS goal, ord - sig AS day, session, open, high, low, close, atr
  FROM tr JOIN o ON o.ticker = tr.ticker AND ord > sig AND ord <= sig + 10 CROSS JOIN pol),
l AS (SELECT *, CASE WHEN policy IN ('ATR_TRAIL', 'CHANDELIER') AND atr > 0 THEN greatest(entry, max(CASE WHEN policy = 'CHANDELIER' THEN high ELSE close END) OVER w) - 2 * atr END AS lv FROM h WINDOW w AS (PARTITION BY trade_id, policy ORDER BY day ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, greatest(stop, coalesce(max(lv) OVER (PARTITION BY trade_id, policy ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), stop)) AS st FROM l),
e AS (SELECT *, CASE WHEN open <= st THEN open WHEN open >= goal THEN open WHEN low <= st THEN st WHEN high >= goal THEN goal END AS px,
  CASE WHEN open <= st THEN CASE WHEN st > stop THEN 'TRAIL_STOP' ELSE 'STOP' END WHEN open >= goal THEN 'TARGET' WHEN low <= st THEN CASE WHEN st > stop THEN 'TRAIL_STOP' ELSE 'STOP' END WHEN high >= goal THEN 'TARGET' END AS why,
  CASE WHEN policy = 'SCALE_OUT' AND NOT open <= st AND (open >= 2 * entry - stop OR (low > st AND high >= 2 * entry - stop)) THEN greatest(2 * entry - stop, open) END AS hp FROM s),
d AS (SELECT trade_id, policy, any_value(entry) AS entry, any_value(stop) AS stop, coalesce(arg_min(px, day) FILTER (px IS NOT NULL), arg_max(close, day)) AS px, coalesce(arg_min(why, day) FILTER (px IS NOT NULL), 'TIME') AS reason,
  coalesce(min(day) FILTER (px IS NOT NULL), max(day)) AS held, min(day) FILTER (hp IS NOT NULL) AS hd, arg_min(hp, day) FILTER (hp IS NOT NULL) AS hp FROM e GROUP BY 1, 2)
SELECT trade_id, policy, round((CASE WHEN coalesce(hd <= held, false) THEN (hp + px) / 2 ELSE px END - entry) / (entry - stop), 4) AS r, reason, CAST(held AS INTEGER) AS bars_held, coalesce(hd <= held, false) AS scaled FROM d"""
)
def exit_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = indicators.add_indicators(views.bars_walk(spark, sf_dir), complete=False).select("ticker", "session", "open", "high", "low", "close", "atr")
    trades = outcomes.with_ordinals(bars).where("ord % 5 = 0").select(
        F.concat_ws("-", "ticker", "ord").alias("trade_id"), "ticker", F.col("ord").alias("signal_ord"), F.col("close").alias("entry"), (F.col("close") * 0.97).alias("stop"), (F.col("close") * 1.06).alias("target"), F.lit(10).alias("time_stop")
    )
    found = exits.exit_policies(trades, bars)
    return found.select("trade_id", "policy", "r", "reason", "bars_held", "scaled")


_BREADTH = """bm AS (SELECT session, close, CASE WHEN count(close) OVER w = 50 THEN avg(close) OVER w END AS m50 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY session ROWS 49 PRECEDING)),
bq AS (SELECT session, avg(CASE WHEN m50 IS NOT NULL THEN CASE WHEN close > m50 THEN 1.0 ELSE 0.0 END END) AS breadth, count(m50) AS breadth_valid, count(*) AS breadth_total FROM bm GROUP BY session),
br AS (SELECT *, breadth_valid / breadth_total AS breadth_coverage, CAST(CASE WHEN breadth_valid / breadth_total < 0.9 THEN 0 WHEN breadth > 0.6 THEN 1 WHEN breadth >= 0.4 THEN 0.5 ELSE 0 END AS DOUBLE) AS breadth_risk_scale FROM bq)"""


@query(f"WITH {_BARS}, {_BREADTH} SELECT session, round(breadth, 8) AS breadth, breadth_valid, breadth_total, round(breadth_coverage, 8) AS breadth_coverage, breadth_risk_scale FROM br")
def breadth_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(alpha.breadth_risk(views.bars_walk(spark, sf_dir)), 8, "breadth", "breadth_coverage")


def _market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, a benchmark and sector indices, as rounded means of closes."""
    bars = views.bars_walk(spark, sf_dir)
    bench = bars.groupBy("session").agg(exact_mean("close").alias("bench"))
    return bars, bench, bars.groupBy("sector", "session").agg(exact_mean("close").alias("close"))


_SECTORS = """bench AS (SELECT session, sum(CAST(round(close * 10000) AS BIGINT)) / count(*) / 10000 AS bench FROM bars GROUP BY session), cal AS (SELECT *, row_number() OVER (ORDER BY session) AS cord FROM bench),
si AS (SELECT sector, session, sum(CAST(round(close * 10000) AS BIGINT)) / count(*) / 10000 AS close FROM bars GROUP BY ALL), sj AS (SELECT * FROM si JOIN cal USING (session)),
sr AS (SELECT session, sector, (close / first_value(close) OVER w) / (bench / first_value(bench) OVER w) - 1 AS sector_rs, count(*) OVER w AS n FROM sj WINDOW w AS (PARTITION BY sector ORDER BY cord RANGE BETWEEN 26 PRECEDING AND CURRENT ROW)),
sf AS (SELECT * EXCLUDE (n, k) FROM (SELECT *, count(*) OVER (PARTITION BY session) AS k, count(*) OVER (PARTITION BY session ORDER BY sector_rs DESC RANGE UNBOUNDED PRECEDING) / 5.0 AS sector_fraction FROM sr WHERE n = 27) WHERE k = 5)"""


@query(f"WITH {_BARS}, {_SECTORS} SELECT session, sector, round(sector_rs, 8) AS sector_rs, CAST(sector_fraction AS DOUBLE) AS sector_fraction FROM sf")
def sector_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bench, indices = _market(spark, sf_dir)
    return rounded(alpha.sector_fractions(indices, bench, lookback=26, declared=5), 8, "sector_rs")


_ADAPTIVE = """am AS (SELECT session, sum(CAST(round(close * 10000) AS BIGINT)) / count(*) / 10000 AS close, avg(atr) AS atr, median(adx) AS adx_median FROM ind GROUP BY session),
aw AS (SELECT *, CASE WHEN count(atr) OVER a = 50 THEN avg(atr) OVER a END AS usual, CASE WHEN count(close) OVER b = 100 THEN avg(close) OVER b END AS mean
  FROM am WINDOW a AS (ORDER BY session ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), b AS (ORDER BY session ROWS 99 PRECEDING)),
ar AS (SELECT session, close > mean AS market_above, CASE WHEN adx_median IS NULL THEN 'UNKNOWN' WHEN usual > 0 AND atr / usual >= 1.3 THEN 'HIGH_VOL' WHEN adx_median < 18 THEN 'RANGE' WHEN close > mean THEN 'BULL' ELSE 'BEAR' END AS adaptive_regime FROM aw),
ad AS (SELECT *, CAST(CASE adaptive_regime WHEN 'BULL' THEN 20 WHEN 'BEAR' THEN 30 WHEN 'HIGH_VOL' THEN 35 WHEN 'RANGE' THEN 0 END AS DOUBLE) AS adaptive_adx_min FROM ar)"""


def _adaptive(found: DataFrame) -> DataFrame:
    rows = found.groupBy("session").agg(exact_mean("close").alias("close"), F.avg("atr").alias("atr"), F.median("adx").alias("adx_median"))
    return alpha.adaptive_regime(rows.select("session", "close", "atr"), rows.select("session", "adx_median"), trend=100)


@query(f"WITH {_INDICATORS}, {_ADAPTIVE} SELECT session, adaptive_regime, adaptive_adx_min FROM ad")
def adaptive_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adaptive(indicators.add_indicators(views.bars_walk(spark, sf_dir), complete=False))


@query(
    f"""WITH {_BARS}, v AS (SELECT session, sum(CAST(round((high - low) / close * 1000000) AS BIGINT)) / count(*) / 1000000 AS close FROM bars GROUP BY session),
x AS (SELECT *, count(close) OVER w AS n, median(close) OVER w AS m FROM v WINDOW w AS (ORDER BY session ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING)) SELECT session, CASE WHEN n = 126 THEN close < m END AS calm FROM x"""
)
def calm_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alpha.calm_volatility(views.bars_walk(spark, sf_dir).groupBy("session").agg(exact_mean((F.col("high") - F.col("low")) / F.col("close"), 6).alias("close")))


_FLOW = f"""flows AS ({views.FLOWS_SQL}), fs AS (SELECT b.ticker, b.session, b.volume, f.* EXCLUDE (ticker, session) FROM bars b LEFT JOIN flows f ON f.ticker = b.ticker AND f.session = b.session),
fw AS (SELECT *, count(delivery_qty) OVER a AS nd, sum(delivery_qty) OVER n AS dn, sum(delivery_qty) OVER o AS do_, sum(total_qty) OVER n AS tn, sum(total_qty) OVER o AS to_, sum(turnover) OVER n AS un, sum(turnover) OVER o AS uo,
  count(fii_net_inr) OVER t AS nf, count(dii_net_inr) OVER t AS ni, sum(fii_net_inr) OVER t AS fii, sum(dii_net_inr) OVER t AS dii, count(volume) OVER a AS nv, sum(volume) OVER n AS vn, sum(volume) OVER o AS vo FROM fs
  WINDOW a AS (PARTITION BY ticker ORDER BY session ROWS 24 PRECEDING), n AS (PARTITION BY ticker ORDER BY session ROWS 4 PRECEDING), o AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING), t AS (PARTITION BY ticker ORDER BY session ROWS 19 PRECEDING)),
fc AS (SELECT ticker, session, CASE WHEN nd = 25 AND do_ > 0 AND uo > 0 THEN dn / tn > do_ / to_ AND (dn / 5) / (do_ / 20) > 1 AND (un / 5) / (uo / 20) > 1 END AS accumulation, CASE WHEN nf = 20 AND ni = 20 THEN fii END AS fii_net,
  CASE WHEN nf = 20 AND ni = 20 THEN dii END AS dii_net, CASE WHEN nv = 25 AND vo > 0 THEN (vn / 5) / (vo / 20) END AS volume_expansion FROM fw),
fx AS (SELECT *, (CAST(fii_net > 0 AS INT) + CAST(dii_net > 0 AS INT) + CAST(accumulation AS INT) + CASE WHEN volume_expansion IS NOT NULL THEN least(1, greatest(0, volume_expansion - 1)) END) / 4 AS flow_score FROM fc)"""


def _flows(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    return alpha.flow_context(bars.select("ticker", "session", "volume").join(views.sql(spark, sf_dir, views.FLOWS_SQL, ("orders", "nation")), ["ticker", "session"], "left"))


@query(f"WITH {_BARS}, {_FLOW} SELECT ticker, session, accumulation, fii_net, dii_net, round(volume_expansion, 8) AS volume_expansion, round(flow_score, 8) AS flow_score FROM fx")
def flow_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _flows(spark, sf_dir, views.bars_walk(spark, sf_dir))
    return rounded(found.select("ticker", "session", "accumulation", "fii_net", "dii_net", "volume_expansion", "flow_score"), 8, "volume_expansion", "flow_score")


_EARNINGS = f"""earn AS ({views.EARNINGS_SQL}), epts AS (SELECT ticker || '|' || strftime(session, '%Y-%m-%d') AS point_id, ticker, session, session + INTERVAL 18 HOUR AS "asof" FROM bars), esess AS (SELECT DISTINCT session FROM bars),
ek AS (SELECT point_id, "asof", session, e.*, row_number() OVER (PARTITION BY point_id, e.period_end ORDER BY known_at DESC) AS rn FROM epts JOIN earn e USING (ticker) WHERE known_at <= "asof" AND period_end <= session),
el AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY period_end DESC) AS place FROM ek WHERE rn = 1) WHERE place = 1),
ages AS (SELECT announced_at, s.session, count(*) FILTER (e2.session + INTERVAL 930 MINUTE >= announced_at AND e2.session <= s.session) AS age FROM (SELECT DISTINCT announced_at, session FROM el) s CROSS JOIN esess e2 GROUP BY ALL),
ec AS (SELECT point_id, period_end AS earnings_period, age AS earnings_age, CASE WHEN age > 20 THEN 'STALE' WHEN abs(expected_eps) < 1e-9 THEN 'ZERO_EXPECTATION_UNSCORABLE' ELSE expectation_kind END AS earnings_status,
  CASE WHEN age <= 20 AND abs(expected_eps) >= 1e-9 THEN (actual_eps - expected_eps) / abs(expected_eps) END AS earnings_surprise FROM el JOIN ages USING (announced_at, session))"""


def _report_points(bars: DataFrame) -> DataFrame:
    return bars.select(F.concat_ws("|", "ticker", F.date_format("session", "yyyy-MM-dd")).alias("point_id"), "ticker", "session", (F.col("session") + F.expr("interval 18 hours")).alias("asof"))


def _earnings(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    feed = views.sql(spark, sf_dir, views.EARNINGS_SQL, ("orders", "nation"))
    return alpha.earnings_context(_report_points(bars), feed, bars.select("session").distinct())


@query(f"WITH {_BARS}, {_EARNINGS} SELECT point_id, earnings_status, round(earnings_surprise, 8) AS earnings_surprise, earnings_age, earnings_period FROM ec")
def earnings_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_earnings(spark, sf_dir, views.bars_walk(spark, sf_dir)), 8, "earnings_surprise")


_GROWTH = f"""{_EARNINGS}, fund AS ({views.GROWTH_SQL}),
gk AS (SELECT point_id, session, g.*, row_number() OVER (PARTITION BY point_id ORDER BY g.period_end DESC) AS place FROM epts JOIN fund g USING (ticker) WHERE known_at <= "asof" AND period_end <= session),
gs AS (SELECT gk.*, ec.earnings_status, ec.earnings_surprise, CASE WHEN earnings_surprise IS NOT NULL AND earnings_period <> period_end THEN 'PERIOD_MISMATCH' WHEN date_diff('day', period_end, session) <= 150 THEN 'OBSERVED' ELSE 'STALE' END AS growth_status FROM gk LEFT JOIN ec USING (point_id) WHERE place = 1),
gc AS (SELECT point_id, growth_status, eps_growth, revenue_growth, guidance_raised, CASE WHEN growth_status = 'OBSERVED' AND earnings_status = 'CONSENSUS' THEN
  (least(1, greatest(0, eps_growth / 0.4)) + least(1, greatest(0, revenue_growth / 0.3)) + CAST(guidance_raised AS INT) + CASE WHEN earnings_surprise IS NOT NULL THEN least(1, greatest(0, earnings_surprise / 0.2)) END) / 4 END AS earnings_score FROM gs)"""


@query(f"WITH {_BARS}, {_GROWTH} SELECT point_id, growth_status, round(eps_growth, 8) AS eps_growth, round(revenue_growth, 8) AS revenue_growth, guidance_raised, round(earnings_score, 8) AS earnings_score FROM gc")
def growth_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.bars_walk(spark, sf_dir)
    feed = views.sql(spark, sf_dir, views.GROWTH_SQL, ("orders", "nation"))
    return rounded(alpha.growth_context(_report_points(bars), feed, _earnings(spark, sf_dir, bars)), 8, "eps_growth", "revenue_growth", "earnings_score")


_MODEL = f"""{_INDICATORS}, {_BREADTH}, {_SECTORS}, {_ADAPTIVE}, {_FLOW}, {_GROWTH}, surv AS ({views.SURVEILLANCE_SQL}),
sk AS (SELECT point_id, s.*, session, row_number() OVER (PARTITION BY point_id, s.effective_date ORDER BY known_at DESC) AS rn FROM epts JOIN surv s USING (ticker) WHERE known_at <= "asof" AND effective_date <= session),
sl AS (SELECT point_id, state AS surveillance_state FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY effective_date DESC) AS place FROM sk WHERE rn = 1) WHERE place = 1 AND valid_until >= session),
px AS (SELECT i.ticker, i.sector, i.session, i.ticker || '|' || strftime(i.session, '%Y-%m-%d') AS point_id, i.high, i.low, i.close, i.adx, vol_avg_20 >= 50 AS liquid, CASE WHEN count(i.close) OVER l = 100 THEN avg(i.close) OVER l END AS sma_200,
  CASE WHEN i.close > max(i.high) OVER (PARTITION BY i.ticker ORDER BY i.session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) THEN 'BREAKOUT' WHEN i.close > ema_20 AND ema_20 > ema_50 THEN 'PULLBACK' END AS "trigger",
  (i.close / lag(i.close, 63) OVER w) / (b.bench / lag(b.bench, 63) OVER w) AS strength FROM ind i JOIN bench b USING (session) WINDOW w AS (PARTITION BY i.ticker ORDER BY i.session), l AS (PARTITION BY i.ticker ORDER BY i.session ROWS 99 PRECEDING)),
pr AS (SELECT ticker, session, (rank() OVER (PARTITION BY session ORDER BY strength) + (count(*) OVER (PARTITION BY session, strength) - 1) / 2.0) / count(*) OVER (PARTITION BY session) * 100 AS rs_percentile FROM px WHERE strength IS NOT NULL),
dr AS (SELECT px.*, rs_percentile, sector_fraction, breadth, breadth_coverage, breadth_risk_scale, market_above, adaptive_regime, adaptive_adx_min, flow_score, earnings_status, earnings_surprise, growth_status, eps_growth, revenue_growth, guidance_raised, earnings_score, surveillance_state
  FROM px LEFT JOIN pr USING (ticker, session) LEFT JOIN sf USING (session, sector) LEFT JOIN br USING (session) LEFT JOIN ad USING (session) LEFT JOIN fx USING (ticker, session) LEFT JOIN ec USING (point_id) LEFT JOIN gc USING (point_id) LEFT JOIN sl USING (point_id))"""
_BASE_REASONS = """CASE WHEN sector IS NULL THEN 'sector_mapping_unavailable' END, CASE WHEN surveillance_state IS NULL THEN 'surveillance_unavailable' END, CASE WHEN surveillance_state <> 'CLEAR' THEN 'surveillance_' || lower(surveillance_state) END,
  CASE WHEN sector_fraction IS NULL THEN 'sector_history_unavailable' END, CASE WHEN sector_fraction > {fraction} THEN 'sector_outside_top_quartile' END"""
_PEAD_REASONS = "CASE WHEN NOT coalesce(earnings_status = 'CONSENSUS', false) THEN 'consensus_surprise_unavailable' END, CASE WHEN earnings_status = 'CONSENSUS' AND earnings_surprise <= 0 THEN 'nonpositive_earnings_surprise' END"
_GATE_REASONS = """CASE WHEN NOT coalesce(market_above, false) THEN 'market_gate_unknown_or_weak' END, CASE WHEN NOT coalesce(breadth_coverage >= 0.9 AND breadth > 0.4, false) THEN 'breadth_gate_unknown_or_weak' END,
  CASE WHEN NOT coalesce(liquid, false) THEN 'liquidity_insufficient' END, CASE WHEN "trigger" IS NULL THEN 'no_timing_trigger' END"""


def _decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each ticker and session with all contexts of the evidence models."""
    c, w = F.col, indicators.by_ticker()
    bars, bench, indices = _market(spark, sf_dir)
    found = indicators.add_indicators(bars, complete=False).join(bench, "session")
    strength = (c("close") / F.lag("close", 63).over(w)) / (c("bench") / F.lag("bench", 63).over(w))
    breakout = c("close") > F.max("high").over(w.rowsBetween(-20, -1))
    rows = found.withColumns(
        {
            "strength": strength,
            "trigger": F.when(breakout, "BREAKOUT").when((c("close") > c("ema_20")) & (c("ema_20") > c("ema_50")), "PULLBACK"),
            "liquid": c("vol_avg_20") >= 50,
            "sma_200": indicators.sliding(c("close"), -99, 0),
            "point_id": F.concat_ws("|", "ticker", F.date_format("session", "yyyy-MM-dd")),
        }
    )
    ranked = rows.where("strength is not null")
    place = F.rank().over(Window.partitionBy("session").orderBy("strength")) + (F.count(F.lit(1)).over(Window.partitionBy("session", "strength")) - 1) / 2.0
    percentile = ranked.select("ticker", "session", (place / F.count(F.lit(1)).over(Window.partitionBy("session")) * 100).alias("rs_percentile"))
    mean = F.avg("bench").over(Window.orderBy("session").rowsBetween(-99, 0))  # one small row a session
    full = F.count("bench").over(Window.orderBy("session").rowsBetween(-99, 0)) == 100
    above = bench.select("session", F.when(full, c("bench") > mean).alias("market_above"))
    reports = _earnings(spark, sf_dir, bars)
    growth = alpha.growth_context(_report_points(bars), views.sql(spark, sf_dir, views.GROWTH_SQL, ("orders", "nation")), reports)
    states = registry.bitemporal.valid_interval(_report_points(bars), views.sql(spark, sf_dir, views.SURVEILLANCE_SQL, ("orders", "nation"))).select("point_id", c("state").alias("surveillance_state"))
    by_session = alpha.breadth_risk(bars).join(above, "session", "left").join(_adaptive(found), "session", "left")
    return (
        rows.select("ticker", "sector", "session", "point_id", "high", "low", "close", "adx", "liquid", "sma_200", "trigger")
        .join(percentile, ["ticker", "session"], "left")
        .join(alpha.sector_fractions(indices, bench, lookback=26, declared=5), ["session", "sector"], "left")
        .join(by_session, "session", "left")
        .join(_flows(spark, sf_dir, bars).select("ticker", "session", "flow_score"), ["ticker", "session"], "left")
        .join(reports, "point_id", "left").join(growth, "point_id", "left").join(states, "point_id", "left")
        .withColumn("triggered", c("trigger").isNotNull())
    )


@query(
    f"""WITH {_MODEL}, q AS (SELECT ticker, session, concat_ws(',', {_BASE_REASONS.format(fraction=0.25)}, {_PEAD_REASONS}, {_GATE_REASONS}) AS reasons FROM dr)
SELECT *, CASE WHEN reasons = '' THEN 'QUALIFIED' ELSE 'REJECTED' END AS status FROM q"""
)
def sector_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decision_rows(spark, sf_dir).withColumn("reasons", F.concat_ws(",", alpha.sector_reasons("COMBINED")))
    return rows.select("ticker", "session", "reasons", F.when(F.col("reasons") == "", "QUALIFIED").otherwise("REJECTED").alias("status"))


_ALPHA = f"""{_MODEL}, fa AS (SELECT *, CASE WHEN high - low > 0 THEN least(1, greatest(0, (close - low) / (high - low))) ELSE 0 END AS structure FROM dr),
sc AS (SELECT *, (rs_percentile / 100 * 0.3 + (1 - sector_fraction + 0.2) * 0.15 + structure * 0.1 + earnings_score * 0.25 + flow_score * 0.2) * 100 AS alpha_score FROM fa),
al AS (SELECT ticker, session, alpha_score, concat_ws(',', {_BASE_REASONS.format(fraction=1.0)}, {_GATE_REASONS}, CASE WHEN NOT coalesce(rs_percentile > 80, false) THEN 'rs_rank_unknown_or_below_threshold' END,
  CASE WHEN NOT coalesce(sector_fraction * 5 <= 3 + 1e-9, false) THEN 'sector_outside_top_n' END, CASE WHEN NOT coalesce(breadth_risk_scale > 0, false) THEN 'breadth_unknown_or_defensive' END,
  CASE WHEN NOT coalesce(earnings_status = 'CONSENSUS' AND earnings_surprise > 0, false) THEN 'pead_consensus_surprise_unknown_or_nonpositive' END,
  CASE WHEN NOT coalesce(growth_status = 'OBSERVED' AND eps_growth > 0.2 AND revenue_growth > 0.15 AND guidance_raised, false) THEN 'earnings_growth_unknown_or_weak' END,
  CASE WHEN NOT coalesce(close > sma_200, false) THEN 'price_below_sma200_or_unknown' END, CASE WHEN flow_score IS NULL THEN 'institutional_flow_unavailable' END, CASE WHEN NOT coalesce(adx >= adaptive_adx_min, false) THEN 'adaptive_adx_unknown_or_weak' END,
  CASE WHEN adaptive_regime = 'RANGE' AND "trigger" = 'BREAKOUT' THEN 'breakout_disabled_in_range' END, CASE WHEN NOT coalesce(alpha_score > 85, false) THEN 'alpha_score_unknown_or_below_threshold' END) AS reasons FROM sc)"""


def _alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alpha.alpha_decisions(_decision_rows(spark, sf_dir).withColumn("base_reasons", alpha.sector_reasons("SECTOR", fraction=1.0)), phase=3)


@query(f"WITH {_ALPHA} SELECT ticker, session, round(alpha_score, 6) AS alpha_score, reasons, CASE WHEN reasons = '' THEN 'QUALIFIED' ELSE 'REJECTED' END AS status FROM al")
def alpha_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alpha(spark, sf_dir).select("ticker", "session", F.round("alpha_score", 6).alias("alpha_score"), F.concat_ws(",", "reasons").alias("reasons"), "status")


@query(f"WITH {_ALPHA} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM al WHERE reasons <> '') GROUP BY reason")
def rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alpha.rejection_counts(_alpha(spark, sf_dir))


@query(
    f"""WITH {_BARS}, {_GROWTH}, surv AS ({views.SURVEILLANCE_SQL}), sk AS (SELECT point_id, s.*, session, row_number() OVER (PARTITION BY point_id, s.effective_date ORDER BY known_at DESC) AS rn FROM epts JOIN surv s USING (ticker) WHERE known_at <= "asof" AND effective_date <= session),
sl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY effective_date DESC) AS place FROM sk WHERE rn = 1) WHERE place = 1)
SELECT e.point_id, CASE WHEN sl.point_id IS NULL THEN 'UNAVAILABLE_NO_KNOWN_OBSERVATION' WHEN valid_until < e.session THEN 'UNAVAILABLE_EXPIRED' WHEN state = 'UNKNOWN' THEN 'UNAVAILABLE_UNKNOWN_STATE' ELSE 'OBSERVED_' || state END AS surveillance,
  CASE WHEN ec.point_id IS NULL THEN 'UNAVAILABLE_NO_KNOWN_OBSERVATION' WHEN earnings_age > 20 THEN 'UNAVAILABLE_STALE_EARNINGS' WHEN earnings_status = 'CONSENSUS' THEN 'OBSERVED_CONSENSUS' ELSE 'UNAVAILABLE_CONSENSUS_OR_NONZERO_EXPECTATION' END AS earnings
FROM epts e LEFT JOIN sl ON sl.point_id = e.point_id LEFT JOIN ec ON ec.point_id = e.point_id"""
)
def feed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.bars_walk(spark, sf_dir)
    points = _report_points(bars)
    states = coverage.interval_states(points, views.sql(spark, sf_dir, views.SURVEILLANCE_SQL, ("orders", "nation")), state="state").select("point_id", F.col("feed_state").alias("surveillance"))
    reports = coverage.earnings_states(points, _earnings(spark, sf_dir, bars)).select("point_id", F.col("feed_state").alias("earnings"))
    return states.join(reports, "point_id")


_FOLD_ROWS = f"""{_BARS}, fc AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS ord FROM (SELECT DISTINCT session FROM bars)), fl AS (SELECT unnest(range(0, (SELECT (max(ord) + 1 - 150) // 30 + 1 FROM fc))) AS fold),
fr AS (SELECT CAST(fold AS VARCHAR) || ':' || ticker AS ticker, fold, b.* EXCLUDE (ticker), ord - fold * 30 < 120 AS train FROM bars b JOIN fc USING (session) JOIN fl ON ord >= fold * 30 AND ord < fold * 30 + 150)"""


@query(
    f"""WITH {_FOLD_ROWS}, {_INDICATORS.replace(_BARS + ",", "").replace("FROM bars WINDOW", "FROM fr WHERE train WINDOW")},
lastrow AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY session DESC) AS back, max(session) OVER (PARTITION BY fold) AS closing FROM ind),
sg AS (SELECT ticker, fold, close AS entry, close - 1.5 * atr AS stop, close + 3.8 * atr AS target FROM lastrow WHERE back = 1 AND session = closing AND atr > 0 AND close > ema_20 AND ema_20 > ema_50),
ts AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY session) AS day FROM fr WHERE NOT train),
dd AS (SELECT s.*, day, open, high, low, close FROM sg s JOIN ts USING (ticker, fold) WHERE day <= 10),
dx AS (SELECT ticker, fold, day, CASE WHEN open <= stop THEN (open - entry) / (entry - stop) WHEN low <= stop THEN -1.0 WHEN open >= target THEN (open - entry) / (entry - stop) WHEN high >= target THEN (target - entry) / (entry - stop) END AS touch, (close - entry) / (entry - stop) AS r_close FROM dd),
dy AS (SELECT ticker, fold, coalesce(arg_min(touch, day) FILTER (touch IS NOT NULL), arg_max(r_close, day)) AS r, coalesce(min(day) FILTER (touch IS NOT NULL), max(day)) AS held FROM dx GROUP BY ALL)
SELECT CAST(s.fold AS INTEGER) AS fold, split_part(s.ticker, ':', 2) AS ticker, round(coalesce(r, 0), 4) AS net_r, CAST(coalesce(held, 0) AS INTEGER) AS bars_held FROM sg s LEFT JOIN dy USING (ticker, fold)"""
)
def walk_forward_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.bars_walk(spark, sf_dir)
    folds = evaluation.session_folds(bars.select("session").distinct(), train=120, test=30, step=30)

    def leaders(found: DataFrame) -> DataFrame:
        return found.where("atr > 0 and close > ema_20 and ema_20 > ema_50").select("fold", "ticker", F.col("close").alias("entry"), (F.col("close") - 1.5 * F.col("atr")).alias("stop"), (F.col("close") + 3.8 * F.col("atr")).alias("target"), F.lit("LONG").alias("direction"), F.lit(10).alias("time_stop"))

    found = evaluation.walk_forward(bars, folds, leaders)
    return found.select("fold", "ticker", "net_r", "bars_held")


@query()
def factor_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of every factor, and weights shrunk towards the range regime's prior."""
    ratios = fitting.factor_ratios(fitting.signed_forward(_candidates(spark, sf_dir)), factors.NAMES, lookback=None)
    found = {r.factor: r.icir for r in ratios.collect()}  # one row a factor
    weights = fitting.shrunk_weights(found, dict(zip(factors.NAMES, factors.REGIME_WEIGHTS["RANGE"])))
    return spark.createDataFrame([(n, round(found.get(n, 0.0), 6), round(w, 6)) for n, w in weights.items()], "factor string, icir double, weight double")


@query()
def ridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fitting.signed_forward(_candidates(spark, sf_dir))
    found = fitting.ridge_weights(rows, factors.NAMES, label="forward")
    return spark.createDataFrame(list(found.items()), "factor string, weight double")


@query(
    f"""WITH {_TRADES}, k AS (SELECT d.trade_id, d.entry_session AS observed, o2.session AS closed, CAST(d.net_r > 0 AS INTEGER) AS win FROM done d JOIN o o2 ON o2.ticker = d.ticker AND o2.ord = d.sig + d.bars_held WHERE d.bars_held > 0),
pn AS (SELECT *, row_number() OVER (ORDER BY observed, closed, trade_id) - 1 AS place, greatest(1, CAST(floor(count(*) OVER () * 0.8) AS BIGINT)) AS cut FROM k WHERE closed < TIMESTAMP '2100-01-01'),
pe AS (SELECT observed AS edge FROM pn WHERE place = cut)
SELECT part, count(*) AS n, CAST(sum(win) AS BIGINT) AS wins FROM (SELECT *, CASE WHEN place >= cut THEN 'holdout' WHEN closed < edge THEN 'fit' ELSE 'purged' END AS part FROM pn CROSS JOIN pe) GROUP BY part"""
)
def purged_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = outcomes.outcomes(*_trades(spark, sf_dir)).where("bars_held > 0")
    rows = done.select("trade_id", F.col("entry_session").alias("observed"), F.col("exit_session").alias("closed"), (F.col("net_r") > 0).cast("int").alias("win"))
    split = fitting.meta_split(rows, F.to_timestamp(F.lit("2100-01-01")))
    return split.groupBy("part").agg(F.count("*").alias("n"), F.sum("win").alias("wins"))


@query()
def reason_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each candidate ranks, with its reward-risk ratio."""
    rows = sizing.with_targets(_candidates(spark, sf_dir)).withColumn("confirmed", F.lit(True))
    texts = gates.score_reasons(F.col("direction"), F.col("regime"), F.col("confirmed"), F.col("rr"))
    return rows.select("ticker", "session", "direction", F.concat_ws(",", texts).alias("reasons"))


@query()
def allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each session's long candidates get under heat, sector, correlation and cash limits."""
    rows = sizing.with_targets(_candidates(spark, sf_dir)).where("direction = 'LONG'").join(alpha.breadth_risk(views.bars_walk(spark, sf_dir)).select("session", "breadth_risk_scale"), "session")
    risk = F.col("close") - F.col("stop")
    quantity = F.when(risk > 0, (F.lit(5_000.0) / risk).cast("long")).otherwise(0)
    wanted = rows.select("session", "ticker", "sector", F.col("composite").alias("rank_score"), quantity.cast("long").alias("quantity"), F.col("close").alias("price"), "stop", F.col("breadth_risk_scale").alias("risk_scale"))
    bars = views.bars_walk(spark, sf_dir)
    pairs = selection.session_correlations(selection.returns(bars), wanted, sessions=bars)
    found = selection.allocate(wanted, pairs)
    return found.withColumn("risk", F.round("risk", 4))
