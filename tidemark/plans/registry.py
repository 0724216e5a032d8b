"""All registered queries of the screening and evidence operators, over views of the given tables.

Each query runs over whole tables.  Its SQL, for DuckDB, is written apart from the operators.  Values
that depend on the order of floating-point sums are rounded in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import curves
from tidemark.operators import bitemporal, coverage, evaluation, factors, indicators, journal, market, outcomes, selection, setups, sizing
from tidemark.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_BARS = f"bars AS ({views.BARS_WALK_SQL})"


def query(sql: str | None = None) -> Callable:
    """Register a function as a query under its name; sql, if any, is its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(views.BARS_WALK_SQL)
def bars_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.bars_walk(spark, sf_dir)


def _ewm(x: str, a: float, start: str = "t", seed_at: int = 0) -> str:
    """Closed form of the recursive mean of x with weight a, seeded at row `seed_at` of each ticker."""
    k = f"({start} - {seed_at})"
    return (
        f"(pow({1 - a!r}, {k}) * sum(CASE WHEN {k} < 0 THEN 0 WHEN {k} = 0 THEN {x} ELSE {a!r} * {x} * pow({1 - a!r}, -{k}) END) OVER (PARTITION BY ticker ORDER BY session ROWS UNBOUNDED PRECEDING))"
    )


def _span(x: str, n: int) -> str:
    return _ewm(x, 2 / (n + 1))


def _wilder(x: str, n: int, seed_at: int = 0) -> str:
    return f"CASE WHEN t >= {n - 1 + seed_at} THEN {_ewm(x, 1 / n, seed_at=seed_at)} END"


def _roll(f: str, x: str, n: int) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY session ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {f}({x}) {w} END"


_INDICATORS = f"""{_BARS},
i0 AS (SELECT *, row_number() OVER w - 1 AS t, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY session)),
i1 AS (SELECT *, greatest(high - low, abs(high - coalesce(pc, close)) * CASE WHEN pc IS NULL THEN 0 ELSE 1 END, abs(low - coalesce(pc, close)) * CASE WHEN pc IS NULL THEN 0 ELSE 1 END) AS tr,
  coalesce(greatest(close - pc, 0), 0) AS up, coalesce(greatest(pc - close, 0), 0) AS dn,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS ndm FROM i0),
i2 AS (SELECT *, {_span("close", 20)} AS ema_20, {_span("close", 50)} AS ema_50, {_span("close", 200)} AS ema_200, {_span("close", 12)} - {_span("close", 26)} AS macd,
  {_wilder("up", 14, 1)} AS ag, {_wilder("dn", 14, 1)} AS al, {_wilder("tr", 14)} AS atr, {_wilder("pdm", 14)} AS ps, {_wilder("ndm", 14)} AS ns FROM i1),
i3 AS (SELECT *, macd - {_span("macd", 9)} AS macd_hist, CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS rsi,
  {_roll("avg", "atr", 50)} AS atr_50_mean, 100 * abs(ps - ns) / nullif(ps + ns, 0) AS dx FROM i2),
i4 AS (SELECT *, {_wilder("coalesce(dx, 0)", 14, 13)} AS adx,
  (rsi - {_roll("min", "rsi", 14)}) / ({_roll("max", "rsi", 14)} - {_roll("min", "rsi", 14)} + 1e-9) AS sr,
  {_roll("avg", "close", 20)} AS mid, {_roll("stddev_pop", "close", 20)} AS sd, {_roll("avg", "volume", 20)} AS vol_avg_20 FROM i3),
ind AS (SELECT *, {_roll("avg", "sr", 3)} * 100 AS stoch_k FROM i4)"""


@query(
    f"""WITH {_INDICATORS}
SELECT ticker, session, round(ema_20, 6) AS ema_20, round(ema_50, 6) AS ema_50, round(ema_200, 6) AS ema_200, round(macd_hist, 6) AS macd_hist, round(rsi, 6) AS rsi, round(stoch_k, 5) AS stoch_k,
  round(atr, 6) AS atr, round(atr_50_mean, 6) AS atr_50_mean, round(adx, 6) AS adx, round(mid + 2 * sd, 6) AS bb_upper, round(4 * sd / mid, 6) AS bb_width, round(vol_avg_20, 6) AS vol_avg_20 FROM ind"""
)
def technical_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("ema_20", "ema_50", "ema_200", "macd_hist", "rsi", "atr", "atr_50_mean", "adx", "bb_upper", "bb_width", "vol_avg_20")
    found = indicators.add_indicators(views.bars_walk(spark, sf_dir), complete=False)
    return rounded(found, 6, *names).withColumn("stoch_k", F.round("stoch_k", 5)).select("ticker", "session", *names, "stoch_k")


#: Supertrend by a recursion over a ticker's bars, and the rank of the range in its last year.
_SUPER = f"""{_INDICATORS}, sb AS (SELECT *, (high + low) / 2 + 3.0 * {_wilder("tr", 10)} AS ub, (high + low) / 2 - 3.0 * {_wilder("tr", 10)} AS lb, list(atr) FILTER (atr IS NOT NULL) OVER (PARTITION BY ticker ORDER BY session ROWS 251 PRECEDING) AS year FROM ind),
sn AS (SELECT ticker, t, pc, close, ub, lb FROM sb WHERE ub IS NOT NULL),
sr AS (SELECT ticker, t, ub AS top, lb AS bottom, close >= lb AS rising FROM sn WHERE t = 9
  UNION ALL SELECT ticker, t, top, bottom, CASE WHEN follows THEN close >= bottom ELSE close > top END FROM (SELECT n.ticker, n.t, n.close, CASE WHEN n.pc > r.top THEN n.ub ELSE least(n.ub, r.top) END AS top,
    CASE WHEN n.pc < r.bottom THEN n.lb ELSE greatest(n.lb, r.bottom) END AS bottom, r.rising OR r.top = r.bottom AS follows FROM sr r JOIN sn n ON n.ticker = r.ticker AND n.t = r.t + 1)),
sup AS (SELECT sb.*, CASE WHEN rising THEN bottom ELSE top END AS supertrend, rising AS super_up, CASE WHEN len(year) >= {indicators.ATR_LEAST} AND atr IS NOT NULL THEN (len(list_filter(year, lambda v: v < atr)) + (len(list_filter(year, lambda v: v = atr)) + 1) / 2.0) * 100.0 / len(year) END AS atr_pctile
  FROM sb LEFT JOIN sr USING (ticker, t)),
whole AS (SELECT * FROM sup WHERE supertrend IS NOT NULL AND adx IS NOT NULL AND rsi IS NOT NULL AND atr IS NOT NULL)"""


@query(f"WITH RECURSIVE {_SUPER} SELECT ticker, session, round(supertrend, 6) AS supertrend, super_up, round(atr_pctile, 6) AS atr_pctile FROM whole")
def supertrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indicators.add_indicators(views.bars_walk(spark, sf_dir))
    return found.select("ticker", "session", F.round("supertrend", 6).alias("supertrend"), "super_up", F.round("atr_pctile", 6).alias("atr_pctile"))


@query(
    f"""WITH {_INDICATORS},
m AS (SELECT session, coalesce(avg(CASE WHEN close > ema_50 THEN 1.0 ELSE 0.0 END), 0.5) AS breadth, coalesce(median(adx), 20) AS adx_median,
  coalesce(median(CASE WHEN atr_50_mean > 0 THEN atr / atr_50_mean END), 1) AS atr_ratio FROM ind GROUP BY session),
p AS (SELECT *, coalesce(last_value(CASE WHEN breadth < 0.25 THEN true WHEN breadth >= 0.35 THEN false END IGNORE NULLS) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING), false) AS panic FROM m),
r AS (SELECT *, CASE WHEN panic THEN 'PANIC' WHEN atr_ratio >= 1.3 AND adx_median >= 25 THEN 'EXPANSION' WHEN adx_median < 18 THEN 'RANGE' WHEN breadth >= 0.55 THEN 'TREND_UP' WHEN breadth < 0.45 THEN 'TREND_DOWN' ELSE 'RANGE' END AS regime FROM p)
SELECT session, round(breadth, 6) AS breadth, round(adx_median, 5) AS adx_median, round(atr_ratio, 5) AS atr_ratio, regime,
  regime = 'PANIC' OR coalesce(lag(regime) OVER (ORDER BY session) = regime, false) AS confirmed FROM r"""
)
def market_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = market.regimes(market.session_metrics(indicators.add_indicators(views.bars_walk(spark, sf_dir), complete=False)))
    return found.select("session", F.round("breadth", 6).alias("breadth"), F.round("adx_median", 5).alias("adx_median"), F.round("atr_ratio", 5).alias("atr_ratio"), "regime", "confirmed")


def _strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.bars_walk(spark, sf_dir)
    return market.relative_strength(bars, market.benchmark(bars))


_RS = f"""{_BARS}, b AS (SELECT session, avg(close) AS bench FROM bars GROUP BY session),
rs AS (SELECT ticker, sector, session, coalesce(round((ln(close / lag(close, 20) OVER w) - ln(bench / lag(bench, 20) OVER w)) * 100, 3), 0) AS rs
  FROM bars JOIN b USING (session) WINDOW w AS (PARTITION BY ticker ORDER BY session))"""


@query(f"WITH {_RS} SELECT * FROM rs")
def relative_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strength(spark, sf_dir).select("ticker", "sector", "session", "rs")


@query(
    f"""WITH {_RS}, s AS (SELECT session, sector, round(median(rs), 3) AS sector_rs FROM rs GROUP BY session, sector)
SELECT *, row_number() OVER (PARTITION BY session ORDER BY sector_rs DESC, sector) AS sector_rank FROM s"""
)
def sector_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.sector_strength(_strength(spark, sf_dir)).withColumn("sector_rank", F.col("sector_rank").cast("long"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every complete bar, long where its Supertrend is up, with factor scores and a composite by regime."""
    bars = views.bars_walk(spark, sf_dir)
    found = indicators.add_indicators(bars)
    rs = market.relative_strength(bars, market.benchmark(bars))
    state = market.regimes(market.session_metrics(found)).select("session", "regime")
    rows = found.join(rs.select("ticker", "session", "rs"), ["ticker", "session"]).join(market.sector_strength(rs), ["session", "sector"]).join(state, "session")
    scored = factors.score_factors(factors.volume_profile(rows.withColumn("direction", F.when(F.col("super_up"), "LONG").otherwise("SHORT"))), n_sectors=5, turnover_floor=50_000.0)
    return factors.composite(factors.blend_cohorts(scored, least=5, full=20))


def _curve(x: str, knots: list[tuple[float, float]]) -> str:
    """A piecewise-linear curve, flat outside its knots."""
    steps = " ".join(f"WHEN {x} < {x1!r} THEN {y0!r} + ({y1 - y0!r}) * (({x} - {x0!r}) / {x1 - x0!r})" for (x0, y0), (x1, y1) in zip(knots, knots[1:]))
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {knots[0][0]!r} THEN {knots[0][1]!r} {steps} ELSE {knots[-1][1]!r} END"


def _clip01(x: str) -> str:
    return f"round(CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, least(1.0, {x})) END, 9)"


def _per_factor(template: str) -> str:
    return ", ".join(template.replace("@", name) for name in factors.NAMES)


_B = "(PARTITION BY ticker ORDER BY session ROWS {} PRECEDING)"
_WEIGHTS = " ".join(f"WHEN '{regime}' THEN " + " + ".join(f"{n} * {w!r}" for n, w in zip(factors.NAMES, weights)) for regime, weights in factors.REGIME_WEIGHTS.items())
#: Factor scores written apart from the operators: the profile by lists, its value area by a recursion, then the curves.
_FACTORS = f"""{_SUPER}, fb AS (SELECT session, avg(close) AS bench FROM bars GROUP BY session),
fr AS (SELECT ticker, sector, session, coalesce(round((ln(close / lag(close, 20) OVER w) - ln(bench / lag(bench, 20) OVER w)) * 100, 3), 0) AS rs FROM bars JOIN fb USING (session) WINDOW w AS (PARTITION BY ticker ORDER BY session)),
fs AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY sector_rs DESC, sector) AS sector_rank FROM (SELECT session, sector, round(median(rs), 3) AS sector_rs FROM fr GROUP BY session, sector)),
fm AS (SELECT session, coalesce(avg(CASE WHEN close > ema_50 THEN 1.0 ELSE 0.0 END), 0.5) AS breadth, coalesce(median(adx), 20) AS adx_median, coalesce(median(CASE WHEN atr_50_mean > 0 THEN atr / atr_50_mean END), 1) AS atr_ratio FROM whole GROUP BY session),
fp AS (SELECT *, coalesce(last_value(CASE WHEN breadth < 0.25 THEN true WHEN breadth >= 0.35 THEN false END IGNORE NULLS) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING), false) AS panic FROM fm),
fg AS (SELECT session, CASE WHEN panic THEN 'PANIC' WHEN atr_ratio >= 1.3 AND adx_median >= 25 THEN 'EXPANSION' WHEN adx_median < 18 THEN 'RANGE' WHEN breadth >= 0.55 THEN 'TREND_UP' WHEN breadth < 0.45 THEN 'TREND_DOWN' ELSE 'RANGE' END AS regime FROM fp),
fw AS (SELECT ticker, session, {_roll("avg", "close * volume", 20)} AS turnover_avg_20, CASE WHEN close > open THEN 1 ELSE 0 END AS up_day, CASE WHEN close < open THEN 1 ELSE 0 END AS dn_day FROM bars),
fq AS (SELECT ticker, session, 4 * sd / mid AS bb_width FROM ind), fz AS (SELECT ticker, session, bb_width, coalesce(bb_width < {_roll("avg", "bb_width", 50)} * 0.85, false) AS bb_squeeze FROM fq),
f0 AS (SELECT whole.*, bb_width, bb_squeeze, turnover_avg_20, up_day, dn_day, rs, sector_rank, regime, CASE WHEN super_up THEN 'LONG' ELSE 'SHORT' END AS direction, list({{'lo': low, 'hi': high, 'v': volume}}) OVER {_B.format(29)} AS win,
  min(low) OVER {_B.format(29)} AS wb, max(high) OVER {_B.format(29)} AS wt
  FROM whole JOIN fz USING (ticker, session) JOIN fw USING (ticker, session) JOIN fr USING (ticker, session) JOIN fs ON fs.session = whole.session AND fs.sector = whole.sector JOIN fg ON fg.session = whole.session),
v0 AS (SELECT ticker, session, close, win, len(win) < 5 OR NOT wt > wb AS flat, list_transform(range(0, 101), lambda i: CASE WHEN i = 100 THEN wt ELSE i * ((wt - wb) / 100) + wb END) AS lv FROM f0),
v1 AS (SELECT *, list_transform(win, lambda x: {{'f': greatest(0, least(99, len(list_filter(lv, lambda l: l < x.lo)) - 1)), 't': greatest(0, least(99, len(list_filter(lv, lambda l: l <= x.hi)))), 'v': x.v}}) AS spread FROM v0 WHERE NOT flat),
v2 AS (SELECT *, list_transform(range(0, 100), lambda b: list_sum(list_transform(spread, lambda x: CASE WHEN x.f <= b AND b <= x.t AND x.v > 0 THEN x.v / greatest(x.t - x.f + 1, 1) ELSE 0.0 END))) AS hist FROM v1),
v3 AS (SELECT ticker, session, lv, hist, list_position(hist, list_max(hist)) AS peak, list_sum(hist) * 0.7 * (1 - 1e-9) AS goal FROM v2),
va AS (SELECT ticker, session, lv, hist, peak, goal, peak AS a, peak AS b, hist[peak] AS held, 0 AS step FROM v3
  UNION ALL SELECT ticker, session, lv, hist, peak, goal, CASE WHEN below >= above * (1 - 1e-9) AND a > 1 THEN a - 1 ELSE a END, CASE WHEN below >= above * (1 - 1e-9) AND a > 1 THEN b ELSE b + 1 END, held + CASE WHEN below >= above * (1 - 1e-9) AND a > 1 THEN below ELSE above END, step + 1
  FROM (SELECT *, CASE WHEN a > 1 THEN hist[a - 1] ELSE -1.0 END AS below, CASE WHEN b < 100 THEN hist[b + 1] ELSE -1.0 END AS above FROM va WHERE held < goal AND (a > 1 OR b < 100))),
vz AS (SELECT ticker, session, arg_max((lv[peak] + lv[peak + 1]) / 2, step) AS poc, arg_max(lv[a], step) AS val, arg_max(lv[b + 1], step) AS vah FROM va GROUP BY ticker, session),
f1 AS (SELECT f0.*, coalesce(poc, close) AS poc, coalesce(val, close * 0.99) AS val, coalesce(vah, close * 1.01) AS vah, CASE WHEN super_up THEN 1.0 ELSE -1.0 END AS sgn, super_up AS lng, coalesce(atr_50_mean, atr) AS base50,
  coalesce(lag(macd_hist) OVER w, 0) AS macd1, CASE WHEN count(bb_width) OVER {_B.format(49)} = 50 THEN avg(bb_width) OVER {_B.format(49)} END AS bw50, max(high) OVER {_B.format(251)} AS h252, min(low) OVER {_B.format(19)} AS l20, lag(close, 63) OVER w AS c63,
  row_number() OVER w AS bar, avg(up_day) OVER {_B.format(19)} AS up20, avg(dn_day) OVER {_B.format(19)} AS dn20, sum(1 - up_day) OVER w AS ub_, sum(1 - dn_day) OVER w AS db_ FROM f0 LEFT JOIN vz USING (ticker, session) WINDOW w AS (PARTITION BY ticker ORDER BY session)),
f2 AS (SELECT *, CASE WHEN up_day = 1 THEN least(10, sum(up_day) OVER (PARTITION BY ticker, ub_ ORDER BY session)) ELSE 0 END AS up_run, CASE WHEN dn_day = 1 THEN least(10, sum(dn_day) OVER (PARTITION BY ticker, db_ ORDER BY session)) ELSE 0 END AS dn_run,
  macd_hist * sgn AS mh, CASE WHEN stoch_k IS NULL OR abs(stoch_k) < 1e-9 THEN 50.0 ELSE stoch_k END AS st, CASE WHEN vol_avg_20 > 0 THEN floor(vol_avg_20) / vol_avg_20 ELSE 1.0 END AS rv, CASE WHEN bb_width IS NULL OR bb_width = 0 THEN 0.05 ELSE bb_width END AS wd FROM f1),
f3 AS (SELECT *, 0.4 + (CASE WHEN (close - ema_20) * sgn > 0 THEN 0.15 ELSE 0 END) + (CASE WHEN (close - ema_50) * sgn > 0 THEN 0.15 ELSE 0 END) + (CASE WHEN (close - ema_200) * sgn > 0 THEN 0.2 ELSE 0 END) + 0.1
    + CASE WHEN (ema_20 - ema_50) * sgn > 0 AND (ema_50 - ema_200) * sgn > 0 THEN 0.05 ELSE 0 END AS t_raw,
  0.30 * (CASE WHEN lng THEN {_curve("rsi", curves.RSI_LONG)} ELSE {_curve("rsi", curves.RSI_SHORT)} END) + 0.25 * (CASE WHEN mh > 0 AND mh > macd1 * sgn THEN 1.0 WHEN mh > 0 THEN 0.5 ELSE 0 END)
    + 0.15 * (CASE WHEN lng THEN {_curve("st", curves.STOCH_LONG)} ELSE {_curve("st", curves.STOCH_SHORT)} END) + 0.20 * ({_curve("adx", curves.ADX)}) + 0.10 * least(1.0, CASE WHEN lng THEN up_run ELSE dn_run END * 0.25) AS m_raw,
  0.55 * (CASE WHEN rv < 0.8 AND base50 > 0 AND atr < 0.85 * base50 THEN 0.4 WHEN rv <= 0.95 THEN 0 WHEN rv < 1.1 THEN pow((rv - 0.95) / 0.15, 2) * (3 - 2 * (rv - 0.95) / 0.15) * 0.1 ELSE 1 END)
    + (CASE WHEN CASE WHEN lng THEN close > poc - 0.3 * atr ELSE close < poc + 0.3 * atr END THEN 0.25 ELSE 0 END) + (CASE WHEN CASE WHEN lng THEN close > val ELSE close < vah END THEN 0.15 ELSE 0 END) + least(0.05, (turnover_avg_20 / 50000.0 - 1) / 4 * 0.05) AS v_raw,
  CASE WHEN atr_50_mean IS NULL OR atr_pctile IS NULL THEN 0.0 ELSE CASE WHEN bb_squeeze THEN least(1.0, calm + 0.15) ELSE calm END END AS c_raw,
  greatest(0.0, CASE WHEN lng THEN 5 - sector_rank ELSE sector_rank - 1 END / 4.0) * 0.6 + greatest(0.0, least(1.0, (rs * sgn + 5) / 10)) * 0.4 AS r_raw,
  greatest(0.0, 1.0 - (CASE WHEN lng THEN CASE WHEN h252 > 0 THEN (h252 - close) / h252 * 100 ELSE 100 END ELSE CASE WHEN close > 0 THEN (close - l20) / close * 100 ELSE 100 END END) / 8.0) * 0.65 + (CASE WHEN coalesce(bw50, wd) > 0 AND wd < coalesce(bw50, wd) * 0.85 THEN 0.35 ELSE 0 END) AS b_raw,
  (CASE WHEN bar >= 64 THEN greatest(0.0, least(1.0, ((CASE WHEN c63 > 0 THEN ln(close / c63) * sgn ELSE 0 END) + 0.10) / 0.20)) ELSE 0.5 END) * 0.5 + (CASE WHEN lng THEN up20 ELSE dn20 END) * 0.3 + (CASE WHEN base50 > 0 THEN greatest(0.0, least(1.0, (atr / base50 - 0.8) / 0.8)) ELSE 0.5 END) * 0.2 AS q_raw
  FROM (SELECT *, CASE WHEN atr_50_mean > 0 AND atr < 0.85 * atr_50_mean THEN 0.70 + 0.30 * greatest(0.0, (50 - atr_pctile) / 50) ELSE greatest(0.0, 0.40 - ((CASE WHEN atr_50_mean > 0 THEN atr / atr_50_mean ELSE 1.0 END) - 1.0) * 0.30) END AS calm FROM f2)),
f4 AS (SELECT ticker, session, direction, regime, poc, val, vah, {_clip01("t_raw")} AS trend, {_clip01("m_raw")} AS momentum, {_clip01("v_raw")} AS volume, {_clip01("c_raw")} AS volatility, {_clip01("r_raw")} AS rs_score, {_clip01("b_raw")} AS breakout, {_clip01("round(q_raw + 1e-9, 4)")} AS quality FROM f3),
f5 AS (SELECT *, count(*) OVER k AS n_, {_per_factor("rank() OVER (PARTITION BY session, direction ORDER BY @) + (count(*) OVER (PARTITION BY session, direction, @) - 1) / 2.0 AS k_@, max(@) OVER k - min(@) OVER k <= 1e-6 AS e_@, greatest(0.0, least(1.0, avg(@) OVER k / 0.5)) AS a_@")} FROM f4 WINDOW k AS (PARTITION BY session, direction)),
f6 AS (SELECT *, CASE WHEN n_ < 5 OR n_ <= 1 THEN 0.0 ELSE greatest(0.0, least(1.0, (n_ - 5) / 15.0)) * 0.4 END AS w_ FROM f5),
f7 AS (SELECT ticker, session, direction, regime, poc, val, vah, {_per_factor("CASE WHEN w_ > 0 THEN greatest(0.0, least(1.0, @ + w_ * ((CASE WHEN e_@ THEN @ ELSE (k_@ - 1.0) / (n_ - 1.0) END) - @) * a_@)) ELSE @ END AS @")} FROM f6),
f8 AS (SELECT *, round(CASE regime {_WEIGHTS} END, 4) AS composite FROM f7)"""


@query(f"WITH RECURSIVE {_FACTORS} SELECT ticker, session, direction, regime, {_per_factor("round(@, 6) AS @").replace("round(quality, 6)", "round(quality, 9)")}, composite, round(poc, 4) AS poc, round(val, 4) AS val, round(vah, 4) AS vah FROM f8")
def factor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(_candidates(spark, sf_dir), 9, "quality"), 6, *factors.NAMES[:-1]).select("ticker", "session", "direction", "regime", *factors.NAMES, "composite", F.round("poc", 4).alias("poc"), F.round("val", 4).alias("val"), F.round("vah", 4).alias("vah"))


#: Long candidates by session, pairs that move together in the 60 sessions up to each, and the greedy choice as a recursion over places.
_CHOSEN = f"""{_FACTORS}, cd AS (SELECT f8.session, f8.ticker, b.sector, composite AS rank_score, row_number() OVER (PARTITION BY f8.session ORDER BY composite DESC, f8.ticker) AS place FROM f8 JOIN bars b ON b.ticker = f8.ticker AND b.session = f8.session WHERE direction = 'LONG'),
sc AS (SELECT session, row_number() OVER (ORDER BY session) AS ord FROM (SELECT DISTINCT session FROM bars)),
re AS (SELECT * FROM (SELECT ticker, session, close / lag(close) OVER (PARTITION BY ticker ORDER BY session) - 1 AS ret FROM bars) WHERE ret IS NOT NULL),
pc AS (SELECT x.session, x.ticker AS a, y.ticker AS b, corr(x.ret, y.ret) OVER w AS c, count(*) OVER w AS n FROM re x JOIN re y ON x.session = y.session AND x.ticker < y.ticker JOIN sc ON sc.session = x.session
  WINDOW w AS (PARTITION BY x.ticker, y.ticker ORDER BY ord RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)),
cl AS (SELECT session, t, list(o) AS near FROM (SELECT session, a AS t, b AS o FROM pc WHERE n >= 20 AND abs(c) > 0.75 UNION ALL SELECT session, b, a FROM pc WHERE n >= 20 AND abs(c) > 0.75) GROUP BY session, t),
cn AS (SELECT cd.*, coalesce(near, []) AS near FROM cd LEFT JOIN cl ON cl.session = cd.session AND cl.t = cd.ticker),
ch AS (SELECT session, CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS taken, CAST([] AS INTEGER[]) AS sectors, false AS ok FROM cn GROUP BY session
  UNION ALL SELECT session, place, CASE WHEN ok THEN list_append(taken, ticker) ELSE taken END, CASE WHEN ok THEN list_append(sectors, sector) ELSE sectors END, ok FROM (SELECT c.session, c.place, c.ticker, c.sector, taken, sectors,
    len(taken) < 6 AND len(list_filter(sectors, lambda s: s = c.sector)) < 2 AND NOT list_has_any(near, taken) AS ok FROM ch JOIN cn c ON c.session = ch.session AND c.place = ch.place + 1)),
chosen AS (SELECT cn.session, cn.ticker, cn.sector, rank_score, false AS held, CAST(cn.place AS INTEGER) AS place FROM cn JOIN ch USING (session, place) WHERE ok)"""


@query(f"WITH RECURSIVE {_CHOSEN} SELECT * FROM chosen")
def portfolio_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).where("direction = 'LONG'").select("session", "ticker", "sector", F.col("composite").alias("rank_score"), F.lit(False).alias("held"))
    bars = views.bars_walk(spark, sf_dir)
    pairs = selection.session_correlations(selection.returns(bars), rows, sessions=bars)
    return selection.select_portfolio(rows, pairs)


@query(
    f"""WITH RECURSIVE {_CHOSEN}, sz AS (SELECT c.session, c.ticker, rank_score, round(close, 6) AS entry, round(close - 1.5 * atr, 2) AS stop, CAST(trunc(5000 / abs(round(close, 6) - round(close - 1.5 * atr, 2))) AS BIGINT) AS shares FROM chosen c JOIN whole w ON w.ticker = c.ticker AND w.session = c.session),
rk AS (SELECT *, round(shares * abs(entry - stop), 2) AS risk FROM sz), tt AS (SELECT *, sum(shares * entry) OVER (PARTITION BY session) AS tv, sum(risk) OVER (PARTITION BY session) AS tr FROM rk),
sf AS (SELECT *, tv > 100000 OR tr > 20000 AS over, least(CASE WHEN tv > 100000 THEN 100000 / tv ELSE 1 END, CASE WHEN tr > 20000 THEN 20000 / tr ELSE 1 END) AS f FROM tt),
sh AS (SELECT *, CASE WHEN over THEN CAST(trunc(shares * f) AS BIGINT) ELSE shares END AS s2 FROM sf), fi AS (SELECT *, CASE WHEN over THEN round(s2 * abs(entry - stop), 2) ELSE risk END AS r2 FROM sh WHERE NOT over OR s2 > 0),
cu AS (SELECT a.session, a.ticker, any_value(a.s2) AS shares, any_value(a.r2) AS risk, sum(b.s2 * b.entry) AS v, sum(b.r2) AS r FROM fi a JOIN fi b ON a.session = b.session AND (b.rank_score, b.ticker) >= (a.rank_score, a.ticker) GROUP BY a.session, a.ticker)
SELECT session, ticker, shares FROM cu WHERE v <= 100000 AND r <= 20000"""
)
def composed_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates chosen by rank, sector and correlation, then held within capital and risk."""
    c = F.col
    rows = _candidates(spark, sf_dir).where("direction = 'LONG'").withColumns({"entry": F.round("close", 6), "stop": F.round(c("close") - 1.5 * c("atr"), 2)})
    gap = F.abs(c("entry") - c("stop"))
    rows = rows.withColumn("shares", (F.lit(5000.0) / gap).cast("long")).withColumn("risk", F.round(c("shares") * gap, 2))
    rows = rows.select("session", "ticker", "sector", c("composite").alias("rank_score"), F.lit(False).alias("held"), "shares", "entry", "stop", "risk")
    bars = views.bars_walk(spark, sf_dir)
    pairs = selection.session_correlations(selection.returns(bars), rows.select("session", "ticker"), sessions=bars)
    return selection.choose_book(rows, pairs, 100_000.0, 20_000.0).select("session", "ticker", "shares")


@query(
    f"""WITH RECURSIVE {_SUPER}, y AS (SELECT ticker, session, open, high, low, close, volume, ema_20, ema_50, atr, row_number() OVER w AS bar, lag(high) OVER w AS high1,
  max(high) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS resistance, max(high) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) AS overhead,
  min(low) OVER b5 AS low5, CASE WHEN count(*) OVER b5 = 5 THEN min(CASE WHEN close >= ema_50 THEN 1 ELSE 0 END) OVER b5 END AS held, list({{'l': low, 'e': ema_20}}) OVER b5 AS recent, rvol
  FROM (SELECT whole.*, volume / nullif(pv, 0) AS rvol FROM whole JOIN (SELECT ticker, session, CASE WHEN count(volume) OVER p = 20 THEN avg(volume) OVER p END AS pv FROM bars WINDOW p AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) USING (ticker, session))
  WINDOW w AS (PARTITION BY ticker ORDER BY session), b5 AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, CASE WHEN close > resistance AND close - resistance <= 0.75 * atr AND rvol >= 1.2 THEN 'BREAKOUT' WHEN len(list_filter(recent, lambda v: v.l <= v.e + 0.25 * atr)) > 0 AND held = 1 AND close > high1 AND close > open THEN 'PULLBACK' END AS strategy
  FROM y WHERE bar >= 150 AND atr > 0 AND high - low > 0 AND high - low <= 2.5 * atr AND (close - low) / (high - low) >= 0.6),
s1 AS (SELECT *, round(least(low5, low) - 0.1 * atr, 2) AS stop FROM k WHERE strategy IS NOT NULL), s2 AS (SELECT *, close - stop AS risk FROM s1 WHERE stop > 0 AND close - stop >= 0.75 * atr AND close - stop <= 3 * atr),
s3 AS (SELECT *, round(CASE WHEN overhead > close + 0.2 * atr THEN least(close + 2 * risk, overhead) ELSE close + 2 * risk END, 2) AS target FROM s2)
SELECT ticker, session, strategy, close AS entry, round(greatest(close - 0.5 * atr, stop + 0.5 * atr), 2) AS entry_min, floor(least(close + 0.5 * atr, (target + 1.5 * stop) / 2.5) * 100) / 100 AS entry_max, stop, target,
  round(close + 3 * risk, 2) AS target2, CASE WHEN strategy = 'BREAKOUT' THEN 15 ELSE 10 END AS time_stop, round(atr, 6) AS atr FROM s3 WHERE (target - close) / risk >= 1.5"""
)
def swing_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.bars_walk(spark, sf_dir)
    return setups.swing_setups(indicators.add_indicators(bars), None).withColumn("atr", F.round("atr", 6))


@query(
    f"""WITH {_BARS}, b AS (SELECT session, avg(close) AS bench FROM bars GROUP BY session),
s AS (SELECT session FROM (SELECT session, bench, avg(bench) OVER w AS m, count(*) OVER w AS n FROM b WINDOW w AS (ORDER BY session ROWS 99 PRECEDING)) WHERE n = 100 AND bench > m),
f0 AS (SELECT *, close - lag(close) OVER w AS d, lag(close) OVER w AS pc, lag(close, 126) OVER w AS past, row_number() OVER w AS n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY session)),
f1 AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
  sum(greatest(coalesce(d, 0), 0) * pow(2.0, n)) OVER r AS up, sum(greatest(-coalesce(d, 0), 0) * pow(2.0, n)) OVER r AS dn,
  avg(close) OVER (PARTITION BY ticker ORDER BY session ROWS 49 PRECEDING) AS sma50, avg(close) OVER (PARTITION BY ticker ORDER BY session ROWS 99 PRECEDING) AS sma100
  FROM f0 WINDOW r AS (PARTITION BY ticker ORDER BY session ROWS 59 PRECEDING)),
f2 AS (SELECT *, avg(tr) OVER (PARTITION BY ticker ORDER BY session ROWS 13 PRECEDING) AS atr_, CASE WHEN dn > 0 THEN 100 - 100 / (1 + up / dn) WHEN up > 0 THEN 100 END AS rsi2_ FROM f1),
p AS (SELECT *, (rank() OVER (PARTITION BY session ORDER BY close / past - 1) + (count(*) OVER (PARTITION BY session, close / past - 1) - 1) / 2.0) / count(*) OVER (PARTITION BY session) AS pct
  FROM f2 JOIN s USING (session) WHERE past > 0),
q AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY rsi2_, ticker) AS place FROM p WHERE pct >= 0.8 AND close > sma50 AND sma50 > sma100 AND rsi2_ < 10 AND atr_ > 0)
SELECT session, ticker, round(close, 2) AS close, round(atr_, 2) AS atr, round(3 * atr_, 2) AS stop_offset, round(pct * 100, 1) AS rs_percentile, round(rsi2_, 1) AS rsi2,
  CAST(trunc(least(5000 / (3 * atr_), 100000 / close)) AS BIGINT) AS shares FROM q WHERE place <= 20"""
)
def leader_pullback(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.bars_walk(spark, sf_dir)
    return setups.leader_pullback(bars, market.benchmark(bars), capital=1_000_000.0, least_turnover=0.0, trend_bars=100)


def _trades(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A long or short trade at every fifth bar of a ticker, risking a twentieth, for at most 10 bars; and the bars."""
    bars = views.bars_walk(spark, sf_dir)
    signals = outcomes.with_ordinals(bars).where("ord % 5 = 0")
    long = F.col("ord") % 10 == 0
    sign = F.when(long, 1.0).otherwise(-1.0)
    return signals.select(
        F.concat_ws("-", "ticker", "ord").alias("trade_id"), "ticker", "sector", F.col("ord").alias("signal_ord"), F.col("session").alias("entry_session"), F.when(long, "LONG").otherwise("SHORT").alias("direction"),
        F.col("close").alias("entry"), (F.col("close") - F.col("close") * 0.05 * sign).alias("stop"), (F.col("close") + F.col("close") * 0.1 * sign).alias("target"), F.lit(10).alias("time_stop"),
    ), bars


_TRADES = f"""{_BARS}, o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY session) AS ord FROM bars),
t AS (SELECT ticker || '-' || ord AS trade_id, ticker, sector, ord AS sig, session AS entry_session, CASE WHEN ord % 10 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, CASE WHEN ord % 10 = 0 THEN 1.0 ELSE -1.0 END AS sg,
  close AS entry, close - close * 0.05 * (CASE WHEN ord % 10 = 0 THEN 1.0 ELSE -1.0 END) AS stop, close + close * 0.1 * (CASE WHEN ord % 10 = 0 THEN 1.0 ELSE -1.0 END) AS target FROM o WHERE ord % 5 = 0),
d AS (SELECT t.*, o.ord - sig AS day, o.session, (o.open - entry) * sg / abs(entry - stop) AS r_open, (o.close - entry) * sg / abs(entry - stop) AS r_close,
  (o.open - stop) * sg <= 0 AS so, (CASE WHEN sg > 0 THEN o.low ELSE o.high END - stop) * sg <= 0 AS sl, (o.open - target) * sg >= 0 AS uo, (CASE WHEN sg > 0 THEN o.high ELSE o.low END - target) * sg >= 0 AS uh
  FROM t JOIN o ON o.ticker = t.ticker AND o.ord > sig AND o.ord <= sig + 10),
e AS (SELECT *, CASE WHEN so THEN r_open WHEN sl THEN -1.0 WHEN uo THEN r_open WHEN uh THEN abs(target - entry) / abs(entry - stop) END AS touch, NOT (so OR sl) AND (uo OR uh) AS hit_ FROM d),
x AS (SELECT trade_id, coalesce(arg_min(touch, day) FILTER (touch IS NOT NULL), arg_max(r_close, day)) AS r, coalesce(arg_min(hit_, day) FILTER (touch IS NOT NULL), false) AS hit,
  coalesce(min(day) FILTER (touch IS NOT NULL), max(day)) AS bars_held FROM e GROUP BY trade_id),
done AS (SELECT t.*, round(coalesce(r, 0), 4) AS net_r, coalesce(hit, false) AS hit, CAST(coalesce(bars_held, 0) AS INTEGER) AS bars_held FROM t LEFT JOIN x USING (trade_id))"""


@query(f"WITH {_TRADES} SELECT trade_id, direction, net_r, hit, bars_held FROM done")
def trade_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.outcomes(*_trades(spark, sf_dir)).select("trade_id", "direction", "net_r", "hit", "bars_held")


@query(
    f"""WITH {_TRADES} SELECT sector, direction, count(*) AS trades, round(avg(net_r), 8) AS mean_r, round(avg(CASE WHEN net_r > 0 THEN 1.0 ELSE 0.0 END), 8) AS win_rate, round(avg(bars_held), 8) AS average_hold,
  round(sum(greatest(net_r, 0)) / nullif(sum(greatest(-net_r, 0)), 0), 6) AS profit_factor, round(quantile_cont(net_r, 0.05), 6) AS p5, round(quantile_cont(net_r, 0.5), 6) AS p50, round(quantile_cont(net_r, 0.95), 6) AS p95,
  round(skewness(net_r), 6) AS skewness, round(kurtosis(net_r), 6) AS excess_kurtosis FROM done GROUP BY sector, direction"""
)
def trade_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outcomes.trade_statistics(outcomes.outcomes(*_trades(spark, sf_dir)), "sector", "direction")
    found = rounded(rounded(found, 8, "mean_r", "win_rate", "average_hold"), 6, "profit_factor", "p5", "p50", "p95", "skewness", "excess_kurtosis")
    return found.select("sector", "direction", "trades", "mean_r", "win_rate", "average_hold", "profit_factor", "p5", "p50", "p95", "skewness", "excess_kurtosis")


@query(
    f"""WITH {_TRADES}, g AS (SELECT 'direction' AS field, direction AS label, net_r FROM done UNION ALL SELECT 'sector', CAST(sector AS VARCHAR), net_r FROM done UNION ALL SELECT 'hit', CAST(hit AS VARCHAR), net_r FROM done)
SELECT field, label, count(*) AS trades, round(avg(net_r), 6) AS mean_r FROM g GROUP BY field, label"""
)
def trade_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes.attribution(outcomes.outcomes(*_trades(spark, sf_dir)), ["direction", "sector", "hit"]), 6, "mean_r")


#: Draws of months by the MD5 of seed, draw and place, and the means that they give.
_DRAWS = """mo AS (SELECT date_trunc('month', entry_session) AS month, sum(net_r) AS total, count(net_r) AS n FROM done GROUP BY 1), mk AS (SELECT *, row_number() OVER (ORDER BY month) - 1 AS k, count(*) OVER () AS m FROM mo),
dr AS (SELECT draw, slot, m, ('0x' || substr(md5('20261002:' || draw || ':' || slot), 1, 8))::BIGINT % m AS k FROM (SELECT draw, m, unnest(range(m)) AS slot FROM range(2000) t(draw) CROSS JOIN (SELECT DISTINCT m FROM mk))),
mm AS (SELECT draw, sum(total) / sum(n) AS mean FROM dr JOIN mk USING (k) GROUP BY draw)"""


@query(f"WITH {_TRADES}, {_DRAWS} SELECT round(quantile_cont(mean, 0.025), 8) AS low, round(quantile_cont(mean, 0.975), 8) AS high FROM mm")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes.cluster_bootstrap(outcomes.outcomes(*_trades(spark, sf_dir))), 8, "low", "high")


@query(
    f"""WITH {_BARS}, n AS (SELECT ticker, session, close / 100 AS nav FROM bars), p AS (SELECT *, greatest(max(nav) OVER (PARTITION BY ticker ORDER BY session ROWS UNBOUNDED PRECEDING), 1) AS peak FROM n)
SELECT ticker, session, round(nav, 8) AS nav, round(peak, 8) AS peak, round(nav / peak - 1, 8) AS drawdown FROM p"""
)
def equity_drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = views.bars_walk(spark, sf_dir).select("ticker", "session", (F.col("close") / 100).alias("nav"))
    return rounded(outcomes.drawdowns(curve, "ticker"), 8, "nav", "peak", "drawdown")


@query(
    f"""WITH {_BARS}, r AS (SELECT * FROM (SELECT ticker, session, close / lag(close) OVER (PARTITION BY ticker ORDER BY session) - 1 AS ret FROM bars) WHERE ret IS NOT NULL),
m AS (SELECT session, avg(ret) AS mret FROM r GROUP BY session)
SELECT ticker, count(*) AS sessions, round(exp(sum(ln(1 + ret))) - 1, 8) AS total_return, round(covar_pop(ret, mret) / var_pop(mret), 6) AS beta, round(avg(ret) * sqrt(252.0) / stddev_samp(ret), 6) AS sharpe,
  round(avg(ret - mret) * sqrt(252.0) / stddev_samp(ret - mret), 6) AS information_ratio FROM r JOIN m USING (session) GROUP BY ticker"""
)
def portfolio_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = selection.returns(views.bars_walk(spark, sf_dir))
    curve = r.join(r.groupBy("session").agg(F.avg("ret").alias("benchmark_return")), "session").withColumnRenamed("ret", "daily_return")
    found = outcomes.portfolio_statistics(curve, "ticker")
    return rounded(rounded(found, 8, "total_return"), 6, "beta", "sharpe", "information_ratio").select("ticker", "sessions", "total_return", "beta", "sharpe", "information_ratio")


@query(
    f"""WITH {_BARS}, r AS (SELECT * FROM (SELECT ticker, session, close / lag(close) OVER (PARTITION BY ticker ORDER BY session) - 1 AS ret FROM bars) WHERE ret IS NOT NULL),
l AS (SELECT DISTINCT session FROM r ORDER BY session DESC LIMIT 60), k AS (SELECT * FROM r JOIN l USING (session))
SELECT x.ticker AS a, y.ticker AS b, round(corr(x.ret, y.ret), 8) AS corr, count(*) AS n FROM k x JOIN k y ON x.session = y.session AND x.ticker < y.ticker GROUP BY 1, 2 HAVING count(*) >= 20"""
)
def pair_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.pair_correlations(selection.returns(views.bars_walk(spark, sf_dir))), 8, "corr")


_FEED = """feed AS (SELECT CAST(o_custkey % 25 AS VARCHAR) AS ticker, date_trunc('month', o_orderdate) AS effective_date, date_trunc('month', o_orderdate) + INTERVAL 60 DAY AS valid_until,
  o_orderdate + (o_orderkey % 40) * INTERVAL 1 DAY AS known_at, CASE o_orderstatus WHEN 'F' THEN 'CLEAR' WHEN 'O' THEN 'ASM' ELSE 'UNKNOWN' END AS state, o_orderkey AS tie FROM orders),
pts AS (SELECT row_number() OVER (ORDER BY ticker, month) AS point_id, ticker, month + INTERVAL 20 DAY AS "asof", month AS session FROM (SELECT DISTINCT CAST(o_custkey % 25 AS VARCHAR) AS ticker, date_trunc('month', o_orderdate) AS month FROM orders)),
k AS (SELECT point_id, "asof", session, f.*, row_number() OVER (PARTITION BY point_id, f.effective_date ORDER BY known_at DESC, tie DESC) AS rn FROM pts JOIN feed f USING (ticker) WHERE known_at <= "asof" AND effective_date <= session),
latest AS (SELECT * FROM k WHERE rn = 1)"""


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    feed = views.feed_rev(spark, sf_dir)
    months = feed.select("ticker", F.col("effective_date").alias("session")).distinct()
    points = months.withColumn("point_id", F.row_number().over(Window.orderBy("ticker", "session")).cast("long")).withColumn("asof", F.col("session") + F.expr("interval 20 days"))
    return points, feed


@query(f"WITH {_FEED} SELECT point_id, count(*) AS revisions, max(known_at) AS newest, sum(CASE WHEN state = 'CLEAR' THEN 1 ELSE 0 END) AS clear FROM latest GROUP BY point_id")
def feed_latest_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bitemporal.latest_known(*_points(spark, sf_dir), ["effective_date"], "effective_date", tie="tie")
    return rows.groupBy("point_id").agg(F.count("*").alias("revisions"), F.max("known_at").alias("newest"), F.sum((F.col("state") == "CLEAR").cast("long")).alias("clear"))


@query(
    f"""WITH {_FEED}, b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY effective_date DESC, known_at DESC, tie DESC) AS place FROM latest)
SELECT point_id, ticker, session, effective_date, state, tie FROM b WHERE place = 1 AND valid_until >= session"""
)
def feed_valid_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitemporal.valid_interval(*_points(spark, sf_dir), tie="tie").select("point_id", "ticker", "session", "effective_date", "state", "tie")


_MEMBERS = """members AS (SELECT n_name AS ticker, min(o_orderdate) AS "start", CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE max(o_orderdate) - INTERVAL 400 DAY END AS "end"
  FROM orders JOIN nation ON n_nationkey = o_custkey % 25 GROUP BY n_name, n_nationkey)"""
_STATES = f"""{_BARS}, {_MEMBERS}, sess AS (SELECT DISTINCT session FROM bars),
cal AS (SELECT session, row_number() OVER (ORDER BY session) AS ord FROM sess), g AS (SELECT ticker, session, ord, open > 0 AND volume >= 0 AND high >= greatest(open, close, low) AND low <= least(open, close) AS good FROM bars JOIN cal USING (session)),
w AS (SELECT *, sum(CAST(good AS INT)) OVER (PARTITION BY ticker ORDER BY ord RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 AS warm FROM g),
st AS (SELECT s.session, m.ticker, CASE WHEN m.ticker NOT IN (SELECT ticker FROM bars) THEN 'UNAVAILABLE_NO_PRICE_SERIES' WHEN good IS NULL THEN 'UNAVAILABLE_NO_PRICE_BAR' WHEN NOT good THEN 'UNAVAILABLE_INVALID_OHLCV'
  WHEN NOT warm THEN 'UNAVAILABLE_PRICE_LOOKBACK' ELSE 'OBSERVED' END AS state
  FROM sess s JOIN members m ON m."start" <= s.session AND (m."end" IS NULL OR s.session < m."end") LEFT JOIN w ON w.ticker = m.ticker AND w.session = s.session)"""


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = views.bars_walk(spark, sf_dir)
    sessions = bars.select("session").distinct()
    return coverage.member_states(bars, sessions, views.members(spark, sf_dir), lookback=20), sessions


@query(
    f"""WITH {_STATES} SELECT session, count(*) AS declared, count(*) FILTER (state IN ('OBSERVED', 'UNAVAILABLE_PRICE_LOOKBACK')) AS valid_bar, count(*) FILTER (state = 'OBSERVED') AS warmed,
  count(*) FILTER (state = 'UNAVAILABLE_NO_PRICE_SERIES') AS no_series, count(*) FILTER (state = 'UNAVAILABLE_NO_PRICE_BAR') AS no_bar, count(*) FILTER (state = 'UNAVAILABLE_INVALID_OHLCV') AS invalid_bar,
  round(count(*) FILTER (state IN ('OBSERVED', 'UNAVAILABLE_PRICE_LOOKBACK')) / count(*), 8) AS coverage FROM st GROUP BY session"""
)
def daily_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coverage.daily_coverage(_states(spark, sf_dir)[0]), 8, "coverage")


@query(
    f"""WITH {_STATES}, i AS (SELECT ticker AS entity, state AS reason, session, ord - row_number() OVER (PARTITION BY ticker, state ORDER BY ord) AS isl FROM st JOIN cal USING (session) WHERE state <> 'OBSERVED')
SELECT entity, reason, min(session) AS "start", max(session) AS "end", count(*) AS audited_sessions FROM i GROUP BY entity, reason, isl"""
)
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, sessions = _states(spark, sf_dir)
    gaps = states.where("state <> 'OBSERVED'").select("session", F.col("ticker").alias("entity"), F.col("state").alias("reason"))
    return coverage.gap_intervals(gaps, sessions, "entity", "reason")


@query(
    """SELECT event_type AS ticker, date_trunc('day', ts) AS session, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume
FROM events GROUP BY 1, 2"""
)
def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    rows = views.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("ticker"), F.date_trunc("day", "ts").alias("session"))
    return rows.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume"))


@query(
    """SELECT o_custkey AS key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1"""
)
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderdate")
    rows = rows.withColumn("version", F.struct("o_orderdate", "o_orderkey"))
    return journal.upsert(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 <> 0"), "key", "version").drop("version")


@query(
    """SELECT CASE WHEN ingested < published THEN 'EARLY' WHEN ingested - published > INTERVAL 900 SECOND THEN 'LATE' ELSE 'ON_TIME' END AS status, count(*) AS n
FROM (SELECT ts AS published, ts + ((event_id * 37) % 2000 - 100) * INTERVAL 1 SECOND AS ingested FROM events) GROUP BY 1"""
)
def recording_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    recorded = F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") * 37) % 2000 - 100)
    events = views.table(spark, sf_dir, "events").select("ts", recorded.alias("recorded"))
    return events.groupBy(journal.recording_delay(F.col("recorded"), F.col("ts")).alias("status")).agg(F.count("*").alias("n"))


_DONE_ROWS = f"WITH {_TRADES}"


def _fold_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.outcomes(*_trades(spark, sf_dir)).withColumn("fold", F.year("entry_session")).withColumn("exit_session", F.col("entry_session"))


@query(
    f"""{_DONE_ROWS}, f AS (SELECT d.*, CAST(year(entry_session) AS INTEGER) AS fold FROM done d), c AS (SELECT *, sum(net_r) OVER (PARTITION BY fold ORDER BY entry_session, trade_id ROWS UNBOUNDED PRECEDING) AS s FROM f),
w AS (SELECT *, s - greatest(0, max(s) OVER (PARTITION BY fold ORDER BY entry_session, trade_id ROWS UNBOUNDED PRECEDING)) AS fall FROM c)
SELECT fold, count(*) AS trades, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(net_r), 6) AS mean_r, round(sum(net_r), 4) AS total_r, round(min(fall), 4) AS worst_fall FROM w GROUP BY ROLLUP (fold)"""
)
def fold_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By its SQL, the row over all folds has the worst of the falls inside single folds; fold_curve_fall has that of the whole curve."""
    found = evaluation.fold_statistics(_fold_trades(spark, sf_dir)).withColumn("worst_fall", F.col("inner_fall")).drop("inner_fall")
    return rounded(rounded(found, 6, "hit_rate", "mean_r"), 4, "total_r", "worst_fall")


@query(
    f"""{_DONE_ROWS}, c AS (SELECT *, sum(net_r) OVER (ORDER BY entry_session, trade_id ROWS UNBOUNDED PRECEDING) AS s FROM done),
w AS (SELECT *, s - greatest(0, max(s) OVER (ORDER BY entry_session, trade_id ROWS UNBOUNDED PRECEDING)) AS fall FROM c)
SELECT count(*) AS trades, round(sum(net_r), 4) AS total_r, round(min(fall), 4) AS worst_fall FROM w"""
)
def fold_curve_fall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row over all folds, with the largest fall of the R curve across them."""
    found = evaluation.fold_statistics(_fold_trades(spark, sf_dir)).where("fold is null").select("trades", "total_r", "worst_fall")
    return rounded(found, 4, "total_r", "worst_fall")


@query(
    f"""WITH {_BARS}, c AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS ord, count(*) OVER () AS n FROM (SELECT DISTINCT session FROM bars)),
f AS (SELECT unnest(range(0, (SELECT (max(n) - 150) // 30 + 1 FROM c))) AS fold)
SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN ord - fold * 30 < 120 THEN 'train' ELSE 'test' END AS role, session FROM c JOIN f ON ord >= fold * 30 AND ord < fold * 30 + 150"""
)
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.session_folds(views.bars_walk(spark, sf_dir).select("session").distinct(), train=120, test=30, step=30)


@query(
    f"""WITH {_BARS}, y AS (SELECT CAST(year(session) AS INTEGER) AS year, min(session) AS a, max(session) AS b FROM bars GROUP BY 1)
SELECT t.year, s.a AS train_from, p.b AS train_to, t.a AS test_from, t.b AS test_to FROM y t JOIN y s ON s.year = t.year - 3 JOIN y p ON p.year = t.year - 1"""
)
def calendar_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calendar_folds(views.bars_walk(spark, sf_dir).select("session").distinct())


@query(
    f"""{_DONE_ROWS}, h AS (SELECT d.*, o.session AS day_session, o.ord - d.sig AS day, o.close AS c FROM done d JOIN o ON o.ticker = d.ticker AND o.ord > d.sig AND o.ord <= d.sig + d.bars_held),
m AS (SELECT *, (c - coalesce(lag(c) OVER (PARTITION BY trade_id ORDER BY day), entry)) * sg * 10 AS mv FROM h),
p AS (SELECT *, coalesce(sum(mv) OVER (PARTITION BY trade_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
SELECT day_session AS session, round(sum(CASE WHEN day = bars_held THEN net_r * abs(entry - stop) * 10 - before ELSE mv END), 4) AS pnl FROM p GROUP BY 1"""
)
def daily_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades, bars = _trades(spark, sf_dir)
    done = outcomes.outcomes(trades, bars).withColumn("shares", F.lit(10))
    return evaluation.daily_profit(done, bars).groupBy("session").agg(F.round(F.sum("pnl"), 4).alias("pnl"))


@query(
    f"""WITH {_BARS}, w AS (SELECT *, lag(session) OVER x AS pv FROM bars WINDOW x AS (PARTITION BY ticker ORDER BY session)),
r AS (SELECT ticker, session, CASE WHEN count(volume) OVER a = 5 THEN avg(volume) OVER a END AS m5, CASE WHEN count(volume) OVER b = 20 THEN avg(volume) OVER b END AS m20 FROM bars
  WINDOW a AS (PARTITION BY ticker ORDER BY session ROWS 4 PRECEDING), b AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING))
SELECT ticker, session, round(m5 / nullif(m20, 0), 8) AS ratio FROM r"""
)
def volume_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.accumulation(views.bars_walk(spark, sf_dir), "volume", "ticker"), 8, "ratio").select("ticker", "session", "ratio")


@query(
    f"""WITH {_BARS}, x AS (SELECT ticker, session, close / lag(close, 10) OVER w - 1 AS f, lead(close, 5) OVER w / close - 1 AS r FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY session)),
k AS (SELECT session, rank() OVER (PARTITION BY session ORDER BY f) + (count(*) OVER (PARTITION BY session, f) - 1) / 2.0 AS a, rank() OVER (PARTITION BY session ORDER BY r) + (count(*) OVER (PARTITION BY session, r) - 1) / 2.0 AS b
  FROM x WHERE f IS NOT NULL AND r IS NOT NULL)
SELECT session, round(coalesce(corr(a, b), 0), 8) AS ic FROM k GROUP BY session HAVING count(*) >= 10"""
)
def information_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("session")
    rows = views.bars_walk(spark, sf_dir).withColumns({"f": F.col("close") / F.lag("close", 10).over(w) - 1, "r": F.lead("close", 5).over(w) / F.col("close") - 1})
    return rounded(evaluation.information_coefficients(rows, "f", "r"), 8, "ic")


@query(
    f"""WITH {_INDICATORS}, k AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY session) - 1 AS ret FROM ind),
q AS (SELECT *, CASE WHEN count(ret) OVER w >= 60 THEN least(20, greatest(0, kurtosis_pop(ret) OVER w)) ELSE 4 END AS ek FROM k WINDOW w AS (PARTITION BY ticker ORDER BY session ROWS 251 PRECEDING))
SELECT ticker, session, round(ek, 5) AS excess_kurtosis FROM q"""
)
def return_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizing.with_kurtosis(views.bars_walk(spark, sf_dir)).select("ticker", "session", F.round("excess_kurtosis", 5).alias("excess_kurtosis"))


@query()
def position_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sizing.with_targets(_candidates(spark, sf_dir)).join(sizing.with_kurtosis(views.bars_walk(spark, sf_dir)).select("ticker", "session", "excess_kurtosis"), ["ticker", "session"])
    sized = sizing.with_size(rows, a=-4.0, b=2.0)
    return sized.select("ticker", "session", "direction", "stop", "target1", "target2", "rr", F.round("probability", 6).alias("probability"), "kelly", "shares", "risk_amount", "expectancy")


FLAGSHIP = factor_scores
