"""Queries of the clock, the book and leadership, and of sources, streams and audits, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import curves
from tidemark.operators import bitemporal, book, clock, coverage, indicators, leadership, market, outcomes, selection, sizing
from tidemark.plans import views
from tidemark.plans.registry import _BARS, _INDICATORS, _STATES, _TRADES, _ewm, _roll, _states, _trades, _wilder, query, rounded
from tidemark.sources import readers
from tidemark.streaming import streams

# ---- the clock

_MINUTE = "(hour(ts + INTERVAL 330 MINUTE) * 60 + minute(ts + INTERVAL 330 MINUTE))"


@query(
    f"""WITH m AS (SELECT *, {_MINUTE} AS m, 915 - {_MINUTE} - CASE WHEN second(ts) > 0 THEN 1 ELSE 0 END AS rest FROM events)
SELECT CASE WHEN m < 555 THEN 'PRE_MARKET' WHEN m < 570 THEN 'OPENING_NOISE' WHEN m < 615 THEN 'PRIME_MORNING' WHEN m < 810 THEN 'MIDDAY_CHOP' WHEN m < 870 THEN 'AFTERNOON_EXPANSION' WHEN m < 930 THEN 'INTRADAY_FREEZE' ELSE 'POST_MARKET' END AS phase,
  CASE WHEN m < 615 THEN 'OPENING_RANGE' WHEN m < 810 THEN 'MIDDAY_CHOP' ELSE 'CLOSING_TREND' END AS label, m >= 555 AND m < 575 AS locked, count(*) AS n, sum(greatest(0, rest))::BIGINT AS minutes_left
FROM m GROUP BY 1, 2, 3"""
)
def market_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the phase of the exchange's day in which they fall."""
    ts = F.col("ts")
    rows = views.table(spark, sf_dir, "events").select(clock.market_phase(ts).alias("phase"), clock.session_label(ts).alias("label"), clock.regime_locked(ts).alias("locked"), clock.minutes_to_square_off(ts).alias("left"))
    return rows.groupBy("phase", "label", "locked").agg(F.count("*").alias("n"), F.sum("left").alias("minutes_left"))


@query(
    f"""WITH {_BARS}, w AS (SELECT max(session) AS d FROM bars)
SELECT h, count(*) AS bars, max(session) AS newest FROM bars, w, (SELECT unnest([570, 930]) AS h) WHERE session < d OR (session = d AND h >= 930) GROUP BY h"""
)
def completed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts as completed on the last session's morning, and at its close."""
    bars = views.bars_walk(spark, sf_dir)
    last = bars.agg(F.max("session").alias("d"))
    found = None
    for minute in (570, 930):
        now = F.to_utc_timestamp(F.col("d") + F.make_dt_interval(mins=F.lit(minute)), clock.ZONE)
        rows = clock.completed_bars(bars.join(last, F.lit(True)), now).agg(F.count("*").alias("bars"), F.max("session").alias("newest")).withColumn("h", F.lit(minute))
        found = rows if found is None else found.unionByName(rows)
    return found.select("h", "bars", "newest")


@query(
    f"""WITH s AS (SELECT event_type AS market, ts, event_id, CAST(user_id % 5 AS VARCHAR) AS regime, {_MINUTE} >= 555 AND {_MINUTE} < 575 AS locked FROM events),
h AS (SELECT *, coalesce(last_value(CASE WHEN NOT locked THEN regime END IGNORE NULLS) OVER (PARTITION BY market ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), regime) AS held FROM s)
SELECT market, held, count(*) AS n FROM h GROUP BY market, held"""
)
def locked_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label that holds at each event, frozen while the market opens."""
    rows = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("market"), "ts", "event_id", (F.col("user_id") % 5).cast("string").alias("regime"))
    held = clock.locked_regimes(rows, order=("ts", "event_id"))
    return held.groupBy("market", "held").agg(F.count("*").alias("n"))


# ---- the book

_SIZED = f"""{_TRADES}, sz AS (SELECT entry_session AS session, ticker, sector, sig % 15 = 0 AS held, sig % 7 AS rank_score, entry, stop, CAST(trunc(5000 / abs(entry - stop)) AS BIGINT) AS shares FROM t),
sr AS (SELECT *, round(shares * abs(entry - stop), 2) AS risk FROM sz)"""


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trade as a candidate of its session with a size; some are held, and ranks tie."""
    trades, _ = _trades(spark, sf_dir)
    gap = F.abs(F.col("entry") - F.col("stop"))
    rows = trades.select(F.col("entry_session").alias("session"), "ticker", "sector", (F.col("signal_ord") % 15 == 0).alias("held"), (F.col("signal_ord") % 7).alias("rank_score"), "entry", "stop", (F.lit(5000.0) / gap).cast("long").alias("shares"))
    return rows.withColumn("risk", F.round(F.col("shares") * gap, 2))


@query(
    f"""WITH {_SIZED}, tot AS (SELECT *, sum(shares * entry) OVER (PARTITION BY session) AS tv, sum(risk) OVER (PARTITION BY session) AS tr FROM sr),
sc AS (SELECT *, tv > 200000 OR tr > 20000 AS over, least(CASE WHEN tv > 200000 THEN 200000 / tv ELSE 1 END, CASE WHEN tr > 20000 THEN 20000 / tr ELSE 1 END) AS f FROM tot),
sh AS (SELECT *, CASE WHEN over THEN greatest(CAST(trunc(shares * f) AS BIGINT), CASE WHEN held THEN 1 ELSE 0 END) ELSE shares END AS s2 FROM sc),
fin AS (SELECT *, CASE WHEN over THEN round(s2 * abs(entry - stop), 2) ELSE risk END AS r2 FROM sh WHERE NOT over OR s2 > 0),
cut AS (SELECT a.session, a.ticker, any_value(a.held) AS held, any_value(a.s2) AS shares, any_value(a.r2) AS risk, sum(b.s2 * b.entry) AS v, sum(b.r2) AS r FROM fin a JOIN fin b ON a.session = b.session AND (b.held OR (b.rank_score, b.ticker) >= (a.rank_score, a.ticker)) GROUP BY a.session, a.ticker)
SELECT session, ticker, held, shares, risk FROM cut WHERE held OR (v <= 200000 AND r <= 20000)"""
)
def portfolio_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's candidates after scaling and trimming to the book's capital and risk."""
    return book.within_limits(_sized(spark, sf_dir), 200_000.0, 20_000.0).select("session", "ticker", "held", "shares", "risk")


@query(
    f"""WITH {_SIZED}, hp AS (SELECT * FROM (SELECT ticker, entry, shares, stop, row_number() OVER (PARTITION BY ticker ORDER BY session) AS p FROM sr WHERE held) WHERE p = 1)
SELECT s.session, s.ticker, hp.ticker IS NOT NULL AS held, coalesce(hp.entry, s.entry) AS entry, coalesce(hp.shares, s.shares) AS shares, round(coalesce(hp.shares, s.shares) * abs(coalesce(hp.entry, s.entry) - coalesce(hp.stop, s.stop)), 2) AS risk
FROM sr s LEFT JOIN hp ON hp.ticker = s.ticker AND s.rank_score < 3 WHERE s.rank_score < 3"""
)
def held_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of tickers with an open position keep the levels of its fill."""
    rows = _sized(spark, sf_dir).withColumn("target", F.col("entry"))
    first = rows.where("held").withColumn("p", F.row_number().over(Window.partitionBy("ticker").orderBy("session"))).where("p = 1")
    found = book.with_held_levels(rows.where("rank_score < 3").drop("held"), first)
    return found.select("session", "ticker", "held", "entry", "shares", "risk")


@query("""SELECT i.o_custkey AS key, max(i.o_orderkey) AS o_orderkey, any_value(c.first) AS first FROM orders i LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) c USING (o_custkey) WHERE o_orderkey % 2 <> 0 GROUP BY 1""")
def replaced_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of customers replaced by a newer one: keys that it lacks go, and what it doesn't say stays."""
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderdate")
    current = orders.where("o_orderkey % 2 = 0").groupBy("key").agg(F.max("o_orderkey").alias("o_orderkey"), F.min("o_orderdate").alias("first"))
    return book.replaced(current, orders.where("o_orderkey % 2 <> 0").groupBy("key").agg(F.max("o_orderkey").alias("o_orderkey")), "key")


_FILLS = f"""{_TRADES}, fl AS (SELECT entry_session AS session, ticker, 1 AS q, entry AS price FROM done WHERE bars_held > 0 AND sg > 0
  UNION ALL SELECT o2.session, d.ticker, -1, o2.close FROM done d JOIN o o2 ON o2.ticker = d.ticker AND o2.ord = d.sig + d.bars_held WHERE d.bars_held > 0 AND sg > 0),
fs AS (SELECT session, ticker, sum(q) * 100 AS moved, sum(-q * 100 * price - 5) AS flow FROM fl GROUP BY 1, 2),
fd AS (SELECT DISTINCT session FROM bars), ft AS (SELECT DISTINCT ticker FROM fl),
fp AS (SELECT fd.session, ft.ticker, coalesce(flow, 0) AS flow, sum(coalesce(moved, 0)) OVER w AS shares, last_value(b.close IGNORE NULLS) OVER w AS mark
  FROM fd CROSS JOIN ft LEFT JOIN fs ON fs.session = fd.session AND fs.ticker = ft.ticker LEFT JOIN bars b ON b.session = fd.session AND b.ticker = ft.ticker WINDOW w AS (PARTITION BY ft.ticker ORDER BY fd.session ROWS UNBOUNDED PRECEDING)),
fc AS (SELECT session, 1000000 + sum(sum(flow)) OVER (ORDER BY session) AS cash, coalesce(sum(shares * mark), 0) AS value, count(*) FILTER (shares <> 0) AS positions FROM fp GROUP BY session),
eq AS (SELECT *, cash + value AS nav, value / (cash + value) AS exposure, (cash + value) / greatest(1000000, max(cash + value) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM fc)"""


def _equity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The equity of all long trades, 100 shares each, and the bars."""
    trades, bars = _trades(spark, sf_dir)
    done = outcomes.outcomes(trades, bars).where("bars_held > 0 AND direction = 'LONG'")
    closes = bars.select("ticker", F.col("session").alias("exit_session"), F.col("close").alias("paid"))
    done = done.select("ticker", "entry_session", "exit_session", "entry").join(closes, ["ticker", "exit_session"])
    sides = F.inline(F.array(F.struct(F.col("entry_session").alias("session"), F.lit("BUY").alias("side"), F.col("entry").alias("price")), F.struct(F.col("exit_session").alias("session"), F.lit("SELL").alias("side"), F.col("paid").alias("price"))))
    fills = done.select("ticker", sides).withColumns({"quantity": F.lit(100), "fees": F.lit(5.0)})
    return book.equity_from_fills(fills, bars, 1_000_000.0), bars


@query(f"WITH {_FILLS} SELECT session, round(cash, 4) AS cash, round(nav, 4) AS nav, CAST(positions AS BIGINT) AS positions, round(exposure, 8) AS exposure, round(drawdown, 8) AS drawdown FROM eq")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rounded(rounded(_equity(spark, sf_dir)[0], 4, "cash", "nav"), 8, "exposure", "drawdown")
    return found.withColumn("positions", F.col("positions").cast("long")).select("session", "cash", "nav", "positions", "exposure", "drawdown")


@query(
    f"""WITH {_FILLS}, bm AS (SELECT session, avg(open) AS o, avg(close) AS c FROM bars GROUP BY session),
mb AS (SELECT session, o, c, coalesce(lag(c) OVER w, o) AS pc, coalesce(lag(exposure) OVER w, 0) AS pe FROM eq JOIN bm USING (session) WINDOW w AS (ORDER BY session))
SELECT session, round(c / pc - 1, 8) AS benchmark_return, round(pe * (o / pc - 1) + pe * (c / o - 1), 8) AS matched_return FROM mb"""
)
def matched_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the benchmark returned at the book's own exposure."""
    curve, bars = _equity(spark, sf_dir)
    bench = bars.groupBy("session").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))
    return rounded(book.matched_benchmark(curve, bench), 8, "benchmark_return", "matched_return").select("session", "benchmark_return", "matched_return")


@query(
    f"""WITH {_TRADES}, bm AS (SELECT session, avg(close) AS c FROM bars GROUP BY session), ex AS (SELECT d.*, o2.session AS out_session, o2.close AS out_price FROM done d JOIN o o2 ON o2.ticker = d.ticker AND o2.ord = d.sig + d.bars_held WHERE d.bars_held > 0)
SELECT trade_id, round(sg * (out_price / entry - 1), 8) AS net_return, round(y.c / x.c - 1, 8) AS benchmark_return, round(sg * (out_price / entry - 1) - (y.c / x.c - 1), 8) AS excess_return
FROM ex JOIN bm x ON x.session = entry_session JOIN bm y ON y.session = out_session"""
)
def excess_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades, bars = _trades(spark, sf_dir)
    done = outcomes.outcomes(trades, bars).where("bars_held > 0")
    done = done.join(bars.select("ticker", F.col("session").alias("exit_session"), F.col("close").alias("exit_price")), ["ticker", "exit_session"])
    bench = bars.groupBy("session").agg(F.avg("close").alias("close"))
    return rounded(book.excess_returns(done, bench), 8, "net_return", "benchmark_return", "excess_return").select("trade_id", "net_return", "benchmark_return", "excess_return")


@query(
    f"""WITH {_FILLS}, bk AS (SELECT fp.session, b.sector, shares * mark AS value, shares * mark * 0.05 AS risk FROM fp JOIN (SELECT DISTINCT ticker, sector FROM bars) b USING (ticker) WHERE shares <> 0),
bs AS (SELECT session, sector, sum(value) AS value, sum(risk) AS risk, count(*) AS n FROM bk GROUP BY 1, 2)
SELECT session, CAST(sum(n) AS BIGINT) AS positions, round(sum(risk) / any_value(nav), 8) AS heat, round(max(bs.value) / any_value(nav), 8) AS largest_sector FROM bs JOIN eq USING (session) GROUP BY session"""
)
def book_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open risk and the largest sector of the long trades' book, a twentieth of a position being at risk."""
    curve, bars = _equity(spark, sf_dir)
    trades, _ = _trades(spark, sf_dir)
    done = outcomes.outcomes(trades, bars).where("bars_held > 0 AND direction = 'LONG'")
    moves = done.select("ticker", F.inline(F.array(F.struct(F.col("entry_session").alias("session"), F.lit(100).alias("moved")), F.struct(F.col("exit_session").alias("session"), F.lit(-100).alias("moved")))))
    marks = bars.select("ticker", "sector", "session", "close")
    # positions at every session: the sessions of all tickers that are in the book
    sessions = bars.select("session").distinct()
    held = moves.groupBy("ticker", "session").agg(F.sum("moved").alias("moved"))
    sector = bars.groupBy("ticker").agg(F.first("sector").alias("sector"))
    last = sessions.agg(F.sort_array(F.collect_list("session")).alias("all"))  # one small row a session
    spine = held.select("ticker").distinct().join(sector, "ticker").join(last, F.lit(True)).select("ticker", "sector", F.explode("all").alias("session"))
    w = Window.partitionBy("ticker").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    rows = spine.join(held, ["ticker", "session"], "left").join(marks.drop("sector"), ["ticker", "session"], "left")
    rows = rows.select("session", "sector", F.sum(F.coalesce("moved", F.lit(0))).over(w).alias("shares"), F.last("close", ignorenulls=True).over(w).alias("mark")).where("shares != 0")
    found = book.exposures(rows.select("session", "sector", (F.col("shares") * F.col("mark")).alias("value"), (F.col("shares") * F.col("mark") * 0.05).alias("risk")), curve)
    return rounded(found, 8, "heat", "largest_sector")


@query(
    f"""WITH {_INDICATORS}, m AS (SELECT session, avg(close) / 100 AS nav, coalesce(avg(CASE WHEN close > ema_50 THEN 1.0 ELSE 0.0 END), 0.5) AS b FROM ind GROUP BY session),
k AS (SELECT *, CASE WHEN b < 0.25 THEN 'PANIC' WHEN b >= 0.55 THEN 'TREND_UP' WHEN b < 0.45 THEN 'TREND_DOWN' ELSE 'RANGE' END AS regime, max(nav) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) AS peak FROM m),
d AS (SELECT *, greatest(0, (peak - nav) / peak) AS dd FROM k)
SELECT session, regime, round(dd, 8) AS drawdown, CASE WHEN regime = 'PANIC' THEN CASE WHEN dd >= 0.10 THEN 0 WHEN dd >= 0.05 THEN 0.25 WHEN dd >= 0.02 THEN 0.5 ELSE 1 END
  ELSE round(CASE regime WHEN 'TREND_UP' THEN 1.0 WHEN 'RANGE' THEN 0.75 ELSE 0.5 END * CASE WHEN dd > 0.02 THEN greatest(0.5, 1 - dd * 3) ELSE 1 END, 4) END::DOUBLE AS fraction,
  round(least(2.0, greatest(0.25, nav)), 10) AS nav_fraction, round(0.8 + 0.2 * least(1, greatest(0, b)), 3) AS size_scale FROM d"""
)
def capital_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of capital that each session's regime and drawdown leave."""
    found = indicators.add_indicators(views.bars_walk(spark, sf_dir), complete=False)
    rows = market.session_metrics(found).join(found.groupBy("session").agg((F.avg("close") / 100).alias("nav")), "session")
    b = F.col("breadth")
    label = F.when(b < 0.25, "PANIC").when(b >= 0.55, "TREND_UP").when(b < 0.45, "TREND_DOWN").otherwise("RANGE")
    out = book.capital_fraction(rows.withColumn("regime", label)).withColumns({"nav_fraction": book.nav_fraction(F.col("nav"), 1.0), "size_scale": book.confidence_scale(b)})
    return rounded(rounded(out, 8, "drawdown"), 10, "nav_fraction").select("session", "regime", "drawdown", "fraction", "nav_fraction", "size_scale")


@query(
    f"""WITH {_INDICATORS}, q AS (SELECT *, (rank() OVER w + (count(*) OVER (PARTITION BY ticker, session) - 1) / 2.0) AS z, row_number() OVER (PARTITION BY ticker ORDER BY session) AS n FROM ind WHERE atr IS NOT NULL WINDOW w AS (PARTITION BY session ORDER BY atr)),
s AS (SELECT ticker, session, close, open, atr, vol_avg_20, CASE WHEN n % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, CASE n % 3 WHEN 0 THEN 'OPENING_RANGE' WHEN 1 THEN 'MIDDAY_CHOP' ELSE 'CLOSING_TREND' END AS label,
  CASE n % 4 WHEN 0 THEN 'RANGE' WHEN 1 THEN 'TREND_DOWN' ELSE 'TREND_UP' END AS regime, (n % 11) / 10.0 AS composite, (n % 101)::DOUBLE AS pct FROM q)
SELECT ticker, session, round(least(1, greatest(0, composite * CASE label WHEN 'OPENING_RANGE' THEN 1.0 WHEN 'MIDDAY_CHOP' THEN 0.92 ELSE 1.05 END * CASE WHEN regime = 'RANGE' THEN 0.88 ELSE 1 END * CASE WHEN regime = 'TREND_DOWN' AND direction = 'LONG' THEN 0.9 ELSE 1 END)), 6) AS adjusted,
  round(close + CASE WHEN direction = 'LONG' THEN -1 ELSE 1 END * (1 + pct / 100) * atr, 1) AS trail_stop, CAST(CASE WHEN pct < 30 THEN 4 WHEN pct < 60 THEN 7 ELSE 12 END AS INTEGER) AS time_stop,
  coalesce(vol_avg_20 < 1000, false) AS illiquid, round((close - open) / open * 100, 6) AS change_pct FROM s"""
)
def trade_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite multipliers, trailing and time stops, and the liquidity gate on every bar with a range."""
    found = indicators.add_indicators(views.bars_walk(spark, sf_dir), complete=False).where("atr is not null")
    n = F.row_number().over(Window.partitionBy("ticker").orderBy("session"))
    rows = found.withColumn("n", n).withColumns(
        {
            "direction": F.when(F.col("n") % 2 == 0, "LONG").otherwise("SHORT"), "label": F.when(F.col("n") % 3 == 0, "OPENING_RANGE").when(F.col("n") % 3 == 1, "MIDDAY_CHOP").otherwise("CLOSING_TREND"),
            "regime": F.when(F.col("n") % 4 == 0, "RANGE").when(F.col("n") % 4 == 1, "TREND_DOWN").otherwise("TREND_UP"), "composite": (F.col("n") % 11) / 10.0, "pct": (F.col("n") % 101).cast("double"),
        }
    )
    trail, bars = book.trade_management(F.col("direction"), F.col("close"), F.col("atr"), F.col("pct"))
    # the stop is shown to a tenth, as two roundings of one cent can differ between engines
    sign = F.when(F.col("direction") == "LONG", -1.0).otherwise(1.0)
    shown = F.when(F.abs(trail - (F.col("close") + sign * (1 + F.col("pct") / 100) * F.col("atr"))) <= 0.0051, F.round(F.col("close") + sign * (1 + F.col("pct") / 100) * F.col("atr"), 1))
    return rows.select(
        "ticker", "session", F.round(book.adjusted_composite(F.col("composite"), F.col("label"), F.col("regime"), F.col("direction")), 6).alias("adjusted"), shown.alias("trail_stop"), bars.alias("time_stop"),
        book.liquidity_reason(1000, 0.0).isNotNull().alias("illiquid"), F.round((F.col("close") - F.col("open")) / F.col("open") * 100, 6).alias("change_pct"),
    )


# ---- leadership

#: The trades' SQL after its bars, with their outcomes as tx.
_TRADES_TAIL = _TRADES.removeprefix(f"{_BARS}, ") + ", tx AS (SELECT trade_id, ticker, entry_session, net_r FROM done)"
_LEADERS = f"""{_INDICATORS}, bm AS (SELECT session, avg(close) AS bench, row_number() OVER (ORDER BY session) AS ord FROM bars GROUP BY session),
l0 AS (SELECT ind.*, bench, ord, {_wilder("tr", 20)} AS atr20, 4 * sd / mid AS width FROM ind JOIN bm USING (session)),
l1 AS (SELECT *, CASE WHEN count(atr20) OVER y >= 60 THEN list(atr20) FILTER (atr20 IS NOT NULL) OVER y END AS past, avg(atr20) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS usual20, lag(width) OVER w AS pwidth,
  avg(close * volume) OVER (PARTITION BY ticker ORDER BY session ROWS 19 PRECEDING) AS turnover, avg(volume) OVER (PARTITION BY ticker ORDER BY session ROWS 19 PRECEDING) AS shares
  FROM l0 WINDOW w AS (PARTITION BY ticker ORDER BY session), y AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
l2 AS (SELECT x.*, (x.close / a.close) / (x.bench / a.bench) - 1 AS raw63, (x.close / b.close) / (x.bench / b.bench) - 1 AS raw252, count(*) OVER (PARTITION BY x.ticker ORDER BY x.ord RANGE BETWEEN 63 PRECEDING AND CURRENT ROW) AS n63,
  count(*) OVER (PARTITION BY x.ticker ORDER BY x.ord RANGE BETWEEN 252 PRECEDING AND CURRENT ROW) AS n252 FROM l1 x LEFT JOIN l1 a ON a.ticker = x.ticker AND a.ord = x.ord - 63 LEFT JOIN l1 b ON b.ticker = x.ticker AND b.ord = x.ord - 252),
l3 AS (SELECT *, CASE WHEN n63 = 64 THEN raw63 END AS rs_63, CASE WHEN n252 = 253 THEN raw252 END AS rs_252 FROM l2 WHERE t >= 49 AND turnover >= 10000 AND shares >= 0),
l4 AS (SELECT *, CASE WHEN rs_63 IS NOT NULL THEN (rank() OVER (PARTITION BY session, rs_63 IS NULL ORDER BY rs_63) + (count(*) OVER (PARTITION BY session, rs_63) - 1) / 2.0) / count(rs_63) OVER (PARTITION BY session) * 100 END AS p63,
  avg(CASE WHEN close > ema_50 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY session) AS b50, avg(CASE WHEN close > ema_200 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY session) AS b200, count(*) OVER (PARTITION BY session) AS n_all FROM l3),
pe AS (SELECT x.ticker, x.session, count(y.rs_63) AS peers, CASE WHEN count(y.rs_63) >= 2 THEN median(y.rs_63) END AS peer_rs FROM l4 x LEFT JOIN l4 y ON y.session = x.session AND y.sector = x.sector AND y.ticker <> x.ticker GROUP BY 1, 2),
ld AS (SELECT l4.*, peers, peer_rs, len(list_filter(past, lambda v: v < atr20)) * 100.0 / len(past) AS atr_pct, CASE WHEN usual20 > 0 THEN atr20 / usual20 END AS expansion FROM l4 JOIN pe USING (ticker, session))"""


@query(
    f"""WITH {_LEADERS} SELECT ticker, session, round(rs_63, 8) AS rs_63, round(rs_252, 8) AS rs_252, round(p63, 6) AS rs_63_percentile, close > ema_200 AS above_ema200, round(atr_pct, 5) AS atr20_percentile, round(expansion, 6) AS atr20_expansion,
  width > pwidth AS bandwidth_expanding, CAST(peers AS INTEGER) AS sector_peer_count, round(peer_rs, 8) AS sector_rs_63, round(b50, 8) AS breadth_ema50, round(b200, 8) AS breadth_ema200, n_all AS rank_universe_count FROM ld"""
)
def leadership_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, peers and volatility state of the liquid tickers of every session."""
    bars = views.bars_walk(spark, sf_dir)
    found = leadership.leadership(bars, market.benchmark(bars), 10_000.0, 0.0)
    found = rounded(rounded(found, 8, "rs_63", "rs_252", "sector_rs_63", "breadth_ema50", "breadth_ema200"), 6, "rs_63_percentile", "atr20_expansion").withColumn("atr20_percentile", F.round("atr20_percentile", 5))
    return found.select("ticker", "session", "rs_63", "rs_252", "rs_63_percentile", "above_ema200", "atr20_percentile", "atr20_expansion", "bandwidth_expanding", "sector_peer_count", "sector_rs_63", "breadth_ema50", "breadth_ema200", "rank_universe_count")


@query(
    f"""WITH {_LEADERS}, {_TRADES_TAIL},
po AS (SELECT session AS entry_session, lag(session) OVER (ORDER BY session) AS sig_session FROM (SELECT DISTINCT session FROM bars)),
tl AS (SELECT d.net_r, ld.rs_63, p63, peer_rs, close / nullif(ema_200, 0) - 1 AS far, b50, atr_pct, ld.ticker IS NULL AS none FROM (SELECT * FROM tx) d LEFT JOIN po USING (entry_session) LEFT JOIN ld ON ld.ticker = d.ticker AND ld.session = po.sig_session),
g AS (SELECT 'rs63_decile' AS field, CASE WHEN p63 IS NULL THEN 'UNKNOWN' ELSE CAST(least(90, CAST(floor(p63 / 10) * 10 AS INTEGER)) AS VARCHAR) || '-' || CAST(least(90, CAST(floor(p63 / 10) * 10 AS INTEGER)) + 10 AS VARCHAR) END AS label, net_r FROM tl
UNION ALL SELECT 'sector_alignment', CASE WHEN peer_rs IS NULL THEN 'UNKNOWN' WHEN peer_rs > 0 THEN 'POSITIVE_PEER_RS' ELSE 'NONPOSITIVE_PEER_RS' END, net_r FROM tl
UNION ALL SELECT 'leadership_distance', CASE WHEN far IS NULL THEN 'UNKNOWN' WHEN far < 0.1 THEN '0-10%' WHEN far < 0.2 THEN '10-20%' WHEN far < 0.4 THEN '20-40%' ELSE '40%+' END, net_r FROM tl
UNION ALL SELECT 'breadth50_bucket', CASE WHEN b50 IS NULL THEN 'UNKNOWN' ELSE CAST(least(80, CAST(floor(b50 * 100 / 20) * 20 AS INTEGER)) AS VARCHAR) || '-' || CAST(least(80, CAST(floor(b50 * 100 / 20) * 20 AS INTEGER)) + 20 AS VARCHAR) END, net_r FROM tl)
SELECT field, label, count(*) AS trades, round(avg(net_r), 6) AS mean_r FROM g GROUP BY field, label""".replace("(SELECT * FROM tx)", "tx")
)
def structural_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades by what was known of their ticker at the session before the entry."""
    trades, bars = _trades(spark, sf_dir)
    done = leadership.annotated(outcomes.outcomes(trades, bars), leadership.leadership(bars, market.benchmark(bars), 10_000.0, 0.0), bars)
    return rounded(outcomes.attribution(done, ["rs63_decile", "sector_alignment", "leadership_distance", "breadth50_bucket"]), 6, "mean_r")


@query(
    f"""WITH {_INDICATORS}, v AS (SELECT ticker, session, close, ema_200, atr / close AS vol FROM ind), u AS (SELECT *, median(vol) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS usual FROM v),
b AS (SELECT session, coalesce(avg(CASE WHEN close > ema_50 THEN 1.0 ELSE 0.0 END), 0.5) AS breadth FROM ind GROUP BY session)
SELECT CASE WHEN breadth >= 0.55 THEN 'STRONG' WHEN breadth < 0.45 THEN 'WEAK' ELSE 'NEUTRAL' END AS breadth_regime, CASE WHEN ema_200 IS NULL THEN 'UNKNOWN' WHEN round(close, 6) >= round(ema_200, 6) THEN 'ABOVE_EMA200' ELSE 'BELOW_EMA200' END AS benchmark_trend,
  CASE WHEN usual IS NULL THEN 'UNKNOWN' WHEN round(vol, 10) > round(usual, 10) THEN 'HIGH' ELSE 'LOW' END AS volatility_regime, count(*) AS n FROM u JOIN b USING (session) GROUP BY 1, 2, 3"""
)
def context_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth, trend and volatility labels of every ticker and session."""
    found = indicators.add_indicators(views.bars_walk(spark, sf_dir), complete=False)
    rows = leadership.usual_volatility(found).join(market.session_metrics(found).select("session", "breadth"), "session")
    labels = leadership.context_labels(F.col("breadth"), F.round("close", 6), F.round("ema_200", 6), F.round("volatility", 10), F.round("usual", 10))
    return rows.select(*(v.alias(k) for k, v in labels.items())).groupBy(*labels).agg(F.count("*").alias("n"))


# ---- outcomes and statistics

_MOVES = f"""{_TRADES}, lx AS (SELECT d.*, o2.session AS exit_session, o2.close AS exit_price, o2.high AS xh, o2.low AS xl, o2.open AS xo, CASE WHEN hit THEN 'TARGET' WHEN net_r <= -1 THEN 'STOP' ELSE 'TIME' END AS why
  FROM done d JOIN o o2 ON o2.ticker = d.ticker AND o2.ord = d.sig + d.bars_held WHERE d.bars_held > 0 AND sg > 0),
li AS (SELECT lx.trade_id, max(o.high) AS hi, min(o.low) AS lo FROM lx JOIN o ON o.ticker = lx.ticker AND o.session >= lx.entry_session AND o.session < lx.exit_session GROUP BY 1),
mv AS (SELECT lx.*, entry - stop AS rk, why IN ('STOP', 'TARGET') AND abs(exit_price - xo) < 1e-8 AS at_open, why = 'TIME' AS whole, hi, lo FROM lx LEFT JOIN li USING (trade_id)),
mb AS (SELECT *, greatest(0, (exit_price - entry) / rk, (hi - entry) / rk) AS su, greatest(0, (entry - exit_price) / rk, (entry - lo) / rk) AS sd FROM mv),
ma AS (SELECT *, CASE WHEN at_open THEN su ELSE greatest(su, (xh - entry) / rk) END AS au, CASE WHEN at_open THEN sd ELSE greatest(sd, (entry - xl) / rk) END AS ad FROM mb),
me AS (SELECT *, CASE WHEN whole THEN au ELSE su END AS mfe_lower, au AS mfe_upper, CASE WHEN whole THEN ad ELSE sd END AS mae_lower, ad AS mae_upper FROM ma)"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades, bars = _trades(spark, sf_dir)
    done = outcomes.outcomes(trades, bars).where("bars_held > 0 AND direction = 'LONG'")
    done = done.join(bars.select("ticker", F.col("session").alias("exit_session"), F.col("close").alias("exit_price")), ["ticker", "exit_session"])
    done = done.withColumn("exit_reason", F.when(F.col("hit"), "TARGET").when(F.col("net_r") <= -1, "STOP").otherwise("TIME"))
    return outcomes.excursions(done, bars).join(done.select("trade_id", "net_r"), "trade_id")


@query(f"WITH {_MOVES} SELECT trade_id, round(mfe_lower, 8) AS mfe_lower, round(mfe_upper, 8) AS mfe_upper, round(mae_lower, 8) AS mae_lower, round(mae_upper, 8) AS mae_upper FROM me")
def trade_excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("mfe_lower", "mfe_upper", "mae_lower", "mae_upper")
    return rounded(_moves(spark, sf_dir), 8, *names).select("trade_id", *names)


@query(
    f"""WITH {_MOVES} SELECT 'losers_reached_1r' AS measure, count(*) AS denominator, count(*) FILTER (mfe_lower >= 1) AS definite, count(*) FILTER (mfe_upper >= 1) AS possible FROM me WHERE net_r < 0
UNION ALL SELECT 'winners_suffered_half_r', count(*), count(*) FILTER (mae_lower >= 0.5), count(*) FILTER (mae_upper >= 0.5) FROM me WHERE net_r > 0
UNION ALL SELECT 'all_reached_2r', count(*), count(*) FILTER (mfe_lower >= 2), count(*) FILTER (mfe_upper >= 2) FROM me"""
)
def excursion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.excursion_summary(_moves(spark, sf_dir))


@query(
    f"""WITH {_FILLS}, n AS (SELECT session, nav / 1000000 AS nav, coalesce(lag(nav / 1000000) OVER (ORDER BY session), 1) AS prev, CASE WHEN session < TIMESTAMP '1996-01-01' THEN 'DEV' ELSE 'HOLD' END AS segment FROM eq),
g AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY segment ORDER BY session ROWS UNBOUNDED PRECEDING), first_value(prev) OVER (PARTITION BY segment ORDER BY session)) - 1 AS fall, nav / prev - 1 AS ret FROM n)
SELECT segment, count(*) AS sessions, round(arg_min(prev, session), 8) AS initial_nav, round(arg_max(nav, session), 8) AS final_nav, round(arg_max(nav, session) / arg_min(prev, session) - 1, 8) AS total_return,
  round(least(0, min(fall)), 8) AS max_drawdown, round(avg(ret) * sqrt(252.0) / nullif(stddev_samp(ret), 0), 6) AS sharpe FROM g GROUP BY segment"""
)
def segment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equity curve before and after a split."""
    curve = _equity(spark, sf_dir)[0].select("session", (F.col("nav") / 1_000_000).alias("nav"))
    found = outcomes.segment_statistics(curve, F.to_timestamp(F.lit("1996-01-01")))
    return rounded(rounded(found, 8, "initial_nav", "final_nav", "total_return", "max_drawdown"), 6, "sharpe").drop("cagr")


@query(
    f"""WITH {_TRADES} SELECT direction AS setup, CASE WHEN entry_session < TIMESTAMP '1996-01-01' THEN 'DEV' ELSE 'HOLD' END AS segment, count(*) AS trades, round(avg(net_r), 6) AS mean_r,
  round(avg(CASE WHEN net_r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(sum(greatest(net_r, 0)) / nullif(sum(greatest(-net_r, 0)), 0), 6) AS profit_factor FROM done GROUP BY 1, 2"""
)
def setup_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades by setup, before and after a split."""
    done = outcomes.outcomes(*_trades(spark, sf_dir)).withColumn("segment", F.when(F.col("entry_session") < F.to_timestamp(F.lit("1996-01-01")), "DEV").otherwise("HOLD"))
    found = outcomes.trade_statistics(done.withColumnRenamed("direction", "setup"), "setup", "segment")
    return rounded(found, 6, "mean_r", "win_rate", "profit_factor").select("setup", "segment", "trades", "mean_r", "win_rate", "profit_factor")


@query(f"""WITH {_TRADES} SELECT CASE WHEN net_r > 0 THEN 'WIN' WHEN net_r < 0 THEN 'LOSS' ELSE 'BREAKEVEN' END AS outcome, count(*) AS n FROM done GROUP BY 1""")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("net_r")
    done = outcomes.outcomes(*_trades(spark, sf_dir))
    return done.groupBy(F.when(r > 0, "WIN").when(r < 0, "LOSS").otherwise("BREAKEVEN").alias("outcome")).agg(F.count("*").alias("n"))


# ---- coverage, membership, calendars

@query(
    f"""WITH {_STATES}, c AS (SELECT session, state, count(*) AS n FROM st GROUP BY 1, 2)
SELECT session, 'prices' AS feed, CAST(sum(n) AS BIGINT) AS expected, CAST(sum(CASE WHEN state = 'OBSERVED' THEN n ELSE 0 END) AS BIGINT) AS covered,
  CASE WHEN sum(n) = sum(CASE WHEN state = 'OBSERVED' THEN n ELSE 0 END) THEN 'RECORDED_COVERAGE_NOT_PROVIDER_VERIFIED' ELSE 'UNAVAILABLE_OR_PARTIAL' END AS status, string_agg(state || '=' || n, ',' ORDER BY state) AS reasons FROM c GROUP BY session"""
)
def feed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared members' price feed by session, with the count of every state."""
    states = _states(spark, sf_dir)[0].select("session", F.lit("prices").alias("feed"), F.col("ticker").alias("entity"), "state")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("reasons")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return coverage.feed_coverage(states).withColumn("reasons", text)


@query(
    f"""WITH {_STATES}, d AS (SELECT session, count(*) AS n, count(*) FILTER (state IN ('OBSERVED', 'UNAVAILABLE_PRICE_LOOKBACK')) / count(*) AS cov FROM st GROUP BY session)
SELECT count(*) AS sessions, min(session) AS "start", max(session) AS "end", min(n) AS members_min, max(n) AS members_max, round(min(cov), 8) AS coverage_min, round(max(cov), 8) AS coverage_max, CAST(0 AS BIGINT) AS missing_benchmark FROM d"""
)
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = coverage.daily_coverage(_states(spark, sf_dir)[0])
    return rounded(coverage.audit_summary(daily, market.benchmark(views.bars_walk(spark, sf_dir))), 8, "coverage_min", "coverage_max")


_ACTS = """acts AS (SELECT CAST(o_custkey % 500 AS VARCHAR) AS ticker, o_orderdate AS effective_date, o_orderdate + (o_orderkey % 40) * INTERVAL 1 DAY AS known_at, CASE WHEN o_orderkey % 3 = 0 THEN 'REMOVE' ELSE 'ADD' END AS action, o_orderkey FROM orders),
one AS (SELECT ticker, effective_date, known_at, max(action) AS action FROM acts GROUP BY 1, 2, 3),
pt AS (SELECT row_number() OVER (ORDER BY m) AS point_id, m + INTERVAL 20 DAY AS "asof", m + INTERVAL 10 DAY AS session FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders))"""


@query(
    f"""WITH {_ACTS}, l AS (SELECT point_id, ticker, arg_max(action, (effective_date, known_at)) AS action FROM pt JOIN one ON known_at <= "asof" AND effective_date <= session GROUP BY 1, 2)
SELECT point_id, count(*) AS members, md5(string_agg(ticker, ',' ORDER BY ticker)) AS tickers FROM l WHERE action = 'ADD' GROUP BY point_id"""
)
def members_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who was a member at each month's point, by the actions known then."""
    o = views.table(spark, sf_dir, "orders")
    known = F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 40).cast("int"))
    acts = o.select((F.col("o_custkey") % 500).cast("string").alias("ticker"), F.col("o_orderdate").alias("effective_date"), known.alias("known_at"), F.when(F.col("o_orderkey") % 3 == 0, "REMOVE").otherwise("ADD").alias("action"))
    acts = acts.groupBy("ticker", "effective_date", "known_at").agg(F.max("action").alias("action"))
    months = o.select(F.date_trunc("month", "o_orderdate").alias("m")).distinct()
    points = months.select(F.row_number().over(Window.orderBy("m")).cast("long").alias("point_id"), (F.col("m") + F.expr("interval 20 days")).alias("asof"), (F.col("m") + F.expr("interval 10 days")).alias("session"))
    found = bitemporal.members_as_of(points, acts)
    return found.groupBy("point_id").agg(F.count("*").alias("members"), F.md5(F.array_join(F.sort_array(F.collect_list("ticker")), ",").cast("binary")).alias("tickers"))


@query(
    """WITH s AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS session, o_custkey AS ticker FROM orders), k AS (SELECT session, row_number() OVER (ORDER BY session) AS ord, lead(session) OVER (ORDER BY session) AS nx FROM (SELECT DISTINCT session FROM s)),
r AS (SELECT ticker, session, nx, ord, ord - row_number() OVER (PARTITION BY ticker ORDER BY ord) AS run FROM s JOIN k USING (session))
SELECT ticker, min(session) AS "start", CASE WHEN max(ord) < (SELECT max(ord) FROM k) THEN max(nx) END AS "end" FROM r GROUP BY ticker, run"""
)
def snapshot_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as members of the months in which they ordered."""
    return bitemporal.snapshot_intervals(views.table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").alias("session"), F.col("o_custkey").alias("ticker")))


@query(
    f"""WITH {_BARS}, a AS (SELECT DISTINCT session FROM bars), b AS (SELECT DISTINCT date_trunc('week', o_orderdate) AS session FROM orders)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)"""
)
def calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that two calendars share, and all sessions of either."""
    a = views.bars_walk(spark, sf_dir).select("session").distinct()
    b = views.table(spark, sf_dir, "orders").select(F.date_trunc("week", "o_orderdate").alias("session")).distinct()
    count = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.union(b).distinct(), "either"))


@query(
    f"""WITH {_BARS}, x AS (SELECT session, avg(close) AS a, avg(close) * (1 + (row_number() OVER (ORDER BY session) % 10) / 5000.0) AS b FROM bars GROUP BY session)
SELECT count(*) AS sessions, count(*) FILTER (abs(b / a - 1) > 0.001) AS apart, round(max(abs(b / a - 1)), 8) AS most FROM x"""
)
def benchmark_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions on which a benchmark and an index differ by more than a thousandth."""
    a = market.benchmark(views.bars_walk(spark, sf_dir))
    b = a.select("session", (F.col("bench") * (1 + (F.row_number().over(Window.orderBy("session")) % 10) / 5000.0)).alias("index"))
    gap = F.abs(F.col("index") / F.col("bench") - 1)
    return a.join(b, "session").agg(F.count("*").alias("sessions"), F.count_if(gap > 0.001).alias("apart"), F.round(F.max(gap), 8).alias("most"))


@query(
    f"""WITH {_BARS}, b AS (SELECT session, avg(close) AS bench FROM bars GROUP BY session),
r AS (SELECT ticker, sector, session, coalesce(round((ln(close / lag(close, 20) OVER w) - ln(bench / lag(bench, 20) OVER w)) * 100, 3), 0) AS rs FROM bars JOIN b USING (session) WINDOW w AS (PARTITION BY ticker ORDER BY session)),
m AS (SELECT session, sector, round(median(rs), 3) AS sector_rs FROM r GROUP BY 1, 2)
SELECT sector, (SELECT string_agg(DISTINCT ticker, ',' ORDER BY ticker) FROM bars x WHERE x.sector = m.sector) AS tickers, arg_max(sector_rs, session) AS sector_rs FROM m GROUP BY sector"""
)
def sector_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sector's tickers and its latest strength."""
    bars = views.bars_walk(spark, sf_dir)
    newest = market.sector_strength(market.relative_strength(bars, market.benchmark(bars))).groupBy("sector").agg(F.max_by("sector_rs", "session").alias("sector_rs"))
    names = bars.groupBy("sector").agg(F.array_join(F.sort_array(F.collect_set("ticker")), ",").alias("tickers"))
    return names.join(newest, "sector")


# ---- tables and streams

@query("SELECT count(*) AS rows, count(*) - count(DISTINCT l_orderkey * 10 + l_linenumber) AS repeated FROM lineitem")
def table_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's digest doesn't depend on its order, and counts repeated rows; its rows, and how many repeat."""
    rows = views.table(spark, sf_dir, "lineitem")
    keys = rows.select("l_orderkey", "l_linenumber")
    one, other = readers.fingerprint(keys), readers.fingerprint(keys.repartition(7, "l_linenumber")).withColumnRenamed("rows", "again")
    same = one.join(other, "digest").select("rows")
    distinct = keys.distinct().agg(F.count("*").alias("n"))
    return same.join(distinct, F.lit(True)).select("rows", (F.col("rows") - F.col("n")).alias("repeated"))


@query(
    f"""WITH {_BARS}, p AS (SELECT ticker AS position_id, ticker, min(session) AS opened, arg_min(close, session) * 0.9 AS stop, arg_min(close, session) * 1.1 AS target FROM bars GROUP BY ticker),
h AS (SELECT position_id, b.*, low <= stop AS st, stop, target FROM bars b JOIN p USING (ticker) WHERE session > opened AND (low <= stop OR high >= target)), f AS (SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY session) AS k FROM h)
SELECT position_id, session, CASE WHEN st THEN 'STOP' ELSE 'TARGET' END AS reason, round(CASE WHEN st THEN least(open, stop) ELSE greatest(open, target) END, 6) AS price FROM f WHERE k = 1"""
)
def position_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one exit of a long position in each ticker, opened at its first bar."""
    bars = views.bars_walk(spark, sf_dir)
    first = F.min_by("close", "session")
    opened = bars.groupBy("ticker").agg(F.min("session").alias("opened"), (first * 0.9).alias("stop"), (first * 1.1).alias("target"))
    positions = opened.withColumns({"position_id": F.col("ticker"), "direction": F.lit("LONG")})
    return streams.position_exits(bars, positions).select("position_id", "session", "reason", F.round("price", 6).alias("price"))


@query(
    f"""WITH {_BARS}, w AS (SELECT *, count(*) OVER x AS n, avg(close * volume) OVER (PARTITION BY ticker ORDER BY session ROWS 19 PRECEDING) AS tv, min(CASE WHEN volume > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY session ROWS 4 PRECEDING) AS busy FROM bars WINDOW x AS (PARTITION BY ticker ORDER BY session))
SELECT ticker, count(*) AS bars, count(*) FILTER (busy = 1) AS complete, min(session) AS first FROM w WHERE n >= 30 AND tv >= 10000 GROUP BY ticker"""
)
def static_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of tickers with history and turnover, and those after five busy ones in a row."""
    bars = views.bars_walk(spark, sf_dir).withColumn("busy", coverage.rolling_complete(F.col("volume") > 100, 5))
    return sizing.static_filter(bars, 30, 10_000.0).groupBy("ticker").agg(F.count("*").alias("bars"), F.count_if("busy").alias("complete"), F.min("session").alias("first"))


@query(
    f"""WITH {_BARS}, r AS (SELECT ticker, session, row_number() OVER (PARTITION BY ticker ORDER BY session) AS turn FROM bars) SELECT turn, ticker, session FROM r WHERE turn <= 100000"""
)
def round_robin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn in which each bar is taken if tickers take turns."""
    return selection.round_robin(views.bars_walk(spark, sf_dir), "ticker", "session").select(F.col("turn").cast("long").alias("turn"), "ticker", "session")


@query(
    f"""WITH RECURSIVE {_TRADES}, nx AS (SELECT trade_id, direction AS setup, ticker, sig AS entry_ord, sig + bars_held AS exit_ord, row_number() OVER (PARTITION BY direction, ticker ORDER BY sig, trade_id) AS k FROM done),
kept AS (SELECT setup, ticker, k, trade_id, exit_ord AS until, true AS keep FROM nx WHERE k = 1 UNION ALL
  SELECT nx.setup, nx.ticker, nx.k, nx.trade_id, CASE WHEN nx.entry_ord > until THEN nx.exit_ord ELSE until END, nx.entry_ord > until FROM kept JOIN nx ON nx.setup = kept.setup AND nx.ticker = kept.ticker AND nx.k = kept.k + 1)
SELECT kept.setup, kept.ticker, kept.trade_id, CAST(nx.entry_ord AS INTEGER) AS entry_ord, CAST(nx.exit_ord AS INTEGER) AS exit_ord FROM kept JOIN nx USING (trade_id) WHERE keep"""
)
def non_overlapping_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of a direction and ticker that start after the last kept one has ended."""
    done = outcomes.outcomes(*_trades(spark, sf_dir)).select("trade_id", F.col("direction").alias("setup"), "ticker", F.col("signal_ord").alias("entry_ord"), (F.col("signal_ord") + F.col("bars_held")).alias("exit_ord"))
    return selection.non_overlapping(done)


@query("SELECT CASE WHEN v <= 38 THEN 0.1 WHEN v < 42 THEN round(0.1 + 0.75 * (v - 38) / 4, 6) WHEN v < 45 THEN 0.85 WHEN v < 48 THEN round(0.85 + 0.15 * (v - 45) / 3, 6) WHEN v <= 73 THEN 1 WHEN v < 78 THEN round(1 - 0.8 * (v - 73) / 5, 6) ELSE 0.2 END::DOUBLE AS score, count(*) AS n FROM (SELECT value % 100 AS v FROM events) GROUP BY 1")
def score_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long momentum curve over event values."""
    return views.table(spark, sf_dir, "events").groupBy(F.round(curves.piecewise(F.col("value") % 100, curves.RSI_LONG), 6).alias("score")).agg(F.count("*").alias("n"))
