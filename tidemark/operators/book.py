"""The book: budget limits of a selection, capital fractions, equity curves from fills and exposures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.curves import clip

#: Share of capital by regime, and in panic by drawdown.
REGIME_CAPITAL = {"TREND_UP": 1.0, "EXPANSION": 1.0, "RANGE": 0.75, "TREND_DOWN": 0.5, "PANIC": 0.0}
PANIC_TIERS = ((0.0, 1.0), (0.02, 0.5), (0.05, 0.25), (0.10, 0.0))
#: Composite multipliers by session, and where the regime is against the trade.
SESSION_MULTIPLIER = {"CLOSING_TREND": 1.05, "MIDDAY_CHOP": 0.92, "OPENING_RANGE": 1.0}
RANGE_MULTIPLIER, FALLING_MULTIPLIER = 0.88, 0.90


def within_limits(selected: DataFrame, capital: float, most_risk: float) -> DataFrame:
    """A session's selection held within its capital and risk, each row with its final shares and risk.

    selected: session, ticker, held, rank_score, shares, entry, stop, risk.  Where a total is too large all
    sizes shrink in proportion; new candidates that come to less than a share go, held ones keep one.
    If that isn't enough, new candidates are dropped from the lowest rank on until both totals fit or none is left.
    """
    c, session = F.col, Window.partitionBy("session")
    value = c("shares") * c("entry")
    totals = selected.withColumns({"__value": F.sum(value).over(session), "__risk": F.sum("risk").over(session)})
    over = (c("__value") > capital) | (c("__risk") > most_risk)
    scale = F.least(F.when(c("__value") > capital, F.lit(capital) / c("__value")).otherwise(1.0), F.when(c("__risk") > most_risk, F.lit(most_risk) / c("__risk")).otherwise(1.0))
    less = F.greatest((c("shares") * scale).cast("long"), F.when(c("held"), 1).otherwise(0).cast("long"))
    scaled = totals.withColumns({"__over": over, "__shares": F.when(over, less).otherwise(c("shares").cast("long"))}).where(~c("__over") | (c("__shares") > 0))
    risk = F.when(c("__over"), F.round(c("__shares") * F.abs(c("entry") - c("stop")), 2)).otherwise(c("risk"))
    scaled = scaled.withColumns({"shares": c("__shares"), "risk": risk})
    # new candidates by rank, the lowest first; each goes if what stays without those before it is still too much
    last = Window.partitionBy("session").orderBy(F.col("held"), "rank_score", "ticker").rowsBetween(0, Window.unboundedFollowing)
    rest = scaled.withColumns({"__value": F.sum(c("shares") * c("entry")).over(last), "__risk": F.sum("risk").over(last)})
    kept = rest.where(c("held") | ((c("__value") <= capital) & (c("__risk") <= most_risk)))
    return kept.select(*selected.columns)


def capital_fraction(curve: DataFrame, *by: str) -> DataFrame:
    """curve (session, nav, regime) with `drawdown` from the running peak and the share of capital that it leaves."""
    peak = F.max("nav").over(Window.partitionBy(*by).orderBy("session").rowsBetween(Window.unboundedPreceding, 0))
    fall = F.when(peak > 0, F.greatest(F.lit(0.0), (peak - F.col("nav")) / peak)).otherwise(0.0)
    rows = curve.withColumn("drawdown", fall)
    base, panic = F.lit(1.0), F.lit(PANIC_TIERS[0][1])
    for regime, share in REGIME_CAPITAL.items():
        base = F.when(F.col("regime") == regime, share).otherwise(base)
    for level, share in PANIC_TIERS:
        panic = F.when(F.col("drawdown") >= level, share).otherwise(panic)
    calm = F.round(base * F.when(F.col("drawdown") > 0.02, F.greatest(F.lit(0.5), 1 - F.col("drawdown") * 3)).otherwise(1.0), 4)
    return rows.withColumn("fraction", F.when(F.col("regime") == "PANIC", panic).otherwise(calm))


def nav_fraction(nav: Column, par: float, low: float = 0.25, high: float = 2.0) -> Column:
    """Net asset value by its par, held within bounds."""
    return clip(nav / par, low, high)


def confidence_scale(confidence: Column) -> Column:
    """A gentle size multiplier: 0.8 without confidence, 1 with all of it."""
    return F.round(0.80 + 0.20 * clip(confidence, 0.0, 1.0), 3)


def adjusted_composite(composite: Column, session: Column, regime: Column, direction: Column, planned: Column | None = None) -> Column:
    """The composite times its session's and regime's multipliers, within 0 and 1; a daily plan has no session."""
    factor = F.lit(1.0)
    for label, by in SESSION_MULTIPLIER.items():
        factor = F.when(session == label, by).otherwise(factor)
    if planned is not None:
        factor = F.when(planned, 1.0).otherwise(factor)
    factor = factor * F.when(regime == "RANGE", RANGE_MULTIPLIER).otherwise(1.0)
    factor = factor * F.when((regime == "TREND_DOWN") & (direction == "LONG"), FALLING_MULTIPLIER).otherwise(1.0)
    return clip(composite * factor, 0.0, 1.0)


def trade_management(direction: Column, entry: Column, atr: Column, atr_pctile: Column) -> tuple[Column, Column]:
    """(trailing stop, bars until the time stop), both by the volatility's percentile."""
    sign = F.when(direction == "LONG", -1.0).otherwise(1.0)
    bars = F.when(atr_pctile < 30, 4).when(atr_pctile < 60, 7).otherwise(12)
    return F.round(entry + sign * (1 + atr_pctile / 100) * atr, 2), bars


def liquidity_reason(shares: float = 750_000, turnover: float = 35_000_000.0) -> Column:
    """Why a row (vol_avg_20, turnover_avg_20) isn't liquid enough; null if it is."""
    small = F.concat(F.lit("Vol "), F.format_number(F.floor("vol_avg_20"), 0), F.lit(f" < {shares:,.0f}"))
    return F.when(F.col("vol_avg_20") < shares, small).when(F.col("turnover_avg_20") < turnover, f"Turnover < {turnover / 1e7:.1f}cr")


def with_override(states: DataFrame, label: str | None) -> DataFrame:
    """states (regime, confidence, confirmed) under a manual regime; a label that isn't one changes nothing."""
    name = (label or "").upper()
    if name not in REGIME_CAPITAL:
        return states
    return states.withColumns({"regime": F.lit(name), "confidence": F.lit(1.0), "confirmed": F.lit(True)})


def with_held_levels(signals: DataFrame, held: DataFrame) -> DataFrame:
    """signals with `held`, and the original fill's entry, shares, stop and target where a position is open; risk follows."""
    names = ("entry", "shares", "stop", "target")
    own = held.select("ticker", *(F.col(n).alias(f"__{n}") for n in names), F.lit(True).alias("held"))
    rows = signals.join(own, "ticker", "left").withColumns({n: F.coalesce(f"__{n}", n) for n in names})
    rows = rows.withColumn("held", F.coalesce("held", F.lit(False))).drop(*(f"__{n}" for n in names))
    return rows.withColumn("risk", F.round(F.col("shares") * F.abs(F.col("entry") - F.col("stop")), 2))


def replaced(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The set after a synchronisation: exactly the incoming keys; columns that incoming lacks stay as they are.

    Of several incoming rows of a key the largest one counts, by its columns in order.
    """
    kept = [c for c in current.columns if c not in incoming.columns]
    one = incoming.groupBy(key).agg(F.max(F.struct(*(c for c in incoming.columns if c != key))).alias("__row")).select(key, "__row.*") if len(incoming.columns) > 1 else incoming.distinct()
    return one.join(current.select(key, *kept), key, "left").select(*current.columns)


def equity_from_fills(fills: DataFrame, marks: DataFrame, start: float) -> DataFrame:
    """(session, cash, value, nav, positions, exposure, drawdown) at every session of `marks`.

    fills: session, ticker, side (BUY or SELL), quantity, price, fees; marks: session, ticker, close.  A position is worth its
    last mark at or before the session, or its last fill's price before the first one.  A ticker's events are one sorted run; sessions are then
    sums of changes, one row each, so no table of all tickers by all sessions is made.
    """
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    moves = fills.groupBy("session", "ticker").agg(
        F.sum(sign * F.col("quantity")).alias("moved"), F.sum(-sign * F.col("quantity") * F.col("price") - F.col("fees")).alias("flow"), F.max_by("price", F.struct("side", "price")).alias("paid")
    )
    own = marks.join(fills.select("ticker").distinct(), "ticker", "left_semi").select("session", "ticker", "close")
    rows = own.join(moves, ["session", "ticker"], "full").withColumns({"moved": F.coalesce("moved", F.lit(0)), "flow": F.coalesce("flow", F.lit(0.0))})
    w = Window.partitionBy("ticker").orderBy("session")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"shares": F.sum("moved").over(upto), "mark": F.coalesce(F.last("close", True).over(upto), F.last("paid", True).over(upto))})
    rows = rows.withColumn("value", F.col("shares") * F.col("mark")).withColumn("open", (F.col("shares") != 0).cast("int"))
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0))
    rows = rows.withColumns({"__value": F.col("value") - before("value"), "__open": F.col("open") - before("open")})
    days = rows.groupBy("session").agg(F.sum("flow").alias("flow"), F.sum("__value").alias("change"), F.sum("__open").alias("opened"))
    days = marks.select("session").distinct().join(days, "session", "full").na.fill(0, ["flow", "change", "opened"])
    every = Window.orderBy("session").rowsBetween(Window.unboundedPreceding, 0)  # one small row a session
    curve = days.select("session", (F.lit(start) + F.sum("flow").over(every)).alias("cash"), F.sum("change").over(every).alias("value"), F.sum("opened").over(every).alias("positions"))
    curve = curve.withColumn("nav", F.col("cash") + F.col("value"))
    peak = F.greatest(F.max("nav").over(every), F.lit(start))
    return curve.withColumns({"exposure": F.when(F.col("nav") > 0, F.col("value") / F.col("nav")).otherwise(0.0), "drawdown": F.col("nav") / peak - 1})


def matched_benchmark(curve: DataFrame, bench: DataFrame) -> DataFrame:
    """curve (session, exposure) with the benchmark's return and what a benchmark position of the same exposure returned.

    bench: session, open, close.  Overnight the exposure of the last close counts, and within the day that of the opening, which
    is the curve's `exposure_open` if it has that column, else the last close's too.
    """
    w = Window.orderBy("session")  # one small row a session
    rows = curve.join(bench.select("session", F.col("open").alias("__open"), F.col("close").alias("__close")), "session")
    rows = rows.withColumns({"__last": F.coalesce(F.lag("__close").over(w), F.col("__open")), "__held": F.coalesce(F.lag("exposure").over(w), F.lit(0.0))})
    opening = F.col("exposure_open") if "exposure_open" in curve.columns else F.col("__held")
    matched = F.col("__held") * (F.col("__open") / F.col("__last") - 1) + opening * (F.col("__close") / F.col("__open") - 1)
    return rows.withColumns({"benchmark_return": F.col("__close") / F.col("__last") - 1, "matched_return": matched}).drop("__open", "__close", "__last", "__held")


def excess_returns(trades: DataFrame, bench: DataFrame) -> DataFrame:
    """trades (entry_session, exit_session, entry, exit_price, direction) with net, benchmark and excess returns over the holding time."""
    at = lambda name, key: bench.select(F.col("session").alias(key), F.col("close").alias(name))
    rows = trades.join(at("__in", "entry_session"), "entry_session", "left").join(at("__out", "exit_session"), "exit_session", "left")
    sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    rows = rows.withColumns({"net_return": sign * (F.col("exit_price") / F.col("entry") - 1), "benchmark_return": F.col("__out") / F.col("__in") - 1})
    return rows.withColumn("excess_return", F.col("net_return") - F.col("benchmark_return")).drop("__in", "__out")


def exposures(book: DataFrame, curve: DataFrame) -> DataFrame:
    """(session, positions, heat, largest_sector): a book's open risk and its largest sector, as shares of the net asset value.

    book: session, sector, value, risk of every open position; curve: session, nav.
    """
    sectors = book.groupBy("session", "sector").agg(F.sum("value").alias("value"), F.sum("risk").alias("risk"), F.count("*").alias("n"))
    days = sectors.groupBy("session").agg(F.sum("n").alias("positions"), F.sum("risk").alias("risk"), F.max("value").alias("largest"))
    share = lambda c: F.when(F.col("nav") > 0, F.col(c) / F.col("nav")).otherwise(0.0)
    return days.join(curve.select("session", "nav"), "session").select("session", "positions", share("risk").alias("heat"), share("largest").alias("largest_sector"))


def scan_metrics(scored: DataFrame, least: float) -> DataFrame:
    """(session, scored, passed, pass_rate, mean_probability, mean_expectancy) of a scan's rows (probability, expectancy)."""
    good = F.col("probability") >= least
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(good, F.col(c))), F.lit(0.0)), 4)
    return scored.groupBy("session").agg(
        F.count("*").alias("scored"), F.count_if(good).alias("passed"), F.round(F.count_if(good) / F.count("*"), 4).alias("pass_rate"), mean("probability").alias("mean_probability"), mean("expectancy").alias("mean_expectancy")
    )
