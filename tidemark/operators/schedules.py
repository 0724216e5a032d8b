"""Setup schedules: entries at the next open after a signal, the first of several exit rules, and no overlap by setup and ticker.

Three setups feed one schedule: pullbacks of leaders (LP), and rises after a surprising report with or without a
strong market (PEAD_MKT, PEAD).  An exit is the least of (day, phase) over all rules that a day meets, where the phases
of a day are OPEN, INTRADAY and CLOSE; a trade unfolds into the ordinals that it may need and meets its own bars on
equal ticker and ordinal.

Defined results: a signal on a ticker's last bar, without a range, or whose stop isn't between 0 and the entry gives no
trade and blocks none.  A trade whose bars end before its holding time ends at the last close.  Reports on no
trading day count for the first bar after them; a report without a finite surprise is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import selection
from tidemark.operators.indicators import by_ticker, sliding
from tidemark.operators.outcomes import with_ordinals
from tidemark.operators.setups import adjusted_rsi

#: Holding times, stop distance in ranges, costs of a round trip, and limits of the setups.
PULLBACK_DAYS, REPORT_DAYS, STOP_RANGES, COST = 10, 20, 3.0, 0.004
LEADER_RANK, RSI_LIMIT, LEAST_SURPRISE, MOMENTUM_BARS, LEAST_BARS = 0.8, 10.0, 10.0, 126, 250
PHASES = ("OPEN", "INTRADAY", "CLOSE")


def panel_ranks(bars: DataFrame, lookback: int = MOMENTUM_BARS, members: DataFrame | None = None) -> DataFrame:
    """(ticker, session, rank): percentile of the change over `lookback` sessions of the common calendar, among members (ticker, session).

    A ticker without a bar keeps its last close, as long as the calendar runs; a ticker's row unfolds into its sessions.
    """
    c = F.col
    calendar = bars.select("session").distinct().withColumn("__k", F.row_number().over(Window.orderBy("session")))  # one small row a session
    own = bars.select("ticker", "session", "close").join(calendar, "session")
    span = own.groupBy("ticker").agg(F.min("__k").alias("__from")).join(calendar.agg(F.max("__k").alias("__to")), F.lit(True))
    panel = span.select("ticker", F.explode(F.sequence("__from", "__to")).alias("__k")).join(own, ["ticker", "__k"], "left").drop("session")
    w = Window.partitionBy("ticker").orderBy("__k")
    panel = panel.withColumn("__last", F.last("close", ignorenulls=True).over(w)).withColumn("__change", c("__last") / F.lag("__last", lookback).over(w) - 1)
    ranked = panel.where("__change is not null").join(calendar, "__k").select("ticker", "session", "__change")
    if members is not None:
        ranked = ranked.join(members.select("ticker", "session").distinct(), ["ticker", "session"])
    session = Window.partitionBy("session")
    ties = F.count(F.lit(1)).over(Window.partitionBy("session", "__change"))
    place = F.rank().over(session.orderBy("__change")) + (ties - 1) / 2.0
    return ranked.select("ticker", "session", (place / F.count(F.lit(1)).over(session)).alias("rank"))


def features(bars: DataFrame, bench: DataFrame, least_turnover: float = 1e8, trend_bars: int = 200, least_bars: int = LEAST_BARS, lookback: int = MOMENTUM_BARS, members: DataFrame | None = None) -> DataFrame:
    """bars with ord, atr, mean_5, rsi2, rank, the flags liquid, strong_market and uptrend, and the next bar's open and session."""
    w, c = by_ticker(), F.col
    before = F.lag("close").over(w)
    market = Window.orderBy("session").rowsBetween(1 - trend_bars, 0)  # one small row a session
    strong = bench.withColumn("strong_market", (F.count("bench").over(market) == trend_bars) & (c("bench") > F.avg("bench").over(market))).select("session", "strong_market")
    rows = with_ordinals(bars).withColumn("__bars", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).where(c("__bars") >= least_bars)
    rows = rows.withColumns(
        {
            "__range": F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before)),
            "mean_5": sliding(c("close"), -4, 0),
            "rsi2": adjusted_rsi(c("close")),
            "liquid": F.coalesce(sliding(c("close") * c("volume"), -19, 0) > least_turnover, F.lit(False)),
            "uptrend": F.coalesce((c("close") > sliding(c("close"), -49, 0)) & (sliding(c("close"), -49, 0) > sliding(c("close"), 1 - trend_bars, 0)), F.lit(False)),
            "next_open": F.lead("open").over(w),
            "next_session": F.lead("session").over(w),
        }
    ).withColumn("atr", sliding(c("__range"), -13, 0))
    rows = rows.join(strong, "session", "left").join(panel_ranks(bars, lookback, members), ["ticker", "session"], "left").withColumn("strong_market", F.coalesce("strong_market", F.lit(False)))
    if members is not None:
        listed = members.select("ticker", "session", F.lit(True).alias("__member")).distinct()
        rows = rows.join(listed, ["ticker", "session"], "left").withColumn("liquid", c("liquid") & F.coalesce("__member", F.lit(False))).drop("__member")
    return rows.drop("__bars", "__range")


_SIGNAL = ("ticker", "ord", "session", "atr", "next_open", "next_session")


def _signals(rows: DataFrame, setup: Column, holding: int, mean_exit: bool, priority: Column) -> DataFrame:
    return rows.select(setup.alias("setup"), *_SIGNAL, F.lit(holding).alias("holding"), F.lit(mean_exit).alias("mean_exit"), priority.alias("priority"))


def pullback_signals(rows: DataFrame) -> DataFrame:
    """LP: leaders in an uptrend and a strong market whose short strength index has fallen."""
    chosen = rows.where(F.col("strong_market") & F.col("liquid") & F.col("uptrend") & (F.col("rank") >= LEADER_RANK) & (F.col("rsi2") < RSI_LIMIT))
    return _signals(chosen, F.lit("LP"), PULLBACK_DAYS, True, -F.col("rsi2"))


def report_signals(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """PEAD and PEAD_MKT: bars after a report (ticker, announced_at, surprise in percent) that close above the bar before it.

    Reports and bars of a ticker are one sequence by day; a report's neighbours on both sides are the last values of two
    running aggregates, so no report meets more than two bars.  Of several reports before one bar, the last one counts.
    """
    c = F.col
    day = lambda name: F.unix_date(c(name).cast("date"))
    bar = F.struct("ord", "close", "liquid", "strong_market")
    both = rows.select("ticker", day("session").alias("__day"), bar.alias("__bar"), F.lit(None).cast("timestamp").alias("announced_at"), F.lit(None).cast("double").alias("surprise"))
    both = both.unionByName(reports.select("ticker", day("announced_at").alias("__day"), F.lit(None).cast(both.schema["__bar"].dataType).alias("__bar"), "announced_at", "surprise"))
    up, down = (Window.partitionBy("ticker").orderBy(o).rangeBetween(Window.unboundedPreceding, -1) for o in (c("__day"), c("__day").desc()))
    near = both.withColumns({"__before": F.max("__bar").over(up), "__after": F.min("__bar").over(down)})
    near = near.where(c("announced_at").isNotNull() & c("__before").isNotNull() & c("__after").isNotNull() & c("__after.liquid"))
    near = near.where((c("surprise") >= LEAST_SURPRISE) & ~F.isnan("surprise") & (c("surprise") < float("inf")) & (c("__after.close") > c("__before.close")))
    kinds = near.select("ticker", c("__after.ord").alias("ord"), "announced_at", "surprise", F.explode(F.when(c("__after.strong_market"), F.array(F.lit("PEAD"), F.lit("PEAD_MKT"))).otherwise(F.array(F.lit("PEAD")))).alias("setup"))
    last = kinds.groupBy("setup", "ticker", "ord").agg(F.max_by("surprise", F.struct("announced_at", "surprise")).alias("__surprise"))
    return _signals(last.join(rows, ["ticker", "ord"]), c("setup"), REPORT_DAYS, False, c("__surprise"))


def schedule(signals: DataFrame, rows: DataFrame, cost: float = COST) -> DataFrame:
    """One row a trade: setup, ticker, the three sessions, entry, exit_price, stop, priority, exit_phase, ret, gross_r and r.

    signals: what the setups give; rows: features' rows.  A later signal of the same setup and ticker counts only after
    the exit of the last trade taken.
    """
    c = F.col
    stop = c("next_open") - STOP_RANGES * c("atr")
    taken = signals.withColumn("stop", stop).where((c("stop") > 0) & (c("next_open") > c("stop")))
    days = taken.select("*", F.explode(F.sequence(F.lit(1), c("holding"))).alias("day")).withColumnsRenamed({"ord": "signal_ord", "session": "signal_session"})
    bars = rows.select("ticker", "ord", "session", "open", "low", "close", "mean_5")
    held = days.withColumn("ord", c("signal_ord") + c("day")).join(bars, ["ticker", "ord"])
    at = lambda phase, price: F.struct("day", F.lit(PHASES.index(phase)).alias("phase"), price.alias("price"), c("session").alias("exit_session"))
    hits = (
        F.when(c("open") <= c("stop"), at("OPEN", c("open")))
        .when(c("low") <= c("stop"), at("INTRADAY", c("stop")))
        .when(c("mean_exit") & (c("close") > c("mean_5")), at("CLOSE", c("close")))
    )
    key = ["setup", "ticker", "signal_ord"]
    same = ["signal_session", "next_session", "next_open", "stop", "priority"]
    exits = held.groupBy(*key).agg(F.coalesce(F.min(hits), F.max(at("CLOSE", c("close")))).alias("x"), *(F.first(n).alias(n) for n in same))
    trades = exits.select(
        *key, F.concat_ws("-", *key).alias("trade_id"), c("signal_ord").alias("entry_ord"), (c("signal_ord") + c("x.day")).alias("exit_ord"), "signal_session", c("next_session").alias("entry_session"), "x.exit_session",
        c("next_open").alias("entry"), c("x.price").alias("exit_price"), "stop", "priority", F.element_at(F.array(*map(F.lit, PHASES)), c("x.phase") + 1).alias("exit_phase"),
    )
    kept = selection.non_overlapping(trades)
    gross = c("exit_price") - c("entry")
    net = gross - (c("entry") + c("exit_price")) * cost / 2
    return kept.drop("signal_ord", "entry_ord", "exit_ord").withColumns({"ret": net / c("entry"), "gross_r": gross / (c("entry") - c("stop")), "r": net / (c("entry") - c("stop"))})


def setup_schedules(bars: DataFrame, bench: DataFrame, reports: DataFrame | None = None, cost: float = COST, **limits) -> DataFrame:
    """schedule() of all setups; `limits` are those of features()."""
    rows = features(bars, bench, **limits)
    signals = pullback_signals(rows)
    if reports is not None:
        signals = signals.unionByName(report_signals(rows, reports))
    return schedule(signals, rows, cost)
