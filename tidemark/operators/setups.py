"""Swing setups and the leader pullback, for every session at once, as window expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import Mean, by_ticker, recursions, sliding, with_moves

#: Limits of the leader pullback.
LEADER_BARS, LEADER_SHARE, RSI_LIMIT, LEADER_TOP = 126, 0.80, 10.0, 20
RISK_SHARE, POSITION_SHARE, STOP_RANGES = 0.005, 0.10, 3.0
#: Limits of the swing setups.
SWING_BARS, LEAST_REWARD, RESISTANCE_BARS, BREAKOUT_VOLUME = 150, 1.5, 20, 1.2
BREAKOUT_HOLD, PULLBACK_HOLD, STOP_BUFFER, GAP_RANGES = 15, 10, 0.1, 0.5


def adjusted_rsi(close: Column, n: int = 2) -> Column:
    """RSI with normalised exponential weights (not seeded): a ratio of two weighted sums.

    With weight 1/2 (n = 2) all but the last 60 bars weigh nothing in double precision, so the sums
    run over that many bars, and the common normalisation cancels.
    """
    w, keep = by_ticker(), 1 - 1.0 / n
    change = close - F.lag(close).over(w)
    frame = w.rowsBetween(-59, 0)
    changes = F.reverse(F.collect_list(change).over(frame))
    weighed = lambda pick: F.aggregate(F.transform(changes, lambda x, i: pick(x) * F.pow(F.lit(keep), i)), F.lit(0.0), lambda s, v: s + v)
    up, down = weighed(lambda x: F.greatest(x, F.lit(0.0))), weighed(lambda x: F.greatest(-x, F.lit(0.0)))
    return F.when(down > 0, 100 - 100 / (1 + up / down)).when(up > 0, 100.0)


def position_size(capital: float, close: Column, stop_offset: Column) -> Column:
    """Equal risk a trade, capped by a share of capital."""
    shares = F.least(F.lit(RISK_SHARE * capital) / stop_offset, F.lit(POSITION_SHARE * capital) / close)
    return F.when((close > 0) & (stop_offset > 0) & (F.lit(capital) > 0), shares.cast("long")).otherwise(F.lit(0).cast("long"))


def leader_pullback(
    bars: DataFrame, bench: DataFrame, capital: float = 0.0, least_turnover: float = 1e8, trend_bars: int = 200, members: DataFrame | None = None, top: int = LEADER_TOP
) -> DataFrame:
    """(session, ticker, close, atr, stop_offset, rs_percentile, rsi2, shares), at most `top` a session by rsi2.

    members (ticker, start, end), half-open and open-ended if end is null, restricts the ranking.
    """
    w, c = by_ticker(), F.col
    market = Window.orderBy("session").rowsBetween(1 - trend_bars, 0)  # one small row a session
    strong = bench.withColumns({"__mean": F.avg("bench").over(market), "__n": F.count("bench").over(market)}).where((c("__n") == trend_bars) & (c("bench") > c("__mean"))).select("session")
    before = F.lag("close").over(w)
    spread = F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before))
    past = F.lag("close", LEADER_BARS).over(w)
    features = bars.withColumn("__tr", spread).withColumns(
        {
            "__mom": F.when(past > 0, c("close") / past - 1),
            "__sma50": sliding(c("close"), -49, 0),
            "__trend": sliding(c("close"), 1 - trend_bars, 0),
            "__turnover": sliding(c("close") * c("volume"), -19, 0, full=False),
            "__rsi2": adjusted_rsi(c("close")),
            "atr": sliding(c("__tr"), -13, 0, full=False),
        }
    )
    pool = features.where("__mom is not null").join(strong, "session", "left_semi")
    if members is not None:
        m = members.alias("m")
        live = (c("m.ticker") == c("p.ticker")) & (c("m.start") <= c("p.session")) & (c("m.end").isNull() | (c("m.end") > c("p.session")))
        pool = pool.alias("p").join(m, live, "left_semi")
    session = Window.partitionBy("session")
    rank = F.rank().over(session.orderBy("__mom")) + (F.count(F.lit(1)).over(Window.partitionBy("session", "__mom")) - 1) / 2.0
    ranked = pool.withColumn("__pct", rank / F.count(F.lit(1)).over(session))
    passed = ranked.where(
        (c("__pct") >= LEADER_SHARE) & (c("__turnover") > least_turnover) & (c("close") > c("__sma50")) & (c("__sma50") > c("__trend")) & (c("__rsi2") < RSI_LIMIT) & (c("atr") > 0)
    )
    best = passed.withColumn("__place", F.row_number().over(session.orderBy("__rsi2", "ticker"))).where(c("__place") <= top)
    return best.select(
        "session", "ticker", F.round("close", 2).alias("close"), F.round("atr", 2).alias("atr"), F.round(STOP_RANGES * c("atr"), 2).alias("stop_offset"),
        F.round(c("__pct") * 100, 1).alias("rs_percentile"), F.round("__rsi2", 1).alias("rsi2"), position_size(capital, c("close"), STOP_RANGES * c("atr")).alias("shares"),
    )


class Variant(NamedTuple):
    """Parameters of the swing setups; stop_ranges, if given, sets the stop so many ranges below the close in place of the recent lows."""

    variant: str = "fixed_default"
    lookback: int = RESISTANCE_BARS
    least_rvol: float = BREAKOUT_VOLUME
    breakout_bars: int = BREAKOUT_HOLD
    pullback_bars: int = PULLBACK_HOLD
    stop_ranges: float | None = None
    slippage: float = 1.0


_KINDS = {"variant": "string", "lookback": "int", "least_rvol": "double", "breakout_bars": "int", "pullback_bars": "int", "stop_ranges": "double", "slippage": "double"}


def swing_setups(indicators: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """Breakout and pullback plans: strategy, entry bounds, stop, targets and holding limit, for every session.

    indicators holds add_indicators' rows; bench (session, bench) adds the trend and strength filters.
    """
    return swing_variants(indicators, (Variant(),), bench).drop("variant", "slippage")


def swing_variants(indicators: DataFrame, variants: tuple[Variant, ...], bench: DataFrame | None = None) -> DataFrame:
    """swing_setups' plans under each variant (variant, slippage, ...), in one pass.

    What variants share is computed once a bar: indicators, the candle, the pullback, and one resistance for each distinct
    lookback.  Only bars that pass the shared filters unfold into variants, whose parameters are then columns.
    """
    w, c = by_ticker(), F.col
    rows = indicators
    eligible = F.lit(True)
    if bench is not None:
        market = Window.orderBy("session")  # one small row a session
        series = bench.select(F.lit("").alias("ticker"), "session", "bench", *(c("bench").alias(n) for n in ("high", "low", "close")))
        means = recursions(with_moves(series), means={"__b_mean": Mean("close", 2 / 51)}, bands=False)
        context = means.select("session", "bench", "__b_mean", F.lag("bench", 63).over(market).alias("__b63")).withColumn("__b_up", c("bench") > c("__b_mean"))
        rows = rows.join(context, "session")
        eligible = (
            (c("close") > c("ema_20")) & (c("ema_20") > c("ema_50")) & (c("ema_50") > c("ema_200")) & (c("ema_50") > c("__ema50_10"))
            & ((c("close") - c("ema_20")) / c("atr") <= 3) & (c("__b63") > 0) & c("__b_up") & (c("close") / c("__close63") >= c("bench") / c("__b63"))
        )
    close, atr, low = c("close"), c("atr"), c("low")
    lookbacks = sorted({v.lookback for v in variants})
    features = rows.withColumns(
        {
            "__bar": F.row_number().over(w), "__ema50_10": F.lag("ema_50", 10).over(w), "__close63": F.lag("close", 63).over(w), "__overhead": sliding(c("high"), -63, -1, F.max, full=False),
            "__low5": sliding(low, -5, -1, F.min, full=False), "__held": sliding((c("close") >= c("ema_50")).cast("int"), -5, -1, F.min, full=False),
            "__recent": F.collect_list(F.struct("low", "ema_20")).over(w.rowsBetween(-5, -1)), "__high1": F.lag("high").over(w),
            **{f"__resistance_{n}": sliding(c("high"), -n, -1, F.max, full=False) for n in lookbacks},
        }
    )
    span = c("high") - low
    candle = (span > 0) & (span <= 2.5 * atr) & ((close - low) / span >= 0.6)
    touched = F.exists("__recent", lambda b: b["low"] <= b["ema_20"] + 0.25 * atr)
    pullback = touched & (c("__held") == 1) & (close > c("__high1")) & (close > c("open"))
    above = F.lit(False)
    for n in lookbacks:
        above = above | (close > c(f"__resistance_{n}"))
    shared = features.where((c("__bar") >= SWING_BARS) & (close > 0) & (atr > 0) & eligible & candle).withColumn("__pullback", F.coalesce(pullback, F.lit(False))).where(c("__pullback") | above)
    each = [F.struct(*(F.lit(x).cast(_KINDS[n]).alias(n) for n, x in v._asdict().items()), c(f"__resistance_{v.lookback}").alias("__resistance")) for v in variants]
    found = shared.select("*", F.inline(F.array(*each)))
    breakout = (close > c("__resistance")) & (close - c("__resistance") <= 0.75 * atr) & (c("rvol_20") >= c("least_rvol"))
    found = found.withColumn("strategy", F.when(breakout, "BREAKOUT").when(c("__pullback"), "PULLBACK")).where("strategy is not null")
    structure = F.least(c("__low5"), low) - STOP_BUFFER * atr
    found = found.withColumn("stop", F.round(F.coalesce(close - c("stop_ranges") * atr, structure), 2)).withColumn("__risk", close - c("stop"))
    nearest = F.when(c("stop_ranges").isNotNull(), 0.25).otherwise(0.75)
    found = found.where((c("stop") > 0) & (c("__risk") >= nearest * atr) & (c("__risk") <= 3 * atr))
    goal = close + 2 * c("__risk")
    found = found.withColumn("target", F.round(F.when(c("__overhead") > close + 0.2 * atr, F.least(goal, c("__overhead"))).otherwise(goal), 2))
    found = found.where((c("target") - close) / c("__risk") >= LEAST_REWARD)
    highest = F.least(close + GAP_RANGES * atr, (c("target") + LEAST_REWARD * c("stop")) / (1 + LEAST_REWARD))
    return found.select(
        "variant", "slippage", "ticker", "session", "strategy", close.alias("entry"), F.round(F.greatest(close - 0.5 * atr, c("stop") + 0.5 * atr), 2).alias("entry_min"), (F.floor(highest * 100) / 100).alias("entry_max"),
        "stop", "target", F.round(close + 3 * c("__risk"), 2).alias("target2"), F.when(c("strategy") == "BREAKOUT", c("breakout_bars")).otherwise(c("pullback_bars")).alias("time_stop"), "atr",
    )


def fill_size(price: Column, capital: float = 1_000_000.0, risk_limit: float = 5_000.0, risk_share: float = 0.0025, exposure_share: float = 0.10, fraction: float = 1.0) -> Column:
    """Shares bought at `price` under a plan's columns (entry_min, entry_max, stop, target); 0 outside its bounds."""
    c, money = F.col, capital * max(0.0, min(1.0, fraction))
    risk = price - c("stop")
    good = (price >= c("entry_min")) & (price <= c("entry_max")) & (risk > 0) & ((c("target") - price) / risk >= LEAST_REWARD)
    shares = F.least((F.lit(min(risk_limit, money * risk_share)) / risk).cast("long"), (F.lit(money * exposure_share) / price).cast("long"))
    return F.when(good, F.greatest(F.lit(0), shares)).otherwise(F.lit(0)).cast("long")
