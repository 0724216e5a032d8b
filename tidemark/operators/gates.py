"""Entry gates of scored candidates as columns: direction, regime, structure, session, probability, reasons.

Every gate is an expression over a candidate's row with its session's regime joined in, so that a table
of candidates passes all of them in one projection.  A comparison with null counts as failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import bitemporal

#: Least probability of a win by regime.
REGIME_THRESHOLDS = {"TREND_UP": 0.50, "EXPANSION": 0.52, "RANGE": 0.55, "TREND_DOWN": 0.58, "PANIC": 0.99}
#: Limits of the gates.
REVERSION_LONG_RSI, REVERSION_SHORT_RSI, COUNTER_TREND_RSI, COUNTER_TREND_RS = 55.0, 45.0, 72.0, 0.70
PROBABILITY, HOLD_PROBABILITY, WATCH_PROBABILITY, MIDDAY_PROBABILITY, EXPECTANCY = 0.52, 0.47, 0.45, 0.55, 0.15
SHORT_STOP_PERCENT, REVERSION_STOP_PERCENT, CLOSING_CUTOFF = 2.5, 3.0, "14:30"


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def direction(super_up: Column, close: Column, ema_20: Column, above_vwap: Column | None = None, held: Column | None = None) -> Column:
    """LONG, SHORT or null (no bias).

    Supertrend and the short mean must agree; where `above_vwap` is known, two of three decide.  A held
    position keeps its direction (`held`).
    """
    above, below = _sure(close > ema_20), _sure(close < ema_20)
    up = _sure(super_up)
    bull, bear = up & above, ~up & below
    if above_vwap is not None:
        votes = up.cast("int") + above.cast("int") + above_vwap.cast("int")
        against = (~up).cast("int") + below.cast("int") + (~above_vwap).cast("int")
        bull, bear = F.when(above_vwap.isNull(), bull).otherwise(votes >= 2), F.when(above_vwap.isNull(), bear).otherwise(against >= 2)
    found = F.when(bull, "LONG").when(bear, "SHORT")
    return found if held is None else F.coalesce(held, found)


def reverts(regime: Column, confirmed: Column) -> Column:
    """Whether the market is a confirmed range, which allows entries against its extremes."""
    return _sure((regime == "RANGE") & confirmed)


def regime_gate(side: Column, regime: Column, confirmed: Column, rsi: Column, close: Column, ema_20: Column, ema_50: Column, ema_200: Column, held: Column | None = None) -> Column:
    """Whether the regime lets the side in: trends their way, expansion both; ranges by RSI; leaders of a down trend by their means."""
    range_ = reverts(regime, confirmed)
    sure = _sure(confirmed)
    stacked = (close > ema_20) & F.when(ema_50 > 0, (ema_20 > ema_50) & (ema_50 > ema_200)).otherwise(ema_20 > ema_200)
    leader = (regime == "TREND_DOWN") & sure & stacked & (F.coalesce(rsi, F.lit(50.0)) <= COUNTER_TREND_RSI)
    if held is not None:
        leader = leader & ~_sure(held)
    long = (regime.isin("TREND_UP", "EXPANSION") & sure) | (range_ & (F.coalesce(rsi, F.lit(50.0)) <= REVERSION_LONG_RSI)) | leader
    short = (regime.isin("TREND_DOWN", "EXPANSION") & sure) | (range_ & (F.coalesce(rsi, F.lit(50.0)) >= REVERSION_SHORT_RSI))
    return _sure(F.when(side == "LONG", long).when(side == "SHORT", short).otherwise(True))


def structure_gate(side: Column, close: Column, ema_200: Column) -> Column:
    """Longs above the long mean, shorts not above it."""
    above = _sure(close > ema_200)
    return F.when(side == "LONG", above).when(side == "SHORT", ~above).otherwise(True)


def counter_trend_gate(side: Column, regime: Column, rs: Column, held: Column | None = None, least: float = COUNTER_TREND_RS) -> Column:
    """New longs in a down trend need a strong relative-strength score."""
    against = _sure((side == "LONG") & (regime == "TREND_DOWN"))
    if held is not None:
        against = against & ~_sure(held)
    return ~against | _sure(rs >= least)


def horizon(side: Column, phase: Column, adx: Column, intraday: bool = False, short_is_intraday: bool = True) -> Column:
    """INTRADAY or SWING by the session's phase and trend strength; always SWING without intraday data."""
    if not intraday:
        return F.lit("SWING")
    short = (side == "SHORT") if short_is_intraday else F.lit(False)
    return F.when(_sure(short | (phase == "OPENING_RANGE") | ((adx < 20) & (phase != "CLOSING_TREND"))), "INTRADAY").otherwise("SWING")


def display_horizon(side: Column, entry: Column, stop: Column, mean_reversion: Column, intraday: bool = False, short_is_intraday: bool = True) -> Column:
    """INTRADAY or SWING for a row that carries none, by how near its stop is."""
    if not intraday:
        return F.lit("SWING")
    percent = F.when(entry > 0, F.abs(entry - stop) / entry * 100).otherwise(5.0)
    near = (percent < SHORT_STOP_PERCENT) | (_sure(mean_reversion) & (percent < REVERSION_STOP_PERCENT))
    return F.when(_sure(((side == "SHORT") & F.lit(short_is_intraday)) | near), "INTRADAY").otherwise("SWING")


def cutoff_gate(trade_horizon: Column, phase: Column, clock: Column, held: Column | None = None, cutoff: str = CLOSING_CUTOFF) -> Column:
    """No new intraday entries in the closing phase from `cutoff` on; clock is a local HH:mm text."""
    late = _sure((trade_horizon == "INTRADAY") & (phase == "CLOSING_TREND") & (clock >= cutoff))
    return ~(late & ~_sure(held)) if held is not None else ~late


def regime_threshold(regime: Column, default: float = PROBABILITY) -> Column:
    """The least probability in a regime; unknown ones take `default`."""
    found = F.lit(None).cast("double")
    for name, value in REGIME_THRESHOLDS.items():
        found = F.when(regime == name, value).otherwise(found)
    return F.coalesce(found, F.lit(default))


def tier(probability: Column, expectancy: Column, held: Column, midday: Column | None = None, least: Column | float = PROBABILITY, watch: bool = True) -> Column:
    """SELECT, WATCH or REJECT.

    Held positions need less (hysteresis), breakouts at midday (`midday`) more; a near miss with an
    edge is watched.  A watched row needs no more than a non-negative expectancy.
    """
    limit = F.when(held, HOLD_PROBABILITY).otherwise(least)
    if midday is not None:
        limit = F.when(_sure(midday) & ~held, F.greatest(limit, F.lit(MIDDAY_PROBABILITY))).otherwise(limit)
    watched = (probability >= WATCH_PROBABILITY) & (expectancy >= 0) & F.lit(watch)
    enough = expectancy >= F.when(held, F.least(F.lit(EXPECTANCY), F.lit(0.0))).otherwise(EXPECTANCY)
    return F.when(_sure((probability >= limit) & enough), "SELECT").when(_sure((probability < limit) & watched), "WATCH").otherwise("REJECT")


def reasons(*named: tuple[Column, Column | str]) -> Column:
    """An array of the texts whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(_sure(when), F.lit(text) if isinstance(text, str) else text) for when, text in named)))


def score_reasons(side: Column, regime: Column, confirmed: Column, rr: Column) -> Column:
    """Why a scored candidate ranks: factor scores over their marks, trend strength, the regime and the reward."""
    c = F.col
    return reasons(
        (c("trend") > 0.7, "Trend"),
        (c("momentum") > 0.6, F.format_string("Momentum:RSI%d", F.rint("rsi").cast("int"))),
        (c("volume") > 0.6, "Volume"),
        (c("volatility") > 0.6, "Coiled"),
        (c("rs_score") > 0.6, F.format_string("RS#%d", c("sector_rank").cast("int"))),
        (c("quality") > 0.6, "Quality"),
        (c("adx") >= 25, F.format_string("ADX%d", F.rint("adx").cast("int"))),
        (reverts(regime, confirmed), "MeanReversion"),
        ((side == "LONG") & (regime == "TREND_DOWN"), "CounterTrend"),
        ((side == "LONG") & (regime == "TREND_DOWN") & (c("rs_score") >= COUNTER_TREND_RS), "Leader"),
        (F.lit(True), F.concat(F.lit("Regime:"), F.coalesce(regime, F.lit("UNKNOWN")))),
        (rr.isNotNull(), F.concat(F.lit("RR:"), F.round(rr, 1).cast("string"))),
    )


def entry_guard(points: DataFrame, surveillance: DataFrame, sectors: DataFrame) -> DataFrame:
    """points (point_id, ticker, session, sector) with `reason` not to enter at the opening; null where entry is free.

    What is known at 09:15 in India counts: the surveillance state must be CLEAR, and the sector (sector_index of
    `sectors`) still the candidate's.
    """
    opening = F.col("session") + F.expr("interval 225 minutes")
    asked = points.withColumn("asof", opening)
    state = bitemporal.valid_interval(asked, surveillance).select("point_id", F.col("state").alias("__state"))
    sector = bitemporal.valid_interval(asked, sectors).select("point_id", F.col("sector_index").alias("__sector"))
    known = points.join(state, "point_id", "left").join(sector, "point_id", "left")
    reason = (
        F.when(F.col("__state").isNull(), "entry_surveillance_unavailable").when(F.col("__state") != "CLEAR", F.concat(F.lit("entry_surveillance_"), F.lower("__state")))
        .when(~F.coalesce(F.col("__sector") == F.col("sector"), F.lit(False)), "entry_sector_mapping_changed_or_unavailable")
    )
    return known.withColumn("reason", reason).drop("__state", "__sector")
