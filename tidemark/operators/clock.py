"""The exchange's clock as columns: session labels, market phases, the regime lock and completed bars.

Times are instants; `zone` is the exchange's.  A null instant gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZONE = "Asia/Kolkata"
#: The trading day, in exchange time.
OPEN, ENTRY_START, MORNING_END, MIDDAY_END, ENTRY_CUTOFF, SQUARE_OFF, CLOSE = "09:15", "09:30", "10:15", "13:30", "14:30", "15:15", "15:30"
LOCK_MINUTES = 20


def _minute(text: str) -> int:
    hours, minutes = text.split(":")
    return 60 * int(hours) + int(minutes)


def day_minute(ts: Column, zone: str = ZONE) -> Column:
    """Minutes since midnight in exchange time, seconds dropped."""
    local = F.from_utc_timestamp(ts, zone)
    return F.hour(local) * 60 + F.minute(local)


def _steps(ts: Column, zone: str, steps: list[tuple[str, str]], last: str) -> Column:
    minute, out = day_minute(ts, zone), F.lit(last)
    for end, label in reversed(steps):
        out = F.when(minute < _minute(end), label).otherwise(out)
    return F.when(ts.isNotNull(), out)


def session_label(ts: Column, zone: str = ZONE) -> Column:
    """OPENING_RANGE, MIDDAY_CHOP or CLOSING_TREND."""
    return _steps(ts, zone, [(MORNING_END, "OPENING_RANGE"), (MIDDAY_END, "MIDDAY_CHOP")], "CLOSING_TREND")


def market_phase(ts: Column, zone: str = ZONE) -> Column:
    """The phase of the trading day, from PRE_MARKET to POST_MARKET."""
    ends = [(OPEN, "PRE_MARKET"), (ENTRY_START, "OPENING_NOISE"), (MORNING_END, "PRIME_MORNING"), (MIDDAY_END, "MIDDAY_CHOP"), (ENTRY_CUTOFF, "AFTERNOON_EXPANSION"), (CLOSE, "INTRADAY_FREEZE")]
    return _steps(ts, zone, ends, "POST_MARKET")


def minutes_to_square_off(ts: Column, zone: str = ZONE) -> Column:
    """Whole minutes left until positions of the day are squared off; 0 after that."""
    local = F.from_utc_timestamp(ts, zone)
    seconds = F.lit(60 * _minute(SQUARE_OFF)) - (F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local))
    return F.greatest(F.lit(0), F.floor(seconds / 60)).cast("int")


def regime_locked(ts: Column, minutes: int = LOCK_MINUTES, zone: str = ZONE) -> Column:
    """Whether the regime is frozen: the first minutes after the market's opening."""
    minute = day_minute(ts, zone)
    return (minute >= _minute(OPEN)) & (minute < _minute(OPEN) + minutes)


def completed_bars(bars: DataFrame, now: Column, zone: str = ZONE) -> DataFrame:
    """bars without future sessions and without today's before the market's close."""
    today, session = F.to_date(F.from_utc_timestamp(now, zone)), F.to_date("session")
    return bars.where((session < today) | ((session == today) & (day_minute(now, zone) >= _minute(CLOSE))))


def locked_regimes(states: DataFrame, minutes: int = LOCK_MINUTES, zone: str = ZONE, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """states (market, ts, regime) with `held`, the regime that holds: inside the lock the last one from before it; `order` tells states of one time apart."""
    w = Window.partitionBy("market").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    locked = regime_locked(F.col("ts"), minutes, zone)
    return states.withColumn("held", F.coalesce(F.last(F.when(~locked, F.col("regime")), ignorenulls=True).over(w), F.col("regime")))
