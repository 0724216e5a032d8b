"""Gates, probabilities, price targets and position sizes as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.curves import clip, sigmoid
from tidemark.operators.indicators import by_ticker, sliding

#: Multiples of the average true range for stop and targets, by horizon.
TARGETS = {"INTRADAY": (0.50, 1.20, 1.80), "SWING": (1.50, 3.80, 6.00)}
KURTOSIS_BARS, KURTOSIS_LEAST, KURTOSIS_DEFAULT = 252, 60, 4.0
REQUIRED = ("close", "ema_20", "ema_50", "ema_200", "atr", "atr_50_mean", "atr_pctile", "rsi", "adx", "macd_hist")


def static_filter(bars: DataFrame, least_bars: int, least_turnover: float) -> DataFrame:
    """Bars of tickers with enough history and a mean 20-bar turnover above the floor, at each session."""
    turnover = sliding(F.col("close") * F.col("volume"), -19, 0, full=False)
    seen = F.count(F.lit(1)).over(by_ticker())
    return bars.withColumns({"__n": seen, "__t": turnover}).where((F.col("__n") >= least_bars) & (F.col("__t") >= least_turnover)).drop("__n", "__t")


def quality_reason(names: tuple[str, ...] = REQUIRED) -> Column:
    """The first required column that is null or NaN; null for a complete row."""
    return F.coalesce(*(F.when(F.col(n).isNull() | F.isnan(n), F.lit(n)) for n in names))


def with_targets(rows: DataFrame, horizon: str = "SWING") -> DataFrame:
    """rows (direction, close, atr) with stop, target1, target2 and the reward-risk ratio of the first."""
    stop, first, second = TARGETS[horizon]
    sign, risk = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0), stop * F.col("atr")
    at = lambda m: F.round(F.col("close") + sign * m * F.col("atr"), 2)
    out = rows.withColumns({"stop": at(-stop), "target1": at(first), "target2": at(second)})
    return out.withColumn("rr", F.when(risk > 0, F.round(F.abs(F.col("target1") - F.col("close")) / risk, 2)).otherwise(0.0))


def with_kurtosis(bars: DataFrame) -> DataFrame:
    """bars with `excess_kurtosis` of each session's last 252 returns."""
    w = by_ticker().rowsBetween(1 - KURTOSIS_BARS, 0)
    out = bars.withColumn("__ret", F.col("close") / F.lag("close").over(by_ticker()) - 1)
    value = F.when(F.count("__ret").over(w) >= KURTOSIS_LEAST, F.kurtosis("__ret").over(w))
    return out.withColumn("excess_kurtosis", F.coalesce(clip(value, 0.0, 20.0), F.lit(KURTOSIS_DEFAULT))).drop("__ret")


def with_size(rows: DataFrame, a: float, b: float, risk: float = 5_000.0, share: float = 0.5, most: float = 2.0, least_shares: int = 1, fraction: Column | float = 1.0) -> DataFrame:
    """rows (close, stop, rr, composite, excess_kurtosis) with probability, kelly, shares, risk_amount and expectancy.

    The Kelly fraction shrinks by 3 / (3 + excess kurtosis); the risk is held between a quarter and
    `most` times the usual one; a share that alone risks more than that isn't bought.  `fraction` scales all of these.
    """
    c = F.col
    part = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    per_share = F.abs(c("close") - c("stop"))
    p = sigmoid(c("composite"), a, b)
    out = rows.withColumn("probability", p)
    kelly = F.when(c("rr") > 0, F.greatest(F.lit(0.0), (c("probability") * (c("rr") + 1) - 1) / c("rr"))).otherwise(0.0) * share * 3.0 / (3.0 + c("excess_kurtosis"))
    out = out.withColumn("kelly", F.round(kelly, 5))
    budget = F.greatest(risk * 0.25 * part, F.least(risk * most * part, risk * F.greatest(kelly, F.lit(0.01)) * part))
    whole = (budget / per_share).cast("long")
    shares = F.when((per_share <= 0) | (part <= 0) | ((whole <= 0) & (per_share > risk * most * part)), 0).otherwise(F.greatest(whole, F.lit(least_shares)))
    out = out.withColumn("shares", shares.cast("long")).withColumn("risk_amount", F.round(c("shares") * per_share, 2))
    return out.withColumn("expectancy", F.round(c("probability") * c("rr") - (1 - c("probability")), 4))
