"""Market state by session: breadth, relative strength, sector ranks and the regime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.curves import clip
from tidemark.operators.indicators import by_ticker

#: Thresholds of the regime classification.
PANIC, PANIC_EXIT = 0.25, 0.35
EXPANSION_ATR, ADX_TREND, ADX_RANGE = 1.3, 25.0, 18.0
TREND_UP_BREADTH, TREND_DOWN_BREADTH = 0.55, 0.45
CONFIRM_SESSIONS, RS_LOOKBACK = 2, 20


def benchmark(bars: DataFrame) -> DataFrame:
    """(session, bench): the mean close of each session, as a market series."""
    return bars.groupBy("session").agg(F.avg("close").alias("bench"))


def relative_strength(bars: DataFrame, bench: DataFrame, lookback: int = RS_LOOKBACK) -> DataFrame:
    """bars with rs: 100 x the log return over `lookback` joined sessions less the benchmark's; 0 with fewer.

    The benchmark has one row a session; the join is on session, and the planner broadcasts it while
    it is below the session's own size limit.
    """
    both = bars.join(bench, "session")
    w = by_ticker()
    change = lambda c: F.log(F.col(c) / F.lag(c, lookback).over(w))
    return both.withColumn("rs", F.coalesce(F.round((change("close") - change("bench")) * 100, 3), F.lit(0.0)))


def sector_strength(rs: DataFrame) -> DataFrame:
    """(session, sector, sector_rs, sector_rank): median of the members' rs; rank 1 is the strongest."""
    medians = rs.where("sector is not null").groupBy("session", "sector").agg(F.round(F.median("rs"), 3).alias("sector_rs"))
    return medians.withColumn("sector_rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("sector_rs"), "sector")))


def session_metrics(indicators: DataFrame) -> DataFrame:
    """(session, breadth, adx_median, atr_ratio) with their defaults where nothing can be measured."""
    ratio = F.when(F.col("atr_50_mean") > 0, F.col("atr") / F.col("atr_50_mean"))
    above = F.when(F.col("ema_50").isNotNull(), (F.col("close") > F.col("ema_50")).cast("int"))
    return indicators.groupBy("session").agg(
        F.coalesce(F.avg(above), F.lit(0.5)).alias("breadth"),
        F.coalesce(F.median("adx"), F.lit(20.0)).alias("adx_median"),
        F.coalesce(F.median(ratio), F.lit(1.0)).alias("atr_ratio"),
    )


def calm_regime() -> Column:
    """The label of a session that isn't in panic."""
    breadth, adx = F.col("breadth"), F.col("adx_median")
    by_breadth = F.when(breadth >= TREND_UP_BREADTH, "TREND_UP").when(breadth < TREND_DOWN_BREADTH, "TREND_DOWN").otherwise("RANGE")
    return (
        F.when((F.col("atr_ratio") >= EXPANSION_ATR) & (adx >= ADX_TREND), "EXPANSION")
        .when((adx < ADX_RANGE) & (adx < ADX_TREND), "RANGE")
        .otherwise(by_breadth)
    )


def regimes(metrics: DataFrame) -> DataFrame:
    """metrics with regime, confirmed and breadth_delta.

    Panic has two thresholds, so its state follows from the last session whose breadth lay outside
    both: below the lower one panic begins, at or above the upper one it ends.  That is a window
    expression; the market's sessions, one small row each, are its only partition.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("session")
    breadth = F.col("breadth")
    turn = F.when(breadth < PANIC, True).when(breadth >= PANIC_EXIT, False)
    panic = F.coalesce(F.last(turn, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    out = metrics.withColumn("regime", F.when(panic, "PANIC").otherwise(calm_regime()))
    same = F.lit(True)
    for k in range(1, CONFIRM_SESSIONS):
        same = same & (F.lag("regime", k).over(w) == F.col("regime"))
    return out.withColumns(
        {
            "confirmed": (F.col("regime") == "PANIC") | F.coalesce(same, F.lit(False)),
            "breadth_delta": F.round(breadth - F.coalesce(F.lag("breadth").over(w), F.lit(0.0)), 4),
        }
    )


def confidence(state: DataFrame) -> DataFrame:
    """state (regime, breadth, adx_median, atr_ratio, sector_concentration) with confidence in [0, 1]."""
    adx = clip((F.col("adx_median") - ADX_TREND) / 15.0, 0.0, 1.0)
    spread = clip(F.abs(F.col("breadth") - 0.5) * 2.0, 0.0, 1.0)
    bonus = clip((F.col("sector_concentration") - 0.5) * 2.0, 0.0, 1.0) * 0.10
    trend = F.round(clip(0.50 + adx * 0.30 + spread * 0.20 + bonus, 0.0, 1.0), 3)
    expansion = F.round(clip(0.55 + adx * 0.25 + clip((F.col("atr_ratio") - EXPANSION_ATR) / 0.7, 0.0, 1.0) * 0.20, 0.0, 1.0), 3)
    panic = clip(0.70 + (PANIC - F.col("breadth")) * 2, 0.70, 1.0)
    return state.withColumn(
        "confidence",
        F.when(F.col("regime") == "PANIC", panic).when(F.col("regime").isin("TREND_UP", "TREND_DOWN"), trend).when(F.col("regime") == "EXPANSION", expansion).otherwise(0.55),
    )


def sector_concentration(sectors: DataFrame, state: DataFrame) -> DataFrame:
    """state with the share of sectors whose rs points the regime's way; 0.5 outside trends."""
    shares = sectors.groupBy("session").agg(F.avg((F.col("sector_rs") > 0).cast("int")).alias("__up"), F.avg((F.col("sector_rs") < 0).cast("int")).alias("__down"))
    share = F.when(F.col("regime") == "TREND_UP", F.round("__up", 3)).when(F.col("regime") == "TREND_DOWN", F.round("__down", 3))
    return state.join(shares, "session", "left").withColumn("sector_concentration", F.coalesce(share, F.lit(0.5))).drop("__up", "__down")


def market_state(indicators: DataFrame, sectors: DataFrame) -> DataFrame:
    """One row a session: metrics, regime, confirmation, concentration and confidence."""
    return confidence(sector_concentration(sectors, regimes(session_metrics(indicators))))
