"""Seven factor scores in [0, 1] for either direction, their composite, and cohort blending.

All inputs are the columns of `indicators.add_indicators` plus rs and sector_rank; every score is a
column expression over windows of one ticker, so scoring any set of sessions is one pass.
Defined results: a missing optional input takes the default stated below; a null required input
gives a null score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import curves
from tidemark.functions.curves import clip
from tidemark.operators.indicators import by_ticker, sliding, streak

NAMES = ("trend", "momentum", "volume", "volatility", "rs_score", "breakout", "quality")
#: Factor weights by regime, in the order of NAMES; any other label weighs all alike.
REGIME_WEIGHTS = {
    "TREND_UP": (0.22, 0.22, 0.10, 0.05, 0.22, 0.14, 0.05),
    "RANGE": (0.05, 0.20, 0.25, 0.25, 0.05, 0.05, 0.15),
    "TREND_DOWN": (0.25, 0.15, 0.08, 0.04, 0.25, 0.20, 0.03),
    "EXPANSION": (0.15, 0.25, 0.20, 0.03, 0.10, 0.25, 0.02),
    "PANIC": (0.10, 0.25, 0.08, 0.30, 0.20, 0.03, 0.04),
}
PROFILE_BARS, PROFILE_BINS, VALUE_AREA = 30, 100, 0.70
#: What rounding leaves where a value is zero, or two are equal.
NEGLIGIBLE = 1e-9


def _points(*parts: tuple[Column, float]) -> Column:
    """The weights of the conditions that hold."""
    total = F.lit(0.0)
    for condition, weight in parts:
        total = total + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
    return total


def _either(long: Column, up: Column, down: Column) -> Column:
    return F.when(long, up).otherwise(down)


def profile_rows(low: list, high: list, volume: list, close: np.ndarray, bins: int) -> np.ndarray:
    """(rows, 3): point of control and value area of each row's bars, all rows of a batch at once."""
    n, width = len(low), max((len(x) for x in low), default=0)
    lo, hi, vol = (np.full((n, max(width, 1)), np.nan) for _ in range(3))
    for k in range(n):
        m = len(low[k])
        lo[k, :m], hi[k, :m], vol[k, :m] = low[k], high[k], volume[k]
    count = np.array([len(x) for x in low])
    bottom, top = np.nanmin(lo, axis=1), np.nanmax(hi, axis=1)
    flat = (count < 5) | ~(top > bottom)
    levels = np.linspace(bottom, np.where(flat, bottom + 1, top), bins + 1, axis=1)
    first = np.clip((levels[:, None, :] < lo[:, :, None]).sum(2) - 1, 0, bins - 1)
    last = np.clip((levels[:, None, :] <= hi[:, :, None]).sum(2), 0, bins - 1)
    share = np.where((hi >= lo) & (vol > 0), vol / np.maximum(last - first + 1, 1), 0.0)
    hist = np.zeros((n, bins))
    place = np.arange(bins)
    for k in range(lo.shape[1]):
        hist += np.where((first[:, k, None] <= place) & (place <= last[:, k, None]), share[:, k, None], 0.0)
    each = np.arange(n)
    peak = hist.argmax(1)
    a, b, held = peak.copy(), peak.copy(), hist[each, peak]
    goal = hist.sum(1) * VALUE_AREA * (1 - NEGLIGIBLE)  # sums in another order may end a hair apart
    for _ in range(bins):
        grow = (held < goal) & ((a > 0) | (b < bins - 1))
        if not grow.any():
            break
        below = np.where(a > 0, hist[each, np.maximum(a - 1, 0)], -1.0)
        above = np.where(b < bins - 1, hist[each, np.minimum(b + 1, bins - 1)], -1.0)
        down = grow & (below >= above * (1 - NEGLIGIBLE)) & (a > 0)
        up = grow & ~down
        a, b = a - down, b + up
        held = held + np.where(down, below, 0.0) + np.where(up, above, 0.0)
    out = np.stack([(levels[each, peak] + levels[each, peak + 1]) / 2, levels[each, a], levels[each, np.minimum(b + 1, bins)]], axis=1)
    return np.where(flat[:, None], close[:, None] * np.array([1.0, 0.99, 1.01]), out)


def volume_profile(bars: DataFrame, lookback: int = PROFILE_BARS, bins: int = PROFILE_BINS) -> DataFrame:
    """bars with poc, val, vah of the last `lookback` bars of every session.

    A bar's volume spreads evenly over the price bins that it touches.  The fullest bin (the lowest
    of ties) is the point of control; the value area grows from it, one bin at a time, to the fuller
    neighbour (the lower of ties) until it holds the stated share of the volume.  The bars of a
    window, at most `lookback`, are arrays in the row; Arrow batches of rows are handled at once.
    """
    w = by_ticker().rowsBetween(1 - lookback, 0)

    @F.pandas_udf("poc double, val double, vah double")
    def profile(low: pd.Series, high: pd.Series, volume: pd.Series, close: pd.Series) -> pd.DataFrame:
        parts = [profile_rows(*(list(x.iloc[k : k + 500]) for x in (low, high, volume)), close.iloc[k : k + 500].to_numpy(float), bins) for k in range(0, len(low), 500)]
        return pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, 3)), columns=["poc", "val", "vah"])

    arrays = bars.withColumns({f"__{c}": F.collect_list(c).over(w) for c in ("low", "high", "volume")})
    found = arrays.withColumn("__p", profile("__low", "__high", "__volume", "close"))
    return found.withColumns({c: F.col(f"__p.{c}") for c in ("poc", "val", "vah")}).drop("__low", "__high", "__volume", "__p")


def score_factors(bars: DataFrame, n_sectors: int, turnover_floor: float = 35_000_000.0, near_high_percent: float = 8.0, contraction: float = 0.85) -> DataFrame:
    """bars (with `direction`, rs, sector_rank, poc, val, vah) and the seven scores of NAMES."""
    c = F.col
    long = c("direction") == "LONG"
    close, atr, atr50 = c("close"), c("atr"), c("atr_50_mean")
    stacked = _either(long, (c("ema_20") > c("ema_50")) & (c("ema_50") > c("ema_200")), (c("ema_20") < c("ema_50")) & (c("ema_50") < c("ema_200")))
    beyond = lambda x: _either(long, close > x, close < x)
    with_trend = c("super_up") == long
    trend = _points((with_trend, 0.40), (beyond(c("ema_20")), 0.15), (beyond(c("ema_50")), 0.15), (beyond(c("ema_200")), 0.20), (with_trend, 0.10))
    trend = F.when(stacked, F.least(F.lit(1.0), trend + 0.05)).otherwise(trend)

    sign = F.when(long, F.lit(1.0)).otherwise(-1.0)
    macd = c("macd_hist") * sign
    faster = macd > F.coalesce(F.lag("macd_hist").over(by_ticker()), F.lit(0.0)) * sign
    stoch = F.when(c("stoch_k").isNull() | (F.abs("stoch_k") < NEGLIGIBLE), F.lit(50.0)).otherwise(c("stoch_k"))
    run = F.least(F.lit(1.0), _either(long, c("__up_run"), c("__dn_run")) * 0.25)
    momentum = (
        0.30 * _either(long, curves.piecewise(c("rsi"), curves.RSI_LONG), curves.piecewise(c("rsi"), curves.RSI_SHORT))
        + 0.25 * F.when((macd > 0) & faster, 1.0).when(macd > 0, 0.5).otherwise(0.0)
        + 0.15 * _either(long, curves.piecewise(stoch, curves.STOCH_LONG), curves.piecewise(stoch, curves.STOCH_SHORT))
        + 0.20 * curves.piecewise(c("adx"), curves.ADX)
        + 0.10 * run
    )
    # without an intraday count today's volume is the average, cut to an integer
    rvol = F.when(c("vol_avg_20") > 0, F.floor("vol_avg_20") / c("vol_avg_20")).otherwise(1.0)
    base50 = F.coalesce(atr50, atr)
    dry_up = (rvol < 0.80) & (base50 > 0) & (atr < 0.85 * base50)
    volume = (
        curves.relative_volume(rvol, dry_up) * 0.55
        + _points((_either(long, close > c("poc") - 0.3 * atr, close < c("poc") + 0.3 * atr), 0.25), (_either(long, close > c("val"), close < c("vah")), 0.15))
        + F.least(F.lit(0.05), (c("turnover_avg_20") / turnover_floor - 1) / 4 * 0.05)
    )
    coiled = (atr50 > 0) & (atr < contraction * atr50)
    calm = F.when(coiled, 0.70 + 0.30 * F.greatest(F.lit(0.0), (50 - c("atr_pctile")) / 50)).otherwise(F.greatest(F.lit(0.0), 0.40 - (F.when(atr50 > 0, atr / atr50).otherwise(1.0) - 1.0) * 0.30))
    calm = F.when(c("bb_squeeze"), F.least(F.lit(1.0), calm + 0.15)).otherwise(calm)
    volatility = F.when(atr50.isNull() | c("atr_pctile").isNull(), 0.0).otherwise(calm)

    spread = max(n_sectors - 1, 1)
    rank = F.coalesce(c("sector_rank"), F.lit(n_sectors))
    relative = F.greatest(F.lit(0.0), _either(long, n_sectors - rank, rank - 1) / spread) * 0.60 + clip((c("rs") * sign + 5) / 10, 0.0, 1.0) * 0.40

    width = F.when(c("bb_width").isNull() | (c("bb_width") == 0), F.lit(0.05)).otherwise(c("bb_width"))
    usual = F.coalesce(c("__bw_50"), width)
    away = _either(long, F.when(c("__high_252") > 0, (c("__high_252") - close) / c("__high_252") * 100).otherwise(100.0), F.when(close > 0, (close - c("__low_20")) / close * 100).otherwise(100.0))
    breakout = F.greatest(F.lit(0.0), 1.0 - away / near_high_percent) * 0.65 + _points(((usual > 0) & (width < usual * 0.85), 0.35))

    drift = F.when(c("__close_63") > 0, F.log(close / c("__close_63")) * sign).otherwise(0.0)
    quality = (
        F.when(c("__bar") >= 64, clip((drift + 0.10) / 0.20, 0.0, 1.0)).otherwise(0.5) * 0.50
        + _either(long, c("__up_20"), c("__dn_20")) * 0.30
        + F.when(base50 > 0, clip((atr / base50 - 0.8) / 0.8, 0.0, 1.0)).otherwise(0.5) * 0.20
    )
    w = by_ticker()
    features = bars.withColumns(
        {
            "__up_run": streak(c("up_day")), "__dn_run": streak(c("dn_day")), "__bw_50": sliding(c("bb_width"), -49, 0),
            "__high_252": sliding(c("high"), -251, 0, F.max, full=False), "__low_20": sliding(c("low"), -19, 0, F.min, full=False),
            "__close_63": F.lag("close", 63).over(w), "__bar": F.row_number().over(w),
            "__up_20": sliding(c("up_day"), -19, 0, full=False), "__dn_20": sliding(c("dn_day"), -19, 0, full=False),
        }
    )
    scores = dict(zip(NAMES, (trend, momentum, volume, volatility, relative, breakout, F.round(clip(quality, 0.0, 1.0) + NEGLIGIBLE, 4))))
    helpers = [x for x in features.columns if x.startswith("__")]
    # rounded, so that equal scores stay equal in ranks whatever the order of their sums
    return features.withColumns({k: F.round(clip(v, 0.0, 1.0), 9) for k, v in scores.items()}).drop(*helpers)


def composite(scored: DataFrame) -> DataFrame:
    """scored (with `regime`) and the weighted sum of its scores; unknown regimes weigh all alike.

    Rows with factor_weights, an array in the order of NAMES, are weighed by it; one of another length counts as none.
    """
    value = F.lit(None).cast("double")
    for regime, weights in REGIME_WEIGHTS.items():
        value = F.when(F.col("regime") == regime, sum(F.col(n) * w for n, w in zip(NAMES, weights))).otherwise(value)
    if "factor_weights" in scored.columns:
        own = sum(F.col(n) * F.col("factor_weights")[k] for k, n in enumerate(NAMES))
        value = F.coalesce(F.when(F.size("factor_weights") == len(NAMES), own), value)
    equal = sum(F.col(n) for n in NAMES) / len(NAMES)
    return scored.withColumn("composite", F.round(F.coalesce(value, equal), 4))


def blend_cohorts(scored: DataFrame, weight: float = 0.40, least: int = 10, full: int = 30) -> DataFrame:
    """Scores moved towards their rank among the session's candidates of one direction.

    The weight ramps from `least` to `full` candidates and is damped where the cohort's mean score is
    under one half; a score that all share stays.  Ties take their average rank.
    """
    cohort = Window.partitionBy("session", "direction")
    n = F.count(F.lit(1)).over(cohort)
    ramp = clip((n - least) / float(full - least), 0.0, 1.0) * weight if full > least else F.lit(weight)
    out = scored.withColumn("__n", n).withColumn("__w", F.when((F.col("__n") < least) | (F.col("__n") <= 1), 0.0).otherwise(ramp))
    columns = {}
    for name in NAMES:
        x = F.col(name)
        rank = F.rank().over(cohort.orderBy(name)) + (F.count(F.lit(1)).over(Window.partitionBy("session", "direction", name)) - 1) / 2.0
        same = F.max(x).over(cohort) - F.min(x).over(cohort) <= 1e-6
        target = F.when(same, x).otherwise((rank - 1.0) / (F.col("__n") - 1.0))
        tape = clip(F.avg(x).over(cohort) / 0.50, 0.0, 1.0)
        columns[name] = F.when(F.col("__w") > 0, clip(x + F.col("__w") * (target - x) * tape, 0.0, 1.0)).otherwise(x)
    return out.withColumns(columns).drop("__n", "__w")
