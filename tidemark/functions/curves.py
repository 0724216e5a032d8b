"""Score curves as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (input, score) knots of piecewise-linear curves, flat outside their ends.
RSI_LONG = [(38.0, 0.10), (42.0, 0.85), (45.0, 0.85), (48.0, 1.0), (73.0, 1.0), (78.0, 0.20)]
RSI_SHORT = [(22.0, 0.20), (27.0, 1.0), (52.0, 1.0), (58.0, 0.0), (65.0, 0.0), (70.0, 0.10)]
ADX = [(18.0, 0.0), (20.0, 0.5), (25.0, 1.0)]
STOCH_LONG = [(15.0, 0.0), (20.0, 1.0), (80.0, 1.0), (90.0, -0.30)]
STOCH_SHORT = [(10.0, -0.30), (20.0, 1.0), (80.0, 1.0), (85.0, 0.0)]
RVOL_START, RVOL_KNEE, RVOL_FULL = (0.95, 0.0), (1.10, 0.10), (2.0, 1.0)
DRY_UP_SCORE = 0.40


def clip(x: Column, low: float, high: float) -> Column:
    """x held within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def piecewise(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between the knots, flat outside; null stays null."""
    out = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):
        out = F.when(x < x1, F.lit(y0) + F.lit(y1 - y0) * ((x - x0) / (x1 - x0))).otherwise(out)
    return F.when(x.isNotNull(), F.when(x <= knots[0][0], F.lit(knots[0][1])).otherwise(out))


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = clip((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def relative_volume(rvol: Column, dry_up: Column) -> Column:
    """0 up to the start, a smooth take-off to the knee, then linear; dry-ups score a fixed value."""
    (x0, _), (x1, y1) = RVOL_START, RVOL_KNEE
    rising = F.least(F.lit(1.0), piecewise(rvol, [RVOL_KNEE, RVOL_FULL]))
    return F.when(dry_up, F.lit(DRY_UP_SCORE)).when(rvol <= x0, F.lit(0.0)).when(rvol < x1, smoothstep(x0, x1, rvol) * y1).otherwise(rising)


def sigmoid(x: Column, a: float | Column, b: float | Column) -> Column:
    """1 / (1 + exp(a x + b))."""
    return 1.0 / (1.0 + F.exp(x * a + b))


def percentile_bucket(x: Column, width: int = 20) -> Column:
    """Labels like `20-40`; the last bucket holds 100, null is UNKNOWN."""
    low = F.least(F.floor(x / width) * width, F.lit(100 - width)).cast("int")
    return F.when(x.isNull() | F.isnan(x), "UNKNOWN").otherwise(F.concat_ws("-", low, low + width))
