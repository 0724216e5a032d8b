"""Grids of setup parameters over one set of bars, and results by variant, period and strategy.

A grid changes one parameter at a time around the defaults; it is no search.  All variants are one plan: indicators and
ordinals are computed once, and parameters are columns of the plans (see setups.swing_variants).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.statistics import nearest_mean
from tidemark.operators import outcomes
from tidemark.operators.indicators import by_ticker
from tidemark.operators.setups import Variant, fill_size, swing_variants


def one_at_a_time(**changes: dict[str, dict[str, object]]) -> tuple[Variant, ...]:
    """The default variant, and one for each named change of parameters."""
    return (Variant(), *(Variant(variant=name, **fields) for name, fields in changes.items()))


#: The prespecified grid: 11 variants.
GRID = one_at_a_time(
    **{f"breakout_lookback_{n}": {"lookback": n} for n in (15, 25)},
    **{f"breakout_rvol_{x}": {"least_rvol": x} for x in (1.1, 1.3)},
    **{f"both_time_exits_{n}": {"breakout_bars": n, "pullback_bars": n} for n in (10, 15, 20)},
    **{f"atr_stop_{x}": {"stop_ranges": x} for x in (0.5, 1.0, 1.5)},
)
#: The defaults under more slippage.
SLIPPAGE = one_at_a_time(slippage_2x={"slippage": 2.0}, slippage_3x={"slippage": 3.0})


def replay(indicators: DataFrame, bars: DataFrame, variants: tuple[Variant, ...] = GRID, bench: DataFrame | None = None, preset: str = "delivery", capital: float = 1_000_000.0) -> DataFrame:
    """Outcomes, net of costs, of every variant's plans that the next open fills: variant, strategy, trade_id, shares, gross_r, net_r, ...

    indicators: add_indicators' rows; bars: all bars, whose ordinals trades refer to.  An open outside a plan's bounds fills nothing.
    """
    c, w = F.col, by_ticker()
    ahead = outcomes.with_ordinals(bars).select("ticker", "session", c("ord").alias("signal_ord"), F.lead("open").over(w).alias("__open"), F.lead("session").over(w).alias("entry_session"))
    plans = swing_variants(indicators, variants, bench).join(ahead, ["ticker", "session"])
    filled = plans.withColumn("shares", fill_size(c("__open"), capital)).where("shares > 0").withColumn("entry", c("__open")).drop("__open").withColumnRenamed("session", "signal_session")
    trades = filled.withColumns({"trade_id": F.concat_ws("-", "variant", "ticker", "signal_ord"), "direction": F.lit("LONG")})
    cost = outcomes.friction_r(c("entry"), c("entry") - c("stop"), c("shares"), preset, c("slippage"))
    return outcomes.outcomes(trades, bars, cost)


def by_strategy(trades: DataFrame, period: Column) -> DataFrame:
    """(variant, period, strategy, trades, mean_gross_r, mean_net_r, win_rate, stopped) of replay's trades; a variant without trades has no row.

    R has four decimals, and means don't depend on the order of trades.
    """
    gross, net = F.col("gross_r"), F.col("net_r")
    found = trades.groupBy("variant", period.alias("period"), "strategy")
    return found.agg(F.count("*").alias("trades"), nearest_mean(gross).alias("mean_gross_r"), nearest_mean(net).alias("mean_net_r"), F.avg((net > 0).cast("int")).alias("win_rate"), F.count_if(gross <= -1).alias("stopped"))
