"""A whole scan of any set of sessions: filters, gates, scores, ranks, probabilities, targets, sizes and tiers in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import book, factors, gates, indicators, market, sizing
from tidemark.operators.plugs import Plug


def score_universe(
    bars: DataFrame,
    n_sectors: int,
    turnover_floor: float = 35_000_000.0,
    least_turnover: float | None = None,
    least_bars: int = 50,
    cohort: tuple[int, int] = (10, 30),
    platt: tuple[float, float] = (-4.0, 2.0),
    session_label: str = "CLOSING_TREND",
    fraction: float = 1.0,
    held: DataFrame | None = None,
    gate: Plug | None = None,
    scaler: Plug | None = None,
    weights: Plug | None = None,
) -> DataFrame:
    """Every bar that a scan of its session selects or watches, with its scores, levels, size, tier and reasons.

    bars: ticker, sector, session, open, high, low, close, volume.  held: session, ticker, held_direction of open positions, which
    pass the filters and need less probability.  least_turnover is the filter's floor, where it isn't the one that scores refer to.  Cohort ranks are taken among the candidates that passed the first gates.  A session without
    candidates gives no rows; bars before an indicator is known are no candidates.

    Plugs replace parts: `gate` the least probability of a selection, `scaler` the share of the usual risk (`fraction`), `weights`
    the regime's factor weights.
    """
    c = F.col
    lowest = turnover_floor if least_turnover is None else least_turnover
    # what looks over all bars comes first and is carried along, so that nothing is joined back by ticker and session
    rs = sizing.with_kurtosis(market.relative_strength(bars, market.benchmark(bars)))
    found = indicators.add_indicators(rs)
    state = market.regimes(market.session_metrics(found)).select("session", "regime", "confirmed")
    rows = found.join(market.sector_strength(rs), ["session", "sector"]).join(state, "session")
    if held is None:
        rows = rows.withColumn("held_direction", F.lit(None).cast("string"))
    else:
        rows = rows.join(held.select("session", "ticker", "held_direction"), ["session", "ticker"], "left")
    rows = rows.withColumn("held", c("held_direction").isNotNull()).withColumn("__side", gates.direction(c("super_up"), c("close"), c("ema_20"), held=c("held_direction")))
    # scores look back over all of a ticker's bars, so the gates come after them; a bar without a side is scored but never kept
    rows = rows.withColumn("direction", F.coalesce("__side", F.when(c("super_up"), "LONG").otherwise("SHORT")))
    rows = rows.withColumn("__bar", F.row_number().over(Window.partitionBy("ticker").orderBy("session")))
    passed = (
        c("__side").isNotNull()
        & (c("held") | ((c("__bar") >= least_bars) & F.coalesce(c("turnover_avg_20") >= lowest, F.lit(False))))
        & gates.regime_gate(c("direction"), c("regime"), c("confirmed"), c("rsi"), c("close"), c("ema_20"), c("ema_50"), c("ema_200"), c("held"))
        & gates.structure_gate(c("direction"), c("close"), c("ema_200"))
    )
    rows = rows.withColumn("__passed", passed)
    scored = factors.score_factors(factors.volume_profile(rows), n_sectors, turnover_floor)
    first = scored.where(c("__passed") & gates.counter_trend_gate(c("direction"), c("regime"), c("rs_score"), c("held")))
    blended = factors.blend_cohorts(first, least=cohort[0], full=cohort[1])
    ranked = factors.composite(weights.apply(blended) if weights else blended)
    # as a generator's one row, so that the filter on the tier isn't pushed below it with all scores written out in it
    adjusted = book.adjusted_composite(c("composite"), F.lit(session_label), c("regime"), c("direction"))
    ranked = ranked.withColumn("__adjusted", F.explode(F.array(adjusted))).withColumn("composite", c("__adjusted")).drop("__adjusted")
    aimed = sizing.with_targets(ranked)
    sized = sizing.with_size(scaler.apply(aimed) if scaler else aimed, *platt, fraction=c("capital_fraction") if scaler else fraction)
    least = gates.regime_threshold(c("regime"))
    if gate:
        sized, least = gate.apply(sized), c("least_probability")
    trail, time_stop = book.trade_management(c("direction"), c("close"), c("atr"), c("atr_pctile"))
    long = c("direction") == "LONG"
    stacked = F.when(long, (c("ema_20") > c("ema_50")) & (c("ema_50") > c("ema_200"))).otherwise((c("ema_20") < c("ema_50")) & (c("ema_50") < c("ema_200")))
    out = sized.withColumns(
        {
            "tier": gates.tier(c("probability"), c("expectancy"), c("held"), least=least),
            "trail_stop": trail,
            "time_stop": time_stop,
            "action": F.when(long, "BUY").otherwise("SELL"),
            "change_percent": F.round((c("close") / c("open") - 1) * 100, 2),
            "means_aligned": stacked,
            "reasons": gates.score_reasons(c("direction"), c("regime"), c("confirmed"), c("rr")),
        }
    )
    return out.where("tier != 'REJECT'").drop("__side", "__bar", "__passed", "held_direction")
