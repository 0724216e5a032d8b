"""Evidence models: breadth, complete sector ranks, earnings, growth and flow contexts, and decisions with every reason.

Contexts are made for all sessions at once, by windows over a ticker's sessions or by joins on equal
keys; a decision is one projection over a row that carries its contexts.  What isn't known is null, and a
gate on null fails under its own reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.curves import clip
from tidemark.functions.statistics import framed_median
from tidemark.operators.bitemporal import merged
from tidemark.operators.gates import reasons
from tidemark.operators.indicators import by_ticker, sliding

#: Weights of the alpha factors.
WEIGHTS = {"relative_strength": 0.30, "earnings": 0.25, "flow": 0.20, "sector": 0.15, "structure": 0.10}
#: Limits of the contexts and gates.
FULL_BREADTH, HALF_BREADTH, BREADTH_COVERAGE = 0.6, 0.4, 0.9
EPS_GROWTH, REVENUE_GROWTH, GROWTH_DAYS, EARNINGS_SESSIONS = 0.20, 0.15, 150, 20
FLOW_SESSIONS, RECENT, PRIOR = 20, 5, 20
#: Least trend strength by adaptive regime; an unknown regime admits nothing.
ADAPTIVE_ADX = {"BULL": 20.0, "BEAR": 30.0, "HIGH_VOL": 35.0, "RANGE": 0.0}


def breadth_risk(bars: DataFrame, n: int = 50, coverage: float = BREADTH_COVERAGE, full: float = FULL_BREADTH, half: float = HALF_BREADTH) -> DataFrame:
    """(session, breadth, breadth_valid, breadth_total, breadth_coverage, breadth_risk_scale).

    Breadth is the share of tickers above their n-bar mean among those with n positive closes; the scale is
    1 over `full`, one half from `half` on, else 0, and 0 where too few tickers can be judged.
    """
    good = F.when((F.col("close") > 0) & ~F.isnan("close"), F.col("close"))
    mean = bars.select("session", "close", sliding(good, 1 - n, 0).alias("__mean"))
    out = mean.groupBy("session").agg(
        F.avg(F.when(F.col("__mean").isNotNull(), (F.col("close") > F.col("__mean")).cast("int"))).alias("breadth"),
        F.count("__mean").alias("breadth_valid"), F.count("*").alias("breadth_total"),
    )
    share = F.col("breadth_valid") / F.col("breadth_total")
    scale = F.when(share < coverage, 0.0).when(F.col("breadth") > full, 1.0).when(F.col("breadth") >= half, 0.5).otherwise(0.0)
    return out.withColumns({"breadth_coverage": share, "breadth_risk_scale": scale})


def sector_fractions(indices: DataFrame, bench: DataFrame, lookback: int, declared: int) -> DataFrame:
    """(session, sector, sector_rs, sector_fraction) of indices (sector, session, close) against bench (session, bench).

    A session has ranks only if all `declared` sectors have a close at each of its last lookback + 1
    sessions; tied sectors take the worst place.
    """
    calendar = bench.withColumn("__ord", F.row_number().over(Window.orderBy("session")))  # one small row a session
    rows = indices.where(F.col("close") > 0).join(calendar, "session")
    w = Window.partitionBy("sector").orderBy("__ord")
    whole = F.count("close").over(w.rangeBetween(-lookback, 0)) == lookback + 1
    first, base = F.first("close").over(w.rangeBetween(-lookback, 0)), F.first("bench").over(w.rangeBetween(-lookback, 0))
    rs = rows.select("session", "sector", F.when(whole, (F.col("close") / first) / (F.col("bench") / base) - 1).alias("sector_rs")).where("sector_rs is not null")
    session = Window.partitionBy("session")
    place = F.count(F.lit(1)).over(session.orderBy(F.desc("sector_rs")).rangeBetween(Window.unboundedPreceding, 0))
    return rs.withColumns({"__n": F.count(F.lit(1)).over(session), "sector_fraction": place / F.lit(float(declared))}).where(F.col("__n") == declared).drop("__n")


def adaptive_regime(market: DataFrame, adx: DataFrame, trend: int = 200, expansion: float = 1.3, quiet: float = 18.0) -> DataFrame:
    """(session, adaptive_regime, adaptive_adx_min) of market (session, close, atr) and adx (session, adx_median).

    HIGH_VOL where the range is `expansion` times its mean over the 50 sessions before, else RANGE under
    `quiet`, else BULL or BEAR by the mean over `trend` sessions; UNKNOWN without any trend strength.
    """
    w = Window.orderBy("session")  # one small row a session
    before = w.rowsBetween(-50, -1)
    usual = F.when(F.count("atr").over(before) == 50, F.avg("atr").over(before))
    past = w.rowsBetween(1 - trend, 0)
    mean = F.when(F.count("close").over(past) == trend, F.avg("close").over(past))
    rows = market.withColumns({"__usual": usual, "__mean": mean}).join(adx, "session", "left")
    high = F.coalesce((F.col("__usual") > 0) & (F.col("atr") / F.col("__usual") >= expansion), F.lit(False))
    bull = F.coalesce(F.col("close") > F.col("__mean"), F.lit(False))
    label = F.when(F.col("adx_median").isNull(), "UNKNOWN").when(high, "HIGH_VOL").when(F.col("adx_median") < quiet, "RANGE").when(bull, "BULL").otherwise("BEAR")
    least = F.lit(None).cast("double")
    for name, value in ADAPTIVE_ADX.items():
        least = F.when(F.col("adaptive_regime") == name, value).otherwise(least)
    return rows.select("session", label.alias("adaptive_regime")).withColumn("adaptive_adx_min", least)


def calm_volatility(index: DataFrame, prior: int = 126) -> DataFrame:
    """(session, calm) of a volatility index (session, close): below the median of the sessions before; null unless all are there."""
    w = Window.orderBy("session").rowsBetween(-prior, -1)  # one small row a session
    return index.select("session", F.when((F.count("close").over(w) == prior) & F.col("close").isNotNull(), F.col("close") < framed_median("close", w)).alias("calm"))


def _sum(name: str, first: int, last: int) -> Column:
    return F.sum(name).over(by_ticker().rowsBetween(first, last))


def flow_context(spine: DataFrame, flow_sessions: int = FLOW_SESSIONS) -> DataFrame:
    """spine with accumulation (null if unknown), fii_net, dii_net, volume_expansion and flow_score.

    spine has one row for each ticker and session, and null where a feed has none: volume, delivery_qty, total_qty,
    turnover, fii_net_inr, dii_net_inr.  Accumulation: delivered share, quantity and turnover all above
    the 20 sessions before the last five.
    """
    c, span = F.col, RECENT + PRIOR
    whole = lambda name, n: F.count(name).over(by_ticker().rowsBetween(1 - n, 0)) == n
    old, new = (1 - span, -RECENT), (1 - RECENT, 0)
    ratio = lambda name: (_sum(name, *new) / RECENT) / F.nullif(_sum(name, *old) / PRIOR, F.lit(0.0))
    share = lambda at: _sum("delivery_qty", *at) / F.nullif(_sum("total_qty", *at), F.lit(0.0))
    known = whole("delivery_qty", span) & (_sum("delivery_qty", *old) > 0) & (_sum("turnover", *old) > 0)
    rising = (share(new) > share(old)) & (ratio("delivery_qty") > 1) & (ratio("turnover") > 1)
    net = lambda name: F.when(whole("fii_net_inr", flow_sessions) & whole("dii_net_inr", flow_sessions), _sum(name, 1 - flow_sessions, 0))
    growth = F.when(whole("volume", span) & (_sum("volume", *old) > 0), ratio("volume"))
    out = spine.withColumns({"accumulation": F.when(known, rising), "fii_net": net("fii_net_inr"), "dii_net": net("dii_net_inr"), "volume_expansion": growth})
    flag = lambda x: x.cast("int")
    score = (flag(c("fii_net") > 0) + flag(c("dii_net") > 0) + flag(c("accumulation")) + clip(c("volume_expansion") - 1, 0.0, 1.0)) / 4
    return out.withColumn("flow_score", score)


def session_counts(sessions: DataFrame) -> DataFrame:
    """(day, upto): for each calendar day of the sessions' range, how many sessions there are up to and including it."""
    days = sessions.agg(F.min(F.to_date("session")).alias("a"), F.max(F.to_date("session")).alias("b")).where("a is not null")
    spine = days.select(F.explode(F.sequence("a", "b")).alias("day"))
    marked = spine.join(sessions.select(F.to_date("session").alias("day"), F.lit(1).alias("n")).distinct(), "day", "left")
    return marked.select("day", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("day")).alias("upto"))  # one small row a day


def earnings_context(points: DataFrame, earnings: DataFrame, sessions: DataFrame, most_sessions: int = EARNINGS_SESSIONS, close_hour: float = 15.5) -> DataFrame:
    """(point_id, earnings_status, earnings_surprise, earnings_age, earnings_period) of every point with a known report.

    The report of the latest period known at the point; its age counts sessions whose close isn't before the
    announcement.  STALE after `most_sessions`; a zero expectation can't be scored.
    """
    c = F.col
    last = merged(points, earnings, "period_end").select("point_id", "period_end", "announced_at", "actual_eps", "expected_eps", "expectation_kind", "session")
    counts = session_counts(sessions)
    closes = F.unix_timestamp(F.to_timestamp(F.to_date("announced_at"))) + int(close_hour * 3600)
    before = F.date_sub(F.to_date("announced_at"), F.when(F.unix_timestamp("announced_at") <= closes, 1).otherwise(0))
    a = counts.select(c("day").alias("__from"), c("upto").alias("__before"))
    b = counts.select(c("day").alias("__to"), c("upto").alias("__upto"))
    dated = last.withColumns({"__from": before, "__to": F.to_date("session")}).join(a, "__from", "left").join(b, "__to")
    age = F.greatest(c("__upto") - F.coalesce(c("__before"), F.lit(0)), F.lit(0))
    dated = dated.withColumn("earnings_age", age)
    status = F.when(c("earnings_age") > most_sessions, "STALE").when(F.abs("expected_eps") < 1e-9, "ZERO_EXPECTATION_UNSCORABLE").otherwise(c("expectation_kind"))
    surprise = F.when((c("earnings_age") <= most_sessions) & (F.abs("expected_eps") >= 1e-9), (c("actual_eps") - c("expected_eps")) / F.abs("expected_eps"))
    return dated.select("point_id", status.alias("earnings_status"), surprise.alias("earnings_surprise"), "earnings_age", c("period_end").alias("earnings_period"))


def growth_context(points: DataFrame, fundamentals: DataFrame, earnings: DataFrame, most_days: int = GROWTH_DAYS) -> DataFrame:
    """(point_id, growth_status, eps_growth, revenue_growth, guidance_raised, earnings_score) of points with known fundamentals.

    earnings is the result of earnings_context.  OBSERVED up to `most_days` after the period, else STALE;
    PERIOD_MISMATCH where the report scored is of another period.  Only an observed period with a
    consensus surprise has a score.
    """
    c = F.col
    last = merged(points, fundamentals, "period_end").select("point_id", "period_end", "eps_growth", "revenue_growth", "guidance_raised", "session")
    both = last.join(earnings, "point_id", "left")
    other = c("earnings_surprise").isNotNull() & (c("earnings_period") != c("period_end"))
    status = F.when(other, "PERIOD_MISMATCH").when(F.datediff("session", "period_end") <= most_days, "OBSERVED").otherwise("STALE")
    both = both.withColumn("growth_status", status)
    score = (
        clip(c("eps_growth") / max(EPS_GROWTH * 2, 0.01), 0.0, 1.0) + clip(c("revenue_growth") / max(REVENUE_GROWTH * 2, 0.01), 0.0, 1.0)
        + c("guidance_raised").cast("int") + clip(c("earnings_surprise") / 0.2, 0.0, 1.0)
    ) / 4
    scored = F.when((c("growth_status") == "OBSERVED") & (c("earnings_status") == "CONSENSUS"), score)
    return both.select("point_id", "growth_status", "eps_growth", "revenue_growth", "guidance_raised", scored.alias("earnings_score"))


def sector_reasons(model: str = "SECTOR", fraction: float = 0.25, market_gate: bool = True, breadth_gate: bool = True, least_breadth: float = 0.4, coverage: float = BREADTH_COVERAGE) -> Column:
    """All reasons against a row under the sector, earnings (PEAD) or COMBINED model; empty if it qualifies.

    Row: sector, surveillance_state, sector_fraction, earnings_status, earnings_surprise, market_above,
    breadth, breadth_coverage, liquid, triggered.
    """
    c = F.col
    fails = lambda x: ~F.coalesce(x, F.lit(False))
    rules: list[tuple[Column, Column | str]] = [
        (c("sector").isNull(), "sector_mapping_unavailable"),
        (c("surveillance_state").isNull(), "surveillance_unavailable"),
        (c("surveillance_state") != "CLEAR", F.concat(F.lit("surveillance_"), F.lower("surveillance_state"))),
    ]
    if model in ("SECTOR", "COMBINED"):
        rules += [(c("sector_fraction").isNull(), "sector_history_unavailable"), (c("sector_fraction") > fraction, "sector_outside_top_quartile")]
    if model in ("PEAD", "COMBINED"):
        rules += [(fails(c("earnings_status") == "CONSENSUS"), "consensus_surprise_unavailable"), ((c("earnings_status") == "CONSENSUS") & (c("earnings_surprise") <= 0), "nonpositive_earnings_surprise")]
    if market_gate:
        rules.append((fails(c("market_above")), "market_gate_unknown_or_weak"))
    if breadth_gate:
        rules.append((fails((c("breadth_coverage") >= coverage) & (c("breadth") > least_breadth)), "breadth_gate_unknown_or_weak"))
    rules += [(fails(c("liquid")), "liquidity_insufficient"), (fails(c("triggered")), "no_timing_trigger")]
    return reasons(*rules)


def alpha_score(*names: str) -> Column:
    """100 x the weighted mean of the named factors (columns factor_<name>); null if any is null."""
    total = sum(WEIGHTS[n] for n in names)
    return sum(F.col(f"factor_{n}") * WEIGHTS[n] for n in names) * 100 / total


def alpha_decisions(rows: DataFrame, phase: int = 3, least_rank: float = 80.0, top_sectors: int = 3, sectors: int = 5, least_score: float = 85.0, meta_least: float = 0.55) -> DataFrame:
    """rows with alpha_score, reasons (all that failed, on top of `base_reasons`) and status QUALIFIED or REJECTED.

    rows: base_reasons, rs_percentile, sector_fraction, breadth_risk_scale, high, low, close; from phase 2 on
    the earnings, growth and flow contexts and sma_200; from 3 adaptive_regime, adaptive_adx_min, adx, trigger;
    from 4 meta_probability, which is asked for only where nothing else failed.
    """
    c = F.col
    fails = lambda x: ~F.coalesce(x, F.lit(False))
    spread = c("high") - c("low")
    factors = {
        "factor_relative_strength": c("rs_percentile") / 100,
        "factor_sector": 1 - c("sector_fraction") + 1.0 / sectors,
        "factor_structure": F.when(spread > 0, clip((c("close") - c("low")) / spread, 0.0, 1.0)).otherwise(0.0),
    }
    names = ["relative_strength", "sector", "structure"]
    rules: list[tuple[Column, Column | str]] = [
        (fails(c("rs_percentile") > least_rank), "rs_rank_unknown_or_below_threshold"),
        (fails(c("sector_fraction") * sectors <= top_sectors + 1e-9), "sector_outside_top_n"),
        (fails(c("breadth_risk_scale") > 0), "breadth_unknown_or_defensive"),
    ]
    if phase >= 2:
        factors |= {"factor_earnings": c("earnings_score"), "factor_flow": c("flow_score")}
        names += ["earnings", "flow"]
        grows = (c("growth_status") == "OBSERVED") & (c("eps_growth") > EPS_GROWTH) & (c("revenue_growth") > REVENUE_GROWTH) & c("guidance_raised")
        rules += [
            (fails((c("earnings_status") == "CONSENSUS") & (c("earnings_surprise") > 0)), "pead_consensus_surprise_unknown_or_nonpositive"),
            (fails(grows), "earnings_growth_unknown_or_weak"),
            (fails(c("close") > c("sma_200")), "price_below_sma200_or_unknown"),
            (c("flow_score").isNull(), "institutional_flow_unavailable"),
        ]
    if phase >= 3:
        rules += [
            (fails(c("adx") >= c("adaptive_adx_min")), "adaptive_adx_unknown_or_weak"),
            ((c("adaptive_regime") == "RANGE") & c("trigger").contains("BREAKOUT"), "breakout_disabled_in_range"),
        ]
    out = rows.withColumns(factors).withColumn("alpha_score", alpha_score(*names))
    rules.append((fails(c("alpha_score") > least_score), "alpha_score_unknown_or_below_threshold"))
    out = out.withColumn("reasons", F.concat(c("base_reasons"), reasons(*rules)))
    if phase >= 4:
        late = (F.size("reasons") == 0) & fails(c("meta_probability") >= meta_least)
        out = out.withColumn("reasons", F.when(late, F.array(F.lit("meta_probability_unknown_or_weak"))).otherwise(c("reasons")))
    return out.withColumn("status", F.when(F.size("reasons") == 0, "QUALIFIED").otherwise("REJECTED"))


def rejection_counts(decisions: DataFrame) -> DataFrame:
    """(reason, n) over all decisions; a decision counts under each of its reasons."""
    return decisions.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
