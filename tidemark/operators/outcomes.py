"""Trade outcomes, excursions, statistics, equity curves and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_ordinals(bars: DataFrame) -> DataFrame:
    """bars with `ord`, a ticker's sessions counted from 1."""
    return bars.withColumn("ord", F.row_number().over(Window.partitionBy("ticker").orderBy("session")))


def forward_bars(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Each trade's bars after its signal, at most time_stop of them, as `day` 1, 2, ...

    Trades carry trade_id, ticker, signal_ord and time_stop.  A trade unfolds into the ordinals that it
    needs, so that the join is on equal ticker and ordinal and not on a range.
    """
    days = trades.where("time_stop > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("time_stop"))).alias("day")).withColumn("ord", F.col("signal_ord") + F.col("day"))
    return days.join(with_ordinals(bars).select("ticker", "ord", "session", "open", "high", "low", "close"), ["ticker", "ord"])


def outcomes(trades: DataFrame, bars: DataFrame, friction: Column | None = None) -> DataFrame:
    """Gross and net R, whether the target was hit, bars held and exit session of each trade.

    Stop before target in one bar; gaps fill at the open; else the last day's close.  trades: trade_id,
    ticker, signal_ord, direction, entry, stop, target, time_stop.  Without risk or bars: zero, not hit.
    """
    c = F.col
    side = F.when(c("direction") == "LONG", 1.0).otherwise(-1.0)
    risk = F.abs(c("entry") - c("stop"))
    worst, best = F.when(side > 0, c("low")).otherwise(c("high")), F.when(side > 0, c("high")).otherwise(c("low"))
    past = lambda price, level, sign: (price - level) * side * sign >= 0
    r_at = lambda price: (price - c("entry")) * side / risk
    gross = (
        F.when(past(c("open"), c("stop"), -1), r_at(c("open")))
        .when(past(worst, c("stop"), -1), F.lit(-1.0))
        .when(past(c("open"), c("target"), 1), r_at(c("open")))
        .when(past(best, c("target"), 1), F.abs(c("target") - c("entry")) / risk)
    )
    stopped = past(c("open"), c("stop"), -1) | past(worst, c("stop"), -1)
    hit = ~stopped & (past(c("open"), c("target"), 1) | past(best, c("target"), 1))
    ended = forward_bars(trades.where(risk > 0), bars).select("trade_id", "day", "session", gross.alias("touch"), hit.alias("hit"), r_at(c("close")).alias("at_close"))
    first = F.min(F.when(c("touch").isNotNull(), F.struct("day", "session", c("touch").alias("r"), "hit")))
    last = F.max(F.struct("day", "session", c("at_close").alias("r"), F.lit(False).alias("hit")))
    exits = ended.groupBy("trade_id").agg(F.coalesce(first, last).alias("x"))
    exact = lambda x: x.cast("decimal(20,9)")
    net = c("gross_r") if friction is None else F.round(exact(c("gross_r")) - exact(friction), 4).cast("double")
    out = trades.join(exits, "trade_id", "left").withColumn("gross_r", F.round(F.coalesce("x.r", F.lit(0.0)), 4))
    return out.withColumns(
        {
            "net_r": F.when(c("x").isNotNull(), net).otherwise(0.0),
            "hit": F.coalesce("x.hit", F.lit(False)),
            "bars_held": F.coalesce("x.day", F.lit(0)),
            "exit_session": c("x.session"),
        }
    ).drop("x")


#: Transaction cost presets, as shares of the price a side, and a flat commission.
COSTS = {
    "intraday": dict(slippage=0.0008, brokerage=0.0003, exchange=0.0000345, regulator=0.000001, buy_tax=0.0, sell_tax=0.00025, stamp=0.00015, gst=0.18, flat=20.0),
    "delivery": dict(slippage=0.0008, brokerage=0.0, exchange=0.0000345, regulator=0.000001, buy_tax=0.001, sell_tax=0.001, stamp=0.00015, gst=0.18, flat=0.0),
    "none": dict(slippage=0.0, brokerage=0.0, exchange=0.0, regulator=0.0, buy_tax=0.0, sell_tax=0.0, stamp=0.0, gst=0.0, flat=0.0),
}


def friction_r(entry: Column, risk: Column, shares: Column | None = None, preset: str = "delivery", slippage: Column | float = 1.0) -> Column:
    """Round-trip costs in units of the initial risk; 0 without risk.  `slippage` multiplies that part of the preset."""
    p = COSTS[preset]
    taxed = (p["brokerage"] + p["exchange"] + p["regulator"]) * (1 + p["gst"])
    share = 2 * (p["slippage"] * slippage + taxed) + p["buy_tax"] + p["stamp"] + p["sell_tax"]
    flat = F.when(shares > 0, F.lit(p["flat"]) / (risk * shares)).otherwise(0.0) if shares is not None else F.lit(0.0)
    return F.when(risk > 0, F.round(entry * share / risk + flat, 5)).otherwise(0.0)


def excursions(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Largest favourable and adverse move of long trades while held, in R: sure and possible bounds.

    trades: trade_id, ticker, entry, stop, exit_price, exit_reason, entry_session, exit_session.  The exit
    day's extremes are only possible, unless the trade ended at the close; at the open it saw none.
    """
    c = F.col
    risk = c("entry") - c("stop")
    # a trade unfolds into the months that it touches, so that a bar meets the trades of its month only
    month = lambda x: F.trunc(F.col(x).cast("date"), "month")
    held = bars.select("ticker", month("session").alias("__month"), "session", "open", "high", "low")
    months = F.explode(F.sequence(month("entry_session"), month("exit_session"), F.expr("interval 1 month")))
    spread = trades.where("entry_session <= exit_session").withColumn("__month", months)
    j = spread.join(held, ["ticker", "__month"]).where(c("session").between(c("entry_session"), c("exit_session")))
    inside = c("session") < c("exit_session")
    known = j.groupBy("trade_id").agg(
        F.max(F.when(inside, c("high"))).alias("hi"), F.min(F.when(inside, c("low"))).alias("lo"),
        F.max(F.when(~inside, c("high"))).alias("exit_hi"), F.min(F.when(~inside, c("low"))).alias("exit_lo"), F.max(F.when(~inside, c("open"))).alias("exit_open"),
    )
    x = trades.join(known, "trade_id").where(risk > 0)
    at_open = c("exit_reason").isin("STOP", "TARGET", "TRAIL_STOP") & (F.abs(c("exit_price") - c("exit_open")) < 1e-8)
    whole = c("exit_reason").isin("TIME", "DATA_END")
    up, down = lambda p: (p - c("entry")) / risk, lambda p: (c("entry") - p) / risk
    sure_up = F.greatest(F.lit(0.0), up(c("exit_price")), up(c("hi")))
    sure_down = F.greatest(F.lit(0.0), down(c("exit_price")), down(c("lo")))
    all_up = F.when(at_open, sure_up).otherwise(F.greatest(sure_up, up(c("exit_hi"))))
    all_down = F.when(at_open, sure_down).otherwise(F.greatest(sure_down, down(c("exit_lo"))))
    return x.select(
        "trade_id", F.when(whole, all_up).otherwise(sure_up).alias("mfe_lower"), all_up.alias("mfe_upper"), F.when(whole, all_down).otherwise(sure_down).alias("mae_lower"),
        all_down.alias("mae_upper"), (~(at_open | whole)).alias("exit_day_unknown"),
    )


def excursion_summary(moves: DataFrame) -> DataFrame:
    """(measure, denominator, definite, possible): losers that had reached 1 R, winners that had suffered half of one, and all that reached 2 R.

    moves: excursions' columns and net_r; `possible` counts the extremes of exit days whose order isn't known.
    """
    r, c = F.col("net_r"), F.col
    measures = {"losers_reached_1r": (r < 0, "mfe", 1.0), "winners_suffered_half_r": (r > 0, "mae", 0.5), "all_reached_2r": (F.lit(True), "mfe", 2.0)}
    row = lambda name, own, side, level: F.struct(
        F.lit(name).alias("measure"), own.alias("own"), (own & (c(f"{side}_lower") >= level)).alias("definite"), (own & (c(f"{side}_upper") >= level)).alias("possible")
    )
    each = moves.select(F.inline(F.array(*(row(k, *v) for k, v in measures.items()))))
    return each.groupBy("measure").agg(F.count_if("own").alias("denominator"), F.count_if("definite").alias("definite"), F.count_if("possible").alias("possible"))


def segment_statistics(curve: DataFrame, split: Column, *by: str) -> DataFrame:
    """(segment, sessions, initial_nav, final_nav, total_return, cagr, max_drawdown, sharpe) before and from `split` on.

    curve: session, nav, in units of the starting capital.  The capital at a segment's start counts as its first peak.
    """
    w = Window.partitionBy(*by).orderBy("session")
    before = F.coalesce(F.lag("nav").over(w), F.lit(1.0))
    rows = curve.withColumn("segment", F.when(F.col("session") < split, "DEV").otherwise("HOLD")).withColumns({"__before": before, "__ret": F.col("nav") / before - 1})
    own = Window.partitionBy(*by, "segment").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__fall", F.col("nav") / F.greatest(F.max("nav").over(own), F.first("__before").over(own)) - 1)
    n, start, end = F.count("*"), F.min_by("__before", "session"), F.max_by("nav", "session")
    return rows.groupBy(*by, "segment").agg(
        n.alias("sessions"), start.alias("initial_nav"), end.alias("final_nav"), (end / start - 1).alias("total_return"), (F.pow(end / start, 252.0 / n) - 1).alias("cagr"),
        F.least(F.min("__fall"), F.lit(0.0)).alias("max_drawdown"), (F.avg("__ret") * F.sqrt(F.lit(252.0)) / F.nullif(F.stddev_samp("__ret"), F.lit(0.0))).alias("sharpe"),
    )


def trade_measures() -> list[Column]:
    """Aggregates of net_r and bars_held: count, mean, win rate, profit factor, percentiles, bias-corrected skewness and excess kurtosis, extremes."""
    r, n = F.col("net_r"), F.count("net_r").cast("double")
    skew, kurt = F.skewness(r), F.kurtosis(r)
    varies = F.stddev_pop(r) > 0
    losses = F.sum(F.when(r < 0, -r).otherwise(0.0))
    quantile = lambda p: F.percentile(r, F.lit(p)).alias(f"p{round(p * 100)}")
    return [
        F.count("net_r").alias("trades"), F.avg(r).alias("mean_r"), F.avg((r > 0).cast("int")).alias("win_rate"), F.avg("bars_held").alias("average_hold"),
        F.when(losses > 0, F.sum(F.when(r > 0, r).otherwise(0.0)) / losses).alias("profit_factor"), *map(quantile, (0.05, 0.25, 0.5, 0.75, 0.95)),
        F.when((n >= 3) & varies, skew * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when((n >= 4) & varies, ((n + 1) * kurt + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("excess_kurtosis"), F.max(r).alias("largest"), F.min(r).alias("smallest"),
    ]


def trade_statistics(trades: DataFrame, *by: str) -> DataFrame:
    """trade_measures by group."""
    return trades.groupBy(*by).agg(*trade_measures())


def attribution(trades: DataFrame, fields: list[str]) -> DataFrame:
    """trade counts and mean net_r by each of several fields (field, label), in one pass over grouping sets."""
    sets = [[F.col(f)] for f in fields]
    grouped = trades.groupingSets(sets, *map(F.col, fields)).agg(F.grouping_id().alias("__g"), F.count("net_r").alias("trades"), F.avg("net_r").alias("mean_r"))
    place = {sum(1 << (len(fields) - 1 - j) for j in range(len(fields)) if j != k): f for k, f in enumerate(fields)}
    pick = lambda how: F.coalesce(*(F.when(F.col("__g") == g, how(f)) for g, f in place.items()))
    return grouped.select(pick(F.lit).alias("field"), pick(lambda f: F.col(f).cast("string")).alias("label"), "trades", "mean_r")


def drawdowns(curve: DataFrame, *by: str, value: str = "nav", start: float = 1.0) -> DataFrame:
    """curve with the running peak (the start included) and value / peak - 1, in session order."""
    w = Window.partitionBy(*by).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.max(value).over(w), F.lit(start))
    return curve.withColumns({"peak": peak, "drawdown": F.col(value) / peak - 1})


def portfolio_statistics(curve: DataFrame, *by: str) -> DataFrame:
    """Compounded return, annual growth, beta, alpha, Sharpe and information ratio of daily and benchmark returns.

    A curve with session has max_drawdown, the start counting as the first peak.  One with exposure_open, exposure_close and
    matched_return (a benchmark return for the exposure held) has exposure means, the share of invested sessions, growth and
    return by exposure, and the matched return, its difference and information ratio.  Ratios by 0 are null; a loss of all is -1.
    """
    d, b = F.col("daily_return"), F.col("benchmark_return")
    n = F.count(d)
    compound = lambda x: F.when(F.min(x) <= -1, -1.0).otherwise(F.exp(F.sum(F.log1p(F.when(x > -1, x)))) - 1)
    growth = lambda total: F.when(total > -1, F.pow(1 + total, 252.0 / n) - 1).otherwise(-1.0)
    ratio = lambda x: F.avg(x) * F.sqrt(F.lit(252.0)) / F.nullif(F.stddev_samp(x), F.lit(0.0))
    total, market = compound(d), compound(b)
    beta = F.covar_pop(d, b) / F.nullif(F.var_pop(b), F.lit(0.0))
    measures = [
        n.alias("sessions"), total.alias("total_return"), growth(total).alias("cagr"), market.alias("benchmark_return"), growth(market).alias("benchmark_cagr"), beta.alias("beta"),
        ((F.avg(d) - beta * F.avg(b)) * 252).alias("alpha"), ratio(d).alias("sharpe"), ratio(d - b).alias("information_ratio"),
    ]
    if "session" in curve.columns:
        w = Window.partitionBy(*by).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
        curve = curve.withColumn("__nav", F.product(1 + d).over(w)).withColumn("__fall", F.col("__nav") / F.greatest(F.lit(1.0), F.max("__nav").over(w)) - 1)
        measures.append(F.min("__fall").alias("max_drawdown"))
    if {"exposure_open", "exposure_close", "matched_return"} <= set(curve.columns):
        held, matched = F.avg("exposure_open"), compound(F.col("matched_return"))
        measures += [
            held.alias("average_exposure"), F.avg("exposure_close").alias("average_close_exposure"), F.avg((F.col("exposure_open") > 0).cast("int")).alias("invested_fraction"),
            (growth(total) / F.nullif(held, F.lit(0.0))).alias("exposure_adjusted_cagr"), (total / F.nullif(held, F.lit(0.0))).alias("return_per_exposure"),
            matched.alias("matched_return"), (total - matched).alias("matched_active_return"), ratio(d - F.col("matched_return")).alias("matched_information_ratio"),
        ]
    return curve.groupBy(*by).agg(*measures)


def cluster_bootstrap(trades: DataFrame, draws: int = 2000, seed: int = 20261002) -> DataFrame:
    """2.5 and 97.5 percent quantiles of mean net_r, resampling entry months whole; null below two months.

    Months are aggregated first, so the resampling joins small rows: draws x months of them.  The month that a draw takes at a
    place is the first 32 bits of the MD5 of "seed:draw:place", modulo the number of months, so that any engine can repeat it.
    """
    months = trades.groupBy(F.date_trunc("month", "entry_session").alias("month")).agg(F.sum("net_r").alias("total"), F.count("net_r").alias("n"))
    numbered = months.withColumn("k", F.row_number().over(Window.orderBy("month")) - 1)
    size = numbered.agg(F.count("*").alias("m"))
    spark = trades.sparkSession
    slots = spark.range(draws).withColumnRenamed("id", "draw").join(size, F.lit(True)).where("m > 0").select("draw", "m", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)).alias("slot"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    picks = slots.withColumn("k", (hashed % F.col("m")).cast("int"))
    means = picks.join(numbered, "k").groupBy("draw").agg((F.sum("total") / F.sum("n")).alias("mean"), F.first("m").alias("m"))
    q = lambda p: F.when(F.max("m") >= 2, F.percentile("mean", F.lit(p)))
    return means.agg(q(0.025).alias("low"), q(0.975).alias("high"))


def evidence_report(trades: DataFrame, curve: DataFrame, fields: list[str], labels: dict[str, list[str]] | None = None, draws: int = 2000) -> DataFrame:
    """(section, field, label, measure, value): all that is said of a replay, as one long table.

    Sections: trades (overall, and by each field's label), portfolio (of curve) and interval (the monthly bootstrap's low and high).
    All fields are one pass of grouping sets over the trades.  Declared labels without trades have a count of 0 and nothing else: what wasn't
    seen is no evidence of nothing.  Unknown measures are left out.
    """
    measures = trade_measures()
    rows = trades.withColumns({f: F.coalesce(F.col(f).cast("string"), F.lit("UNKNOWN")) for f in fields})
    grouped = rows.groupingSets([[], *([F.col(f)] for f in fields)], *map(F.col, fields)).agg(F.grouping_id().alias("__g"), *measures)
    full = (1 << len(fields)) - 1
    own = {full - (1 << (len(fields) - 1 - k)): f for k, f in enumerate(fields)}
    pick = lambda how: F.coalesce(*(F.when(F.col("__g") == g, how(f)) for g, f in own.items()))
    names = [c for c in grouped.columns if c not in (*fields, "__g")]
    found = grouped.withColumns({"field": pick(F.lit), "label": pick(F.col)}) if fields else grouped.withColumns({"field": F.lit(None).cast("string"), "label": F.lit(None).cast("string")})
    long = _long(found, "trades", names)
    declared = [(f, x) for f, known in (labels or {}).items() for x in known]
    if declared:
        asked = trades.sparkSession.createDataFrame(declared, "field string, label string")
        unseen = asked.join(long.select("field", "label").distinct(), ["field", "label"], "left_anti")
        long = long.unionByName(unseen.select(F.lit("trades").alias("section"), "field", "label", F.lit("trades").alias("measure"), F.lit(0.0).alias("value")))
    blank = {"field": F.lit(None).cast("string"), "label": F.lit(None).cast("string")}
    book = portfolio_statistics(curve)
    interval = cluster_bootstrap(trades, draws)
    parts = [long, _long(book.withColumns(blank), "portfolio", book.columns), _long(interval.withColumns(blank), "interval", interval.columns)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("value is not null")


def _long(wide: DataFrame, section: str, names: list[str]) -> DataFrame:
    """One row a measure."""
    each = F.inline(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names)))
    return wide.select(F.lit(section).alias("section"), "field", "label", each)


def bucket(value: Column, width: int, top: int = 100) -> Column:
    """The label (such as 20-040) of the bucket of `width` that a value from 0 to top falls in; the last one holds top itself."""
    low = F.least(F.floor(F.greatest(value, F.lit(0.0)) / width) * width, F.lit(top - width)).cast("int")
    return F.when(value.isNotNull(), F.format_string("%02d-%03d", low, low + width))


def cohort_buckets(trades: DataFrame, labels: dict[str, list[str]], time: str = "exit_session") -> DataFrame:
    """Statistics of net_r and the worst fall of its running sum by (field, label); declared labels appear without trades too.

    trades: trade_id, net_r, `time` and the fields; a null field is UNKNOWN.  The sum is folded inside days first and
    days are then put together, so that no task orders a whole cohort.
    """
    fields = list(labels)
    named = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("UNKNOWN")).alias("label")) for f in fields)))
    rows = trades.where(F.col("net_r").isNotNull()).select("trade_id", "net_r", F.col(time).alias("__at"), F.to_date(time).alias("__day"), named.alias("__n")).select("__n.*", "trade_id", "net_r", "__at", "__day")
    inside = Window.partitionBy("field", "label", "__day").orderBy("__at", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__sum", F.sum("net_r").over(inside)).withColumn("__fall", F.col("__sum") - F.max("__sum").over(inside))
    days = rows.groupBy("field", "label", "__day").agg(
        F.count("*").alias("trades"), F.sum("net_r").alias("total"), F.sum((F.col("net_r") > 0).cast("long")).alias("wins"), F.max("__sum").alias("hi"), F.min("__sum").alias("lo"), F.min("__fall").alias("fall")
    )
    before = Window.partitionBy("field", "label").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    days = days.withColumn("peak", F.greatest(F.lit(0.0), F.max(F.col("base") + F.col("hi")).over(before)))
    found = days.groupBy("field", "label").agg(
        F.sum("trades").alias("trades"), (F.sum("total") / F.sum("trades")).alias("mean_r"), (F.sum("wins") / F.sum("trades")).alias("win_rate"),
        F.min(F.least("fall", F.col("base") + F.col("lo") - F.col("peak"))).alias("worst_fall"),
    )
    declared = trades.sparkSession.createDataFrame([(f, x) for f in fields for x in labels[f]], "field string, label string")
    return found.join(declared, ["field", "label"], "full_outer").withColumn("trades", F.coalesce("trades", F.lit(0)))


def hedge(curve: DataFrame, benchmark: DataFrame, *by: str, window: int = 60, carry: float = 0.0, trade_cost: float = 0.0005, roll_cost: float = 0.0005) -> DataFrame:
    """curve (session, nav) with `beta` and `hedged`, the curve less a short position of the market (session, bench).

    beta is that of the last `window` sessions, known a session before, within 0 and 1.5, and 0 without a whole window;
    its changes cost trade_cost and its level roll_cost a month.  The market's sessions are one small row each.
    """
    c, w = F.col, Window.partitionBy(*by).orderBy("session")
    moves = benchmark.select("session", (c("bench") / F.lag("bench").over(Window.orderBy("session")) - 1).alias("__m"))
    rows = curve.withColumn("__r", c("nav") / F.coalesce(F.lag("nav").over(w), F.lit(1.0)) - 1).join(moves, "session", "left").withColumn("__m", F.coalesce("__m", F.lit(0.0)))
    frame = w.rowsBetween(1 - window, 0)
    raw = F.when(F.count(F.lit(1)).over(frame) == window, F.covar_samp("__r", "__m").over(frame) / F.nullif(F.var_samp("__m").over(frame), F.lit(0.0)))
    rows = rows.withColumn("__raw", raw).withColumn("beta", F.coalesce(F.least(F.lit(1.5), F.greatest(F.lit(0.0), F.lag("__raw").over(w))), F.lit(0.0)))
    rows = rows.withColumn("beta", F.when(F.lag("__raw").over(w).isNull(), 0.0).otherwise(c("beta")))
    fees = F.abs(c("beta") - F.coalesce(F.lag("beta").over(w), F.lit(0.0))) * trade_cost + c("beta") * roll_cost / 21
    rows = rows.withColumn("__f", 1 + c("__r") - c("beta") * c("__m") - fees + c("beta") * carry / 252)
    return rows.withColumn("hedged", F.product("__f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__r", "__m", "__raw", "__f")
