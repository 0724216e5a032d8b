"""Leadership of liquid tickers at every session: strength percentiles, peers, breadth and volatility state; and trades that carry it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.curves import percentile_bucket
from tidemark.operators import bitemporal
from tidemark.operators.indicators import add_indicators, by_ticker, sliding, wilder

#: Lookbacks of relative strength, and bars of the volatility state.
LOOKBACKS, LEAST_BARS, ATR_BARS, YEAR, LEAST_RANKED, LEAST_PEERS = (63, 252), 50, 20, 252, 60, 2


def smoothed_range(bars: DataFrame, period: int = ATR_BARS, name: str = "atr20") -> DataFrame:
    """bars with the recursive mean of the true range, null before `period` bars."""
    before = F.lag("close").over(by_ticker())
    rows = bars.withColumn(name, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))

    def smooth(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("session", kind="stable")
        return group.assign(**{name: wilder(group[name], period)})

    return rows.groupBy("ticker").applyInPandas(smooth, rows.schema)


def volatility_state(bars: DataFrame) -> DataFrame:
    """bars (with atr20) with its percentile among the 252 bars before, its ratio to the mean of the 20 before, and whether bands widen."""
    w, c = by_ticker(), F.col
    past = F.collect_list("atr20").over(w.rowsBetween(-YEAR, -1))
    usual = F.avg("atr20").over(w.rowsBetween(-ATR_BARS, -1))
    width = 4 * sliding(c("close"), 1 - ATR_BARS, 0, F.stddev_pop) / sliding(c("close"), 1 - ATR_BARS, 0)
    rows = bars.withColumns({"__past": past, "__width": width})
    less = F.size(F.filter("__past", lambda x: x < c("atr20")))
    return rows.withColumns(
        {
            "atr20_percentile": F.when(F.size("__past") >= LEAST_RANKED, less / F.size("__past") * 100),
            "atr20_expansion": F.when(usual > 0, c("atr20") / usual),
            "bandwidth_expanding": c("__width") > F.lag("__width").over(w),
        }
    ).drop("__past", "__width")


def leadership(bars: DataFrame, bench: DataFrame, turnover_floor: float, share_floor: float) -> DataFrame:
    """One row a liquid ticker and session, ranked among the liquid tickers of that session only.

    bars: ticker, sector, session and prices; bench: session, bench.  Relative strength needs every session of
    its lookback.  sector_rs_63 is the median of the peers' (the ticker itself left out), with two peers at least.
    """
    w, c = by_ticker(), F.col
    order = Window.orderBy("session")  # one small row a session
    calendar = bench.select("session", "bench", F.row_number().over(order).alias("__ord"))
    calendar = calendar.withColumns({f"__bench_{n}": F.lag("bench", n).over(order) for n in LOOKBACKS})
    rows = volatility_state(smoothed_range(add_indicators(bars, complete=False))).join(calendar, "session")
    near = Window.partitionBy("ticker").orderBy("__ord")
    whole = lambda n: F.count(F.when(c("close") > 0, 1)).over(near.rangeBetween(-n, 0)) == n + 1
    strength = {f"rs_{n}": F.when(whole(n), c("close") / F.lag("close", n).over(near) / (c("bench") / c(f"__bench_{n}")) - 1) for n in LOOKBACKS}
    rows = rows.withColumns(
        {
            **strength, "turnover": sliding(c("close") * c("volume"), 1 - ATR_BARS, 0, full=False), "__shares": sliding(c("volume"), 1 - ATR_BARS, 0, full=False),
            "__bars": F.row_number().over(w), "above_ema50": c("close") > c("ema_50"), "above_ema200": c("close") > c("ema_200"), "distance_ema200": F.when(c("ema_200") > 0, c("close") / c("ema_200") - 1),
        }
    )
    liquid = rows.where((c("__bars") >= LEAST_BARS) & (c("turnover") >= turnover_floor) & (c("__shares") >= share_floor))
    session = Window.partitionBy("session")
    ranks = {}
    for n in LOOKBACKS:
        x = c(f"rs_{n}")
        own = Window.partitionBy("session", x.isNotNull())
        place = F.rank().over(own.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy("session", x)) - 1) / 2.0
        ranks[f"rs_{n}_percentile"] = F.when(x.isNotNull(), place / F.count(x).over(session) * 100)
    found = liquid.withColumns(ranks).withColumns(
        {
            "breadth_ema50": F.avg(c("above_ema50").cast("int")).over(session), "breadth_ema200": F.avg(c("above_ema200").cast("int")).over(session),
            "rank_universe_count": F.count(F.lit(1)).over(session),
            "__peers": F.sort_array(F.collect_list(F.when(c("rs_63").isNotNull(), F.struct("rs_63", "ticker"))).over(Window.partitionBy("session", "sector"))),
        }
    )
    others = F.filter("__peers", lambda p: p["ticker"] != c("ticker"))
    found = found.withColumn("__others", F.transform(others, lambda p: p["rs_63"])).withColumn("sector_peer_count", F.size("__others"))
    half = (c("sector_peer_count") / 2).cast("int")
    middle = (F.get("__others", F.expr("cast((sector_peer_count - 1) / 2 as int)")) + F.get("__others", half)) / 2
    found = found.withColumn("sector_rs_63", F.when(c("sector_peer_count") >= LEAST_PEERS, middle))
    names = [
        "ticker", "sector", "session", "rs_63", "rs_252", "rs_63_percentile", "rs_252_percentile", "turnover", "above_ema50", "above_ema200", "distance_ema200", "atr20_percentile", "atr20_expansion",
        "bandwidth_expanding", "sector_peer_count", "sector_rs_63", "breadth_ema50", "breadth_ema200", "rank_universe_count",
    ]
    return found.select(*names)


def annotated(trades: DataFrame, snapshot: DataFrame, sessions: DataFrame) -> DataFrame:
    """trades (ticker, entry_session) with the leadership row of the session before their entry, and its buckets; unknown where there is none."""
    order = Window.orderBy("session")
    prior = sessions.select("session").distinct().select(F.col("session").alias("entry_session"), F.lag("session").over(order).alias("signal_session"))
    facts = snapshot.drop("sector").withColumnRenamed("session", "signal_session")
    rows = trades.join(prior, "entry_session", "left").join(facts, ["ticker", "signal_session"], "left")
    c = F.col
    far = c("distance_ema200")
    return rows.withColumns(
        {
            "rs63_decile": percentile_bucket(c("rs_63_percentile"), 10), "rs252_decile": percentile_bucket(c("rs_252_percentile"), 10),
            "sector_alignment": F.when(c("sector_rs_63").isNull(), "UNKNOWN").when(c("sector_rs_63") > 0, "POSITIVE_PEER_RS").otherwise("NONPOSITIVE_PEER_RS"),
            "leadership_distance": F.when(far.isNull(), "UNKNOWN").when(far < 0.1, "0-10%").when(far < 0.2, "10-20%").when(far < 0.4, "20-40%").otherwise("40%+"),
            "breadth50_bucket": percentile_bucket(c("breadth_ema50") * 100), "breadth200_bucket": percentile_bucket(c("breadth_ema200") * 100),
            "atr20_bucket": percentile_bucket(c("atr20_percentile")), "atr_expanding": c("atr20_expansion") > 1,
        }
    )


#: What is known of a coming report at an entry.
NEAR_EVENT, NO_EVENT, NO_FEED = "KNOWN_EARNINGS_WITHIN_5_SESSIONS", "NO_KNOWN_EVENT_COVERAGE_UNVERIFIED", "UNKNOWN_NO_ASOF_EVENT_FEED"


def with_events(trades: DataFrame, sessions: DataFrame, calendar: DataFrame | None = None, membership: DataFrame | None = None, close_hour: float = 15.5, within: int = 5, event: str | None = None) -> DataFrame:
    """trades (trade_id, ticker, entry_session) with earnings_status, sessions_to_event and pit_member, as known at the close before the entry.

    calendar: bitemporal.next_events' events; membership: ticker, effective_date, known_at, action (ADD or REMOVE).  pit_member is
    whether the ticker's last action in effect at the entry was ADD, false without one, and null without a history.  An
    entry on the first session, or on none, has no close before it and so nothing known.
    """
    c = F.col
    prior = sessions.select("session").distinct().select(c("session").alias("entry_session"), F.lag("session").over(Window.orderBy("session")).alias("__before"))
    asked = trades.join(prior, "entry_session").where("__before is not null")
    points = asked.select(c("trade_id").alias("point_id"), "ticker", (c("__before").cast("timestamp") + F.make_dt_interval(mins=F.lit(round(close_hour * 60)))).alias("asof"), c("entry_session").alias("session"))
    status, out = F.lit(NO_FEED), trades
    if calendar is not None:
        near = bitemporal.next_events(points, calendar, sessions, within, event).select(c("point_id").alias("trade_id"), "sessions_to_event")
        out, status = out.join(near, "trade_id", "left"), F.when(c("sessions_to_event").isNotNull(), NEAR_EVENT).otherwise(NO_EVENT)
    else:
        out = out.withColumn("sessions_to_event", F.lit(None).cast("int"))
    out = out.withColumn("earnings_status", status)
    if membership is None:
        return out.withColumn("pit_member", F.lit(None).cast("boolean"))
    acts = bitemporal.merged(points, membership, "effective_date").select(c("point_id").alias("trade_id"), (c("action") == "ADD").alias("pit_member"))
    return out.join(acts, "trade_id", "left").withColumn("pit_member", F.coalesce("pit_member", F.lit(False)))


def context_labels(breadth: Column, close: Column, ema200: Column, volatility: Column, usual: Column) -> dict[str, Column]:
    """Labels of breadth, of the benchmark's trend and of its volatility against the usual one; UNKNOWN without a measure."""
    return {
        "breadth_regime": F.when(breadth >= 0.55, "STRONG").when(breadth < 0.45, "WEAK").otherwise("NEUTRAL"),
        "benchmark_trend": F.when(ema200.isNull(), "UNKNOWN").when(close >= ema200, "ABOVE_EMA200").otherwise("BELOW_EMA200"),
        "volatility_regime": F.when(usual.isNull(), "UNKNOWN").when(volatility > usual, "HIGH").otherwise("LOW"),
    }


def usual_volatility(bars: DataFrame) -> DataFrame:
    """bars (close, atr) with `volatility`, the range by the close, and `usual`, its median over the 252 bars before."""
    rows = bars.withColumn("volatility", F.col("atr") / F.col("close"))
    rows = rows.withColumn("__past", F.sort_array(F.collect_list("volatility").over(by_ticker().rowsBetween(-YEAR, -1))))
    n = F.size("__past")
    middle = (F.get("__past", ((n - 1) / 2).cast("int")) + F.get("__past", (n / 2).cast("int"))) / 2
    return rows.withColumn("usual", F.when(n > 0, middle)).drop("__past")
