"""Coverage audits: which declared members have valid bars, and compressed gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bitemporal import latest_known, members_on


def valid_bar() -> Column:
    """Finite positive prices, high and low around the others, no negative volume."""
    c = F.col
    finite = F.lit(True)
    for name in ("open", "high", "low", "close", "volume"):
        finite = finite & c(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf"))
    ordered = (c("high") >= F.greatest("open", "close", "low")) & (c("low") <= F.least("open", "close"))
    return finite & (F.least("open", "high", "low", "close") > 0) & (c("volume") >= 0) & ordered


def member_states(bars: DataFrame, sessions: DataFrame, intervals: DataFrame, lookback: int = 200) -> DataFrame:
    """(session, ticker, state) of every declared member of every session; a missing bar breaks a lookback."""
    calendar = sessions.select("session", F.row_number().over(Window.orderBy("session")).alias("ord"))  # one small row a session
    good = bars.select("ticker", "session", valid_bar().alias("good")).join(calendar, "session")
    w = Window.partitionBy("ticker").orderBy("ord").rangeBetween(1 - lookback, 0)
    warmed = good.withColumn("warm", F.sum(F.col("good").cast("int")).over(w) == lookback)
    series = bars.select("ticker").distinct().withColumn("series", F.lit(True))
    rows = members_on(sessions, intervals).join(warmed.select("session", "ticker", "good", "warm"), ["session", "ticker"], "left").join(series, "ticker", "left")
    state = (
        F.when(F.col("series").isNull(), "UNAVAILABLE_NO_PRICE_SERIES")
        .when(F.col("good").isNull(), "UNAVAILABLE_NO_PRICE_BAR")
        .when(~F.col("good"), "UNAVAILABLE_INVALID_OHLCV")
        .when(~F.col("warm"), "UNAVAILABLE_PRICE_LOOKBACK")
        .otherwise("OBSERVED")
    )
    return rows.select("session", "ticker", state.alias("state"))


def daily_coverage(states: DataFrame) -> DataFrame:
    """One row a session: declared members, valid and warmed ones, the missing by cause, and the covered share."""
    n = lambda *names: F.count(F.when(F.col("state").isin(*names), 1))
    valid = n("OBSERVED", "UNAVAILABLE_PRICE_LOOKBACK")
    return states.groupBy("session").agg(
        F.count("*").alias("declared"), valid.alias("valid_bar"), n("OBSERVED").alias("warmed"), n("UNAVAILABLE_NO_PRICE_SERIES").alias("no_series"),
        n("UNAVAILABLE_NO_PRICE_BAR").alias("no_bar"), n("UNAVAILABLE_INVALID_OHLCV").alias("invalid_bar"), (valid / F.count("*")).alias("coverage"),
    )


def gap_intervals(gaps: DataFrame, sessions: DataFrame, *key: str) -> DataFrame:
    """Runs of adjacent audited sessions with one key: start, end and number of sessions."""
    calendar = sessions.select("session", F.row_number().over(Window.orderBy("session")).alias("ord"))
    island = F.col("ord") - F.row_number().over(Window.partitionBy(*key).orderBy("ord"))
    return (
        gaps.select("session", *key).distinct().join(calendar, "session").withColumn("__island", island).groupBy(*key, "__island")
        .agg(F.min("session").alias("start"), F.max("session").alias("end"), F.count("*").alias("audited_sessions")).drop("__island")
    )


def rolling_complete(flag: Column, n: int) -> Column:
    """Whether the last n rows of a ticker all have the flag."""
    w = Window.partitionBy("ticker").orderBy("session").rowsBetween(1 - n, 0)
    return (F.count(F.lit(1)).over(w) == n) & (F.sum(flag.cast("int")).over(w) == n)


def missing(expected: DataFrame, present: DataFrame, *key: str) -> DataFrame:
    """Rows of `expected` without a row of `present`."""
    return expected.join(present.select(*key), list(key), "left_anti")


def interval_states(points: DataFrame, feed: DataFrame, state: str | None = None, tie: str | None = None) -> DataFrame:
    """(point_id, ticker, session, feed_state) of an interval feed at every point: no observation, expired, unknown or observed.

    The newest effective row known at the point is judged; an expired one isn't replaced by an older.
    """
    rows = latest_known(points, feed, ["ticker", "effective_date"], "effective_date", tie=tie)
    value = F.col(state) if state else F.lit("INTERVAL")
    last = rows.groupBy("point_id").agg(F.max(F.struct("effective_date", "known_at", "valid_until", value.alias("value"))).alias("r"))
    found = points.select("point_id", "ticker", "session").join(last, "point_id", "left")
    label = (
        F.when(F.col("r").isNull(), "UNAVAILABLE_NO_KNOWN_OBSERVATION")
        .when(F.col("r.valid_until") < F.col("session"), "UNAVAILABLE_EXPIRED")
        .when(F.col("r.value") == "UNKNOWN", "UNAVAILABLE_UNKNOWN_STATE")
        .otherwise(F.concat(F.lit("OBSERVED_"), F.coalesce("r.value", F.lit("INTERVAL"))))
    )
    return found.select("point_id", "ticker", "session", label.alias("feed_state"))


def earnings_states(points: DataFrame, context: DataFrame, most_sessions: int = 20) -> DataFrame:
    """(point_id, feed_state) of the earnings feed: stale reports and those without a consensus are unavailable."""
    label = (
        F.when(F.col("earnings_status").isNull(), "UNAVAILABLE_NO_KNOWN_OBSERVATION")
        .when(F.col("earnings_age") > most_sessions, "UNAVAILABLE_STALE_EARNINGS")
        .when(F.col("earnings_status") == "CONSENSUS", "OBSERVED_CONSENSUS")
        .otherwise("UNAVAILABLE_CONSENSUS_OR_NONZERO_EXPECTATION")
    )
    return points.select("point_id").join(context, "point_id", "left").select("point_id", label.alias("feed_state"))


def window_states(spine: DataFrame, value: str, n: int) -> DataFrame:
    """spine (ticker, session, value; null where the feed has none) with feed_state: whether all of the last n sessions are there."""
    w = Window.partitionBy("ticker").orderBy("session").rowsBetween(1 - n, 0)
    return spine.withColumn("feed_state", F.when(F.count(value).over(w) == n, "OBSERVED_WINDOW").otherwise("UNAVAILABLE_SESSION_WINDOW"))


def feed_coverage(states: DataFrame) -> DataFrame:
    """(session, feed, expected, covered, status, reasons): how many entities each feed covers, and all states with their counts.

    states: session, feed, entity, state.  States are counted before they are gathered, so that a row holds one entry a state.
    """
    counted = states.groupBy("session", "feed", "state").agg(F.count("*").alias("n"))
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n"))))
    rows = counted.groupBy("session", "feed").agg(F.sum("n").alias("expected"), F.sum(F.when(F.col("state").startswith("OBSERVED"), F.col("n")).otherwise(0)).alias("covered"), reasons.alias("reasons"))
    status = F.when((F.col("expected") > 0) & (F.col("covered") == F.col("expected")), "RECORDED_COVERAGE_NOT_PROVIDER_VERIFIED").otherwise("UNAVAILABLE_OR_PARTIAL")
    return rows.select("session", "feed", "expected", "covered", status.alias("status"), "reasons")


def audit_summary(daily: DataFrame, bench: DataFrame) -> DataFrame:
    """One row over daily_coverage's rows: sessions, their ends, bounds of members and of coverage, and the sessions without a valid benchmark bar."""
    good = bench.where("bench > 0").select("session", F.lit(True).alias("__good"))
    rows = daily.join(good, "session", "left")
    return rows.agg(
        F.count("*").alias("sessions"), F.min("session").alias("start"), F.max("session").alias("end"), F.min("declared").alias("members_min"), F.max("declared").alias("members_max"),
        F.min("coverage").alias("coverage_min"), F.max("coverage").alias("coverage_max"), F.count_if(F.col("__good").isNull()).alias("missing_benchmark"),
    )
