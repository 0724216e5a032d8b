"""Exit policies of long trades: fixed, trailing by the average true range, chandelier, and scaling out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.outcomes import with_ordinals

POLICIES = ("FIXED", "ATR_TRAIL", "CHANDELIER", "SCALE_OUT")


def exit_policies(trades: DataFrame, bars: DataFrame, policies: tuple[str, ...] = POLICIES, multiple: float = 2.0) -> DataFrame:
    """(trade_id, policy, r, reason, bars_held, exit_session, scaled) of long trades under each policy.

    trades: trade_id, ticker, signal_ord, entry, stop, target, time_stop; bars carry atr.  A trailing stop
    for a day is the highest level that the days before it set (their highest close, or high, less
    `multiple` ranges), and never below the first stop.  SCALE_OUT sells half at one risk and the rest
    at three.  In one bar: stop at the open, target at the open, stop, half, target, time.  Policies
    multiply rows by their number only; a trade meets its own bars on equal ticker and ordinal.  Trades
    without risk or bars are left out.
    """
    c = F.col
    each = F.explode(F.array(*map(F.lit, policies)))
    days = trades.where("entry > stop and time_stop > 0").select("trade_id", "ticker", "signal_ord", "entry", "stop", "target", "time_stop", F.explode(F.sequence(F.lit(1), c("time_stop"))).alias("day"))
    held = days.withColumn("ord", c("signal_ord") + c("day")).join(with_ordinals(bars).select("ticker", "ord", "session", "open", "high", "low", "close", "atr"), ["ticker", "ord"])
    risk = c("entry") - c("stop")
    rows = held.select("*", each.alias("policy")).withColumn("goal", F.when(c("policy") == "SCALE_OUT", c("entry") + 3 * risk).when(c("policy") == "FIXED", c("target")))

    w = Window.partitionBy("trade_id", "policy").orderBy("day")
    past, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    highest = F.greatest(c("entry"), F.max(F.when(c("policy") == "CHANDELIER", c("high")).otherwise(c("close"))).over(so_far))
    trails = c("policy").isin("ATR_TRAIL", "CHANDELIER") & (c("atr") > 0) & ~F.isnan("atr")
    rows = rows.withColumn("__level", F.when(trails, highest - multiple * c("atr")))
    rows = rows.withColumn("__stop", F.greatest(c("stop"), F.max("__level").over(past)))

    at_open_stop, at_open_goal = c("open") <= c("__stop"), F.coalesce(c("open") >= c("goal"), F.lit(False))
    stopped, reached = c("low") <= c("__stop"), F.coalesce(c("high") >= c("goal"), F.lit(False))
    half_level = c("entry") + risk
    halved = (c("policy") == "SCALE_OUT") & ~at_open_stop & (at_open_goal | (c("open") >= half_level) | (~stopped & (c("high") >= half_level)))
    half_price = F.when(halved, F.greatest(half_level, c("open")))
    price = F.when(at_open_stop, c("open")).when(at_open_goal, c("open")).when(stopped, c("__stop")).when(reached, c("goal"))
    trailing = F.when(c("__stop") > c("stop"), "TRAIL_STOP").otherwise("STOP")
    reason = F.when(at_open_stop, trailing).when(at_open_goal, "TARGET").when(stopped, trailing).when(reached, "TARGET")
    marked = rows.select("trade_id", "policy", "day", "session", "entry", risk.alias("risk"), "close", price.alias("price"), reason.alias("reason"), half_price.alias("half"))

    first = F.min(F.when(c("price").isNotNull(), F.struct("day", "session", "price", "reason")))
    last = F.max(F.struct("day", "session", c("close").alias("price"), F.lit("TIME").alias("reason")))
    half = F.min(F.when(c("half").isNotNull(), F.struct("day", "half")))
    done = marked.groupBy("trade_id", "policy").agg(F.coalesce(first, last).alias("x"), half.alias("h"), F.first("entry").alias("entry"), F.first("risk").alias("risk"))
    scaled = F.coalesce(c("h.day") <= c("x.day"), F.lit(False))
    paid = F.when(scaled, (c("h.half") + c("x.price")) / 2).otherwise(c("x.price"))
    return done.select(
        "trade_id", "policy", F.round((paid - c("entry")) / c("risk"), 4).alias("r"), c("x.reason").alias("reason"), c("x.day").alias("bars_held"), c("x.session").alias("exit_session"), scaled.alias("scaled")
    )
