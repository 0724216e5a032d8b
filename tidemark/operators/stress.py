"""Resampling of a trade history in blocks: wealth paths, drawdowns, losses and ruin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The least factor by which a trade can change wealth, so that its logarithm exists: a total loss.
LEAST_FACTOR = 1e-300


def ordinals(trades: DataFrame) -> DataFrame:
    """trades with `pos`, their place from 0 by exit_session and trade_id.

    A day's trades are numbered among themselves and moved by the days before, one small row each, so no task orders all.
    """
    inside = Window.partitionBy("__day").orderBy("exit_session", "trade_id")
    rows = trades.withColumn("__day", F.to_date("exit_session"))
    before = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("__day").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    numbered = rows.withColumn("pos", F.row_number().over(inside) - 1).join(days.select("__day", "__base"), "__day")
    return numbered.withColumn("pos", F.col("__base") + F.col("pos")).drop("__day", "__base")


def circular_bootstrap(trades: DataFrame, simulations: int = 10_000, block: int = 5, risk_fraction: float = 0.01, ruin: float = 0.5, seed: int = 7) -> DataFrame:
    """One row: trades, worst_drawdown, drawdown_p95, loss_var95, loss_shortfall95, ruin_share, final_p05 and final_median.

    Each simulation draws as many trades as there are, in blocks of `block` neighbours that wrap around at the end; the last block is cut.  Wealth
    starts at 1 and is multiplied by 1 + risk_fraction * net_r.  What a block does is found once for each first trade, so that a simulation
    chains blocks and not trades.  Trades without a day or a net_r don't take part; without any the figures are null and trades is 0.
    """
    c = F.col
    known = trades.where("exit_session is not null and net_r is not null").select("exit_session", "trade_id", "net_r")
    total = known.agg(F.count("*").alias("n")).withColumns({"__block": F.least(F.lit(block).cast("long"), c("n"))})
    total = total.withColumn("__blocks", F.when(c("n") > 0, F.ceil(c("n") / c("__block"))).otherwise(0)).withColumn("__tail", c("n") - (c("__blocks") - 1) * c("__block"))
    total = F.broadcast(total)  # one row

    gain = F.ln(F.greatest(F.lit(LEAST_FACTOR), 1 + risk_fraction * c("net_r")))
    steps = ordinals(known).crossJoin(total).select("n", "__tail", "pos", gain.alias("gain"), F.explode(F.sequence(F.lit(0).cast("long"), c("__block") - 1)).alias("off"))
    path = Window.partitionBy("start").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("start", F.pmod(c("pos") - c("off"), c("n"))).withColumn("run", F.sum("gain").over(path))
    steps = steps.withColumn("fall", c("run") - F.greatest(F.lit(0.0), F.max("run").over(path)))

    def summary(inside, name):
        run = F.when(inside, c("run"))
        return F.struct(F.max_by(run, F.when(inside, c("off"))).alias("total"), F.max(run).alias("hi"), F.min(run).alias("lo"), F.min(F.when(inside, c("fall"))).alias("fall")).alias(name)

    starts = steps.groupBy("start").agg(summary(F.lit(True), "whole"), summary(c("off") < c("__tail"), "cut"))

    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "sim", "b")), 1, 8), 16, 10).cast("long")
    sims = trades.sparkSession.range(simulations).withColumnRenamed("id", "sim").crossJoin(total).where("n > 0")
    draws = sims.select("sim", "n", "__blocks", F.explode(F.sequence(F.lit(0).cast("long"), c("__blocks") - 1)).alias("b")).withColumn("start", draw % c("n"))
    did = draws.join(starts, "start").select("sim", "b", F.when(c("b") == c("__blocks") - 1, c("cut")).otherwise(c("whole")).alias("s")).select("sim", "b", "s.*")
    before = Window.partitionBy("sim").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    did = did.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    did = did.withColumn("peak", F.greatest(F.lit(0.0), F.max(c("base") + c("hi")).over(before)))
    low = c("base") + c("lo")
    ends = did.groupBy("sim").agg(F.exp(F.sum("total")).alias("final"), (1 - F.exp(F.least(F.lit(0.0), F.min(F.least("fall", low - c("peak")))))).alias("drawdown"), F.exp(F.least(F.lit(0.0), F.min(low))).alias("least"))
    quantile = lambda name, p: F.percentile(name, F.lit(p))
    ends = ends.withColumn("loss", 1 - c("final"))
    level = F.broadcast(ends.agg(quantile("loss", 0.95).alias("var")))
    tail = ends.crossJoin(level).agg(
        F.max("drawdown").alias("worst_drawdown"), quantile("drawdown", 0.95).alias("drawdown_p95"), F.greatest(F.lit(0.0), F.max("var")).alias("loss_var95"),
        F.greatest(F.lit(0.0), F.avg(F.when(c("loss") >= c("var"), c("loss")))).alias("loss_shortfall95"), F.avg((c("least") <= ruin).cast("double")).alias("ruin_share"),
        quantile("final", 0.05).alias("final_p05"), quantile("final", 0.5).alias("final_median"), F.count("*").alias("__sims"),
    )
    shown = {n: F.when(c("__sims") > 0, c(n)) for n in ("loss_var95", "loss_shortfall95")}
    return total.select(c("n").alias("trades")).crossJoin(tail.withColumns(shown).drop("__sims"))
