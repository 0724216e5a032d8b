"""Evaluation over time: folds, per-trade daily profit, fold statistics, feed windows and calibration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.statistics import correlation
from tidemark.operators.indicators import add_indicators
from tidemark.operators.outcomes import forward_bars, outcomes
from tidemark.operators.plugs import Plug, guarded


def session_folds(sessions: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """(fold, role, session): rolling windows of `train` and then `test` sessions; sessions are one small row each.

    A session finds its folds by arithmetic on its ordinal, so nothing is joined on a range.
    """
    numbered = sessions.select("session", (F.row_number().over(Window.orderBy("session")) - 1).alias("ord"))
    total = numbered.agg(F.count("*").alias("n"))
    last = F.floor((F.col("n") - train - test) / step)
    low, high = F.greatest(F.lit(0), F.ceil((F.col("ord") - train - test + 1) / step)), F.least(last, F.floor(F.col("ord") / step))
    rows = numbered.join(total, F.lit(True)).where(high >= low).select("session", "ord", F.explode(F.sequence(low, high)).alias("fold"))
    role = F.when(F.col("ord") - F.col("fold") * step < train, "train").otherwise("test")
    return rows.select(F.col("fold").cast("int").alias("fold"), role.alias("role"), "session")


def calendar_folds(sessions: DataFrame, train_years: int = 3) -> DataFrame:
    """(year, train_from, train_to, test_from, test_to): a test year after `train_years` of training."""
    years = sessions.groupBy(F.year("session").alias("year")).agg(F.min("session").alias("first"), F.max("session").alias("last"))
    w = Window.orderBy("year")  # one row a year
    first, last, n = F.lag("first", train_years).over(w), F.lag("last", 1).over(w), F.lag("year", train_years).over(w)
    rows = years.select("year", first.alias("train_from"), last.alias("train_to"), F.col("first").alias("test_from"), F.col("last").alias("test_to"), n.alias("__y"))
    return rows.where(F.col("__y") == F.col("year") - train_years).drop("__y")


def daily_profit(done: DataFrame, bars: DataFrame) -> DataFrame:
    """(trade_id, session, pnl): each held day's change in price; the last day takes the rest, so that days add up to the trade.

    done: outcomes' rows with bars_held, net_r, shares, direction.
    """
    held = forward_bars(done.where("bars_held > 0"), bars).where(F.col("day") <= F.col("bars_held"))
    w = Window.partitionBy("trade_id").orderBy("day")
    sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    move = (F.col("close") - F.coalesce(F.lag("close").over(w), F.col("entry"))) * sign * F.col("shares")
    net = F.col("net_r") * F.abs(F.col("entry") - F.col("stop")) * F.col("shares")
    rows = held.withColumns({"__move": move, "__net": net})
    before = F.coalesce(F.sum("__move").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    pnl = F.when(F.col("day") == F.col("bars_held"), F.col("__net") - before).otherwise(F.col("__move"))
    return rows.select("trade_id", "session", pnl.alias("pnl"))


def business_pnl(pnl: DataFrame, *by: str) -> DataFrame:
    """(by..., day, pnl) on a spine of all weekdays from the first to the last day of each group, 0 where nothing was made; weekend days with a result stay.

    pnl: session, pnl and `by`.  A group's range is one row that unfolds into its days.
    """
    days = pnl.where("pnl is not null and session is not null").groupBy(*by, F.to_date("session").alias("day")).agg(F.sum("pnl").alias("pnl"))
    ends = days.groupBy(*by).agg(F.min("day").alias("__a"), F.max("day").alias("__b"))
    spine = ends.select(*by, F.explode(F.sequence("__a", "__b")).alias("day")).where(F.weekday("day") < 5)
    return spine.join(days, [*by, "day"], "full_outer").withColumn("pnl", F.coalesce("pnl", F.lit(0.0)))


def sharpe(pnl: DataFrame, capital: float, *by: str) -> DataFrame:
    """(by..., days, total_pnl, sharpe): the annual Sharpe ratio of business_pnl by capital; 0 below two days or without variation.

    With `by` a fold, that is a fold's ratio over its own days.
    """
    daily = business_pnl(pnl, *by).withColumn("__r", F.col("pnl") / capital)
    spread = F.stddev_pop("__r")
    ratio = F.when((F.count(F.lit(1)) >= 2) & (spread > 0), F.round(F.avg("__r") / spread * F.sqrt(F.lit(252.0)), 3)).otherwise(0.0)
    return daily.groupBy(*by).agg(F.count(F.lit(1)).alias("days"), F.sum("pnl").alias("total_pnl"), ratio.alias("sharpe"))


def curve_fall(trades: DataFrame) -> DataFrame:
    """(curve_fall), one row: the largest fall of the running sum of net_r over all trades by exit_session and trade_id.

    Days are folded inside first and then put together, one small row each, so that no task orders all trades.
    """
    inside = Window.partitionBy("__day").orderBy("exit_session", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.select("exit_session", "trade_id", F.coalesce("net_r", F.lit(0.0)).alias("__r"), F.to_date("exit_session").alias("__day"))
    rows = rows.withColumn("__sum", F.sum("__r").over(inside)).withColumn("__fall", F.col("__sum") - F.max("__sum").over(inside))
    days = rows.groupBy("__day").agg(F.sum("__r").alias("total"), F.max("__sum").alias("hi"), F.min("__sum").alias("lo"), F.min("__fall").alias("fall"))
    before = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    days = days.withColumn("peak", F.greatest(F.lit(0.0), F.max(F.col("base") + F.col("hi")).over(before)))
    return days.agg(F.min(F.least("fall", F.col("base") + F.col("lo") - F.col("peak"))).alias("curve_fall"))


def fold_statistics(trades: DataFrame, fold: str = "fold") -> DataFrame:
    """By fold and (fold null) over all: trades, hit rate, mean and total R, and the largest fall of the R curve.

    worst_fall is that of the row's whole curve, over all folds where fold is null; inner_fall is the largest inside
    single folds.
    """
    w = Window.partitionBy(fold).orderBy("exit_session", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    run = trades.withColumn("__sum", F.sum("net_r").over(w)).withColumn("__fall", F.col("__sum") - F.greatest(F.lit(0.0), F.max("__sum").over(w)))
    stats = run.rollup(fold).agg(
        F.grouping(fold).alias("__all"), F.count("*").alias("trades"), F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.avg("net_r").alias("mean_r"), F.sum("net_r").alias("total_r"), F.min("__fall").alias("inner_fall")
    )
    stats = stats.crossJoin(F.broadcast(curve_fall(trades))).withColumn("worst_fall", F.when(F.col("__all") == 1, F.col("curve_fall")).otherwise(F.col("inner_fall")))
    return stats.withColumn(fold, F.when(F.col("__all") == 1, None).otherwise(F.col(fold))).drop("__all", "curve_fall")


def accumulation(spine: DataFrame, value: str, *by: str, recent: int = 5, prior: int = 20) -> DataFrame:
    """spine with the mean of the last `recent` sessions over that of the `prior` before; null unless all are present."""
    w = Window.partitionBy(*by).orderBy("session")

    def mean(first: int, last: int):
        frame = w.rowsBetween(first, last)
        return F.when(F.count(value).over(frame) == last - first + 1, F.avg(value).over(frame))

    return spine.withColumn("ratio", mean(1 - recent, 0) / F.nullif(mean(1 - recent - prior, -recent), F.lit(0.0)))


def information_coefficients(rows: DataFrame, factor: str, forward: str, least: int = 10) -> DataFrame:
    """(session, ic): rank correlation of a factor with the forward return, 0 where either is constant."""
    session = Window.partitionBy("session")
    rank = lambda c: F.rank().over(session.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("session", c)) - 1) / 2.0
    known = rows.where(F.col(factor).isNotNull() & F.col(forward).isNotNull()).withColumns({"__f": rank(factor), "__r": rank(forward)})
    out = known.groupBy("session").agg(F.coalesce(correlation("__f", "__r"), F.lit(0.0)).alias("ic"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).select("session", "ic")


def fit_probability(rows: DataFrame, score: str = "composite", label: str = "win", bound_a: float = 15.0, bound_b: float = 10.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(a score + b)) by bounded maximum likelihood on the cluster."""
    data = VectorAssembler(inputCols=[score], outputCol="__x").transform(rows.select(score, F.col(label).cast("double").alias(label)).na.drop())
    model = LogisticRegression(
        featuresCol="__x", labelCol=label, regParam=0.0, family="binomial", lowerBoundsOnCoefficients=DenseMatrix(1, 1, [-bound_a]), upperBoundsOnCoefficients=DenseMatrix(1, 1, [bound_a]),
        lowerBoundsOnIntercepts=DenseVector([-bound_b]), upperBoundsOnIntercepts=DenseVector([bound_b]),
    ).fit(data)
    return -float(model.coefficients[0]), -float(model.intercept)


def held_out(rows: DataFrame, newest: int, *order: str) -> DataFrame:
    """rows with `held`: whether a row is among the `newest` last ones by `order`, which must tell rows apart."""
    mark = F.struct(*order)
    cut = rows.orderBy(*(F.col(c).desc() for c in order)).limit(newest).agg(F.min(mark).alias("__cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("held", F.coalesce(mark >= F.col("__cut"), F.lit(False))).drop("__cut")


def probability_check(rows: DataFrame, a: float, b: float, score: str = "composite", label: str = "win") -> DataFrame:
    """One row: n, brier, mean_predicted, actual and error (predicted less actual) of 1 / (1 + exp(a score + b)); null without rows."""
    p, y = 1 / (1 + F.exp(a * F.col(score) + b)), F.col(label).cast("double")
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(p.alias("p"), y.alias("y"))
    out = known.agg(F.count("*").alias("n"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("actual"))
    return out.withColumn("error", F.col("mean_predicted") - F.col("actual"))


def fit_held_out(rows: DataFrame, *order: str, newest: int = 60, least: int = 20, score: str = "composite", label: str = "win") -> tuple[float, float, DataFrame]:
    """(a, b, check): the fit without the `newest` rows, and its check on those; with newest = 0 both use all rows."""
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    n = known.count()
    if n < newest + least:
        raise ValueError(f"{newest + least} rows are needed to hold out {newest}, {n} given")
    marked = held_out(known, newest, *order)
    a, b = fit_probability(marked.where("not held"), score, label)
    return a, b, probability_check(marked.where("held") if newest else known, a, b, score, label)


def calibration_set(trades: DataFrame, weights: dict[str, float], least: int = 80) -> DataFrame:
    """Executed trades with a known profit as trade_id, composite and win; nothing where there are fewer than `least`.

    A missing composite is the weighted sum of the factor columns named in weights, missing ones as 0.  A missing source counts as executed.
    """
    total = sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0))
    done = trades.where((F.coalesce("source", F.lit("EXECUTED")) == "EXECUTED") & F.col("pnl").isNotNull())
    rows = done.select("trade_id", F.coalesce("composite", total).alias("composite"), (F.col("pnl") > 0).cast("int").alias("win"))
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("__n")))).where(F.col("__n") >= least).drop("__n")


def walk_forward(bars: DataFrame, folds: DataFrame, screen: Callable[[DataFrame], DataFrame] | Plug, guards: tuple[Plug, ...] = (), friction: Column | None = None) -> DataFrame:
    """Outcomes (fold, ticker, net_r, hit, bars_held, ...) of what `screen` picks on each fold's last training session.

    All folds run at once: bars meet the folds on session (a bar is in few of them), and a fold's ticker is
    a group of its own, so indicators start afresh in every training slice.  screen takes the last
    bars with indicators and returns fold, ticker, entry, stop, target, direction, time_stop; entries
    run over the test slice only.  A screen that is a signal provider is checked before it runs; what an entry guard
    (of columns fold, ticker, entry, stop) gives a reason against isn't entered; friction is outcomes' cost.
    """
    rows = bars.join(folds, "session").withColumn("__key", F.concat_ws(":", "fold", "ticker"))
    train = rows.where("role = 'train'").drop("role", "__key")
    ends = folds.where("role = 'train'").groupBy("fold").agg(F.max("session").alias("session"))
    last = add_indicators(train, complete=False, partition=("fold", "ticker")).join(ends, ["fold", "session"], "left_semi")
    key = F.concat_ws(":", "fold", "ticker")
    picked, _ = guarded(screen.apply(last) if isinstance(screen, Plug) else screen(last), guards)
    picked = picked.drop("session", "open", "high", "low", "close").withColumns({"trade_id": key, "signal_ord": F.lit(0), "__ticker": F.col("ticker"), "ticker": key})
    test = rows.where("role = 'test'").select(F.col("__key").alias("ticker"), "session", "open", "high", "low", "close")
    return outcomes(picked, test, friction).drop("ticker").withColumnRenamed("__ticker", "ticker")
