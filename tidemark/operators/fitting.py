"""Weights and models fitted on the cluster: information-coefficient weights, ridge weights, purged meta models.

Fits reduce the data to a few numbers by aggregates (a factor's coefficients by session, a matrix of
moments) or run as cluster estimators; what reaches the driver has one row a factor or cohort.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.statistics import correlation
from tidemark.operators.indicators import by_ticker


def signed_forward(rows: DataFrame, bars: int = 5) -> DataFrame:
    """rows (ticker, session, close, direction) with `forward`: the return over the next bars, negated for shorts."""
    sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    return rows.withColumn("forward", (F.lead("close", bars).over(by_ticker()) / F.col("close") - 1) * sign)


def factor_ratios(rows: DataFrame, factors: tuple[str, ...], step: int = 5, lookback: int | None = 120, offset: int = 5, least_names: int = 10, least_sessions: int = 5) -> DataFrame:
    """(factor, sessions, icir): mean over deviation of the factors' rank correlation with `forward`, over every `step`-th session.

    Sessions are counted back from the last one, `offset` of them left out; lookback null takes all.
    A factor that is constant in a session counts as 0 there; under `least_sessions` the ratio is 0.
    """
    w = Window.orderBy(F.desc("session"))  # one small row a session
    back = rows.select("session").distinct().withColumn("__back", F.row_number().over(w) - offset - 1)
    chosen = back.where((F.col("__back") >= 0) & (F.col("__back") % step == 0) & (F.col("__back") < lookback if lookback else F.lit(True)))
    long = rows.join(chosen, "session").where("forward is not null").select("session", "ticker", "forward", F.explode(F.map_from_arrays(F.array(*map(F.lit, factors)), F.array(*factors))).alias("factor", "value")).where("value is not null")
    group = Window.partitionBy("session", "factor")
    tied = lambda c: F.rank().over(group.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("session", "factor", c)) - 1) / 2.0
    ranked = long.withColumns({"__v": tied("value"), "__f": tied("forward")})
    ic = ranked.groupBy("session", "factor").agg(correlation("__v", "__f").alias("ic"), F.count("*").alias("n"), F.stddev_pop("value").alias("sd")).where(F.col("n") >= least_names)
    ic = ic.withColumn("ic", F.when(F.col("sd") > 1e-6, F.coalesce("ic", F.lit(0.0))).otherwise(0.0))
    out = ic.groupBy("factor").agg(F.count("*").alias("sessions"), F.avg("ic").alias("__m"), F.stddev_pop("ic").alias("__s"))
    ratio = F.when((F.col("sessions") >= least_sessions) & (F.col("__s") > 1e-6), F.col("__m") / F.col("__s")).otherwise(0.0)
    return out.select("factor", "sessions", ratio.alias("icir"))


def floored(weights: np.ndarray, floor: float = 0.03) -> np.ndarray:
    """Weights that sum to one with none under `floor`: what is too small is lifted, the others share the rest in proportion."""
    w = np.asarray(weights, float)
    if floor * len(w) >= 1:
        return np.full(len(w), 1.0 / len(w))
    low = np.zeros(len(w), bool)
    while True:
        free = w[~low].sum()
        rest = 1 - floor * low.sum()
        share = w * (rest / free) if free > 1e-9 else np.full(len(w), rest / (~low).sum())
        out = np.where(low, floor, share)
        worse = ~low & (out < floor)
        if not worse.any():
            return out / out.sum()
        low |= worse


def shrunk_weights(ratios: dict[str, float], prior: dict[str, float], empirical: float = 0.70, floor: float = 0.03) -> dict[str, float]:
    """Positive ratios as shares, drawn towards the prior and floored; the prior where no ratio is positive."""
    names = list(prior)
    positive = np.array([max(0.0, ratios.get(n, 0.0)) for n in names])
    if positive.sum() < 1e-6:
        return dict(prior)
    mixed = empirical * positive / positive.sum() + (1 - empirical) * np.array([prior[n] for n in names])
    return dict(zip(names, floored(mixed, floor).tolist()))


def ridge_weights(trades: DataFrame, factors: tuple[str, ...], label: str = "pnl", alpha: float = 1.0, least: int = 5) -> dict[str, float]:
    """Shares of the positive coefficients of a ridge fit with an unpenalised intercept; empty under `least` trades.

    One aggregate gives means and central moments of all pairs of columns, so the fit's size is that of the
    factors and not of the trades.
    """
    k = len(factors)
    names = [*factors, label]
    rows = trades.select(*(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in factors), F.col(label).cast("double").alias(label)).where(F.col(label).isNotNull())
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    found = rows.agg(F.count("*").alias("n"), *(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    if found.n < least:
        return {}
    moments = np.zeros((k + 1, k + 1))
    for i, j in pairs:
        moments[i, j] = moments[j, i] = found[f"c{i}_{j}"] * found.n
    slope = np.linalg.solve(moments[:k, :k] + alpha * np.eye(k), moments[:k, k])
    kept = np.maximum(slope, 0.0)
    return {n: round(float(v), 4) for n, v in zip(factors, kept / (kept.sum() or 1.0))}


def meta_split(rows: DataFrame, cutoff, cohort: str | None = None, train: float = 0.8) -> DataFrame:
    """Closed rows (observed, closed, win) up to the cutoff with `part`: fit, purged or holdout, in time order by cohort.

    A label that closes at or after the first held-out observation would leak, and is purged.
    """
    known = rows.where((F.col("observed") < F.lit(cutoff)) & (F.col("closed") < F.lit(cutoff)) & (F.col("closed") >= F.col("observed")))
    # cohorts are few and large, so places come from counts a day, and only days inside are ordered
    keys = [cohort] if cohort else []
    days = known.groupBy(*keys, F.to_date("observed").alias("__day")).agg(F.count("*").alias("__n"))
    total = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = total.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__all": F.sum("__n").over(total)})
    inside = Window.partitionBy(*keys, "__day").orderBy("observed", "closed", *(c for c in ("trade_id",) if c in rows.columns))
    placed = known.withColumn("__day", F.to_date("observed")).join(days, [*keys, "__day"]).withColumn("__place", F.col("__before") + F.row_number().over(inside) - 1)
    cut = F.greatest(F.lit(1), F.floor(F.col("__all") * train))
    edges = placed.where(F.col("__place") == cut).select(*keys, F.col("observed").alias("__edge"))
    marked = placed.join(edges, keys, "left") if keys else placed.join(edges, F.lit(True), "left")
    part = F.when(F.col("__place") >= cut, "holdout").when(F.col("closed") < F.col("__edge"), "fit").otherwise("purged")
    return marked.withColumn("part", part).drop("__day", "__n", "__before", "__all", "__place", "__edge")


def fit_meta(split: DataFrame, features: tuple[str, ...], least: int = 40, least_class: int = 10) -> tuple[dict | None, DataFrame | None]:
    """({mean, scale, weights, intercept, samples}, holdout with `probability`) of one cohort's split; (None, None) with too little evidence.

    Features are standardised by the fit rows' population deviation first, then fitted with a unit penalty.
    """
    split = split.where(" and ".join(f"{f} is not null" for f in features))
    counts = {(r.part, r.win): r.n for r in split.groupBy("part", "win").agg(F.count("*").alias("n")).collect()}  # at most six rows
    n = sum(v for (part, _), v in counts.items() if part == "fit")
    held = sum(v for (part, _), v in counts.items() if part == "holdout")
    if sum(counts.values()) < least or not held or min(counts.get(("fit", k), 0) for k in (0, 1)) < least_class:
        return None, None
    fit = split.where("part = 'fit'")
    stats = fit.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_pop(f).alias(f"s_{f}") for f in features)).first()
    mean, scale = [stats[f"m_{f}"] for f in features], [stats[f"s_{f}"] or 1.0 for f in features]
    scaled = lambda df: VectorAssembler(inputCols=[f"__scaled_{f}" for f in features], outputCol="__features").transform(
        df.withColumns({f"__scaled_{f}": (F.col(f) - m) / s for f, m, s in zip(features, mean, scale)})
    )
    model: LogisticRegressionModel = LogisticRegression(featuresCol="__features", labelCol="win", probabilityCol="__p", regParam=1.0 / n, elasticNetParam=0.0, standardization=False).fit(scaled(fit))
    out = model.transform(scaled(split.where("part = 'holdout'"))).withColumn("probability", vector_to_array("__p")[1])
    return {"mean": mean, "scale": scale, "weights": model.coefficients.toArray().tolist(), "intercept": float(model.intercept), "samples": n}, out.select(*split.columns, "probability")
