"""Gates, exits, evidence models, fits, allocation, streams and sinks on small tables, against plain code."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tests.test_operators import walk
from tidemark.functions.statistics import correlation, framed_median
from tidemark.operators import alpha, coverage, exits, fitting, gates, indicators, selection
from tidemark.sources import sinks
from tidemark.streaming import streams

DAY = dt.datetime(2024, 1, 1)


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_direction_needs_both_or_two_of_three(spark):
    c = F.col
    rows = spark.createDataFrame([(True, 11.0, 10.0, None, None), (True, 9.0, 10.0, None, None), (False, 9.0, 10.0, None, None), (True, 9.0, 10.0, True, None), (False, 9.0, 10.0, None, "LONG"), (None, 9.0, 10.0, None, None)], "up boolean, close double, ema double, vwap boolean, held string")
    assert one(rows, gates.direction(c("up"), c("close"), c("ema"))) == ["LONG", None, "SHORT", None, "SHORT", "SHORT"]
    assert one(rows, gates.direction(c("up"), c("close"), c("ema"), c("vwap"), c("held"))) == ["LONG", None, "SHORT", "LONG", "LONG", "SHORT"]


def test_regime_gate_exceptions(spark):
    c = F.col
    data = [("LONG", "TREND_UP", True, 80.0), ("LONG", "TREND_UP", False, 50.0), ("LONG", "RANGE", True, 55.0), ("LONG", "RANGE", True, 56.0), ("SHORT", "RANGE", True, 45.0), ("SHORT", "TREND_UP", True, 45.0), ("LONG", "TREND_DOWN", True, 72.0), ("LONG", "TREND_DOWN", True, 73.0), ("LONG", None, None, None)]
    rows = spark.createDataFrame(data, "side string, regime string, sure boolean, rsi double").withColumns({"close": F.lit(4.0), "e20": F.lit(3.0), "e50": F.lit(2.0), "e200": F.lit(1.0)})
    gate = lambda held: gates.regime_gate(c("side"), c("regime"), c("sure"), c("rsi"), c("close"), c("e20"), c("e50"), c("e200"), held)
    assert one(rows, gate(None)) == [True, False, True, False, True, False, True, False, False]
    assert one(rows, gate(F.lit(True)))[6] is False
    assert one(rows, gates.counter_trend_gate(c("side"), c("regime"), F.lit(0.6))) == [True] * 6 + [False, False, True]
    assert one(rows, gates.regime_threshold(c("regime")))[0:3:2] == [0.50, 0.55] and one(rows, gates.regime_threshold(c("regime")))[-1] == 0.52


def test_tiers_and_session_gates(spark):
    c = F.col
    rows = spark.createDataFrame([(0.6, 0.2, False), (0.5, 0.0, False), (0.5, -0.1, False), (0.48, 0.0, True), (0.53, 0.1, False), (0.54, 0.2, False), (None, None, False)], "p double, e double, held boolean")
    assert one(rows, gates.tier(c("p"), c("e"), c("held"))) == ["SELECT", "WATCH", "REJECT", "SELECT", "REJECT", "SELECT", "REJECT"]
    assert one(rows, gates.tier(c("p"), c("e"), c("held"), midday=F.lit(True)))[3:6] == ["SELECT", "WATCH", "WATCH"]
    clock = spark.createDataFrame([("INTRADAY", "CLOSING_TREND", "14:30"), ("INTRADAY", "CLOSING_TREND", "14:29"), ("SWING", "CLOSING_TREND", "15:00"), (None, None, None)], "h string, phase string, t string")
    assert one(clock, gates.cutoff_gate(c("h"), c("phase"), c("t"))) == [False, True, True, True]
    assert one(clock, gates.horizon(F.lit("LONG"), c("phase"), F.lit(15.0), intraday=True)) == ["SWING", "SWING", "SWING", "SWING"]
    assert one(clock.limit(1), gates.reasons((F.lit(True), "a"), (F.lit(None).cast("boolean"), "b"), (F.lit(True), F.lit("c")))) == [["a", "c"]]


def plain_exit(policy, entry, stop, target, bars, multiple=2.0):
    """(r, reason, bars held) by a loop over the bars of one long trade."""
    risk, level, high, scaled, paid = entry - stop, stop, entry, False, []
    goal = entry + 3 * risk if policy == "SCALE_OUT" else target if policy == "FIXED" else None
    for day, b in enumerate(bars, 1):
        out = None
        half = entry + risk
        if b.open <= level:
            out = (b.open, "STOP" if level == stop else "TRAIL_STOP")
        else:
            if policy == "SCALE_OUT" and not scaled and b.open >= half:
                scaled, paid = True, [b.open]
            if goal and b.open >= goal:
                out = (b.open, "TARGET")
            elif b.low <= level:
                out = (level, "STOP" if level == stop else "TRAIL_STOP")
            else:
                if policy == "SCALE_OUT" and not scaled and b.high >= half:
                    scaled, paid = True, [half]
                if goal and b.high >= goal:
                    out = (goal, "TARGET")
        if out is None and day == len(bars):
            out = (b.close, "TIME")
        if out:
            price = (paid[0] + out[0]) / 2 if scaled else out[0]
            return round((price - entry) / risk, 4), out[1], day
        if policy in ("ATR_TRAIL", "CHANDELIER"):
            high = max(high, b.close if policy == "ATR_TRAIL" else b.high)
            level = max(level, high - multiple * b.atr)


def test_exit_policies_match_a_loop(spark):
    source = walk(200).drop(columns=["sector", "volume"])
    source["atr"] = source["close"] * 0.01
    bars = spark.createDataFrame(source)
    rows = []
    for ticker, frame in source.groupby("ticker"):
        for n in range(5, 180, 6):
            close = float(frame.close.iloc[n - 1])
            rows.append((f"{ticker}{n}", ticker, n, close, close * 0.98, close * 1.03, 12))
    trades = spark.createDataFrame(rows + [("flat", "A", 5, 1.0, 1.0, 2.0, 5)], "trade_id string, ticker string, signal_ord int, entry double, stop double, target double, time_stop int")
    got = {(r.trade_id, r.policy): (r.r, r.reason, r.bars_held) for r in exits.exit_policies(trades, bars).collect()}
    assert len(got) == 4 * len(rows)
    for id_, ticker, n, entry, stop, target, hold in rows:
        ahead = list(source[source.ticker == ticker].iloc[n : n + hold].itertuples())
        for policy in exits.POLICIES:
            want, have = plain_exit(policy, entry, stop, target, ahead), got[id_, policy]
            assert have[0] == pytest.approx(want[0], abs=1e-4) and have[1:] == want[1:]
    assert {v[1] for v in got.values()} == {"STOP", "TRAIL_STOP", "TARGET", "TIME"}


def test_breadth_sectors_and_median(spark):
    data = pd.DataFrame([(t, s, DAY + dt.timedelta(d), 10.0 + d * (1 if t < "C" else -0.1)) for t, s in (("A", 0), ("B", 0), ("C", 1), ("D", 1)) for d in range(60)], columns=["ticker", "sector", "session", "close"])
    bars = spark.createDataFrame(data)
    last = alpha.breadth_risk(bars).orderBy(F.desc("session")).first()
    assert (last.breadth, last.breadth_valid, last.breadth_total, last.breadth_risk_scale) == (0.5, 4, 4, 0.5)
    assert alpha.breadth_risk(bars).orderBy("session").first().breadth_risk_scale == 0.0
    bench = bars.groupBy("session").agg(F.avg("close").alias("bench"))
    tied = bars.select(F.col("ticker").alias("sector"), "session", "close")
    ranks = {r.sector: r.sector_fraction for r in alpha.sector_fractions(tied, bench, 20, 4).where(F.col("session") == DAY + dt.timedelta(59)).collect()}
    assert ranks == {"A": 0.5, "B": 0.5, "C": 1.0, "D": 1.0}  # ties take the worst place
    gap = tied.where(~((F.col("sector") == "D") & (F.col("session") == DAY + dt.timedelta(50))))
    assert alpha.sector_fractions(gap, bench, 20, 4).where(F.col("session") >= DAY + dt.timedelta(50)).count() == 0
    x = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 2.0), (4, None)], "k int, x double")
    from pyspark.sql import Window

    assert one(x.orderBy("k"), framed_median("x", Window.orderBy("k").rowsBetween(-2, 0))) == [3.0, 2.0, 2.0, 1.5]
    constant = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double")
    assert constant.agg(correlation("a", "b")).first()[0] is None


def test_earnings_age_revisions_and_growth(spark):
    sessions = spark.createDataFrame([(DAY + dt.timedelta(d),) for d in range(0, 60) if (DAY + dt.timedelta(d)).weekday() < 5], "session timestamp")
    at = lambda d, h=0: DAY + dt.timedelta(days=d, hours=h)
    feed = spark.createDataFrame(
        [("A", at(-30), at(7, 16), at(7, 17), 1.2, 1.0, "CONSENSUS"), ("A", at(-30), at(7, 16), at(20), 0.9, 1.0, "CONSENSUS"), ("B", at(-30), at(7, 10), at(7, 11), 1.0, 0.0, "CONSENSUS")],
        "ticker string, period_end timestamp, announced_at timestamp, known_at timestamp, actual_eps double, expected_eps double, expectation_kind string",
    )
    points = spark.createDataFrame([("a1", "A", at(8), at(8, 18)), ("a2", "A", at(21), at(21, 18)), ("a3", "A", at(45), at(45, 18)), ("a0", "A", at(4), at(4, 18)), ("b1", "B", at(8), at(8, 18)), ("c", "C", at(8), at(8, 18))], "point_id string, ticker string, session timestamp, asof timestamp")
    found = alpha.earnings_context(points, feed, sessions)
    got = {r.point_id: (r.earnings_status, r.earnings_surprise and round(r.earnings_surprise, 6), r.earnings_age) for r in found.collect()}
    # announced after the close of day 7 (a Monday), so the first session counted is day 8
    assert got == {"a1": ("CONSENSUS", 0.2, 1), "a2": ("CONSENSUS", -0.1, 10), "a3": ("STALE", None, 28), "b1": ("ZERO_EXPECTATION_UNSCORABLE", None, 2)}
    fund = spark.createDataFrame([("A", at(-30), at(7), 0.4, 0.15, True), ("B", at(-200), at(7), 0.4, 0.3, True)], "ticker string, period_end timestamp, known_at timestamp, eps_growth double, revenue_growth double, guidance_raised boolean")
    growth = {r.point_id: (r.growth_status, r.earnings_score) for r in alpha.growth_context(points, fund, found).collect()}
    assert growth["a1"] == ("OBSERVED", pytest.approx((1 + 0.5 + 1 + 1) / 4)) and growth["b1"] == ("STALE", None) and growth["a3"][1] is None
    states = {r.point_id: r.feed_state for r in coverage.earnings_states(points, found).collect()}
    assert states["a3"] == "UNAVAILABLE_STALE_EARNINGS" and states["c"] == "UNAVAILABLE_NO_KNOWN_OBSERVATION" and states["a1"] == "OBSERVED_CONSENSUS"


def test_decisions_name_every_reason(spark):
    row = dict(base_reasons=[], rs_percentile=90.0, sector_fraction=0.2, breadth_risk_scale=1.0, high=2.0, low=1.0, close=2.0, earnings_status="CONSENSUS", earnings_surprise=0.1, growth_status="OBSERVED", eps_growth=0.5, revenue_growth=0.5, guidance_raised=True, earnings_score=0.9,
        flow_score=0.9, sma_200=1.0, adaptive_regime="BULL", adaptive_adx_min=20.0, adx=25.0, trigger="BREAKOUT", meta_probability=0.5)
    none = {**row, **{k: None for k in row if k != "base_reasons"}, "base_reasons": ["first"]}
    schema = "base_reasons array<string>, rs_percentile double, sector_fraction double, breadth_risk_scale double, high double, low double, close double, earnings_status string, earnings_surprise double, growth_status string, eps_growth double, revenue_growth double, guidance_raised boolean, earnings_score double, flow_score double, sma_200 double, adaptive_regime string, adaptive_adx_min double, adx double, trigger string, meta_probability double"
    rows = spark.createDataFrame([tuple(row.values()), tuple(none.values())], schema)
    good, bad = alpha.alpha_decisions(rows, phase=3).collect()
    assert good.status == "QUALIFIED" and good.alpha_score == pytest.approx(100 * (0.3 * 0.9 + 0.25 * 0.9 + 0.2 * 0.9 + 0.15 + 0.1))
    assert bad.alpha_score is None and bad.reasons[0] == "first" and len(bad.reasons) == 10
    assert [r.reasons for r in alpha.alpha_decisions(rows, phase=4).collect()][0] == ["meta_probability_unknown_or_weak"]
    assert {r.reason: r.n for r in alpha.rejection_counts(alpha.alpha_decisions(rows, phase=1)).collect()}["first"] == 1


def test_weights_and_ridge(spark):
    assert fitting.floored(np.array([0.5, 0.49, 0.01])).tolist() == pytest.approx([0.97 * 0.5 / 0.99, 0.97 * 0.49 / 0.99, 0.03])
    assert fitting.shrunk_weights({"a": -1.0}, {"a": 0.4, "b": 0.6}) == {"a": 0.4, "b": 0.6}
    mixed = fitting.shrunk_weights({"a": 3.0, "b": 1.0}, {"a": 0.5, "b": 0.5})
    assert mixed == pytest.approx({"a": 0.7 * 0.75 + 0.15, "b": 0.7 * 0.25 + 0.15})
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 3))
    y = x @ [2.0, 1.0, -1.0] + r.normal(size=200)
    rows = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(pnl=y))
    centred = x - x.mean(0)
    slope = np.maximum(np.linalg.solve(centred.T @ centred + np.eye(3), centred.T @ (y - y.mean())), 0)
    assert fitting.ridge_weights(rows, ("a", "b", "c")) == pytest.approx(dict(zip("abc", np.round(slope / slope.sum(), 4))))
    assert fitting.ridge_weights(rows.limit(3), ("a", "b")) == {}


def test_factor_ratios_match_pandas(spark):
    r = np.random.default_rng(5)
    data = pd.DataFrame([(f"T{k}", DAY + dt.timedelta(d), r.normal(), 1.0, r.normal()) for d in range(40) for k in range(12)], columns=["ticker", "session", "f", "flat", "forward"])
    got = {x.factor: x.icir for x in fitting.factor_ratios(spark.createDataFrame(data), ("f", "flat"), step=3, lookback=30, offset=5).collect()}
    days = sorted(data.session.unique(), reverse=True)[5:35:3]
    ics = [data[data.session == d].f.rank().corr(data[data.session == d].forward.rank()) for d in days]
    assert got["f"] == pytest.approx(np.mean(ics) / np.std(ics)) and got["flat"] == 0.0


def test_meta_model_purges_and_fits(spark):
    r = np.random.default_rng(9)
    n = 200
    x = r.normal(size=n)
    rows = spark.createDataFrame(pd.DataFrame({"trade_id": range(n), "observed": [DAY + dt.timedelta(hours=k) for k in range(n)], "closed": [DAY + dt.timedelta(hours=k + 5) for k in range(n)], "x": x, "win": (x + r.normal(size=n) * 0.3 > 0).astype(int)}))
    split = fitting.meta_split(rows, DAY + dt.timedelta(days=300)).cache()
    assert {p.part: p.n for p in split.groupBy("part").agg(F.count("*").alias("n")).collect()} == {"fit": 155, "purged": 5, "holdout": 40}
    model, held = fitting.fit_meta(split, ("x",))
    assert model["samples"] == 155 and model["weights"][0] > 0
    brier = held.agg(F.avg((F.col("probability") - F.col("win")) ** 2)).first()[0]
    assert brier < 0.15
    assert fitting.fit_meta(split.limit(30), ("x",)) == (None, None)


def test_allocation_limits(spark):
    day = (DAY,)
    c = [day + row for row in [("A", "s", 9.0, 100, 100.0, 95.0, 1.0), ("B", "s", 8.0, 5000, 100.0, 95.0, 1.0), ("C", "s", 7.0, 10, 100.0, 95.0, 1.0), ("D", "t", 6.0, 10, 100.0, 95.0, 1.0), ("E", "u", 5.0, 10, 100.0, 95.0, 0.0), ("F", "v", 4.0, 10, 90.0, 95.0, 1.0), ("H", "h", 3.0, 10, 100.0, 95.0, 1.0), ("G", "w", 2.0, 10, 100.0, 95.0, 1.0)]]
    rows = spark.createDataFrame(c, "session timestamp, ticker string, sector string, rank_score double, quantity long, price double, stop double, risk_scale double")
    names = "ABCDEFH"
    pairs = [(a, b, 0.9 if (a, b) == ("A", "D") else 0.1) for k, a in enumerate(names) for b in names[k + 1 :]]
    held = spark.createDataFrame([day + ("H", "h", 10, 100.0, 50.0)], "session timestamp, ticker string, sector string, shares long, price double, risk double")
    got = {r.ticker: (r.shares, r.reason) for r in selection.allocate(rows, spark.createDataFrame(pairs, "a string, b string, corr double"), held).collect()}
    assert got == {"A": (100, "allocated"), "B": (2900, "allocated"), "C": (0, "sector_cap"), "D": (0, "correlation_cap"), "E": (0, "breadth_defensive"), "F": (0, "invalid_allocation_inputs"), "H": (0, "already_held"), "G": (0, "correlation_unknown")}


def test_indicator_stream_matches_the_batch(spark, tmp_path):
    source = walk(80).drop(columns=["sector"])
    half = source.session.sort_values().iloc[len(source) // 2]
    folder = str(tmp_path / "in")
    bars = spark.createDataFrame(source)
    bars.where(F.col("session") <= F.lit(half)).coalesce(1).write.parquet(folder)
    run = lambda: streams.indicator_stream(spark.readStream.schema(bars.schema).parquet(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    run()
    bars.where(F.col("session") > F.lit(half)).coalesce(1).write.mode("append").parquet(folder)
    run()  # the second run goes on from the kept state
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ticker", "session").toPandas()
    want = indicators.add_indicators(bars, complete=False).orderBy("ticker", "session").toPandas()
    for a, b in (("ema", "ema_20"), ("rsi", "rsi"), ("atr", "atr")):
        assert got[a].tolist() == pytest.approx(want[b].tolist(), nan_ok=True)


def test_recalibration_sink(spark, tmp_path):
    rows = spark.createDataFrame([(k, DAY + dt.timedelta(k), float(k % 7), float(k % 3), float(k % 7) * 2) for k in range(60)], "trade_id long, closed_at timestamp, a double, b double, pnl double")
    write = streams.recalibrate(str(tmp_path / "t"), str(tmp_path / "w"), ("a", "b"))
    write(rows.where("trade_id < 30"), 0)
    write(rows.where("trade_id >= 30"), 1)
    write(rows.where("trade_id >= 30"), 1)  # replayed
    assert spark.read.parquet(str(tmp_path / "t")).count() == 60
    last = {r.factor: r.weight for r in spark.read.parquet(str(tmp_path / "w")).where("batch = 1").collect()}
    assert last["a"] > 0.9 and set(last) == {"a", "b"}


def test_sinks(spark, tmp_path):
    journal = spark.createDataFrame([(1, "a", "{}"), (2, "b", None)], "sequence long, event_id string, payload string")
    path = str(tmp_path / "export")
    assert sinks.append_export(journal, path) == 2 and sinks.append_export(journal, path) == 0
    more = journal.unionByName(spark.createDataFrame([(3, "c", "{}")], journal.schema))
    assert sinks.append_export(more, path) == 1 and spark.read.schema(journal.schema).json(path).count() == 3
    with pytest.raises(ValueError):
        sinks.append_export(more.withColumn("payload", F.lit("x")), path)
    sinks.write_audit(str(tmp_path / "r"), journal, journal.select(F.array("event_id").alias("ids")), journal.limit(0), journal.agg(F.count("*").alias("n")))
    assert json.loads(next((tmp_path / "r" / "summary").glob("*.json")).read_text()) == {"n": 2}
    assert sorted(r.ids for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "r" / "feeds")).collect()) == ['["a"]', '["b"]']
    assert "* n: unknown" in sinks.markdown({"n": None}, "Report")


def test_window_states_need_every_session(spark):
    rows = spark.createDataFrame([("A", DAY + dt.timedelta(d), None if d == 3 else 1.0) for d in range(7)], "ticker string, session timestamp, x double")
    got = one(coverage.window_states(rows, "x", 3).orderBy("session"), "feed_state")
    assert [g == "OBSERVED_WINDOW" for g in got] == [False, False, True, False, False, False, True]
