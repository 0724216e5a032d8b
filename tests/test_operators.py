"""Screening and evidence operators on small tables, against plain code."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark.functions import curves
from tidemark.operators import bitemporal, coverage, factors, indicators, journal, market, outcomes, selection, setups
from tidemark.sources import readers
from tidemark.streaming import streams


def walk(n=300, seed=7, tickers=("A", "B")):
    rows = []
    for k, ticker in enumerate(tickers):
        r = np.random.default_rng(seed + k)
        close = 100 * np.exp(np.cumsum(r.normal(0.001, 0.01, n)))
        open_ = close * (1 + r.normal(0, 0.002, n))
        frame = pd.DataFrame({"ticker": ticker, "sector": k, "session": pd.bdate_range("2020-01-01", periods=n), "open": open_, "close": close, "volume": r.integers(1000, 5000, n).astype(float)})
        frame["high"], frame["low"] = frame[["open", "close"]].max(axis=1) * 1.005, frame[["open", "close"]].min(axis=1) * 0.995
        rows.append(frame)
    return pd.concat(rows, ignore_index=True)


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk()).cache()


def test_piecewise_curves(spark):
    x = spark.createDataFrame([(v,) for v in (10.0, 40.0, 46.5, 60.0, 75.5, 99.0, None)], "x double")
    got = [r[0] for r in x.select(curves.piecewise(F.col("x"), curves.RSI_LONG)).collect()]
    assert got[-1] is None and got[:-1] == pytest.approx([0.10, 0.475, 0.925, 1.0, 0.6, 0.20])
    rv = spark.createDataFrame([(0.9, False), (1.1, False), (2.5, False), (0.5, True)], "x double, d boolean")
    assert [r[0] for r in rv.select(curves.relative_volume(F.col("x"), F.col("d"))).collect()] == pytest.approx([0.0, 0.1, 1.0, 0.4])


def test_supertrend_bands_only_tighten():
    close = np.array([10.0, 11, 12, 11, 8, 7, 9, 13])
    line, up = indicators.supertrend(close, close + 1.5, close - 1.5)
    assert up.tolist() == [True, True, True, True, False, False, True, True]
    assert line.tolist() == [8.5, 9.5, 10.5, 10.5, 9.5, 8.5, 7.5, 11.5]


def test_indicators_match_a_plain_loop(bars):
    got = indicators.add_indicators(bars, complete=False).where("ticker = 'A'").orderBy("session").toPandas()
    source = walk().query("ticker == 'A'").reset_index(drop=True)
    ema, gain, loss, rsi = source.close[0], None, None, []
    for t, c in enumerate(source.close):
        ema += (c - ema) * 2 / 21
        if t:
            d = c - source.close[t - 1]
            gain, loss = (max(d, 0), max(-d, 0)) if gain is None else (gain + (max(d, 0) - gain) / 14, loss + (max(-d, 0) - loss) / 14)
        rsi.append(100 - 100 / (1 + gain / loss) if t >= 14 and loss else math.nan)
    assert got.ema_20.iloc[-1] == pytest.approx(ema)
    assert got.rsi.iloc[20:].tolist() == pytest.approx(rsi[20:])
    assert got.bb_upper.iloc[-1] == pytest.approx(source.close[-20:].mean() + 2 * source.close[-20:].std(ddof=0))
    assert got.rvol_20.iloc[-1] == pytest.approx(source.volume.iloc[-1] / source.volume.iloc[-21:-1].mean())


def test_streak_counts_back_without_a_break(spark):
    rows = spark.createDataFrame([("A", k, v) for k, v in enumerate([1, 1, 0, 1, 1, 1])], "ticker string, session int, f int")
    assert [r[0] for r in rows.select("session", indicators.streak(F.col("f")).alias("s")).orderBy("session").select("s").collect()] == [1, 2, 0, 1, 2, 3]


def fold_regimes(rows):
    """The same labels by a plain fold over sessions."""
    out = []
    for r in rows.itertuples():
        limit = market.PANIC_EXIT if out and out[-1] == "PANIC" else market.PANIC
        if r.breadth < limit:
            out.append("PANIC")
        elif r.atr_ratio >= market.EXPANSION_ATR and r.adx_median >= market.ADX_TREND:
            out.append("EXPANSION")
        elif r.adx_median < market.ADX_RANGE:
            out.append("RANGE")
        else:
            out.append("TREND_UP" if r.breadth >= market.TREND_UP_BREADTH else "TREND_DOWN" if r.breadth < market.TREND_DOWN_BREADTH else "RANGE")
    return out


def test_regimes_match_the_fold(spark):
    r = np.random.default_rng(3)
    rows = pd.DataFrame({"session": range(400), "breadth": r.uniform(0.1, 0.7, 400), "adx_median": r.uniform(10, 40, 400), "atr_ratio": r.uniform(0.8, 1.6, 400)})
    got = market.regimes(spark.createDataFrame(rows)).orderBy("session").toPandas()
    assert got.regime.tolist() == fold_regimes(rows)


def plain_profile(low, high, volume, bins=100):
    levels = np.linspace(min(low), max(high), bins + 1)
    hist = np.zeros(bins)
    for lo, hi, v in zip(low, high, volume):
        a, b = np.clip(np.searchsorted(levels, lo, "left") - 1, 0, bins - 1), np.clip(np.searchsorted(levels, hi, "right"), 0, bins - 1)
        hist[a : b + 1] += v / (b - a + 1)
    return hist, levels


def test_volume_profile(bars):
    got = factors.volume_profile(bars).where("ticker = 'B'").orderBy("session").toPandas()
    s = walk().query("ticker == 'B'").tail(30)
    hist, levels = plain_profile(s.low.tolist(), s.high.tolist(), s.volume.tolist())
    k, last = int(hist.argmax()), got.iloc[-1]
    assert last.poc == pytest.approx((levels[k] + levels[k + 1]) / 2) and last.val <= last.poc <= last.vah
    a, b = np.abs(levels - last.val).argmin(), np.abs(levels - last.vah).argmin()
    assert hist[a:b].sum() >= 0.7 * hist.sum() - 1e-6
    assert got.iloc[1].val == pytest.approx(got.iloc[1].close * 0.99)


def test_factor_scores_and_cohorts(bars):
    ind = indicators.add_indicators(bars)
    rows = factors.volume_profile(ind.withColumns({"direction": F.lit("LONG"), "rs": F.lit(1.0), "sector_rank": F.lit(1), "regime": F.lit("RANGE")}))
    scored = factors.composite(factors.score_factors(rows, n_sectors=2))
    r = scored.agg(*(F.min(n) for n in factors.NAMES), *(F.max(n) for n in factors.NAMES), F.count("composite"), F.count("*")).first()
    assert all(0 <= x <= 1 for x in r[:14]) and r[14] == r[15] > 0
    blended = factors.blend_cohorts(scored, least=1, full=2).select("ticker", "session", F.col("trend").alias("b")).join(scored, ["ticker", "session"])
    assert blended.where("b < 0 or b > 1").count() == 0
    assert factors.blend_cohorts(scored, least=10).select("trend").exceptAll(scored.select("trend")).count() == 0


def test_outcomes_order_and_gaps(spark):
    day = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    prices = [("A", day[0], 100, 100, 100, 100), ("A", day[1], 100, 111, 94, 100), ("B", day[0], 100, 100, 100, 100), ("B", day[1], 112, 115, 111, 114), ("C", day[0], 100, 100, 100, 100), ("C", day[1], 101, 103, 99, 102), ("C", day[2], 102, 104, 101, 103)]
    bars = spark.createDataFrame([(t, s, float(o), float(h), float(lo), float(c), 1.0) for t, s, o, h, lo, c in prices], "ticker string, session timestamp, open double, high double, low double, close double, volume double")
    trades = spark.createDataFrame([(x, x, 1, "LONG", 100.0, 95.0, 110.0, 2) for x in "ABC"] + [("D", "A", 1, "LONG", 100.0, 100.0, 110.0, 2), ("E", "Z", 1, "LONG", 100.0, 95.0, 110.0, 2)], "trade_id string, ticker string, signal_ord int, direction string, entry double, stop double, target double, time_stop int")
    got = {r.trade_id: (r.net_r, r.hit, r.bars_held) for r in outcomes.outcomes(trades, bars).collect()}
    assert got == {"A": (-1.0, False, 1), "B": (2.4, True, 1), "C": (0.6, False, 2), "D": (0.0, False, 0), "E": (0.0, False, 0)}


def test_excursions(spark):
    d = [dt.datetime(2024, 1, k) for k in (1, 2, 3)]
    bars = spark.createDataFrame([("A", d[0], 100.0, 104.0, 98.0), ("A", d[1], 101.0, 108.0, 97.0), ("A", d[2], 103.0, 112.0, 90.0)], "ticker string, session timestamp, open double, high double, low double")
    t = spark.createDataFrame([(1, "A", 100.0, 95.0, 110.0, "TARGET", d[0], d[2])], "trade_id int, ticker string, entry double, stop double, exit_price double, exit_reason string, entry_session timestamp, exit_session timestamp")
    r = outcomes.excursions(t, bars).first()
    assert (r.mfe_lower, r.mfe_upper, r.mae_lower, r.mae_upper, r.exit_day_unknown) == (2.0, 2.4, 0.6, 2.0, True)


def test_revisions_are_chosen_before_validity(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    feed = spark.createDataFrame([("A", t(1), t(30), t(1), "old"), ("A", t(1), t(5), t(3), "new"), ("B", t(2), t(30), t(20), "late")], "ticker string, effective_date timestamp, valid_until timestamp, known_at timestamp, state string")
    points = spark.createDataFrame([(1, "A", t(2), t(2)), (2, "A", t(4), t(4)), (3, "A", t(10), t(10)), (4, "B", t(10), t(10))], "point_id int, ticker string, asof timestamp, session timestamp")
    assert {r.point_id: r.state for r in bitemporal.valid_interval(points, feed).collect()} == {1: "old", 2: "new"}


def test_membership_is_half_open_and_rules_name_violations(spark):
    s = spark.createDataFrame([(dt.datetime(2024, 3, d),) for d in (1, 2, 3)], "session timestamp")
    m = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 2)), ("B", dt.datetime(2024, 3, 3), None)], "ticker string, start timestamp, end timestamp")
    assert sorted((r.session.day, r.ticker) for r in bitemporal.members_on(s, m).collect()) == [(1, "A"), (3, "B")]
    assert bitemporal.overlapping(m.unionByName(m.where("ticker = 'B'"))).count() == 1
    rows = spark.createDataFrame([(None, None, " ", "CLEAR"), (dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1), "x", "??")], "published_at timestamp, ingested_at timestamp, source string, state string")
    got = [r.violations for r in bitemporal.violations(rows, bitemporal.FEED_RULES | bitemporal.SURVEILLANCE_RULES).collect()]
    assert got == [["missing_time", "empty_source"], ["ingested_before_published", "unknown_state"]]


def test_coverage_gaps(spark):
    d = [dt.datetime(2024, 1, k) for k in range(1, 6)]
    sessions = spark.createDataFrame([(x,) for x in d], "session timestamp")
    gaps = spark.createDataFrame([(d[k], "A") for k in (0, 1, 3)], "session timestamp, entity string")
    assert sorted((r.start.day, r.end.day, r.audited_sessions) for r in coverage.gap_intervals(gaps, sessions, "entity").collect()) == [(1, 2, 2), (4, 4, 1)]


def test_journal_append(spark):
    old = spark.createDataFrame([("a", "1")], "event_id string, payload string")
    new = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("b", "3")], "event_id string, payload string")
    fresh, conflicts = journal.append(old, new)
    assert [tuple(r) for r in fresh.collect()] == [("b", "3")] and [tuple(r) for r in conflicts.collect()] == [("a", "1", "2")]


def test_selection_caps(spark):
    rows = spark.createDataFrame([(1, t, s, r, h) for t, s, r, h in [("A", "x", 0.1, True), ("B", "x", 0.9, False), ("C", "x", 0.8, False), ("D", "y", 0.7, False), ("E", "z", 0.6, False)]], "session int, ticker string, sector string, rank_score double, held boolean")
    pairs = spark.createDataFrame([("B", "D", 0.9, 50), ("A", "E", -0.2, 50)], "a string, b string, corr double, n long")
    assert sorted(r.ticker for r in selection.select_portfolio(rows, pairs, size=4, per_sector=2).collect()) == ["A", "B", "E"]


def test_vendor_candles_and_fill(spark):
    p = spark.createDataFrame([("A", '{"s":"ok","candles":[[1704085200,1,2,0.5,1.5,10]]}'), ("B", '{"s":"error"}'), ("C", "junk")], "ticker string, body string")
    bars, rejected = readers.vendor_candles(p)
    assert [(r.ticker, str(r.session), r.close) for r in bars.collect()] == [("A", "2024-01-01", 1.5)] and rejected.count() == 2
    assert sorted(r.ticker for r in readers.fill_missing(bars, bars.unionByName(bars.withColumn("ticker", F.lit("Z")))).collect()) == ["A", "Z"]


def test_streams(spark, tmp_path):
    ticks = spark.createDataFrame([("A", dt.datetime(2024, 1, 1, h), h, 10.0 + h, 1) for h in range(5)], "ticker string, ts timestamp, seq int, price double, qty int")
    ticks.write.parquet(f"{tmp_path}/ticks")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/ticks")
    done = streams.tick_bars(stream).writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert [(r.open, r.high, r.close, r.volume) for r in spark.table("bars_out").collect()] == [(10.0, 14.0, 14.0, 5)]
    write = streams.append_journal(f"{tmp_path}/journal")
    batch = spark.createDataFrame([("a", "1"), ("b", "2")], "event_id string, payload string")
    write(batch, 0)
    write(batch, 1)
    assert spark.read.parquet(f"{tmp_path}/journal").count() == 2


def test_leader_pullback_and_fill_size(spark, bars):
    bench = market.benchmark(bars)
    assert setups.leader_pullback(bars, bench, least_turnover=0.0, trend_bars=50).columns[0] == "session"
    plan = spark.createDataFrame([(9.0, 11.0, 8.0, 14.0)], "entry_min double, entry_max double, stop double, target double")
    assert [r[0] for r in plan.select(setups.fill_size(F.lit(10.0)), ).collect()] == [1250]
    assert [r[0] for r in plan.select(setups.fill_size(F.lit(12.0))).collect()] == [0]
