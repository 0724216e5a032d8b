"""As-of lookups, schedules, grids and plug points on small tables, against plain code."""

import datetime as dt
import json
import math
import random
from fractions import Fraction

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts, bitemporal, book, coverage, evaluation, factors, gates, grid, indicators, market, outcomes, plugs, research, scan, schedules, setups, sizing
from tidemark.plans import studies
from tidemark.plans.registry import ORACLE_SQL
from tidemark.sources import manifests, readers, sinks
from tidemark.streaming import streams

from .test_operators import walk

DAY = dt.timedelta(days=1)
START = dt.datetime(2019, 11, 1)


def revisions(seed, tickers, n, dates):
    rnd = random.Random(seed)
    rows = []
    for t in tickers:
        for k in range(n):
            valid = START + DAY * 30 * rnd.randrange(dates)
            rows.append((t, valid, valid + DAY * rnd.randrange(20, 400), valid + DAY * rnd.randrange(-20, 500), k, f"{t}{k}"))
    return rows


FEED = "ticker string, effective_date timestamp, valid_until timestamp, known_at timestamp, tie long, state string"
POINTS = "point_id long, ticker string, asof timestamp, session timestamp"


def test_merge_equals_a_search_of_all_revisions(spark):
    feed = revisions(1, ["A", "B", "C"], 300, 24) + [("A", None, None, START, 1, "no date"), (None, START, START, START, 1, "no ticker")]
    rnd = random.Random(2)
    points = [(k, rnd.choice(["A", "B", "D"]), a := START + DAY * rnd.randrange(-40, 1200), a - DAY * rnd.randrange(-30, 300)) for k in range(400)]
    points += [(400, "A", None, START), (401, None, START, START), *points[:5]]
    f, p = spark.createDataFrame(feed, FEED), spark.createDataFrame(points, POINTS)
    want_all, want_last, want_valid = [], [], []
    for i, t, asof, session in points:
        known = [r for r in feed if r[0] == t and t and r[1] and asof and r[3] <= asof and r[1] <= session]
        newest = {}
        for r in sorted(known, key=lambda r: (r[3], r[4])):
            newest[r[1]] = r
        want_all += [(i, r[5]) for r in newest.values()]
        if newest:
            last = newest[max(newest)]
            want_last.append((i, last[5]))
            want_valid += [(i, last[5])] if last[2] >= session else []
    pairs = lambda df: sorted((r.point_id, r.state) for r in df.collect())
    assert pairs(bitemporal.latest_known(p, f, ["effective_date"], "effective_date", tie="tie")) == sorted(want_all)
    assert pairs(bitemporal.merged(p, f, "effective_date", tie="tie")) == sorted(want_last)
    assert pairs(bitemporal.valid_interval(p, f, tie="tie")) == sorted(want_valid)
    for empty in (bitemporal.merged(p.limit(0), f, "effective_date"), bitemporal.merged(p, f.limit(0), "effective_date")):
        assert empty.count() == 0


def test_many_revisions_of_a_ticker_give_one_row_a_point(spark):
    """10,000 revisions over 40 dates and 3,000 points: no join by ticker, and as many rows as points out of the merge."""
    feed = spark.createDataFrame(revisions(3, ["A"], 10_000, 40), FEED)
    points = spark.range(3000).select(F.col("id").alias("point_id"), F.lit("A").alias("ticker"), (F.lit(START) + F.make_dt_interval(F.lit(1300) + F.col("id") % 50)).alias("asof")).withColumn("session", F.col("asof"))
    found = bitemporal.merged(points, feed, "effective_date", tie="tie")
    assert found.count() == 3000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Join Inner, (ticker" not in plan  # with the one row of the last year


def test_index_history_takes_the_revision_of_its_time(spark):
    days = [START + DAY * k for k in range(6)]
    feed = [("X", d, 10.0 + k, d + DAY) for k, d in enumerate(days)] + [("X", days[1], 99.0, days[4]), ("Y", days[2], 5.0, days[2])]
    points = [(1, "X", days[3], days[2]), (2, "X", days[5], days[3]), (3, "Y", days[5], days[3])]
    rows = bitemporal.index_history(
        spark.createDataFrame(points, "point_id int, index string, asof timestamp, session timestamp"), spark.createDataFrame(feed, "index string, session timestamp, close double, known_at timestamp"),
        spark.createDataFrame([(d,) for d in days], "session timestamp"), 3,
    )
    got = {(r.point_id, r.session): r.close for r in rows.collect()}
    assert got == {(1, days[0]): 10.0, (1, days[1]): 11.0, (1, days[2]): 12.0, (2, days[1]): 99.0, (2, days[2]): 12.0, (2, days[3]): 13.0, (3, days[1]): None, (3, days[2]): 5.0, (3, days[3]): None}


# ---- schedules

ROWS = "ticker string, ord int, session timestamp, open double, low double, close double, mean_5 double, atr double, next_open double, next_session timestamp, liquid boolean, strong_market boolean"


def schedule_rows(seed, tickers=("A", "B"), n=120):
    rnd, out = random.Random(seed), []
    for t in tickers:
        closes, price = [], 100.0
        for _ in range(n):
            price = round(price * (1 + rnd.gauss(0, 0.02)), 2)
            closes.append(price)
        opens = [100.0] + [round(c * (1 + rnd.gauss(0, 0.03)), 2) for c in closes[:-1]]
        for k in range(n):
            mean = sum(closes[k - 4 : k + 1]) / 5 if k >= 4 else None
            more = (opens[k + 1], START + DAY * 7 * (k + 1)) if k + 1 < n else (None, None)
            out.append((t, k + 1, START + DAY * 7 * k, opens[k], round(min(opens[k], closes[k]) * 0.99, 2), closes[k], mean, rnd.choice([None, 0.5, 1.0, 40.0]) if k % 9 == 0 else 1.0, *more, rnd.random() < 0.9, rnd.random() < 0.5))
    return out


def plain_schedule(signals, rows):
    """One trade after the other, day by day."""
    bars = {(r[0], r[1]): r for r in rows}
    taken = []
    for setup in sorted({s[0] for s in signals}):
        for ticker in sorted({r[0] for r in rows}):
            busy = 0
            for _, _, k, hold, mean_exit, _ in sorted(s for s in signals if s[0] == setup and s[1] == ticker):
                r = bars[ticker, k]
                if k <= busy or (ticker, k + 1) not in bars or r[7] is None:
                    continue
                entry, stop = r[8], r[8] - 3 * r[7]
                if not entry > stop > 0:
                    continue
                for day in range(k + 1, k + hold + 1):
                    if (ticker, day) not in bars:
                        break
                    b, last, price, phase = bars[ticker, day], day, bars[ticker, day][5], "CLOSE"
                    if b[4] <= stop:
                        price, phase = min(stop, b[3]), "OPEN" if b[3] <= stop else "INTRADAY"
                        break
                    if mean_exit and b[6] is not None and b[5] > b[6]:
                        break
                busy = last
                taken.append((setup, ticker, bars[ticker, k][2], bars[ticker, last][2], entry, round(price, 6), phase))
    return sorted(taken)


def test_schedules_equal_a_walk_through_days(spark):
    rows, rnd = schedule_rows(4), random.Random(5)
    signals = sorted({(s, t, k) for s in ("X", "Y") for t in ("A", "B") for k in rnd.sample(range(1, 121), 40)})
    signals = [(s, t, k, 8 if s == "X" else 15, s == "X", float(k)) for s, t, k in signals]
    table = spark.createDataFrame(rows, ROWS)
    chosen = spark.createDataFrame(signals, "setup string, ticker string, ord int, holding int, mean_exit boolean, priority double").join(table.select("ticker", "ord", "session", "atr", "next_open", "next_session"), ["ticker", "ord"])
    got = schedules.schedule(chosen, table).collect()
    assert sorted((r.setup, r.ticker, r.signal_session, r.exit_session, r.entry, round(r.exit_price, 6), r.exit_phase) for r in got) == plain_schedule(signals, rows)
    assert {r.exit_phase for r in got} == {"OPEN", "INTRADAY", "CLOSE"}
    one = got[0]
    assert one.r == pytest.approx((one.exit_price - one.entry - (one.entry + one.exit_price) * 0.002) / (one.entry - one.stop))
    assert schedules.schedule(chosen.limit(0), table).count() == 0


def test_reports_find_their_bars(spark):
    rows, rnd = schedule_rows(6), random.Random(7)
    reports = [(rnd.choice("AB"), START + DAY * rnd.randrange(-10, 860) + dt.timedelta(hours=rnd.randrange(24)), rnd.choice([5.0, 12.0, 30.0, None, math.nan, math.inf])) for _ in range(200)]
    want = {}
    for t, at, surprise in sorted(reports, key=lambda r: r[1]):
        own = [r for r in rows if r[0] == t]
        before, after = [r for r in own if r[2].date() < at.date()], [r for r in own if r[2].date() > at.date()]
        if before and after and surprise is not None and 10 <= surprise < math.inf and after[0][10] and after[0][5] > before[-1][5]:
            for setup in ["PEAD", "PEAD_MKT"] if after[0][11] else ["PEAD"]:
                want[setup, t, after[0][1]] = surprise
    found = schedules.report_signals(spark.createDataFrame(rows, ROWS), spark.createDataFrame(reports, "ticker string, announced_at timestamp, surprise double"))
    assert {(r.setup, r.ticker, r.ord): r.priority for r in found.collect()} == want


def test_ranks_over_a_common_calendar(spark):
    closes = {"A": {0: 1.0, 1: 2.0, 2: 4.0, 3: 4.0}, "B": {0: 1.0, 1: 1.0, 3: 3.0}, "C": {1: 5.0, 2: 5.0, 3: 10.0}}
    bars = spark.createDataFrame([(t, START + DAY * k, v) for t, days in closes.items() for k, v in days.items()], "ticker string, session timestamp, close double")
    got = {(r.ticker, (r.session - START).days): r.rank for r in schedules.panel_ranks(bars, 1).collect()}
    # day 1: A +100 %, B 0; day 2: A +100 %, B kept 0, C 0; day 3: A 0, B +200 %, C +100 %
    assert got == {("A", 1): 1.0, ("B", 1): 0.5, ("A", 2): 1.0, ("B", 2): 0.5, ("C", 2): 0.5, ("A", 3): pytest.approx(1 / 3), ("B", 3): 1.0, ("C", 3): pytest.approx(2 / 3)}


# ---- grids


def test_a_grid_is_its_variants_one_by_one(spark):
    bars = spark.createDataFrame(walk(n=400, tickers=("A", "B", "C", "D"))).cache()
    found = indicators.add_indicators(bars).cache()
    together = {tuple(r) for r in setups.swing_variants(found, grid.GRID).collect()}
    apart = {tuple(r) for v in grid.GRID for r in setups.swing_variants(found, (v,)).collect()}
    assert together == apart and len(grid.GRID) == 11
    plain = {tuple(r) for r in setups.swing_setups(found).collect()}
    assert plain == {r[2:] for r in together if r[0] == "fixed_default"} and plain
    free, costly = (grid.replay(found, bars, grid.SLIPPAGE, preset=p).collect() for p in ("none", "delivery"))
    assert free and all(r.net_r == r.gross_r for r in free)
    by = {(r.variant, r.ticker, r.signal_ord): r for r in costly}
    for (v, t, k), r in by.items():
        share = 2 * (0.0008 * r.slippage + 0.0000355 * 1.18) + 0.00215
        assert r.net_r == pytest.approx(r.gross_r - r.entry * share / (r.entry - r.stop), abs=2e-4)
        assert r.net_r <= by["fixed_default", t, k].net_r
    assert len(setups.swing_setups(found, market.benchmark(bars)).columns) == 11


def test_means_of_a_grid_that_end_in_a_half_round_up_in_any_order(spark):
    rnd, groups = random.Random(5), {}
    for n in (8, 24, 40, 200):
        for k in range(50):
            units = [rnd.randrange(-10_000, 30_000) for _ in range(n - 1)]
            # the sum, in units of 0.0001, is such that the mean's seventh and last decimal is 5
            units.append(next(u for u in range(10_000, 10_000 + n) if (sum(units) + u) * 100 % n * 2 == n))
            groups[f"{n}-{k}"] = [u / 10_000 for u in units]
    means = {v: Fraction(sum(round(x * 10_000) for x in xs), 10_000 * len(xs)) for v, xs in groups.items()}
    half_up = {v: math.copysign(math.floor(abs(m) * 10**6 + Fraction(1, 2)) / 10**6, m) for v, m in means.items()}
    assert all((m * 10**6).denominator == 2 for m in means.values())
    rows = [(v, "BREAKOUT", x, x) for v, xs in groups.items() for x in xs]
    for parts in (1, 3, 7):
        rnd.shuffle(rows)
        trades = spark.createDataFrame(rows, "variant string, strategy string, gross_r double, net_r double").repartition(parts)
        got = grid.by_strategy(trades, F.lit("DEV")).withColumns({"gross": F.round("mean_gross_r", 6), "net": F.round("mean_net_r", 6)}).collect()
        assert {r.variant: r.mean_gross_r for r in got} == {v: float(m) for v, m in means.items()}
        assert {r.variant: r.gross for r in got} == {r.variant: r.net for r in got} == half_up


# ---- plug points


def test_plugs_are_checked_before_they_run(spark):
    rows = spark.createDataFrame([("A", START, "RANGE", "LONG", 10.0, 9.0)], "ticker string, session timestamp, regime string, direction string, entry double, stop double")
    gate = plugs.probability_gate(lambda: F.when(F.col("regime") == "RANGE", 0.6).otherwise(0.5))
    assert gate.apply(rows).first().least_probability == 0.6
    with pytest.raises(plugs.PlugError, match="needs regime string .is missing."):
        gate.apply(rows.drop("regime"))
    with pytest.raises(plugs.PlugError, match="ticker string .is int."):
        gate.apply(rows.withColumn("ticker", F.lit(1)))
    with pytest.raises(plugs.PlugError, match="drops"):
        plugs.Plug("lossy", "ticker string", "x int", lambda d: d.select("ticker", F.lit(1).alias("x"))).apply(rows)
    with pytest.raises(plugs.PlugError, match="gives entry double"):
        plugs.signal_provider(lambda d: d.select("ticker")).apply(rows.selectExpr("ticker", "session", "entry close", "stop atr"))
    with pytest.raises(plugs.PlugError, match="no DataFrame"):
        plugs.bar_provider(lambda d: None).apply(rows)
    guards = (plugs.entry_guard(lambda: F.when(F.col("entry") > 11, "DEAR")), plugs.entry_guard(lambda: F.when(F.col("stop") < 8, "WIDE")))
    more = rows.union(rows.withColumn("entry", F.lit(12.0))).union(rows.withColumn("stop", F.lit(7.0))).union(rows.withColumn("entry", F.lit(12.0)).withColumn("stop", F.lit(7.0)))
    accepted, refused = plugs.guarded(more, guards)
    assert accepted.count() == 1 and sorted(r.guard_reason for r in refused.collect()) == ["DEAR", "DEAR", "WIDE"]


def test_scans_take_plugs(spark):
    """Plugs that say what a scan does by itself change nothing; others change what they are for."""
    c = F.col
    bars = spark.createDataFrame(walk(n=260, tickers=tuple("ABCDEF"), seed=3)).withColumn("volume", F.col("volume") * 1e6)
    run = lambda **plugged: {(r.ticker, r.session): r for r in scan.score_universe(bars, 6, 1.0, 1.0, **plugged).select("ticker", "session", "composite", "probability", "shares", "tier").collect()}
    usual = run()
    own = {k: F.array(*map(F.lit, map(float, w))) for k, w in factors.REGIME_WEIGHTS.items()}

    def weights(rows):
        value = F.lit(None).cast("array<double>")
        for regime, w in own.items():
            value = F.when(c("regime") == regime, w).otherwise(value)
        return rows.withColumn("factor_weights", value)

    same = run(gate=plugs.probability_gate(lambda: gates.regime_threshold(c("regime"))), scaler=plugs.capital_scaler(lambda: F.lit(1.0)), weights=plugs.weight_provider(weights))
    assert usual and same == usual
    halved = run(gate=plugs.probability_gate(lambda: F.lit(2.0)), scaler=plugs.capital_scaler(lambda: F.lit(0.5)))
    assert {r.tier for r in halved.values()} <= {"WATCH"}
    assert all(r.shares <= usual[k].shares for k, r in halved.items() if k in usual) and any(r.shares < usual[k].shares for k, r in halved.items() if k in usual)


# ---- exports


def test_exports_are_chained_and_appends_read_no_history(spark, tmp_path):
    schema = "sequence long, event_id string, payload string"
    make = lambda n, change=None: spark.createDataFrame([(k, f"e{k}", change if change and k == 3 else None if k % 4 == 0 else "{}") for k in range(1, n + 1)], schema)
    path = str(tmp_path / "export")
    assert [sinks.append_export(make(n), path) for n in (4, 9, 9, 12)] == [4, 5, 0, 3]
    assert spark.read.schema(schema).json(path).count() == 12 and sinks.verify_export(make(12), path).count() == 0
    faults = lambda j: sorted((r.fault, r.key) for r in sinks.verify_export(j, path).collect())
    assert faults(make(12, "x")) == [("CHANGED", 3)] and faults(make(12).where("sequence <> 5")) == [("NOT_IN_JOURNAL", 5)]
    # a block left by an interrupted append is replaced
    make(20).where("sequence > 12").write.json(f"{path}/block=4")
    assert sinks.append_export(make(13), path) == 1 and spark.read.schema(schema).json(path).count() == 13
    # old data that can't be read doesn't disturb an append, but a check
    old = next((tmp_path / "export" / "block=1").glob("part-*"))
    lines = [f for f in (tmp_path / "export" / "block=1").glob("part-*") if f.stat().st_size]
    kept = [f.read_text() for f in lines]
    for crc in (tmp_path / "export" / "block=1").glob(".*.crc"):
        crc.unlink()
    for f in lines:
        f.write_text(f.read_text().replace("e2", "e9"))
    assert old is not None and sinks.append_export(make(15), path) == 2
    assert faults(make(15)) == [("BLOCK_CHANGED", None), ("CHANGED", 2)]
    for f, text in zip(lines, kept):
        f.write_text(text)
    assert faults(make(15)) == []
    with pytest.raises(ValueError):
        sinks.append_export(make(16).withColumn("payload", F.lit("x")), path)
    with pytest.raises(ValueError):
        sinks.append_export(make(10), path)
    assert sinks.append_export(make(0), str(tmp_path / "none")) == 0 and sinks.verify_export(make(3), str(tmp_path / "none")).count() == 0


# ---- streams


def test_late_bars_are_put_in_order(spark, tmp_path):
    """Bars that arrive shuffled, in five files, give what the batch gives; a bar behind the watermark is dropped."""
    source = walk(90, tickers=("A", "B", "C")).drop(columns=["sector"])
    rnd = random.Random(3)
    order = sorted(range(len(source)), key=lambda k: (source.session[k] - source.session[0]).days + rnd.random() * 25)
    parts = [order[k * 54 : (k + 1) * 54] for k in range(5)]
    bars = spark.createDataFrame(source)
    folder, ahead = str(tmp_path / "in"), source.session.max() + pd.Timedelta(days=400)
    read = lambda: streams.indicator_stream(spark.readStream.schema(bars.schema).parquet(folder), late="30 days")

    def run():
        read().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()

    for k, part in enumerate(parts):
        spark.createDataFrame(source.iloc[part]).coalesce(1).write.mode("append").parquet(folder)
        if k % 2 == 0:
            run()
    run()
    flush = pd.DataFrame({"ticker": ["A", "A"], "session": [ahead, source.session.min() - pd.Timedelta(days=1)], "open": 1.0, "close": 1.0, "volume": 1.0, "high": 1.0, "low": 1.0})
    spark.createDataFrame(flush)[bars.columns].coalesce(1).write.mode("append").parquet(folder)
    run()
    got = spark.read.parquet(str(tmp_path / "out")).where(F.col("session") < F.lit(ahead)).orderBy("ticker", "session").toPandas()
    want = indicators.add_indicators(bars, complete=False).orderBy("ticker", "session").toPandas()
    assert len(got) == len(want)
    for a, b in (("ema", "ema_20"), ("rsi", "rsi"), ("atr", "atr"), ("supertrend", "supertrend")):
        assert got[a].tolist() == pytest.approx(want[b].tolist(), nan_ok=True)
    assert got.super_up.tolist() == want.super_up.fillna(False).tolist()


def plain_alerts(rows, least, hours, top):
    out, sent = [], {}
    for channel in sorted({r[0] for r in rows}):
        for ts in sorted({r[1] for r in rows if r[0] == channel}):
            n = 0
            for _, _, key, _, p in sorted((r for r in rows if r[:2] == (channel, ts) and r[2]), key=lambda r: (r[3], r[2])):
                last = sent.get((channel, key))
                if p is not None and p >= least and n < top and (last is None or ts - last >= dt.timedelta(hours=hours)):
                    sent[channel, key] = ts
                    out.append((channel, ts, key, p))
                    n += 1
    return sorted(out)


ALERTS = "channel string, ts timestamp, key string, place double, probability double"


def test_alerts_remember_what_was_sent(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(c, START + dt.timedelta(hours=h), rnd.choice(["a", "b", "c", "d", None]), float(rnd.randrange(4)), rnd.choice([0.4, 0.55, 0.6, 0.9, None])) for c in "XY" for h in range(60) for _ in range(rnd.randrange(5))]
    table = spark.createDataFrame(rows, ALERTS)
    want = plain_alerts(rows, 0.55, 4, 2)
    batch = alerts.alerts(table, 0.55, 4, 2)
    assert sorted(map(tuple, batch.collect())) == want and len(want) > 40
    assert alerts.alerts(table.limit(0)).count() == 0
    folder = str(tmp_path / "in")
    for k in range(3):  # three triggers go on from the kept state
        table.where((F.col("ts") >= F.lit(START + dt.timedelta(hours=20 * k))) & (F.col("ts") < F.lit(START + dt.timedelta(hours=20 * (k + 1))))).coalesce(1).write.mode("append").parquet(folder)
        stream = streams.alert_stream(spark.readStream.schema(ALERTS).parquet(folder), 0.55, 4, 2)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


# ---- feeds and coming events


def test_a_folder_of_feeds(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"sector_universe": ["BANK"], "benchmark_index": "I", "vix_index": "V", "benchmark_ticker": "B"}))
    time = "2024-01-02T12:00:00+05:30,2024-01-02T13:00:00+05:30,src"
    (tmp_path / "indices.csv").write_text("index,session,close,published_at,ingested_at,source\n" + "\n".join([
        f"I,2024-01-02,10,{time}", f" I ,2024-01-02,11,{time}", f"V,2024-01-02,0,{time}", f"I,2024-01-03,9,{time}", f"I,2024-1-4,inf,{time}", "I,2024-01-01,7,2024-01-02T12:00:00,,src", f"W,2024-01-02,5,{time}",
    ]))
    (tmp_path / "fundamentals.csv").write_text(f"ticker,period_end,eps_growth,revenue_growth,guidance_raised,published_at,ingested_at\na.NS,2023-12-31,0.1,-0.2,TRUE,{time[:-4]}\n")
    found = manifests.load(spark, str(tmp_path))
    assert set(found.tables) == {"indices", "fundamentals"} and found.settings["benchmark_index"] == "I"
    good = found.tables["indices"].collect()
    assert [(r["index"], r.close, r.known_at) for r in good] == [("W", 5.0, dt.datetime(2024, 1, 2, 7, 30))]
    bad = {(r.kind, json.loads(r.row)["index"] if r.kind == "indices" else None, tuple(r.violations)) for r in found.quarantine.collect()}
    assert bad == {
        ("indices", "I", ("conflicting_revision",)), ("indices", "V", ("nonpositive_close",)), ("indices", "I", ("published_before_its_day",)), ("indices", "I", ("bad_day:session", "bad_number:close")),
        ("indices", "I", ("bad_instant:published_at", "missing:ingested_at")), ("fundamentals", None, ("missing:source",)),
    }
    (tmp_path / "manifest.json").write_text("{}")
    with pytest.raises(ValueError, match="sector_universe"):
        manifests.load(spark, str(tmp_path))


def test_next_events_follow_what_was_known(spark):
    days = [START + DAY * k for k in range(12)]
    events = [("A", "q1", days[5], days[0]), ("A", "q1", days[8], days[3]), ("A", "q2", days[9], days[1]), ("B", "q1", days[4] + dt.timedelta(hours=1), days[0])]
    points = [(1, "A", days[2], days[2]), (2, "A", days[3], days[4]), (3, "A", days[4], days[9]), (4, "A", days[4], days[10]), (5, "B", days[4], days[4]), (6, "A", days[2], days[5])]
    found = bitemporal.next_events(
        spark.createDataFrame(points, POINTS), spark.createDataFrame(events, "ticker string, event string, event_date timestamp, known_at timestamp"), spark.createDataFrame([(d,) for d in days], "session timestamp"), 5, "event"
    )
    # at 2 the report of q1 has moved to day 8; at 6 it is still on day 5
    assert {r.point_id: (r.sessions_to_event, r.event_date) for r in found.collect()} == {1: (3, days[5]), 2: (4, days[8]), 3: (0, days[9]), 6: (0, days[5])}


# ---- packets


def test_faulty_answers_are_set_aside(spark):
    candidates = spark.createDataFrame([(str(k), START + DAY * 10) for k in range(40)], "ticker string, observed_at timestamp")
    docs = [(str(k), t, START + DAY * d, 10 * k + d, f"{t} of {k} on day {d}") for k in range(1, 40) for t, d in (("financials", 1), ("financials", 5), ("financials", 30), ("sector_tailwinds", 2), ("quarterly_results", 20))]
    docs += [("1", "financials", START + DAY * 6, 1, "   "), ("1", "gossip", START, 2, "x")]
    packed = research.packets(candidates, spark.createDataFrame(docs, "ticker string, topic string, ingested_at timestamp, doc long, text string"), "doc")
    one = packed.where("ticker = '7'").first()
    assert [(s.source_id, s.topic, s.text) for s in one.sources] == [("S1", "financials", "financials of 7 on day 5"), ("S2", "sector_tailwinds", "sector_tailwinds of 7 on day 2")]
    assert one.missing_topics == ["quarterly_results", "promoter_holding", "institutional_holding", "management_commentary"]

    def generator(asked):
        out = []
        for p in asked:
            kind = int(p["ticker"]) % 6
            if kind == 1:
                raise KeyError("no")
            claim = {"text": "t", "source_id": "S2" if kind != 2 else "S9", "quote": "of " + p["ticker"] if kind != 3 else "of 1000"}
            brief = {"bull_thesis": [claim], "bear_thesis": [], "risk_factors": [], "catalysts": [] if kind != 4 else "none", "unknowns": []}
            out.append(brief if kind != 5 else {**brief, "orders": []})
        return out

    want = {0: [], 1: ["generator_failed:KeyError"], 2: ["absent_source:bull_thesis:0"], 3: ["fabricated_quote:bull_thesis:0"], 4: ["malformed_section:catalysts"], 5: ["malformed_brief"]}
    got = {int(r.ticker): r for r in research.briefs(packed, generator, batch=7).collect()}
    assert len(got) == 40 and got[0].status == research.NOTHING
    for k in range(1, 40):
        assert got[k].faults == want[k % 6] and got[k].status == (research.DRAFT if k % 6 == 0 else research.FAULTY) and (got[k].brief is not None) == (k % 6 == 0)
    silent = research.briefs(packed, lambda asked: asked[1:]).where("ticker = '6'").first()
    assert silent.faults == ["generator_failed:ValueError"]
    assert research.faults({"bull_thesis": [{"text": " ", "source_id": "S1", "quote": "x"}], "bear_thesis": [], "risk_factors": [], "catalysts": [], "unknowns": [1]}, []) == ["malformed_unknowns", "malformed_claim:bull_thesis:0"]


def test_evidence_reports_keep_what_was_not_seen(spark):
    trades = [(str(k), START + DAY * 20 * k, float(k % 5 - 2), k % 7, "UP" if k % 2 else "DOWN") for k in range(30)]
    curve = [(START + DAY * k, 0.01 * (k % 3 - 1) + 0.001, 0.002 * (k % 2), 0.5, 0.4, 0.001 * (k % 2)) for k in range(50)]
    report = outcomes.evidence_report(
        spark.createDataFrame(trades, "trade_id string, entry_session timestamp, net_r double, bars_held int, trend string"),
        spark.createDataFrame(curve, "session timestamp, daily_return double, benchmark_return double, exposure_open double, exposure_close double, matched_return double"), ["trend"], {"trend": ["UP", "DOWN", "FLAT"]}, draws=300,
    )
    got = {(r.section, r.label, r.measure): r.value for r in report.collect()}
    rs = [t[2] for t in trades]
    assert got["trades", None, "mean_r"] == pytest.approx(sum(rs) / 30) and got["trades", "UP", "mean_r"] == pytest.approx(sum(rs[1::2]) / 15)
    assert {k[2]: v for k, v in got.items() if k[1] == "FLAT"} == {"trades": 0.0}
    nav = [1.0]
    for row in curve:
        nav.append(nav[-1] * (1 + row[1]))
    assert got["portfolio", None, "max_drawdown"] == pytest.approx(min(v / max(nav[: k + 1]) - 1 for k, v in enumerate(nav)))
    assert got["portfolio", None, "return_per_exposure"] == pytest.approx((nav[-1] - 1) / 0.5)
    assert got["interval", None, "low"] <= sum(rs) / 30 <= got["interval", None, "high"]
    lost = spark.createDataFrame([(START, -1.0, 0.0), (START + DAY, 0.5, 0.1)], "session timestamp, daily_return double, benchmark_return double")
    assert outcomes.portfolio_statistics(lost).first().total_return == -1.0


def test_evidence_report_without_a_hit_equals_its_sql(spark, tmp_path):
    for name in ("nation", "supplier", "lineitem"):
        table = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "lineitem":  # moves so small that no trade reaches its target
            table = table.withColumn("l_discount", F.lit(0.05) + F.when(F.col("l_orderkey") % 50 == 0, 0.01).otherwise(0.0))
        table.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in ("nation", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = {r[1:3]: r[4] for r in con.execute(ORACLE_SQL["evidence_report"]).fetchall() if r[0] == r[3] == "trades"}
    got = {(r.field, r.label): r.value for r in studies.evidence_report(spark, str(tmp_path)).where("section = 'trades' and measure = 'trades'").collect()}
    assert got == want and ("hit", "true") not in got and got["direction", "FLAT"] == 0.0


# ---- what no query calls


def test_small_lookups(spark, tmp_path):
    c = F.col
    rows = spark.createDataFrame([("A", 1, 1.0, None), ("A", 2, None, 2.0), ("A", 3, float("nan"), 5.0), ("B", 1, None, 1.0)], "ticker string, session int, x double, y double")
    assert [r[0] for r in rows.select(sizing.quality_reason(("x", "y"))).collect()] == ["y", "x", "x", "x"]
    kept = rows.withColumn("x", F.nanvl("x", F.lit(None))).withColumn("last", bitemporal.carried(rows, "y", "ticker")).orderBy("ticker", "session")
    assert [r.last for r in kept.collect()] == [None, 2.0, 5.0, 1.0]
    assert {(r.ticker, r.session) for r in coverage.missing(rows, rows.where("y > 1"), "ticker", "session").collect()} == {("A", 1), ("B", 1)}
    scan = spark.createDataFrame([(1, 0.6, 0.2), (1, 0.4, 0.9), (2, 0.1, 0.3)], "session int, probability double, expectancy double")
    assert {tuple(r) for r in book.scan_metrics(scan, 0.5).collect()} == {(1, 2, 1, 0.5, 0.6, 0.2), (2, 1, 0, 0.0, 0.0, 0.0)}
    asked = spark.createDataFrame([("SHORT", 100.0, 90.0, False), ("LONG", 100.0, 99.9, False), ("LONG", 100.0, 50.0, None)], "side string, entry double, stop double, reverts boolean")
    near = gates.display_horizon(c("side"), c("entry"), c("stop"), c("reverts"), intraday=True)
    assert [r[0] for r in asked.select(near).collect()] == ["INTRADAY", "INTRADAY", "SWING"]
    assert [r[0] for r in asked.select(gates.display_horizon(c("side"), c("entry"), c("stop"), c("reverts"))).collect()] == ["SWING"] * 3
    journal = spark.createDataFrame([(k,) for k in (5, 1, 3, 2, 4)], "sequence long")
    assert [r.sequence for r in readers.journal_page(journal, 2, 2).collect()] == [3, 4]
    for name, text in (("a", '{"end": "2024-01-02", "status": "OK"}'), ("b", '{"end": "2024-03-01", "status": "LATE"}'), ("c", "{broken")):
        (tmp_path / f"{name}.json").write_text(text)
    last = readers.latest_report(spark, str(tmp_path)).first()
    assert (last.latest.end, last.latest.status, last.unreadable) == ("2024-03-01", "LATE", 1)
    ticks = spark.createDataFrame([("A", START + dt.timedelta(minutes=m)) for m in (0, 10, 35, 80, 90)], "ticker string, ts timestamp")
    assert sorted(r.ticks for r in streams.activity_sessions(ticks).collect()) == [2, 3]


def test_weekdays_without_trades_count(spark):
    rows = [("x", START + DAY * k, p) for k, p in ((0, 100.0), (0, 20.0), (3, -50.0), (8, 10.0))] + [("y", START, 5.0)]  # START is a Friday
    pnl = spark.createDataFrame(rows, "fold string, session timestamp, pnl double")
    daily = [120.0, -50.0, 0.0, 0.0, 0.0, 0.0, 10.0]  # Friday, Monday to Friday, and a Saturday with a result
    mean, spread = sum(daily) / 7 / 1000, (sum((d - sum(daily) / 7) ** 2 for d in daily) / 7) ** 0.5 / 1000
    got = {r.fold: r for r in evaluation.sharpe(pnl, 1000.0, "fold").collect()}
    assert got["x"].days == 7 and got["x"].sharpe == round(mean / spread * 252**0.5, 3) and got["x"].total_pnl == 80.0
    assert (got["y"].days, got["y"].sharpe) == (1, 0.0)


def test_regimes_in_a_stream(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(m, START + DAY * k, rnd.choice([0.1, 0.3, 0.5, 0.7]), rnd.choice([10.0, 20.0, 30.0]), rnd.choice([1.0, 1.5])) for m in "AB" for k in range(60)]
    table = spark.createDataFrame(rows, "market string, session timestamp, breadth double, adx_median double, atr_ratio double")
    folder = str(tmp_path / "in")
    for k in range(2):
        table.where((F.col("session") >= F.lit(START + DAY * 30 * k)) & (F.col("session") < F.lit(START + DAY * 30 * (k + 1)))).coalesce(1).write.mode("append").parquet(folder)
        streams.regime_stream(spark.readStream.schema(table.schema).parquet(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {(r.market, r.session): (r.regime, r.confirmed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for m in "AB":
        want = market.regimes(table.where(F.col("market") == m).drop("market")).collect()
        assert {s: v for (k, s), v in got.items() if k == m} == {r.session: (r.regime, r.confirmed) for r in want}
