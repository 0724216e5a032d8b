"""Clock, book, leadership, sources and streams on small tables, against plain code."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from tidemark.operators import bitemporal, book, clock, leadership
from tidemark.sources import readers
from tidemark.streaming import streams


def test_fingerprint_counts_repeated_rows(spark):
    a, b = (spark.createDataFrame([(x,)] * 2, "x string") for x in ("A", "B"))
    digest = lambda df: tuple(readers.fingerprint(df).first())
    assert digest(a) != digest(b) and digest(a)[1] == 2
    assert digest(a.union(b)) == digest(b.union(a)) != digest(a.union(a))
    assert digest(a.limit(0)) == ("", 0)


POSITIONS = [("p1", "A", "LONG", "2024-01-01", 90.0, 110.0), ("p2", "B", "SHORT", "2024-01-01", 110.0, 90.0)]
BARS = [("A", "2024-01-02", 100.0, 112.0, 99.0), ("A", "2024-01-03", 100.0, 120.0, 80.0), ("B", "2024-01-02", 100.0, 105.0, 95.0), ("B", "2024-01-03", 120.0, 121.0, 100.0), ("B", "2024-01-04", 80.0, 125.0, 70.0)]
WANT = {("p1", "2024-01-02", "TARGET", 110.0), ("p2", "2024-01-03", "STOP", 120.0)}


def tables(spark):
    bars = spark.createDataFrame(BARS, "ticker string, session string, open double, high double, low double").withColumn("session", F.to_timestamp("session"))
    positions = spark.createDataFrame(POSITIONS, "position_id string, ticker string, direction string, opened string, stop double, target double").withColumn("opened", F.to_timestamp("opened"))
    return bars, positions


def test_a_position_exits_once(spark, tmp_path):
    bars, positions = tables(spark)
    found = lambda df: {(r.position_id, str(r.session.date()), r.reason, r.price) for r in df.collect()}
    assert found(streams.position_exits(bars, positions)) == WANT
    for k, row in enumerate(bars.orderBy("session").collect()):
        spark.createDataFrame([row], bars.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = streams.position_exits(source, positions).writeStream.format("memory").queryName("exits").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    rows = spark.table("exits")
    assert rows.count() == 2 and {r.position_id for r in rows.collect()} == {"p1", "p2"}


def limited(rows, capital, most_risk):
    """The same limits by a loop over one session."""
    rows = [dict(r) for r in rows]
    total = lambda: (sum(r["shares"] * r["entry"] for r in rows), sum(r["risk"] for r in rows))
    value, risk = total()
    if value > capital or risk > most_risk:
        scale = min(capital / value if value > capital else 1.0, most_risk / risk if risk > most_risk else 1.0)
        for r in rows:
            r["shares"] = max(int(r["shares"] * scale), 1 if r["held"] else 0)
            r["risk"] = round(r["shares"] * abs(r["entry"] - r["stop"]), 2)
        rows = [r for r in rows if r["shares"] > 0]
    while (total()[0] > capital or total()[1] > most_risk) and any(not r["held"] for r in rows):
        rows.remove(min((r for r in rows if not r["held"]), key=lambda r: (r["rank_score"], r["ticker"])))
    return {(r["ticker"], r["shares"], r["risk"]) for r in rows}


def test_limits_of_capital_and_risk(spark):
    rnd = random.Random(2)
    rows = [
        dict(session=s, ticker=f"t{k}", held=rnd.random() < 0.3, rank_score=float(rnd.randrange(4)), shares=rnd.randrange(1, 9), entry=float(rnd.choice([1, 40, 900])), stop=0.5, risk=0.0)
        for s in range(40) for k in range(rnd.randrange(1, 8))
    ]
    for r in rows:
        r["risk"] = round(r["shares"] * abs(r["entry"] - r["stop"]), 2)
    schema = "session int, ticker string, held boolean, rank_score double, shares long, entry double, stop double, risk double"
    got = book.within_limits(spark.createDataFrame([tuple(r.values()) for r in rows], schema), 2000.0, 900.0).collect()
    for s in range(40):
        assert {(r.ticker, r.shares, r.risk) for r in got if r.session == s} == limited([r for r in rows if r["session"] == s], 2000.0, 900.0), s


def test_clock_labels(spark):
    times = ["03:44", "03:45", "04:00", "04:04", "04:05", "04:45", "08:00", "09:00", "10:00", None]
    rows = spark.createDataFrame([(k, f"2024-05-06 {t}:30" if t else None) for k, t in enumerate(times)], "k int, t string").withColumn("ts", F.to_timestamp("t"))
    got = rows.orderBy("k").select(clock.market_phase(F.col("ts")), clock.regime_locked(F.col("ts")), clock.minutes_to_square_off(F.col("ts"))).collect()
    assert [r[0] for r in got] == ["PRE_MARKET", "OPENING_NOISE", "PRIME_MORNING", "PRIME_MORNING", "PRIME_MORNING", "MIDDAY_CHOP", "AFTERNOON_EXPANSION", "INTRADAY_FREEZE", "POST_MARKET", None]
    assert [r[1] for r in got] == [False, True, True, True, False, False, False, False, False, None]
    assert [r[2] for r in got][:3] == [360, 359, 344] and got[8][2] == 0


def test_members_as_of_and_snapshots(spark):
    rnd = random.Random(4)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    acts = [(f"t{rnd.randrange(4)}", rnd.choice(["ADD", "REMOVE"]), day(rnd.randrange(200)), day(rnd.randrange(200)), k) for k in range(40)]
    points = [(k, day(rnd.randrange(220)), day(rnd.randrange(220))) for k in range(30)]
    got = bitemporal.members_as_of(spark.createDataFrame(points, "point_id int, asof timestamp, session timestamp"), spark.createDataFrame([a[:4] for a in acts], "ticker string, action string, effective_date timestamp, known_at timestamp"))
    want = set()
    for p, asof, session in points:
        for t in {a[0] for a in acts}:
            seen = [(e, k, action) for x, action, e, k, _ in acts if x == t and k <= asof and e <= session]
            if seen and max(seen)[2] == "ADD":
                want.add((p, t))
    assert {tuple(r) for r in got.collect()} == want
    snaps = spark.createDataFrame([(1, "A"), (2, "A"), (2, "A"), (2, "B"), (4, "A"), (4, "B"), (5, "B")], "session int, ticker string")
    assert {tuple(r) for r in bitemporal.snapshot_intervals(snaps).collect()} == {("A", 1, 5), ("B", 2, None)}


def test_overrides_fractions_and_replaced_sets(spark):
    states = spark.createDataFrame([("RANGE", 0.4, False)], "regime string, confidence double, confirmed boolean")
    assert tuple(book.with_override(states, "panic").first()) == ("PANIC", 1.0, True)
    assert book.with_override(states, "nothing").first().regime == "RANGE" and book.with_override(states, None) is states
    curve = spark.createDataFrame([(1, 100.0, "RANGE"), (2, 90.0, "PANIC"), (3, 96.0, "TREND_UP"), (4, 120.0, "PANIC")], "session int, nav double, regime string")
    assert [r.fraction for r in book.capital_fraction(curve).orderBy("session").collect()] == pytest.approx([0.75, 0.0, 0.88, 1.0])
    now, new = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, note string"), spark.createDataFrame([("b", 5), ("c", 6)], "k string, n int")
    assert {tuple(r) for r in book.replaced(now, new, "k").collect()} == {("b", 5, "y"), ("c", 6, None)}


def test_sources_of_members_and_logs(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ticker,start,end\n abc ,2024-01-01,\nXYZ.NS,2024-01-01,2024-02-01\n")
    assert {r.ticker for r in readers.membership(spark, str(tmp_path / "m.csv")).collect()} == {"ABC.NS", "XYZ.NS"}
    events = [{"ts": "1", "event": "portfolio_built", "size": 2, "mean_prob_win": 0.6, "tickers": ["a", "b"]}, {"ts": "2", "event": "portfolio_built", "size": 0, "mean_prob_win": 0.9}, {"ts": "3", "event": "other", "size": 4, "mean_prob_win": 0.9}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, events)) + "\nnot json\n")
    assert [r.ts for r in readers.portfolio_events(spark, str(tmp_path / "log.jsonl")).collect()] == ["1"]


def test_trades_without_a_prior_snapshot_are_unknown(spark):
    trades = spark.createDataFrame([("A", 1)], "ticker string, entry_session int")
    facts = "ticker string, sector int, session int, rs_63_percentile double, rs_252_percentile double, sector_rs_63 double, distance_ema200 double, breadth_ema50 double, breadth_ema200 double, atr20_percentile double, atr20_expansion double"
    row = leadership.annotated(trades, spark.createDataFrame([], facts), spark.createDataFrame([(1,), (2,)], "session int")).first()
    assert (row.rs63_decile, row.sector_alignment, row.leadership_distance, row.breadth50_bucket) == ("UNKNOWN",) * 4
