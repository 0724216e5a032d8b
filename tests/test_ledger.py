"""Reconciliation, research packets, entry guards, cohorts and hedges on small tables."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark.operators import gates, outcomes, reconciliation, research
from tidemark.sources import readers

FILL = {"trade_id": "t", "ticker": "A", "strategy_id": "x", "signal_event_id": "s", "entry_price": 10, "stop_loss": 9, "shares": 5, "direction": "LONG", "entry_ts": "2024-01-02T04:00:00Z", "fees": 0, "slippage_inr": 0, "cost_basis": "MODELED"}
EXIT = {"trade_id": "t", "ticker": "a.ns", "strategy_id": "x", "signal_event_id": "s", "exit_price": 12, "costs": 1, "net_pnl": 9, "realised_r": 1.8, "exit_ts": "2024-01-02T05:00:00+00:00", "fees": 0.5, "slippage": 0.5, "cost_basis": "OBSERVED"}
SIGNAL = {"ticker": "a.ns", "strategy_version": "x", "signal_time": "2024-01-02", "selected": True, "watchlist": False, "entry_bound": [9, 11], "parameter_fingerprint": "p", "research_protocol": {"sha256": "h"}}


def reconcile(spark, rows):
    made = [(n, i, kind, at, p if p is None or isinstance(p, str) else json.dumps(p)) for n, i, kind, at, p in rows]
    events = spark.createDataFrame(made, "sequence long, event_id string, event_type string, recorded_at string, payload string")
    known = reconciliation.classify(events, reconciliation.cutoff(dt.date(2024, 1, 2)))
    trades = reconciliation.lifecycles(known)
    return known, trades, reconciliation.issues(known, trades)


def codes(found):
    return sorted((r.event_id, r.code) for r in found.collect())


def test_sound_trade_has_no_issue(spark):
    rows = [(1, "s", "SIGNAL", "2024-01-02T03:59:00Z", SIGNAL), (2, "f", "PAPER_FILL", "2024-01-02T04:01:00Z", FILL), (3, "x", "PAPER_EXIT", "2024-01-02T05:01:00Z", EXIT), (4, "n", "SCAN", "2024-01-02T05:02:00Z", {"qualified_signals": 0, "selected": 0, "market_date": "2024-01-02"})]
    known, trades, found = reconcile(spark, rows)
    t = trades.collect()[0]
    assert (t.status, t.net_pnl, t.realised_r, t.valid_signal_link, t.signal_precedes_entry, t.within_entry_bounds) == ("CLOSED", 9.0, 1.8, True, True, True)
    assert codes(found) == []
    got = {(r.measure, r.label): r.n for r in reconciliation.summary(known, trades, found, dt.date(2024, 1, 2)).collect()}
    assert got == {("daily_event", k): 1 for k in ("SIGNAL", "PAPER_FILL", "PAPER_EXIT", "SCAN")} | {("trade", "CLOSED"): 1, ("signal", "LINKED_FILL"): 1}


def test_standing_of_events(spark):
    at = "2024-01-02T05:00:00Z"
    rows = [
        (1, "a", "NOTE", "2024-01-02T05:00:00", {}), (2, "b", "NOTE", at, "[1]"), (3, "c", "NOTE", at, "not json"), (4, "d", "NOTE", at, None), (None, "e", "NOTE", at, {}), (6, None, "NOTE", at, {}), (7, "g", "NOTE", at, {}), (8, "g", "NOTE", at, {}),
        (9, "i", "NOTE", at, {"source": "executed"}), (10, "j", "REPLAY", at, {}), (11, "k", "NOTE", "2024-01-02T18:30:00Z", {}), (12, "l", "NOTE", None, {}), (13, "m", None, at, {}),
    ]
    known, _, found = reconcile(spark, rows)
    bad = "INVALID_EVENT_PAYLOAD"
    assert codes(found.na.fill({"event_id": "-"})) == [
        ("-", "DUPLICATE_OR_INVALID_EVENT_ID"), ("a", "UNASSIGNED_JOURNAL_TIME"), ("b", bad), ("c", bad), ("d", bad), ("e", "INVALID_SEQUENCE"), ("g", "DUPLICATE_OR_INVALID_EVENT_ID"), ("g", "UNSUPPORTED_EVENT_TYPE"),
        ("i", "NON_PAPER_EVENT_EXCLUDED"), ("j", "NON_PAPER_EVENT_EXCLUDED"), ("l", "UNASSIGNED_JOURNAL_TIME"), ("m", "UNSUPPORTED_EVENT_TYPE"),
    ]
    assert known.where("event_id = 'k'").first().standing == "LATER" and reconcile(spark, [])[2].count() == 0


def test_broken_trades(spark):
    at = "2024-01-02T04:01:00Z"
    odd = FILL | {"trade_id": "u", "signal_event_id": "none", "fees": "5", "slippage_inr": None, "cost_basis": "?", "entry_ts": "2024-01-02T04:00:00"}
    bare = {"trade_id": "v", "signal_event_id": None, "entry_ts": "2024-01-02T03:00:00Z", "fees": 0, "slippage": 0, "cost_basis": "MODELED"}
    rows = [
        (5, "s", "SIGNAL", "2024-01-02T04:30:00Z", SIGNAL | {"selected": False, "watchlist": True, "signal_time": "x"}), (2, "f", "PAPER_FILL", at, FILL | {"entry_price": 20}), (3, "g", "PAPER_FILL", at, odd), (4, "h", "PAPER_FILL", at, bare),
        (1, "x", "PAPER_EXIT", at, EXIT | {"exit_ts": "2024-01-02T03:59:00Z", "costs": 0.5, "signal_event_id": "q", "shares": 1}), (6, "y", "PAPER_EXIT", at, EXIT | {"trade_id": "w", "costs": None}), (7, "m", "PAPER_FILL", at, FILL | {"trade_id": "z", "signal_event_id": "s"}),
        (8, "n", "PAPER_FILL", at, FILL | {"trade_id": None}),
    ]
    found = {}
    for event, code in codes(reconcile(spark, rows)[2]):
        found.setdefault(event, set()).add(code)
    assert found["f"] == {"SIGNAL_RECORDED_AFTER_FILL", "SIGNAL_OBSERVED_AFTER_ENTRY", "FILL_FROM_UNSELECTED_SIGNAL", "FILL_FROM_WATCHLIST_SIGNAL", "ENTRY_OUTSIDE_BOUNDS"}
    assert found["g"] == {"SIGNAL_LINK_NOT_FOUND", "INVALID_ENTRY_FEES", "MISSING_ENTRY_SLIPPAGE", "UNKNOWN_ENTRY_COST_BASIS", "INVALID_ENTRY_TIME", "ENTRY_BOUNDS_UNAVAILABLE"}
    assert found["h"] == {"UNLINKED_FILL", "ENTRY_BOUNDS_UNAVAILABLE", "DELAYED_ENTRY_RECORDING"}
    assert {"EXIT_RECORDED_BEFORE_FILL", "EXIT_BEFORE_ENTRY", "COST_COMPONENTS_EXCEED_TOTAL", "EXIT_LINK_MISMATCH", "NET_PNL_MISMATCH_OR_UNAVAILABLE", "REALISED_R_MISMATCH_OR_UNAVAILABLE"} == found["x"]
    assert found["y"] == {"EXIT_WITHOUT_UNIQUE_FILL", "MISSING_OR_INVALID_ROUND_TRIP_COSTS", "FUTURE_DATED_EXIT"}
    assert found["n"] == {"MISSING_TRADE_ID"} and {"SIGNAL_LINKED_TO_MULTIPLE_TRADES", "SIGNAL_MARKET_DATE_UNAVAILABLE"} <= found["s"]


def test_packets_and_quotes(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    docs = spark.createDataFrame([("A", "financials", day(2), 1, "profit rose"), ("A", "sector_tailwinds", day(4), 2, " "), ("A", "financials", day(5), 3, "x")], "ticker string, topic string, ingested_at timestamp, doc int, text string")
    asked = spark.createDataFrame([("A", day(1)), ("A", day(3)), ("A", day(9)), ("B", day(9))], "ticker string, observed_at timestamp")
    got = {(r.ticker, r.observed_at.day): r.missing_topics for r in research.missing_topics(asked, docs).collect()}
    assert got["A", 1] == got["B", 9] == list(research.TOPICS) and got["A", 3] == got["A", 9] == list(research.TOPICS[1:])
    assert sorted((r.observed_at.day, r.doc, r.source_id) for r in research.packet_sources(asked, docs, "doc").collect()) == [(3, 1, "S1"), (9, 1, "S1"), (9, 3, "S2")]
    claims = spark.createDataFrame([("p", "S1", "c", "rose"), ("p", "S1", "c", "fell"), ("p", "S2", "c", "rose"), ("p", "S1", " ", "rose"), ("p", None, "c", "rose")], "packet_id string, source_id string, claim string, quote string")
    sources = spark.createDataFrame([("p", "S1", "profit rose")], "packet_id string, source_id string, text string")
    assert sorted(r.verdict for r in research.check_quotes(claims, sources).collect()) == ["ABSENT_SOURCE", "FABRICATED_QUOTE", "MALFORMED", "MALFORMED", "SUPPORTED"]


def test_entry_guard(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    points = spark.createDataFrame([("1", "A", day(5), "x"), ("2", "B", day(5), "x"), ("3", "C", day(5), "x"), ("4", "D", day(5), "x")], "point_id string, ticker string, session timestamp, sector string")
    feed = lambda rows, name: spark.createDataFrame([(t, day(1), day(20), day(k), v) for t, k, v in rows], f"ticker string, effective_date timestamp, valid_until timestamp, known_at timestamp, {name} string")
    got = gates.entry_guard(points, feed([("A", 2, "CLEAR"), ("B", 2, "ASM"), ("C", 6, "CLEAR"), ("D", 2, "CLEAR")], "state"), feed([("A", 2, "x"), ("D", 2, "y")], "sector_index"))
    assert {r.point_id: r.reason for r in got.collect()} == {"1": None, "2": "entry_surveillance_asm", "3": "entry_surveillance_unavailable", "4": "entry_sector_mapping_changed_or_unavailable"}


def test_cohort_buckets_fold_days(spark):
    rng = random.Random(1)
    rows = [(f"{k:03d}", rng.choice([-1.0, -0.5, 0.5, 1.5]), dt.datetime(2024, 1, 1 + k // 9, k % 9), rng.choice(["a", "b", None])) for k in range(120)]
    df = spark.createDataFrame(rows, "trade_id string, net_r double, exit_session timestamp, f string")
    got = {r.label: r for r in outcomes.cohort_buckets(df, {"f": ["a", "c"]}).collect()}
    for label in ("a", "b", None):
        run = pd.Series([0.0] + [r[1] for r in rows if r[3] == label]).cumsum()
        assert got[label or "UNKNOWN"].worst_fall == pytest.approx((run - run.cummax()).min()) and got[label or "UNKNOWN"].trades == len(run) - 1
    assert (got["c"].trades, got["c"].mean_r) == (0, None)
    assert [r[0] for r in spark.createDataFrame([(0.0,), (19.9,), (20.0,), (100.0,), (None,)], "v double").select(outcomes.bucket(F.col("v"), 20)).collect()] == ["00-020", "00-020", "20-040", "80-100", None]


def test_hedge_against_pandas(spark):
    rng = random.Random(2)
    n, nav, bench = 40, [1.0], [100.0]
    for _ in range(n - 1):
        m = rng.gauss(0, 0.02)
        nav.append(nav[-1] * (1 + 0.8 * m + rng.gauss(0, 0.01)))
        bench.append(bench[-1] * (1 + m))
    days = pd.date_range("2024-01-01", periods=n)
    equity, market = pd.Series(nav, days), pd.Series(bench, days)
    r, m = equity / equity.shift(1, fill_value=1.0) - 1, market.pct_change().fillna(0.0)
    beta = (r.rolling(10).cov(m) / m.rolling(10).var()).shift(1).clip(0, 1.5).fillna(0.0)
    want = (1 + r - beta * m - beta.diff().abs().fillna(beta) * 0.0005 - beta * 0.0005 / 21).cumprod()
    got = outcomes.hedge(spark.createDataFrame([(d.to_pydatetime(), v) for d, v in zip(days, nav)], "session timestamp, nav double"), spark.createDataFrame([(d.to_pydatetime(), v) for d, v in zip(days, bench)], "session timestamp, bench double"), window=10)
    assert [x.hedged for x in got.orderBy("session").collect()] == pytest.approx(list(want), rel=1e-9)


def test_long_bars(spark):
    wide = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, 2.0, None), (dt.date(2024, 1, 2), 3.0, None, None)], "session date, `Close|A` double, `Open|A` double, `Close|B.NS` double")
    assert sorted((r.ticker, r.session.day, r.close, r.open) for r in readers.long_bars(wide).collect()) == [("A", 1, 1.0, 2.0), ("A", 2, 3.0, None)]
