"""Whole scans, resampling, calibration, the signal journal and labels, against SQL, plain code and on odd input."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, journal, labels, stress
from tidemark.plans import desk
from tidemark.plans.registry import ORACLE_SQL, QUERIES
from tidemark.sources import readers

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return str(value)
    return format(float(value), ".9g") if hasattr(value, "__float__") else str(value)


@pytest.mark.parametrize("name", ["scored_universe", "circular_bootstrap", "calibration_set", "probability_check", "signal_journal", "portfolio_log", "evidence_labels", "ordered_unique"])
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table in ("nation", "supplier", "lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in QUERIES[name](spark, SF).collect())
    assert got == want


def trades(spark, values):
    rows = [(i, f"2024-01-{1 + i // 3:02d}", r) for i, r in enumerate(values)]
    return spark.createDataFrame(rows, "trade_id int, day string, net_r double").select("trade_id", F.to_timestamp("day").alias("exit_session"), "net_r")


def test_bootstrap_equals_a_plain_loop(spark):
    values, sims, block = [1.0, -2.0, 0.5, -60.0, 3.0, -1.0, 2.5], 40, 3
    n, ends = len(values), []
    for sim in range(sims):
        wealth = [1.0]
        for step in range(n):
            start = int(hashlib.md5(f"7:{sim}:{step // block}".encode()).hexdigest()[:8], 16) % n
            wealth.append(wealth[-1] * max(1e-300, 1 + 0.01 * values[(start + step % block) % n]))
        wealth = np.array(wealth)
        ends.append((wealth[-1], (1 - wealth / np.maximum.accumulate(wealth)).max(), wealth.min() <= 0.5))
    final, fall, ruined = map(np.array, zip(*ends))
    row = stress.circular_bootstrap(trades(spark, values), sims, block).first()
    assert row.trades == n and row.ruin_share == pytest.approx(ruined.mean())
    assert row.worst_drawdown == pytest.approx(fall.max()) and row.drawdown_p95 == pytest.approx(np.quantile(fall, 0.95))
    assert row.loss_var95 == pytest.approx(np.quantile(1 - final, 0.95)) and row.final_median == pytest.approx(np.median(final))


def test_bootstrap_of_few_and_no_trades(spark):
    one = stress.circular_bootstrap(trades(spark, [2.0]), 5, 4).first()
    assert one.trades == 1 and one.final_median == pytest.approx(1.02) and one.worst_drawdown == 0
    lost = stress.circular_bootstrap(trades(spark, [-200.0, -200.0]), 5).first()
    assert lost.ruin_share == 1 and lost.worst_drawdown == pytest.approx(1)
    none = stress.circular_bootstrap(trades(spark, [1.0]).where("false"), 5).first()
    assert none.trades == 0 and all(v is None for k, v in none.asDict().items() if k != "trades")


def test_held_out_and_fit(spark):
    rows = spark.range(200).select(F.col("id"), ((F.col("id") * 37 % 100) / 100.0).alias("composite"))
    rows = rows.withColumn("win", (F.col("composite") + (F.col("id") % 10) / 20.0 > 0.7).cast("int"))
    held = evaluation.held_out(rows, 60, "id")
    assert sorted(r.id for r in held.where("held").collect()) == list(range(140, 200))
    assert held.count() == 200 and evaluation.held_out(rows, 0, "id").where("held").count() == 0
    a, b, check = evaluation.fit_held_out(rows, "id")
    row = check.first()
    assert a < 0 and row.n == 60 and row.brier < 0.15 and row.error == pytest.approx(row.mean_predicted - row.actual)
    with pytest.raises(ValueError):
        evaluation.fit_held_out(rows.limit(79), "id")
    assert evaluation.probability_check(rows.where("false"), a, b).first().asDict() == {"n": 0, "brier": None, "mean_predicted": None, "actual": None, "error": None}


def test_calibration_set_needs_enough_rows(spark):
    rows = spark.createDataFrame([(1, None, 1.0, None, 0.5), (2, "PAPER", 1.0, 0.4, 0.5), (3, "EXECUTED", None, 0.4, 0.5), (4, "EXECUTED", -1.0, 0.4, None)], "trade_id int, source string, pnl double, composite double, trend double")
    assert sorted(map(tuple, evaluation.calibration_set(rows, {"trend": 0.5}, least=2).collect())) == [(1, 0.25, 1), (4, 0.4, 0)]
    assert evaluation.calibration_set(rows, {"trend": 0.5}, least=3).count() == 0


def test_journal_keeps_first_observations_and_empty_scans(spark):
    scans = spark.createDataFrame([("a", "2024-01-01", "2024-01-01 10:00:00"), ("b", "2024-01-02", "2024-01-02 10:00:00")], "scan_id string, d string, t string")
    scans = scans.select("scan_id", F.to_date("d").alias("market_date"), F.to_timestamp("t").alias("recorded_at"))
    results = spark.createDataFrame([("a", 2, "X", "SWING_A", False, True), ("a", 1, "X", "SWING_A", False, False), ("a", 3, "Y", "SWING_A", True, True), ("a", 4, "Z", "LEGACY", False, True)],
                                    "scan_id string, place int, ticker string, strategy_id string, held boolean, selected boolean").withColumn("signal_time", F.lit("2024-01-01").cast("timestamp"))
    rows = journal.build(scans, results, "f").collect()
    signals = [r for r in rows if r.event_type == "SIGNAL"]
    assert len(rows) == 3 and len(signals) == 1 and '"selected":false' in signals[0].payload
    assert sorted(r.payload for r in rows if r.event_type == "SCAN") == ['{"market_date":"2024-01-01","qualified_signals":4,"selected":3}', '{"market_date":"2024-01-02","qualified_signals":0,"selected":0}']


def test_labels_of_odd_values(spark):
    rows = spark.createDataFrame([("CALIBRATED", 0.5, "2024-01-01T00:00:00Z"), (None, 0.123, "2024-01-01T00:20:00+00:00"), ("UNUSED", 0.5, "2024-01-01T00:00:00"), ("OTHER", math.nan, None), ("X", 1.5, "badZ")], "status string, value double, at string")
    shown, age = labels.probability_evidence(F.col("status"), F.col("value")), labels.snapshot_freshness(F.col("at"), F.lit("2024-01-01T00:16:00Z").cast("timestamp"))
    got = [tuple(r) for r in rows.select(shown["text"], shown["tone"], age["state"], age["minutes"]).collect()]
    assert got == [("50%", "cyan", "stale", 16), ("0.12", "amber", "future", None), ("Unavailable", "muted", "unknown", None), ("Unavailable", "muted", "unknown", None), ("Unavailable", "muted", "unknown", None)]
    firsts = labels.ordered_unique(spark.createDataFrame([("a", 2), (None, 1), ("a", 1)], "k string, p int"), "k", "p")
    assert sorted((r.k or "", r.p) for r in firsts.collect()) == [("", 1), ("a", 1)]


def test_logs_and_memberships(spark, tmp_path):
    lines = ['{"event": "portfolio_built", "ts": "1", "size": 2, "mean_prob_win": 0.6, "tickers": ["A", "B"]}', '{"event": "portfolio_built", "ts": "2", "size": 0, "mean_prob_win": 0.9}', "not json", "", "[1]", '{"event": "portfolio_built"}']
    assert [r.ts for r in readers.portfolio_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()] == ["1"]
    (tmp_path / "members.csv").write_text("ticker,start,end\nABC,2024-01-01,\nXYZ.NS,2024-01-01,2024-06-30\n")
    assert [(r.ticker, r.end is None) for r in readers.memberships(spark, str(tmp_path / "members.csv")).orderBy("ticker").collect()] == [("ABC.NS", True), ("XYZ.NS", False)]
    assert desk.COHORT[0] < desk.COHORT[1]
