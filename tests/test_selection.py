"""Selection over many sessions: correlations known at each session."""

import datetime as dt
import random

import numpy as np
import pytest
from tidemark.operators import selection


def day(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=k)


def test_session_correlations_match_brute_force(spark):
    rnd = random.Random(3)
    rets = [(t, day(k), rnd.gauss(0, 1)) for t in "ABCDE" for k in range(50) if rnd.random() < 0.9 and not (t == "E" and k > 25)]
    rets += [("F", day(k), 0.5) for k in range(50)]  # constant
    at = [(day(k), t) for k in range(51) for t in "ABCDEF" if rnd.random() < 0.7]
    got = selection.session_correlations(spark.createDataFrame(rets, "ticker string, session timestamp, ret double"), spark.createDataFrame(at, "session timestamp, ticker string"), tail=12, least=5)
    ret, days, want = {(t, s): x for t, s, x in rets}, sorted({s for _, s, _ in rets} | {s for s, _ in at}), {}
    for s, a in at:
        for b in (t for s2, t in at if s2 == s and t > a):
            last = days[max(0, days.index(s) - 11) : days.index(s) + 1]
            both = [(ret[a, d], ret[b, d]) for d in last if (a, d) in ret and (b, d) in ret]
            if len(both) >= 5:
                want[s, a, b] = (None if "F" in (a, b) else np.corrcoef(*zip(*both))[0, 1], len(both))
    found = {(r.session, r.a, r.b): (r.corr, r.n) for r in got.collect()}
    assert set(found) == set(want) and len(want) > 200
    for key, (corr, n) in want.items():
        assert found[key][1] == n and (found[key][0] == pytest.approx(corr, abs=1e-9) if corr is not None else found[key][0] is None), key


def test_later_returns_do_not_change_earlier_choices(spark):
    """A and B move together at first and apart later; each session's choice sees only what came before it."""
    rnd = random.Random(4)
    x = [rnd.gauss(0, 1) for _ in range(80)]
    rets = [("A", day(k), x[k]) for k in range(80)] + [("B", day(k), x[k] if k < 40 else rnd.gauss(0, 1)) for k in range(80)]
    rets = spark.createDataFrame(rets, "ticker string, session timestamp, ret double")
    rows = spark.createDataFrame([(day(k), t, i, 2.0 - i, False) for k in (39, 79) for i, t in enumerate("AB")], "session timestamp, ticker string, sector int, rank_score double, held boolean")
    pairs = selection.session_correlations(rets, rows, tail=30)
    chosen = sorted((r.session, r.ticker) for r in selection.select_portfolio(rows, pairs).collect())
    assert chosen == [(day(39), "A"), (day(79), "A"), (day(79), "B")]
    wanted = rows.selectExpr("session", "ticker", "sector", "rank_score", "10L quantity", "10D price", "9D stop", "1D risk_scale")
    reasons = {(r.session, r.ticker): r.reason for r in selection.allocate(wanted, pairs).collect()}
    assert (reasons[day(39), "B"], reasons[day(79), "B"]) == ("correlation_cap", "allocated")


@pytest.mark.parametrize("batch", [10_000, 7])
def test_selection_goes_on_until_the_book_is_full(spark, batch):
    """The best candidates share a sector or move together; the others follow far behind, over several Arrow batches."""
    rnd = random.Random(5)
    rows = [(s, f"A{k:03d}", "x", 1000.0 - k, False) for s in range(3) for k in range(300)]  # one sector
    rows += [(s, f"B{k:03d}", f"y{k}", 500.0 - k, False) for s in range(3) for k in range(40)]  # all move with A000
    rows += [(s, f"C{k:03d}", f"z{k % 3}", rnd.random(), k == 30 and s == 2) for s in range(1, 3) for k in range(40)]
    pairs = [("A000", f"B{k:03d}", 0.9) for k in range(40)]
    size, per_sector, want = 6, 2, []
    for s in range(3):
        taken = []
        for _, t, sector, _, held in sorted((r for r in rows if r[0] == s), key=lambda r: (not r[4], -r[3], r[1])):
            near = any((a in (t, o) and b in (t, o)) for a, b, _ in pairs for o, _ in taken)
            if len(taken) < size and (held or sum(x == sector for _, x in taken) < per_sector and not near):
                taken.append((t, sector))
        want += [(s, t) for t, _ in taken]
    assert [sum(s == k for s, _ in want) for k in range(3)] == [2, 6, 6]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = selection.select_portfolio(spark.createDataFrame(rows, "session int, ticker string, sector string, rank_score double, held boolean"), spark.createDataFrame(pairs, "a string, b string, corr double"), size, per_sector)
        assert sorted((r.session, r.ticker) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
