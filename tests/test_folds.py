"""Fold statistics: the fall of the curve over all folds."""

import datetime as dt
import random

import numpy as np
import pytest
from tidemark.operators import evaluation


def test_overall_fall_crosses_folds(spark):
    rnd = random.Random(1)
    trades = [(k, dt.datetime(2020 + k // 40, 1, 1) + dt.timedelta(hours=8 * (k % 40)), rnd.gauss(0.1 if k // 40 in (0, 3) else -0.2, 1)) for k in range(200)]
    rows = [(t, s.year, s, r, r > 0) for t, s, r in trades]
    got = {r.fold: r for r in evaluation.fold_statistics(spark.createDataFrame(rows, "trade_id long, fold int, exit_session timestamp, net_r double, hit boolean")).collect()}

    def fall(rs):
        curve = np.cumsum([0.0, *rs])
        return float(np.min(curve - np.maximum.accumulate(curve)))

    folds = {y: fall([r for _, s, r in trades if s.year == y]) for y in range(2020, 2025)}
    assert set(got) == {None, *folds}
    for y, want in folds.items():
        assert got[y].worst_fall == pytest.approx(want) and got[y].inner_fall == pytest.approx(want)
    whole = fall([r for _, _, r in trades])
    assert whole < min(folds.values()) - 1
    assert got[None].worst_fall == pytest.approx(whole) and got[None].inner_fall == pytest.approx(min(folds.values()))
    assert got[None].trades == 200 and got[None].total_r == pytest.approx(sum(r for *_, r in trades))
