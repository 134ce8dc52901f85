"""The four sample feature rows printed by the original (FIXTURES.md §3)."""

import datetime as dt

import pytest

from weekcast.config import REFERENCE
from weekcast.operators.features import horizon_label, lag_features, rolling_stats

DIFFS = [5_000_000, 7663000, 7622346, 4368718, 718359, 1410796, 3727189, 8101, 3443227, 2737971]

# Expected rows (date, label, diff, lags 1-4, ma 1-4, std 1-4) as printed by the original.
EXPECTED = {
    dt.date(2011, 2, 11): (3727189, 1410796, (718359, 4368718, 7622346, 7663000),
                           (2543538.5, 2543538.5, 2543538.5, 2543538.5),
                           (2581193.603, 2581193.603, 2581193.603, 2581193.603)),
    dt.date(2011, 2, 18): (8101, 3727189, (1410796, 718359, 4368718, 7622346),
                           (1064577.5, 2165957.667, 2165957.667, 2165957.667),
                           (489626.8982, 1938809.445, 1938809.445, 1938809.445)),
    dt.date(2011, 2, 25): (3443227, 8101, (3727189, 1410796, 718359, 4368718),
                           (2568992.5, 1952114.667, 2556265.5, 2556265.5),
                           (1637937.198, 1575764.55, 1765035.088, 1765035.088)),
    dt.date(2011, 3, 4): (2737971, 3443227, (8101, 3727189, 1410796, 718359),
                          (1867645, 1715362, 1466111.25, 2046632.6),
                          (2629792.345, 1878157.135, 1612499.063, 1906604.34)),
}


def test_golden_rows(make_series):
    df = make_series(DIFFS, start=dt.date(2011, 1, 7), column="diff_sales")
    df = lag_features(df, 1, (), REFERENCE)
    df = rolling_stats(df, 1, (), REFERENCE)
    df = horizon_label(df, 1, (), REFERENCE)
    rows = {r["date"]: r for r in df.collect()}
    names = ["1week", "2weeks", "3weeks", "4weeks"]
    for day, (label, diff, lags, mas, stds) in EXPECTED.items():
        r = rows[day]
        assert r["label"] == label and r["diff_sales"] == diff
        assert [r[f"lag_{n}"] for n in names] == list(lags)
        assert [r[f"ma_{n}"] for n in names] == pytest.approx(mas, abs=1e-3)
        assert [r[f"std_{n}"] for n in names] == pytest.approx(stds, rel=1e-9, abs=1e-3)
    # the artificial last row gets the 0 label of the original
    last = max(rows)
    assert rows[last]["label"] == 0
