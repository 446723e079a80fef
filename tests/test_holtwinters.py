"""The matrix of series against the recursion of one series."""

import datetime as dt

import numpy as np
import pytest

from granary.operators import forecast as fc
from granary.operators import holtwinters as hw


def histories(seed, low, high):
    rng = np.random.default_rng(seed)
    out = [np.round(rng.gamma(2, 10, n) * (1 + 0.4 * np.sin(np.arange(n) / 3)), 2) for n in rng.integers(low, high, 40)]
    out += [np.zeros(high), np.full(low, 7.0), np.arange(high, dtype=float), np.tile([0.0, 5.0], high // 2)]
    return out


@pytest.mark.parametrize("period, seasonal, damp", [(0, "add", 1.0), (0, "add", 0.9), (4, "add", 1.0), (13, "add", 1.0), (4, "mul", 1.0)])
def test_a_matrix_equals_the_loop(period, seasonal, damp):
    series = [y + 1 if seasonal == "mul" else y for y in histories(period, max(period + 2, 4), 60)]
    aics, aheads, sds = hw.fit(series, 9, period, seasonal, damp)
    for y, aic, ahead, sd in zip(series, aics, aheads, sds):
        want = fc.holt_winters(y, 9, period, seasonal, damp)
        assert aic == pytest.approx(want[0], rel=1e-7, abs=1e-6)
        np.testing.assert_allclose(ahead, want[1], rtol=1e-7, atol=1e-7)
        assert sd == pytest.approx(want[2], rel=1e-6, abs=1e-6)


def candidates(y, horizon, period):
    """The lowest AIC of the candidates of one series."""
    lifted, plans = (y + 0.1 if (y == 0).any() else y), []
    if period and len(y) >= period + 2:
        plans.append(("seasonal-add", lifted, period, "add", 1.0))
        if not (y == 0).any():
            plans.append(("seasonal-mul", y, period, "mul", 1.0))
    if period > 4 and len(y) >= 6:
        plans.append(("monthly-add", lifted, 4, "add", 1.0))
    plans += [("damped", y, 0, "add", 0.9), ("linear", y, 0, "add", 1.0)]
    return min(((*fc.holt_winters(d, horizon, m, k, p), name) for name, d, m, k, p in plans), key=lambda s: s[0])


def test_the_best_candidate_is_that_of_the_loop(spark):
    series = histories(5, 4, 70)
    grains = ["weekly" if i % 3 else "biweekly" for i in range(len(series))]
    start = dt.date(2024, 1, 1)
    rows = [(i, start + dt.timedelta(days=7 * t), float(v), g, 5 if i % 2 else 3) for i, (y, g) in enumerate(zip(series, grains)) for t, v in enumerate(y)]
    df = spark.createDataFrame(rows, "product_id long, date date, smooth double, grain string, horizon int").repartition(5)
    got = {}
    for r in fc.fit_holt_winters(df).collect():
        got.setdefault(r.product_id, []).append(r)
    for i, (y, g) in enumerate(zip(series, grains)):
        _, ahead, sd, name = candidates(y, 5 if i % 2 else 3, hw.season_length(len(y), g))
        mine = sorted(got[i], key=lambda r: r.step)
        assert [r.step for r in mine] == list(range(1, len(ahead) + 1))
        assert {r.model for r in mine} == {f"holt_winters:{name}"}
        np.testing.assert_allclose([r.forecast for r in mine], np.maximum(ahead, 0), rtol=1e-6, atol=1e-6)
        half = 1.96 * sd * (1 + 0.02 * np.arange(len(ahead)))
        np.testing.assert_allclose([r.upper for r in mine], np.maximum(ahead, 0) + half, rtol=1e-6, atol=1e-6)


def test_one_value_and_short_series_are_continued():
    assert [f[0] for f in hw.best_of([np.array([4.0]), np.array([1.0, 2.0])], ["weekly"] * 2, 3)][0] == "flat"
    (name, ahead, _), = hw.weekly_seasons([np.array([1.0, 2.0, 3.0])], ["daily"], 2)
    assert name == "linear" and ahead == pytest.approx([4.0, 5.0])


def test_chunks_do_not_matter(spark, tables, monkeypatch):
    rows = fc.ts.fill_days(tables.brand_daily())
    whole = {(r.product_id, r.step): r.forecast for r in fc.seasonal_days(rows, 5).collect()}
    monkeypatch.setattr(hw, "CHUNK", 3)
    parts = {(r.product_id, r.step): r.forecast for r in fc.seasonal_days(rows, 5).collect()}
    assert whole.keys() == parts.keys() and all(parts[k] == pytest.approx(v) for k, v in whole.items())
