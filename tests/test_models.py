"""Calendar regression, holdout blend and rolling-origin scores against numpy and plain loops."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.operators import batched as bt
from granary.operators import forecast as fc
from granary.operators import holtwinters as hw
from granary.operators import regression as reg
from granary.operators import series as ts

START = dt.date(2023, 1, 2)


def rows_of(series):
    return [(p, START + dt.timedelta(days=i), int(v)) for p, ys in series.items() for i, v in enumerate(ys)]


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(4)
    out = {p: rng.poisson(20 + 5 * (np.arange(n) % 7 == 5) + np.arange(n) / 20).astype(int) for p, n in ((1, 400), (2, 35), (3, 14), (4, 90))}
    out[5] = np.zeros(40, int)
    out[6] = np.full(31, 6)
    out[7] = np.array([3, 0, 9])
    return out


@pytest.fixture(scope="module")
def daily(spark, series):
    return spark.createDataFrame(rows_of(series), "product_id long, date date, qty long").repartition(4)


def design(n, features, start=START):
    d = pd.date_range(start, periods=n)
    table = pd.DataFrame({"day_of_week": d.dayofweek, "day_of_month": d.day, "month": d.month, "quarter": d.quarter,
                          "is_weekend": (d.dayofweek >= 5).astype(int), "week_of_year": d.isocalendar().week.to_numpy().astype(int)})
    return table[list(features)].to_numpy(float)


def test_coefficients_equal_numpy(daily, series):
    got = {r.product_id: r for r in reg.calendar_fit(daily).collect()}
    for p in (1, 4):
        x = np.column_stack([np.ones(len(series[p])), design(len(series[p]), reg.DEFAULT)])
        want = np.linalg.lstsq(x, series[p].astype(float), rcond=None)[0]
        mine = [got[p].intercept] + [got[p].coef[reg.FEATURES.index(f)] for f in reg.DEFAULT]
        np.testing.assert_allclose(mine, want, rtol=1e-8, atol=1e-8)
    # Two weeks of one month: the month is constant and counts for nothing.
    assert got[3].coef[reg.FEATURES.index("month")] == 0.0
    x = np.column_stack([np.ones(14), design(14, [f for f in reg.DEFAULT if f != "month"])])
    want = np.linalg.lstsq(x, series[3].astype(float), rcond=None)[0]
    np.testing.assert_allclose(got[3].intercept + design(14, reg.FEATURES) @ np.array(got[3].coef), x @ want, rtol=1e-8)
    assert got[6].intercept == pytest.approx(6) and got[5].intercept == 0.0


def test_selected_features_and_rows(spark, daily, series):
    chosen = spark.createDataFrame([(1, ["week_of_year", "month"]), (4, ["quarter"])], "product_id long, features array<string>")
    got = {r.product_id: r for r in reg.calendar_fit(daily, chosen, F.col("date") < F.lit(START + dt.timedelta(days=80))).collect()}
    for p, features in ((1, ["week_of_year", "month"]), (4, ["quarter"])):
        y = series[p][:80].astype(float)
        x = np.column_stack([np.ones(80), design(80, features)])
        fitted = x @ np.linalg.lstsq(x, y, rcond=None)[0]
        np.testing.assert_allclose(got[p].intercept + design(80, reg.FEATURES) @ np.array(got[p].coef), fitted, rtol=1e-8)
        assert sum(c != 0 for c in got[p].coef) <= len(features)


def blended(y, features, h):
    """Holdout winner, regression and blend of one series."""
    y = y.astype(float)
    n, cut = len(y), int(len(y) * 0.8)

    def smooth(v, k):
        level = v[0]
        for x in v[1:]:
            level = 0.3 * x + 0.7 * level
        return np.full(k, level)

    models = {"exponential_smoothing": smooth, "seasonal_naive": lambda v, k: v[-7:][np.arange(k) % min(7, len(v))],
              "linear_trend": lambda v, k: np.polyval(np.polyfit(np.arange(len(v)), v, 1), np.arange(len(v), len(v) + k)),
              "holt_winters": lambda v, k: fc.holt_winters(v, k, 7)[1]}
    x = np.column_stack([np.ones(n), design(n, features)])
    coef = np.linalg.lstsq(x, y, rcond=None)[0]
    weight, choice = 0.7, "exponential_smoothing"
    if n >= 30:
        errors = {m: np.abs(y[cut:] - f(y[:cut], n - cut)).mean() for m, f in models.items()}
        choice = min(sorted(errors), key=errors.get)
        a, b = 1 / (errors[choice] + 1), 1 / (np.abs(y[cut:] - (x @ coef)[cut:]).mean() + 1)
        weight = np.clip(a / (a + b), 0.2, 0.8)
    ahead = design(h, features, START + dt.timedelta(days=n))
    return choice, np.maximum(weight * models[choice](y, h) + (1 - weight) * (coef[0] + ahead @ coef[1:]), 0)


def test_blend_equals_the_loop(daily, series):
    chosen = {r.product_id: sorted(r.features) for r in reg.selected_features(daily).collect()}
    got = {}
    for r in fc.auto_forecast(daily, 10).collect():
        got.setdefault(r.product_id, []).append(r)
    for p in (1, 2, 4, 5, 6):
        model, ahead = blended(series[p], chosen[p], 10)
        mine = sorted(got[p], key=lambda r: r.step)
        assert {r.model for r in mine} == {model}, p
        if p in (1, 4):  # long enough for independent features
            np.testing.assert_allclose([r.forecast for r in mine], ahead, rtol=1e-6, atol=1e-6)
        change = (np.mean([r.forecast for r in mine][-7:]) - np.mean([r.forecast for r in mine][:7])) / max(np.mean([r.forecast for r in mine][:7]), 1) * 100
        assert mine[0].direction == ("increasing" if change > 10 else "decreasing" if change < -10 else "stable")
        assert all(0 <= r.lower <= r.forecast <= r.upper for r in mine)
    assert len(got[7]) == 10


def test_backtest_follows_its_training_rows(daily, series):
    """Forecasts for the held-out dates are those of the series cut there."""
    got = {(r.product_id, r.forecast_date): r for r in fc.backtest(daily).collect()}
    assert {p for p, _ in got} == {1, 2, 4, 5, 6}
    for p in (1, 4):
        cut = int(len(series[p]) * 0.6)
        train = daily.where((F.col("product_id") == p) & (F.col("date") < F.lit(START + dt.timedelta(days=cut))))
        alone = {r.step: r.forecast for r in fc.auto_forecast(train, len(series[p]) - cut).collect()}
        for step, value in alone.items():
            row = got[p, START + dt.timedelta(days=cut + step - 1)]
            assert row.predicted == pytest.approx(value, rel=1e-6) and row.actual == series[p][cut + step - 1]


def test_rolling_scores_see_no_held_out_row(spark, series):
    """Values behind the last cut change errors, never what a model forecasts for rows before them."""
    y = series[4].astype(float)
    cuts = [54, 63, 72, 81]
    states = [s[0] for s in bt.smoothed_states([y], 0.3, 0.3)]
    first = bt.rolling_forecasts(y, tuple(states), cuts)
    other = np.concatenate([y[:81], y[81:] * 100])
    second = bt.rolling_forecasts(other, tuple(s[0] for s in bt.smoothed_states([other], 0.3, 0.3)), cuts)
    for m in bt.MODELS:
        np.testing.assert_allclose(first[m], second[m])
    level = y[0]
    for v in y[1:63]:
        level = 0.3 * v + 0.7 * level
    np.testing.assert_allclose(first["exponential_smoothing"][9:18], level)
    np.testing.assert_allclose(first["linear_regression"][:9], np.polyval(np.polyfit(np.arange(54), y[:54], 1), np.arange(54, 63)))
    np.testing.assert_allclose(first["moving_average"][-9:], y[74:81].mean())


def test_decomposition_matrix_equals_the_windows(spark, daily, series):
    for p in (3, 4, 7, 13):
        want = {}
        for r in ts.decompose(ts.numbered(daily), "qty", (p,)).collect():
            want.setdefault(r.product_id, {})[r.i] = (r.trend, r.seasonal, r.resid)
        for key, parts in zip(series, bt.by_period([y.astype(float) for y in series.values()], [(p,)] * len(series))):
            assert (key in want) == (p in parts)
            for i, got in enumerate(zip(*parts.get(p, ((), (), ())))):
                assert got == pytest.approx(want[key][i], abs=1e-8)


def test_caps_equal_the_long_form(spark):
    rng = np.random.default_rng(8)
    series = {p: np.where(rng.random(n) < share, rng.poisson(5, n) * rng.choice([1, 1, 1, 60], n), 0)
              for p, (n, share) in enumerate([(40, 0.2), (40, 0.9), (3, 0.5), (12, 0.0), (25, 0.25), (60, 0.1)])}
    rows = [(p, START + dt.timedelta(days=7 * i), int(v)) for p, ys in series.items() for i, v in enumerate(ys)]
    want = {}
    for r in ts.winsorise(spark.createDataFrame(rows, "product_id long, date date, qty long")).collect():
        want.setdefault(r.product_id, []).append((r.date, r.smooth))
    for p, ys in series.items():
        np.testing.assert_allclose(bt.capped(ys.astype(float)), [v for _, v in sorted(want[p])])


def test_dense_periods():
    y, length = bt.dense_periods(np.array([10, 11, 13]), np.array([1.0, 2.0, 3.0]))
    assert length == 1 and y.tolist() == [1, 2, 0, 3]
    y, length = bt.dense_periods(np.array([0, 3, 9]), np.array([1.0, 2.0, 3.0]))
    assert length == 2 and y.tolist() == [1, 2, 0, 0, 3]
    assert hw.season_length(12, "biweekly") == 6


def test_trees_step_ahead_on_their_own_forecasts(spark, monkeypatch):
    """A step sees the forecasts of those before it in its lags: the frames equal a plain loop over steps."""
    rows = [(p, START + dt.timedelta(days=7 * i), 20 * p + 10 * (i % 2) + i % 5) for p in (1, 2, 3) for i in range(40)]
    weeks = spark.createDataFrame(rows, "product_id long, date date, qty long")
    out = {(r.product_id, r.step): r for r in fc.boosted_forecast(weeks, horizon=3, rounds=4).collect()}
    assert len(out) == 9 and all(0 <= r.lower <= r.forecast <= r.upper for r in out.values())
    assert {r.date for (p, s), r in out.items() if s == 3} == {START + dt.timedelta(days=7 * 42)}
    # The first two steps put into the history give the third as a first step.
    grown = weeks.selectExpr("product_id", "date", "cast(qty as double) qty")
    known = spark.createDataFrame([(p, out[p, s].date, out[p, s].forecast) for p in (1, 2, 3) for s in (1, 2)], grown.schema)
    from pyspark.ml.regression import GBTRegressor

    fit, kept = GBTRegressor.fit, []
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df, *a: kept.append(fit(self, df, *a)) or kept[-1])
    fc.boosted_forecast(weeks, horizon=1, rounds=4).collect()
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df, *a: kept[0])
    third = {r.product_id: r.forecast for r in fc.boosted_forecast(grown.unionByName(known), horizon=1, rounds=4).collect()}
    assert third == pytest.approx({p: out[p, 3].forecast for p in (1, 2, 3)})


def test_volatile_products_take_the_trees_first(spark):
    rng = np.random.default_rng(2)
    series = {1: rng.gamma(0.7, 40, 300).astype(int) + 1, 2: rng.gamma(0.8, 30, 250).astype(int) + 1, 3: np.full(200, 9)}
    daily = spark.createDataFrame(rows_of(series), "product_id long, date date, qty long")
    got = {r.product_id: r for r in fc.forecast_products(daily, 14, trees=(3, 0.3)).where("day = 1").collect()}
    volatile = {p for p, r in got.items() if r.segment == "VOLATILE"}
    assert volatile and all(got[p].model.startswith("boosted") for p in volatile)
    assert all(not got[p].model.startswith("boosted") for p in got.keys() - volatile)
    assert fc.forecast_products(daily, 14, trees=(3, 0.3)).groupBy("product_id").count().where("count != 14").isEmpty()
