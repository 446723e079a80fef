"""Segments, smoothing, models and their properties."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import forecast as fc
from granary.operators import series as ts

START = dt.date(2022, 1, 3)


def rnd(x):
    return math.floor(x + 0.5)


def segment_rows():
    """One closed-form series per segment (no random numbers)."""
    k = lambda i: (i * 7919) % 11
    forms = {
        1: lambda i: rnd(20 + 10 * math.sin(2 * math.pi * i / 7)),
        2: lambda i: rnd(20 + 15 * math.sin(2 * math.pi * i / 7)) * (3 if i % 7 == 2 else 1),
        3: lambda i: 20 + k(i) // 3 - 1,
        4: lambda i: rnd(10 + 0.06 * i) + k(i) // 4,
        5: lambda i: 60 if (i * 7919) % 23 < 3 else 5,
        6: lambda i: 8 if k(i) < 6 else 0,
        7: lambda i: 5 + 2 * k(i),
    }
    rows = [(p, START + dt.timedelta(days=i), int(f(i))) for p, f in forms.items() for i in range(730)]
    return rows + [(8, START + dt.timedelta(days=i), int(forms[1](i))) for i in range(13)]


@pytest.fixture(scope="module")
def fixture(spark):
    return spark.createDataFrame(segment_rows(), "product_id long, date date, qty long").repartition(4)


def test_segments(fixture):
    got = {r.product_id: r.segment for r in ts.segments(fixture).collect()}
    assert got == {1: "SEASONAL_STABLE", 2: "SEASONAL_VOLATILE", 3: "STABLE_FLAT", 4: "STABLE_TRENDING", 5: "VOLATILE",
                   6: "INTERMITTENT", 7: "MODERATE", 8: "INSUFFICIENT_DATA"}


def decompose_np(y, p):
    n, h = len(y), p // 2
    w = np.ones(p) / p if p % 2 else np.r_[0.5, np.ones(p - 1), 0.5] / p
    t = np.full(n, np.nan)
    t[h:n - h] = np.convolve(y, w, "valid")
    front, back = h, n - 1 - h
    a = np.arange(front, min(front + p, back))
    b = np.arange(max(front, back - p), back)
    t[:front] = np.polyval(np.polyfit(a, t[a], 1), np.arange(front))
    t[back + 1:] = np.polyval(np.polyfit(b, t[b], 1), np.arange(back + 1, n))
    d = y - t
    s = np.array([d[i::p].mean() for i in range(p)])
    s -= s.mean()
    season = np.resize(s, n)
    return t, season, d - season


@pytest.mark.parametrize("p", [7, 14])
def test_decomposition_equals_numpy(fixture, p):
    one = fixture.filter("product_id = 4")
    rows = sorted(ts.decompose(ts.numbered(one), "qty", (p,)).collect(), key=lambda r: r.i)
    y = np.array([float(r.qty) for r in rows])
    t, s, e = decompose_np(y, p)
    assert np.allclose([r.trend for r in rows], t) and np.allclose([r.seasonal for r in rows], s) and np.allclose([r.resid for r in rows], e)


def test_gap_filling_keeps_the_total(spark):
    rows = [(1, START, 4), (1, START + dt.timedelta(days=20), 6), (2, START, 1)]
    df = spark.createDataFrame(rows, "product_id long, date date, qty long")
    days, weeks = ts.fill_days(df).collect(), ts.weekly(df).collect()
    assert len(days) == 22 and sum(r.qty for r in days) == 11
    assert len(weeks) == 4 and sum(r.qty for r in weeks) == 11


def spread_np(y):
    y = np.array(y, float)
    if len(y) < 4:
        return y
    pos = y[y > 0]
    out = np.minimum(y, np.percentile(pos, 99) * 2) if len(pos) else y.copy()
    if (y > 0).mean() < 0.3:
        med = np.median(pos) if len(pos) else 1
        for i in range(len(out)):
            if out[i] > med * 5:
                near = range(max(0, i - 1), min(len(out), i + 2))
                share = out[i] / len(near)
                for j in near:
                    out[j] = max(out[j], share)
    return out


def test_winsorise_equals_the_loop(spark):
    series = {
        1: [0] * 12 + [2] + [0] * 6 + [100] + [0] * 5 + [3] + [0] * 4, 2: [5, 6, 7, 400, 5, 6, 5, 5],
        3: [0, 0, 900, 0, 0, 0, 0, 0, 0, 0, 2, 1, 0, 0, 0], 4: [0] * 6,
        5: [700] + [0] * 9 + [1, 2] + [0] * 8 + [600], 6: [1, 2, 3]}
    rows = [(p, START + dt.timedelta(days=7 * i), v) for p, ys in series.items() for i, v in enumerate(ys)]
    out = ts.winsorise(spark.createDataFrame(rows, "product_id long, date date, qty long")).collect()
    for p, ys in series.items():
        got = [r.smooth for r in sorted((r for r in out if r.product_id == p), key=lambda r: r.date)]
        assert got == pytest.approx(list(spread_np(ys))), p


def test_holt_and_smoothing_equal_the_loop(fixture):
    levels = {r.product_id: r.level for r in ts.smoothed_level(fixture).collect()}
    holts = {r.product_id: r.holt for r in ts.holt_level(fixture).collect()}
    by = {}
    for p, d, q in segment_rows():
        by.setdefault(p, []).append(float(q))
    for p, y in by.items():
        s = y[0]
        lvl, tr = y[0], y[1] - y[0]
        for v in y[1:]:
            s = 0.3 * v + 0.7 * s
            new = 0.3 * v + 0.7 * (lvl + tr)
            tr = 0.3 * (new - lvl) + 0.7 * tr
            lvl = new
        assert levels[p] == pytest.approx(s) and holts[p] == pytest.approx(lvl + tr)


def test_croston_equals_the_loop(fixture):
    got = ts.croston(fixture.filter("product_id = 6")).first()
    y = [q for p, _, q in segment_rows() if p == 6]
    at = [i for i, v in enumerate(y) if v > 0]
    gaps, sizes = np.diff(at), [y[i] for i in at[1:]]
    g, s = gaps[0], sizes[0]
    for a, b in zip(gaps[1:], sizes[1:]):
        g, s = 0.1 * a + 0.9 * g, 0.1 * b + 0.9 * s
    assert got.rate == pytest.approx(s / g)


def test_holt_winters_follows_a_clean_season():
    y = np.array([10 + 5 * math.sin(2 * math.pi * i / 7) for i in range(140)])
    _, ahead, sd = fc.holt_winters(y, 7, 7)
    assert np.allclose(ahead, y[:7], atol=0.5) and sd < 0.6


def test_pipeline_covers_every_product_and_ignores_layout(fixture):
    def run(df):
        return {(r.product_id, r.day): (round(r.forecast, 6), r.model) for r in fc.forecast_products(df, 28).collect()}

    a = run(fixture.repartition(1))
    assert len(a) == 8 * 28 and a == run(fixture.repartition(8))
    assert all(v[0] >= 0 for v in a.values())
    assert a[(8, 1)][1] == "fallback" and a[(6, 1)][1].startswith("seasonal_naive") and a[(1, 1)][1].startswith("holt_winters")


def test_days_add_up_to_the_weeks(fixture):
    weekly = fc.seasonal_naive(ts.weekly(fixture), 4)
    last = fixture.groupBy("product_id").agg(F.max("date").alias("last")).withColumn("period_days", F.lit(7))
    days = fc.to_days(weekly, last, ts.weekday_weights(fixture), 28)
    a = {r[0]: r[1] for r in days.groupBy("product_id").agg(F.sum("forecast")).collect()}
    b = {r[0]: r[1] for r in weekly.groupBy("product_id").agg(F.sum("forecast")).collect()}
    assert a == pytest.approx(b)


def test_backtest_uses_the_held_out_dates(fixture):
    out = fc.backtest(fixture)
    assert out.groupBy("product_id").count().collect() and out.filter("forecast_date < date'2022-12-01'").count() == 0
    assert {r[0] for r in out.select("product_id").distinct().collect()} == {1, 2, 3, 4, 5, 6, 7}


def test_first_generation_picks_croston_for_intermittent(fixture):
    got = {r.product_id: r.model for r in fc.first_generation(fixture, 3).filter("step = 1").collect()}
    assert got[6] == "croston" and got[3] == "holt_winters:7" and got[8] == "recent_average"


def model_scores(y):
    """The six models as plain loops: (mape, rmse, last) on the rows each is judged on."""
    n, k = len(y), int(len(y) * 0.8)

    def errors(rows, last):
        known = [abs((a - p) / a) for a, p in rows if a]
        return (100 * sum(known) / len(known) if known else 100.0,
                math.sqrt(sum((a - p) ** 2 for a, p in rows) / len(rows)), last)

    level, es = y[0], []
    for v in y:
        es.append(level)
        level = 0.3 * v + 0.7 * level
    level, trend, holt = y[0], y[1] - y[0], [y[0]]
    for v in y[1:k]:
        new = 0.3 * v + 0.7 * (level + trend)
        level, trend = new, 0.3 * (new - level) + 0.7 * trend
        holt.append(level + trend)
    mean7 = sum(y[-7:]) / 7
    wma = []
    for i in range(k):
        part = y[max(0, i - 6): i + 1]
        wma.append(sum(v * (j + 1) for j, v in enumerate(part)) / sum(range(1, len(part) + 1)) if k >= 7 else y[i])
    b, a = np.polyfit(np.arange(k), y[:k], 1)
    return {"exponential_smoothing": errors(list(zip(y[k:], es[k:])), es[-1]),
            "double_exponential_smoothing": errors(list(zip(y[:k], holt)), holt[-1]),
            "moving_average": errors([(v, mean7) for v in y[k:]], mean7),
            "weighted_moving_average": errors(list(zip(y[:k], wma)), wma[-1]),
            "linear_regression": errors([(y[i], a + b * i) for i in range(k)], max(0.0, a + b * k))}


def test_model_comparison_equals_loops(spark):
    series = {1: [3 + (i * 7919) % 11 for i in range(40)], 2: [5] * 14, 3: [0, 4] * 10, 4: [0] * 20, 5: [1] * 13,
              6: [i for i in range(1, 31)]}
    rows = [(p, START + dt.timedelta(days=i), v) for p, ys in series.items() for i, v in enumerate(ys)]
    df = spark.createDataFrame(rows, "product_id long, date date, qty long").repartition(3)
    got = {(r.product_id, r.model): (r.mape, r.rmse, r.last) for r in fc.compare_models(df).collect()}
    assert {p for p, _ in got} == {1, 2, 3, 4, 6} and len(got) == 30
    for p in (1, 2, 3, 4, 6):
        for model, want in model_scores([float(v) for v in series[p]]).items():
            assert got[p, model] == pytest.approx(want, abs=1e-6), (p, model)


def test_model_comparison_reads_the_series_once(tables):
    plan = fc.compare_models(tables.part_daily())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_pooled_trees(spark):
    rows = [(p, START + dt.timedelta(days=7 * i), 20 * p + 10 * (i % 2)) for p in (1, 2) for i in range(60)]
    weeks = spark.createDataFrame(rows, "product_id long, date date, qty long")
    table = {(r.product_id, r.date): r for r in fc.lag_table(weeks).collect()}
    third, first = table[1, START + dt.timedelta(days=14)], table[1, START]
    assert third.mean_4 == 25.0 and third.lag_1 == 30 and first.mean_4 == 0.0  # weeks before it only
    out = fc.boosted_forecast(weeks, horizon=3, rounds=5).collect()
    assert len(out) == 6 and all(0 <= r.lower <= r.forecast <= r.upper for r in out)
    ahead = {(r.product_id, r.date): r.forecast for r in out}
    assert ahead[1, START + dt.timedelta(days=420)] == pytest.approx(20, abs=5)
    assert len(fc.boosted_forecast(weeks, horizon=1, rounds=2, own=True).collect()) == 2
