"""Layouts and plans that keep a task, and the driver, bounded as the tables grow."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions.layout import ROWS_PER_TASK, tasks_for_rows
from granary.functions.prefix import materialise
from granary.operators import batched as bt
from granary.operators import classify as cls
from granary.operators import dashboard as dash
from granary.operators import forecast as fc
from granary.operators import holtwinters as hw
from granary.operators import series as ts
from granary.streaming import jobs
from granary.streaming.dedupe import dedupe_log

DAY, DAY0 = dt.date(2024, 1, 1), dt.datetime(2024, 1, 1)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def catalogue(spark, n: int):
    return spark.range(n).select(
        F.col("id").alias("product_id"), F.lit(3).alias("lead_time_days"), F.lit(10).alias("current_stock"), F.lit(4.0).alias("reorder_point"),
        F.lit(2.0).alias("average_daily_demand"), F.lit(9.0).alias("unit_price"), F.lit(0.4).alias("demand_volatility"),
        F.lit(1.2).alias("seasonality_factor"), F.lit("Y").alias("xyz_class"), F.lit(5.0).alias("inventory_turnover"))


def test_adjustments_do_not_broadcast_the_catalogue(spark):
    df = fc.adjust(fc.baseline(catalogue(spark, 40), DAY, 14), catalogue(spark, 40))
    assert "BroadcastExchange" not in plan_of(df)
    assert df.count() == 40 * 14


def daily(spark, n: int, products: int = 3):
    return spark.range(n).select(
        (F.col("id") % products).alias("product_id"), F.date_add(F.lit(DAY), (F.col("id") * 11 % 700).cast("int")).alias("date"),
        (F.col("id") % 50 + 1).alias("qty")).groupBy("product_id", "date").agg(F.sum("qty").alias("qty"))


def test_tasks_follow_the_rows(spark, tables):
    assert tasks_for_rows(spark, 10_000_000) == -(-10_000_000 // ROWS_PER_TASK)
    assert 1 <= tasks_for_rows(spark, 100) <= spark.sparkContext.defaultParallelism
    assert plan_of(tables.part_daily()).count("REPARTITION_BY_NUM") == 2
    # No exchange of its own behind the layout by product.
    assert "ENSURE_REQUIREMENTS" not in plan_of(cls.trend_acceleration(tables.part_daily()))


def test_weekly_buckets_of_forecasts_need_no_join(tables):
    plan = plan_of(dash.weekly_buckets(tables.forecasts))
    assert "Join" not in plan and "ENSURE_REQUIREMENTS" not in plan


def test_periods_are_filled_and_capped_without_joins(spark):
    rows = daily(spark, 60).repartition(2, "product_id")
    df = ts.winsorise(ts.model_periods(rows))
    assert "Join" not in plan_of(df)
    found = {}
    for r in df.collect():
        found.setdefault(r.product_id, []).append(r)
    for product, periods in found.items():
        periods.sort(key=lambda r: r.date)
        gaps = {(b.date - a.date).days for a, b in zip(periods, periods[1:])}
        assert gaps == {14 if periods[0].grain == "biweekly" else 7}
        assert sum(r.qty for r in periods) == sum(r.qty for r in rows.where(F.col("product_id") == product).collect())


def test_holt_winters_builds_its_series_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(hw, "materialise", lambda df: written.append(df) or materialise(df))
    rows = daily(spark, 90).withColumns({"grain": F.lit("weekly"), "horizon": F.lit(2), "smooth": F.col("qty")})
    assert fc.fit_holt_winters(rows).count() == 6
    assert len(written) == 1


def test_alerts_of_few_rows_need_no_group_per_stretch(spark):
    at = [(f"k{i % 3}", "EMAIL", i, DAY0 + dt.timedelta(minutes=(i * 37) % 1500)) for i in range(200)] + [(None, "EMAIL", 900, DAY0), ("k0", "EMAIL", 901, None)]
    df = spark.createDataFrame(at, "alert_key string, channel string, id long, ts timestamp")
    short, long = dedupe_log(df), dedupe_log(df, short=0, stretch_windows=2)
    assert "FlatMapGroupsInPandas" not in plan_of(short)
    assert sorted(short.collect()) == sorted(long.collect())
    assert sorted(dedupe_log(df, short=66).collect()) == sorted(short.collect())


def test_rates_sum_over_changes_and_not_over_silent_days(spark):
    sold = [(k, DAY + dt.timedelta(days=d), q) for k, d, q in ((1, 0, 4), (1, 3, None), (1, 9, 2), (1, 60, 5), (2, 1, None))]
    df = jobs.sliding_rate(spark.createDataFrame(sold, "k int, sale_date date, quantity long"), "k", (7, 30))
    plan = plan_of(df)
    assert plan.index("explode(sequence") < plan.index("Window")  # the days come after the sums
    want = set()
    for k in (1, 2):
        for n in (7, 30):
            for day in range(120):
                within = [q for key, d, q in sold if key == k and 1 <= (DAY + dt.timedelta(days=day) - d).days <= n]
                if within:
                    units = sum(q for q in within if q is not None) if any(q is not None for q in within) else None
                    want.add((k, n, DAY + dt.timedelta(days=day), units, None if units is None else units / n))
    rows = [tuple(r[c] for c in ("k", "days", "until", "units", "rate")) for r in df.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_silent_periods_of_no_product_stay_empty(spark):
    rows = spark.createDataFrame([(None, DAY, 3), (None, DAY + dt.timedelta(days=21), 4), (1, DAY, 5)], "product_id long, date date, qty long")
    for grid in (ts.weekly(rows), ts.model_periods(rows)):
        found = sorted((r.product_id or 0, r.date, r.qty, r.n_days) for r in grid.collect())
        assert [x[2:] for x in found] == [(0, 0)] * 4 + [(5, 1)]


def test_trees_learn_in_few_tasks(spark, monkeypatch):
    """Each level of a tree shuffles between all tasks, so their number must not follow every 20,000 rows."""
    from pyspark.ml.regression import GBTRegressor

    class Stop(Exception):
        pass

    seen = []

    def fit(self, df, *a):
        seen.append(df.rdd.getNumPartitions())
        raise Stop

    monkeypatch.setattr(GBTRegressor, "fit", fit)
    weeks = spark.range(200_001).selectExpr(
        "id div 100 as product_id", "date_add(date'2020-01-06', cast(id % 100 * 7 as int)) as date", "id % 17 as qty")
    with pytest.raises(Stop):
        fc.boosted_forecast(weeks, 1, 2)
    assert seen == [8]


def test_pipeline_reads_its_days_once(spark):
    """Segments, periods, weekdays, fallback and last days all read one written table."""
    rows = [(p, dt.date(2022, 1, 3) + dt.timedelta(days=d), 5 + (d * p) % 7) for p in (1, 2) for d in range(0, 200, 1 + p)]
    rows += [(3, dt.date(2022, 1, 3), 4)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    daily = spark.createDataFrame(rows, "product_id long, date date, qty long").coalesce(1)
    out = fc.forecast_products(daily.mapInArrow(counted, daily.schema), 14)
    assert out.count() == 3 * 14 and read.value == len(rows)


def test_quantiles_of_a_series_are_numpys():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 200):
        y = np.sort(rng.gamma(0.7, 40, n))
        for share in (0.5, 0.99):
            assert bt.quantile(y, share) == pytest.approx(np.percentile(y, 100 * share), rel=1e-12)
        assert bt.variance(y) == pytest.approx(y.var(), rel=1e-9, abs=1e-12)


def test_weeks_leave_out_sales_without_date_or_quantity(spark):
    rows = [(1, DAY, 5), (1, None, 9), (1, DAY + dt.timedelta(days=7), None), (1, DAY + dt.timedelta(days=14), 3), (None, DAY, 2)]
    daily = spark.createDataFrame(rows, "product_id long, date date, qty long")
    out = fc.period_table(daily).collect()
    assert [(r.product_id, r.n, r.qty, r.smooth) for r in out] == [(1, 3, [5.0, 0.0, 3.0], [5.0, 0.0, 3.0])]
    assert {r.model for r in fc.forecast_products(daily, 7).collect()} == {"fallback"}
