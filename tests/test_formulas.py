"""Hand-computed values and band edges."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from granary.functions.mathx import z_value
from granary.operators import classify, decision, demand, inventory, listing, policy

AS_OF = dt.date(2024, 1, 31)


def one(spark, **cols):
    return spark.range(1).select(F.lit(1).cast("long").alias("product_id"), *[F.lit(v).alias(k) for k, v in cols.items()])


def test_stock_bands(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([0, 1, 10, 11, 50, 51])], "product_id long, current_stock int")
    got = [r.band for r in listing.with_band(df).orderBy("product_id").collect()]
    assert got == ["OUT", "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH"]


def test_compact_policy(spark):
    df = one(spark, demand=10.0, sigma=4.0, lead=9, cost=8.0, current_stock=100)
    r = policy.compact_policy(df).first()
    ss = round(z_value(0.95) * 4 * 3, 2)
    assert r.safety_stock == round(ss) and r.reorder_point == round(90 + ss)
    assert r.eoq == int(math.sqrt(2 * 3650 * 50 / 2))
    assert r.stockout_risk == "MEDIUM" and r.risk_percentage == pytest.approx(20.2, abs=0.05)


def test_policy_without_demand(spark):
    rows = policy.compact_policy(spark.createDataFrame(
        [(0,), (5,)], "current_stock int").withColumns({
            "demand": F.lit(None).cast("double"), "sigma": F.lit(None).cast("double"), "lead": F.lit(7), "cost": F.lit(1.0)})).collect()
    assert [(r.stockout_risk, r.risk_percentage) for r in rows] == [("CRITICAL", 100.0), ("UNKNOWN", 0.0)]


def test_lot_size_limits_and_priority(spark):
    base = dict(annual_demand=3650.0, unit_cost=8.0, sd_daily=5.0, avg_daily=10.0, storage_cost_per_unit=0.0,
                order_frequency_days=0, min_order_qty=500, max_order_qty=450, product_priority="HIGH")
    r = policy.order_quantity_terms(one(spark, **base)).first()
    assert r.holding_cost == 2.0 and r.pure_eoq == pytest.approx(math.sqrt(2 * 3650 * 50 / 2))
    assert r.eoq == pytest.approx(450 * 1.175)  # raised to 500, capped at 450, plus .10 + .15 * .5


def test_safety_stock_grows_with_service_level_and_respects_shelf_life(spark):
    base = dict(sd_daily=4.0, lead=4, avg_daily=10.0, holding_cost=0.0)
    df = one(spark, **base).withColumns({"stockout_cost_per_unit": F.lit(None).cast("double"), "shelf_life_days": F.lit(None).cast("int")})
    levels = [policy.safety_stock_terms(df, s).first().safety_stock for s in (0.85, 0.9, 0.95, 0.99)]
    assert levels == sorted(levels)
    short = df.withColumn("shelf_life_days", F.lit(4))
    assert policy.safety_stock_terms(short).first().safety_stock == 0.0


def test_decision_prefers_order_when_waiting_costs_more(spark):
    df = one(spark, annual_demand=3650.0, sd_daily=4.0, lead=9, current_stock=95, unit_cost=8.0, unit_price=60.0,
             unit_margin=52.0, predicted_demand=500.0)
    r = decision.order_decision(df).first()
    p = 1 - 0.5 * (1 + math.erf(((95 - r.reorder_point) / 12) / math.sqrt(2)))
    assert r.cost_to_order == 0 and r.cost_to_wait == pytest.approx(p * 500 * 52 * 0.4, rel=1e-5)
    assert r.decision == "ORDER NOW"


def test_markdown_grid(spark):
    df = one(spark, current_stock=100, monthly=60.0, unit_price=20.0, unit_cost=10.0, daily_holding=0.01, category="Electronics")
    rows = {r.step: r for r in decision.markdown_scenarios(df).collect()}
    assert rows[0].units_sold == 60 and rows[0].revenue == 1200.0 and rows[0].revenue_vs_idle == 0
    assert rows[1].units_sold == int(2 * (1 + 1.8 * 0.1) * 14)
    assert decision.best_markdown(decision.markdown_scenarios(df)).count() == 1


def test_trend_needs_significance(spark):
    up = [(1, i, 10 + 2 * i) for i in range(10)] + [(2, i, 10 + (-1) ** i) for i in range(10)] + [(3, i, 5) for i in range(3)]
    got = {r.product_id: r.trend for r in decision.demand_trend(spark.createDataFrame(up, "product_id long, i int, qty long")).collect()}
    assert got == {1: "RISING", 2: "STABLE", 3: "UNKNOWN"}


def test_abc_crossing_row_is_b_and_single_row_is_c(spark):
    df = spark.createDataFrame([(1, 70), (2, 20), (3, 10)], "product_id long, v int").withColumn("v", F.col("v").cast("decimal(28,4)"))
    assert {r.product_id: r.abc_class for r in classify.abc_by_value(df, "v").collect()} == {1: "A", 2: "B", 3: "C"}
    assert classify.abc_by_value(df.filter("product_id = 1"), "v").first().abc_class == "C"


def test_active_days_equal_a_distinct_count(spark):
    rows = [(1 + i % 3, AS_OF - dt.timedelta(days=(i * i) % 200), 1 + i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "product_id long, date date, quantity_sold int")
    for days in (30, 90, 199):
        got = {r.product_id: (r.active_days, r.total_qty) for r in demand.transaction_stats(df, AS_OF, days).collect()}
        for p in got:
            kept = [r for r in rows if r[0] == p and (AS_OF - r[1]).days <= days]
            assert got[p] == (len({r[1] for r in kept}), sum(r[2] for r in kept))


def test_restock_adds_repeated_lines(spark):
    p = spark.createDataFrame([(1, "a", 5), (2, "b", 0)], "product_id long, sku string, current_stock int")
    r = spark.createDataFrame([("a", 3), ("a", 4), ("x", 1)], "sku string, restock_quantity int")
    assert {x.sku: x.current_stock for x in inventory.restock_apply(p, r).collect()} == {"a": 12, "b": 0}
    assert {x.sku: x.outcome for x in inventory.restock_preview(p, r).collect()} == {"a": "HIGH", "x": "NOT_FOUND"}
