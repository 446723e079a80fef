"""Order decisions, service-level grids, risk profiles, finance, markdown and what-if.

Grids (service levels, profiles, discounts, scenarios) are short literal lists: each
product row is exploded over the list in place, so no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.mathx import norm_cdf, or_default, ratio, t_passes, truncate, z_value
from granary.operators.policy import HOLDING_RATE, ORDER_COST, lead_time


def annual_inputs(products: DataFrame, stats: DataFrame) -> DataFrame:
    """Catalogue joined with demand per active day scaled to a year."""
    rate = F.col("total_qty").cast("double") / F.col("active_days") * 365
    shaped = stats.select(
        "product_id", rate.alias("annual_demand"), F.coalesce("sd_daily", F.lit(0.0)).alias("sd_daily"),
        (F.col("total_qty").cast("double") / F.col("active_days")).alias("mean_daily"))
    return products.join(shaped, "product_id").withColumns({
        "lead": lead_time(), "unit_margin": F.col("unit_price") - F.col("unit_cost")})


def explode_grid(df: DataFrame, rows: list[tuple], fields: list[str]) -> DataFrame:
    """Repeat every row once per literal grid row, adding the grid's columns."""
    grid = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, row)]) for row in rows])
    return df.select("*", F.explode(grid).alias("_g")).select("*", *[F.col(f"_g.{f}").alias(f) for f in fields]).drop("_g")


def lot_size(annual: Column, hold: Column) -> Column:
    return F.when(hold > 0, F.sqrt(2.0 * annual * ORDER_COST / hold)).otherwise(annual / 12)


# ---- order now or wait -----------------------------------------------------

def order_decision(df: DataFrame, service_level: float = 0.95, stockout_share: float = 0.4) -> DataFrame:
    """Compare the cost of ordering with the expected cost of waiting."""
    z = z_value(service_level)
    D, sd, lead, stock = F.col("annual_demand"), F.col("sd_daily"), F.col("lead"), F.col("current_stock")
    hold = F.col("unit_cost") * HOLDING_RATE
    df = df.withColumns({
        "daily": D / 365, "_lot": lot_size(D, hold), "safety_stock": F.lit(z) * sd * F.sqrt(lead)})
    df = df.withColumn("reorder_point", F.col("daily") * lead + F.col("safety_stock"))
    short = F.greatest(F.lit(0.0), F.col("reorder_point") - stock)
    df = df.withColumn("_qty", F.when(short < F.col("_lot") * 0.5, 0.0).otherwise(F.greatest(F.col("_lot"), short)))
    q = F.col("_qty")
    z_now = ratio(stock - F.col("reorder_point"), sd * F.sqrt(lead))
    chance = F.when((q > 0) | (sd <= 0), 0.0).otherwise(1.0 - norm_cdf(z_now))
    df = df.withColumns({
        "stockout_probability": chance,
        "cost_to_order": F.when(q > 0, q / 2 * hold + ORDER_COST).otherwise(0.0)})
    wait = F.col("stockout_probability") * (F.col("predicted_demand") * F.col("unit_margin") * stockout_share)
    df = df.withColumn("cost_to_wait", wait)
    now = F.col("cost_to_wait") > F.col("cost_to_order")
    saved = F.when(now, F.col("cost_to_wait") - F.col("cost_to_order")).otherwise(0.0)
    df = df.withColumns({
        "decision": F.when(now, "ORDER NOW").otherwise("WAIT/MONITOR"),
        "order_quantity": F.when(now, F.round(q)).otherwise(0.0),
        "net_savings": saved,
        "roi_percent": F.when(now, saved / (F.col("cost_to_order") + 1) * 100).otherwise(0.0),
        "cash_impact": q * F.col("unit_cost"),
        "projected_service_level": F.when(q == 0, 1.0 - F.col("stockout_probability")).otherwise(service_level) * 100,
        "days_of_stock": F.when(F.col("daily") > 0, stock / F.col("daily")).otherwise(999.0),
        "days_after_order": F.when(F.col("daily") > 0, (stock + q) / F.col("daily")).otherwise(999.0),
    })
    return df.drop("_lot", "_qty", "daily")


def approval_level(decision: Column, savings: Column, cash: Column) -> Column:
    return (
        F.when(decision == "WAIT/MONITOR", "NONE").when(savings > 5000, "AUTO_APPROVED")
        .when(cash > 50000, "FINANCE_REVIEW").otherwise("MANAGER_REVIEW")
    )


SERVICE_LEVELS = (0.85, 0.90, 0.95, 0.99)


def service_level_grid(df: DataFrame, levels=SERVICE_LEVELS) -> DataFrame:
    """Cost of every service level per product; the cheapest level is marked."""
    g = explode_grid(df, [(lv, z_value(lv)) for lv in levels], ["service_level", "z"])
    ss = F.col("z") * F.col("sd_daily") * F.sqrt("lead")
    g = g.withColumn("safety_stock", ss).withColumns({
        "annual_holding": F.col("safety_stock") / 2 * (F.col("unit_cost") * HOLDING_RATE),
        "lost_margin": F.col("annual_demand") * (1.0 - F.col("service_level")) * 0.01 * F.col("unit_margin"),
        "working_capital": (F.col("current_stock") + F.col("safety_stock")) * F.col("unit_cost"),
    }).withColumn("total_cost", F.round(F.col("annual_holding") + F.col("lost_margin"), 2))
    # Four rows per product: the window is as wide as the grid.
    w = Window.partitionBy("product_id")
    best = F.min(F.struct("total_cost", "service_level")).over(w)
    return g.withColumns({
        "is_optimal": F.col("service_level") == best["service_level"],
        "cost_range": F.max("total_cost").over(w) - F.min("total_cost").over(w),
    })


def decision_impact(df: DataFrame, service_level: float = 0.95) -> DataFrame:
    """Past yearly cost of stockouts and waste against the proposed policy."""
    m = F.col("unit_margin")
    past = F.col("past_stockouts") * m * 100
    after = F.greatest(F.lit(0), truncate(F.col("past_stockouts") * (1 - service_level)))
    hold = F.col("order_quantity") / 2 * F.col("unit_cost") * 0.25 / 12
    return df.withColumns({
        "past_cost": past + F.col("holding_waste"), "projected_stockouts": after,
        "projected_cost": after * m * 100 + hold,
    }).withColumn("annual_savings", F.col("past_cost") - F.col("projected_cost")).withColumns({
        "savings_pct": F.col("annual_savings") / (F.col("past_cost") + 1) * 100,
        "stockout_reduction": F.col("past_stockouts") - F.col("projected_stockouts"),
        "payback_days": F.when(F.col("annual_savings") > 0, 14).otherwise(0),
        "three_year": F.col("annual_savings") * 3,
    })


# ---- risk profiles ---------------------------------------------------------

# Score per customer criticality, and target service level per profile.
CRITICALITY = {"critical": 100, "important": 70, "standard": 50, "seasonal": 30}
PROFILES = {"CONSERVATIVE": 0.99, "BALANCED": 0.95, "AGGRESSIVE": 0.90}


def risk_profile(df: DataFrame) -> DataFrame:
    """Weighted score of criticality, volatility, margin and life span, and its profile."""
    table = F.create_map(*[F.lit(x) for kv in CRITICALITY.items() for x in kv])
    crit = F.coalesce(table[F.col("criticality")], F.lit(50))
    vol = F.least(F.lit(100.0), F.col("volatility") * 100)
    margin = F.least(F.lit(100.0), F.col("margin_share") * 100)
    life = F.when(F.col("lifespan_months") < 3, 30).when(F.col("lifespan_months") < 12, 50).otherwise(80)
    df = df.withColumn("score", crit * 0.4 + vol * 0.3 + margin * 0.2 + life * 0.1)
    s = F.col("score")
    profile = F.when(s >= 70, "CONSERVATIVE").when(s >= 50, "BALANCED").otherwise("AGGRESSIVE")
    target = F.when(s >= 70, 0.99).when(s >= 50, 0.95).otherwise(0.90)
    return df.withColumns({
        "profile": profile,
        "target_service_level": (target + F.when(F.col("supplier_reliability") < 85, 0.02).otherwise(0.0)) * 100,
    })


def profile_plan(df: DataFrame, lead_variance: float = 0.0) -> DataFrame:
    """Inventory plan for the profile and ``z`` in each row."""
    D, sd = F.col("annual_demand"), F.col("sd_daily")
    lead = F.col("lead") * (1.0 + lead_variance)
    hold = F.col("unit_cost") * HOLDING_RATE
    df = df.withColumns({
        "safety_stock": F.col("z") * sd * F.sqrt(lead), "eoq": lot_size(D, hold), "daily": D / 365})
    ss, eoq = F.col("safety_stock"), F.col("eoq")
    df = df.withColumns({
        "reorder_point": F.col("daily") * lead + ss, "avg_inventory": ss + eoq / 2,
        "annual_cost": ratio(D, eoq, 0.0) * ORDER_COST + (ss + eoq / 2) * hold,
        "lost_margin": D * (1.0 - F.col("service_level")) * 0.01 * F.col("unit_margin"),
    })
    rop, stock = F.col("reorder_point"), F.col("current_stock")
    return df.withColumns({
        "max_inventory": rop + eoq,
        "avg_inventory_value": F.col("avg_inventory") * F.col("unit_cost"),
        "turnover": D / F.greatest(F.lit(1.0), F.col("avg_inventory")),
        "inventory_days": F.when(F.col("daily") > 0, F.col("avg_inventory") / F.col("daily")).otherwise(0.0),
        "order_recommendation": F.when(stock < rop, "ORDER").otherwise("HOLD"),
        "order_quantity": F.when(stock < rop, F.round(F.greatest(rop - stock, eoq))).otherwise(0.0),
    })


def with_profile_target(df: DataFrame) -> DataFrame:
    level = F.create_map(*[F.lit(x) for kv in PROFILES.items() for x in kv])
    z = F.create_map(*[F.lit(x) for k, v in PROFILES.items() for x in (k, z_value(v))])
    return df.withColumns({"service_level": level[F.col("profile")], "z": z[F.col("profile")]})


def compare_profiles(df: DataFrame) -> DataFrame:
    """All profiles per product with differences to BALANCED; the cheapest is marked."""
    rows = [(k, v, z_value(v)) for k, v in PROFILES.items()]
    g = profile_plan(explode_grid(df.withColumn("current_stock", F.lit(0)), rows, ["profile", "service_level", "z"]))
    g = g.withColumns({
        "total_cost": F.round("annual_cost", 2) + F.round("lost_margin", 2),
        "value": F.round("avg_inventory_value", 2)})
    w = Window.partitionBy("product_id")

    def base(c: str) -> Column:
        return F.max(F.when(F.col("profile") == "BALANCED", F.col(c))).over(w)

    best = F.min(F.struct("total_cost", (-F.col("service_level")).alias("k"), "profile")).over(w)
    return g.withColumns({
        "cost_vs_balanced": F.col("total_cost") - base("total_cost"),
        "capital_vs_balanced": F.col("value") - base("value"),
        "is_cheapest": F.col("profile") == best["profile"],
    })


# ---- finance ---------------------------------------------------------------

def decision_story(df: DataFrame, cogs: float = 0.4, capital: float = 0.08,
                   stockout_pct: float = 2.0) -> DataFrame:
    """Margin at risk before and after, working capital, carrying cost and payback."""
    D, price, cost, qty = (F.col(c) for c in ("annual_demand", "unit_price", "unit_cost", "order_quantity"))
    before = D * (stockout_pct / 100) * 0.01 * price * (1 - cogs)
    after = D * (1.0 - F.col("service_level")) * 0.01 * price * (1 - cogs)
    wc = qty * cost
    avg = (F.col("current_stock") * 2 + qty) / 2
    df = df.withColumns({
        "margin_at_risk_before": before, "margin_at_risk_after": after, "margin_saved": before - after,
        "working_capital_added": wc, "capital_cost": wc * capital, "carrying_cost": avg * cost * 0.25,
    })
    df = df.withColumn(
        "net_benefit", F.col("margin_saved") - (F.col("capital_cost") + F.col("carrying_cost")))
    net = F.col("net_benefit")
    return df.withColumns({
        "payback_days": F.when(net > 0, F.col("working_capital_added") / F.greatest(F.lit(1.0), net) * 365).otherwise(999.0),
        "roi_percent": F.when(F.col("working_capital_added") > 0,
                              net / F.greatest(F.lit(1.0), F.col("working_capital_added")) * 100).otherwise(0.0),
        "three_year": net * 3,
        "net_per_unit": net / F.greatest(F.lit(1.0), D),
    })


def finance_verdict(net: Column, payback: Column) -> dict[str, Column]:
    return {
        "verdict": F.when(net < 0, "NOT_RECOMMENDED").when(payback > 365, "REVIEW")
        .when(payback > 180, "APPROVE").when(payback > 90, "RECOMMEND").otherwise("HIGH_PRIORITY"),
        "headline": F.when(net > 100000, "LARGE_SAVING").when(net > 10000, "VALUE").otherwise("MARGINAL"),
    }


def portfolio_rows(products: DataFrame, revenue: DataFrame) -> DataFrame:
    wc = F.col("current_stock") * F.col("unit_cost")
    return products.join(revenue, "product_id").select(
        "product_id", "name", (F.col("revenue") * 0.05).alias("margin_saved"), wc.alias("wc_required"),
        (wc * 0.25).alias("carrying_cost"))


def portfolio_impact(rows: DataFrame, annual_revenue: Column) -> DataFrame:
    out = rows.agg(
        F.count(F.lit(1)).alias("products"), F.sum("margin_saved").alias("margin_saved"),
        F.sum("wc_required").alias("wc_required"), F.sum("carrying_cost").alias("carrying_cost"))
    net = F.col("margin_saved") - F.col("wc_required") - F.col("carrying_cost")
    return out.withColumn("annual_revenue", annual_revenue).withColumn("net_benefit", net).withColumn(
        "benefit_pct", ratio(F.col("net_benefit"), F.col("annual_revenue"), 0.0) * 100)


# ---- markdown --------------------------------------------------------------

# Price elasticity per category; anything else uses the last one.
ELASTICITY = {
    "Electronics": -1.8, "Pet Supplies": -1.2, "Office Supplies": -1.4, "Toys & Games": -1.6,
    "Sports & Outdoors": -1.5, "Automotive": -1.1, "Books & Media": -1.7, "Garden & Outdoor": -1.3,
    "Home & Kitchen": -1.4, "Baby Products": -0.9, "Clothing": -1.6, "Health & Beauty": -1.3,
    "general": -1.5,
}

DISCOUNTS = (0.10, 0.15, 0.20, 0.25, 0.30)


def demand_trend(last: DataFrame, min_rows: int = 7) -> DataFrame:
    """Trend of the last daily values (``i`` ascending from 0, ``qty``) per product."""
    i, q = F.col("i").cast("bigint"), F.col("qty").cast("bigint")
    g = last.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(i).alias("sx"), F.sum(q).alias("sy"),
        F.sum(i * q).alias("sxy"), F.sum(i * i).alias("sxx"), F.sum(q * q).alias("syy"))
    n = F.col("n")
    cov = (n * F.col("sxy") - F.col("sx") * F.col("sy")).cast("double")
    vx = (n * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double")
    vy = (n * F.col("syy") - F.col("sy") * F.col("sy")).cast("double")
    g = g.withColumns({"slope": ratio(cov, vx, 0.0), "r2": ratio(cov * cov, vx * vy, 0.0)})
    r2 = F.col("r2")
    strong = t_passes(r2, n)
    s = F.col("slope")
    trend = (
        F.when(n < min_rows, "UNKNOWN").when(strong & (s > 0.1), "RISING")
        .when(strong & (s < -0.1), "FALLING").otherwise("STABLE")
    )
    return g.select(
        "product_id", "n",
        F.when(n >= min_rows, s).otherwise(0.0).alias("slope"),
        F.when(n >= min_rows, r2).otherwise(0.0).alias("r2"), trend.alias("trend"),
        F.when(trend == "RISING", 1.2).when(trend == "FALLING", 0.8).otherwise(1.0).alias("multiplier"))


def velocity(daily: Column, category_mean: Column | float = 10.0) -> dict[str, Column]:
    rel = daily / ((category_mean if isinstance(category_mean, Column) else F.lit(category_mean)) + 0.1)
    score = F.least(F.lit(100), F.greatest(F.lit(0), truncate(100.0 * (1.0 - F.exp(-rel)))))
    band = F.when(score >= 70, "FAST_MOVER").when(score >= 40, "MODERATE").when(score >= 20, "SLOW").otherwise("STAGNANT")
    return {"velocity_score": score, "velocity_status": band, "relative_velocity": rel}


def elasticity(price: Column, cost: Column, category: Column) -> dict[str, Column]:
    table = F.create_map(*[F.lit(x) for kv in ELASTICITY.items() for x in kv])
    base = F.coalesce(table[category], F.lit(ELASTICITY["general"]))
    margin = F.when(price > 0, (price - cost) / price).otherwise(0.3)
    value = F.when(margin > 0.5, base * 1.2).when(margin < 0.2, base * 0.8).otherwise(base)
    return {"margin": margin, "elasticity_raw": value, "elasticity": F.round(value, 2),
            "elasticity_type": F.when(F.abs(value) > 1, "ELASTIC").otherwise("INELASTIC")}


def discount_range(e: Column, margin: Column) -> dict[str, Column]:
    a = F.abs(e)
    theory = F.when(a > 0, (a - 1.0) / (2.0 * a)).otherwise(0.1)
    high = F.least(margin * 0.8, F.lit(0.4))
    low = F.greatest(F.lit(0.05), theory * 0.5)
    best = F.least(high, F.greatest(low, theory))
    return {"min_discount": F.bround(low * 100).cast("int"), "max_discount": F.bround(high * 100).cast("int"),
            "optimal_discount": F.bround(best * 100).cast("int")}


def markdown_inputs(products: DataFrame, stats: DataFrame) -> DataFrame:
    """Monthly demand over the span of the history, and a tenth of a percent daily holding."""
    rate = F.col("total_qty").cast("double") / (F.col("span_days") + 1)
    s = stats.select("product_id", rate.alias("daily_span"), (rate * 30).alias("monthly"))
    return products.join(s, "product_id").withColumn("daily_holding", F.col("unit_cost") * 0.001)


def coverage_health(stock: Column, monthly: Column) -> dict[str, Column]:
    cover = stock / (monthly + 0.1)
    return {
        "monthly_coverage": cover, "health_days": stock / (monthly / 30 + 0.1),
        "health": F.when(cover < 1, "HEALTHY").when(cover < 2, "SLOW_MOVING").when(cover < 3, "AT_RISK").otherwise("CRITICAL"),
        "risk_level": F.when(cover < 1, 1).when(cover < 2, 2).when(cover < 3, 3).otherwise(4),
    }


def urgency_score(days: Column, score: Column, e: Column, margin: Column) -> Column:
    stock_part = F.when(days > 90, 40).when(days > 60, 30).when(days > 30, 20).when(days > 14, 10).otherwise(0)
    total = (stock_part + (30 - score * 0.3) + F.least(F.lit(20.0), F.abs(e) * 10)
             + F.least(F.lit(10.0), margin * 20))
    return F.least(F.lit(100), F.greatest(F.lit(0), truncate(total)))


def markdown_timing(df: DataFrame, trend_multiplier: Column | None = None, by_category: bool = False) -> DataFrame:
    """When to start a markdown: urgency from stock age, velocity, elasticity and margin."""
    daily0 = F.col("monthly") / 30
    daily = daily0 if trend_multiplier is None else daily0 * trend_multiplier
    stock = F.col("current_stock")
    df = df.withColumns({
        "daily_demand": daily, "days_of_inventory": stock / (daily + 0.1),
        "holding_cost_today": stock * F.col("daily_holding") * (stock / (daily0 + 0.1)),
    })
    df = df.withColumns(velocity(F.col("daily_demand")))
    df = df.withColumns(elasticity(
        F.col("unit_price"), F.col("unit_cost"), F.col("category") if by_category else F.lit("general")))
    df = df.withColumns(discount_range(F.col("elasticity_raw"), F.col("margin")))
    df = df.withColumn("urgency_score", urgency_score(
        F.col("days_of_inventory"), F.col("velocity_score"), F.col("elasticity"), F.col("margin")))
    u = F.col("urgency_score")
    return df.withColumns({
        "urgency": F.when(u >= 80, "IMMEDIATE").when(u >= 60, "URGENT").when(u >= 40, "HIGH")
        .when(u >= 20, "MEDIUM").otherwise("LOW"),
        "days_until_markdown": F.when(u >= 80, 0).when(u >= 60, 3).when(u >= 40, 7).when(u >= 20, 14).otherwise(21),
    })


def markdown_scenarios(df: DataFrame, duration: int = 14, discounts=DISCOUNTS) -> DataFrame:
    """Every discount step next to doing nothing, per product."""
    df = df.withColumns(elasticity(F.col("unit_price"), F.col("unit_cost"), F.col("category")))
    g = explode_grid(df, [(i, d) for i, d in enumerate((0.0, *discounts))], ["step", "discount"])
    stock, price, cost = F.col("current_stock"), F.col("unit_price"), F.col("unit_cost")
    daily, disc = F.col("monthly") / 30, F.col("discount")
    lift = F.least(F.lit(3.0), 1.0 + F.abs("elasticity") * disc)
    idle = F.col("step") == 0
    sold_idle = F.least(daily * 30, stock.cast("double"))
    sold_off = truncate(F.least(daily * lift * duration, stock.cast("double")))
    g = g.withColumns({
        "markdown_price": price * (1.0 - disc), "lift": F.when(idle, 1.0).otherwise(lift),
        "_sold": F.when(idle, sold_idle).otherwise(sold_off.cast("double"))})
    s = F.col("_sold")
    revenue = F.when(idle, s * price).otherwise(
        s * F.col("markdown_price") + (stock - s) * price * (30 - duration) / 30)
    g = g.withColumns({
        "units_sold": truncate(s), "units_remaining": truncate(stock - s), "revenue": revenue,
        "cleared_pct": F.when(stock > 0, s / stock * 100).otherwise(0.0),
    })
    g = g.withColumn("net_profit", F.col("revenue") - stock * cost - stock * F.col("daily_holding") * 30)
    w = Window.partitionBy("product_id")  # six rows
    base = F.max(F.when(idle, F.struct("revenue", "net_profit"))).over(w)
    return g.withColumns({
        "margin_pct": F.when(F.col("revenue") > 0, F.col("net_profit") / F.col("revenue") * 100).otherwise(0.0),
        "revenue_vs_idle": F.col("revenue") - base["revenue"],
        "profit_vs_idle": F.col("net_profit") - base["net_profit"],
    }).drop("_sold")


def best_markdown(scenarios: DataFrame) -> DataFrame:
    """Scenario with the highest profit (to the cent); ties keep the smaller discount."""
    pick = F.max_by(
        F.struct("step", "discount", "markdown_price", "units_sold", "cleared_pct", "revenue_vs_idle", "profit_vs_idle"),
        F.struct(F.round("net_profit", 2), -F.col("step")))
    return scenarios.groupBy("product_id").agg(pick.alias("b")).select("product_id", "b.*")


# ---- what-if ---------------------------------------------------------------

def cents(x: Column) -> Column:
    """Differences of large amounts in cents; a millionth settles exact half cents."""
    return F.round(x + 1e-6, 2)


def price_change(df: DataFrame, changes, price_elasticity: float = -1.2, cogs: float = 0.4) -> DataFrame:
    g = explode_grid(df, [(float(c),) for c in changes], ["change_pct"])
    c = F.col("change_pct")
    price, dem = F.col("unit_price"), F.col("annual_demand")
    g = g.withColumns({
        "new_price": price * (1.0 + c / 100), "new_demand": dem * (1.0 + price_elasticity * c / 100)})
    r0, r1 = price * dem, F.col("new_price") * F.col("new_demand")
    g = g.withColumns({
        "new_revenue": r1, "revenue_change": cents(r1 - r0),
        "revenue_change_pct": F.when(r0 > 0, (r1 - r0) / r0 * 100).otherwise(0.0),
        "margin_change": cents((r1 - r0) * (1 - cogs)),
        "margin_change_pct": F.when(r0 > 0, (r1 / r0 - 1.0) * 100).otherwise(0.0),
    })
    rp, mc = F.col("revenue_change_pct"), F.col("margin_change")
    return g.withColumn("verdict", F.when((rp > 5) & (mc > 0), "RECOMMENDED").when((rp > 0) & (mc > 0), "GOOD")
                        .when(mc > 0, "CAUTION").otherwise("NOT_RECOMMENDED"))


def demand_shift(df: DataFrame, shifts) -> DataFrame:
    """Needs ``annual_demand``, ``daily``, ``eoq``, ``reorder_point``, ``safety_stock``."""
    g = explode_grid(df, [(float(s),) for s in shifts], ["shift_pct"])
    f = 1.0 + F.col("shift_pct") / 100
    cost = F.col("unit_cost")
    g = g.withColumns({
        "new_demand": F.col("annual_demand") * f, "new_daily": F.col("daily") * f,
        "new_rop": F.col("reorder_point") * f,
        "new_safety_stock": F.col("safety_stock") * (1.0 + F.abs("shift_pct") / 100)})
    g = g.withColumn("new_eoq", F.sqrt(ratio(2.0 * F.col("new_demand") * ORDER_COST, cost * HOLDING_RATE, 0.0)))
    g = g.withColumn("new_avg_inventory", F.col("new_eoq") / 2 + F.col("new_safety_stock"))
    g = g.withColumn("inventory_change",
                     F.col("new_avg_inventory") - (F.col("eoq") / 2 + F.col("safety_stock")))
    g = g.withColumns({
        "cost_impact": F.col("inventory_change") * cost * 0.25,
        "days_of_inventory": F.when(F.col("new_daily") > 0, F.col("new_avg_inventory") / F.col("new_daily")).otherwise(999.0)})
    days, ic = F.col("days_of_inventory"), F.col("inventory_change")
    return g.withColumns({
        "stockout_risk": F.when(days < 5, "HIGH").when(days < 15, "MEDIUM").otherwise("LOW"),
        "verdict": F.when((ic < 0) & (F.col("cost_impact") < 0), "FAVORABLE")
        .when((ic > 0) & (F.col("cost_impact") > 100), "PLAN_AHEAD").when(ic > 0, "MONITOR").otherwise("STATUS_QUO"),
    })


def supplier_switch(df: DataFrame, transition: float = 5000.0, z: float = 1.645, hold: float = 5.0) -> DataFrame:
    """Needs the offer columns ``new_cost``, ``new_lead``, ``reliability``, ``new_reliability``."""
    D = F.col("annual_demand")
    ss = D * 0.2 / 365 * (F.sqrt(F.greatest(F.lit(1), F.col("new_lead"))) - F.sqrt("lead")) * z
    df = df.withColumns({
        "annual_cost_change": (F.col("new_cost") - F.col("unit_cost")) * D,
        "safety_cost_impact": ss * hold,
        "reliability_change": F.col("new_reliability") - F.col("reliability")})
    total = F.col("annual_cost_change") + F.col("safety_cost_impact")
    df = df.withColumn("total_impact", total).withColumn(
        "payback_months", F.when(F.col("total_impact") != 0, transition / F.abs("total_impact") * 12).otherwise(0.0))
    t, r = F.col("total_impact"), F.col("reliability_change")
    return df.withColumn("verdict", (
        F.when((t > 5000) & (F.col("payback_months") < 12) & (r >= 0), "STRONGLY_RECOMMENDED")
        .when((t > 2000) & (r >= -0.05), "RECOMMENDED").when((t > 0) & (r >= -0.1), "CONSIDER")
        .when(r > 0.1, "REVIEW").otherwise("NOT_RECOMMENDED")))


def scenario_matrix(scenarios: DataFrame) -> DataFrame:
    """Best scenario per product by revenue, margin, cost and weighted score."""
    z = F.lit(0.0)
    score = (F.coalesce("revenue_change_pct", z) * 0.4 + F.coalesce("margin_change_pct", z) * 0.4
             - F.coalesce("annual_cost_change", z) / 1000 * 0.2)

    def first(value: Column) -> Column:
        return F.max_by("scenario", F.struct(F.round(value, 4), -F.col("position")))

    return scenarios.groupBy("product_id").agg(
        first(F.coalesce("new_revenue", z)).alias("best_revenue"),
        first(F.coalesce("margin_change", z)).alias("best_margin"),
        first(-F.coalesce("annual_cost_change", z)).alias("best_cost"),
        first(score).alias("recommended"))


# ---- demand signals --------------------------------------------------------

# Demand multiplier of the holidays, by month and day.
HOLIDAYS = {"01-01": 1.3, "02-14": 1.5, "07-04": 1.2, "11-25": 2.5, "12-25": 3.0}


def signal_factors(date: Column) -> dict[str, Column]:
    """Season, holiday, pay-day and weekend multipliers of a calendar day."""
    m, d = F.month(date), F.dayofmonth(date)
    table = F.create_map(*[F.lit(x) for kv in HOLIDAYS.items() for x in kv])
    return {
        "weather": F.when(m.isin(6, 7, 8), 1.5).when(m.isin(12, 1, 2), 1.8).otherwise(1.0),
        "holiday": F.coalesce(table[F.date_format(date, "MM-dd")], F.lit(1.0)),
        "payday": F.when(d.isin(15, 30), 1.3).otherwise(1.0),
        "weekend": F.when(F.weekday(date) >= 5, 1.5).otherwise(1.0),
    }


def combined_signal(df: DataFrame, trends: DataFrame | None = None) -> DataFrame:
    """Product of all factors; ``trends`` may add a (product_id, date, trend) boost."""
    df = df.withColumns(signal_factors(F.col("date")))
    factor = F.col("weather") * F.col("holiday") * F.col("payday") * F.col("weekend")
    if trends is None:
        return df.withColumn("multiplier", factor)
    return df.join(trends, ["product_id", "date"], "left").withColumn(
        "multiplier", factor * F.coalesce(F.col("trend"), F.lit(1.0)))
