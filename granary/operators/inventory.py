"""Reorder points, stockout loss, live alerts, advisor rules and restocking."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.mathx import half_up, or_default, ratio, truncate
from granary.operators.demand import daily_rate, daily_stats, daily_totals, row_average, since
from granary.operators.policy import compact_policy, lead_time
from granary.operators.series_terms import slope

ID = ("product_id", "sku", "name", "category", "current_stock")


# ---- integer reorder point and risk ---------------------------------------

def integer_reorder(products: DataFrame, sales: DataFrame, as_of: dt.date, days: int = 30,
                    z: float = 1.65) -> DataFrame:
    """Whole-unit demand, safety stock and reorder point; one unit a day at least."""
    stats = daily_stats(sales, as_of, days).select(
        "product_id", daily_rate("fixed", days).alias("_d"), "sd_daily",
        (F.col("total_qty").cast("double") / days).alias("_rate"))
    df = products.join(stats, "product_id", "left").withColumns({
        "demand": F.coalesce(F.col("_d"), F.lit(1.0)),
        "rate": F.coalesce(F.col("_rate"), F.lit(0.0)),
        "lead": lead_time(),
    })
    ss = F.greatest(F.lit(z) * F.coalesce(F.col("sd_daily"), F.lit(0.0)) * F.sqrt("lead"), F.col("demand"))
    df = df.withColumn("_ss", ss).withColumn("_rop", F.col("demand") * F.col("lead") + F.col("_ss"))
    return df.withColumns({
        "reorder_point": F.ceil("_rop").cast("int"),
        "safety_stock": F.ceil("_ss").cast("int"),
        "average_daily_demand": F.col("demand").cast("int"),
        "status": F.when(F.col("current_stock") > F.col("_rop"), "NORMAL").otherwise("REORDER_NEEDED"),
    }).drop("_d", "_rate", "_ss", "_rop")


def latest_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Newest row per key: one aggregate with map-side combine instead of a sort."""
    return df.groupBy(key).agg(
        F.max_by(F.struct(*columns), order).alias("_latest")).select(key, "_latest.*")


def banded_risk(reorder: DataFrame, latest_forecast: DataFrame, horizon: int = 7) -> DataFrame:
    """Stockout risk by days of cover, raised when the forecast runs above demand."""
    df = reorder.join(latest_forecast, "product_id", "left")
    d = F.col("demand")
    days = ratio(F.col("current_stock"), d)
    risk = (
        F.when(days <= horizon, F.least(F.lit(100.0), 100.0 - days / horizon * 80))
        .when(days <= horizon * 2, 30.0 + (horizon * 2 - days) / horizon * 40)
        .otherwise(F.greatest(F.lit(5.0), 30.0 * F.exp(-0.05 * (days - horizon * 2))))
    )
    level = F.when(days <= horizon, "HIGH").when(days <= horizon * 2, "MEDIUM").otherwise("LOW")
    spike = F.coalesce(F.col("predicted_demand") > d * 1.2, F.lit(False))
    return df.withColumns({
        "risk_level": F.when(spike, "HIGH").otherwise(level),
        "days_until_stockout": F.floor(days).cast("int"),
        "risk_percentage": half_up(F.when(spike, F.least(F.lit(100.0), risk + 20)).otherwise(risk)),
        "forecast_confidence": half_up(or_default(F.col("confidence_level"), 0.95) * 100),
    })


# ---- losses ---------------------------------------------------------------

def stockout_loss(products: DataFrame, sales: DataFrame, as_of: dt.date, days: int = 30,
                  min_days: int = 7, z: float = 1.65) -> DataFrame:
    """Lost profit of out-of-stock products from a one-step trend of recent days."""
    out = products.filter("current_stock = 0")
    recent = since(sales, as_of, days).join(out.select("product_id"), "product_id", "left_semi")
    per_day = recent.groupBy("product_id", "date").agg(
        F.sum("quantity_sold").alias("qty"), F.count(F.lit(1)).alias("n"))
    numbered = per_day.withColumn(
        "i", F.row_number().over(Window.partitionBy("product_id").orderBy("date")) - 1)
    q = F.col("qty")
    trend = numbered.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_days"),
        slope(F.col("i"), q).alias("slope"),
        F.max_by("qty", "date").alias("last_qty"),
        (F.sum(q).cast("double") / F.sum("n")).alias("row_avg"),
        F.sum(q).alias("s"), F.sum(q * q).alias("ss"),
    )
    n, mean = F.col("n_days"), F.col("s").cast("double") / F.col("n_days")
    sd = F.when(n >= 2, F.sqrt(F.greatest(F.lit(0.0), F.col("ss").cast("double") / n - mean * mean))).otherwise(0.0)
    df = out.join(trend, "product_id", "left").withColumns({
        "lead": lead_time(),
        "predicted": F.greatest(
            F.lit(1),
            F.when(n >= min_days, truncate(F.col("last_qty") + F.col("slope")))
            .otherwise(truncate(F.coalesce(F.col("row_avg"), F.lit(0.0))))),
        "sd": F.coalesce(sd, F.lit(0.0)),
        "unit_profit": F.col("unit_price") - F.col("unit_cost"),
    })
    loss = F.col("predicted") * F.col("unit_profit")
    qty = F.greatest(F.lit(1), truncate(F.col("predicted") * F.col("lead") + F.lit(z) * F.col("sd") * F.sqrt("lead")))
    return df.select(
        *ID[:-1], F.col("predicted").alias("predicted_daily_demand"), "unit_profit",
        (F.col("predicted") * F.col("unit_price")).alias("daily_revenue_loss"),
        loss.alias("daily_loss"), (loss * 7).alias("weekly_loss"), (loss * 30).alias("monthly_loss"),
        (loss * 365).alias("annual_loss"), qty.alias("order_quantity"),
        (qty * F.col("unit_cost")).alias("estimated_cost"),
    )


def dynamic_threshold(demand: Column, lead: Column, price: Column) -> Column:
    sd = F.when(demand > 0, demand * 0.3).otherwise(1.0)
    floor_ = F.least(F.greatest(F.lit(1), truncate(5000.0 / or_default(price, 10.0))), F.lit(50))
    return F.greatest(floor_.cast("double"), demand * lead + 1.28 * sd * F.sqrt(lead))


def with_row_demand(products: DataFrame, sales: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    return products.join(row_average(sales, as_of, days, "_d"), "product_id", "left").withColumns({
        "demand": or_default(F.col("_d"), 1.0), "lead": lead_time()}).drop("_d")


def low_stock_risk(products: DataFrame, sales: DataFrame, as_of: dt.date, days: int = 7,
                   top: int | None = None) -> DataFrame:
    df = with_row_demand(products.filter("current_stock > 0"), sales, as_of, days)
    d, lead, stock = F.col("demand"), F.col("lead"), F.col("current_stock")
    df = df.withColumn("threshold", dynamic_threshold(d, lead, F.col("unit_price"))).filter(
        stock < F.col("threshold"))
    cover = truncate(ratio(stock, d))
    df = df.withColumns({"days_until_stockout": cover, "buffer_days": cover - lead})
    b = F.col("buffer_days")
    return df.select(
        *ID, truncate(F.col("threshold")).alias("threshold"), d.alias("daily_demand"),
        "days_until_stockout", "buffer_days",
        F.when(b <= 10, "LOW_WARNING").when(b <= 30, "MEDIUM").otherwise("HIGH").alias("urgency"),
        (d * (F.col("unit_price") - F.col("unit_cost"))).alias("potential_daily_loss"),
        (b <= 5).alias("send_alert"),
    ).transform(first_rows, top, "buffer_days", "product_id")


# ---- live alerts ----------------------------------------------------------

SEVERITY_ORDER = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
ALERT_TYPES = ("STOCKOUT", "LOW_STOCK", "MEDIUM_STOCK", "HIGH_STOCK")
# Rows of the alert report by type, and in all.
REPORT_CAPS = (30, 50, 30, 20)
REPORT_ROWS = 100


def first_rows(df: DataFrame, top: int | None, *order) -> DataFrame:
    """All rows, or the first ``top`` in order."""
    return df if top is None else df.orderBy(*order).limit(top)


def live_alerts(products: DataFrame, sales: DataFrame, as_of: dt.date, recent_days: int = 7,
                loss_days: int = 30) -> DataFrame:
    """All alerts of every stock tier.  One scan gives both demand windows."""
    windows = since(sales, as_of, max(recent_days, loss_days))
    edge = F.lit(as_of - dt.timedelta(days=recent_days))
    edge_loss = F.lit(as_of - dt.timedelta(days=loss_days))
    q = F.col("quantity_sold")

    def mean_if(cond: Column) -> Column:
        return F.sum(F.when(cond, q)).cast("double") / F.count(F.when(cond, q))

    rates = windows.groupBy("product_id").agg(
        mean_if(F.col("date") >= edge).alias("recent"),
        mean_if(F.col("date") >= edge_loss).alias("month"))
    stock = F.col("current_stock")
    df = products.join(rates, "product_id").withColumns({
        "lead": lead_time(),
        "demand": F.when(stock == 0, F.col("month")).otherwise(F.col("recent")),
        "margin": F.col("unit_price") - F.col("unit_cost"),
    }).filter(F.col("demand") > 0)
    d, lead = F.col("demand"), F.col("lead")
    cover = F.when(stock > 0, truncate(stock / d))
    df = df.withColumns({"days_until_stockout": cover, "buffer_days": cover - lead})
    b = F.col("buffer_days")
    kind = (
        F.when(stock == 0, "STOCKOUT").when(b <= 10, "LOW_STOCK")
        .when(b <= 30, "MEDIUM_STOCK").otherwise("HIGH_STOCK")
    )
    df = df.withColumn("type", kind)
    urgent = F.col("type").isin("STOCKOUT", "LOW_STOCK")
    loss = d * F.col("margin")
    qty = truncate(d * lead * 1.5)
    cost = qty * F.col("unit_cost")
    severity = F.create_map(*[F.lit(x) for x in (
        "STOCKOUT", "CRITICAL", "LOW_STOCK", "HIGH", "MEDIUM_STOCK", "MEDIUM", "HIGH_STOCK", "LOW")])
    level = F.create_map(*[F.lit(x) for x in (
        "STOCKOUT", "OUT_OF_STOCK", "LOW_STOCK", "LOW", "MEDIUM_STOCK", "MEDIUM", "HIGH_STOCK", "HIGH")])
    return df.select(
        *ID, "type", severity[F.col("type")].alias("severity"), level[F.col("type")].alias("stock_level"),
        "days_until_stockout", "buffer_days",
        F.when(urgent, half_up_signed(loss)).alias("loss_per_day"),
        F.when(urgent, qty).alias("recommended_quantity"),
        F.when(stock == 0, half_up_signed(cost)).when(urgent, truncate(cost)).alias("estimated_cost"),
        F.when(stock == 0, True).otherwise(F.coalesce(b <= 5, F.lit(False)) & urgent).alias("send_email"),
    )


def alert_report(alerts: DataFrame, caps: tuple[int, int, int, int] = REPORT_CAPS, limit: int = REPORT_ROWS) -> DataFrame:
    """The most pressing alerts, ``caps`` of each type; a grouped top-k, trimmed inside each task."""
    kind, b = F.col("type"), F.col("buffer_days")
    order = F.when(kind == "STOCKOUT", 0).when(kind == "HIGH_STOCK", -b).otherwise(b)
    w = Window.partitionBy("type").orderBy(order, "product_id")
    cap = F.create_map(*[F.lit(x) for k, v in zip(ALERT_TYPES, caps) for x in (k, v)])[kind]
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity"))
    df = alerts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max(caps)).filter(F.col("_rn") <= cap)
    return df.orderBy(rank, "_rn").limit(limit).drop("_rn")


def half_up_signed(x: Column) -> Column:
    return F.round(x).cast("int")


def alert_summary(alerts: DataFrame) -> DataFrame:
    sev = F.col("severity")
    hot = sev.isin("CRITICAL", "HIGH")
    daily = F.sum(F.when(hot, F.coalesce(F.col("loss_per_day"), F.lit(0))).otherwise(0))
    return alerts.agg(
        F.count_if(sev == "CRITICAL").alias("critical"), F.count_if(sev == "HIGH").alias("high"),
        F.count_if(hot | (sev == "WARNING")).alias("at_risk"), daily.alias("daily_risk"),
        (daily * 7).alias("weekly_risk"), (daily * 30).alias("monthly_risk"))


def out_of_stock_by_category(products: DataFrame) -> DataFrame:
    """Out-of-stock products with the size of their category's list.

    The list stays one row per product: a category may hold a third of the
    catalogue, so its names are never gathered into one value.
    """
    out = products.filter("current_stock = 0").select("product_id", "sku", "category")
    sizes = out.groupBy("category").agg(F.count(F.lit(1)).alias("category_count"))
    return out.join(sizes, "category")


# ---- advisor --------------------------------------------------------------

def recent_rows(sales: DataFrame, keep: int) -> DataFrame:
    """The last ``keep`` sales rows of every product, newest first.

    The rank filter becomes a grouped limit before the shuffle, so a hot product
    sends at most ``keep`` rows per task.
    """
    w = Window.partitionBy("product_id").orderBy(
        F.col("date").desc(), F.col("id").desc(), F.col("quantity_sold").desc())
    return sales.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)


def recent_shift(rows: DataFrame) -> DataFrame:
    """Mean of the last 15 rows against the 15 before, when there are at least 30."""
    q, rn = F.col("quantity_sold"), F.col("rn")
    return rows.groupBy("product_id").agg(
        F.max("rn").alias("n_rows"),
        (F.sum(F.when(rn <= 15, q)).cast("double") / 15).alias("recent"),
        (F.sum(F.when((rn > 15) & (rn <= 30), q)).cast("double") / 15).alias("previous"),
    )


def weekday_peak(rows: DataFrame) -> DataFrame:
    """Best and worst weekday mean per product (Monday = 0), ties to the earlier day."""
    per = rows.groupBy("product_id", F.weekday("date").alias("wd")).agg(
        (F.sum("quantity_sold").cast("double") / F.count(F.lit(1))).alias("m"))
    return per.groupBy("product_id").agg(
        F.max(F.struct("m", (-F.col("wd")).alias("k"))).alias("hi"),
        F.min(F.struct("m", F.col("wd").alias("k"))).alias("lo"),
    ).select("product_id", F.col("hi.m").alias("peak_mean"), (-F.col("hi.k")).alias("peak_day"),
             F.col("lo.m").alias("low_mean"), F.col("lo.k").alias("low_day"))


def advisor_rules(risk: DataFrame, shift: DataFrame, peaks: DataFrame) -> DataFrame:
    """One row per fired rule.  ``risk`` carries the integer policy and banded risk."""
    df = risk.join(shift, "product_id", "left").join(peaks, "product_id", "left")
    stock, rop, lead = F.col("current_stock"), F.col("reorder_point"), F.col("lead_time_days")
    margin = ratio(F.col("unit_price") - F.col("unit_cost"), F.col("unit_price")) * 100
    has = F.col("n_rows").isNotNull()
    up = (F.col("n_rows") >= 30) & (F.col("recent") > F.col("previous") * 1.2)
    down = (F.col("n_rows") >= 30) & (F.col("recent") < F.col("previous") * 0.8)

    def rule(cond: Column, name: str, kind: str, priority, value: Column) -> Column:
        p = priority if isinstance(priority, Column) else F.lit(priority)
        return F.when(cond, F.struct(F.lit(name).alias("rule"), F.lit(kind).alias("type"),
                                     p.alias("priority"), value.cast("double").alias("value")))

    fired = F.array_compact(F.array(
        rule(~has, "NO_HISTORY", "warning", "medium", F.lit(0.0)),
        rule(has & (stock <= rop), "REORDER", "action",
             F.when(F.col("risk_level") == "HIGH", "critical").otherwise("high"),
             rop * 2 * F.col("unit_cost")),
        rule(has & (F.col("risk_level") == "HIGH") & (stock > 0), "STOCKOUT_RISK", "warning", "critical",
             F.col("days_until_stockout")),
        rule(has & (stock > rop * 5), "OVERSTOCK", "info", "medium", stock * F.col("unit_cost") * 0.25),
        rule(has & (F.col("rate") < 1) & (stock > 100), "SLOW_MOVING", "action", "medium",
             stock * F.col("unit_price") * 0.7),
        rule(has & up, "DEMAND_UP", "success", "high", (ratio(F.col("recent"), F.col("previous")) - 1) * 100),
        rule(has & down, "DEMAND_DOWN", "warning", "medium", (1 - ratio(F.col("recent"), F.col("previous"))) * 100),
        rule(has & (margin < 20), "LOW_MARGIN", "warning", "medium", margin),
        rule(has & (margin > 60), "HIGH_MARGIN", "success", "low", margin),
        rule(has & (F.col("n_rows") >= 60) & (F.col("peak_mean") > F.col("low_mean") * 1.5),
             "WEEKDAY_PATTERN", "info", "low", F.col("peak_day")),
        rule(has & (lead > 14) & (stock < F.col("demand") * (lead + 7)), "LONG_LEAD", "warning", "high",
             F.col("demand") * (lead + 7)),
    ))
    return df.select("product_id", "sku", "category", F.explode(fired).alias("r")).select(
        "product_id", "sku", "category", "r.*")


def priority_rank(priority: Column) -> Column:
    order = F.array(*[F.lit(p) for p in ("critical", "high", "medium", "low")])
    return F.array_position(order, priority).cast("int")


def top_advice(rules: DataFrame, limit: int | None = None) -> DataFrame:
    urgent = rules.filter(F.col("priority").isin("critical", "high"))
    return first_rows(urgent, limit, priority_rank(F.col("priority")), "product_id", "rule")


# ---- exceptions -----------------------------------------------------------

def exposure(enriched: DataFrame) -> DataFrame:
    """Revenue at risk per product: chance of a stockout times a day's sales."""
    amount = F.col("risk_percentage") / 100.0 * F.col("demand_per_day") * F.col("unit_price")
    return enriched.select("product_id", "sku", "name", "current_stock",
                           F.round(amount, 0).alias("risk_amount"))


def critical_items(risks: DataFrame, confidence: DataFrame, low_confidence: float = 0.70,
                   high_risk: float = 1000.0) -> DataFrame:
    df = risks.join(confidence, "product_id", "left").withColumn(
        "confidence", F.coalesce(F.col("confidence_level"), F.lit(0.8)))
    issues = F.array_compact(F.array(
        F.when(F.col("confidence") < low_confidence, F.struct(F.lit("LOW_FORECAST_CONFIDENCE").alias("issue"), F.lit(1).alias("priority"))),
        F.when(F.col("risk_amount") > high_risk, F.struct(F.lit("HIGH_STOCKOUT_RISK").alias("issue"), F.lit(1).alias("priority"))),
        F.when((F.col("current_stock") < 50) & (F.col("risk_amount") > 500),
               F.struct(F.lit("CRITICAL_STOCK_LEVEL").alias("issue"), F.lit(0).alias("priority"))),
    ))
    return df.select("product_id", "sku", "current_stock", "risk_amount", "confidence",
                     F.explode(issues).alias("i")).select(
        "product_id", "sku", "current_stock", "risk_amount", "confidence", "i.issue", "i.priority")


def override_candidates(decisions: DataFrame, confidence: DataFrame, special: DataFrame) -> DataFrame:
    """Orders a planner should look at; ``special`` lists (product_id, condition)."""
    df = decisions.join(confidence, "product_id", "left").join(special, "product_id", "left").withColumn(
        "confidence", F.coalesce(F.col("confidence_level"), F.lit(0.8)))
    reasons = F.array_compact(F.array(
        F.when((F.col("decision") == "ORDER NOW") & (F.col("confidence") < 0.75),
               F.struct(F.lit("LOW_CONFIDENCE_HIGH_VALUE").alias("reason"), F.lit("MEDIUM").alias("severity"))),
        F.when(F.col("order_quantity") > 1000,
               F.struct(F.lit("LARGE_ORDER_REQUIRES_REVIEW").alias("reason"), F.lit("MEDIUM").alias("severity"))),
        F.when(F.col("condition").isNotNull(),
               F.struct(F.lit("SPECIAL_CONDITION_DETECTED").alias("reason"), F.lit("HIGH").alias("severity"))),
    ))
    return df.select("product_id", "decision", "order_quantity", "confidence", F.explode(reasons).alias("r")).select(
        "product_id", "decision", "order_quantity", "confidence", "r.reason", "r.severity")


def daily_exception_status(critical: DataFrame, high_risk: DataFrame, overrides: DataFrame) -> DataFrame:
    n_c = critical.agg(F.count(F.lit(1)).alias("critical_items"))
    n_h = high_risk.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_o = overrides.agg(F.count(F.lit(1)).alias("n")).scalar()
    c = F.col("critical_items")
    return n_c.withColumns({
        "high_risk_skus": n_h,
        "manual_reviews": n_o,
        "total_flagged": c + n_h + n_o,
        "status": F.when(c > 3, "RED").when(c > 0, "YELLOW").otherwise("GREEN"),
    })


# ---- explanations as numbers ----------------------------------------------

def reorder_explained(products: DataFrame, sales: DataFrame, as_of: dt.date, days: int = 7,
                      z: float = 1.645) -> DataFrame:
    q = F.col("quantity_sold").cast("bigint")
    n, s, ss = F.count(F.lit(1)), F.sum(q), F.sum(q * q)
    mean = s.cast("double") / n
    stats = since(sales, as_of, days).groupBy("product_id").agg(
        n.alias("n"), mean.alias("m"),
        F.sqrt(F.greatest(F.lit(0.0), ss.cast("double") / n - mean * mean)).alias("sd"))
    df = products.join(stats, "product_id", "left").withColumns({
        "demand": or_default(F.col("m"), 1.0), "lead": lead_time()})
    d, lead = F.col("demand"), F.col("lead")
    spread = F.when(F.col("n") > 1, F.col("sd")).otherwise(d * 0.3)
    df = df.withColumn("variability", F.least(F.lit(1.0), spread / F.greatest(d, F.lit(0.01))))
    safety = F.lit(z) * (d * F.col("variability")) * F.sqrt(lead)
    cover = F.col("current_stock") / F.greatest(d, F.lit(0.01))
    df = df.withColumns({"days_until_stockout": cover, "buffer_days": cover - lead, "_ss": safety})
    b = F.col("buffer_days")
    qty = truncate(d * lead + F.col("_ss"))
    return df.select(
        "product_id", "days_until_stockout", "buffer_days", "variability",
        truncate(F.col("_ss")).alias("safety_stock"), qty.alias("reorder_quantity"),
        (qty * F.col("unit_cost")).alias("order_cost"),
        (d * (F.col("unit_price") - F.col("unit_cost"))).alias("potential_daily_loss"),
        F.when(b < 0, "CRITICAL").when(b <= 3, "URGENT").when(b <= 7, "HIGH")
        .when(b <= 14, "MODERATE").otherwise("LOW").alias("urgency"),
    )


def margin_health(revenue: Column, cost: Column) -> dict[str, Column]:
    margin = F.when(revenue > 0, (revenue - cost) / revenue * 100).otherwise(0.0)
    band = (
        F.when(margin >= 40, "EXCELLENT").when(margin >= 25, "HEALTHY").when(margin >= 10, "MODERATE")
        .when(margin >= 0, "LOW").otherwise("CRITICAL")
    )
    return {"profit": revenue - cost, "margin_pct": margin, "health": band}


def loss_explained(products: DataFrame, sales: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    df = products.join(row_average(sales, as_of, days, "m"), "product_id", "left")
    d = F.coalesce(F.col("m"), F.lit(0.0))
    loss = d * (F.col("unit_price") - F.col("unit_cost"))
    return df.select(
        "product_id", d.alias("avg_daily_demand"), loss.alias("daily_loss"), (loss * 7).alias("weekly_loss"),
        (loss * 30).alias("monthly_loss"), (loss * 365).alias("annual_loss"))


# ---- restocking -----------------------------------------------------------

def restock_preview(products: DataFrame, receipts: DataFrame) -> DataFrame:
    """Every receipt line with the stock it leads to; unknown codes are kept and marked."""
    df = receipts.join(products.select("product_id", "sku", "current_stock"), "sku", "left")
    new = F.col("current_stock") + F.col("restock_quantity")
    return df.withColumns({
        "new_stock": new,
        "outcome": F.when(F.col("product_id").isNull(), "NOT_FOUND")
        .when(F.col("current_stock") == 0, "CRITICAL").when(F.col("current_stock") < 100, "HIGH")
        .when(new > 5000, "WARN_LARGE").otherwise("NORMAL"),
    })


def restock_apply(products: DataFrame, receipts: DataFrame) -> DataFrame:
    """Stock after all receipts; repeated lines of one product add up."""
    added = receipts.groupBy("sku").agg(F.sum("restock_quantity").alias("added"))
    return products.join(added, "sku", "left").withColumn(
        "current_stock", F.col("current_stock") + F.coalesce(F.col("added"), F.lit(0))).drop("added")


def threshold_sweep(reorder: DataFrame) -> DataFrame:
    low = reorder.filter(F.col("current_stock") <= F.col("reorder_point")).select(
        "product_id", "sku", F.lit("STOCK").alias("alert"), F.col("reorder_point").cast("double").alias("limit_value"),
        F.col("current_stock").cast("double").alias("value"))
    loss = reorder.filter(F.col("unit_price") < F.col("unit_cost")).select(
        "product_id", "sku", F.lit("LOSS").alias("alert"), F.col("unit_cost").alias("limit_value"),
        F.col("unit_price").alias("value"))
    return low.unionByName(loss)


def recommendations(products: DataFrame, stats: DataFrame, limit: int | None = None, medium_max: int = 50) -> DataFrame:
    """Policy of at-risk products on the 90-day rate, most pressing first."""
    chosen = products.filter(F.col("current_stock") <= medium_max)
    df = chosen.join(stats, "product_id", "left").withColumns({
        "demand": F.when(F.col("total_qty") > 0, daily_rate("max30"))
        .otherwise(or_default(F.col("average_daily_demand"), 1.0)),
        "lead": lead_time(), "cost": or_default(F.col("unit_cost"), 1.0)})
    df = compact_policy(df)
    level = F.col("eoq") / 2.0 + F.col("safety_stock")
    held = F.greatest(F.col("current_stock").cast("double"), level * 1.5)
    return df.select(
        *ID, "reorder_point", "safety_stock", "eoq",
        (F.col("reorder_point") + F.col("safety_stock")).alias("optimal_stock"),
        (F.greatest(F.lit(0.0), held - level) * F.greatest(F.col("cost") * 0.25, F.lit(0.01))).alias("savings"),
        (F.col("current_stock") < F.col("reorder_point")).alias("needs_reorder"),
    ).transform(first_rows, limit, F.col("needs_reorder").desc(), "current_stock", "product_id")
