"""Roll-ups: period trends, comparisons, category breakdowns, accuracy and health."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.mathx import ratio, truncate
from granary.operators.demand import daily_rate, since, transaction_stats
from granary.operators.listing import days_of_inventory, with_demand
from granary.operators.policy import Bands, compact_policy, lead_time, stock_band

# Look-back in days, bucket and nominal length of each reporting period.
PERIODS = {"daily": (30, "day", 1), "wow": (84, "week", 7), "mom": (365, "month", 30), "yoy": (730, "year", 365)}


def money(col: Column) -> Column:
    """Exact arithmetic for sums of amounts."""
    return col.cast("decimal(12,2)")


def bucket(date: Column, period: str) -> Column:
    return F.date_trunc(PERIODS[period][1], date).cast("date")


def calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    days = (end - start).days + 1
    return spark.range(days).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))


def catalogue_summary(products: DataFrame, bands: Bands = Bands()) -> DataFrame:
    stock = F.col("current_stock")
    return products.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(stock == 0).alias("out_of_stock"),
        F.count_if((stock > 0) & (stock <= bands.low_max)).alias("low_stock"),
        F.count_if((stock > bands.low_max) & (stock <= bands.medium_max)).alias("medium_stock"),
        F.count_if(stock > bands.medium_max).alias("high_stock"),
        F.count_distinct("category").alias("categories"),
    )


def headline_kpis(products: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Counts, stock value and the savings estimate from the cost of at-risk products."""
    stock = F.col("current_stock")
    at_risk = stock <= bands.low_max
    df = products.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.sum(stock * money(F.col("unit_cost"))).cast("double").alias("stock_value"),
        F.count_if(stock == 0).alias("out_of_stock"),
        F.count_if((stock > 0) & at_risk).alias("low_stock"),
        (F.sum(F.when(at_risk, money(F.col("unit_cost")))).cast("double")
         / F.nullif(F.count_if(at_risk), F.lit(0))).alias("cost"),
    )
    cost = F.coalesce(F.col("cost"), F.lit(10.0))
    return df.withColumn(
        "estimated_savings",
        F.col("out_of_stock") * cost * 30 * 0.5 + F.col("low_stock") * (cost * 0.25) * 15).drop("cost")


def period_trend(priced: DataFrame, as_of: dt.date, period: str) -> DataFrame:
    """Quantity, revenue, profit and loss per bucket, with fallbacks for missing prices."""
    q = F.col("quantity_sold")
    revenue = F.coalesce(F.col("revenue"), q * F.coalesce(money(F.col("unit_price_at_sale")), F.lit(10)))
    cost = q * F.coalesce(money(F.col("unit_cost_at_sale")), F.lit(5))
    loss = F.when(F.col("profit_loss_amount") < 0, -F.col("profit_loss_amount")).otherwise(0)
    df = since(priced, as_of, PERIODS[period][0]).groupBy(bucket(F.col("date"), period).alias("period")).agg(
        F.min("date").alias("first_date"), F.sum(q).alias("quantity"),
        F.sum(revenue).alias("r"), F.sum(cost).alias("c"), F.sum(loss).cast("double").alias("loss"))
    return df.select("period", "first_date", "quantity", F.col("r").cast("double").alias("revenue"),
                     F.greatest((F.col("r") - F.col("c")).cast("double"), F.lit(0.0)).alias("profit"), "loss")


def stockout_drain(products: DataFrame, sales: DataFrame, as_of: dt.date, days: int = 90) -> DataFrame:
    """Revenue lost per day by products that are out of stock (one row)."""
    rate = since(sales, as_of, days).groupBy("product_id").agg(
        (F.sum("quantity_sold").cast("double")
         / F.greatest(F.lit(1), F.datediff(F.max("date"), F.min("date")))).alias("per_day")
    ).filter("per_day > 0")
    return products.filter("current_stock = 0").join(rate, "product_id").agg(
        F.coalesce(F.sum(F.col("per_day") * F.col("unit_price")), F.lit(0.0)).alias("daily_loss"))


def with_stockout_loss(trend: DataFrame, drain: DataFrame, period: str) -> DataFrame:
    """Add the drain to the last three buckets with weights 1, .75 and .5.

    The trend holds one row per calendar bucket, so its ranking is small.
    """
    back = F.row_number().over(Window.orderBy(F.col("period").desc()))
    weight = F.when(back == 1, 1.0).when(back == 2, 0.75).when(back == 3, 0.5).otherwise(0.0)
    return trend.withColumn("loss", F.col("loss") + drain.scalar() * PERIODS[period][2] * weight)


def catalogue_trend(products: DataFrame, sales: DataFrame, as_of: dt.date, period: str) -> DataFrame:
    """Trend at catalogue prices.  Quantities are summed per product and bucket before
    the join; days without sales appear as zeros in the daily view."""
    days = PERIODS[period][0]
    per = since(sales, as_of, days).groupBy("product_id", bucket(F.col("date"), period).alias("period")).agg(
        F.sum("quantity_sold").alias("q"))
    df = per.join(products.select("product_id", "unit_price", "unit_cost"), "product_id").groupBy("period").agg(
        F.sum("q").alias("quantity"),
        F.sum(F.col("q") * F.coalesce(money(F.col("unit_price")), F.lit(0))).alias("r"),
        F.sum(F.col("q") * F.coalesce(money(F.col("unit_cost")), F.lit(0))).alias("c"))
    if period == "daily":
        grid = calendar(sales.sparkSession, as_of - dt.timedelta(days=days), as_of).withColumnRenamed("date", "period")
        df = grid.join(df, "period", "left")
    zero = F.lit(0)
    profit = F.coalesce((F.col("r") - F.col("c")).cast("double"), F.lit(0.0))
    return df.select(
        "period", F.coalesce("quantity", zero).alias("quantity"),
        F.coalesce(F.col("r").cast("double"), F.lit(0.0)).alias("revenue"), profit.alias("profit"),
        F.abs(F.least(profit, F.lit(0.0))).alias("loss"))


def period_change(trend: DataFrame) -> DataFrame:
    """Last bucket against the one before it."""
    two = trend.orderBy(F.col("period").desc()).limit(2).agg(
        F.max_by("revenue", "period").alias("current_revenue"),
        F.min_by("revenue", "period").alias("previous_revenue"), F.count(F.lit(1)).alias("n"))
    prev = F.col("previous_revenue")
    return two.filter("n = 2").select(
        "current_revenue", "previous_revenue",
        F.when(prev != 0, (F.col("current_revenue") - prev) / prev * 100).alias("change_pct"))


def product_trend(products: DataFrame, priced: DataFrame, stats: DataFrame, as_of: dt.date,
                  period: str = "mom") -> DataFrame:
    """Per product and bucket, gaps filled, with the revenue missed while out of stock."""
    days, unit, length = PERIODS[period]
    gain = F.col("profit_loss_amount")
    seen = since(priced, as_of, days).groupBy("product_id", bucket(F.col("date"), period).alias("period")).agg(
        F.sum("quantity_sold").alias("quantity"), F.sum("revenue").cast("double").alias("revenue"),
        F.sum(F.when(gain >= 0, gain).otherwise(0)).cast("double").alias("profit"),
        F.sum(F.when(gain < 0, -gain).otherwise(0)).cast("double").alias("row_loss"))
    start = F.date_trunc(unit, F.lit(as_of - dt.timedelta(days=days))).cast("date")
    steps = F.sequence(start, F.lit(as_of), F.expr(f"interval 1 {unit}"))
    per_day = stats.select("product_id", daily_rate("span0").alias("per_day"))
    grid = products.join(per_day, "product_id", "left").select(
        "product_id", "current_stock", "unit_price", "per_day", F.explode(steps).alias("period"))
    df = grid.join(seen, ["product_id", "period"], "left").na.fill(0, ["quantity", "revenue", "profit", "row_loss"])
    daily_rev = F.coalesce(F.col("per_day"), F.lit(0.0)) * F.col("unit_price")
    expected = daily_rev * length
    starving = (F.col("current_stock") == 0) | (
        F.col("current_stock") < F.coalesce(F.col("per_day"), F.lit(0.0)) * 7)
    missed = F.when((daily_rev > 0) & starving & (F.col("revenue") < expected * 0.5),
                    expected - F.col("revenue")).otherwise(0.0)
    return df.select("product_id", "period", "quantity", "revenue", "profit",
                     (F.col("row_loss") + missed).alias("loss"))


def category_breakdown(products: DataFrame, bands: Bands | None = None) -> DataFrame:
    stock = F.col("current_stock")
    cat = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("Uncategorized")).alias("category")
    aggs = [F.count(F.lit(1)).alias("products"), F.sum(stock).alias("total_stock"),
            F.sum(stock * money(F.col("unit_cost"))).cast("double").alias("total_value")]
    if bands:
        band = stock_band(stock, bands)
        aggs += [F.count_if(band == b).alias(b.lower()) for b in ("OUT", "LOW", "MEDIUM", "HIGH")]
    return products.groupBy(cat).agg(*aggs)


def stockout_detail(products: DataFrame, sales: DataFrame, as_of: dt.date, days: int = 30,
                    bands: Bands = Bands()) -> DataFrame:
    """At-risk products with order size; SAFE ones are dropped."""
    near = products.filter(F.col("current_stock") <= bands.low_max * 4)
    df = with_demand(near, sales, as_of, days, catalogue_sigma=False).filter("demand > 0")
    df = compact_policy(df).filter("stockout_risk <> 'SAFE'")
    cover = truncate(ratio(F.col("current_stock"), F.col("demand")))
    return df.select(
        "product_id", "sku", "category", "current_stock", "demand", cover.alias("days_until_stockout"),
        "stockout_risk", "reorder_point", "order_quantity", "cost",
        ((F.col("current_stock") == 0) | (cover < 3)).alias("is_critical"))


def stockout_totals(detail: DataFrame) -> DataFrame:
    c = F.col("is_critical")
    return detail.agg(
        F.count(F.lit(1)).alias("at_risk"), F.count_if(c).alias("critical"),
        F.sum(F.when(c, F.col("order_quantity") * money(F.col("cost")))).cast("double").alias("reorder_cost"))


def scored_forecasts(forecasts: DataFrame, daily: DataFrame) -> DataFrame:
    """Stored forecasts next to the day's total sales; days that sold nothing drop out."""
    actual = daily.select("product_id", F.col("date").alias("forecast_date"), F.col("qty").alias("actual"))
    df = forecasts.join(actual, ["product_id", "forecast_date"]).filter("actual > 0")
    return df.withColumn("ape", ratio(F.abs(F.col("predicted_demand") - F.col("actual")), F.col("actual")))


def product_accuracy(scored: DataFrame, min_points: int = 3) -> DataFrame:
    mape = F.avg("ape")
    return scored.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("points"),
        (F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - mape)) * 100).alias("accuracy"),
    ).filter(F.col("points") >= min_points)


def overall_accuracy(scored: DataFrame, cap: bool) -> DataFrame:
    err = F.least(F.col("ape"), F.lit(1.0)) if cap else F.col("ape")
    return scored.agg(F.count(F.lit(1)).alias("points"),
                      F.greatest(F.lit(0.0), 1.0 - F.avg(err)).alias("accuracy"))


def quick_accuracy(sales: DataFrame, as_of: dt.date, test: int = 7, train: int = 30,
                   min_days: int = 14) -> DataFrame:
    """Mean of the training window against the test window, one pass over all products."""
    q = F.col("quantity_sold")
    edge = F.lit(as_of - dt.timedelta(days=test))
    old = F.col("date") < edge
    per = since(sales, as_of, test + train).groupBy("product_id").agg(
        F.count_distinct("date").alias("n_days"),
        (F.sum(F.when(old, q)).cast("double") / F.count(F.when(old, q))).alias("train"),
        (F.sum(F.when(~old, q)).cast("double") / F.count(F.when(~old, q))).alias("test"))
    per = per.filter((F.col("n_days") >= min_days) & (F.col("train") != 0) & (F.col("test") > 0))
    err = F.least(ratio(F.abs(F.col("train") - F.col("test")), F.col("test")), F.lit(1.0))
    return per.agg(F.count(F.lit(1)).alias("products"),
                   F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.avg(err)), F.lit(0.0)).alias("accuracy"))


def revenue_days(priced: DataFrame, as_of: dt.date, days: int = 90) -> DataFrame:
    """Daily revenue, profit, units, order value and margin with zero days filled in."""
    per = since(priced, as_of, days).groupBy("date").agg(
        F.sum("revenue").alias("r"), F.sum("profit_loss_amount").alias("p"), F.sum("quantity_sold").alias("u"))
    grid = calendar(priced.sparkSession, as_of - dt.timedelta(days=days), as_of)
    df = grid.join(per, "date", "left").select(
        "date", F.coalesce(F.col("r").cast("double"), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.col("p").cast("double"), F.lit(0.0)).alias("profit"),
        F.coalesce("u", F.lit(0)).alias("units"))
    r, u = F.col("revenue"), F.col("units")
    return df.withColumns({
        "avg_order_value": F.when(u > 0, r / u).otherwise(0.0),
        "margin_pct": F.when(r > 0, F.col("profit") / r * 100).otherwise(0.0)})


def window_totals(priced: DataFrame, as_of: dt.date) -> DataFrame:
    d7, d30 = (F.col("date") >= F.lit(as_of - dt.timedelta(days=n)) for n in (7, 30))
    below = F.col("profit_loss_amount") < 0
    zero = F.lit(0)

    def tot(cond: Column, col: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(col))), zero).cast("double")

    return since(priced, as_of, 90).agg(
        tot(d30, "revenue").alias("revenue_30d"), tot(d7, "revenue").alias("revenue_7d"),
        tot(d30, "profit_loss_amount").alias("profit_30d"), tot(d7, "profit_loss_amount").alias("profit_7d"),
        F.coalesce(F.sum(F.when(d30, F.col("quantity_sold"))), zero).cast("bigint").alias("units_30d"),
        F.count_if(below).alias("loss_transactions"),
        tot(below, "profit_loss_amount").alias("loss_amount"))


def product_revenue(priced: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    return since(priced, as_of, days).groupBy("product_id").agg(
        F.sum("revenue").cast("double").alias("revenue"),
        F.sum("profit_loss_amount").cast("double").alias("profit"), F.sum("quantity_sold").alias("units"))


def savings_rows(products: DataFrame, sales: DataFrame, as_of: dt.date, days: int = 60,
                 bands: Bands = Bands()) -> DataFrame:
    """Four kinds of yearly saving per product that has demand and a cost."""
    stats = transaction_stats(sales, as_of, days).select("product_id", daily_rate("active").alias("observed"))
    listed = F.when(F.col("average_daily_demand") > 0, F.col("average_daily_demand"))
    df = products.join(stats, "product_id", "left").withColumns({
        "d": F.coalesce("observed", listed), "lead": lead_time()})
    df = df.filter((F.col("d") > 0) & (F.col("unit_cost") > 0))
    d, stock, cost, price = F.col("d"), F.col("current_stock"), F.col("unit_cost"), F.col("unit_price")
    rop, year = d * F.col("lead"), d * 365
    now = F.greatest(F.lit(1.0), year / F.greatest(stock, F.lit(1)))
    best = F.greatest(F.lit(1.0), year / (rop * 2))
    return df.select(
        "product_id", F.coalesce(F.col("category"), F.lit("Uncategorized")).alias("category"),
        F.when(stock > rop, (stock - rop) * (cost * 0.25)).otherwise(0.0).alias("holding"),
        F.when(stock < rop * 0.5, d * 7 * (price - cost) * 0.3).otherwise(0.0).alias("stockouts"),
        (F.abs(now - best) * 50 * 0.5).alias("ordering"),
        F.when((d < 1) & (stock > bands.medium_max), stock * price * 0.05).otherwise(0.0).alias("markdown"))


def savings_by_category(rows: DataFrame) -> DataFrame:
    """Per category and overall (null category) in one pass."""
    parts = ("holding", "stockouts", "ordering", "markdown")
    out = rows.rollup("category").agg(*[F.sum(F.round(p, 8).cast("decimal(28,8)")).cast("double").alias(p) for p in parts])
    return out.withColumn("total", sum((F.col(p) for p in parts[1:]), F.col(parts[0])))


def portfolio_savings(products: DataFrame, sales: DataFrame, as_of: dt.date, days: int = 90) -> DataFrame:
    stats = transaction_stats(sales, as_of, days)
    df = products.join(stats, "product_id").filter("total_qty > 0").withColumns({
        "demand": daily_rate("capped"), "lead": lead_time(), "cost": F.col("unit_cost")})
    df = compact_policy(df)
    level = F.col("eoq") / 2.0 + F.col("safety_stock")
    spare = F.greatest(F.lit(0.0), F.greatest(F.col("current_stock").cast("double"), level) - level)
    saving = F.round(spare * F.greatest(F.col("cost") * 0.25, F.lit(0.01)), 8).cast("decimal(28,8)")
    return df.agg(F.count(F.lit(1)).alias("products"), F.sum(saving).cast("double").alias("savings"))


def pnl_shift(priced: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    """Current window against the one before it; both sums come from one pass."""
    cur = F.col("date") >= F.lit(as_of - dt.timedelta(days=days))
    per = since(priced, as_of, 2 * days).groupBy("product_id").agg(
        F.sum(F.when(cur, F.col("quantity_sold"))).alias("quantity"),
        F.sum(F.when(cur, F.col("revenue"))).cast("double").alias("revenue"),
        F.sum(F.when(cur, F.col("profit_loss_amount"))).cast("double").alias("profit"),
        F.coalesce(F.sum(F.when(~cur, F.col("revenue"))).cast("double"), F.lit(0.0)).alias("previous_revenue"),
        F.coalesce(F.sum(F.when(~cur, F.col("profit_loss_amount"))).cast("double"), F.lit(0.0)).alias("previous_profit"),
    ).filter("quantity is not null")

    def growth(now: str, before: str) -> Column:
        return F.when(F.col(before) > 0, (F.col(now) - F.col(before)) / F.col(before) * 100).otherwise(0.0)

    per = per.withColumns({
        "revenue_growth": growth("revenue", "previous_revenue"),
        "profit_growth": growth("profit", "previous_profit"), "is_profitable": F.col("profit") > 0})
    g = F.col("profit_growth")
    return per.withColumn("trend", F.when(g > 5, "UP").when(g < -5, "DOWN").otherwise("STABLE"))


def inventory_health(products: DataFrame, row_rates: DataFrame) -> DataFrame:
    """Counts of dead, at-risk, fast and critical products; the tests apply in this order."""
    df = products.join(row_rates, "product_id", "left")
    d, stock = F.col("per_row"), F.col("current_stock")
    days = days_of_inventory(stock, d)
    state = F.when(d.isNull(), "NONE").when(days > 180, "DEAD").when(days < 7, "RISK").when(days < 30, "FAST").otherwise("OK")
    return df.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.sum(stock * money(F.col("unit_cost"))).cast("double").alias("inventory_value"),
        F.count_if(state == "DEAD").alias("dead_stock"), F.count_if(state == "RISK").alias("at_risk"),
        F.count_if(state == "FAST").alias("high_turnover"), F.count_if(stock < d * 2).alias("critical_stockout"))


def notification_metrics(notices: DataFrame, recipients: DataFrame, hours: int = 24) -> DataFrame:
    """Attempts and failures in the hours before the last attempt, and active recipients."""
    last = notices.agg(F.max("created_at").alias("m")).scalar()
    recent = notices.filter(F.col("created_at") >= last - F.expr(f"interval {hours} hours"))
    active = recipients.filter("is_active").agg(F.count(F.lit(1)).alias("n")).scalar()
    return recent.agg(
        F.count(F.lit(1)).alias("notifications"), F.count_if(F.col("status") == "FAILED").alias("failures"),
    ).withColumn("active_recipients", active)


def stock_snapshot(products: DataFrame, low: int = 50) -> DataFrame:
    stock = F.col("current_stock")
    df = products.agg(
        F.count(F.lit(1)).alias("total_products"), F.sum(stock).alias("total_units"),
        F.count_if(stock == 0).alias("out_of_stock"), F.count_if((stock > 0) & (stock <= low)).alias("low_stock"),
        F.sum(stock * money(F.col("unit_cost"))).cast("double").alias("stock_value"))
    per_day = F.greatest(F.col("total_units") / 365.0, F.lit(0.1))
    return df.withColumn("days_of_inventory", days_of_inventory(F.col("total_units"), per_day))


def weekly_buckets(forecasts: DataFrame) -> DataFrame:
    """Daily forecast rows to Monday weeks: rounded, never negative."""
    f = F.greatest(F.lit(0.0), F.col("predicted_demand")).cast("decimal(18,6)")
    return forecasts.groupBy("product_id", F.date_trunc("week", "forecast_date").cast("date").alias("week")).agg(
        F.count(F.lit(1)).alias("days"), F.round(F.sum(f).cast("double")).alias("predicted"))


def rate_kpis(products: DataFrame, year_sales: DataFrame) -> DataFrame:
    """Turnover, days of inventory, fill rate and carrying cost per product."""
    df = products.join(year_sales, "product_id", "left")
    cogs = F.coalesce(F.col("units"), F.lit(0)) * F.col("unit_cost")
    value = F.col("current_stock") * F.col("unit_cost")
    return df.select(
        "product_id",
        F.when(value > 0, cogs / value).otherwise(0.0).alias("turnover"),
        days_of_inventory(F.col("current_stock"), F.col("units") / 365.0).alias("days_of_inventory"),
        F.when(F.coalesce(F.col("orders"), F.lit(0)) == 0, 1.0)
        .otherwise(F.col("fulfilled") / F.col("orders")).alias("fill_rate"),
        (value * 0.25).alias("carrying_cost"))


def top_sellers(products: DataFrame, sales: DataFrame, as_of: dt.date, days: int = 30, top: int = 5) -> DataFrame:
    """Best products by catalogue revenue with a demand level and one piece of advice."""
    qty = since(sales, as_of, days).groupBy("product_id").agg(F.sum("quantity_sold").alias("quantity"))
    df = qty.join(products.select("product_id", "name", "sku", "current_stock", "unit_price", "unit_cost"), "product_id")
    q = F.col("quantity")
    df = df.withColumns({
        "revenue": (q * money(F.col("unit_price"))).cast("double"),
        "profit": (q * (money(F.col("unit_price")) - money(F.col("unit_cost")))).cast("double")})
    df = df.orderBy(F.col("revenue").desc(), "product_id").limit(top)
    ratio = q / F.max(q).over(Window.partitionBy(F.lit(1)))  # over ``top`` rows
    level = F.when(ratio >= 0.7, "HIGH").when(ratio >= 0.3, "MEDIUM").otherwise("LOW")
    df = df.withColumn("demand_level", level)
    advice = (
        F.when(F.col("unit_price") < F.col("unit_cost"), "REVIEW_PRICING")
        .when((F.col("demand_level") == "HIGH") & (F.col("current_stock") < q), "INCREASE_STOCK")
        .when((F.col("demand_level") == "LOW") & (F.col("profit") <= 0), "PROMOTE").otherwise("MONITOR"))
    return df.select("product_id", "sku", "current_stock", "quantity", "revenue", "profit", "demand_level",
                     advice.alias("advice"))


def daily_summary(priced: DataFrame) -> DataFrame:
    """The materialised daily table: units, revenue, cost, loss and row count."""
    q, p = F.col("quantity_sold"), F.col("profit_loss_amount")
    return priced.groupBy(F.col("date").alias("sale_date")).agg(
        F.sum(q).alias("total_quantity"),
        F.sum(F.coalesce(F.col("revenue"), q * F.lit(10))).cast("double").alias("total_revenue"),
        F.sum(q * F.coalesce(money(F.col("unit_cost_at_sale")), F.lit(5))).cast("double").alias("total_cost"),
        F.sum(F.when(p < 0, -p).otherwise(0)).cast("double").alias("total_loss"),
        F.count(F.lit(1)).alias("transactions"))


def channel_stats(daily: DataFrame) -> DataFrame:
    """Per channel totals, spread, trend and share, with the concentration of the whole.

    ``daily`` has one row per channel and day, so the windows see calendar-sized groups.
    """
    q = F.col("qty").cast("bigint")
    i = F.row_number().over(Window.partitionBy("channel").orderBy("date")).cast("bigint")
    from granary.operators.demand import population_sd
    from granary.operators.series_terms import slope

    n, s, ss = F.count(F.lit(1)), F.sum(q), F.sum(q * q)
    per = daily.withColumn("i", i).groupBy("channel").agg(
        n.alias("days"), s.alias("total"), (s.cast("double") / n).alias("mean"), population_sd(n, s, ss).alias("sd"),
        F.min(q).alias("min_daily"), F.max(q).alias("max_daily"), slope(F.col("i"), q).alias("slope"),
        F.min_by("qty", "date").alias("first"), F.max_by("qty", "date").alias("last"))
    share = F.round(F.col("total").cast("double") / F.sum("total").over(Window.partitionBy(F.lit(1))) * 100, 1)
    per = per.withColumns({"share_pct": share, "trend": trend_label(
        F.col("days"), F.col("slope"), F.col("first"), F.col("last"))})
    everything = Window.partitionBy(F.lit(1))  # one row per channel
    hhi = F.sum(F.col("share_pct") / 100 * (F.col("share_pct") / 100)).over(everything)
    return per.withColumns({
        "concentration": F.when(hhi > 0.5, "HIGH").when(hhi > 0.25, "MODERATE").otherwise("LOW"),
        "is_top": F.row_number().over(everything.orderBy(F.col("total").desc(), "channel")) == 1,
    }).drop("slope", "first", "last")


def trend_label(n: Column, slope_: Column, first: Column, last: Column) -> Column:
    return (
        F.when(n < 2, "INSUFFICIENT_DATA")
        .when(n >= 3, F.when(slope_ > 0.05, "INCREASING").when(slope_ < -0.05, "DECREASING").otherwise("STABLE"))
        .when(last > first, "INCREASING").when(last < first, "DECREASING").otherwise("STABLE"))
