"""Catalogue lists: bands, search, paging, worklists and alert digests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.mathx import or_default, truncate
from granary.operators.demand import daily_rate, transaction_stats
from granary.operators.policy import Bands, band_predicate, compact_policy, lead_time, stock_band

BASIC = ("product_id", "sku", "name", "category", "current_stock")


def with_band(products: DataFrame, bands: Bands = Bands()) -> DataFrame:
    risk = F.create_map(*[F.lit(x) for x in ("OUT", "CRITICAL", "LOW", "HIGH", "MEDIUM", "LOW", "HIGH", "SAFE")])
    return products.withColumn("band", stock_band(F.col("current_stock"), bands)).withColumn(
        "band_risk", risk[F.col("band")])


def in_band(products: DataFrame, band: str, bands: Bands = Bands()) -> DataFrame:
    return products.filter(band_predicate(F.col("current_stock"), band, bands))


def text_match(columns: list[str], text: str) -> Column:
    pattern = f"%{text}%"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).ilike(pattern)
    return hit


def dropdown(products: DataFrame, search: str | None, category: str | None, limit: int) -> DataFrame:
    df = products
    if search:
        df = df.filter(text_match(["name", "sku", "category"], search))
    if category:
        df = df.filter(F.col("category") == category)
    return df.select(
        "product_id", "sku", "name", "category", F.concat_ws(" - ", "sku", "name").alias("display_name")
    ).orderBy("product_id").limit(limit)


def categories(products: DataFrame) -> DataFrame:
    return products.select("category").filter("category is not null and category <> ''").distinct()


def with_demand(products: DataFrame, sales: DataFrame, as_of: dt.date, days: int,
                catalogue_sigma: bool = True) -> DataFrame:
    """Observed demand, else the catalogue's figure, else null."""
    stats = transaction_stats(sales, as_of, days).select(
        "product_id", daily_rate("active").alias("observed"), F.col("sigma").alias("observed_sigma"))
    listed = F.when(F.col("average_daily_demand") > 0, F.col("average_daily_demand"))
    spread = F.when(F.col("demand_volatility") > 0, F.col("demand_volatility") * listed) if catalogue_sigma \
        else F.lit(None).cast("double")
    return products.join(stats, "product_id", "left").withColumns({
        "demand": F.coalesce("observed", listed),
        "sigma": F.when(F.col("observed").isNotNull(), F.col("observed_sigma")).otherwise(spread),
        "lead": lead_time(),
        "cost": or_default(F.col("unit_cost"), 1.0),
    })


def enriched(products: DataFrame, sales: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Every product with its policy, days of cover and reorder status."""
    df = compact_policy(with_demand(products, sales, as_of, days))
    d, stock, rop = F.col("demand"), F.col("current_stock"), F.col("reorder_point")
    status = (
        F.when(d.isNull(), "N/A").when(stock <= rop, "REORDER NOW")
        .when(stock <= rop * 1.5, "REORDER SOON").otherwise("OK")
    )
    return df.select(
        *BASIC, "unit_cost", "unit_price", "lead_time_days",
        stock_band(stock).alias("stock_badge"),
        "reorder_point", "safety_stock", "order_quantity",
        status.alias("reorder_status"),
        F.coalesce(d, F.lit(0.0)).alias("demand_per_day"),
        "stockout_risk", "risk_percentage",
        F.when(d > 0, truncate(stock / d)).alias("days_until_stockout"),
    )


def page(products: DataFrame, number: int, size: int, band: str | None = None,
         category: str | None = None, search: str | None = None) -> DataFrame:
    """One page of products by id; the offset is part of the top-k, not a full sort."""
    df = products
    if category:
        df = df.filter(F.col("category") == category)
    if band:
        df = in_band(df, band)
    if search:
        df = df.filter(text_match(["name", "sku"], search))
    return df.orderBy("product_id").offset((number - 1) * size).limit(size)


def order_size() -> Column:
    rop = F.coalesce(truncate(F.col("reorder_point")), F.lit(0))
    d = F.col("average_daily_demand")
    no_demand = truncate(or_default(F.col("reorder_point"), 100.0))
    return F.greatest(rop, F.when(d > 0, truncate(d * 14)).otherwise(no_demand))


def worklist(products: DataFrame, top: int | None = None, bands: Bands = Bands()) -> DataFrame:
    """What to order first: OUT by demand, LOW by days left; all, or ``top`` of each."""
    d, stock = F.col("average_daily_demand"), F.col("current_stock")
    left = F.when(d > 0, stock / d).otherwise(999.0)
    df = products.filter(stock <= bands.low_max).withColumns({
        "band": stock_band(stock, bands),
        "_left": F.when(stock == 0, 0.0).otherwise(left),
    })
    w = Window.partitionBy("band").orderBy(
        F.col("_left"), d.desc_nulls_last(), F.col("product_id"))
    ranked = df.withColumn("position", F.row_number().over(w))
    return (ranked if top is None else ranked.filter(F.col("position") <= top)).select(
        *BASIC, "band", "position", order_size().alias("order_quantity"),
        F.coalesce(d, F.lit(0.0)).alias("demand_per_day"),
        F.when(stock > 0, truncate(F.col("_left"))).alias("days_left"),
        "lead_time_days", "unit_cost",
    )


def only_ids(df: DataFrame, ids: DataFrame, key: str = "product_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def threshold_alerts(products: DataFrame, per_type: int | None = None, bands: Bands = Bands()) -> DataFrame:
    """Alerts of both types; with ``per_type`` the first of each by id, numbered."""
    stock = F.col("current_stock")
    df = products.filter(stock <= bands.low_max).withColumn(
        "alert_type", F.when(stock == 0, "CRITICAL").otherwise("LOW"))
    if per_type is None:
        return df.select(*BASIC, "alert_type")
    w = Window.partitionBy("alert_type").orderBy("product_id")
    return df.withColumn("position", F.row_number().over(w)).filter(
        F.col("position") <= per_type).select(*BASIC, "alert_type", "position")


def suggested_order() -> Column:
    rop, stock = F.col("reorder_point"), F.col("current_stock")
    safety = F.coalesce(F.col("safety_stock"), F.lit(0.0))
    return (
        F.when(stock == 0, F.greatest(F.coalesce(rop, F.lit(0.0)) * 2, F.lit(50.0)))
        .otherwise(F.greatest(F.coalesce(rop, F.lit(0.0)) - stock + safety, F.lit(20.0)))
    )


def stock_notifications(products: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """All products at or under the low band, most urgent first."""
    stock, d = F.col("current_stock"), F.col("average_daily_demand")
    days = F.when(d > 0, truncate(stock / d))
    return (
        products.filter(stock <= bands.low_max)
        .select(
            *BASIC,
            F.when(stock == 0, "CRITICAL").otherwise("WARNING").alias("alert_level"),
            days.alias("days_until_stockout"),
            "reorder_point",
            suggested_order().alias("suggested_order"),
        )
        .orderBy("current_stock", F.coalesce(or_default(F.col("days_until_stockout"), 999), F.lit(999)), "product_id")
    )


def alert_digest(products: DataFrame, alert_type: str = "all", ids: DataFrame | None = None,
                 bands: Bands = Bands()) -> DataFrame:
    """Totals of one digest: item counts, units to order and estimated cost."""
    stock = F.col("current_stock")
    df = products if ids is None else only_ids(products, ids)
    wanted = {"out_of_stock": stock == 0, "low_stock": (stock > 0) & (stock <= bands.low_max)}
    df = df.filter(wanted.get(alert_type, stock <= bands.low_max))
    qty = suggested_order()
    return df.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(stock == 0).alias("out_of_stock"),
        F.count_if(stock > 0).alias("low_stock"),
        F.sum(qty).alias("units_to_order"),
        F.sum(qty * F.col("unit_cost")).alias("estimated_cost"),
    )


def digest_preview(products: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Band counts plus the daily loss of all out-of-stock products."""
    stock = F.col("current_stock")
    loss = or_default(F.col("average_daily_demand"), 5.0) * (F.col("unit_price") - F.col("unit_cost"))
    return products.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(stock == 0).alias("out_of_stock"),
        F.count_if((stock > 0) & (stock <= bands.low_max)).alias("low_stock"),
        F.count_if((stock > bands.low_max) & (stock <= bands.medium_max)).alias("medium_stock"),
        F.coalesce(F.sum(F.when(stock == 0, loss)), F.lit(0.0)).alias("daily_loss"),
    )


def days_of_inventory(stock: Column, per_day: Column) -> Column:
    return F.when(F.coalesce(per_day, F.lit(0.0)) == 0, 999.0).otherwise(stock / per_day)


def slow_movers(products: DataFrame, rates: DataFrame, threshold_days: int = 90) -> DataFrame:
    df = products.join(rates, "product_id", "left")
    days = days_of_inventory(F.col("current_stock"), F.col("per_day"))
    return df.withColumn("days_of_inventory", days).filter(
        F.col("days_of_inventory") > threshold_days
    ).select("product_id", "name", "current_stock", "days_of_inventory")


def day_window(trend: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    return trend.filter(F.col("date") >= F.lit(as_of - dt.timedelta(days=days)))


def active_recipients(recipients: DataFrame, channel: str, fallback: list[str]) -> DataFrame:
    """Active addresses of a channel; the configured list only when there is none."""
    active = recipients.filter((F.col("channel") == channel) & F.col("is_active")).select("address")
    spare = recipients.sparkSession.createDataFrame([(a,) for a in fallback], "address string")
    return active.unionByName(spare.filter(~active.limit(1).exists()))


def find_product(products: DataFrame, tokens: list[str]) -> DataFrame:
    """First product for every token: code matches beat name matches, then the lowest id.

    The typed tokens are literals, so the substring tests run inside the scan and
    only one candidate per token leaves each task.
    """
    sku, name = F.lower("sku"), F.lower("name")
    words = F.array(*[F.lit(t.lower()) for t in tokens])
    hits = F.filter(words, lambda t: F.contains(sku, t) | F.contains(name, t))
    df = products.select("product_id", "sku", "name", F.explode(hits).alias("token"))
    rank = F.when(F.contains(F.lower("sku"), F.col("token")), 1).otherwise(2)
    best = F.min(F.struct(rank.alias("match_rank"), "product_id", "sku", "name"))
    return df.groupBy("token").agg(best.alias("b")).select("token", "b.*")


def alert_loss(alerts: DataFrame, level: str | None = None) -> DataFrame:
    df = alerts if level in (None, "ALL") else alerts.filter(F.col("stock_level") == level)
    return df.agg(
        F.count(F.lit(1)).alias("alerts"), F.coalesce(F.sum("loss_per_day"), F.lit(0)).alias("daily_loss"))
