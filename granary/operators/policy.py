"""Reorder policy as column expressions: stock bands, EOQ, safety stock, risk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.mathx import norm_cdf, norm_pdf, norm_ppf, or_default, ratio, truncate, z_value

HOLDING_RATE = 0.25
ORDER_COST = 50.0


@dataclass(frozen=True)
class Bands:
    low_max: int = 10
    medium_max: int = 50


def stock_band(stock: Column, bands: Bands = Bands()) -> Column:
    return (
        F.when(stock == 0, "OUT")
        .when(stock <= bands.low_max, "LOW")
        .when(stock <= bands.medium_max, "MEDIUM")
        .otherwise("HIGH")
    )


def band_predicate(stock: Column, band: str, bands: Bands = Bands()) -> Column:
    choices = {
        "OUT": stock == 0,
        "LOW": (stock > 0) & (stock <= bands.low_max),
        "MEDIUM": (stock > bands.low_max) & (stock <= bands.medium_max),
        "HIGH": stock > bands.medium_max,
    }
    return choices.get(band, F.lit(True))


def lead_time() -> Column:
    return or_default(F.col("lead_time_days"), 7)


def compact_policy(df: DataFrame, service_level: float = 0.95) -> DataFrame:
    """Safety stock, reorder point, lot size, order quantity and stockout risk.

    Needs ``demand``, ``sigma``, ``lead``, ``cost`` and ``current_stock``.  A missing
    or zero spread becomes 30 % of demand; a product without demand gets zeros.
    """
    z = z_value(service_level)
    d, lead, stock = F.col("demand"), F.col("lead"), F.col("current_stock")
    sd = F.when(F.col("sigma").isNull() | (F.col("sigma") <= 0), d * 0.3).otherwise(F.col("sigma"))
    base = df.withColumns({
        "_sd": sd,
        "_ss": F.greatest(F.lit(0.0), F.round(F.lit(z) * sd * F.sqrt(lead), 2)),
        "_eoq": F.greatest(
            F.lit(1.0),
            F.when(F.col("cost") * HOLDING_RATE == 0, d * 365 / 12)
            .otherwise(F.sqrt(2.0 * (d * 365) * ORDER_COST / (F.col("cost") * HOLDING_RATE))),
        ),
    })
    rop = F.greatest(F.lit(0.0), d * lead + F.col("_ss"))
    eoq = F.greatest(truncate(F.round("_eoq", 2)), F.lit(1))
    base = base.withColumns({"_rop": rop, "_lot": eoq})
    order = F.greatest(
        F.lit(1),
        F.when(stock < F.col("_rop"),
               F.greatest(F.col("_lot"), truncate(F.col("_rop") - stock + F.col("_ss"))))
        .otherwise(F.col("_lot")),
    )
    z_now = ratio(stock - d * lead, F.col("_sd") * F.sqrt(lead))
    risk = F.when(stock == 0, 100.0).otherwise(F.round((1.0 - norm_cdf(z_now)) * 100, 1))
    base = base.withColumns({"_order": order, "_risk": risk})
    r = F.col("_risk")
    label = (
        F.when((stock == 0) | (r >= 80), "CRITICAL").when(r >= 50, "HIGH")
        .when(r >= 20, "MEDIUM").when(r >= 5, "LOW").otherwise("SAFE")
    )
    none = d.isNull() | (d <= 0)
    out = base.withColumns({
        "safety_stock": F.when(none, 0).otherwise(truncate(F.round("_ss"))),
        "reorder_point": F.when(none, 0).otherwise(truncate(F.round("_rop"))),
        "eoq": F.when(none, 0).otherwise(F.col("_lot")),
        "order_quantity": F.when(none, 0).otherwise(F.col("_order")),
        "risk_percentage": F.when(none, F.when(stock > 0, 0.0).otherwise(100.0)).otherwise(r),
        "stockout_risk": F.when(none, F.when(stock == 0, "CRITICAL").otherwise("UNKNOWN")).otherwise(label),
    })
    return out.drop("_sd", "_ss", "_eoq", "_rop", "_lot", "_order", "_risk")


# --------------------------------------------------------------------------
# Full optimiser: lot size, safety stock, reorder point and annual costs
# --------------------------------------------------------------------------

def order_quantity_terms(df: DataFrame) -> DataFrame:
    """Lot size with storage cost, order rhythm, supplier limits and priority buffer.

    Needs ``annual_demand``, ``unit_cost``, ``sd_daily``, ``avg_daily`` and the optional
    catalogue columns.  Adds ``holding_cost``, ``pure_eoq``, ``implied_order_days``, ``eoq``.
    """
    D = F.col("annual_demand")
    storage = F.col("storage_cost_per_unit")
    hold = F.when(storage > 0, storage).otherwise(F.col("unit_cost") * HOLDING_RATE)
    df = df.withColumn("holding_cost", hold)
    pure = F.greatest(
        F.lit(1.0),
        F.when(F.col("holding_cost") == 0, D / 12)
        .otherwise(F.sqrt(2.0 * D * ORDER_COST / F.col("holding_cost"))),
    )
    df = df.withColumn("pure_eoq", pure)
    p = F.col("pure_eoq")
    df = df.withColumn("implied_order_days", F.when(D > 0, ratio(365.0, ratio(D, p), 30.0)).otherwise(30.0))
    rhythm = ratio(D, ratio(365.0, F.col("order_frequency_days")))
    gap = ratio(F.abs(rhythm - p), p)
    weight = F.greatest(F.lit(0.5), 1.0 - gap * 0.5)
    blended = (
        F.when((F.col("order_frequency_days") > 0) & (gap > 0.2), weight * p + (1.0 - weight) * rhythm)
        .otherwise(p)
    )
    floor_ = F.greatest(blended, F.col("min_order_qty").cast("double"))  # null limit is ignored
    capped = F.least(floor_, F.col("max_order_qty").cast("double"))
    cv = ratio(F.col("sd_daily"), F.col("avg_daily"))
    buffer = F.when(D > 0, F.greatest(F.lit(0.10), F.least(F.lit(0.30), cv * 0.15 + 0.10))).otherwise(0.15)
    final = F.when(F.upper("product_priority") == "HIGH", capped * (1.0 + buffer)).otherwise(capped)
    return df.withColumn("eoq", F.greatest(F.lit(1.0), final))


def safety_stock_terms(df: DataFrame, service_level: float = 0.95) -> DataFrame:
    """Safety stock with a newsvendor service level and a shelf-life cap."""
    so, hold = F.col("stockout_cost_per_unit"), F.col("holding_cost")
    both = (so > 0) & (hold > 0)
    level = F.when(both, F.greatest(F.lit(0.85), F.least(F.lit(0.99), ratio(so, so + hold)))).otherwise(service_level)
    df = df.withColumn("service_level", level).withColumn("z_score", norm_ppf(F.col("service_level")))
    raw = F.col("z_score") * F.col("sd_daily") * F.sqrt(F.col("lead"))
    left = F.col("shelf_life_days") - F.col("lead")
    cap = left * F.col("avg_daily") * 0.5
    limited = (
        F.when((F.col("shelf_life_days") > 0) & (F.col("avg_daily") > 0),
               F.when(left > 0, F.least(raw, cap)).otherwise(0.0))
        .otherwise(raw)
    )
    return df.withColumns({
        "uncapped_safety_stock": raw,
        "safety_stock": F.greatest(F.lit(0.0), limited),
        "shelf_life_capped": F.coalesce(limited < raw, F.lit(False)),
    })


def full_policy(df: DataFrame, service_level: float = 0.95) -> DataFrame:
    """Lot size, safety stock, reorder point, annual costs, turnover and warnings."""
    df = safety_stock_terms(order_quantity_terms(df), service_level)
    D, eoq, ss, h = (F.col(c) for c in ("annual_demand", "eoq", "safety_stock", "holding_cost"))
    df = df.withColumn("reorder_point", F.greatest(F.lit(0.0), F.col("avg_daily") * F.col("lead") + ss))
    df = df.withColumns({
        "optimal_stock": F.col("reorder_point") + eoq,
        "avg_inventory": eoq / 2.0 + ss,
    })
    z, sl = F.col("z_score"), F.col("service_level")
    short = F.col("sd_daily") * F.sqrt(F.col("lead")) * (norm_pdf(z) - z * (1.0 - sl))
    df = df.withColumns({
        "annual_savings": F.greatest(
            F.lit(0.0), F.col("reorder_point") + eoq * 0.75 - F.col("avg_inventory")) * h,
        "annual_holding": F.col("avg_inventory") * h,
        "annual_ordering": ratio(D, eoq, 0.0) * ORDER_COST,
        "annual_stockout": F.when(F.col("stockout_cost_per_unit") > 0,
                                  ratio(D, eoq, 0.0) * short * F.col("stockout_cost_per_unit")).otherwise(0.0),
        "turnover": F.when(F.col("avg_inventory") > 0, D / F.col("avg_inventory")).otherwise(0.0),
        "stock_weight_kg": F.col("optimal_stock") * F.col("weight_kg"),
        "stock_volume_m3": F.col("optimal_stock") * F.col("volume_m3"),
    })
    elapsed = ratio(F.col("days_since_last_order"), ratio(365.0, ratio(D, eoq)), 0.0)
    idle = F.col("days_since_last_sale")
    return df.withColumns({
        "total_annual_cost": F.col("annual_holding") + F.col("annual_ordering") + F.col("annual_stockout"),
        "reorder_urgency": F.when(elapsed > 1.5, "HIGH").when(elapsed > 1.0, "MEDIUM").otherwise("NORMAL"),
        "dead_stock_risk": F.when(idle > 180, "CRITICAL").when(idle > 90, "HIGH")
        .when(idle > 60, "MEDIUM").otherwise("NONE"),
    })


def span_inputs(products: DataFrame, stats: DataFrame, as_of) -> DataFrame:
    """Join the catalogue with whole-history demand for the full optimiser."""
    rate = F.col("total_qty").cast("double") / (F.col("span_days") + 1)
    shaped = stats.select(
        "product_id", "total_qty", "active_days", "span_days",
        rate.alias("avg_daily"),
        (rate * 365).alias("annual_demand"),
        F.when(F.col("sd_daily").isNull() | (F.col("sd_daily") == 0), rate * 0.3)
        .otherwise(F.col("sd_daily")).alias("sd_daily"),
        F.datediff(F.lit(as_of), F.col("last_date")).alias("days_since_last_sale"),
    )
    return products.join(shaped, "product_id").withColumn("lead", lead_time())


def stockout_risk_band(stock: Column, rop: Column, demand: Column, sd: Column) -> dict[str, Column]:
    """Risk level, days of cover and stockout probability over a 7-day horizon."""
    z = ratio(stock - rop, sd * F.sqrt(F.lit(7.0)))
    return {
        "risk_level": F.when(stock <= 0, "CRITICAL").when(stock < rop * 0.5, "CRITICAL")
        .when(stock < rop, "HIGH").when(stock < rop * 1.5, "MEDIUM").otherwise("LOW"),
        "days_of_stock": F.when(stock <= 0, 0.0).when(demand > 0, stock / demand).otherwise(999.0),
        "probability": F.when(stock <= 0, 1.0).when(sd > 0, 1.0 - norm_cdf(z)).otherwise(0.0),
    }
