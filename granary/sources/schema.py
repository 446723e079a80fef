"""Declared schemas, header aliases, defaults and the one function that applies them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """Target columns with types, accepted header spellings, defaults and required sets."""

    types: dict[str, str]
    aliases: dict[str, tuple[str, ...]]
    defaults: dict[str, object] = field(default_factory=dict)
    required: dict[str, list[str]] = field(default_factory=dict)

    def target(self, header: str) -> str:
        name = header.lower().strip()
        for column, spellings in self.aliases.items():
            if name in spellings:
                return column
        return name


# Column types, header spellings, defaults and required columns of both feeds.
PRODUCT = Contract(
    types={
        "sku": "string",
        "name": "string",
        "category": "string",
        "supplier_id": "string",
        "abc_classification": "string",
        "xyz_classification": "string",
        "product_priority": "string",
        "stock_status": "string",
        "description": "string",
        "current_stock": "int",
        "lead_time_days": "int",
        "min_order_qty": "int",
        "max_order_qty": "int",
        "shelf_life_days": "int",
        "order_frequency_days": "int",
        "unit_cost": "double",
        "unit_price": "double",
        "reorder_point": "double",
        "safety_stock": "double",
        "average_daily_demand": "double",
        "seasonality_factor": "double",
        "demand_volatility": "double",
        "profit_margin": "double",
        "weight_kg": "double",
        "volume_m3": "double",
        "storage_cost_per_unit": "double",
        "stockout_cost_per_unit": "double",
        "target_service_level": "double",
        "economic_order_qty": "double",
        "inventory_turnover": "double",
        "weeks_of_supply": "double",
        "is_perishable": "boolean",
        "is_hazardous": "boolean",
        "last_order_date": "date",
        "last_sale_date": "date",
    },
    aliases={
        "sku": ("id", "product_id", "product_code", "code", "item_code"),
        "name": ("product_name", "title", "item_name"),
        "description": ("desc", "product_description", "brand"),
        "min_order_qty": ("minimumorderquantity", "min_order", "min_qty"),
        "max_order_qty": ("max_order", "max_qty"),
        "current_stock": ("stock", "inventory", "quantity", "qty", "stock_level", "on_hand"),
        "unit_cost": ("cost", "cost_price", "purchase_price"),
        "unit_price": ("price", "selling_price", "retail_price", "sale_price"),
        "lead_time_days": ("lead_time", "leadtime", "delivery_days"),
        "category": ("type", "product_type", "product_category"),
        "abc_classification": ("class", "abc"),
        "xyz_classification": ("xyz",),
        "product_priority": ("priority",),
        "average_daily_demand": ("daily_demand", "avg_demand", "demand"),
        "seasonality_factor": ("seasonality",),
        "demand_volatility": ("volatility", "variability"),
        "inventory_turnover": ("turnover",),
        "weight_kg": ("weight",),
        "volume_m3": ("volume",),
        "shelf_life_days": ("shelf_life",),
        "is_perishable": ("perishable",),
        "is_hazardous": ("hazardous",),
        "storage_cost_per_unit": ("storage_cost", "holding_cost"),
        "stockout_cost_per_unit": ("stockout_cost", "shortage_cost"),
        "supplier_id": ("supplier", "vendor", "vendor_id"),
        "economic_order_qty": ("eoq",),
        "target_service_level": ("service_level",),
        "stock_status": ("status",),
    },
    defaults={"category": "General", "current_stock": 0, "unit_cost": 10.0, "unit_price": 15.0, "lead_time_days": 7,
              "seasonality_factor": 1.0, "demand_volatility": 0.5, "target_service_level": 0.95,
              "is_perishable": False, "is_hazardous": False},
    required={"core": ["sku", "name"],
              "ai": ["sku", "name", "current_stock", "unit_cost", "unit_price", "lead_time_days"]},
)

SALES = Contract(
    types={
        "date": "date", "sku": "string", "quantity_sold": "int", "revenue": "double", "unit_price_at_sale": "double",
        "unit_cost_at_sale": "double", "profit_loss_amount": "double", "profit_margin_pct": "double",
        "discount_applied": "double", "transaction_type": "string", "promotion_id": "string",
        "sales_channel": "string", "customer_id": "string", "region": "string",
    },
    aliases={
        "date": ("sale_date", "transaction_date", "order_date"),
        "sku": ("product_sku", "product_id", "item_id", "product_code"),
        "quantity_sold": ("quantity", "qty_sold", "units_sold", "qty"),
        "revenue": ("sales", "total_sales", "amount", "total_amount"),
        "unit_price_at_sale": ("unit_price", "price", "selling_price"),
        "unit_cost_at_sale": ("unit_cost", "cost"),
        "profit_loss_amount": ("profit", "profit_amount"),
        "profit_margin_pct": ("profit_margin", "margin"),
        "discount_applied": ("discount", "discount_pct"),
        "promotion_id": ("promo_id", "campaign_id"),
        "transaction_type": ("transaction", "sale_type"),
        "sales_channel": ("channel",),
        "customer_id": ("customer", "customer_code"),
        "region": ("location", "area"),
    },
    defaults={"revenue": 0.0, "transaction_type": "Normal"},
    required={"core": ["date", "sku", "quantity_sold"], "revenue": ["date", "sku", "quantity_sold", "revenue"],
              "profit": ["date", "sku", "quantity_sold", "revenue", "unit_price_at_sale", "unit_cost_at_sale"]},
)

# Columns every model reads, required and optional.
MODEL_COLUMNS = {
    "demand_forecasting": (["sku", "date", "quantity_sold"], ["revenue", "seasonality_factor", "average_daily_demand"]),
    "inventory_optimization": (["sku", "current_stock", "unit_cost"],
                               ["lead_time_days", "reorder_point", "safety_stock", "average_daily_demand"]),
    "stockout_prediction": (["sku", "current_stock", "average_daily_demand"],
                            ["lead_time_days", "safety_stock", "seasonality_factor"]),
    "price_optimization": (["sku", "unit_cost", "unit_price"], ["revenue", "quantity_sold", "discount"]),
}

FORECAST_FEATURES = ["average_daily_demand", "seasonality_factor", "demand_volatility", "abc_classification",
                     "xyz_classification", "inventory_turnover", "current_stock", "reorder_point", "safety_stock",
                     "lead_time_days"]


def rename(df: DataFrame, contract: Contract) -> DataFrame:
    """Map headers to target names; when several headers mean one column the first non-null wins."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(contract.target(c), []).append(c)
    return df.select(*[
        (F.coalesce(*[F.col(f"`{c}`") for c in cs]) if len(cs) > 1 else F.col(f"`{cs[0]}`")).alias(t)
        for t, cs in groups.items()
    ])


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def _number(col: Column) -> Column:
    return F.trim(col.cast("string")).try_cast("double")


def convert(df: DataFrame, contract: Contract) -> DataFrame:
    """Cast by contract: bad numbers take the default or zero, bad dates become null."""
    out = {}
    for name, kind in contract.types.items():
        default = contract.defaults.get(name)
        if name not in df.columns:
            if default is not None:
                out[name] = F.lit(default).cast(kind)
            continue
        col = F.col(name)
        if kind == "int":
            # "45.0" is a whole number here, which a direct cast would reject.
            out[name] = F.coalesce(_number(col).try_cast("int"), F.lit(default if default is not None else 0))
        elif kind == "double":
            out[name] = F.coalesce(_number(col), F.lit(default if default is not None else 0.0))
        elif kind == "boolean":
            out[name] = F.coalesce(F.lower(F.trim(col.cast("string"))).isin("true", "1", "yes", "y"),
                                   F.lit(bool(default)))
        elif kind == "date":
            out[name] = F.trim(col.cast("string")).try_cast("date")
        else:
            text = F.trim(col.cast("string"))
            out[name] = text if default is None else F.coalesce(text, F.lit(default))
    return df.withColumns(out)


def conform(df: DataFrame, contract: Contract, level: str = "core") -> DataFrame:
    """Rename, require and convert; raises when a required column is absent."""
    named = rename(df, contract)
    absent = missing_columns(named, contract.required[level])
    if absent:
        raise ValueError(f"missing required columns: {', '.join(absent)}")
    return convert(named, contract)


def conform_products(df: DataFrame, ai: bool = False) -> DataFrame:
    return conform(df, PRODUCT, "ai" if ai else "core")


def conform_sales(df: DataFrame, level: str = "core") -> DataFrame:
    """Sales with profit and margin derived row by row where the feed has none."""
    named = rename(df, SALES)
    given = {c for c in ("profit_loss_amount", "profit_margin_pct") if c in named.columns}
    missing_price = [c for c in ("unit_price_at_sale", "unit_cost_at_sale") if c not in named.columns]
    raw = {f"_has_{c}": _number(F.col(c)).isNotNull() for c in given}
    priced = {} if missing_price else {
        "_p": _number(F.col("unit_price_at_sale")), "_c": _number(F.col("unit_cost_at_sale"))}
    out = conform(named.withColumns({**raw, **priced}), SALES, level)
    if missing_price:
        return out
    p, c, q = F.col("_p"), F.col("_c"), F.col("quantity_sold")
    profit = (p - c) * q
    margin = F.when(p > 0, (p - c) / p * 100).otherwise(0.0)

    def pick(name: str, derived: Column) -> Column:
        return F.when(F.col(f"_has_{name}"), F.col(name)).otherwise(derived) if name in given else derived

    return out.withColumns({
        "profit_loss_amount": pick("profit_loss_amount", profit),
        "profit_margin_pct": pick("profit_margin_pct", F.coalesce(margin, F.lit(0.0))),
    }).drop("_p", "_c", *raw)


def model_columns(df: DataFrame, model: str) -> DataFrame:
    required, optional = MODEL_COLUMNS[model]
    absent = missing_columns(df, required)
    if absent:
        raise ValueError(f"{model} needs: {', '.join(absent)}")
    return df.select(*required, *[c for c in optional if c in df.columns])


def forecast_features(products: DataFrame) -> DataFrame:
    return products.select("sku", *[c for c in FORECAST_FEATURES if c in products.columns])
