"""Quality reports, record validation, cleaning and catalogue metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.mathx import or_default, ratio
from granary.functions.prefix import exact_quantiles
from granary.operators.demand import population_sd, since
from granary.sources.schema import PRODUCT, SALES, Contract, missing_columns, rename


def quality_report(df: DataFrame, kind: str, as_of: dt.date | None = None) -> DataFrame:
    """(check, severity, rows) of every check, from one pass plus a duplicate count."""
    checks: dict[str, tuple[str, Column]] = {}
    need = PRODUCT.required["ai"] if kind == "product" else SALES.required["core"]
    for c in need:
        if c in df.columns:
            checks[f"missing_{c}"] = ("warning", F.col(c).isNull())
    if kind == "product":
        rules = {
            "negative_stock": ("error", ["current_stock"], lambda: F.col("current_stock") < 0),
            "negative_cost": ("error", ["unit_cost"], lambda: F.col("unit_cost") < 0),
            "non_positive_price": ("warning", ["unit_price"], lambda: F.col("unit_price") <= 0),
            "below_cost": ("warning", ["unit_price", "unit_cost"], lambda: F.col("unit_price") < F.col("unit_cost")),
            "negative_lead_time": ("error", ["lead_time_days"], lambda: F.col("lead_time_days") < 0),
            "service_level_range": ("warning", ["target_service_level"],
                                    lambda: (F.col("target_service_level") <= 0) | (F.col("target_service_level") > 1)),
        }
    else:
        rules = {
            "negative_quantity": ("error", ["quantity_sold"], lambda: F.col("quantity_sold") < 0),
            "future_date": ("warning", ["date"], lambda: F.col("date") > F.lit(as_of)),
            "below_cost": ("warning", ["unit_price_at_sale", "unit_cost_at_sale"],
                           lambda: F.col("unit_price_at_sale") < F.col("unit_cost_at_sale")),
        }
    for name, (severity, cols, cond) in rules.items():
        if all(c in df.columns for c in cols):
            checks[name] = (severity, cond())
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, (_, c) in checks.items()])
    rows = [F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.col(n).alias("rows"))
            for n, (s, _) in checks.items()]
    report = counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if kind == "product":
        repeats = df.groupBy("sku").agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows"))
        report = report.unionByName(repeats.select(
            F.lit("duplicate_sku").alias("check"), F.lit("warning").alias("severity"), "rows"))
    return report


def dry_run(df: DataFrame, contract: Contract, kind: str, as_of: dt.date) -> DataFrame:
    """Header mapping, missing columns and quality findings of a feed, without loading it."""
    from granary.sources.schema import convert

    named = rename(df, contract)
    absent = missing_columns(named, contract.required["core"])
    mapping = F.array(*[F.struct(F.lit("mapping").alias("part"), F.lit(c).alias("item"),
                                 F.lit(contract.target(c)).alias("detail")) for c in df.columns])
    head = df.limit(1).select(F.explode(mapping).alias("m")).select("m.*", F.lit(None).cast("bigint").alias("rows"))
    if absent:
        missing = F.array(*[F.struct(F.lit("missing").alias("part"), F.lit(c).alias("item"), F.lit("").alias("detail")) for c in absent])
        return head.unionByName(df.limit(1).select(F.explode(missing).alias("m")).select("m.*", F.lit(None).cast("bigint").alias("rows")))
    found = quality_report(convert(named, contract), kind, as_of)
    return head.unionByName(found.select(
        F.lit("quality").alias("part"), F.col("check").alias("item"), F.col("severity").alias("detail"), "rows"))


# The looser contract of JSON records.
RECORD_TYPES = {
    "products": {"sku": "string", "name": "string", "category": "string", "current_stock": "int", "unit_cost": "double", "unit_price": "double",
                 "lead_time_days": "int", "reorder_point": "int", "safety_stock": "int", "average_daily_demand": "double",
                 "seasonality_factor": "double"},
    "sales": {"sku": "string", "date": "string", "quantity_sold": "int", "revenue": "double", "unit_price": "double", "discount": "double",
              "channel": "string", "region": "string"},
}
RECORD_REQUIRED = {"products": ["sku", "name"], "sales": ["sku", "date", "quantity_sold"]}


def validate_records(df: DataFrame, kind: str, record: str = "record") -> DataFrame:
    """Errors and warnings of JSON text records: required fields, types and unknown fields."""
    types = RECORD_TYPES[kind]
    # Both are parsed once a row: an expression that is used more than once stays a column of its own.
    df = df.withColumns({"fields": F.from_json(F.col(record), ", ".join(f"{c} string" for c in types)), "_keys": F.json_object_keys(record)})
    m, keys = F.col("fields"), F.col("_keys")
    errors = [F.when(~F.array_contains(keys, c), F.lit(f"missing {c}")) for c in RECORD_REQUIRED[kind]]
    for c, t in types.items():
        v = m[c]
        if t == "int":
            errors.append(F.when(v.isNotNull() & v.try_cast("int").isNull(), F.lit(f"type {c}")))
        elif t == "double":
            errors.append(F.when(v.isNotNull() & v.try_cast("double").isNull(), F.lit(f"type {c}")))
    known = F.array(*[F.lit(c) for c in types])
    warnings = F.array_sort(F.array_except(keys, known))
    return df.withColumns({"errors": F.array_compact(F.array(*errors)), "warnings": warnings}).drop("_keys")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in a stated order; only one row per key and task is shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def clean(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_per_key(df, keys, order).dropna("any")


def table_stats(products: DataFrame, sales: DataFrame) -> DataFrame:
    s = sales.agg(F.count(F.lit(1)).alias("sales"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    n = products.agg(F.count(F.lit(1)).alias("n")).scalar()
    return s.withColumns({"products": n, "span_days": F.datediff("last_date", "first_date")})


def sales_summary(joined: DataFrame) -> DataFrame:
    """Records, units and revenue per category and product with subtotals."""
    return joined.rollup("category", "sku").agg(
        F.count(F.lit(1)).alias("records"), F.sum("quantity_sold").alias("units"),
        F.sum("revenue").cast("double").alias("revenue"))


def history_metrics(products: DataFrame, sales_days: DataFrame) -> DataFrame:
    """Demand, spread, policy, class, turnover and status from the selling days of a product."""
    q = F.col("qty").cast("bigint")
    newest = Window.partitionBy("product_id").orderBy(F.col("date").desc())
    ranked = sales_days.filter("qty > 0").withColumn("rn", F.row_number().over(newest))
    n, s, ss = F.count(F.lit(1)), F.sum(q), F.sum(q * q)
    g = ranked.groupBy("product_id").agg(
        n.alias("n"), (s.cast("double") / n).alias("avg"), population_sd(n, s, ss).alias("sd0"),
        (F.sum(F.when(F.col("rn") <= 30, q)).cast("double") / F.count_if(F.col("rn") <= 30)).alias("last30"))
    df = products.join(g, "product_id").withColumn("lead", or_default(F.col("lead_time_days"), 7))
    d = F.col("avg")
    df = df.withColumn("sd", F.when(F.col("n") > 1, F.col("sd0")).otherwise(d * 0.3))
    cost = or_default(F.col("unit_cost"), 0.0)
    df = df.withColumns({
        "cv": ratio(F.col("sd"), d), "ss": 1.645 * F.col("sd") * F.sqrt("lead"),
        "cost": F.when(cost == 0, F.col("unit_price") * 0.6).otherwise(cost)})
    df = df.withColumn("rop", d * F.col("lead") + F.col("ss"))
    hold = F.col("cost") * 0.25
    df = df.withColumn("eoq", F.when(hold > 0, F.sqrt(2 * (d * 365) * 50.0 / hold)).otherwise(50.0))
    stock, rop = F.col("current_stock"), F.col("rop")
    return df.select(
        "product_id", d.alias("average_daily_demand"), F.col("cv").alias("demand_volatility"),
        F.col("ss").alias("safety_stock"), rop.alias("reorder_point"), F.col("eoq").alias("economic_order_qty"),
        F.greatest(F.lit(0.5), F.least(F.lit(2.0), ratio(F.col("last30"), d))).alias("seasonality_factor"),
        ratio(F.col("unit_price") - F.col("cost"), F.col("unit_price")).alias("profit_margin"),
        F.when(F.col("cv") < 0.3, "X").when(F.col("cv") < 0.6, "Y").otherwise("Z").alias("xyz_class"),
        ratio(d * 365, F.col("ss") + F.col("eoq") / 2).alias("inventory_turnover"),
        ratio(stock, d * 7).alias("weeks_of_supply"),
        F.when(stock <= 0, "out_of_stock").when(stock <= rop * 0.5, "low_stock").when(stock > rop * 3, "overstock")
        .otherwise("in_stock").alias("stock_status"),
        F.greatest(F.lit(1), F.least(F.lit(365), F.floor(ratio(F.col("eoq"), d) + 0.5).cast("int"))).alias("order_frequency_days"))


def refresh_metrics(products: DataFrame, sales: DataFrame, as_of: dt.date, days: int = 90) -> DataFrame:
    g = since(sales, as_of, days).groupBy("product_id").agg((F.sum("quantity_sold").cast("double") / days).alias("d"))
    df = products.join(g, "product_id", "left").withColumn("demand", F.coalesce("d", F.lit(0.1)))
    d, lead, stock = F.col("demand"), F.col("lead_time_days"), F.col("current_stock")
    df = df.withColumns({"rop": F.round(d * lead * 1.2), "ss": F.round(d * lead * 0.3)})
    return df.select(
        "product_id", d.alias("average_daily_demand"), F.col("rop").alias("reorder_point"), F.col("ss").alias("safety_stock"),
        F.when(d > 0, stock / (d * 7)).otherwise(0.0).alias("weeks_of_supply"),
        F.when(stock > 0, d * 365 / stock).otherwise(0.0).alias("inventory_turnover"),
        F.when(stock == 0, "out_of_stock").when(stock <= F.col("rop"), "low_stock").when(stock > d * 120, "overstock")
        .otherwise("in_stock").alias("stock_status"))


def enrich_catalogue(products: DataFrame, order_cost: float = 50.0) -> DataFrame:
    """Margin, classes, order quantities and a five-band status; class limits are quantiles."""
    rev = F.col("unit_price") * F.col("average_daily_demand")
    limits = exact_quantiles(products.select(rev.alias("_rev")), "_rev", [0.2, 0.5]).scalar()
    d, stock = F.col("average_daily_demand"), F.col("current_stock")
    df = products.withColumns({
        "_rev": rev, "_q": limits, "_eoq": F.round(F.sqrt(2 * d * 365 * order_cost / (F.col("storage_cost_per_unit") * 365 + 0.01)))})
    v = F.col("demand_volatility")
    return df.select(
        "product_id", ratio(F.col("unit_price") - F.col("unit_cost"), F.col("unit_price")).alias("profit_margin"),
        F.when(F.col("_rev") >= F.col("_q")[1], "A").when(F.col("_rev") >= F.col("_q")[0], "B").otherwise("C").alias("abc_class"),
        F.when(v <= 0.3, "X").when(v <= 0.5, "Y").otherwise("Z").alias("xyz_class"),
        F.col("_eoq").alias("economic_order_qty"),
        F.greatest(F.col("min_order_qty").cast("double"), F.least(F.col("_eoq"), F.col("max_order_qty").cast("double"))).alias("reorder_quantity"),
        (d * 365 / (stock + 1)).alias("inventory_turnover"), (stock / (d * 7 + 0.01)).alias("weeks_of_supply"),
        F.when(stock == 0, "OUT_OF_STOCK").when(stock <= F.col("safety_stock"), "CRITICAL")
        .when(stock <= F.col("reorder_point"), "LOW").when(stock <= F.col("reorder_point") * 2, "MEDIUM")
        .otherwise("HIGH").alias("stock_status"))
