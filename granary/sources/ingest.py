"""Feeds into product and sales tables: bulk loads, upserts, JSON documents and sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.quality import first_per_key, validate_records
from granary.sources.schema import PRODUCT, SALES, conform_products, conform_sales, convert, rename

# What a product gets when a sales feed mentions it first.
NEW_PRODUCT = {"unit_cost": 10.0, "unit_price": 15.0, "lead_time_days": 7}


def read_text_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """A messy CSV as strings under a declared header; nothing is inferred from the data."""
    schema = ", ".join(f"`{h}` string" for h in header)
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", enforceSchema=True)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV from its first line only."""
    return spark.read.option("header", True).csv(path, samplingRatio=None).limit(0).columns


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming non-null values replace existing ones; unknown keys are added."""
    cols = [c for c in incoming.columns if c != key]
    inc = incoming.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_inc"))
    joined = existing.withColumn("_old", F.lit(True)).join(inc, key, "full_outer")
    out = []
    for c in existing.columns:
        out.append(F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in cols else F.col(c))
    out += [F.col(f"_n_{c}").alias(c) for c in cols if c not in existing.columns]
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_inc").isNull(), "kept").otherwise("updated")
    return joined.select(*out, state.alias("change"))


def bulk_sales(raw: DataFrame, products: DataFrame) -> DataFrame:
    """Conformed sales of known products with a valid date."""
    df = conform_sales(raw).filter("date is not null")
    return df.join(products.select("sku", "product_id"), "sku")


def seed_sales(raw: DataFrame, products: DataFrame) -> DataFrame:
    """Price at sale from revenue, cost from the catalogue when the feed has none."""
    df = convert(rename(raw, SALES), SALES).join(
        products.select("sku", "product_id", F.col("unit_cost").alias("_cost")), "sku")
    raw_cost = F.nullif(F.col("unit_cost_at_sale"), F.lit(0.0)) if "unit_cost_at_sale" in df.columns else F.lit(None).cast("double")
    q = F.col("quantity_sold")
    df = df.withColumns({
        "unit_price_at_sale": F.when(q > 0, F.col("revenue") / q), "unit_cost_at_sale": F.coalesce(raw_cost, F.col("_cost"))})
    return df.withColumn("profit_loss_amount", (F.col("unit_price_at_sale") - F.col("unit_cost_at_sale")) * q).drop("_cost")


def unknown_codes(raw_sales: DataFrame, products: DataFrame) -> DataFrame:
    """Product codes a sales feed uses that the catalogue does not have."""
    seen = rename(raw_sales, SALES).select(F.trim("sku").alias("sku")).distinct()
    return seen.join(products.select("sku"), "sku", "left_anti")


# Header candidates per role of the onboarding mapper, best first.
ROLES = {
    "date": ("date", "order_date", "invoice_date", "transaction_date", "sales_date", "sale_date"),
    "sku": ("sku", "product_code", "item_code", "item_id", "productid", "product_id", "upc"),
    "quantity_sold": ("quantity_sold", "quantity", "qty", "units", "units_sold", "sales_qty", "sold_units"),
    "revenue": ("revenue", "amount", "line_total", "sales_amount", "total_price", "net_sales"),
    "name": ("product_name", "name", "item_name", "description"),
    "category": ("category", "product_category", "segment"),
}


def resolve_roles(columns: list[str], required: tuple[str, ...] = ("date", "sku", "quantity_sold")) -> dict[str, str]:
    """First matching header per role; raises with the roles nothing matches."""
    by_norm = {c.strip().lower().replace(" ", "_"): c for c in columns}
    found = {}
    for role, names in ROLES.items():
        for n in names:
            if n in by_norm:
                found[role] = by_norm[n]
                break
    absent = [r for r in required if r not in found]
    if absent:
        raise ValueError(f"no column for: {', '.join(absent)}")
    return found


def smart_load(raw: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Onboarding: resolve headers, create unknown products with defaults, return both tables."""
    roles = resolve_roles(raw.columns)
    df = convert(raw.select(*[F.col(f"`{c}`").alias(r) for r, c in roles.items()]), SALES).filter("date is not null")
    name = F.col("name") if "name" in roles else F.col("sku")
    category = F.coalesce(F.col("category"), F.lit("General")) if "category" in roles else F.lit("General")
    seen = df.groupBy("sku").agg(F.min(name).alias("name"), F.min(category).alias("category"))
    new = seen.join(products.select("sku"), "sku", "left_anti").withColumns(
        {"current_stock": F.lit(0), **{k: F.lit(v) for k, v in NEW_PRODUCT.items()}})
    return new, df.select("sku", "date", "quantity_sold", *(["revenue"] if "revenue" in roles else []))


def load_new_products(incoming: DataFrame, products: DataFrame) -> DataFrame:
    """All or nothing: if any code exists, the duplicates come back and nothing is accepted."""
    dup = incoming.join(products.select("sku"), "sku", "left_semi").select("sku", F.lit("duplicate").alias("outcome"))
    ok = incoming.select("sku", F.lit("accepted").alias("outcome")).filter(~dup.limit(1).exists())
    return dup.unionByName(ok)


def insert_absent(incoming: DataFrame, products: DataFrame) -> DataFrame:
    return incoming.join(products.select("sku"), "sku", "left_anti")


def combined_load(raw: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A file with product and sales columns: upsert the first, append the second.

    Of several lines of one product the first, by line number, sets its attributes.
    """
    named = rename(raw, PRODUCT)
    attrs = [c for c in ("name", "category", "current_stock", "unit_cost", "unit_price", "lead_time_days") if c in named.columns]
    first = first_per_key(named.withColumn("sku", F.trim("sku")).filter("sku <> ''"), ["sku"], ["line_no"])
    new = convert(first.select("sku", *attrs), PRODUCT).select("sku", *attrs)
    after = upsert(products.select("sku", *[c for c in attrs if c in products.columns]), new, "sku")
    return after, bulk_sales(raw, products)


def bulk_import(raw: DataFrame, products: DataFrame, stock: int = 100) -> DataFrame:
    """Products a sales import has to create before its rows can be appended."""
    return unknown_codes(raw, products).withColumns({
        "name": F.col("sku"), "category": F.lit("General"), "current_stock": F.lit(stock),
        **{k: F.lit(v) for k, v in NEW_PRODUCT.items()}})


def split_sales(raw: DataFrame, products: DataFrame) -> DataFrame:
    """Every row with its fate: appended, unknown code or bad date."""
    df = conform_sales(raw)
    out = df.join(products.select("sku", "product_id"), "sku", "left")
    fate = F.when(F.col("date").isNull(), "BAD_DATE").when(F.col("product_id").isNull(), "UNKNOWN_SKU").otherwise("OK")
    return out.withColumn("fate", fate)


def ingest_records(records: DataFrame, products: DataFrame, strict: bool = False) -> DataFrame:
    """JSON sales records: validate, look up, default the revenue; bad rows keep their errors.

    Dates must be year-month-day.  In strict mode a warning rejects the record too.
    """
    v = validate_records(records, "sales")
    m = F.col("fields")
    day = F.when(F.rlike(m["date"], F.lit(r"^\d{4}-\d{2}-\d{2}$")), m["date"].try_cast("date"))
    v = v.withColumns({
        "sku": F.trim(m["sku"]), "date": day, "quantity_sold": m["quantity_sold"].try_cast("int"),
        "revenue": F.coalesce(m["revenue"].try_cast("double"), (m["quantity_sold"].try_cast("int") * 10).cast("double"))})
    v = v.join(products.select("sku", "product_id"), "sku", "left")
    bad = (F.size("errors") > 0) | F.col("date").isNull() | F.col("product_id").isNull()
    if strict:
        bad = bad | (F.size("warnings") > 0)
    return v.withColumn("accepted", ~F.coalesce(bad, F.lit(True))).drop("fields")


# ---- landed API documents ---------------------------------------------------

WRAPPERS = ("data", "items", "products", "results")


def unwrap_documents(docs: DataFrame, item_schema: str, body: str = "body") -> DataFrame:
    """Rows of JSON documents: the first non-empty wrapper, a bare list, or the object itself."""
    wrapped = F.from_json(F.col(body), "struct<" + ",".join(f"{w}:array<struct<{item_schema}>>" for w in WRAPPERS) + ">")
    single = F.from_json(F.col(body), f"struct<{item_schema}>")
    listed = F.from_json(F.col(body), f"array<struct<{item_schema}>>")
    # The other two forms are parsed only where they are used.
    df = docs.withColumn("_w", wrapped)
    filled = [F.when(F.size(F.col(f"_w.{w}")) > 0, F.col(f"_w.{w}")) for w in WRAPPERS]
    bare = F.when(F.ltrim(F.col(body)).startswith("["), listed)
    rows = F.coalesce(*filled, bare, F.array(single))
    keep = [c for c in docs.columns if c != body]
    return df.select(*keep, F.explode(rows).alias("_r")).select(*keep, "_r.*")


def import_documents(docs: DataFrame, products: DataFrame, kind: str, item_schema: str, body: str = "body") -> DataFrame:
    """Documents to rows of the target: products upserted, sales appended, inventory set."""
    rows = unwrap_documents(docs, item_schema, body)
    if kind == "sales":
        return bulk_sales(rows, products)
    if kind == "inventory":
        counts = rename(rows, PRODUCT).select(F.trim("sku").alias("sku"), F.col("current_stock").try_cast("int").alias("current_stock"))
        return upsert(products.select("sku", "current_stock"), counts.groupBy("sku").agg(F.max("current_stock").alias("current_stock")), "sku")
    new = conform_products(rows)
    cols = [c for c in new.columns if c in products.columns and c != "product_id"]
    return upsert(products.select(*cols), first_per_key(new.select(*cols), ["sku"], cols), "sku")


def import_history(log: DataFrame, source: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    if source:
        log = log.filter(F.col("source_name") == source)
    if status:
        log = log.filter(F.col("status") == status)
    return log.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


# ---- sinks -------------------------------------------------------------------

def append_forecasts(forecast: DataFrame, path: str, run_date: dt.date) -> None:
    """Forecast rows of one run; the run's partition is replaced, so a retry cannot double it."""
    (forecast.withColumn("run_date", F.lit(run_date)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path))


def append_recommendations(policy: DataFrame, path: str, run_date: dt.date) -> None:
    append_forecasts(policy, path, run_date)


def retained(sales: DataFrame, as_of: dt.date, days_to_keep: int = 730) -> DataFrame:
    return sales.filter(F.col("date") >= F.lit(as_of - dt.timedelta(days=days_to_keep)))


def retention_report(sales: DataFrame, as_of: dt.date, days_to_keep: int = 730) -> DataFrame:
    cutoff = as_of - dt.timedelta(days=days_to_keep)
    old = F.col("date") < F.lit(cutoff)
    return sales.agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept"), F.lit(cutoff).alias("cutoff"))


def notification_rows(sent: DataFrame, subject: Column, recipients: Column) -> DataFrame:
    """Audit rows: subject cut at 250 characters, recipients as a JSON list."""
    return sent.select("id", "channel", F.substring(subject, 1, 250).alias("subject"),
                       F.to_json(recipients).alias("recipients"), "status", "alert_key")


def dead_letters(fated: DataFrame, source: str, started: dt.datetime) -> DataFrame:
    """One failed-import row per kind of rejection, with its count."""
    return fated.filter("fate <> 'OK'").groupBy(F.col("fate").alias("error_message")).agg(
        F.count(F.lit(1)).alias("record_count")).withColumns({
            "source_name": F.lit(source), "status": F.lit("FAILED"), "created_at": F.lit(started)})


def land_documents(raw: DataFrame, rows: DataFrame, folder: str, name: str) -> DataFrame:
    """Two tiers: the documents as received and the mapped rows; returns the manifest entry."""
    raw.write.mode("overwrite").parquet(f"{folder}/bronze/{name}")
    rows.write.mode("overwrite").parquet(f"{folder}/silver/{name}")
    spark = raw.sparkSession
    n_raw = spark.read.parquet(f"{folder}/bronze/{name}").agg(F.count(F.lit(1)).alias("n")).scalar()
    entry = spark.read.parquet(f"{folder}/silver/{name}").agg(F.count(F.lit(1)).alias("rows")).withColumns({
        "name": F.lit(name), "documents": n_raw, "bronze": F.lit(f"{folder}/bronze/{name}"), "silver": F.lit(f"{folder}/silver/{name}")})
    entry.write.mode("overwrite").parquet(f"{folder}/manifest/entry={name}")
    return spark.read.parquet(f"{folder}/manifest")


def replay(spark: SparkSession, folder: str, name: str, products: DataFrame, kind: str, item_schema: str) -> DataFrame:
    """Run a landed file through the same mapping again."""
    return import_documents(spark.read.parquet(f"{folder}/bronze/{name}"), products, kind, item_schema)
