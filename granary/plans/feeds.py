"""Ingest, mapping, quality and log queries over raw text feeds derived from the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from granary.functions.prefix import work_folder
from granary.operators import decision as dec  # noqa: F401
from granary.plans.registry import query
from granary.plans.sqlparts import window
from granary.sources import ingest, quality
from granary.sources import schema as sch

D = "try_cast({} as double)"
I_ = "coalesce(cast(trunc(try_cast(trim({0}) as double)) as int), {1})"
CONV_P = f"""select trim(product_code) as sku, trim(product_name) as name, coalesce({D.format('trim(price)')}, 15.0)::double as unit_price, coalesce({D.format('trim(cost)')}, 10.0)::double as unit_cost,
   {I_.format('stock', 0)} as current_stock, coalesce(trim(category), 'General') as category, {I_.format('lead_time', 7)} as lead_time_days,
   coalesce(lower(trim(perishable)) in ('true', '1', 'yes', 'y'), false) as is_perishable, false as is_hazardous, 1.0::double as seasonality_factor, 0.5::double as demand_volatility,
   0.95::double as target_service_level, line_no from raw_products"""
CONV_S = f"""select *, case when _p is null or _c is null then null else (_p - _c) * quantity_sold end as profit_loss_amount, coalesce(case when _p > 0 then (_p - _c) / _p * 100 else 0.0 end, 0.0) as profit_margin_pct
 from (select line_no, trim(product_code) as sku, try_cast(trim(sale_date) as date) as date, {I_.format('qty', 0)} as quantity_sold, coalesce({D.format('trim(amount)')}, 0.0)::double as revenue,
   coalesce({D.format('trim(price)')}, 0.0)::double as unit_price_at_sale, coalesce({D.format('trim(cost)')}, 0.0)::double as unit_cost_at_sale, trim(channel) as sales_channel, 'Normal' as transaction_type,
   {D.format('trim(price)')} as _p, {D.format('trim(cost)')} as _c from raw_sales)"""
FEED = {"convp": CONV_P, "convs": CONV_S}
P_COLS = "sku name unit_price unit_cost current_stock category lead_time_days is_perishable is_hazardous seasonality_factor demand_volatility target_service_level".split()
S_COLS = "line_no sku date quantity_sold revenue unit_price_at_sale unit_cost_at_sale sales_channel transaction_type profit_loss_amount profit_margin_pct".split()
S_DBL = "revenue unit_price_at_sale unit_cost_at_sale profit_loss_amount profit_margin_pct"


@query("MAP01", "select product_code as sku, product_name as name, price as unit_price, cost as unit_cost, stock as current_stock, category, lead_time as lead_time_days, perishable as is_perishable, line_no from raw_products")
def map01(t):
    return sch.rename(t.raw_products, sch.PRODUCT)


@query("MAP02", """select line_no, list_filter([case when cost is null then 'unit_cost' end, case when price is null then 'unit_price' end, case when perishable is null then 'is_perishable' end], lambda x: x is not null) as missing from raw_products
  where cost is null or price is null or perishable is null""")
def map02(t):
    df = sch.rename(t.raw_products, sch.PRODUCT)
    need = ["unit_cost", "unit_price", "is_perishable"]
    assert not sch.missing_columns(df, need)
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in need]))
    return df.select("line_no", gaps.alias("missing")).filter(F.size("missing") > 0)


@query("MAP03", f"select {', '.join(P_COLS)} from convp", "unit_price unit_cost", FEED)
def map03(t):
    return sch.convert(sch.rename(t.raw_products, sch.PRODUCT), sch.PRODUCT).select(*P_COLS)


@query("MAP04", f"select {', '.join(P_COLS)} from convp where current_stock >= 0", "unit_price unit_cost", FEED)
def map04(t):
    return sch.conform_products(t.raw_products, ai=True).select(*P_COLS).filter("current_stock >= 0")


@query("MAP05", f"select {', '.join(S_COLS)} from convs", S_DBL, FEED)
def map05(t):
    return sch.conform_sales(t.raw_sales).select(*S_COLS)


@query("MAP06", "select sku, average_daily_demand, seasonality_factor, demand_volatility, current_stock, reorder_point, safety_stock, lead_time_days from products",
       "average_daily_demand seasonality_factor demand_volatility reorder_point safety_stock")
def map06(t):
    return sch.forecast_features(t.products)


QUAL_P = """select u."check", u.severity, u."rows" from (select count(*) filter (where sku is null) as a, count(*) filter (where name is null) as b, count(*) filter (where current_stock is null) as c, count(*) filter (where unit_cost is null) as d,
   count(*) filter (where unit_price is null) as e, count(*) filter (where lead_time_days is null) as f, count(*) filter (where current_stock < 0) as g, count(*) filter (where unit_cost < 0) as h, count(*) filter (where unit_price <= 0) as i,
   count(*) filter (where unit_price < unit_cost) as j, count(*) filter (where lead_time_days < 0) as k, count(*) filter (where target_service_level <= 0 or target_service_level > 1) as l, count(*) - count(distinct sku) as m from convp) q,
  lateral (values ('missing_sku', 'warning', a), ('missing_name', 'warning', b), ('missing_current_stock', 'warning', c), ('missing_unit_cost', 'warning', d), ('missing_unit_price', 'warning', e), ('missing_lead_time_days', 'warning', f),
   ('negative_stock', 'error', g), ('negative_cost', 'error', h), ('non_positive_price', 'warning', i), ('below_cost', 'warning', j), ('negative_lead_time', 'error', k), ('service_level_range', 'warning', l), ('duplicate_sku', 'warning', m)) u("check", severity, "rows")"""


@query("MAP07", QUAL_P, "", FEED)
def map07(t):
    return quality.quality_report(sch.conform_products(t.raw_products), "product")


@query("MAP07_sales", """select u."check", u.severity, u."rows" from (select count(*) filter (where date is null) as a, count(*) filter (where sku is null) as b, count(*) filter (where quantity_sold is null) as c, count(*) filter (where quantity_sold < 0) as d,
   count(*) filter (where date > (select d from clock) - 30) as e, count(*) filter (where unit_price_at_sale < unit_cost_at_sale) as f from convs) q,
  lateral (values ('missing_date', 'warning', a), ('missing_sku', 'warning', b), ('missing_quantity_sold', 'warning', c), ('negative_quantity', 'error', d), ('future_date', 'warning', e), ('below_cost', 'warning', f)) u("check", severity, "rows")""", "", FEED)
def map07_sales(t):
    return quality.quality_report(sch.conform_sales(t.raw_sales), "sales", t.days_before(30))


@query("MAP08")
def map08(t):
    return quality.dry_run(t.raw_products, sch.PRODUCT, "product", t.as_of)


RECORDS = """select line_no, to_json(struct_pack(sku := trim(product_code), date := sale_date, quantity_sold := replace(qty, '.0', ''), revenue := amount, channel := channel, note := cost)) as record from raw_sales"""


def _records(t):
    s = F.struct(F.trim("product_code").alias("sku"), F.col("sale_date").alias("date"),
                 F.replace("qty", F.lit(".0"), F.lit("")).alias("quantity_sold"), F.col("amount").alias("revenue"),
                 "channel", F.col("cost").alias("note"))
    return t.raw_sales.select("line_no", F.to_json(s).alias("record"))


@query("MAP09", """select line_no, case when try_cast(replace(qty, '.0', '') as int) is null then ['type quantity_sold'] else cast([] as varchar[]) end as errors,
   case when cost is not null then ['note'] else cast([] as varchar[]) end as warnings from raw_sales""")
def map09(t):
    return quality.validate_records(_records(t), "sales").select("line_no", "errors", "warnings")


@query("MAP10", "select sku, current_stock, unit_cost, lead_time_days, reorder_point, safety_stock, average_daily_demand from products",
       "unit_cost reorder_point safety_stock average_daily_demand")
def map10(t):
    return sch.model_columns(t.products, "inventory_optimization")


@query("MAP11", "select sku, date, quantity_sold, cast(revenue as double) as revenue, seasonality_factor, average_daily_demand from sales s join products p on s.product_id = p.product_id", "revenue seasonality_factor average_daily_demand")
def map11(t):
    joined = t.sales().join(t.products.select("product_id", "sku", "seasonality_factor", "average_daily_demand"), "product_id")
    return sch.model_columns(joined.withColumn("revenue", F.col("revenue").cast("double")), "demand_forecasting")


@query("MAP12", """select sku, date, quantity_sold, unit_price_at_sale from (select *, row_number() over (partition by sku, date order by line_no, quantity_sold, revenue, _p) as rn from (select *, case when _p is null then null else unit_price_at_sale end as up from convs))
   where rn = 1 and date is not null and _p is not null""", "unit_price_at_sale", FEED)
def map12(t):
    named = sch.rename(t.raw_sales, sch.SALES)
    df = named.select(
        F.trim("sku").alias("sku"), F.trim("date").try_cast("date").alias("date"), "line_no",
        F.coalesce(F.trim("quantity_sold").try_cast("double").try_cast("int"), F.lit(0)).alias("quantity_sold"),
        F.coalesce(F.trim("revenue").try_cast("double"), F.lit(0.0)).alias("revenue"),
        F.trim("unit_price_at_sale").try_cast("double").alias("unit_price_at_sale"))
    return quality.clean(df, ["sku", "date"], ["line_no", "quantity_sold", "revenue", "unit_price_at_sale"]).select(
        "sku", "date", "quantity_sold", "unit_price_at_sale")


@query("MAP13", """with r as (select *, row_number() over (partition by product_id order by date desc) as rn from part_daily where qty > 0),
   g as (select product_id, count(*) as n, cast(sum(qty) as double) / count(*) as avg, sqrt(greatest(0.0::double, cast(sum(qty * qty) as double) / count(*) - (cast(sum(qty) as double) / count(*)) * (cast(sum(qty) as double) / count(*)))) as sd0,
     cast(sum(qty) filter (where rn <= 30) as double) / count(*) filter (where rn <= 30) as last30 from r group by product_id),
   j as (select p.*, avg, last30, case when n > 1 then sd0 else avg * 0.3 end as sd, case when coalesce(lead_time_days, 0) = 0 then 7 else lead_time_days end as lead, case when coalesce(unit_cost, 0) = 0 then unit_price * 0.6 else unit_cost end as cost from products p join g on p.product_id = g.product_id),
   k as (select * exclude (safety_stock), sd / avg as cv, 1.645::double * sd * sqrt(lead) as ss, case when cost * 0.25 > 0 then sqrt(2 * (avg * 365) * 50.0 / (cost * 0.25)) else 50.0 end as eoq from j),
   m as (select *, avg * lead + ss as rop from k)
  select product_id, avg as average_daily_demand, cv as demand_volatility, ss as safety_stock, rop as reorder_point, eoq as economic_order_qty, greatest(0.5, least(2.0, last30 / avg)) as seasonality_factor,
   (unit_price - cost) / unit_price as profit_margin, case when cv < 0.3 then 'X' when cv < 0.6 then 'Y' else 'Z' end as xyz_class, avg * 365 / (ss + eoq / 2) as inventory_turnover, current_stock / (avg * 7) as weeks_of_supply,
   case when current_stock <= 0 then 'out_of_stock' when current_stock <= rop * 0.5 then 'low_stock' when current_stock > rop * 3 then 'overstock' else 'in_stock' end as stock_status,
   greatest(1, least(365, cast(floor(eoq / avg + 0.5) as int))) as order_frequency_days from m""",
       "average_daily_demand demand_volatility safety_stock reorder_point economic_order_qty seasonality_factor profit_margin inventory_turnover weeks_of_supply")
def map13(t):
    return quality.history_metrics(t.products, t.part_daily())


@query("MAP14", f"""select product_id, demand as average_daily_demand, rop as reorder_point, round(demand * lead_time_days * 0.3) as safety_stock, case when demand > 0 then current_stock / (demand * 7) else 0.0 end as weeks_of_supply,
   case when current_stock > 0 then demand * 365 / current_stock else 0.0 end as inventory_turnover,
   case when current_stock = 0 then 'out_of_stock' when current_stock <= rop then 'low_stock' when current_stock > demand * 120 then 'overstock' else 'in_stock' end as stock_status
  from (select *, round(demand * lead_time_days * 1.2::double) as rop from (select p.*, coalesce(d, 0.1)::double as demand from products p left join
   (select product_id, cast(sum(quantity_sold) as double) / 90 as d from sales where {window(90)} group by product_id) s on p.product_id = s.product_id))""",
       "average_daily_demand reorder_point safety_stock weeks_of_supply inventory_turnover")
def map14(t):
    return quality.refresh_metrics(t.products, t.sales(t.days_before(90)), t.as_of)


@query("MAP15", """with q as (select quantile_cont(unit_price * average_daily_demand, 0.2) as q2, quantile_cont(unit_price * average_daily_demand, 0.5) as q5 from products)
  select product_id, (unit_price - unit_cost) / unit_price as profit_margin, case when unit_price * average_daily_demand >= q5 then 'A' when unit_price * average_daily_demand >= q2 then 'B' else 'C' end as abc_class,
   case when demand_volatility <= 0.3 then 'X' when demand_volatility <= 0.5 then 'Y' else 'Z' end as xyz_class, eoq as economic_order_qty, greatest(min_order_qty::double, least(eoq, max_order_qty::double)) as reorder_quantity,
   average_daily_demand * 365 / (current_stock + 1) as inventory_turnover, current_stock / (average_daily_demand * 7 + 0.01) as weeks_of_supply,
   case when current_stock = 0 then 'OUT_OF_STOCK' when current_stock <= safety_stock then 'CRITICAL' when current_stock <= reorder_point then 'LOW' when current_stock <= reorder_point * 2 then 'MEDIUM' else 'HIGH' end as stock_status
  from (select *, round(sqrt(2 * average_daily_demand * 365 * 50.0 / (storage_cost_per_unit * 365 + 0.01))) as eoq from products), q""",
       "profit_margin economic_order_qty reorder_quantity inventory_turnover weeks_of_supply")
def map15(t):
    return quality.enrich_catalogue(t.products)


@query("MAP16", "select count(*) as sales, min(date) as first_date, max(date) as last_date, (select count(*) from products) as products, cast(max(date) - min(date) as int) as span_days from sales")
def map16(t):
    return quality.table_stats(t.products, t.sales())


@query("MAP17", """select category, sku, count(*) as records, cast(sum(quantity_sold) as bigint) as units, cast(sum(revenue) as double) as revenue from sales s join products p on s.product_id = p.product_id group by rollup (category, sku)""", "revenue")
def map17(t):
    return quality.sales_summary(t.sales().join(t.products.select("product_id", "category", "sku"), "product_id"))


# --- loads ------------------------------------------------------------------

BULK = "select s.*, p.product_id from convs s join products p on s.sku = p.sku where s.date is not null"


@query("SRC01", """with a as (select line_no, trim(product_code) as sku, price, cost from raw_sales), f as (select *, row_number() over (partition by sku order by line_no, price, cost) as rn from a),
   n as (select sku, coalesce(try_cast(trim(price) as double), 15.0) as up, coalesce(try_cast(trim(cost) as double), 10.0) as uc from f where rn = 1)
  select coalesce(p.sku, n.sku) as sku, case when p.sku is null then 'added' when n.sku is null then 'kept' else 'updated' end as change from products p full join n on p.sku = n.sku""")
def src01(t):
    after, _ = ingest.combined_load(t.raw_sales, t.products)
    return after.select("sku", "change")


@query("SRC02", f"select product_id, {', '.join(S_COLS)} from bulk", S_DBL, {**FEED, "bulk": BULK})
def src02(t):
    return ingest.bulk_sales(t.raw_sales, t.products).select("product_id", *S_COLS)


@query("SRC03", "select date, count(*) as n, cast(sum(quantity_sold) as bigint) as units from bulk group by date", "", {**FEED, "bulk": BULK})
def src03(t):
    return ingest.bulk_sales(t.raw_sales, t.products).groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity_sold").alias("units"))


UPS = """select coalesce(p.sku, n.sku) as sku, coalesce(n.name, p.name) as name, coalesce(n.category, p.category) as category, coalesce(n.unit_price, p.unit_price) as unit_price, coalesce(n.unit_cost, p.unit_cost) as unit_cost,
   coalesce(n.current_stock, p.current_stock) as current_stock, coalesce(n.lead_time_days, p.lead_time_days) as lead_time_days, case when p.sku is null then 'added' when n.sku is null then 'kept' else 'updated' end as change
  from products p full join convp n on p.sku = n.sku"""
UPC = ["sku", "name", "category", "unit_price", "unit_cost", "current_stock", "lead_time_days"]


@query("SRC04", "select * from ups", "unit_price unit_cost", {**FEED, "ups": UPS})
def src04(t):
    return ingest.upsert(t.products.select(*UPC), sch.conform_products(t.raw_products).select(*UPC), "sku").select(*UPC, "change")


@query("SRC05", """select line_no, p.product_id, case when quantity_sold > 0 then revenue / quantity_sold end as unit_price_at_sale, coalesce(nullif(unit_cost_at_sale, 0), p.unit_cost) as unit_cost_at_sale,
   (case when quantity_sold > 0 then revenue / quantity_sold end - coalesce(nullif(unit_cost_at_sale, 0), p.unit_cost)) * quantity_sold as profit_loss_amount from convs s join products p on s.sku = p.sku""",
       "unit_price_at_sale unit_cost_at_sale profit_loss_amount", FEED)
def src05(t):
    return ingest.seed_sales(t.raw_sales, t.products).select(
        "line_no", "product_id", "unit_price_at_sale", "unit_cost_at_sale", "profit_loss_amount")


@query("SRC06", "select sku, row_number() over (order by sku) as id from (select distinct trim(product_code) as sku from raw_products)")
def src06(t):
    from granary.functions.prefix import running_totals

    seeds = sch.conform_products(t.raw_products).select("sku").distinct()
    return running_totals(seeds, [F.col("sku")], {}, position="id").select("sku", "id")


UNKNOWN = "select distinct trim(product_code) as sku from raw_sales where trim(product_code) not in (select sku from products)"


@query("SRC07", """select distinct sku, 'General' as category, 0 as current_stock, 10.0::double as unit_cost, 15.0::double as unit_price, 7 as lead_time_days from convs where date is not null and sku not in (select sku from products)""",
       "unit_cost unit_price", FEED)
def src07(t):
    new, _ = ingest.smart_load(t.raw_sales, t.products)
    return new.select("sku", "category", "current_stock", "unit_cost", "unit_price", "lead_time_days")


@query("SRC08", "select distinct trim(product_code) as sku, 'duplicate' as outcome from raw_sales where trim(product_code) in (select sku from products)")
def src08(t):
    incoming = t.raw_sales.select(F.trim("product_code").alias("sku")).distinct()
    return ingest.load_new_products(incoming, t.products)


@query("SRC08_accepted", "select sku, 'accepted' as outcome from unknown", "", {"unknown": UNKNOWN})
def src08_accepted(t):
    return ingest.load_new_products(ingest.unknown_codes(t.raw_sales, t.products), t.products)


@query("SRC09", "select * from unknown", "", {"unknown": UNKNOWN})
def src09(t):
    return ingest.insert_absent(t.raw_sales.select(F.trim("product_code").alias("sku")).distinct(), t.products)


@query("SRC10", "select sku, sku as name, 'General' as category, 100 as current_stock, 10.0::double as unit_cost, 15.0::double as unit_price, 7 as lead_time_days from unknown", "unit_cost unit_price", {"unknown": UNKNOWN})
def src10(t):
    return ingest.bulk_import(t.raw_sales, t.products)


@query("SRC11", "select sku, name, unit_price, unit_cost, current_stock, change from ups", "unit_price unit_cost", {**FEED, "ups": UPS})
def src11(t):
    return ingest.upsert(t.products.select(*UPC), sch.conform_products(t.raw_products).select(*UPC), "sku").select(
        "sku", "name", "unit_price", "unit_cost", "current_stock", "change")


@query("SRC12", """select line_no, s.sku, quantity_sold, case when s.date is null then 'BAD_DATE' when p.product_id is null then 'UNKNOWN_SKU' else 'OK' end as fate from convs s left join products p on s.sku = p.sku""", "", FEED)
def src12(t):
    return ingest.split_sales(t.raw_sales, t.products).select("line_no", "sku", "quantity_sold", "fate")


@query("SRC13", """select line_no, trim(product_code) as sku, try_cast(sale_date as date) as date, try_cast(replace(qty, '.0', '') as int) as quantity_sold, coalesce(try_cast(amount as double), try_cast(replace(qty, '.0', '') as int) * 10) as revenue,
   not (try_cast(replace(qty, '.0', '') as int) is null or try_cast(sale_date as date) is null or p.product_id is null) as accepted from raw_sales r left join products p on trim(product_code) = p.sku""", "revenue")
def src13(t):
    return ingest.ingest_records(_records(t), t.products).select("line_no", "sku", "date", "quantity_sold", "revenue", "accepted")


ITEM = "product_code string, sale_date string, qty string, amount string, price string, cost string"


def documents(t):
    """One API answer per line, under one of the known wrappers or as a bare list."""
    text = F.to_json(F.array(F.struct("product_code", "sale_date", "qty", "amount", "price", "cost")))
    kind = F.col("line_no") % 5
    wrap = F.when(kind == 4, text)
    for i, w in enumerate(ingest.WRAPPERS):
        wrap = F.when(kind == i, F.concat(F.lit(f'{{"{w}":'), text, F.lit("}"))).otherwise(wrap)
    return t.raw_sales.select(F.col("line_no").alias("doc"), wrap.alias("body"))


@query("SRC14", """select line_no as doc, p.product_id, s.date, quantity_sold, revenue from convs s join products p on s.sku = p.sku where s.date is not null""", "revenue", FEED)
def src14(t):
    rows = ingest.import_documents(documents(t), t.products, "sales", ITEM)
    return rows.select("doc", "product_id", "date", "quantity_sold", "revenue")


@query("SRC17", "select id, source_name, status, record_count, created_at from imports where source_name = 'feed-1' and status = 'SUCCESS' order by created_at desc, id desc limit 50")
def src17(t):
    return ingest.import_history(t.imports, "feed-1", "SUCCESS").select("id", "source_name", "status", "record_count", "created_at")


@query("SRC15", """select p.product_id, s.date, quantity_sold, revenue from convs s join products p on s.sku = p.sku where s.date is not null""", "revenue", FEED)
def src15(t):
    """The landed documents once more through the mapping."""
    folder, raw = work_folder(t.spark, "lake"), documents(t).select("body")
    ingest.land_documents(raw, ingest.import_documents(raw, t.products, "sales", ITEM), folder, "run1")
    return ingest.replay(t.spark, folder, "run1", t.products, "sales", ITEM).select("product_id", "date", "quantity_sold", "revenue")


@query("SRC16", """select r.name, (select count(*) from convs s join products p on s.sku = p.sku where s.date is not null and s.line_no % 2 = r.k) as rows,
  (select count(*) from raw_sales where line_no % 2 = r.k) as documents from (select unnest([0, 1]) as k, unnest(['even', 'odd']) as name) r""", "", FEED)
def src16(t):
    """Two landings, one of them retried: the manifest has one entry for each."""
    folder = work_folder(t.spark, "lake")
    for k, name in ((0, "even"), (1, "odd"), (1, "odd")):
        raw = documents(t).filter(F.col("doc") % 2 == k).select("body")
        manifest = ingest.land_documents(raw, ingest.import_documents(raw, t.products, "sales", ITEM), folder, name)
    return manifest.select("name", "rows", "documents")


@query("SNK03", "select count(*) filter (where date < (select d from clock) - 730) as deleted, count(*) filter (where date >= (select d from clock) - 730) as kept, (select d from clock) - 730 as cutoff from sales")
def snk03(t):
    return ingest.retention_report(t.sales(), t.as_of)


@query("SNK03_kept", f"select product_id, date, quantity_sold from sales where {window(730)}")
def snk03_kept(t):
    return ingest.retained(t.sales(t.days_before(730)), t.as_of).select("product_id", "date", "quantity_sold")


@query("SNK05", """select id, channel, substr(repeat(alert_key || ' raised an error; ', 20), 1, 250) as subject, '["ops@example.com","' || alert_key || '@example.com"]' as recipients, status, alert_key from notices""")
def snk05(t):
    subject = F.repeat(F.concat("alert_key", F.lit(" raised an error; ")), 20)
    people = F.array(F.lit("ops@example.com"), F.concat("alert_key", F.lit("@example.com")))
    return ingest.notification_rows(t.notices, subject, people)


@query("SNK06", """select case when s.date is null then 'BAD_DATE' else 'UNKNOWN_SKU' end as error_message, count(*) as record_count, 'bulk' as source_name, 'FAILED' as status from convs s left join products p on s.sku = p.sku
  where s.date is null or p.product_id is null group by 1""", "", FEED)
def snk06(t):
    fated = ingest.split_sales(t.raw_sales, t.products)
    return ingest.dead_letters(fated, "bulk", dt.datetime(2001, 11, 4)).drop("created_at")
