"""Bands, filters, search, paging and worklists."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import demand, listing
from granary.operators.policy import Bands
from granary.plans.registry import query
from granary.plans.sqlparts import BAND, SUGGESTED, demand_join, policy, window

YEAR = 365


@query("FIL01", f"""select product_id, current_stock, {BAND} as band,
  case when current_stock = 0 then 'CRITICAL' when current_stock <= 10 then 'HIGH'
       when current_stock <= 50 then 'LOW' else 'SAFE' end as band_risk from products""")
def fil01(t):
    return listing.with_band(t.products).select("product_id", "current_stock", "band", "band_risk")


@query("FIL02", """select product_id, sku, current_stock from products
  where current_stock > 20 and current_stock <= 100""")
def fil02(t):
    return listing.in_band(t.products, "MEDIUM", Bands(20, 100)).select("product_id", "sku", "current_stock")


@query("FIL03", """select product_id, sku, name, category, sku || ' - ' || name as display_name from products
  where (name ilike '%ring%' or sku ilike '%ring%' or category ilike '%ring%') and category = 'ECONOMY'
  order by product_id limit 500""")
def fil03(t):
    return listing.dropdown(t.products, "RING", "ECONOMY", 500)


@query("FIL04", "select distinct category from products where category is not null and category <> ''")
def fil04(t):
    return listing.categories(t.products)


@query("FIL05", f"""with page as (select * from products where current_stock > 50
     order by product_id limit 50 offset 100),
  j as (select * from ({demand_join(YEAR)}) where product_id in (select product_id from page))
  select product_id, sku, name, category, current_stock, unit_cost, unit_price, lead_time_days,
   {BAND} as stock_badge, reorder_point, safety_stock, order_quantity,
   case when demand is null then 'N/A' when current_stock <= reorder_point then 'REORDER NOW'
        when current_stock <= reorder_point * 1.5 then 'REORDER SOON' else 'OK' end as reorder_status,
   coalesce(demand, 0.0) as demand_per_day, stockout_risk, risk_percentage,
   case when demand is not null then cast(trunc(current_stock / demand) as int) end as days_until_stockout
  from ({policy('j')})""", "demand_per_day risk_percentage")
def fil05(t):
    page = listing.page(t.products, 3, 50, band="HIGH")
    recent = listing.only_ids(t.sales(t.days_before(YEAR)), page)
    return listing.enriched(page, recent, t.as_of, YEAR)


@query("FIL06", f"""with j as ({demand_join(YEAR)})
  select product_id, sku, name, category, current_stock, unit_cost, unit_price, lead_time_days,
   {BAND} as stock_badge, reorder_point, safety_stock, order_quantity,
   case when demand is null then 'N/A' when current_stock <= reorder_point then 'REORDER NOW'
        when current_stock <= reorder_point * 1.5 then 'REORDER SOON' else 'OK' end as reorder_status,
   coalesce(demand, 0.0) as demand_per_day, stockout_risk, risk_percentage,
   case when demand is not null then cast(trunc(current_stock / demand) as int) end as days_until_stockout
  from ({policy('j')})""", "demand_per_day risk_percentage")
def fil06(t):
    return listing.enriched(t.products, t.sales(t.days_before(YEAR)), t.as_of, YEAR)


@query("FIL07", f"""select product_id, sku, name, category, current_stock, band, cast(position as int) as position,
   greatest(coalesce(cast(trunc(reorder_point) as int), 0),
     case when average_daily_demand > 0 then cast(trunc(average_daily_demand * 14) as int)
          else cast(coalesce(nullif(reorder_point, 0), 100) as int) end) as order_quantity,
   coalesce(average_daily_demand, 0.0) as demand_per_day,
   case when current_stock > 0 then cast(trunc(days) as int) end as days_left, lead_time_days, unit_cost
  from (select *, row_number() over (partition by band order by days, average_daily_demand desc nulls last, product_id) as position
   from (select *, {BAND} as band, case when current_stock = 0 then 0.0 when average_daily_demand > 0
           then current_stock / average_daily_demand else 999.0 end as days
         from products where current_stock <= 10))""", "demand_per_day")
def fil07(t):
    return listing.worklist(t.products)


@query("FIL08", f"""select product_id, sku, name, category, current_stock from products
  where product_id in (select product_id from sales where {window(7)}) and current_stock > 0""")
def fil08(t):
    sold = t.sales(t.days_before(7)).select("product_id")
    return listing.only_ids(t.products.filter("current_stock > 0"), sold).select(*listing.BASIC)


@query("FIL09", """select product_id, sku, name, category, current_stock, case when current_stock = 0 then 'CRITICAL' else 'LOW' end as alert_type
   from products where current_stock <= 10""")
def fil09(t):
    return listing.threshold_alerts(t.products)


@query("FIL10", f"""select product_id, sku, name, category, current_stock,
  case when current_stock = 0 then 'CRITICAL' else 'WARNING' end as alert_level,
  case when average_daily_demand > 0 then cast(trunc(current_stock / average_daily_demand) as int) end as days_until_stockout,
  reorder_point, {SUGGESTED} as suggested_order from products where current_stock <= 10""",
       "reorder_point suggested_order")
def fil10(t):
    return listing.stock_notifications(t.products)


@query("FIL11", f"""select count(*) as items, count(*) filter (where current_stock = 0) as out_of_stock,
  count(*) filter (where current_stock > 0) as low_stock, sum({SUGGESTED}) as units_to_order,
  sum({SUGGESTED} * unit_cost) as estimated_cost from products where current_stock <= 10""",
       "units_to_order estimated_cost")
def fil11(t):
    return listing.alert_digest(t.products)


@query("FIL12", """select count(*) as total_products, count(*) filter (where current_stock = 0) as out_of_stock,
  count(*) filter (where current_stock between 1 and 10) as low_stock,
  count(*) filter (where current_stock between 11 and 50) as medium_stock,
  (select sum(coalesce(nullif(average_daily_demand, 0), 5) * (unit_price - unit_cost)) from
    (select * from products where current_stock = 0)) as daily_loss from products""",
       "daily_loss")
def fil12(t):
    return listing.digest_preview(t.products)


@query("FIL13", f"""select product_id, name, current_stock, days_of_inventory from (
  select p.product_id, name, current_stock,
   case when coalesce(r.per_day, 0) = 0 then 999.0 else current_stock / r.per_day end as days_of_inventory
  from products p left join (select product_id, cast(sum(quantity_sold) as double) / 365 as per_day
     from sales where {window(YEAR)} group by product_id) r on p.product_id = r.product_id)
  where days_of_inventory > 90""", "days_of_inventory")
def fil13(t):
    rates = demand.since(t.sales(t.days_before(YEAR)), t.as_of, YEAR).groupBy("product_id").agg(
        (F.sum("quantity_sold").cast("double") / YEAR).alias("per_day"))
    return listing.slow_movers(t.products, rates)


@query("FIL14", f"""select date, cast(sum(quantity_sold) as bigint) as units, sum(revenue) as revenue
  from sales where {window(30)} group by date""", "revenue")
def fil14(t):
    trend = t.sales(t.days_before(30)).groupBy("date").agg(
        F.sum("quantity_sold").alias("units"), F.sum("revenue").cast("double").alias("revenue"))
    return listing.day_window(trend, t.as_of, 30)


@query("FIL15", "select address from recipients where channel = 'email' and is_active")
def fil15(t):
    return listing.active_recipients(t.recipients, "email", ["ops@example.com"])


@query("FIL16", """select token, cast(match_rank as int) as match_rank, product_id, sku, name from (
  select token, case when contains(lower(sku), token) then 1 else 2 end as match_rank, product_id, sku, name,
   row_number() over (partition by token order by case when contains(lower(sku), token) then 1 else 2 end, product_id) as rn
  from products join (values ('sku-000042'), ('widget'), ('0007'), ('ring')) v(token)
    on contains(lower(sku), token) or contains(lower(name), token)) where rn = 1""")
def fil16(t):
    return listing.find_product(t.products, ["SKU-000042", "Widget", "0007", "ring"])
