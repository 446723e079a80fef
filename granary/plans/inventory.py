"""Reorder, loss, alert, advisor and exception queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from granary.functions.prefix import work_folder
from granary.sources.ingest import append_recommendations
from granary.functions.mathx import norm_cdf_sql, norm_pdf_sql, norm_ppf_sql, z_value
from granary.functions.prefix import running_totals
from granary.operators import decision as dec
from granary.operators import inventory as inv
from granary.operators import listing, policy as pol
from granary.operators.demand import daily_stats as spark_daily_stats
from granary.operators.demand import population_sd, transaction_stats
from granary.plans.registry import query
from granary.plans.sqlparts import Z95, daily_stats, demand_join, policy, row_avg, trans_stats, window

YEAR = 365

LEAD = "case when coalesce(lead_time_days, 0) = 0 then 7 else lead_time_days end"

SPAN = f"""select p.*, {LEAD} as lead, s.span_days, s.active_days,
  cast(s.total_qty as double) / (s.span_days + 1) as avg_daily,
  cast(s.total_qty as double) / (s.span_days + 1) * 365 as annual_demand,
  case when s.sd_daily is null or s.sd_daily = 0 then cast(s.total_qty as double) / (s.span_days + 1) * 0.3 else s.sd_daily end as sd_daily,
  (select d from clock) - s.last_date as days_since_last_sale
  from products p join ({daily_stats()}) s on p.product_id = s.product_id"""

EOQ = """select *, greatest(1.0::double, case when upper(product_priority) = 'HIGH'
    then capped * (1.0::double + case when annual_demand > 0 then greatest(0.10::double, least(0.30::double, sd_daily / avg_daily * 0.15::double + 0.10::double)) else 0.15::double end)
    else capped end) as eoq
 from (select *, least(greatest(blended, cast(min_order_qty as double)), cast(max_order_qty as double)) as capped
 from (select *, case when order_frequency_days > 0 and abs(rhythm - pure_eoq) / pure_eoq > 0.2
     then greatest(0.5::double, 1.0::double - abs(rhythm - pure_eoq) / pure_eoq * 0.5::double) * pure_eoq
        + (1.0::double - greatest(0.5::double, 1.0::double - abs(rhythm - pure_eoq) / pure_eoq * 0.5::double)) * rhythm
     else pure_eoq end as blended
 from (select *, annual_demand / (365.0::double / order_frequency_days) as rhythm,
     case when annual_demand > 0 then 365.0::double / (annual_demand / pure_eoq) else 30.0::double end as implied_order_days
 from (select *, greatest(1.0::double, case when holding_cost = 0 then annual_demand / 12
     else sqrt(2.0::double * annual_demand * 50.0::double / holding_cost) end) as pure_eoq
 from (select *, case when storage_cost_per_unit > 0 then storage_cost_per_unit else unit_cost * 0.25::double end as holding_cost from span)))))"""

SS = f"""select * exclude (reorder_point, safety_stock), z_score * sd_daily * sqrt(lead) as uncapped_safety_stock,
   greatest(0.0::double, limited) as safety_stock, coalesce(limited < z_score * sd_daily * sqrt(lead), false) as shelf_life_capped
 from (select *, case when shelf_life_days > 0 and avg_daily > 0 then
     (case when shelf_life_days - lead > 0 then least(z_score * sd_daily * sqrt(lead), (shelf_life_days - lead) * avg_daily * 0.5::double) else 0.0 end)
     else z_score * sd_daily * sqrt(lead) end as limited
 from (select *, {norm_ppf_sql('service_level')} as z_score
 from (select *, case when stockout_cost_per_unit > 0 and holding_cost > 0
     then greatest(0.85::double, least(0.99::double, stockout_cost_per_unit / (stockout_cost_per_unit + holding_cost))) else 0.95::double end as service_level from eoqs)))"""

FULL = f"""select *, annual_holding + annual_ordering + annual_stockout as total_annual_cost from (
 select *, greatest(0.0::double, reorder_point + eoq * 0.75 - avg_inventory) * holding_cost as annual_savings,
   avg_inventory * holding_cost as annual_holding, annual_demand / eoq * 50.0 as annual_ordering,
   case when stockout_cost_per_unit > 0 then annual_demand / eoq * (sd_daily * sqrt(lead) *
      ({norm_pdf_sql('z_score')} - z_score * (1.0 - service_level))) * stockout_cost_per_unit else 0.0 end as annual_stockout,
   case when avg_inventory > 0 then annual_demand / avg_inventory else 0.0 end as turnover,
   optimal_stock * weight_kg as stock_weight_kg, optimal_stock * volume_m3 as stock_volume_m3,
   case when days_since_last_order / (365.0 / (annual_demand / eoq)) > 1.5 then 'HIGH'
        when days_since_last_order / (365.0 / (annual_demand / eoq)) > 1.0 then 'MEDIUM' else 'NORMAL' end as reorder_urgency,
   case when days_since_last_sale > 180 then 'CRITICAL' when days_since_last_sale > 90 then 'HIGH'
        when days_since_last_sale > 60 then 'MEDIUM' else 'NONE' end as dead_stock_risk
 from (select *, reorder_point + eoq as optimal_stock, eoq / 2.0 + safety_stock as avg_inventory
 from (select *, greatest(0.0::double, avg_daily * lead + safety_stock) as reorder_point from sss)))"""

OPT = {"span": SPAN, "eoqs": EOQ, "sss": SS, "full_policy": FULL}


def _span(t):
    return pol.span_inputs(t.products, spark_daily_stats(t.sales(), t.as_of), t.as_of)


@query("INV01", "select product_id, holding_cost, pure_eoq, implied_order_days, eoq from eoqs",
       "holding_cost pure_eoq implied_order_days eoq", OPT)
def inv01(t):
    return pol.order_quantity_terms(_span(t)).select(
        "product_id", "holding_cost", "pure_eoq", "implied_order_days", "eoq")


@query("INV02", """select product_id, service_level, z_score, uncapped_safety_stock, safety_stock, shelf_life_capped from sss""",
       "service_level z_score uncapped_safety_stock safety_stock", OPT)
def inv02(t):
    return pol.safety_stock_terms(pol.order_quantity_terms(_span(t))).select(
        "product_id", "service_level", "z_score", "uncapped_safety_stock", "safety_stock", "shelf_life_capped")


@query("INV03", "select product_id, greatest(0.0::double, avg_daily * lead + safety_stock) as reorder_point from sss",
       "reorder_point", OPT)
def inv03(t):
    return pol.full_policy(_span(t)).select("product_id", "reorder_point")


FULL_COLS = ("product_id eoq safety_stock reorder_point optimal_stock avg_daily sd_daily service_level annual_savings "
             "annual_holding annual_ordering annual_stockout total_annual_cost turnover stock_weight_kg "
             "stock_volume_m3 reorder_urgency dead_stock_risk").split()


@query("INV04", f"select {', '.join(FULL_COLS)} from full_policy", " ".join(FULL_COLS[1:-2]), OPT)
def inv04(t):
    return pol.full_policy(_span(t)).select(*FULL_COLS)


@query("SNK02", f"select {', '.join(FULL_COLS)}, run_date from full_policy, (select unnest([date '2001-11-03', date '2001-11-04']) as run_date) runs", " ".join(FULL_COLS[1:-2]), OPT)
def snk02(t):
    """Two runs are appended, the second of them twice; the retry replaces its own partition."""
    path = work_folder(t.spark, "recommendations")
    for day in (3, 4, 4):
        append_recommendations(inv04(t), path, dt.date(2001, 11, day))
    return t.spark.read.parquet(path)


@query("INV05", f"""with j as ({demand_join(YEAR)})
  select product_id, demand, sigma, safety_stock, reorder_point, eoq, order_quantity, risk_percentage, stockout_risk
  from ({policy('j')})""", "demand sigma risk_percentage")
def inv05(t):
    df = listing.with_demand(t.products, t.sales(t.days_before(YEAR)), t.as_of, YEAR)
    return pol.compact_policy(df).select(
        "product_id", "demand", "sigma", "safety_stock", "reorder_point", "eoq", "order_quantity",
        "risk_percentage", "stockout_risk")


@query("INV06", f"""with j as (select p.* exclude (reorder_point, safety_stock), case when coalesce(s.total_qty, 0) > 0 then cast(s.total_qty as double) / greatest(s.active_days, 30)
       else coalesce(nullif(p.average_daily_demand, 0), 1.0) end as demand, s.sigma, {LEAD} as lead,
       coalesce(nullif(unit_cost, 0), 1.0) as cost
     from products p left join ({trans_stats(90)}) s on p.product_id = s.product_id where current_stock <= 50)
  select product_id, sku, name, category, current_stock, reorder_point, safety_stock, eoq,
    reorder_point + safety_stock as optimal_stock,
    greatest(0.0::double, greatest(current_stock::double, (eoq / 2.0 + safety_stock) * 1.5) - (eoq / 2.0 + safety_stock))
      * greatest(cost * 0.25, 0.01) as savings, current_stock < reorder_point as needs_reorder
  from ({policy('j')})""", "savings")
def inv06(t):
    stats = transaction_stats(t.sales(t.days_before(90)), t.as_of, 90)
    return inv.recommendations(t.products, stats)


@query("INV07", f"""select product_id, case when current_stock <= 0 then 'CRITICAL' when current_stock < reorder_point * 0.5 then 'CRITICAL'
    when current_stock < reorder_point then 'HIGH' when current_stock < reorder_point * 1.5 then 'MEDIUM' else 'LOW' end as risk_level,
  case when current_stock <= 0 then 0.0 when avg_daily > 0 then current_stock / avg_daily else 999.0 end as days_of_stock,
  case when current_stock <= 0 then 1.0 when sd_daily > 0
    then 1.0 - {norm_cdf_sql('(current_stock - reorder_point) / (sd_daily * sqrt(7.0::double))')} else 0.0 end as probability
  from full_policy""", "days_of_stock probability", OPT)
def inv07(t):
    c = F.col
    return pol.full_policy(_span(t)).select("product_id", *[
        v.alias(k) for k, v in pol.stockout_risk_band(
            c("current_stock"), c("reorder_point"), c("avg_daily"), c("sd_daily")).items()])


REORDER = f"""select * exclude (reorder_point, safety_stock, average_daily_demand, ss, rop),
   cast(ceil(rop) as int) as reorder_point, cast(ceil(ss) as int) as safety_stock,
   cast(demand as int) as average_daily_demand, case when current_stock > rop then 'NORMAL' else 'REORDER_NEEDED' end as status
 from (select *, demand * lead + ss as rop from (select *, greatest(1.65::double * sd_daily * sqrt(lead), demand) as ss from (
  select p.*, {LEAD} as lead, coalesce(greatest(1.0::double, ceil(cast(s.total_qty as double) / 90)), 1.0) as demand,
     coalesce(s.sd_daily, 0.0) as sd_daily, coalesce(cast(s.total_qty as double) / 90, 0.0) as rate
  from products p left join ({daily_stats(90)}) s on p.product_id = s.product_id)))"""

LATEST = """select product_id, predicted_demand, confidence_level from (select *,
   row_number() over (partition by product_id order by forecast_date desc) as rn from forecasts) where rn = 1"""

RISK = """select * exclude (risk, lvl, days, spike), case when spike then 'HIGH' else lvl end as risk_level,
   cast(floor(days) as int) as days_until_stockout,
   cast(floor(case when spike then least(100.0::double, risk + 20) else risk end + 0.5) as int) as risk_percentage,
   cast(floor(coalesce(nullif(confidence_level, 0), 0.95) * 100 + 0.5) as int) as forecast_confidence
 from (select *, case when days <= 7 then least(100.0::double, 100.0::double - days / 7 * 80) when days <= 14 then 30.0::double + (14 - days) / 7 * 40
      else greatest(5.0::double, 30.0::double * exp(-0.05::double * (days - 14))) end as risk,
     case when days <= 7 then 'HIGH' when days <= 14 then 'MEDIUM' else 'LOW' end as lvl,
     coalesce(predicted_demand > demand * 1.2::double, false) as spike
 from (select r.*, l.predicted_demand, l.confidence_level, current_stock / demand as days
       from reorder r left join latest l on r.product_id = l.product_id))"""

RISK_CTES = {"reorder": REORDER, "latest": LATEST, "risked": RISK}


def _reorder(t):
    return inv.integer_reorder(t.products, t.sales(t.days_before(90)), t.as_of, 90)


def _latest(t):
    return inv.latest_per_key(t.forecasts, "product_id", "forecast_date", ["predicted_demand", "confidence_level"])


def _risk(t):
    return inv.banded_risk(_reorder(t), _latest(t))


@query("INV08", "select product_id, reorder_point, safety_stock, average_daily_demand, lead, status from reorder", "", RISK_CTES)
def inv08(t):
    return _reorder(t).select("product_id", "reorder_point", "safety_stock", "average_daily_demand", "lead", "status")


@query("INV09", """select product_id, risk_level, days_until_stockout, risk_percentage, average_daily_demand, predicted_demand,
  forecast_confidence from risked""", "predicted_demand", RISK_CTES)
def inv09(t):
    return _risk(t).select("product_id", "risk_level", "days_until_stockout", "risk_percentage",
                           "average_daily_demand", "predicted_demand", "forecast_confidence")


@query("INV10", """select product_id, reorder_point, safety_stock, status, risk_level, days_until_stockout, risk_percentage from risked""",
       "", RISK_CTES)
def inv10(t):
    return _risk(t).select("product_id", "reorder_point", "safety_stock", "status", "risk_level",
                           "days_until_stockout", "risk_percentage")


@query("INV11", f"""with d as (select product_id, date, cast(sum(quantity_sold) as bigint) as qty, count(*) as n,
     row_number() over (partition by product_id order by date) - 1 as i from sales where {window(730)}
     and product_id in (select product_id from products where current_stock = 0) group by product_id, date),
  g as (select product_id, count(*) as n_days, cast(count(*) * sum(i * qty) - sum(i) * sum(qty) as double)
       / nullif(count(*) * sum(i * i) - sum(i) * sum(i), 0)::double as slope, max_by(qty, date) as last_qty,
     cast(sum(qty) as double) / sum(n) as row_avg,
     sqrt(greatest(0.0::double, cast(sum(qty * qty) as double) / count(*) - (cast(sum(qty) as double) / count(*)) * (cast(sum(qty) as double) / count(*)))) as sd
     from d group by product_id),
  j as (select p.*, {LEAD} as lead, greatest(1, case when n_days >= 7 then cast(trunc(last_qty + slope) as int)
       else cast(trunc(coalesce(row_avg, 0)) as int) end) as predicted, case when n_days >= 2 then sd else 0.0 end as sd,
       unit_price - unit_cost as unit_profit
     from products p left join g on p.product_id = g.product_id where current_stock = 0),
  k as (select *, greatest(1, cast(trunc(predicted * lead + 1.65::double * coalesce(sd, 0.0) * sqrt(lead)) as int)) as order_quantity from j)
  select product_id, sku, name, category, predicted as predicted_daily_demand, unit_profit, predicted * unit_price as daily_revenue_loss,
   predicted * unit_profit as daily_loss, predicted * unit_profit * 7 as weekly_loss, predicted * unit_profit * 30 as monthly_loss,
   predicted * unit_profit * 365 as annual_loss, order_quantity, order_quantity * unit_cost as estimated_cost from k""",
       "unit_profit daily_revenue_loss daily_loss weekly_loss monthly_loss annual_loss estimated_cost")
def inv11(t):
    return inv.stockout_loss(t.products, t.sales(t.days_before(730)), t.as_of, 730)


ROWD = f"""select p.*, {LEAD} as lead, coalesce(nullif(d, 0), 1.0) as demand from products p
  left join ({row_avg(90, 'd')}) r on p.product_id = r.product_id"""
THRESH = """select *, greatest(least(greatest(1, cast(trunc(5000.0::double / coalesce(nullif(unit_price, 0), 10.0)) as int)), 50)::double,
   demand * lead + 1.28::double * (case when demand > 0 then demand * 0.3::double else 1.0::double end) * sqrt(lead)) as threshold from rowd"""


@query("INV12", "select product_id, demand, threshold from thr", "demand threshold", {"rowd": ROWD, "thr": THRESH})
def inv12(t):
    df = inv.with_row_demand(t.products, t.sales(t.days_before(90)), t.as_of, 90)
    return df.select("product_id", "demand", inv.dynamic_threshold(
        F.col("demand"), F.col("lead"), F.col("unit_price")).alias("threshold"))


@query("INV13", """select product_id, sku, name, category, current_stock, cast(trunc(threshold) as int) as threshold, demand as daily_demand,
  cover as days_until_stockout, cover - lead as buffer_days,
  case when cover - lead <= 10 then 'LOW_WARNING' when cover - lead <= 30 then 'MEDIUM' else 'HIGH' end as urgency,
  demand * (unit_price - unit_cost) as potential_daily_loss, cover - lead <= 5 as send_alert
  from (select *, cast(trunc(current_stock / demand) as int) as cover from thr where current_stock > 0 and current_stock < threshold)""", "daily_demand potential_daily_loss", {"rowd": ROWD, "thr": THRESH})
def inv13(t):
    return inv.low_stock_risk(t.products, t.sales(t.days_before(90)), t.as_of, 90)


ALERTS = f"""select product_id, sku, name, category, current_stock, type,
   case type when 'STOCKOUT' then 'CRITICAL' when 'LOW_STOCK' then 'HIGH' when 'MEDIUM_STOCK' then 'MEDIUM' else 'LOW' end as severity,
   case type when 'STOCKOUT' then 'OUT_OF_STOCK' when 'LOW_STOCK' then 'LOW' when 'MEDIUM_STOCK' then 'MEDIUM' else 'HIGH' end as stock_level,
   cover as days_until_stockout, buffer as buffer_days,
   case when type in ('STOCKOUT', 'LOW_STOCK') then cast(round(demand * margin) as int) end as loss_per_day,
   case when type in ('STOCKOUT', 'LOW_STOCK') then qty end as recommended_quantity,
   case when type = 'STOCKOUT' then cast(round(qty * unit_cost) as int) when type = 'LOW_STOCK' then cast(trunc(qty * unit_cost) as int) end as estimated_cost,
   case when type = 'STOCKOUT' then true else coalesce(buffer <= 5, false) and type = 'LOW_STOCK' end as send_email
 from (select *, cast(trunc(demand * lead * 1.5::double) as int) as qty
  from (select *, case when current_stock = 0 then 'STOCKOUT' when buffer <= 10 then 'LOW_STOCK' when buffer <= 30 then 'MEDIUM_STOCK' else 'HIGH_STOCK' end as type
   from (select *, cover - lead as buffer from (select *, case when current_stock > 0 then cast(trunc(current_stock / demand) as int) end as cover
    from (select p.*, {LEAD} as lead, unit_price - unit_cost as margin, case when current_stock = 0 then m.m30 else w.m7 end as demand
     from products p left join ({row_avg(180, 'm7')}) w on p.product_id = w.product_id
     left join ({row_avg(365, 'm30')}) m on p.product_id = m.product_id) where demand > 0))))"""
ALERT_REPORT = """select * exclude (rn) from (select *, row_number() over (partition by type order by
      case type when 'STOCKOUT' then 0 when 'HIGH_STOCK' then -buffer_days else buffer_days end, product_id) as rn from alerts)
 where rn <= case type when 'STOCKOUT' then 30 when 'LOW_STOCK' then 50 when 'MEDIUM_STOCK' then 30 else 20 end
 order by case type when 'STOCKOUT' then 1 when 'LOW_STOCK' then 2 when 'MEDIUM_STOCK' then 3 else 4 end, rn limit 100"""


def _alerts(t):
    return inv.live_alerts(t.products, t.sales(t.days_before(365)), t.as_of, 180, 365)


@query("INV14", "select * from alerts", "", {"alerts": ALERTS})
def inv14(t):
    return _alerts(t)


@query("INV14_report", ALERT_REPORT, "", {"alerts": ALERTS})
def inv14_report(t):
    return inv.alert_report(_alerts(t))


@query("FIL17", """select count(*) as alerts, cast(coalesce(sum(loss_per_day), 0) as bigint) as daily_loss from alerts
  where stock_level = 'LOW'""", "", {"alerts": ALERTS})
def fil17(t):
    return listing.alert_loss(_alerts(t), "LOW")


@query("AGG26", """select count(*) filter (where severity = 'CRITICAL') as critical, count(*) filter (where severity = 'HIGH') as high,
  count(*) filter (where severity in ('CRITICAL', 'HIGH', 'WARNING')) as at_risk, cast(d as bigint) as daily_risk,
  cast(d * 7 as bigint) as weekly_risk, cast(d * 30 as bigint) as monthly_risk
  from alerts, (select sum(coalesce(loss_per_day, 0)) as d from alerts where severity in ('CRITICAL', 'HIGH')) group by d""",
       "", {"alerts": ALERTS})
def agg26(t):
    return inv.alert_summary(_alerts(t))


@query("AGG19", """select category, product_id, sku, count(*) over (partition by category) as category_count
  from products where current_stock = 0""")
def agg19(t):
    return inv.out_of_stock_by_category(t.products)


RANKED = "select *, row_number() over (partition by product_id order by date desc, id desc, quantity_sold desc) as rn from sales"
SHIFT = """select product_id, max(rn) as n_rows, cast(sum(quantity_sold) filter (where rn <= 15) as double) / 15 as recent,
  cast(sum(quantity_sold) filter (where rn between 16 and 30) as double) / 15 as previous from ranked where rn <= 90 group by product_id"""
PEAK = """select product_id, max(m) as peak_mean, min(m) as low_mean, arg_max(wd, struct_pack(a := m, b := -wd)) as peak_day
  from (select product_id, (isodow(date) - 1) as wd, cast(sum(quantity_sold) as double) / count(*) as m from ranked where rn <= 90
    group by product_id, isodow(date)) group by product_id"""
RULES = """select product_id, sku, category, unnest(list_filter([
   case when n_rows is null then {'rule': 'NO_HISTORY', 'type': 'warning', 'priority': 'medium', 'value': 0.0::double} end,
   case when n_rows is not null and current_stock <= reorder_point then {'rule': 'REORDER', 'type': 'action',
      'priority': case when risk_level = 'HIGH' then 'critical' else 'high' end, 'value': (reorder_point * 2 * unit_cost)::double} end,
   case when n_rows is not null and risk_level = 'HIGH' and current_stock > 0 then {'rule': 'STOCKOUT_RISK', 'type': 'warning', 'priority': 'critical', 'value': days_until_stockout::double} end,
   case when n_rows is not null and current_stock > reorder_point * 5 then {'rule': 'OVERSTOCK', 'type': 'info', 'priority': 'medium', 'value': (current_stock * unit_cost * 0.25)::double} end,
   case when n_rows is not null and rate < 1 and current_stock > 100 then {'rule': 'SLOW_MOVING', 'type': 'action', 'priority': 'medium', 'value': (current_stock * unit_price * 0.7)::double} end,
   case when n_rows >= 30 and recent > previous * 1.2 then {'rule': 'DEMAND_UP', 'type': 'success', 'priority': 'high', 'value': ((recent / previous - 1) * 100)::double} end,
   case when n_rows >= 30 and recent < previous * 0.8 then {'rule': 'DEMAND_DOWN', 'type': 'warning', 'priority': 'medium', 'value': ((1 - recent / previous) * 100)::double} end,
   case when n_rows is not null and margin < 20 then {'rule': 'LOW_MARGIN', 'type': 'warning', 'priority': 'medium', 'value': margin::double} end,
   case when n_rows is not null and margin > 60 then {'rule': 'HIGH_MARGIN', 'type': 'success', 'priority': 'low', 'value': margin::double} end,
   case when n_rows >= 60 and peak_mean > low_mean * 1.5 then {'rule': 'WEEKDAY_PATTERN', 'type': 'info', 'priority': 'low', 'value': peak_day::double} end,
   case when n_rows is not null and lead_time_days > 14 and current_stock < demand * (lead_time_days + 7) then {'rule': 'LONG_LEAD', 'type': 'warning', 'priority': 'high', 'value': (demand * (lead_time_days + 7))::double} end
   ], lambda x: x is not null)) as r
 from (select k.*, n_rows, recent, previous, peak_mean, low_mean, peak_day, (unit_price - unit_cost) / unit_price * 100 as margin
   from risked k left join shift s on k.product_id = s.product_id left join peak p on k.product_id = p.product_id)"""
RULE_CTES = {**RISK_CTES, "ranked": RANKED, "shift": SHIFT, "peak": PEAK, "ruled": RULES}


def _rules(t):
    rows = inv.recent_rows(t.sales(), 90)
    return inv.advisor_rules(_risk(t), inv.recent_shift(rows), inv.weekday_peak(rows))


@query("INV15", """select product_id, sku, category, r.rule as "rule", r."type" as "type", r.priority as priority, r."value" as "value" from ruled""",
       "value", RULE_CTES)
def inv15(t):
    return _rules(t)


@query("INV16", """select product_id, sku, category, r.rule as "rule", r."type" as "type", r.priority as priority, r."value" as "value" from ruled
  where r.priority in ('critical', 'high')""",
       "value", RULE_CTES)
def inv16(t):
    return inv.top_advice(_rules(t))


@query("WIN13", """select product_id, cast(n_rows as int) as n_rows, recent, previous, case when recent > previous * 1.2 then 'UP'
   when recent < previous * 0.8 then 'DOWN' else 'FLAT' end as trend from shift where n_rows >= 30""", "recent previous",
       {"ranked": RANKED.replace("from sales", "from sales"), "shift": SHIFT})
def win13(t):
    r, p = F.col("recent"), F.col("previous")
    return inv.recent_shift(inv.recent_rows(t.sales(), 90)).filter("n_rows >= 30").withColumn(
        "trend", F.when(r > p * 1.2, "UP").when(r < p * 0.8, "DOWN").otherwise("FLAT"))


EXPOSE = f"""select product_id, sku, name, current_stock, round(risk_percentage / 100.0::double * coalesce(demand, 0.0) * unit_price, 0) as risk_amount
  from ({policy('(' + demand_join(YEAR) + ')')})"""
CRIT = """select product_id, sku, current_stock, risk_amount, confidence, i.issue as issue, i.priority as priority from (
   select *, unnest(list_filter([
     case when confidence < 0.70 then {'issue': 'LOW_FORECAST_CONFIDENCE', 'priority': 1} end,
     case when risk_amount > 1000 then {'issue': 'HIGH_STOCKOUT_RISK', 'priority': 1} end,
     case when current_stock < 50 and risk_amount > 500 then {'issue': 'CRITICAL_STOCK_LEVEL', 'priority': 0} end], lambda x: x is not null)) as i
   from (select e.*, coalesce(l.confidence_level, 0.8) as confidence from expose e left join latest l on e.product_id = l.product_id))"""
EXC_CTES = {**RISK_CTES, "expose": EXPOSE, "crit": CRIT}


def _exposure(t):
    return inv.exposure(listing.enriched(t.products, t.sales(t.days_before(YEAR)), t.as_of, YEAR))


@query("INV17", """select product_id, sku, current_stock, risk_amount, confidence, issue, priority from crit
  order by priority, risk_amount desc, product_id, issue limit 5""", "risk_amount confidence", EXC_CTES)
def inv17(t):
    return inv.critical_items(_exposure(t), _latest(t)).orderBy(
        "priority", F.col("risk_amount").desc(), "product_id", "issue").limit(5)


PARETO = """select product_id, risk_amount, rn as "position", risk_amount > 10000 as very_high,
   case when risk_amount > 10000 then 'CRITICAL' when risk_amount > 5000 then 'HIGH' when risk_amount > 1000 then 'MEDIUM' else 'LOW' end as risk_category
 from (select *, row_number() over (order by risk_amount desc, product_id) as rn,
   sum(risk_amount) over (order by risk_amount desc, product_id rows unbounded preceding) - risk_amount as before,
   sum(risk_amount) over () as total from expose) where before < 0.8 * total"""


def _pareto(t):
    run = running_totals(_exposure(t), [F.col("risk_amount").desc(), F.col("product_id")], {"cum": "risk_amount"})
    r = F.col("risk_amount")
    return run.filter(F.col("cum") - r < 0.8 * F.col("cum_total")).select(
        "product_id", "risk_amount", "position", (r > 10000).alias("very_high"),
        F.when(r > 10000, "CRITICAL").when(r > 5000, "HIGH").when(r > 1000, "MEDIUM").otherwise("LOW").alias("risk_category"))


@query("WIN06", "select * from pareto", "risk_amount", {**EXC_CTES, "pareto": PARETO})
def win06(t):
    return _pareto(t)


ANNUAL = f"""select p.*, {LEAD} as lead, unit_price - unit_cost as unit_margin, cast(total_qty as double) / active_days * 365 as annual_demand,
   cast(total_qty as double) / active_days as mean_daily, coalesce(sd_daily, 0.0) as sd_daily
 from products p join ({daily_stats()}) s on p.product_id = s.product_id"""
DECIDE = f"""select * exclude (lot, q, chance), case when to_wait > to_order then 'ORDER NOW' else 'WAIT/MONITOR' end as decision,
   case when to_wait > to_order then round(q) else 0.0 end as order_quantity,
   case when to_wait > to_order then to_wait - to_order else 0.0 end as net_savings,
   case when to_wait > to_order then (to_wait - to_order) / (to_order + 1) * 100 else 0.0 end as roi_percent,
   q * unit_cost as cash_impact, (case when q = 0 then 1.0 - chance else 0.95 end) * 100 as projected_service_level, chance as stockout_probability,
   case when annual_demand > 0 then current_stock / (annual_demand / 365) else 999.0 end as days_of_stock,
   case when annual_demand > 0 then (current_stock + q) / (annual_demand / 365) else 999.0 end as days_after_order
 from (select *, chance * (predicted_demand * unit_margin * 0.4::double) as to_wait
 from (select *, case when q > 0 then q / 2 * (unit_cost * 0.25::double) + 50 else 0.0 end as to_order,
     case when q > 0 or sd_daily <= 0 then 0.0 else 1.0 - {norm_cdf_sql('(current_stock - reorder_point) / (sd_daily * sqrt(lead))')} end as chance
 from (select *, case when greatest(0.0::double, reorder_point - current_stock) < lot * 0.5 then 0.0 else greatest(lot, reorder_point - current_stock) end as q
 from (select *, annual_demand / 365 * lead + safety_stock as reorder_point
 from (select a.* exclude (reorder_point, safety_stock), {Z95}::double * sd_daily * sqrt(lead) as safety_stock, l.predicted_demand * 30 as predicted_demand,
     case when unit_cost * 0.25 > 0 then sqrt(2.0::double * annual_demand * 50.0::double / (unit_cost * 0.25::double)) else annual_demand / 12 end as lot
   from annual a join latest l on a.product_id = l.product_id)))))"""
DEC_CTES = {**EXC_CTES, "annual": ANNUAL, "decided": DECIDE}


def annual(t):
    return dec.annual_inputs(t.products, spark_daily_stats(t.sales(), t.as_of))


def decided(t):
    forecast = _latest(t).select("product_id", (F.col("predicted_demand") * 30).alias("predicted_demand"))
    return dec.order_decision(annual(t).join(forecast, "product_id"))


DEC_COLS = ("product_id decision order_quantity reorder_point safety_stock cost_to_order cost_to_wait net_savings roi_percent "
            "cash_impact stockout_probability projected_service_level days_of_stock days_after_order").split()


@query("DEC01", f"select {', '.join(DEC_COLS).replace('cost_to_order', 'to_order as cost_to_order').replace('cost_to_wait', 'to_wait as cost_to_wait')} from decided",
       " ".join(DEC_COLS[2:]), DEC_CTES)
def dec01(t):
    return decided(t).select(*DEC_COLS)


@query("DEC02", """select product_id, decision, case when decision = 'WAIT/MONITOR' then 'NONE' when net_savings > 5000 then 'AUTO_APPROVED'
   when cash_impact > 50000 then 'FINANCE_REVIEW' else 'MANAGER_REVIEW' end as approval from decided""", "", DEC_CTES)
def dec02(t):
    return decided(t).select("product_id", "decision", dec.approval_level(
        F.col("decision"), F.col("net_savings"), F.col("cash_impact")).alias("approval"))


SPECIAL = "select product_id, 'STALE_PRIORITY' as condition from products where product_priority = 'HIGH' and days_since_last_order > 200"
OVERRIDE = """select product_id, decision, order_quantity, confidence, r.reason as reason, r.severity as severity from (
  select *, unnest(list_filter([
   case when decision = 'ORDER NOW' and confidence < 0.75 then {'reason': 'LOW_CONFIDENCE_HIGH_VALUE', 'severity': 'MEDIUM'} end,
   case when order_quantity > 1000 then {'reason': 'LARGE_ORDER_REQUIRES_REVIEW', 'severity': 'MEDIUM'} end,
   case when condition is not null then {'reason': 'SPECIAL_CONDITION_DETECTED', 'severity': 'HIGH'} end], lambda x: x is not null)) as r
  from (select d.product_id, decision, order_quantity, coalesce(l.confidence_level, 0.8) as confidence, s.condition
    from decided d left join latest l on d.product_id = l.product_id left join special s on d.product_id = s.product_id))"""
OVR_CTES = {**DEC_CTES, "special": SPECIAL, "overrides": OVERRIDE, "pareto": PARETO}


def _overrides(t):
    special = t.products.filter("product_priority = 'HIGH' and days_since_last_order > 200").select(
        "product_id", F.lit("STALE_PRIORITY").alias("condition"))
    return inv.override_candidates(
        decided(t).select("product_id", "decision", "order_quantity"), _latest(t), special)


@query("INV18", "select * from overrides", "order_quantity confidence", OVR_CTES)
def inv18(t):
    return _overrides(t)


@query("INV19", """select c as critical_items, h as high_risk_skus, o as manual_reviews, c + h + o as total_flagged,
   case when c > 3 then 'RED' when c > 0 then 'YELLOW' else 'GREEN' end as status
  from (select (select count(*) from crit) as c, (select count(*) from pareto) as h, (select count(*) from overrides) as o)""", "", OVR_CTES)
def inv19(t):
    return inv.daily_exception_status(inv.critical_items(_exposure(t), _latest(t)), _pareto(t), _overrides(t))


@query("INV20", f"""with s as (select product_id, count(*) as n, cast(sum(quantity_sold) as double) / count(*) as m,
    sqrt(greatest(0.0::double, cast(sum(quantity_sold * quantity_sold) as double) / count(*)
      - (cast(sum(quantity_sold) as double) / count(*)) * (cast(sum(quantity_sold) as double) / count(*)))) as sd
    from sales where {window(90)} group by product_id),
  j as (select p.*, {LEAD} as lead, coalesce(nullif(m, 0), 1.0) as demand, n, sd from products p left join s on p.product_id = s.product_id),
  k as (select *, least(1.0::double, (case when n > 1 then sd else demand * 0.3::double end) / greatest(demand, 0.01::double)) as variability,
      current_stock / greatest(demand, 0.01::double) as cover from j),
  m as (select *, 1.645::double * (demand * variability) * sqrt(lead) as ss, cover - lead as buffer_days from k)
  select product_id, cover as days_until_stockout, buffer_days, variability, cast(trunc(ss) as int) as safety_stock,
   cast(trunc(demand * lead + ss) as int) as reorder_quantity, cast(trunc(demand * lead + ss) as int) * unit_cost as order_cost,
   demand * (unit_price - unit_cost) as potential_daily_loss,
   case when buffer_days < 0 then 'CRITICAL' when buffer_days <= 3 then 'URGENT' when buffer_days <= 7 then 'HIGH'
        when buffer_days <= 14 then 'MODERATE' else 'LOW' end as urgency from m""",
       "days_until_stockout buffer_days variability order_cost potential_daily_loss")
def inv20(t):
    return inv.reorder_explained(t.products, t.sales(t.days_before(90)), t.as_of, 90)


@query("INV21", f"""select product_id, quantity, revenue, cost, revenue - cost as profit,
   case when revenue > 0 then (revenue - cost) / revenue * 100 else 0.0 end as margin_pct,
   case when m >= 40 then 'EXCELLENT' when m >= 25 then 'HEALTHY' when m >= 10 then 'MODERATE' when m >= 0 then 'LOW' else 'CRITICAL' end as health
  from (select *, case when revenue > 0 then (revenue - cost) / revenue * 100 else 0.0 end as m from (
   select s.product_id, cast(sum(quantity_sold) as bigint) as quantity, cast(sum(revenue) as double) as revenue,
     cast(sum(quantity_sold) as double) * min(unit_cost) as cost from sales s join products p on s.product_id = p.product_id
   where {window(YEAR)} group by s.product_id))""", "revenue cost profit margin_pct")
def inv21(t):
    sums = t.sales(t.days_before(YEAR)).groupBy("product_id").agg(
        F.sum("quantity_sold").alias("quantity"), F.sum("revenue").cast("double").alias("revenue"))
    df = sums.join(t.products.select("product_id", "unit_cost"), "product_id").withColumn(
        "cost", F.col("quantity").cast("double") * F.col("unit_cost")).drop("unit_cost")
    return df.withColumns(inv.margin_health(F.col("revenue"), F.col("cost")))


@query("INV22", f"""select p.product_id, coalesce(m, 0.0) as avg_daily_demand, coalesce(m, 0.0) * (unit_price - unit_cost) as daily_loss,
   coalesce(m, 0.0) * (unit_price - unit_cost) * 7 as weekly_loss, coalesce(m, 0.0) * (unit_price - unit_cost) * 30 as monthly_loss,
   coalesce(m, 0.0) * (unit_price - unit_cost) * 365 as annual_loss
  from products p left join ({row_avg(90, 'm')}) r on p.product_id = r.product_id""",
       "avg_daily_demand daily_loss weekly_loss monthly_loss annual_loss")
def inv22(t):
    return inv.loss_explained(t.products, t.sales(t.days_before(90)), t.as_of, 90)


# Returned goods go back on the shelf; one order in fifty carries a code nobody knows.
RECEIPTS = """select concat('SKU-', lpad(cast(l_partkey + case when l_orderkey % 50 = 0 then 9000000 else 0 end as varchar(20)), 6, '0')) as sku,
   cast(l_quantity as int) as restock_quantity from lineitem where l_returnflag = 'R'"""


def _receipts(t):
    return t.raw("lineitem").filter("l_returnflag = 'R'").selectExpr(
        "concat('SKU-', lpad(cast(l_partkey + case when l_orderkey % 50 = 0 then 9000000 else 0 end as string), 6, '0')) as sku",
        "cast(l_quantity as int) as restock_quantity")


@query("INV23", """select r.sku, p.product_id, restock_quantity, current_stock, current_stock + restock_quantity as new_stock,
   case when p.product_id is null then 'NOT_FOUND' when current_stock = 0 then 'CRITICAL' when current_stock < 100 then 'HIGH'
        when current_stock + restock_quantity > 5000 then 'WARN_LARGE' else 'NORMAL' end as outcome
  from receipts r left join products p on r.sku = p.sku""", "", {"receipts": RECEIPTS})
def inv23(t):
    return inv.restock_preview(t.products, _receipts(t))


@query("INV23_apply", """select product_id, p.sku, cast(current_stock + coalesce(added, 0) as bigint) as current_stock
  from products p left join (select sku, sum(restock_quantity) as added from receipts group by sku) r on p.sku = r.sku""",
       "", {"receipts": RECEIPTS})
def inv23_apply(t):
    return inv.restock_apply(t.products, _receipts(t)).select("product_id", "sku", "current_stock")


@query("INV24", """select product_id, sku, 'STOCK' as alert, reorder_point::double as limit_value, current_stock::double as "value"
   from reorder where current_stock <= reorder_point
  union all select product_id, sku, 'LOSS', unit_cost, unit_price from reorder where unit_price < unit_cost""",
       "limit_value value", RISK_CTES)
def inv24(t):
    return inv.threshold_sweep(_reorder(t))
