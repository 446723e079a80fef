"""SQL fragments shared by the checking queries."""

from __future__ import annotations

from granary.functions.mathx import norm_cdf_sql, norm_pdf_sql, norm_ppf_sql, z_value

Z95 = repr(z_value(0.95))


def window(days: int) -> str:
    return f"date >= (select d from clock) - {days}"


def trans_stats(days: int) -> str:
    """Per product over a window: totals, distinct days, squares, rows, row spread."""
    return f"""
select product_id, cast(sum(quantity_sold) as bigint) as total_qty,
       count(distinct date) as active_days,
       cast(sum(quantity_sold * quantity_sold) as bigint) as sum_sq, count(*) as n_sales,
       case when count(*) > 1 then sqrt(greatest(0.0::double,
            cast(sum(quantity_sold * quantity_sold) as double) / count(*)
            - (cast(sum(quantity_sold) as double) / count(*)) * (cast(sum(quantity_sold) as double) / count(*)))) end as sigma
from sales where {window(days)} group by product_id"""


def daily_stats(days: int | None = None) -> str:
    cond = f"where {window(days)}" if days else ""
    return f"""
select product_id, cast(sum(qty) as bigint) as total_qty, count(*) as active_days,
       min(date) as first_date, max(date) as last_date, max(date) - min(date) as span_days,
       case when count(*) > 1 then sqrt(greatest(0.0::double, (cast(sum(qty * qty) as double)
            - cast(sum(qty) as double) * cast(sum(qty) as double) / count(*)) / (count(*) - 1))) end as sd_daily
from (select product_id, date, cast(sum(quantity_sold) as bigint) as qty from sales {cond} group by product_id, date)
group by product_id"""


def row_avg(days: int, name: str) -> str:
    return (f"select product_id, cast(sum(quantity_sold) as double) / count(*) as {name} "
            f"from sales where {window(days)} group by product_id")


def policy(src: str, service_level: float = 0.95) -> str:
    """Compact policy over a relation with demand, sigma, lead, cost, current_stock."""
    z = repr(z_value(service_level))
    risk = norm_cdf_sql("(current_stock - demand * lead) / (sd * sqrt(lead))")
    return f"""
select * exclude (sd, ss, rop, lot, ord, risk),
  case when none then 0 else cast(round(ss) as int) end as safety_stock,
  case when none then 0 else cast(round(rop) as int) end as reorder_point,
  case when none then 0 else lot end as eoq,
  case when none then 0 else ord end as order_quantity,
  case when none then (case when current_stock > 0 then 0.0 else 100.0 end) else risk end::double as risk_percentage,
  case when none then (case when current_stock = 0 then 'CRITICAL' else 'UNKNOWN' end)
       when current_stock = 0 or risk >= 80 then 'CRITICAL' when risk >= 50 then 'HIGH'
       when risk >= 20 then 'MEDIUM' when risk >= 5 then 'LOW' else 'SAFE' end as stockout_risk
from (select *, greatest(1, case when current_stock < rop
              then greatest(lot, cast(trunc(rop - current_stock + ss) as int)) else lot end) as ord,
             case when current_stock = 0 then 100.0::double else round((1.0::double - {risk}) * 100, 1) end as risk
 from (select *, greatest(0.0::double, demand * lead + ss) as rop
  from (select *, greatest(0.0::double, round({z}::double * sd * sqrt(lead), 2)) as ss,
       greatest(cast(trunc(round(greatest(1.0::double, case when cost * 0.25 = 0 then demand * 365 / 12
            else sqrt(2.0::double * (demand * 365) * 50.0::double / (cost * 0.25::double)) end), 2)) as int), 1) as lot
   from (select *, case when sigma is null or sigma <= 0 then demand * 0.3::double else sigma end as sd,
            (demand is null or demand <= 0) as none from {src}))))"""


def demand_join(days: int, catalogue_sigma: bool = True) -> str:
    spread = ("case when p.demand_volatility > 0 and p.average_daily_demand > 0 "
              "then p.demand_volatility * p.average_daily_demand end" if catalogue_sigma else "null::double")
    return f"""
select p.* exclude (reorder_point, safety_stock), coalesce(o.observed, case when p.average_daily_demand > 0 then p.average_daily_demand end) as demand,
       case when o.observed is not null then o.sigma else {spread} end as sigma,
       case when coalesce(p.lead_time_days, 0) = 0 then 7 else p.lead_time_days end as lead,
       case when coalesce(p.unit_cost, 0) = 0 then 1.0 else p.unit_cost end as cost
from products p left join (select product_id, cast(total_qty as double) / greatest(active_days, 1) as observed, sigma
     from ({trans_stats(days)})) o on p.product_id = o.product_id"""


BAND = ("case when current_stock = 0 then 'OUT' when current_stock <= 10 then 'LOW' "
        "when current_stock <= 50 then 'MEDIUM' else 'HIGH' end")

SUGGESTED = ("(case when current_stock = 0 then greatest(coalesce(reorder_point, 0) * 2, 50) "
             "else greatest(coalesce(reorder_point, 0) - current_stock + coalesce(safety_stock, 0), 20) end)")

__all__ = [n for n in dir() if not n.startswith("_")]
