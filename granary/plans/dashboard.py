"""Aggregations, joins, classes and windowed features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators import classify as cls
from granary.operators import dashboard as dash
from granary.operators import decision as dec
from granary.operators import inventory as inv
from granary.operators import listing
from granary.operators.demand import daily_rate, row_average, since, transaction_stats
from granary.operators.demand import daily_stats as spark_daily_stats
from granary.operators.policy import Bands
from granary.plans.inventory import LEAD, RISK_CTES
from granary.plans.registry import query
from granary.plans.sqlparts import BAND, daily_stats, demand_join, policy, row_avg, trans_stats, window

M = "cast({} as decimal(12,2))"
COST, PRICE = M.format("unit_cost"), M.format("unit_price")
YEAR = 365


@query("AGG01", f"select product_id, total_qty, active_days, sum_sq, n_sales from ({trans_stats(YEAR)})")
def agg01(t):
    return transaction_stats(t.sales(t.days_before(YEAR)), t.as_of, YEAR).drop("sigma")


_rates = {
    "active": ("cast(total_qty as double) / greatest(active_days, 1)", 30),
    "max30": ("cast(total_qty as double) / greatest(active_days, 30)", 90),
    "capped": ("cast(total_qty as double) / greatest(1, least(active_days, 90))", 90),
}


@query("DEMAND", f"""select d.product_id, cast(d.total_qty as double) / (d.span_days + 1) as d_span, cast(d.total_qty as double) / greatest(1, d.span_days) as d_span0,
   cast(d.total_qty as double) / d.active_days * 365 as d_annual, {_rates['active'][0].replace('total_qty', 'a.total_qty').replace('active_days', 'a.active_days')} as d_active,
   {_rates['max30'][0].replace('total_qty', 'b.total_qty').replace('active_days', 'b.active_days')} as d_max30,
   {_rates['capped'][0].replace('total_qty', 'b.total_qty').replace('active_days', 'b.active_days')} as d_capped,
   coalesce(greatest(1.0::double, ceil(cast(a.total_qty as double) / 30)), 1.0) as d_fixed, r.m as d_rowavg
  from ({daily_stats()}) d left join ({trans_stats(30)}) a on d.product_id = a.product_id
   left join ({trans_stats(90)}) b on d.product_id = b.product_id left join ({row_avg(7, 'm')}) r on d.product_id = r.product_id""",
       "d_span d_span0 d_annual d_active d_max30 d_capped d_fixed d_rowavg")
def demand_rates(t):
    """All eight demand definitions side by side."""
    whole = spark_daily_stats(t.sales(), t.as_of).select(
        "product_id", daily_rate("span").alias("d_span"), daily_rate("span0").alias("d_span0"),
        daily_rate("annual").alias("d_annual"))
    s30 = transaction_stats(t.sales(t.days_before(30)), t.as_of, 30).select(
        "product_id", daily_rate("active").alias("d_active"), daily_rate("fixed", 30).alias("_fixed"))
    s90 = transaction_stats(t.sales(t.days_before(90)), t.as_of, 90).select(
        "product_id", daily_rate("max30").alias("d_max30"), daily_rate("capped").alias("d_capped"))
    rows = row_average(t.sales(t.days_before(7)), t.as_of, 7, "d_rowavg")
    df = whole.join(s30, "product_id", "left").join(s90, "product_id", "left").join(rows, "product_id", "left")
    return df.withColumn("d_fixed", F.coalesce("_fixed", F.lit(1.0))).drop("_fixed")


@query("AGG02", f"""select count(*) as total_products, count(*) filter (where {BAND} = 'OUT') as out_of_stock,
  count(*) filter (where {BAND} = 'LOW') as low_stock, count(*) filter (where {BAND} = 'MEDIUM') as medium_stock,
  count(*) filter (where {BAND} = 'HIGH') as high_stock, count(distinct category) as categories from products""")
def agg02(t):
    return dash.catalogue_summary(t.products)


@query("AGG03", f"""select total_products, stock_value, out_of_stock, low_stock, out_of_stock * c * 30 * 0.5 + low_stock * (c * 0.25) * 15 as estimated_savings
  from (select count(*) as total_products, cast(sum(current_stock * {COST}) as double) as stock_value, count(*) filter (where current_stock = 0) as out_of_stock,
   count(*) filter (where current_stock between 1 and 10) as low_stock,
   coalesce(cast(sum({COST}) filter (where current_stock <= 10) as double) / nullif(count(*) filter (where current_stock <= 10), 0), 10.0) as c from products)""",
       "stock_value estimated_savings")
def agg03(t):
    return dash.headline_kpis(t.products)


def trend_sql(period):
    days, unit, _ = dash.PERIODS[period]
    return f"""select cast(date_trunc('{unit}', date) as date) as period, min(date) as first_date, cast(sum(quantity_sold) as bigint) as quantity,
   cast(sum(coalesce(revenue, quantity_sold * 10)) as double) as revenue,
   greatest(cast(sum(coalesce(revenue, quantity_sold * 10)) - sum(quantity_sold * coalesce({M.format('unit_cost_at_sale')}, 5)) as double), 0.0) as profit,
   cast(sum(case when profit_loss_amount < 0 then -profit_loss_amount else 0 end) as double) as loss
  from priced where {window(days)} group by 1"""


for _p in dash.PERIODS:
    def _bind(p):
        return lambda t: dash.period_trend(t.priced(t.days_before(dash.PERIODS[p][0])), t.as_of, p)
    query("AGG04" if _p == "daily" else f"AGG04_{_p}", trend_sql(_p), "revenue profit loss")(_bind(_p))


@query("AGG05", """select period, first_date, quantity, revenue, profit,
   loss + drain * 7 * case row_number() over (order by period desc) when 1 then 1.0 when 2 then 0.75 when 3 then 0.5 else 0.0 end as loss
  from tr, (select coalesce(sum(per_day * unit_price), 0.0) as drain from products p join
    (select product_id, cast(sum(quantity_sold) as double) / greatest(1, max(date) - min(date)) as per_day from sales
      where date >= (select d from clock) - 90 group by product_id having sum(quantity_sold) > 0) r on p.product_id = r.product_id where current_stock = 0)""",
       "revenue profit loss", {"tr": trend_sql("wow")})
def agg05(t):
    trend = dash.period_trend(t.priced(t.days_before(84)), t.as_of, "wow")
    drain = dash.stockout_drain(t.products, t.sales(t.days_before(90)), t.as_of)
    return dash.with_stockout_loss(trend, drain, "wow")


def cat_trend_sql(period):
    days, unit, _ = dash.PERIODS[period]
    core = f"""select cast(date_trunc('{unit}', date) as date) as period, cast(sum(quantity_sold) as bigint) as quantity,
      cast(sum(quantity_sold * {PRICE}) as double) as revenue, cast(sum(quantity_sold * ({PRICE} - {COST})) as double) as profit
     from sales s join products p on s.product_id = p.product_id where {window(days)} group by 1"""
    if period == "daily":
        core = f"""select cast(g.period as date) as period, coalesce(quantity, 0) as quantity, coalesce(revenue, 0.0) as revenue, coalesce(profit, 0.0) as profit
          from (select unnest(generate_series((select d from clock) - {days}, (select d from clock), interval 1 day)) as period) g left join ({core}) c on cast(g.period as date) = c.period"""
    return f"select period, quantity, revenue, profit, abs(least(profit, 0.0)) as loss from ({core})"


for _p in dash.PERIODS:
    def _bind2(p):
        return lambda t: dash.catalogue_trend(t.products, t.sales(t.days_before(dash.PERIODS[p][0])), t.as_of, p)
    query("AGG06" if _p == "daily" else f"AGG06_{_p}", cat_trend_sql(_p), "revenue profit loss")(_bind2(_p))


@query("AGG07", """select revenue as current_revenue, prev as previous_revenue, case when prev <> 0 then (revenue - prev) / prev * 100 end as change_pct
  from (select period, revenue, lag(revenue) over (order by period) as prev, row_number() over (order by period desc) as rn from tr) where rn = 1 and prev is not null""",
       "current_revenue previous_revenue change_pct", {"tr": cat_trend_sql("mom")})
def agg07(t):
    return dash.period_change(dash.catalogue_trend(t.products, t.sales(t.days_before(365)), t.as_of, "mom"))


@query("AGG08", f"""with per as (select product_id, cast(date_trunc('month', date) as date) as period, cast(sum(quantity_sold) as bigint) as quantity, cast(sum(revenue) as double) as revenue,
    cast(sum(case when profit_loss_amount >= 0 then profit_loss_amount else 0 end) as double) as profit,
    cast(sum(case when profit_loss_amount < 0 then -profit_loss_amount else 0 end) as double) as row_loss from priced where {window(365)} group by 1, 2),
  months as (select cast(unnest(generate_series(date_trunc('month', (select d from clock) - 365), (select d from clock)::timestamp, interval 1 month)) as date) as period),
  grid as (select p.product_id, current_stock, unit_price, coalesce(cast(total_qty as double) / greatest(1, span_days), 0.0) as per_day, period
    from products p left join ({daily_stats()}) s on p.product_id = s.product_id, months)
  select product_id, period, quantity, revenue, profit, row_loss + case when daily_rev > 0 and (current_stock = 0 or current_stock < per_day * 7)
      and revenue < daily_rev * 30 * 0.5 then daily_rev * 30 - revenue else 0.0 end as loss
  from (select g.product_id, g.period, current_stock, per_day, per_day * unit_price as daily_rev, coalesce(quantity, 0) as quantity, coalesce(revenue, 0.0) as revenue,
     coalesce(profit, 0.0) as profit, coalesce(row_loss, 0.0) as row_loss from grid g left join per on g.product_id = per.product_id and g.period = per.period)""",
       "revenue profit loss")
def agg08(t):
    return dash.product_trend(t.products, t.priced(t.days_before(365)), spark_daily_stats(t.sales(), t.as_of), t.as_of, "mom")


@query("AGG09", f"""select coalesce(nullif(category, ''), 'Uncategorized') as category, count(*) as products, cast(sum(current_stock) as bigint) as total_stock,
  cast(sum(current_stock * {COST}) as double) as total_value from products group by 1""", "total_value")
def agg09(t):
    return dash.category_breakdown(t.products)


@query("AGG10", f"""select coalesce(nullif(category, ''), 'Uncategorized') as category, count(*) as products, cast(sum(current_stock) as bigint) as total_stock,
  cast(sum(current_stock * {COST}) as double) as total_value, count(*) filter (where current_stock = 0) as "out",
  count(*) filter (where current_stock between 1 and 25) as low, count(*) filter (where current_stock between 26 and 120) as medium,
  count(*) filter (where current_stock > 120) as high from products group by 1""", "total_value")
def agg10(t):
    return dash.category_breakdown(t.products, Bands(25, 120))


DETAIL = f"""with j as (select * from ({demand_join(YEAR, False)}) where current_stock <= 40 and demand > 0)
  select product_id, sku, category, current_stock, demand, cast(trunc(current_stock / demand) as int) as days_until_stockout, stockout_risk, reorder_point,
   order_quantity, cost, current_stock = 0 or cast(trunc(current_stock / demand) as int) < 3 as is_critical from ({policy('j')}) where stockout_risk <> 'SAFE'"""


def _detail(t):
    return dash.stockout_detail(t.products, t.sales(t.days_before(YEAR)), t.as_of, YEAR)


@query("AGG11", "select * from detail", "demand", {"detail": DETAIL})
def agg11(t):
    return _detail(t)


@query("AGG11_totals", f"""select count(*) as at_risk, count(*) filter (where is_critical) as critical,
  cast(sum(order_quantity * {M.format('cost')}) filter (where is_critical) as double) as reorder_cost from detail""", "reorder_cost", {"detail": DETAIL})
def agg11_totals(t):
    return dash.stockout_totals(_detail(t))


SCORED = f"""select f.*, a.qty as actual, abs(predicted_demand - a.qty) / a.qty as ape from forecasts f
   join part_daily a on f.product_id = a.product_id and f.forecast_date = a.date where a.qty > 0 and f.forecast_date >= (select d from clock) - 365"""
ACC = """select product_id, count(*) as points, least(1.0::double, greatest(0.0::double, 1.0 - avg(ape))) * 100 as accuracy from scored group by product_id having count(*) >= 3"""


def _scored(t, days=365):
    start = t.days_before(days)
    return dash.scored_forecasts(t.forecasts.filter(F.col("forecast_date") >= F.lit(start)), t.part_daily(start))


@query("AGG12", "select product_id, points, accuracy from acc", "accuracy", {"scored": SCORED, "acc": ACC})
def agg12(t):
    return dash.product_accuracy(_scored(t))


@query("AGG12_category", """select category, count(*) as products, avg(accuracy) as accuracy from acc a join products p on a.product_id = p.product_id group by category""",
       "accuracy", {"scored": SCORED, "acc": ACC})
def agg12_category(t):
    return dash.product_accuracy(_scored(t)).join(t.products.select("product_id", "category"), "product_id").groupBy(
        "category").agg(F.count(F.lit(1)).alias("products"), F.avg("accuracy").alias("accuracy"))


@query("AGG12_best", "select product_id, points, accuracy from acc order by round(accuracy, 6) desc, product_id limit 10",
       "accuracy", {"scored": SCORED, "acc": ACC})
def agg12_best(t):
    return dash.product_accuracy(_scored(t)).orderBy(F.round("accuracy", 6).desc(), "product_id").limit(10)


@query("AGG13", f"""select date, revenue, profit, units, case when units > 0 then revenue / units else 0.0 end as avg_order_value,
   case when revenue > 0 then profit / revenue * 100 else 0.0 end as margin_pct
  from (select cast(g.d as date) as date, coalesce(cast(r as double), 0.0) as revenue, coalesce(cast(p as double), 0.0) as profit, coalesce(u, 0) as units
   from (select unnest(generate_series((select d from clock) - 90, (select d from clock), interval 1 day)) as d) g left join
   (select date, sum(revenue) as r, sum(profit_loss_amount) as p, cast(sum(quantity_sold) as bigint) as u from priced where {window(90)} group by date) s on cast(g.d as date) = s.date)""",
       "revenue profit avg_order_value margin_pct")
def agg13(t):
    return dash.revenue_days(t.priced(t.days_before(90)), t.as_of)


@query("AGG13_top", f"""select product_id, cast(sum(revenue) as double) as revenue, cast(sum(profit_loss_amount) as double) as profit, cast(sum(quantity_sold) as bigint) as units
  from priced where {window(90)} group by product_id order by 2 desc, product_id limit 20""", "revenue profit")
def agg13_top(t):
    return dash.product_revenue(t.priced(t.days_before(90)), t.as_of, 90).orderBy(F.col("revenue").desc(), "product_id").limit(20)


@query("AGG13_totals", f"""select {", ".join(f"cast(coalesce(sum({c}) filter (where {window(n)}), 0) as double) as {a}_{n}d" for n in (30, 7) for c, a in (("revenue", "revenue"), ("profit_loss_amount", "profit")))},
   cast(coalesce(sum(quantity_sold) filter (where {window(30)}), 0) as bigint) as units_30d, count(*) filter (where profit_loss_amount < 0) as loss_transactions,
   cast(coalesce(sum(profit_loss_amount) filter (where profit_loss_amount < 0), 0) as double) as loss_amount from priced where {window(90)}""",
       "revenue_30d revenue_7d profit_30d profit_7d loss_amount")
def agg13_totals(t):
    return dash.window_totals(t.priced(t.days_before(90)), t.as_of)


SAVE = f"""select product_id, coalesce(category, 'Uncategorized') as category, case when current_stock > d * lead then (current_stock - d * lead) * (unit_cost * 0.25) else 0.0 end as holding,
   case when current_stock < d * lead * 0.5 then d * 7 * (unit_price - unit_cost) * 0.3 else 0.0 end as stockouts,
   abs(greatest(1.0, d * 365 / greatest(current_stock, 1)) - greatest(1.0, d * 365 / (d * lead * 2))) * 50 * 0.5 as ordering,
   case when d < 1 and current_stock > 50 then current_stock * unit_price * 0.05 else 0.0 end as markdown
  from (select p.*, {LEAD} as lead, coalesce(cast(total_qty as double) / greatest(active_days, 1), case when average_daily_demand > 0 then average_daily_demand end) as d
    from products p left join ({trans_stats(60)}) s on p.product_id = s.product_id) where d > 0 and unit_cost > 0"""
_D = "cast(sum(cast(round({0}, 8) as decimal(28,8))) as double)"


@query("AGG14", f"""select *, holding + stockouts + ordering + markdown as total from (select category, {", ".join(_D.format(c) + " as " + c for c in ("holding", "stockouts", "ordering", "markdown"))}
  from save group by rollup (category))""", "holding stockouts ordering markdown total", {"save": SAVE})
def agg14(t):
    return dash.savings_by_category(dash.savings_rows(t.products, t.sales(t.days_before(60)), t.as_of))


@query("AGG15", f"""with j as (select p.* exclude (reorder_point, safety_stock), {LEAD} as lead, unit_cost as cost, sigma, cast(total_qty as double) / greatest(1, least(active_days, 90)) as demand
    from products p join ({trans_stats(90)}) s on p.product_id = s.product_id where total_qty > 0)
  select count(*) as products, cast(sum(cast(round(greatest(0.0::double, greatest(current_stock::double, eoq / 2.0 + safety_stock) - (eoq / 2.0 + safety_stock)) * greatest(cost * 0.25, 0.01), 8) as decimal(28,8))) as double) as savings
  from ({policy('j')})""", "savings")
def agg15(t):
    return dash.portfolio_savings(t.products, t.sales(t.days_before(90)), t.as_of)


@query("AGG16", f"""select *, case when profit_growth > 5 then 'UP' when profit_growth < -5 then 'DOWN' else 'STABLE' end as trend from (
  select *, case when previous_revenue > 0 then (revenue - previous_revenue) / previous_revenue * 100 else 0.0 end as revenue_growth,
   case when previous_profit > 0 then (profit - previous_profit) / previous_profit * 100 else 0.0 end as profit_growth, profit > 0 as is_profitable from (
  select product_id, cast(sum(quantity_sold) filter (where {window(365)}) as bigint) as quantity, cast(sum(revenue) filter (where {window(365)}) as double) as revenue,
   cast(sum(profit_loss_amount) filter (where {window(365)}) as double) as profit,
   coalesce(cast(sum(revenue) filter (where not ({window(365)})) as double), 0.0) as previous_revenue,
   coalesce(cast(sum(profit_loss_amount) filter (where not ({window(365)})) as double), 0.0) as previous_profit
  from priced where {window(730)} group by product_id) where quantity is not null)""",
       "revenue profit previous_revenue previous_profit revenue_growth profit_growth")
def agg16(t):
    return dash.pnl_shift(t.priced(t.days_before(730)), t.as_of, 365)


@query("AGG17", f"""select count(*) as total_products, cast(sum(current_stock * {COST}) as double) as inventory_value, count(*) filter (where st = 'DEAD') as dead_stock,
   count(*) filter (where st = 'RISK') as at_risk, count(*) filter (where st = 'FAST') as high_turnover, count(*) filter (where current_stock < m * 2) as critical_stockout
  from (select *, case when m is null then 'NONE' when days > 180 then 'DEAD' when days < 7 then 'RISK' when days < 30 then 'FAST' else 'OK' end as st from (
   select p.*, m, case when coalesce(m, 0) = 0 then 999.0 else current_stock / m end as days from products p left join
    (select product_id, cast(sum(quantity_sold) as double) / count(*) as m from sales group by product_id) s on p.product_id = s.product_id))""", "inventory_value")
def agg17(t):
    rates = t.sales().groupBy("product_id").agg(
        (F.sum("quantity_sold").cast("double") / F.count(F.lit(1))).alias("per_row"))
    return dash.inventory_health(t.products, rates)


CH = "select sales_channel as channel, date, cast(sum(quantity_sold) as bigint) as qty from feed group by 1, 2"


@query("AGG20", """with g as (select channel, count(*) as days, cast(sum(qty) as bigint) as total, cast(sum(qty) as double) / count(*) as mean,
     sqrt(greatest(0.0::double, cast(sum(qty * qty) as double) / count(*) - (cast(sum(qty) as double) / count(*)) * (cast(sum(qty) as double) / count(*)))) as sd,
     min(qty) as min_daily, max(qty) as max_daily, cast(count(*) * sum(i * qty) - sum(i) * sum(qty) as double) / nullif(cast(count(*) * sum(i * i) - sum(i) * sum(i) as double), 0) as slope
    from (select *, row_number() over (partition by channel order by date) as i from ch) group by channel),
   s as (select *, round(cast(total as double) / (select sum(total) from g) * 100, 1) as share_pct from g)
  select channel, days, total, mean, sd, min_daily, max_daily, share_pct, case when slope > 0.05 then 'INCREASING' when slope < -0.05 then 'DECREASING' else 'STABLE' end as trend,
   case when (select sum(share_pct / 100 * (share_pct / 100)) from s) > 0.5 then 'HIGH' when (select sum(share_pct / 100 * (share_pct / 100)) from s) > 0.25 then 'MODERATE' else 'LOW' end as concentration,
   total = max(total) over () as is_top from s""", "mean sd share_pct", {"ch": CH})
def agg20(t):
    daily = t.feed().groupBy(F.col("sales_channel").alias("channel"), "date").agg(F.sum("quantity_sold").alias("qty"))
    return dash.channel_stats(daily)


@query("AGG22", """select count(*) as notifications, count(*) filter (where status = 'FAILED') as failures, (select count(*) from recipients where is_active) as active_recipients
  from notices where created_at >= (select max(created_at) from notices) - interval 24 hours""")
def agg22(t):
    return dash.notification_metrics(t.notices, t.recipients)


@query("AGG23", f"""select *, case when greatest(total_units / 365.0::double, 0.1) = 0 then 999.0 else total_units / greatest(total_units / 365.0::double, 0.1) end as days_of_inventory from (
  select count(*) as total_products, cast(sum(current_stock) as bigint) as total_units, count(*) filter (where current_stock = 0) as out_of_stock,
   count(*) filter (where current_stock between 1 and 50) as low_stock, cast(sum(current_stock * {COST}) as double) as stock_value from products)""",
       "stock_value days_of_inventory")
def agg23(t):
    return dash.stock_snapshot(t.products)


@query("AGG24", """select product_id, cast(date_trunc('week', forecast_date) as date) as week, count(*) as days,
  round(cast(sum(cast(greatest(0.0, predicted_demand) as decimal(18,6))) as double)) as predicted from forecasts group by 1, 2""", "predicted")
def agg24(t):
    return dash.weekly_buckets(t.forecasts)


@query("AGG25", f"""with y as (select l_partkey as product_id, cast(sum(cast(l_quantity as int)) as bigint) as units, count(*) as orders, count(*) filter (where l_linestatus = 'F') as fulfilled
    from lineitem where cast(l_shipdate as date) >= (select d from clock) - 365 group by l_partkey)
  select p.product_id, case when current_stock * unit_cost > 0 then coalesce(units, 0) * unit_cost / (current_stock * unit_cost) else 0.0 end as turnover,
   case when coalesce(units / 365.0::double, 0) = 0 then 999.0 else current_stock / (units / 365.0::double) end as days_of_inventory,
   case when coalesce(orders, 0) = 0 then 1.0 else cast(fulfilled as double) / orders end as fill_rate, current_stock * unit_cost * 0.25 as carrying_cost
  from products p left join y on p.product_id = y.product_id""", "turnover days_of_inventory fill_rate carrying_cost")
def agg25(t):
    lines = t._lines(t.days_before(365)).groupBy(F.col("l_partkey").alias("product_id")).agg(
        F.sum(F.col("l_quantity").cast("int")).alias("units"), F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("l_linestatus") == "F").alias("fulfilled"))
    return dash.rate_kpis(t.products, lines)


# --- joins ------------------------------------------------------------------

@query("JOI01", f"""select p.product_id, sku, cast(sum(quantity_sold) as bigint) as units, cast(sum(quantity_sold * {PRICE}) as double) as revenue
  from sales s join products p on s.product_id = p.product_id group by p.product_id, sku""", "revenue")
def joi01(t):
    units = t.sales().groupBy("product_id").agg(F.sum("quantity_sold").alias("units"))
    return units.join(t.products.select("product_id", "sku", "unit_price"), "product_id").select(
        "product_id", "sku", "units", (F.col("units") * dash.money(F.col("unit_price"))).cast("double").alias("revenue"))


@query("JOI02", f"select p.product_id, coalesce(m, 1.0) as demand from products p left join ({row_avg(30, 'm')}) r on p.product_id = r.product_id", "demand")
def joi02(t):
    return t.products.select("product_id").join(
        row_average(t.sales(t.days_before(30)), t.as_of, 30, "m"), "product_id", "left").select(
        "product_id", F.coalesce("m", F.lit(1.0)).alias("demand"))


@query("JOI03", """select p.product_id, unit_price, per_day from products p join (select product_id, cast(sum(quantity_sold) as double) / greatest(1, max(date) - min(date)) as per_day
  from sales group by product_id having cast(sum(quantity_sold) as double) / greatest(1, max(date) - min(date)) > 0.4) r on p.product_id = r.product_id where current_stock = 0""", "per_day")
def joi03(t):
    rate = spark_daily_stats(t.sales(), t.as_of).select("product_id", daily_rate("span0").alias("per_day")).filter("per_day > 0.4")
    return t.products.filter("current_stock = 0").select("product_id", "unit_price").join(rate, "product_id")


@query("JOI04", "select product_id, forecast_date, predicted_demand, actual, ape from scored", "predicted_demand ape", {"scored": SCORED})
def joi04(t):
    return _scored(t).select("product_id", "forecast_date", "predicted_demand", "actual", "ape")


@query("JOI05", """select supplier_id, scored_on, overall_risk_score from (select *, row_number() over (partition by supplier_id order by scored_on desc) as rn from supplier_risk) where rn = 1""",
       "overall_risk_score")
def joi05(t):
    return inv.latest_per_key(t.supplier_risk, "supplier_id", "scored_on", ["scored_on", "overall_risk_score"])


@query("SUP01", """select s_suppkey as supplier_id, s_name as supplier_name, n_name as country, overall_risk_score, case when overall_risk_score >= 40 then 'HIGH'
   when overall_risk_score >= 25 then 'MEDIUM' else 'LOW' end as risk_level from supplier join nation on s_nationkey = n_nationkey left join
  (select supplier_id, overall_risk_score, row_number() over (partition by supplier_id order by scored_on desc) as rn from supplier_risk) r on s_suppkey = supplier_id and rn = 1""",
       "overall_risk_score")
def sup01(t):
    latest = inv.latest_per_key(t.supplier_risk, "supplier_id", "scored_on", ["overall_risk_score"])
    base = t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name"), F.col("n_name").alias("country"))
    r = F.col("overall_risk_score")
    return base.join(latest, "supplier_id", "left").withColumn(
        "risk_level", F.when(r >= 40, "HIGH").when(r >= 25, "MEDIUM").otherwise("LOW"))


@query("JOI06", """select 'matched' as side, count(*) as n, count(distinct trim(product_code)) as codes from raw_sales r join products p on trim(r.product_code) = p.sku
  union all select 'unmatched', count(*), count(distinct trim(product_code)) from raw_sales r where trim(product_code) not in (select sku from products)""")
def joi06(t):
    raw = t.raw_sales.select(F.trim("product_code").alias("sku"))
    known = t.products.select("sku")

    def side(df, name):
        per = df.groupBy("sku").agg(F.count(F.lit(1)).alias("c"))
        return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("codes")).select(
            F.lit(name).alias("side"), "n", "codes")

    return side(raw.join(known, "sku"), "matched").unionByName(side(raw.join(known, "sku", "left_anti"), "unmatched"))


@query("JOI07", """select cast(g.d as date) as date, coalesce(units, 0) as units from (select unnest(generate_series((select min(date) from sales), (select d from clock), interval 1 day)) as d) g
  left join (select date, cast(sum(quantity_sold) as bigint) as units from sales group by date) s on cast(g.d as date) = s.date""")
def joi07(t):
    per = t.sales().groupBy("date").agg(F.sum("quantity_sold").alias("units"))
    bounds = per.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    grid = bounds.select(F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("date"))
    return grid.join(per, "date", "left").select("date", F.coalesce("units", F.lit(0)).alias("units"))


@query("JOI08", f"""select product_id, cast(coalesce(sum(quantity_sold) filter (where {window(180)}), 0) as bigint) as current_units,
  cast(coalesce(sum(quantity_sold) filter (where not ({window(180)})), 0) as bigint) as previous_units from sales where {window(360)} group by product_id""")
def joi08(t):
    cur = F.col("date") >= F.lit(t.days_before(180))
    q = F.col("quantity_sold")
    return since(t.sales(t.days_before(360)), t.as_of, 360).groupBy("product_id").agg(
        F.coalesce(F.sum(F.when(cur, q)), F.lit(0)).alias("current_units"),
        F.coalesce(F.sum(F.when(~cur, q)), F.lit(0)).alias("previous_units"))


@query("JOI09", """select product_id, discount, unit_price * (1.0 - discount) as price from products, (values (0.1::double), (0.2::double), (0.3::double)) g(discount)""", "price")
def joi09(t):
    df = dec.explode_grid(t.products.select("product_id", "unit_price"), [(0.1,), (0.2,), (0.3,)], ["discount"])
    return df.select("product_id", "discount", (F.col("unit_price") * (1.0 - F.col("discount"))).alias("price"))


# --- set operations ------------------------------------------------------------

@query("SET01", """select product_id, 'OUT' as band from products where current_stock = 0 union all select product_id, 'LOW' from products where current_stock between 1 and 10""")
def set01(t):
    p = t.products
    return listing.in_band(p, "OUT").select("product_id", F.lit("OUT").alias("band")).unionByName(
        listing.in_band(p, "LOW").select("product_id", F.lit("LOW").alias("band")))


@query("SET02", "select product_id, list_sort(list_filter(['cost','price','stock'], lambda x: not list_contains(h, x))) as missing from (select line_no as product_id, list_filter([case when cost is not null then 'cost' end, case when price is not null then 'price' end, case when stock is not null then 'stock' end], lambda x: x is not null) as h from raw_products)")
def set02(t):
    need = ["cost", "price", "stock"]
    have = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in need]))
    return t.raw_products.select(
        F.col("line_no").alias("product_id"),
        F.array_sort(F.array_except(F.array(*[F.lit(c) for c in need]), have)).alias("missing"))


@query("SET03", """select p.product_id, cast(g.w as date) as week, coalesce(units, 0) as units from (select unnest(generate_series(date_trunc('week', (select d from clock) - 200), (select d from clock)::timestamp, interval 7 day)) as w) g cross join (select distinct product_id from sales where date >= (select d from clock) - 200) p
  left join (select product_id, cast(date_trunc('week', date) as date) as week, cast(sum(quantity_sold) as bigint) as units from sales where date >= (select d from clock) - 200 group by 1, 2) s
  on cast(g.w as date) = s.week and p.product_id = s.product_id""")
def set03(t):
    start = F.date_trunc("week", F.lit(t.days_before(200))).cast("date")
    seen = since(t.sales(t.days_before(200)), t.as_of, 200).groupBy(
        "product_id", F.date_trunc("week", "date").cast("date").alias("week")).agg(F.sum("quantity_sold").alias("u"))
    # Every product that sold gets every week: its rows are the grid, filled in place.
    weeks = seen.select("product_id").distinct().select(
        "product_id", F.explode(F.sequence(start, F.lit(t.as_of), F.expr("interval 7 days"))).alias("week"))
    grid = weeks.withColumn("u", F.lit(0).cast("bigint")).unionByName(seen)
    return grid.groupBy("product_id", "week").agg(F.sum("u").alias("units"))


@query("SET04", f"""select product_id, case when product_id in (select product_id from sales where {window(30)}) and current_stock > 0 then 'DEMAND' else 'OUT' end as source
  from products where current_stock = 0 or product_id in (select product_id from sales where {window(30)})""")
def set04(t):
    p = t.products.select("product_id", "current_stock")
    out = p.filter("current_stock = 0").select("product_id", F.lit("OUT").alias("source"), F.lit(1).alias("turn"))
    sold = t.sales(t.days_before(30)).select("product_id")
    live = listing.only_ids(p.filter("current_stock > 0"), sold).select("product_id", F.lit("DEMAND").alias("source"), F.lit(2).alias("turn"))
    return out.unionByName(live).groupBy("product_id").agg(F.max_by("source", "turn").alias("source"))


# --- classes -------------------------------------------------------------------

UNITS = "select product_id, cast(sum(quantity_sold) as bigint) as u from sales group by product_id"
VALUE = f"select p.*, u as annual_units, cast(u * {COST} as decimal(28,4)) as v from products p join ({UNITS}) s on p.product_id = s.product_id"
ABC = """select *, cast(sum(v) over (order by v desc, product_id rows unbounded preceding) as double) / cast(sum(v) over () as double) * 100 as cumulative_pct, cast(sum(v) over () as double) as total_value from {src}"""
KLASS = "case when cumulative_pct <= 80 then 'A' when cumulative_pct <= 95 then 'B' else 'C' end"


def _units(t):
    return t.products.join(t.sales().groupBy("product_id").agg(F.sum("quantity_sold").alias("annual_units")), "product_id")


@query("WIN01", f"select product_id, cast(v as double) as annual_value, cumulative_pct, {KLASS} as abc_class from ({ABC.format(src='valued')})",
       "annual_value cumulative_pct", {"valued": VALUE})
def win01(t):
    df = _units(t).withColumn("v", (F.col("annual_units") * dash.money(F.col("unit_cost"))).cast("decimal(28,4)"))
    return cls.abc_by_value(df, "v").select("product_id", F.col("v").cast("double").alias("annual_value"), "cumulative_pct", "abc_class")


PROFIT = f"""select *, annual_margin / annual_revenue * 100 as margin_pct from (select *, cast(v as double) as annual_revenue, cast(v as double) - annual_units * unit_cost as annual_margin, current_stock * unit_cost as inventory_value,
   current_stock / (annual_units / 365::double) as days_of_inventory, {KLASS} as abc_class from ({ABC.format(src='revved')}))"""
PROFIT_CTES = {"revved": VALUE.replace(COST, PRICE), "profit": PROFIT}
DEAD = "(annual_units < 50 and current_stock > annual_units * 0.5)"


def _profit(t):
    return cls.profitability(_units(t))


@query("WIN02", "select product_id, annual_revenue, annual_margin, margin_pct, inventory_value, days_of_inventory, abc_class from profit",
       "annual_revenue annual_margin margin_pct inventory_value days_of_inventory", PROFIT_CTES)
def win02(t):
    return _profit(t).select("product_id", "annual_revenue", "annual_margin", "margin_pct", "inventory_value", "days_of_inventory", "abc_class")


@query("WIN02_classes", f"""select abc_class, count(*) as products, cast(sum(cast(round(annual_revenue, 4) as decimal(24,4))) as double) as revenue, count(*) filter (where {DEAD}) as dead_stock from profit group by abc_class""",
       "revenue", PROFIT_CTES)
def win02_classes(t):
    return cls.class_summary(_profit(t))


@query("WIN03", """select product_id, case when abc_class = 'A' then (case when margin_pct > 40 then 'STAR' when days_of_inventory > 90 then 'CASH_COW' else 'CORE' end)
   when abc_class = 'B' then (case when margin_pct < 20 then 'PROBLEM_CHILD' else 'STEADY' end) when days_of_inventory > 180 then 'DEAD_STOCK' else 'NICHE' end as kind from profit""", "", PROFIT_CTES)
def win03(t):
    return _profit(t).select("product_id", cls.seven_way(F.col("abc_class"), F.col("margin_pct"), F.col("days_of_inventory")).alias("kind"))


_LOWSALES = {"revved": VALUE.replace(COST, PRICE).replace("u as annual_units", "u // 12 as annual_units").replace("cast(u *", "cast((u // 12) *"), "profit": PROFIT}


def _profit_low(t):
    df = _units(t).withColumn("annual_units", F.floor(F.col("annual_units") / 12).cast("bigint")).filter("annual_units > 0")
    return cls.profitability(df)


@query("WIN04", f"""select product_id, current_stock, inventory_value, unit_cost * 0.6::double as clearance_price, current_stock * (unit_cost * 0.6::double) as clearance_revenue,
   inventory_value - current_stock * (unit_cost * 0.6::double) as loss from profit where {DEAD} order by annual_revenue desc, product_id limit 5""",
       "inventory_value clearance_price clearance_revenue loss", {**_LOWSALES, "revved": _LOWSALES["revved"] + " where u // 12 > 0"})
def win04(t):
    return cls.dead_stock(_profit_low(t))


@query("WIN05", """select product_id, annual_margin, margin_pct, annual_revenue * 2 as doubled_revenue from profit where margin_pct > 50 order by margin_pct desc, product_id limit 5""",
       "annual_margin margin_pct doubled_revenue", PROFIT_CTES)
def win05(t):
    return cls.margin_opportunities(_profit(t))


@query("WIN07", """select product_id, rn as pos, case when (rn - 1) / n::double < 0.2 then 'A' when (rn - 1) / n::double < 0.5 then 'B' else 'C' end as abc_class,
   case when (rn - 1) / n::double < 0.2 then 0.97 when (rn - 1) / n::double < 0.5 then 0.95 else 0.90 end::double as service_level,
   case when (rn - 1) / n::double < 0.2 then 'HIGH' when (rn - 1) / n::double < 0.5 then 'MEDIUM' else 'LOW' end as priority
  from (select product_id, row_number() over (order by v desc, product_id) as rn, count(*) over () as n from revved)""", "", PROFIT_CTES)
def win07(t):
    df = _units(t).withColumn("v", (F.col("annual_units") * dash.money(F.col("unit_price"))).cast("decimal(28,4)"))
    return cls.abc_by_rank(df, "v").select("product_id", "pos", "abc_class", "service_level", "priority")


@query("WIN08", f"""with r as (select p.product_id, sku, current_stock, quantity, unit_price, unit_cost, cast(quantity * {PRICE} as double) as revenue, cast(quantity * ({PRICE} - {COST}) as double) as profit
    from products p join (select product_id, cast(sum(quantity_sold) as bigint) as quantity from sales where {window(30)} group by product_id) s on p.product_id = s.product_id
    order by revenue desc, product_id limit 5), d as (select *, case when quantity / max(quantity) over ()::double >= 0.7 then 'HIGH' when quantity / max(quantity) over ()::double >= 0.3 then 'MEDIUM' else 'LOW' end as demand_level from r)
  select product_id, sku, current_stock, quantity, revenue, profit, demand_level, case when unit_price < unit_cost then 'REVIEW_PRICING' when demand_level = 'HIGH' and current_stock < quantity then 'INCREASE_STOCK'
   when demand_level = 'LOW' and profit <= 0 then 'PROMOTE' else 'MONITOR' end as advice from d""", "revenue profit")
def win08(t):
    return dash.top_sellers(t.products, t.sales(t.days_before(30)), t.as_of)


@query("WIN09", f"select product_id, sku, cast(current_stock * {COST} as double) as stock_value from products order by stock_value desc, product_id limit 10", "stock_value")
def win09(t):
    v = (F.col("current_stock") * dash.money(F.col("unit_cost"))).cast("double")
    return t.products.select("product_id", "sku", v.alias("stock_value")).orderBy(F.col("stock_value").desc(), "product_id").limit(10)


@query("WIN09_revenue", f"""select product_id, cast(sum(revenue) as double) as revenue, cast(sum(quantity_sold) as bigint) as units from sales where {window(365)}
  group by product_id order by revenue desc, product_id limit 5""", "revenue")
def win09_revenue(t):
    return since(t.sales(t.days_before(365)), t.as_of, 365).groupBy("product_id").agg(
        F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity_sold").alias("units")).orderBy(
        F.col("revenue").desc(), "product_id").limit(5)


@query("WIN10", """select product_id, date, qty, case when n < 7 then qty::double else cast(sum(qty) over f as double) / count(*) over f end as ma
  from (select *, count(*) over (partition by product_id) as n from part_daily) window f as (partition by product_id order by date rows 6 preceding)""", "ma")
def win10(t):
    return cls.moving_average(t.part_daily())


@query("WIN11", """select product_id, date, qty, case when n < 7 then qty::double else
   (select cast(sum(x * w) as double) / sum(w) from (select unnest(l) as x, unnest(generate_series(1, len(l))) as w)) end as wma
  from (select *, count(*) over (partition by product_id) as n, list(qty) over (partition by product_id order by date rows 6 preceding) as l from part_daily)""", "wma")
def win11(t):
    return cls.weighted_moving_average(t.part_daily())


def _roll(k):
    f = f"(partition by product_id order by date rows {k - 1} preceding)"
    return (f"cast(sum(qty) over {f} as double) / count(*) over {f} as mean_{k}, case when count(*) over {f} > 1 then sqrt(greatest(0.0::double, (cast(sum(qty * qty) over {f} as double) "
            f"- cast(sum(qty) over {f} as double) * cast(sum(qty) over {f} as double) / count(*) over {f}) / (count(*) over {f} - 1))) else 0.0 end as sd_{k}")


@query("WIN12", f"""select product_id, date, qty, {", ".join(f"lag(qty, {k}) over (partition by product_id order by date) as lag_{k}" for k in (7, 14, 30))}, {", ".join(_roll(k) for k in (7, 14, 30))}
  from brand_daily""", " ".join(f"mean_{k} sd_{k}" for k in (7, 14, 30)))
def win12(t):
    return cls.lag_features(t.brand_daily(), (7, 14, 30), (7, 14, 30))


@query("WIN14", """with m as (select *, case when count(*) over a = 7 then cast(sum(qty) over a as double) / 7 end as s, case when count(*) over b = 14 then cast(sum(qty) over b as double) / 14 end as l,
    row_number() over (partition by product_id order by date desc) as rn from part_daily
    window a as (partition by product_id order by date rows 6 preceding), b as (partition by product_id order by date rows 13 preceding)),
  g as (select *, lag(s - l, 4) over (partition by product_id order by date) as pg, lag(s, 4) over (partition by product_id order by date) as ps from m)
  select product_id, s as current_mean, ps as previous_short, (s - l) - pg as acceleration, case when abs((s - l) - pg) < l * 0.02 then 'STABLE' when (s - l) - pg > 0 then 'ACCELERATING' else 'DECELERATING' end as status,
   s * case when abs((s - l) - pg) < l * 0.02 then 1.0 when (s - l) - pg > 0 then 1.05 else 0.95 end::double as next_forecast from g where rn = 1 and pg is not null""",
       "current_mean previous_short acceleration next_forecast")
def win14(t):
    return cls.trend_acceleration(t.part_daily())


@query("WIN16", f"""select abc_class, count(*) as products, case abc_class when 'A' then '95-99' when 'B' then '90-95' else 'BULK' end as advice from profit group by abc_class
  union all select 'DEAD', count(*) filter (where {DEAD}), 'CLEARANCE' from profit""", "", PROFIT_CTES)
def win16(t):
    return cls.class_advice(_profit(t))


# --- sensing -------------------------------------------------------------------

def _last_qty(t, keep):
    w = Window.partitionBy("product_id").orderBy(F.col("date").desc())
    return t.part_daily().withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)


@query("SEN01", """with r as (select *, row_number() over (partition by product_id order by date desc) as rn from part_daily),
  s as (select *, count(*) over w as n, cast(sum(qty) over w as double) / count(*) over w as mean,
     sqrt(greatest(0.0::double, cast(sum(qty * qty) over w as double) / count(*) over w - (cast(sum(qty) over w as double) / count(*) over w) * (cast(sum(qty) over w as double) / count(*) over w))) as sd
     from r where rn <= 30 window w as (partition by product_id)),
  z as (select *, case when sd > 0 then abs(qty - mean) / sd else 0.0 end as z from s where n >= 7)
  select product_id, date, qty, mean, z, case when z > 3.0 then 'HIGH' else 'MEDIUM' end as severity, case when count(*) over (partition by product_id) > 3 then 'HIGH' else 'MEDIUM' end as overall,
   case when mean > 0 then (qty - mean) / mean * 100 else 0.0 end as deviation_pct from z where z > 2.0""", "mean z deviation_pct")
def sen01(t):
    return cls.anomalies(_last_qty(t, 30)).select("product_id", "date", "qty", "mean", "z", "severity", "overall", "deviation_pct")


@query("SEN02", """select product_id, n, case when n < 2 then 'INSUFFICIENT_DATA' when n >= 3 then (case when slope > 0.05 then 'INCREASING' when slope < -0.05 then 'DECREASING' else 'STABLE' end)
   when l > f then 'INCREASING' when l < f then 'DECREASING' else 'STABLE' end as trend
  from (select product_id, count(*) as n, cast(count(*) * sum(i * qty) - sum(i) * sum(qty) as double) / nullif(cast(count(*) * sum(i * i) - sum(i) * sum(i) as double), 0) as slope, arg_min(qty, i) as f, arg_max(qty, i) as l
   from (select *, row_number() over (partition by product_id order by date) - 1 as i from part_daily) group by product_id)""")
def sen02(t):
    from granary.operators.series_terms import slope

    i = F.row_number().over(Window.partitionBy("product_id").orderBy("date")) - 1
    g = t.part_daily().withColumn("i", i).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), slope(F.col("i"), F.col("qty")).alias("s"),
        F.min_by("qty", "i").alias("f"), F.max_by("qty", "i").alias("l"))
    return g.select("product_id", "n", dash.trend_label(F.col("n"), F.col("s"), F.col("f"), F.col("l")).alias("trend"))


@query("SEN03", """with d as (select product_id, qty, case when date >= (select d from clock) - 90 then 'post' when date >= (select d from clock) - 180 then 'during' when date >= (select d from clock) - 540 then 'pre' end as phase from brand_daily),
  g as (select product_id, cast(sum(qty) filter (where phase = 'pre') as double) / nullif(count(*) filter (where phase = 'pre'), 0) as pre, cast(sum(qty) filter (where phase = 'during') as double) / nullif(count(*) filter (where phase = 'during'), 0) as during,
    cast(sum(qty) filter (where phase = 'post') as double) / nullif(count(*) filter (where phase = 'post'), 0) as post, count(*) filter (where phase = 'during') as n from d where phase is not null group by product_id),
  u as (select *, case when pre > 0 then (during - pre) / pre * 100 else 0.0 end as lift_pct, (during - pre) * n as uplift from g where pre is not null and during is not null)
  select *, case when pre > 0 then (post - pre) / pre * 100 end as carryover_pct, case when post > pre then uplift / (post - pre) when post is not null then 0.0 end as payback_days,
   (uplift * 10 - 500) / 500 * 100 as roi_pct, case when (uplift * 10 - 500) / 500 * 100 > 50 then 'HIGHLY_EFFECTIVE' when (uplift * 10 - 500) / 500 * 100 > 0 then 'EFFECTIVE' else 'LOW_RETURN' end as verdict from u""",
       "pre during post lift_pct uplift carryover_pct payback_days roi_pct")
def sen03(t):
    d = F.col("date")
    phase = F.when(d >= F.lit(t.days_before(90)), "post").when(d >= F.lit(t.days_before(180)), "during").when(d >= F.lit(t.days_before(540)), "pre")
    return cls.promotion_lift(t.brand_daily().withColumn("phase", phase).filter("phase is not null").drop("date"))


@query("SNK04", f"""select date as sale_date, cast(sum(quantity_sold) as bigint) as total_quantity, cast(sum(coalesce(revenue, quantity_sold * 10)) as double) as total_revenue,
  cast(sum(quantity_sold * coalesce({M.format('unit_cost_at_sale')}, 5)) as double) as total_cost, cast(sum(case when profit_loss_amount < 0 then -profit_loss_amount else 0 end) as double) as total_loss,
  count(*) as transactions from priced group by date""", "total_revenue total_cost total_loss")
def snk04(t):
    return dash.daily_summary(t.priced())


@query("TSF35", f"""with g as (select product_id, count(distinct date) as nd, cast(sum(quantity_sold) filter (where not ({window(365)})) as double) / nullif(count(*) filter (where not ({window(365)})), 0) as train,
    cast(sum(quantity_sold) filter (where {window(365)}) as double) / nullif(count(*) filter (where {window(365)}), 0) as test from sales where {window(1095)} group by product_id)
  select count(*) as products, coalesce(greatest(0.0, 1.0 - avg(least(abs(train - test) / test, 1.0))), 0.0) as accuracy from g where nd >= 14 and train <> 0 and test > 0""", "accuracy")
def tsf35(t):
    return dash.quick_accuracy(t.sales(t.days_before(1095)), t.as_of, 365, 730)


@query("TSF36", "select count(*) as points, greatest(0.0, 1.0 - avg(least(ape, 1.0))) as accuracy from scored", "accuracy", {"scored": SCORED})
def tsf36(t):
    return dash.overall_accuracy(_scored(t), cap=True)


@query("TSF36_full", "select count(*) as points, greatest(0.0, 1.0 - avg(ape)) as accuracy from scored", "accuracy", {"scored": SCORED})
def tsf36_full(t):
    return dash.overall_accuracy(_scored(t), cap=False)
