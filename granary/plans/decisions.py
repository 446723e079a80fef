"""Service levels, risk profiles, finance, markdown, what-if and demand signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import mathx
from granary.functions.mathx import z_value
from granary.operators import decision as dec
from granary.operators import policy as pol
from granary.operators.demand import daily_stats as spark_daily_stats
from granary.plans.inventory import DEC_CTES, FULL_COLS, OPT, _span, annual, decided
from granary.plans.registry import query
from granary.plans.sqlparts import daily_stats, window

LEVELS = ", ".join(f"({lv}::double, {z_value(lv)!r}::double)" for lv in dec.SERVICE_LEVELS)
PROFILES = ", ".join(f"('{k}', {v}::double, {z_value(v)!r}::double)" for k, v in dec.PROFILES.items())


@query("DEC03", f"""select product_id, service_level, safety_stock, annual_holding, lost_margin, working_capital, total_cost,
   service_level = first_value(service_level) over (partition by product_id order by total_cost, service_level) as is_optimal,
   max(total_cost) over (partition by product_id) - min(total_cost) over (partition by product_id) as cost_range
  from (select *, round(annual_holding + lost_margin, 2) as total_cost
   from (select *, safety_stock / 2 * (unit_cost * 0.25::double) as annual_holding,
       annual_demand * (1.0 - service_level) * 0.01::double * unit_margin as lost_margin, (current_stock + safety_stock) * unit_cost as working_capital
   from (select a.* exclude (safety_stock), service_level, z * sd_daily * sqrt(lead) as safety_stock from annual a, (values {LEVELS}) g(service_level, z))))""",
       "safety_stock annual_holding lost_margin working_capital total_cost cost_range", DEC_CTES)
def dec03(t):
    return dec.service_level_grid(annual(t)).select(
        "product_id", "service_level", "safety_stock", "annual_holding", "lost_margin", "working_capital",
        "total_cost", "is_optimal", "cost_range")


@query("DEC04", """select product_id, past_cost, after as projected_stockouts, projected_cost, past_cost - projected_cost as annual_savings,
   (past_cost - projected_cost) / (past_cost + 1) * 100 as savings_pct, past_stockouts - after as stockout_reduction,
   case when past_cost - projected_cost > 0 then 14 else 0 end as payback_days, (past_cost - projected_cost) * 3 as three_year
  from (select *, past_stockouts * unit_margin * 100 + holding_waste as past_cost,
      after * unit_margin * 100 + order_quantity / 2 * unit_cost * 0.25::double / 12 as projected_cost
   from (select *, greatest(0, cast(trunc(past_stockouts * (1 - 0.95::double)) as int)) as after
   from (select *, cast(product_id % 61 as int) as past_stockouts, current_stock * unit_cost * 0.05::double as holding_waste from decided)))""",
       "past_cost projected_cost annual_savings savings_pct three_year", DEC_CTES)
def dec04(t):
    df = decided(t).withColumns({
        "past_stockouts": (F.col("product_id") % 61).cast("int"),
        "holding_waste": F.col("current_stock") * F.col("unit_cost") * 0.05})
    return dec.decision_impact(df).select(
        "product_id", "past_cost", "projected_stockouts", "projected_cost", "annual_savings", "savings_pct",
        "stockout_reduction", "payback_days", "three_year")


PROFILED = """select *, case when score >= 70 then 'CONSERVATIVE' when score >= 50 then 'BALANCED' else 'AGGRESSIVE' end as profile,
   ((case when score >= 70 then 0.99::double when score >= 50 then 0.95::double else 0.90::double end) + (case when supplier_reliability < 85 then 0.02::double else 0.0 end)) * 100 as target_service_level
  from (select *, (case criticality when 'critical' then 100 when 'important' then 70 when 'seasonal' then 30 else 50 end) * 0.4::double
     + least(100.0::double, volatility * 100) * 0.3::double + least(100.0::double, margin_share * 100) * 0.2::double
     + (case when lifespan_months < 3 then 30 when lifespan_months < 12 then 50 else 80 end) * 0.1::double as score
   from (select *, case when mean_daily > 0 then sd_daily / mean_daily else 0.2 end as volatility,
     case when unit_price > 0 then (unit_price - unit_cost) / unit_price else 0.3 end as margin_share,
     cast(1 + product_id % 24 as int) as lifespan_months, cast(70 + product_id % 30 as int) as supplier_reliability,
     case product_id % 4 when 0 then 'critical' when 1 then 'important' when 2 then 'standard' else 'seasonal' end as criticality from annual))"""
PLAN = """select *, rop + eoq as max_inventory, avg_inventory * unit_cost as avg_inventory_value, annual_demand / greatest(1.0::double, avg_inventory) as turnover,
   case when annual_demand > 0 then avg_inventory / (annual_demand / 365) else 0.0 end as inventory_days,
   case when current_stock < rop then 'ORDER' else 'HOLD' end as order_recommendation,
   case when current_stock < rop then round(greatest(rop - current_stock, eoq)) else 0.0 end as order_quantity
  from (select *, annual_demand / 365 * lead2 + ss as rop, ss + eoq / 2 as avg_inventory,
     annual_demand / eoq * 50 + (ss + eoq / 2) * (unit_cost * 0.25::double) as annual_cost,
     annual_demand * (1.0 - service_level) * 0.01::double * unit_margin as lost_margin
   from (select *, z * sd_daily * sqrt(lead2) as ss, case when unit_cost * 0.25 > 0 then
       sqrt(2.0::double * annual_demand * 50.0::double / (unit_cost * 0.25::double)) else annual_demand / 12 end as eoq
    from (select p.*, g.service_level, g.z, lead * (1.0::double + {var}::double) as lead2 from {src} p join (values {profiles}) g(gp, service_level, z) on {cond})))"""
PLAN_CTES = {**DEC_CTES, "profiled": PROFILED,
             "plan": PLAN.format(var=0.1, src="profiled", profiles=PROFILES, cond="p.profile = g.gp"),
             "planall": PLAN.replace("select p.*, g.service_level", "select p.* exclude (current_stock), 0 as current_stock, g.gp as profile, g.service_level")
             .format(var=0.0, src="annual", profiles=PROFILES, cond="true")}


def _profiled(t):
    df = annual(t).withColumns({
        "volatility": F.when(F.col("mean_daily") > 0, F.col("sd_daily") / F.col("mean_daily")).otherwise(0.2),
        "margin_share": F.when(F.col("unit_price") > 0, F.col("unit_margin") / F.col("unit_price")).otherwise(0.3),
        "lifespan_months": (1 + F.col("product_id") % 24).cast("int"),
        "supplier_reliability": (70 + F.col("product_id") % 30).cast("int"),
        "criticality": F.array(*[F.lit(c) for c in ("critical", "important", "standard", "seasonal")])[
            (F.col("product_id") % 4).cast("int")]})
    return dec.risk_profile(df)


@query("RSK01", "select product_id, score, profile, target_service_level from profiled", "score target_service_level", PLAN_CTES)
def rsk01(t):
    return _profiled(t).select("product_id", "score", "profile", "target_service_level")


PLAN_COLS = ("product_id profile service_level safety_stock reorder_point eoq max_inventory annual_cost lost_margin "
             "avg_inventory_value turnover inventory_days order_recommendation order_quantity").split()


@query("RSK02", """select product_id, profile, service_level, ss as safety_stock, rop as reorder_point, eoq, max_inventory, annual_cost, lost_margin,
  avg_inventory_value, turnover, inventory_days, order_recommendation, order_quantity from plan""",
       " ".join(c for c in PLAN_COLS if c not in ("product_id", "profile", "service_level", "order_recommendation")), PLAN_CTES)
def rsk02(t):
    return dec.profile_plan(dec.with_profile_target(_profiled(t)), 0.1).select(*PLAN_COLS)


@query("RSK03", """select product_id, profile, total_cost, "value", total_cost - max(total_cost) filter (where profile = 'BALANCED') over w as cost_vs_balanced,
   "value" - max("value") filter (where profile = 'BALANCED') over w as capital_vs_balanced,
   profile = first_value(profile) over (partition by product_id order by total_cost, -service_level) as is_cheapest
  from (select *, round(annual_cost, 2) + round(lost_margin, 2) as total_cost, round(avg_inventory_value, 2) as "value" from planall)
  window w as (partition by product_id)""", "total_cost value cost_vs_balanced capital_vs_balanced", PLAN_CTES)
def rsk03(t):
    return dec.compare_profiles(annual(t)).select(
        "product_id", "profile", "total_cost", "value", "cost_vs_balanced", "capital_vs_balanced", "is_cheapest")


STORY = """select *, margin_before - margin_after as margin_saved, case when net > 0 then wc / greatest(1.0::double, net) * 365 else 999.0 end as payback_days,
   case when wc > 0 then net / greatest(1.0::double, wc) * 100 else 0.0 end as roi_percent
  from (select *, margin_before - margin_after - (wc * 0.08::double + carrying_cost) as net
  from (select product_id, annual_demand, annual_demand * (2.0::double / 100) * 0.01::double * unit_price * (1 - 0.4::double) as margin_before,
    annual_demand * (1.0 - service_level) * 0.01::double * unit_price * (1 - 0.4::double) as margin_after,
    order_quantity * unit_cost as wc, (current_stock * 2 + order_quantity) / 2 * unit_cost * 0.25::double as carrying_cost
   from (select d.*, p.service_level from decided d join full_policy p on d.product_id = p.product_id)))"""
STORY_CTES = {**DEC_CTES, **OPT, "story": STORY}


def _story(t):
    level = pol.full_policy(_span(t)).select("product_id", "service_level")
    return dec.decision_story(decided(t).join(level, "product_id"))


@query("FIN01", """select product_id, margin_before as margin_at_risk_before, margin_after as margin_at_risk_after, margin_saved, wc as working_capital_added,
   wc * 0.08::double as capital_cost, carrying_cost, net as net_benefit, payback_days, roi_percent, net * 3 as three_year,
   net / greatest(1.0::double, annual_demand) as net_per_unit from story""",
       "margin_at_risk_before margin_at_risk_after margin_saved working_capital_added capital_cost carrying_cost net_benefit payback_days roi_percent three_year net_per_unit",
       STORY_CTES)
def fin01(t):
    return _story(t).select(
        "product_id", "margin_at_risk_before", "margin_at_risk_after", "margin_saved", "working_capital_added",
        "capital_cost", "carrying_cost", "net_benefit", "payback_days", "roi_percent", "three_year", "net_per_unit")


@query("FIN02", """select product_id, case when net < 0 then 'NOT_RECOMMENDED' when payback_days > 365 then 'REVIEW' when payback_days > 180 then 'APPROVE'
   when payback_days > 90 then 'RECOMMEND' else 'HIGH_PRIORITY' end as verdict,
   case when net > 100000 then 'LARGE_SAVING' when net > 10000 then 'VALUE' else 'MARGINAL' end as headline from story""", "", STORY_CTES)
def fin02(t):
    v = dec.finance_verdict(F.col("net_benefit"), F.col("payback_days"))
    return _story(t).select("product_id", *[c.alias(k) for k, c in v.items()])


FOLIO = """select p.product_id, name, cast(r.revenue as double) * 0.05 as margin_saved, current_stock * unit_cost as wc_required, current_stock * unit_cost * 0.25 as carrying_cost
  from products p join (select product_id, sum(revenue) as revenue from sales group by product_id) r on p.product_id = r.product_id"""


def _folio(t):
    revenue = t.sales().groupBy("product_id").agg(F.sum("revenue").cast("double").alias("revenue"))
    return dec.portfolio_rows(t.products, revenue)


@query("FIN03", "select * from folio order by margin_saved desc, product_id limit 5",
       "margin_saved wc_required carrying_cost", {"folio": FOLIO})
def fin03(t):
    return _folio(t).orderBy(F.col("margin_saved").desc(), "product_id").limit(5)


@query("AGG18", """select *, margin_saved - wc_required - carrying_cost as net_benefit,
   (margin_saved - wc_required - carrying_cost) / annual_revenue * 100 as benefit_pct
  from (select count(*) as products, sum(margin_saved) as margin_saved, sum(wc_required) as wc_required, sum(carrying_cost) as carrying_cost,
   (select cast(sum(revenue) as double) / (max(date) - min(date) + 1) * 365 from sales) as annual_revenue from folio)""",
       "margin_saved wc_required carrying_cost annual_revenue net_benefit benefit_pct", {"folio": FOLIO})
def agg18(t):
    yearly = t.sales().agg(
        (F.sum("revenue").cast("double") / (F.datediff(F.max("date"), F.min("date")) + 1) * 365).alias("r"))
    return dec.portfolio_impact(_folio(t), yearly.scalar())


# --- markdown ---------------------------------------------------------------

LAST30 = """select product_id, qty, row_number() over (partition by product_id order by date) - 1 as i from (
   select product_id, date, qty, row_number() over (partition by product_id order by date desc) as back from part_daily) where back <= 30"""
TREND = f"""select product_id, n, case when n >= 7 then slope else 0.0 end as slope, case when n >= 7 then r2 else 0.0 end as r2, trend,
   case trend when 'RISING' then 1.2 when 'FALLING' then 0.8 else 1.0 end as multiplier
 from (select *, case when n < 7 then 'UNKNOWN' when strong and slope > 0.1 then 'RISING' when strong and slope < -0.1 then 'FALLING' else 'STABLE' end as trend
 from (select *, r2 >= 1.0 or r2 * (n - 2) / (1.0 - r2) > c * c as strong
 from (select *, list_extract([{', '.join(f'{v}::double' for v in mathx.T_CRITICAL)}], cast(n - 6 as int)) as c
 from (select product_id, n, cast(n * sxy - sx * sy as double) / nullif(n * sxx - sx * sx, 0)::double as slope,
   case when n * syy - sy * sy > 0 then cast(n * sxy - sx * sy as double) * cast(n * sxy - sx * sy as double)
      / nullif(cast(n * sxx - sx * sx as double) * cast(n * syy - sy * sy as double), 0) else 0.0 end as r2
  from (select product_id, count(*) as n, sum(i) as sx, sum(qty) as sy, sum(i * qty) as sxy, sum(i * i) as sxx, sum(qty * qty) as syy from last30 group by product_id)))))"""


def last_daily(t, keep: int):
    """Last ``keep`` daily totals per product, numbered upwards in time."""
    from pyspark.sql import Window

    newest = Window.partitionBy("product_id").orderBy(F.col("date").desc())
    trimmed = t.part_daily().withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= keep)
    up = Window.partitionBy("product_id").orderBy("date")
    return trimmed.withColumn("i", F.row_number().over(up) - 1).drop("back")


@query("MKD01", "select * from trend", "slope r2 multiplier", {"last30": LAST30, "trend": TREND})
def mkd01(t):
    return dec.demand_trend(last_daily(t, 30))


MD = f"""select p.*, cast(total_qty as double) / (span_days + 1) as daily_span, cast(total_qty as double) / (span_days + 1) * 30 as monthly,
   unit_cost * 0.001::double as daily_holding from products p join ({daily_stats()}) s on p.product_id = s.product_id"""
CATAVG = "select category, avg(daily_span) as cat from md group by category"


def _md(t):
    return dec.markdown_inputs(t.products, spark_daily_stats(t.sales(), t.as_of))


VEL = "cast(least(100, greatest(0, trunc(100.0::double * (1.0::double - exp(-{rel}))))) as int)"
VELBAND = "case when velocity_score >= 70 then 'FAST_MOVER' when velocity_score >= 40 then 'MODERATE' when velocity_score >= 20 then 'SLOW' else 'STAGNANT' end"


@query("MKD02", f"""select product_id, velocity_score, {VELBAND} as velocity_status, relative_velocity from (
   select product_id, {VEL.format(rel='(daily_span / (cat + 0.1))')} as velocity_score, daily_span / (cat + 0.1) as relative_velocity
   from md m join catavg c on m.category = c.category)""", "relative_velocity", {"md": MD, "catavg": CATAVG})
def mkd02(t):
    md = _md(t)
    means = md.groupBy("category").agg(F.avg("daily_span").alias("cat"))
    v = dec.velocity(F.col("daily_span"), F.col("cat"))
    return md.join(means, "category").select("product_id", *[c.alias(k) for k, c in v.items()])


# The driver's part types stand in for retail categories.
ELA = """select *, case when margin > 0.5 then base * 1.2::double when margin < 0.2 then base * 0.8::double else base end as e
  from (select *, case when unit_price > 0 then (unit_price - unit_cost) / unit_price else 0.3 end as margin,
    case category when 'Electronics' then -1.8 when 'Clothing' then -1.6 when 'Automotive' then -1.1 else -1.5 end::double as base
   from (select * exclude (category), case category when 'ECONOMY' then 'Electronics' when 'LARGE' then 'Clothing' when 'PROMO' then 'Automotive' else category end as category from md))"""
ECTES = {"md": MD, "ela": ELA}


def retail_category(df):
    c = F.col("category")
    return df.withColumn("category", F.when(c == "ECONOMY", "Electronics").when(c == "LARGE", "Clothing")
                         .when(c == "PROMO", "Automotive").otherwise(c))


@query("MKD03", """select product_id, margin, round(e, 2) as elasticity, case when abs(e) > 1 then 'ELASTIC' else 'INELASTIC' end as elasticity_type from ela""",
       "margin elasticity", ECTES)
def mkd03(t):
    df = retail_category(_md(t))
    return df.withColumns(dec.elasticity(F.col("unit_price"), F.col("unit_cost"), F.col("category"))).select(
        "product_id", "margin", "elasticity", "elasticity_type")


RANGE = """select *, greatest(0.05::double, theory * 0.5) as low, least(margin * 0.8::double, 0.4::double) as high,
   least(least(margin * 0.8::double, 0.4::double), greatest(greatest(0.05::double, theory * 0.5), theory)) as best
  from (select *, case when abs(e) > 0 then (abs(e) - 1.0) / (2.0 * abs(e)) else 0.1 end as theory from ela)"""


@query("MKD04", """select product_id, cast(round_even(low * 100, 0) as int) as min_discount, cast(round_even(high * 100, 0) as int) as max_discount,
  cast(round_even(best * 100, 0) as int) as optimal_discount from rng""", "", {**ECTES, "rng": RANGE})
def mkd04(t):
    df = retail_category(_md(t))
    df = df.withColumns(dec.elasticity(F.col("unit_price"), F.col("unit_cost"), F.col("category")))
    return df.select("product_id", *[
        c.alias(k) for k, c in dec.discount_range(F.col("elasticity_raw"), F.col("margin")).items()])


HEALTH = """select product_id, cover as monthly_coverage, current_stock / (monthly / 30 + 0.1::double) as health_days,
   case when cover < 1 then 'HEALTHY' when cover < 2 then 'SLOW_MOVING' when cover < 3 then 'AT_RISK' else 'CRITICAL' end as health,
   case when cover < 1 then 1 when cover < 2 then 2 when cover < 3 then 3 else 4 end as risk_level
  from (select *, current_stock / (monthly + 0.1::double) as cover from md)"""


@query("MKD05", "select * from health", "monthly_coverage health_days", {"md": MD, "health": HEALTH})
def mkd05(t):
    h = dec.coverage_health(F.col("current_stock"), F.col("monthly"))
    return _md(t).select("product_id", *[c.alias(k) for k, c in h.items()])


TIMING = f"""select *, case when urgency_score >= 80 then 'IMMEDIATE' when urgency_score >= 60 then 'URGENT' when urgency_score >= 40 then 'HIGH'
    when urgency_score >= 20 then 'MEDIUM' else 'LOW' end as urgency,
   case when urgency_score >= 80 then 0 when urgency_score >= 60 then 3 when urgency_score >= 40 then 7 when urgency_score >= 20 then 14 else 21 end as days_until_markdown
 from (select *, cast(least(100, greatest(0, trunc((case when days_of_inventory > 90 then 40 when days_of_inventory > 60 then 30 when days_of_inventory > 30 then 20
     when days_of_inventory > 14 then 10 else 0 end) + (30 - velocity_score * 0.3::double) + least(20.0::double, abs(elasticity) * 10) + least(10.0::double, margin * 20)))) as int) as urgency_score
 from (select *, {VEL.format(rel='(daily_demand / (10.0::double + 0.1::double))')} as velocity_score, current_stock / (daily_demand + 0.1::double) as days_of_inventory,
   current_stock * daily_holding * (current_stock / (monthly / 30 + 0.1::double)) as holding_cost_today,
   round(case when margin > 0.5 then -1.5::double * 1.2::double when margin < 0.2 then -1.5::double * 0.8::double else -1.5::double end, 2) as elasticity
 from (select m.*, monthly / 30 * tr.multiplier::double as daily_demand, case when unit_price > 0 then (unit_price - unit_cost) / unit_price else 0.3 end as margin
   from md m join trend tr on m.product_id = tr.product_id)))"""
TIME_CTES = {"md": MD, "last30": LAST30, "trend": TREND, "timing": TIMING, "health": HEALTH}
TIME_COLS = "product_id daily_demand days_of_inventory holding_cost_today velocity_score elasticity urgency_score urgency days_until_markdown".split()


def _timing(t):
    trend = dec.demand_trend(last_daily(t, 30)).select("product_id", "multiplier")
    return dec.markdown_timing(_md(t).join(trend, "product_id"), F.col("multiplier"))


@query("MKD06", f"select {', '.join(TIME_COLS)} from timing", "daily_demand days_of_inventory holding_cost_today elasticity", TIME_CTES)
def mkd06(t):
    return _timing(t).select(*TIME_COLS)


@query("MKD07", "select product_id, urgency_score from timing", "", TIME_CTES)
def mkd07(t):
    return _timing(t).select("product_id", "urgency_score")


SCEN = """select *, case when revenue > 0 then net_profit / revenue * 100 else 0.0 end as margin_pct,
   revenue - max(revenue) filter (where step = 0) over w as revenue_vs_idle, net_profit - max(net_profit) filter (where step = 0) over w as profit_vs_idle
 from (select *, revenue - current_stock * unit_cost - current_stock * daily_holding * 30 as net_profit,
   case when current_stock > 0 then sold / current_stock * 100 else 0.0 end as cleared_pct
 from (select *, case when step = 0 then sold * unit_price else sold * markdown_price + (current_stock - sold) * unit_price * (30 - 14) / 30 end as revenue
 from (select *, unit_price * (1.0 - discount) as markdown_price,
   case when step = 0 then 1.0 else lift0 end as lift,
   case when step = 0 then least(monthly / 30 * 30, current_stock::double) else trunc(least(monthly / 30 * lift0 * 14, current_stock::double)) end as sold
 from (select e.*, g.step, g.discount, least(3.0::double, 1.0::double + abs(round(e.e, 2)) * g.discount) as lift0
   from ela e, (values (0, 0.0::double), (1, 0.1::double), (2, 0.15::double), (3, 0.2::double), (4, 0.25::double), (5, 0.3::double)) g(step, discount)))))
 window w as (partition by product_id)"""
SCEN_CTES = {**ECTES, "scen": SCEN}


def _scen(t):
    return dec.markdown_scenarios(retail_category(_md(t)))


@query("MKD08", """select product_id, step, discount, markdown_price, lift, cast(trunc(sold) as int) as units_sold,
   cast(trunc(current_stock - sold) as int) as units_remaining, cleared_pct, revenue, net_profit, margin_pct, revenue_vs_idle, profit_vs_idle from scen""",
       "markdown_price lift cleared_pct revenue net_profit margin_pct revenue_vs_idle profit_vs_idle", SCEN_CTES)
def mkd08(t):
    return _scen(t).select(
        "product_id", "step", "discount", "markdown_price", "lift", "units_sold", "units_remaining", "cleared_pct",
        "revenue", "net_profit", "margin_pct", "revenue_vs_idle", "profit_vs_idle")


BEST = """select product_id, step, discount, markdown_price, cast(trunc(sold) as int) as units_sold, cleared_pct, revenue_vs_idle, profit_vs_idle
  from (select *, row_number() over (partition by product_id order by round(net_profit, 2) desc, step) as rn from scen) where rn = 1"""


@query("MKD09", "select * from best", "markdown_price cleared_pct revenue_vs_idle profit_vs_idle", {**SCEN_CTES, "best": BEST})
def mkd09(t):
    return dec.best_markdown(_scen(t))


@query("MKD10", """select t.product_id, sku, current_stock, daily_span, monthly, current_stock / greatest(daily_span, 0.1::double) as days_on_hand,
   health, risk_level, urgency, urgency_score, days_until_markdown
  from timing t join health h on t.product_id = h.product_id
  where current_stock > 0 and (risk_level >= 2 or current_stock / greatest(daily_span, 0.1::double) > 45)""", "daily_span monthly days_on_hand", TIME_CTES)
def mkd10(t):
    df = _timing(t).withColumns(dec.coverage_health(F.col("current_stock"), F.col("monthly"))).withColumn(
        "days_on_hand", F.col("current_stock") / F.greatest(F.col("daily_span"), F.lit(0.1)))
    chosen = df.filter((F.col("current_stock") > 0) & ((F.col("risk_level") >= 2) | (F.col("days_on_hand") > 45)))
    return chosen.select(
        "product_id", "sku", "current_stock", "daily_span", "monthly", "days_on_hand", "health", "risk_level",
        "urgency", "urgency_score", "days_until_markdown")


@query("MKD11", """select t.product_id, h.health, t.urgency, t.days_until_markdown, b.step, b.discount, b.markdown_price, b.units_sold,
   b.revenue_vs_idle, b.profit_vs_idle from timing t join health h on t.product_id = h.product_id join best b on t.product_id = b.product_id""",
       "markdown_price revenue_vs_idle profit_vs_idle", {**SCEN_CTES, **TIME_CTES, "best": BEST})
def mkd11(t):
    left = _timing(t).withColumns(dec.coverage_health(F.col("current_stock"), F.col("monthly"))).select(
        "product_id", "health", "urgency", "days_until_markdown")
    return left.join(dec.best_markdown(_scen(t)).drop("cleared_pct"), "product_id")


# --- what-if ------------------------------------------------------------------

PRICE = """select product_id, change_pct, np as new_price, nd as new_demand, r1 as new_revenue, round(r1 - r0 + 1e-6, 2) as revenue_change,
   case when r0 > 0 then (r1 - r0) / r0 * 100 else 0.0 end as revenue_change_pct, round((r1 - r0) * (1 - 0.4::double) + 1e-6, 2) as margin_change,
   case when r0 > 0 then (r1 / r0 - 1.0) * 100 else 0.0 end as margin_change_pct
  from (select *, unit_price * annual_demand as r0, np * nd as r1 from (select a.*, change_pct, unit_price * (1.0 + change_pct / 100) as np,
     annual_demand * (1.0::double + -1.2::double * change_pct / 100) as nd from annual a, (values (-10.0::double), (-5.0::double), (5.0::double), (10.0::double)) g(change_pct)))"""


def _price(t):
    return dec.price_change(annual(t), (-10, -5, 5, 10))


@query("SCN01", """select *, case when revenue_change_pct > 5 and margin_change > 0 then 'RECOMMENDED' when revenue_change_pct > 0 and margin_change > 0 then 'GOOD'
   when margin_change > 0 then 'CAUTION' else 'NOT_RECOMMENDED' end as verdict from price""",
       "new_price new_demand new_revenue revenue_change revenue_change_pct margin_change margin_change_pct", {**DEC_CTES, "price": PRICE})
def scn01(t):
    return _price(t).select("product_id", "change_pct", "new_price", "new_demand", "new_revenue", "revenue_change",
                            "revenue_change_pct", "margin_change", "margin_change_pct", "verdict")


SHIFT = """select product_id, shift_pct, nd as new_demand, ne as new_eoq, nr as new_rop, ns as new_safety_stock, na as new_avg_inventory,
    na - (eoq / 2 + safety_stock) as inventory_change, (na - (eoq / 2 + safety_stock)) * unit_cost * 0.25::double as cost_impact,
    case when nday > 0 then na / nday else 999.0 end as days_of_inventory
  from (select *, ne / 2 + ns as na from (select *, sqrt(2.0::double * nd * 50.0::double / (unit_cost * 0.25::double)) as ne
  from (select f.*, shift_pct, annual_demand * (1.0::double + shift_pct / 100) as nd, avg_daily * (1.0::double + shift_pct / 100) as nday,
     reorder_point * (1.0::double + shift_pct / 100) as nr, safety_stock * (1.0::double + abs(shift_pct) / 100) as ns
   from full_policy f, (values (-20.0::double), (10.0::double), (30.0::double)) g(shift_pct))))"""


@query("SCN02", """select *, case when days_of_inventory < 5 then 'HIGH' when days_of_inventory < 15 then 'MEDIUM' else 'LOW' end as stockout_risk,
   case when inventory_change < 0 and cost_impact < 0 then 'FAVORABLE' when inventory_change > 0 and cost_impact > 100 then 'PLAN_AHEAD'
     when inventory_change > 0 then 'MONITOR' else 'STATUS_QUO' end as verdict from shifted""",
       "new_demand new_eoq new_rop new_safety_stock new_avg_inventory inventory_change cost_impact days_of_inventory", {**OPT, "shifted": SHIFT})
def scn02(t):
    df = pol.full_policy(_span(t)).withColumn("daily", F.col("avg_daily"))
    return dec.demand_shift(df, (-20, 10, 30)).select(
        "product_id", "shift_pct", "new_demand", "new_eoq", "new_rop", "new_safety_stock", "new_avg_inventory",
        "inventory_change", "cost_impact", "days_of_inventory", "stockout_risk", "verdict")


# Offers: the two suppliers that shipped a part most often quote against the catalogue.
OFFERS = """select product_id, supplier_id, unit_cost_factor, new_lead, reliability, new_reliability from (
   select l_partkey as product_id, l_suppkey as supplier_id, (90 + l_suppkey % 21) / 100.0::double as unit_cost_factor, cast(2 + l_suppkey % 14 as int) as new_lead,
     0.9::double as reliability, (75 + l_suppkey % 25) / 100.0::double as new_reliability, row_number() over (partition by l_partkey order by count(*) desc, l_suppkey) as rn
   from lineitem group by l_partkey, l_suppkey) where rn <= 2"""
SWITCH = """select *, case when total_impact > 5000 and payback_months < 12 and reliability_change >= 0 then 'STRONGLY_RECOMMENDED'
    when total_impact > 2000 and reliability_change >= -0.05 then 'RECOMMENDED' when total_impact > 0 and reliability_change >= -0.1 then 'CONSIDER'
    when reliability_change > 0.1 then 'REVIEW' else 'NOT_RECOMMENDED' end as verdict
 from (select *, case when total_impact <> 0 then 5000.0::double / abs(total_impact) * 12 else 0.0 end as payback_months
 from (select *, annual_cost_change + safety_cost_impact as total_impact
 from (select a.product_id, supplier_id, (unit_cost * unit_cost_factor - unit_cost) * annual_demand as annual_cost_change,
    annual_demand * 0.2::double / 365 * (sqrt(greatest(1, new_lead)) - sqrt(lead)) * 1.645::double * 5.0::double as safety_cost_impact, new_reliability - reliability as reliability_change
   from annual a join offers o on a.product_id = o.product_id)))"""


def _switch(t):
    from pyspark.sql import Window

    k = F.col("l_suppkey")
    counts = t.raw("lineitem").groupBy(F.col("l_partkey").alias("product_id"), "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("product_id").orderBy(F.col("n").desc(), k)
    offers = counts.withColumn("rn", F.row_number().over(w)).filter("rn <= 2").select(
        "product_id", k.alias("supplier_id"), ((90 + k % 21) / 100.0).alias("factor"),
        (2 + k % 14).cast("int").alias("new_lead"), F.lit(0.9).alias("reliability"),
        ((75 + k % 25) / 100.0).alias("new_reliability"))
    df = annual(t).join(offers, "product_id").withColumn("new_cost", F.col("unit_cost") * F.col("factor"))
    return dec.supplier_switch(df).select(
        "product_id", "supplier_id", "annual_cost_change", "safety_cost_impact", "reliability_change",
        "total_impact", "payback_months", "verdict")


@query("SCN03", "select * from switched", "annual_cost_change safety_cost_impact reliability_change total_impact payback_months",
       {**DEC_CTES, "offers": OFFERS, "switched": SWITCH})
def scn03(t):
    return _switch(t)


@query("SCN04", """with u as (select product_id, 'PRICE ' || cast(cast(change_pct as int) as varchar) as scenario, cast(change_pct as int) as position, new_revenue,
     margin_change, revenue_change_pct, margin_change_pct, 0.0::double as cost from price
    union all select product_id, 'SUPPLIER ' || supplier_id, 100 + cast(supplier_id as int), 0.0, 0.0, 0.0, 0.0, annual_cost_change from switched)
  select product_id, arg_max(scenario, {'a': round(new_revenue, 4), 'b': -position}) as best_revenue,
   arg_max(scenario, {'a': round(margin_change, 4), 'b': -position}) as best_margin,
   arg_max(scenario, {'a': round(-cost, 4), 'b': -position}) as best_cost,
   arg_max(scenario, {'a': round(revenue_change_pct * 0.4::double + margin_change_pct * 0.4::double - cost / 1000 * 0.2::double, 4), 'b': -position}) as recommended
  from u group by product_id""", "", {**DEC_CTES, "price": PRICE, "offers": OFFERS, "switched": SWITCH})
def scn04(t):
    price = _price(t).select(
        "product_id", F.concat(F.lit("PRICE "), F.col("change_pct").cast("int").cast("string")).alias("scenario"),
        F.col("change_pct").cast("int").alias("position"), "new_revenue", "margin_change", "revenue_change_pct", "margin_change_pct")
    switch = _switch(t).select(
        "product_id", F.concat(F.lit("SUPPLIER "), F.col("supplier_id").cast("string")).alias("scenario"),
        (100 + F.col("supplier_id")).cast("int").alias("position"), "annual_cost_change")
    return dec.scenario_matrix(price.unionByName(switch, allowMissingColumns=True))


# --- signals ------------------------------------------------------------------

FACTORS = """select date, case when month(date) in (6,7,8) then 1.5 when month(date) in (12,1,2) then 1.8 else 1.0 end::double as weather,
   case strftime(date, '%m-%d') when '01-01' then 1.3 when '02-14' then 1.5 when '07-04' then 1.2 when '11-25' then 2.5 when '12-25' then 3.0 else 1.0 end::double as holiday,
   case when day(date) in (15, 30) then 1.3 else 1.0 end::double as payday, case when isodow(date) >= 6 then 1.5 else 1.0 end::double as weekend
  from (select distinct date from sales)"""


def _days(t):
    return t.sales().select("date").distinct()


for _key, _cols in (("SIG01", ["weather"]), ("SIG02", ["holiday"]), ("SIG03", ["payday", "weekend"])):
    def _bind(cols):
        def run(t):
            return _days(t).withColumns(dec.signal_factors(F.col("date"))).select("date", *cols)
        return run
    query(_key, f"select date, {', '.join(_cols)} from factors", "", {"factors": FACTORS})(_bind(_cols))


@query("SIG04", f"""select product_id, s.date, weather * holiday * payday * weekend as multiplier, cast(qty as double) as base,
   cast(trunc(qty * (weather * holiday * payday * weekend)) as int) as enriched
  from (select product_id, date, qty from part_daily where {window(90)}) s join factors f on s.date = f.date""", "multiplier", {"factors": FACTORS})
def sig04(t):
    daily = t.part_daily(t.days_before(90)).withColumn("base", F.col("qty").cast("double"))
    return dec.combined_signal(daily).select(
        "product_id", "date", "multiplier", "base",
        (F.col("qty") * F.col("multiplier")).cast("int").alias("enriched"))
