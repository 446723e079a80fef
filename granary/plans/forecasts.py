"""Series, segments and forecasts.

Part grain is sparse (about thirty selling days per part), brand grain is dense; both
cover every sales row.  Dense models run on brands, intermittent ones on parts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions.prefix import work_folder
from granary.sources.ingest import append_forecasts
from granary.operators import forecast as fc
from granary.operators import regression as reg
from granary.operators import series as ts
from granary.plans.dashboard import SCORED, _scored
from granary.plans.registry import query

NUM = """select *, row_number() over (partition by product_id order by date) - 1 as i, count(*) over (partition by product_id) as n from {src}"""
BN = NUM.format(src="brand_daily")
PN = NUM.format(src="part_daily")
SLOPE = "cast(count(*) * sum(i * qty) - sum(i) * sum(qty) as double) / nullif(cast(count(*) * sum(i * i) - sum(i) * sum(i) as double), 0)"
MEANQ = "cast(sum(qty) as double) / count(*)"
SDPOP = f"sqrt(greatest(0.0::double, cast(sum(qty * qty) as double) / count(*) - ({MEANQ}) * ({MEANQ})))"


@query("TSF01", "select product_id, date, qty from part_daily")
def tsf01(t):
    return t.part_days()


FILL = """select g.product_id, g.date, cast(coalesce(b.qty, 0) as bigint) as qty from (select product_id, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date
   from brand_daily group by product_id) g left join brand_daily b on g.product_id = b.product_id and g.date = b.date"""


@query("TSF02", "select * from filled", "", {"filled": FILL})
def tsf02(t):
    return ts.fill_days(t.brand_daily())


def week_sql(src):
    return f"""select g.product_id, g.date, cast(coalesce(s.qty, 0) as bigint) as qty, coalesce(s.n_days, 0) as n_days
      from (select product_id, cast(unnest(generate_series(date_trunc('week', min(date)), date_trunc('week', max(date)), interval 7 day)) as date) as date from {src} group by product_id) g
      left join (select product_id, cast(date_trunc('week', date) as date) as date, sum(qty) as qty, count(*) as n_days from {src} group by 1, 2) s on g.product_id = s.product_id and g.date = s.date"""


@query("TSF03", "select * from weeks", "", {"weeks": week_sql("brand_daily")})
def tsf03(t):
    return ts.weekly(t.brand_daily())


PERIODS = """with w as (select *, count(*) filter (where qty > 0) over p < 0.5 * count(*) over p and count(*) over p >= 8 as sparse, min(date) over p as d0 from pweeks window p as (partition by product_id))
  select product_id, date, qty, n_days, 'weekly' as grain from w where not sparse union all
  select product_id, d0 + cast(floor((date - d0) / 14) as int) * 14, cast(sum(qty) as bigint), cast(sum(n_days) as bigint), 'biweekly' from w where sparse group by 1, 2, d0"""
PW = {"pweeks": week_sql("part_daily"), "periods": PERIODS}


@query("TSF04", "select * from periods", "", PW)
def tsf04(t):
    return ts.model_periods(t.part_daily())


@query("TSF05")
def tsf05(t):
    return ts.winsorise(ts.model_periods(t.part_daily()))


DOW = """select p.product_id, cast(w.wd as int) as wd, case when p.total > 0 then coalesce(d.q, 0) / p.total::double else 1.0 / 7 end as weight
  from (select product_id, sum(qty) as total from part_daily group by product_id) p cross join (select unnest(generate_series(0, 6)) as wd) w
  left join (select product_id, isodow(date) - 1 as wd, sum(qty) as q from part_daily group by 1, 2) d on p.product_id = d.product_id and w.wd = d.wd"""


@query("TSF06", "select * from dow", "weight", {"dow": DOW})
def tsf06(t):
    return ts.weekday_weights(t.part_daily())


def decomp_sql(src: str, value: str, periods, extra: str = "") -> str:
    keep = "product_id, i, n" + extra
    parts = []
    for p in periods:
        h = p // 2
        total = f"sum({value}::double) over (partition by product_id order by i rows between {h} preceding and {h} following)"
        if p % 2 == 0:
            total = f"({total} - 0.5::double * (lag({value}::double, {h}) over (partition by product_id order by i) + lead({value}::double, {h}) over (partition by product_id order by i)))"
        parts.append(f"select {keep}, {value}::double as y, {p} as period, {h} as h, case when i >= {h} and i <= n - 1 - {h} then {total} / {p} end as ma from {src} where n >= {2 * p}")
    return f"""select {keep}, period, trend, ph - sum(ph / pc) over e / period as seasonal, off - (ph - sum(ph / pc) over e / period) as resid
 from (select *, avg(off) over f as ph, count(*) over f as pc from (select *, y - trend as off from (
  select *, case when i < h then i * hs + hi when i > n - 1 - h then i * tsl + ti else ma end as trend from (
   select *, regr_slope(case when i >= h and i < least(h + period, n - 1 - h) then ma end, i::double) over e as hs, regr_intercept(case when i >= h and i < least(h + period, n - 1 - h) then ma end, i::double) over e as hi,
     regr_slope(case when i >= greatest(h, n - 1 - h - period) and i < n - 1 - h then ma end, i::double) over e as tsl, regr_intercept(case when i >= greatest(h, n - 1 - h - period) and i < n - 1 - h then ma end, i::double) over e as ti
   from ({' union all '.join(parts)}) window e as (partition by product_id, period)))) window f as (partition by product_id, period, i % period)) window e as (partition by product_id, period)"""


STRENGTH = """select product_id, case when strength > 0 then period end as period, strength from (
  select *, row_number() over (partition by product_id order by round(strength, 9) desc, period) as rn from (
   select product_id, period, case when var_pop(seasonal) + var_pop(resid) > 0 then var_pop(seasonal) / (var_pop(seasonal) + var_pop(resid)) else 0.0 end as strength from parts group by product_id, period)) where rn = 1"""
SEG = f"""select *, case when n_rows < 14 then 'INSUFFICIENT_DATA' when zero_share > 0.25 then 'INTERMITTENT' when strength > 0.3 then (case when cv < 0.4 then 'SEASONAL_STABLE' else 'SEASONAL_VOLATILE' end)
    when cv > 0.6 then 'VOLATILE' when cv < 0.4 then (case when abs(slope) > 0.05 then 'STABLE_TRENDING' else 'STABLE_FLAT' end) else 'MODERATE' end as segment
  from (select g.*, coalesce(s.strength, 0.0) as strength, s.period, case when mean > 0 then sd / mean else 999.0 end as cv from (
    select product_id, count(*) as n_rows, {MEANQ} as mean, {SDPOP} as sd, count(*) filter (where qty = 0) / count(*)::double as zero_share, case when count(*) >= 7 then coalesce({SLOPE}, 0.0) else 0.0 end as slope
    from nums group by product_id) g left join strengths s on g.product_id = s.product_id)"""
SEG_CTES = {"nums": BN, "parts": decomp_sql("nums", "qty", ts.SEGMENT_PERIODS), "strengths": STRENGTH, "segs": SEG}


@query("TSF07", """select product_id, n_rows as "rows", mean, cv, zero_share, strength, slope, segment from segs""", "mean cv zero_share strength slope", SEG_CTES)
def tsf07(t):
    return ts.segments(t.brand_daily()).select("product_id", "rows", "mean", "cv", "zero_share", "strength", "slope", "segment")


@query("TSF07_parts", """select product_id, n_rows as "rows", cv, strength, segment from segs""", "cv strength", {**SEG_CTES, "nums": PN})
def tsf07_parts(t):
    return ts.segments(t.part_daily()).select("product_id", "rows", "cv", "strength", "segment")


@query("TSF08", "select * from strengths", "strength", SEG_CTES)
def tsf08(t):
    return ts.seasonality(ts.decompose(ts.numbered(t.brand_daily()), "qty", ts.SEGMENT_PERIODS))


@query("TSF09", f"""select product_id, n, slope, case when abs(slope) < 0.01 then 'flat' when slope > 0 then 'increasing' else 'decreasing' end as direction from (
  select product_id, count(*) as n, case when count(*) >= 7 then coalesce({SLOPE}, 0.0) else 0.0 end as slope from nums group by product_id)""", "slope", {"nums": PN})
def tsf09(t):
    return ts.trend_slope(ts.numbered(t.part_daily()))


@query("TSF10", """select product_id, date, qty, cast(isodow(date) - 1 as int) as day_of_week, cast(day(date) as int) as day_of_month, cast(month(date) as int) as month,
  cast(quarter(date) as int) as quarter, case when isodow(date) >= 6 then 1 else 0 end as is_weekend, cast(week(date) as int) as week_of_year from brand_daily""")
def tsf10(t):
    return ts.calendar_features(t.brand_daily())


@query("TSF11")
def tsf11(t):
    return fc.feature_selection(t.brand_daily())


def _solved(m: int) -> dict[str, str]:
    """CTEs that solve the normal equations ``eq`` (a{i}_{j}, the right side is column m) by elimination; zero pivots give 0."""
    out, src = {}, "eq"
    for k in range(m):
        columns, pivot = ["product_id"], f"a{k}_{k} > 1e-9 * d{k}"
        for i in range(m):
            for j in range(m + 1):
                new = f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k}" if i != k else f"a{k}_{j} / a{k}_{k}"
                columns.append(f"case when {pivot} then {new} else {f'a{i}_{j}' if i != k else '0.0::double'} end as a{i}_{j}")
        out[f"step{k}"] = f"select {', '.join(columns)}, {', '.join(f'd{i}' for i in range(m))} from {src}"
        src = f"step{k}"
    return out


FOUR = ("isodow(date) - 1", "day(date)", "month(date)", "case when isodow(date) >= 6 then 1 else 0 end")
XY = f"select product_id, i, n, k, qty, {', '.join(f'({x})::bigint as x{j}' for j, x in enumerate(FOUR))} from (select *, floor(n * 0.8) as k from series)"
EQ = "select product_id, " + ", ".join(
    [f"(count(*) * sum(x{i} * {f'x{j}' if j < 4 else 'qty'}) - sum(x{i}) * sum({f'x{j}' if j < 4 else 'qty'}))::double as a{i}_{j}" for i in range(4) for j in range(5)]
    + [f"(count(*) * sum(x{i} * x{i}) - sum(x{i}) * sum(x{i}))::double as d{i}" for i in range(4)]) + " from xy where i < k group by product_id"
BLEND = f"""with m as (select product_id, avg(qty) as my, {', '.join(f'avg(x{j}) as m{j}' for j in range(4))} from xy where i < k group by product_id),
   l as (select product_id, sum(qty * pow(0.7::double, k - 1 - i) * case when i = 0 then 1.0::double else 0.3::double end) as level from xy where i < k group by product_id),
   g as (select xy.product_id, max(n) as n, count(*) as held, avg(abs(qty - level)) as m1,
     avg(abs(qty - my - ({' + '.join(f'a{j}_4 * (x{j} - m{j})' for j in range(4))}))) as m2
     from xy join m on m.product_id = xy.product_id join l on l.product_id = xy.product_id join step3 s on s.product_id = xy.product_id where i >= k group by xy.product_id),
   w as (select *, case when n < 30 or held < 5 then 0.7 else greatest(0.2, least(0.8, (1.0 / (m1 + 1)) / (1.0 / (m1 + 1) + 1.0 / (m2 + 1)))) end as wt from g)
  select product_id, m1 as series_mae, m2 as calendar_mae, wt as series_weight, 1.0 - wt as calendar_weight from w"""


def _blend_ctes(series: str) -> dict[str, str]:
    return {"series": series, "xy": XY, "eq": EQ, **_solved(4)}


def _blend(series):
    """Smoothing and calendar regression, both fitted on the first four fifths of the rows."""
    s = ts.numbered(series).withColumn("k", F.floor(F.col("n") * 0.8))
    coefs = reg.calendar_fit(s, rows=F.col("i") < F.col("k"))
    level = ts.smoothed_level(s.filter("i < k").select("product_id", "date", "qty")).select("product_id", F.col("level").alias("series_pred"))
    held = ts.calendar_features(s.filter("i >= k")).join(coefs, "product_id").join(level, "product_id")
    return fc.ensemble_weights(held.withColumn("calendar_pred", reg.calendar_value()))


@query("TSF12", BLEND, "series_mae calendar_mae series_weight calendar_weight", _blend_ctes(BN))
def tsf12(t):
    return _blend(t.brand_daily())


@query("TSF12_parts", BLEND, "series_mae calendar_mae series_weight calendar_weight", _blend_ctes(PN))
def tsf12_parts(t):
    return _blend(t.part_daily())


def with_meta(products):
    v = F.col("demand_volatility")
    return products.withColumns({
        "xyz_class": F.when(v <= 0.3, "X").when(v <= 0.5, "Y").otherwise("Z"),
        "inventory_turnover": F.col("average_daily_demand") * 365 / (F.col("current_stock") + 1)})


BASELINE = """select product_id, cast(step as int) as step, date, p as forecast, greatest(0.0::double, p * (1.0::double - 0.3::double * (1.0::double + vol))) as lower, p * (1.0::double + 0.3::double * (1.0::double + vol)) as upper
 from (select *, base * list_extract([1.05::double, 1.02::double, 1.0::double, 0.98::double, 1.08::double, 1.1::double, 0.77::double], isodow(date)) as p
 from (select *, (select d from clock) + cast(step - 1 as int) as date from (
  select product_id, (case when average_daily_demand > 0 then average_daily_demand when unit_price > 0 and current_stock > 0 then greatest(1.0::double, current_stock / (lead * 3))
     when coalesce(reorder_point, 0) > 0 then greatest(1.0::double, reorder_point / greatest(lead, 7)) else 1.0::double end) * (case when coalesce(seasonality_factor, 0) = 0 then 1.0::double else seasonality_factor end) as base,
    case when coalesce(demand_volatility, 0) = 0 then 0.3::double else demand_volatility end as vol, unnest(generate_series(1, 14)) as step
   from (select *, case when coalesce(lead_time_days, 0) = 0 then 7 else lead_time_days end as lead from products))))"""
ADJUST = """with m as (select b.*, seasonality_factor as s, demand_volatility as v, case when demand_volatility <= 0.3 then 'X' when demand_volatility <= 0.5 then 'Y' else 'Z' end as xyz,
     average_daily_demand as d, average_daily_demand * 365 / (current_stock + 1) as t from baseline b join products p on b.product_id = p.product_id),
   a as (select *, forecast * coalesce(s, 1.0) as f0, lower * coalesce(s, 1.0) as l0, upper * coalesce(s, 1.0) as u0,
     (1.0 + (coalesce(v, 0.5) - 0.5) * 0.5) * (case xyz when 'Z' then 1.4 when 'X' then 0.8 else 1.0 end) as stretch from m),
   b as (select *, avg(f0) over (partition by product_id) as mean from a),
   c as (select *, case when d > 0 and abs(mean - d) / d > 0.5 then (d - mean) * 0.3 else 0.0 end as shift from b),
   e as (select *, f0 + shift as f1, (u0 + l0) / 2 - (u0 - l0) / 2 * stretch + shift as l1, (u0 + l0) / 2 + (u0 - l0) / 2 * stretch + shift as u1 from c)
  select product_id, step, greatest(0.0, case when t > 12 then f1 + (f1 - coalesce(lag(f1) over (partition by product_id order by step), f1)) * 0.15
     when t > 0 and t < 4 then f1 * 0.7 + avg(f1) over (partition by product_id) * 0.3 else f1 end) as forecast, greatest(0.0, l1) as lower, greatest(0.0, u1) as upper from e"""


@query("TSF13", "select * from adjusted", "forecast lower upper", {"baseline": BASELINE, "adjusted": ADJUST})
def tsf13(t):
    return fc.adjust(fc.baseline(t.products, t.as_of, 14), with_meta(t.products))


@query("TSF14", """select product_id, sum(qty * pow(0.7::double, n - 1 - i) * case when i = 0 then 1.0::double else 0.3::double end) as level, max(n) as n from nums group by product_id""", "level", {"nums": PN})
def tsf14(t):
    return ts.smoothed_level(t.part_daily())


HOLT = """select product_id, 0 as i, qty::double as level, coalesce((select b.qty from nums b where b.product_id = a.product_id and b.i = 1) - qty, 0)::double as trend, n from nums a where i = 0
  union all select h.product_id, s.i, 0.3::double * s.qty + 0.7::double * (h.level + h.trend),
    0.3::double * ((0.3::double * s.qty + 0.7::double * (h.level + h.trend)) - h.level) + 0.7::double * h.trend, h.n from holt h join nums s on s.product_id = h.product_id and s.i = h.i + 1"""


@query("TSF15", """select product_id, case when n >= 2 then level + trend else level end as holt, cast(n as int) as n from holt where i = n - 1""", "holt", {"nums": PN, "holt": HOLT})
def tsf15(t):
    return ts.holt_level(t.part_daily())


LINE = f"""select product_id, n, slope, cast(sy as double) / n - slope * sx / n as intercept from (select product_id, max(n) as n, coalesce({SLOPE}, 0.0) as slope, sum(qty) as sy, sum(i) as sx from nums group by product_id)"""


@query("TSF16", "select * from line", "slope intercept", {"nums": PN, "line": LINE})
def tsf16(t):
    return ts.line_fit(t.part_daily())


TRAIL = """select *, qty - trend - seasonal as resid from (select product_id, date, qty, i, n, trend, case when n < 14 then 0.0 else ph - sum(ph / pc) over (partition by product_id) / 7 end as seasonal
  from (select *, avg(off) over (partition by product_id, i % 7) as ph, count(*) over (partition by product_id, i % 7) as pc from (select *, qty - trend as off from (
   select *, case when n < 14 then qty::double else cast(sum(qty) over f as double) / count(*) over f end as trend from nums window f as (partition by product_id order by i rows 6 preceding)))))"""


@query("TSF17", "select product_id, date, qty, trend, seasonal, resid from trail", "trend seasonal resid", {"nums": PN, "trail": TRAIL})
def tsf17(t):
    return ts.trailing_decomposition(t.part_daily()).select("product_id", "date", "qty", "trend", "seasonal", "resid")


@query("TSF18", """select product_id, coalesce(avg(abs((actual - predicted_demand) / actual)) * 100, 100.0) as mape, sqrt(avg((actual - predicted_demand) * (actual - predicted_demand))) as rmse,
  avg(abs(actual - predicted_demand)) as mae, avg(abs((actual - predicted_demand) / (actual + 1))) * 100 as mape_plus_one from scored group by product_id""", "mape rmse mae mape_plus_one", {"scored": SCORED})
def tsf18(t):
    return fc.accuracy_metrics(_scored(t).withColumnRenamed("predicted_demand", "predicted"))


# One recursive pass gives both smoothers per row; the rest are windows.
SMOOTH = """select product_id, 0 as i, qty::double as es, qty::double as level, coalesce((select b.qty from nums b where b.product_id = a.product_id and b.i = 1) - qty, 0)::double as trend, qty::double as holt_fit from nums a where i = 0
  union all select h.product_id, s.i, 0.3::double * s.qty + 0.7::double * h.es, 0.3::double * s.qty + 0.7::double * (h.level + h.trend),
    0.3::double * ((0.3::double * s.qty + 0.7::double * (h.level + h.trend)) - h.level) + 0.7::double * h.trend,
    (0.3::double * s.qty + 0.7::double * (h.level + h.trend)) + (0.3::double * ((0.3::double * s.qty + 0.7::double * (h.level + h.trend)) - h.level) + 0.7::double * h.trend)
   from smooth h join nums s on s.product_id = h.product_id and s.i = h.i + 1"""
MODELS = """with s as (select n.*, floor(n.n * 0.8) as k, m.holt_fit, p.es as es_prev, cast(sum(qty) over (partition by n.product_id order by n.i rows between current row and unbounded following) as double) as rest,
     list(qty) over (partition by n.product_id order by n.i rows 6 preceding) as l from nums n join smooth m on n.product_id = m.product_id and n.i = m.i
     left join smooth p on n.product_id = p.product_id and n.i = p.i + 1 where n.n >= 14),
   t as (select *, (select max(b.rest) from s b where b.product_id = a.product_id and b.i = a.n - 7) / 7 as ma7,
     case when k < 7 then qty::double else (select cast(sum(x * w) as double) / sum(w) from (select unnest(l) as x, unnest(generate_series(1, len(l))) as w)) end as wma from s a),
   fit as (select product_id, max(n) as nt, cast(count(*) * sum(i * qty) - sum(i) * sum(qty) as double) / nullif(cast(count(*) * sum(i * i) - sum(i) * sum(i) as double), 0) as b, avg(qty) as my, avg(i) as mx, count(*) as cnt from t where i < k group by product_id),
   u as (select t.product_id, t.i, t.qty, 'exponential_smoothing' as model, es_prev as p from t where i >= k
     union all select product_id, i, qty, 'double_exponential_smoothing', holt_fit from t where i < k
     union all select product_id, i, qty, 'moving_average', ma7 from t where i >= k
     union all select product_id, i, qty, 'weighted_moving_average', wma from t where i < k
     union all select t.product_id, i, qty, 'linear_regression', my - coalesce(b, 0) * mx + coalesce(b, 0) * i from t join fit f on t.product_id = f.product_id where i < k
     union all select product_id, i, qty, 'seasonal_decomposition', trend + seasonal from trail where n >= 14),
   g as (select product_id, model, coalesce(avg(abs((qty - p) / qty)) * 100, 100.0) as mape, sqrt(avg((qty - p) * (qty - p))) as rmse, arg_max(p, i) as last from u group by product_id, model)
  select g.product_id, mape, case when model = 'seasonal_decomposition' then 0.0 else rmse end as rmse,
    case when model = 'linear_regression' then greatest(0.0, my - coalesce(b, 0) * mx + coalesce(b, 0) * cnt) when model = 'seasonal_decomposition' then greatest(0.0, last) else last end as last, model
   from g join fit f on g.product_id = f.product_id"""
MODEL_CTES = {"nums": PN, "smooth": SMOOTH, "trail": TRAIL, "models": MODELS}


@query("TSF19", "select * from models", "mape rmse last", MODEL_CTES)
def tsf19(t):
    return fc.compare_models(t.part_daily())


PICK = """select product_id, arg_min(model, rn) as best_model, arg_min(mape, rn) as best_mape, sum(last) / 3 as ensemble,
   case when arg_min(mape, rn) < 15 then 'high' when arg_min(mape, rn) < 30 then 'medium' else 'low' end as confidence
  from (select *, row_number() over (partition by product_id order by round(mape, 6), model) as rn from models) where rn <= 3 group by product_id"""


@query("WIN15", "select * from picked", "best_mape ensemble", {**MODEL_CTES, "picked": PICK})
def win15(t):
    return fc.pick_models(fc.compare_models(t.part_daily()))


GAINS = """select p.product_id, best_model, best_mape, m.mape as naive_mape, annual_revenue, greatest(0.0, (m.mape - best_mape) / greatest(m.mape, 1e-6)) as error_reduction,
   annual_revenue * (m.mape - best_mape) / 100.0 * (case when unit_price > 0 then greatest(0.0, unit_price - unit_cost) / unit_price else 0.3 end) as margin_saved
  from picked p join models m on p.product_id = m.product_id and m.model = 'moving_average' join products c on p.product_id = c.product_id
  join (select product_id, cast(sum(revenue) as double) / (max(date) - min(date) + 1) * 365 as annual_revenue from sales group by product_id) r on p.product_id = r.product_id"""


def _gains(t, scores):
    span = F.datediff(F.max("date"), F.min("date")) + 1
    revenue = t.sales().groupBy("product_id").agg((F.sum("revenue").cast("double") / span * 365).alias("annual_revenue"))
    df = fc.pick_models(scores, beside="moving_average").join(
        t.products.select("product_id", "unit_price", "unit_cost"), "product_id").join(revenue, "product_id")
    gain = F.col("naive_mape") - F.col("best_mape")
    price = F.col("unit_price")
    share = F.when(price > 0, F.greatest(F.lit(0.0), price - F.col("unit_cost")) / price).otherwise(0.3)
    return df.select("product_id", "best_model", "best_mape", "naive_mape", "annual_revenue",
                     F.greatest(F.lit(0.0), gain / F.greatest(F.col("naive_mape"), F.lit(1e-6))).alias("error_reduction"),
                     (F.col("annual_revenue") * gain / 100.0 * share).alias("margin_saved"))


@query("TSF20", GAINS,
       "best_mape naive_mape annual_revenue error_reduction margin_saved", {**MODEL_CTES, "picked": PICK})
def tsf20(t):
    return _gains(t, fc.compare_models(t.part_daily()))


ROLLING = """with cuts as (select product_id, n, c::bigint as c, coalesce(lead(c) over (partition by product_id order by c), n)::bigint as e
     from (select distinct product_id, n, floor(n * share) as c from nums, (select unnest([0.6::double, 0.7::double, 0.8::double, 0.9::double]) as share) where n >= 14)),
   before as (select k.product_id, k.c, k.e, sum(qty * pow(0.7::double, c - 1 - i) * case when i = 0 then 1.0::double else 0.3::double end) as es,
       sum(case when i >= c - 7 then qty end) / 7.0::double as ma, sum(case when i >= c - 7 then qty * (i - c + 8) end) / 28.0::double as wma,
       regr_slope(qty, i) as b, regr_intercept(qty, i) as a
     from cuts k join nums s on s.product_id = k.product_id and s.i < k.c group by k.product_id, k.c, k.e),
   avg7 as (select product_id, i, avg(qty) over (partition by product_id order by i rows between 6 preceding and current row) as mean, qty from nums),
   phases as (select k.product_id, k.c, i % 7 as ph, avg(qty - mean) as m from cuts k join avg7 s on s.product_id = k.product_id and s.i < k.c group by k.product_id, k.c, i % 7),
   season as (select *, m - avg(m) over (partition by product_id, c) as s from phases),
   p as (select s.product_id, s.i, s.qty, unnest([
       {'m': 'exponential_smoothing', 'p': b.es}, {'m': 'double_exponential_smoothing', 'p': h.level + h.trend * (s.i - b.c + 1)},
       {'m': 'moving_average', 'p': ma}, {'m': 'weighted_moving_average', 'p': wma},
       {'m': 'linear_regression', 'p': greatest(0.0::double, a + b.b * s.i)}, {'m': 'seasonal_decomposition', 'p': greatest(0.0::double, t.mean + z.s)}]) as x
     from before b join nums s on s.product_id = b.product_id and s.i >= b.c and s.i < b.e join smooth h on h.product_id = b.product_id and h.i = b.c - 1
     join avg7 t on t.product_id = b.product_id and t.i = b.c - 1 join season z on z.product_id = b.product_id and z.c = b.c and z.ph = s.i % 7)
  select product_id, coalesce(avg(abs((qty - x.p) / nullif(qty, 0))) * 100, 100.0::double) as mape, sqrt(avg((qty - x.p) * (qty - x.p))) as rmse,
    arg_max(x.p, i) as last, x.m as model from p group by product_id, x.m"""
ROLLING_CTES = {"nums": PN, "smooth": SMOOTH, "models": ROLLING}


def _rolling(t):
    return fc.compare_models(t.part_daily(), scoring="holdout")


@query("TSF19_holdout", "select * from models", "mape rmse last", ROLLING_CTES)
def tsf19_holdout(t):
    return _rolling(t)


@query("WIN15_holdout", "select * from picked", "best_mape ensemble", {**ROLLING_CTES, "picked": PICK})
def win15_holdout(t):
    return fc.pick_models(_rolling(t))


@query("TSF20_holdout", GAINS, "best_mape naive_mape annual_revenue error_reduction margin_saved", {**ROLLING_CTES, "picked": PICK})
def tsf20_holdout(t):
    return _gains(t, _rolling(t))


@query("TSF21")
def tsf21(t):
    return fc.forecast_products(t.part_daily(), 28)


def _brand_periods(t):
    return ts.winsorise(ts.model_periods(t.brand_daily())).withColumn("horizon", F.lit(8))


@query("TSF22")
def tsf22(t):
    return fc.fit_holt_winters(_brand_periods(t))


NAIVE = """select product_id, cast(step as int) as step, greatest(0.0, qty::double) as forecast, greatest(0.0, qty - 1.5 * sd * (1 + 0.05 * (step - 1))) as lower, greatest(0.0, qty::double) + 1.5 * sd * (1 + 0.05 * (step - 1)) as upper,
   'seasonal_naive:' || cycle as model
 from (select *, unnest(list_filter(generate_series(1, 6), lambda k: (k - 1) % cycle = slot)) as step from (select *, i - (n - cycle) as slot,
   sqrt(greatest(0.0, cast(sum(qty * qty) over p as double) / count(*) over p - (cast(sum(qty) over p as double) / count(*) over p) * (cast(sum(qty) over p as double) / count(*) over p))) as sd
  from (select *, case when n >= 52 then 52 when n >= 26 then 13 when n >= 8 then 4 else n end as cycle from wnums) where i >= n - cycle window p as (partition by product_id)))"""
NAIVE_CTES = {"pweeks": week_sql("part_daily"), "wnums": NUM.format(src="pweeks"), "naive": NAIVE}


@query("TSF22_parts")
def tsf22_parts(t):
    return fc.fit_holt_winters(ts.winsorise(ts.model_periods(t.part_daily())).withColumn("horizon", F.lit(8)))


@query("TSF23", "select * from naive", "forecast lower upper", NAIVE_CTES)
def tsf23(t):
    return fc.seasonal_naive(ts.weekly(t.part_daily()), 6)


DECF = """select product_id, cast(step as int) as step, f as forecast, greatest(0.0, f - 1.96 * sd * (1 + 0.03 * (step - 1))) as lower, f + 1.96 * sd * (1 + 0.03 * (step - 1)) as upper, 'decomposition:' || period as model
 from (select g.product_id, g.period, sd, step, greatest(0.0, a + b * (g.n + step - 1) + c.seasonal) as f from (select product_id, period, max(n) as n, regr_slope(trend, i::double) as b, regr_intercept(trend, i::double) as a, stddev_pop(resid) as sd from dparts group by product_id, period) g,
   (select unnest(generate_series(1, 8)) as step) s join dparts c on c.product_id = g.product_id and c.i = g.n - g.period + (step - 1) % g.period)"""


@query("TSF24", "select * from decf", "forecast lower upper",
       {"bweeks": week_sql("brand_daily"), "bnums": NUM.format(src="bweeks"), "dparts": decomp_sql("bnums", "qty", (13,)), "decf": DECF})
def tsf24(t):
    weeks = ts.weekly(t.brand_daily()).withColumn("grain", F.lit("weekly")).withColumn("smooth", F.col("qty").cast("double"))
    return fc.decomposition_forecast(weeks, 8)


@query("TSF25")
def tsf25(t):
    return fc.boosted_forecast(ts.weekly(t.brand_daily()))


@query("TSF26", f"""with s as (select product_id, qty, row_number() over w as k, count(*) over (partition by product_id) as m, date - lag(date) over w as gap from part_daily where qty > 0 window w as (partition by product_id order by date)),
   g as (select product_id, count(*) as sales, sum(case when k >= 2 then pow(0.9::double, m - k) * (case when k = 2 then 1.0::double else 0.1::double end) * qty end) as size,
     sum(case when k >= 2 then pow(0.9::double, m - k) * (case when k = 2 then 1.0::double else 0.1::double end) * gap end) as "interval", {MEANQ} as mp, {SDPOP} as sd from s group by product_id),
   r as (select *, case when sales < 2 then mp when "interval" > 0 then size / "interval" else 0.0 end as rate from g)
  select product_id, sales, size, "interval", rate, greatest(0.0, rate - 1.96 * sd) as lower, rate + 1.96 * sd as upper from r""", "size interval rate lower upper")
def tsf26(t):
    return ts.croston(t.part_daily())


@query("TSF27")
def tsf27(t):
    periods = _brand_periods(t)
    return fc.enrich(fc.fit_holt_winters(periods), periods.select("product_id", "date", "qty", "grain"))


@query("TSF28", """select n.product_id, cast(day as int) as day, last + cast(day as int) as date, forecast * weight as forecast, lower * weight as lower, upper * weight as upper, model
  from (select *, unnest(generate_series((step - 1) * 7 + 1, case when step = 6 then 45 else step * 7 end)) as day from naive) n
  join (select product_id, max(date) as last from part_daily group by product_id) l on n.product_id = l.product_id
  join dow d on d.product_id = n.product_id and d.wd = isodow(last + cast(day as int)) - 1""", "forecast lower upper", {**NAIVE_CTES, "dow": DOW})
def tsf28(t):
    daily = t.part_daily()
    last = daily.groupBy("product_id").agg(F.max("date").alias("last")).withColumn("period_days", F.lit(7))
    return fc.to_days(fc.seasonal_naive(ts.weekly(daily), 6), last, ts.weekday_weights(daily), 45)


FALL = """with r as (select *, row_number() over (partition by product_id order by date desc) as rn from part_daily),
   g as (select product_id, max(date) as last, count(*) as n, sum(qty) as s, sum(qty * qty) as ss, cast(sum(qty) filter (where rn <= 28) as double) / greatest(1, max(date) - min(date) filter (where rn <= 28) + 1) as mean from r group by product_id),
   h as (select *, case when n > 1 then sqrt(greatest(0.0, (cast(ss as double) - cast(s as double) * cast(s as double) / n) / (n - 1))) else mean * 0.5 end as sd, unnest(generate_series(1, 28)) as step from g),
   f as (select h.product_id, cast(step as int) as step, last + cast(step as int) as date, greatest(0.0, mean * weight * 7) as forecast, sd from h join dow d on d.product_id = h.product_id and d.wd = isodow(last + cast(step as int)) - 1)
  select product_id, step, date, forecast, greatest(0.0, forecast - 1.5 * sd) as lower, forecast + 1.5 * sd as upper from f"""
FALL_CTES = {"dow": DOW, "fall": FALL}


def _fallback(t):
    daily = t.part_daily()
    return fc.fallback(daily, ts.weekday_weights(daily), 28)


@query("TSF29", "select * from fall", "forecast lower upper", FALL_CTES)
def tsf29(t):
    return _fallback(t)


RUNS = "(select unnest([date '2001-11-03', date '2001-11-04']) as run_date) runs"


@query("SNK01", f"select b.*, run_date from baseline b, {RUNS}", "forecast lower upper", {"baseline": BASELINE})
def snk01(t):
    """Two runs are appended, the second of them twice; the retry replaces its own partition."""
    path = work_folder(t.spark, "forecasts")
    for day in (3, 4, 4):
        append_forecasts(tsf30(t), path, dt.date(2001, 11, day))
    return t.spark.read.parquet(path)


@query("TSF30", "select * from baseline", "forecast lower upper", {"baseline": BASELINE})
def tsf30(t):
    return fc.baseline(t.products, t.as_of, 14)


@query("TSF31")
def tsf31(t):
    return fc.auto_forecast(ts.fill_days(t.brand_daily()), 30)


@query("TSF31_parts")
def tsf31_parts(t):
    return fc.auto_forecast(t.part_daily(), 30)


@query("TSF32")
def tsf32(t):
    return fc.seasonal_days(ts.fill_days(t.brand_daily()), 30)


@query("TSF32_parts")
def tsf32_parts(t):
    """Selling days as they are; a part sells on about thirty days in seven years."""
    return fc.seasonal_days(t.part_daily(), 30)


@query("TSF33")
def tsf33(t):
    return fc.forecast_products(t.brand_daily(), 30)


@query("TSF34")
def tsf34(t):
    return fc.backtest(t.part_daily())


@query("TSF37")
def tsf37(t):
    return fc.weekly_view(fc.forecast_products(t.brand_daily(), 30))


@query("TSF38", """select product_id, avg(forecast) as avg_daily, min(forecast) as min_daily, max(forecast) as max_daily, sum(forecast) as total, sum(lower) as total_lower, sum(upper) as total_upper from fall group by product_id""",
       "avg_daily min_daily max_daily total total_lower total_upper", FALL_CTES)
def tsf38(t):
    return fc.horizon_summary(_fallback(t))


@query("TSF39", """select p.product_id, current_stock, total, case when total / 28 > 0 then current_stock / (total / 28) end as coverage_days, greatest(0.0, total - current_stock) as shortage
  from products p join (select product_id, sum(forecast) as total from fall group by product_id) f on p.product_id = f.product_id""", "total coverage_days shortage", FALL_CTES)
def tsf39(t):
    return fc.coverage(t.products, _fallback(t), 28)


@query("TSF40", """select product_id, forecast_date as date, 'forecast' as kind, predicted_demand as "value" from forecasts where forecast_date >= (select d from clock) - 30
  union all select product_id, date, 'history', quantity_sold::double from (select *, row_number() over (partition by product_id order by date desc, id desc, quantity_sold desc) as rn from sales) where rn <= 90""", "value")
def tsf40(t):
    from granary.operators.inventory import recent_rows

    ahead = t.forecasts.filter(F.col("forecast_date") >= F.lit(t.days_before(30))).select(
        "product_id", F.col("forecast_date").alias("date"), F.lit("forecast").alias("kind"), F.col("predicted_demand").alias("value"))
    past = recent_rows(t.sales(), 90).select(
        "product_id", "date", F.lit("history").alias("kind"), F.col("quantity_sold").cast("double").alias("value"))
    return ahead.unionByName(past)


@query("TSF41")
def tsf41(t):
    return fc.first_generation(t.brand_daily(), 14)


@query("AGG21")
def agg21(t):
    return fc.forecast_products(t.part_daily(), 28).select("product_id", "segment", "model").distinct().groupBy(
        "segment", F.split("model", ":")[0].alias("model_used")).agg(F.count(F.lit(1)).alias("products"))
