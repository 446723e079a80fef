"""Forecasts for every product at once.

Models that are sums or joins (seasonal naive, decomposition, fallback, baseline) are
Spark plans.  The Holt-Winters recursion runs on matrices of series (``holtwinters``).
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.layout import by_key
from granary.functions.mathx import ratio, t_passes
from granary.functions.prefix import materialise
from granary.operators import batched as bt
from granary.operators import holtwinters as hw
from granary.operators import regression as reg
from granary.operators import series as ts

KEY = "product_id"
FORECAST = "product_id {key}, step int, forecast double, lower double, upper double, model string"


def steps_ahead(df: DataFrame, horizon: Column | int) -> DataFrame:
    h = horizon if isinstance(horizon, Column) else F.lit(horizon)
    return df.withColumn("step", F.explode(F.sequence(F.lit(1), h)))


# ---- Holt-Winters -------------------------------------------------------------

def holt_winters(y: np.ndarray, horizon: int, period: int, seasonal: str = "add", damp: float = 1.0):
    """Best of a parameter grid; the grid runs as one vector through the recursion.

    Returns (AIC, forecast, residual deviation).  ``period`` 0 means no season.
    """
    a, b, g = (v.ravel() for v in np.meshgrid(
        [0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9], [0.01, 0.05, 0.1, 0.3], [0.05, 0.1, 0.3, 0.6] if period else [0.0]))
    n, m = len(y), period
    mul = seasonal == "mul"
    if m:
        level = np.full(len(a), y[:m].mean())
        second = y[m:2 * m].mean() if n >= 2 * m else y.mean()
        trend = np.full(len(a), (second - y[:m].mean()) / m)
        season = [np.full(len(a), v / max(level[0], 1e-9) if mul else v - level[0]) for v in y[:m]]
    else:
        level, trend, season = np.full(len(a), y[0]), np.full(len(a), y[1] - y[0]), []
    sse, fits = np.zeros(len(a)), []
    for t in range(n):
        s = season[t % m] if m else (1.0 if mul else 0.0)
        base = level + damp * trend
        fit = base * s if mul else base + s
        fits.append(fit)
        sse += (y[t] - fit) ** 2
        core = (y[t] / np.where(np.abs(s) < 1e-9, 1e-9, s)) if mul else y[t] - s
        new = a * core + (1 - a) * base
        trend = b * (new - level) + (1 - b) * damp * trend
        if m:
            own = (y[t] / np.where(np.abs(new) < 1e-9, 1e-9, new)) if mul else y[t] - new
            season[t % m] = g * own + (1 - g) * s
        level = new
    k = int(np.nanargmin(sse))
    aic = n * np.log(max(sse[k] / n, 1e-12)) + 2 * (3 + m + (damp < 1))
    powers = np.cumsum(damp ** np.arange(1, horizon + 1))
    ahead = level[k] + powers * trend[k]
    if m:
        tail = np.array([season[(n + j) % m][k] for j in range(horizon)])
        ahead = ahead * tail if mul else ahead + tail
    resid = y - np.array([f[k] for f in fits])
    return aic, ahead, float(resid.std())


def fit_holt_winters(periods: DataFrame) -> DataFrame:
    """``periods`` has product_id, date, smooth, grain, horizon; a series is a calendar of periods."""
    return hw.forecast_all(periods, KEY, "smooth", hw.best_of, lambda k: 1.96 * (1 + 0.02 * k), "holt_winters:")


# ---- seasonal naive and decomposition ------------------------------------------

def cycle_length(n: Column) -> Column:
    return F.when(n >= 52, 52).when(n >= 26, 13).when(n >= 8, 4).otherwise(n).cast("int")


def seasonal_naive(periods: DataFrame, horizon: Column | int) -> DataFrame:
    """Repeat the last cycle: horizon steps meet history rows by position in the cycle."""
    s = ts.numbered(periods.select(KEY, "date", "qty"))
    s = s.withColumn("cycle", cycle_length(F.col("n"))).filter(F.col("i") >= F.col("n") - F.col("cycle"))
    q = F.col("qty").cast("bigint")
    w = Window.partitionBy(KEY)
    n, tot, sq = F.count(F.lit(1)).over(w), F.sum(q).over(w), F.sum(q * q).over(w)
    s = s.withColumns({
        "slot": (F.col("i") - (F.col("n") - F.col("cycle"))).cast("int"),
        "sd": F.sqrt(F.greatest(F.lit(0.0), sq.cast("double") / n - (tot.cast("double") / n) * (tot.cast("double") / n)))})
    h = horizon if isinstance(horizon, Column) else F.lit(horizon)
    # Steps slot+1, slot+1+cycle, ... up to the horizon.
    reps = F.filter(F.sequence(F.lit(1), h), lambda k: (k - 1) % F.col("cycle") == F.col("slot"))
    s = s.withColumn("step", F.explode(reps))
    mean = F.greatest(F.lit(0.0), F.col("qty").cast("double"))
    band = 1.5 * F.col("sd") * (1 + 0.05 * (F.col("step") - 1))
    return s.select(KEY, "step", mean.alias("forecast"), F.greatest(F.lit(0.0), mean - band).alias("lower"),
                    (mean + band).alias("upper"), F.concat(F.lit("seasonal_naive:"), F.col("cycle").cast("string")).alias("model"))


def decomposition_forecast(periods: DataFrame, horizon: int | Column) -> DataFrame:
    """Line through the extended trend plus the last seasonal cycle.

    ``periods`` has product_id, date, smooth, grain; products too short for two seasons drop out.
    """
    s = ts.numbered(periods.select(KEY, "date", "smooth", "grain"))
    n = F.col("n")
    season = F.when(F.col("grain") == "biweekly", F.when(n >= 12, 6).when(n >= 6, 3)) \
        .otherwise(F.when(n >= 26, 13).when(n >= 8, 4))
    lengths = (3, 4, 6, 13)
    parts = ts.decompose(s.withColumn("want", season), "smooth", lengths, {p: F.col("want") == p for p in lengths})
    x = F.col("i").cast("double")
    g = parts.groupBy(KEY).agg(
        F.max("n").alias("n"), F.max("period").alias("period"), F.regr_slope("trend", x).alias("b"),
        F.regr_intercept("trend", x).alias("a"), F.stddev_pop("resid").alias("sd"),
        # At most 13 values: the last cycle in order.
        F.array_sort(F.collect_list(F.when(
            F.col("i") >= n - F.col("period"), F.struct("i", "seasonal")))).alias("cycle"))
    g = steps_ahead(g, horizon)
    k = F.col("step") - 1
    season_value = F.get("cycle", (k % F.col("period")).cast("int"))["seasonal"]
    mean = F.greatest(F.lit(0.0), F.col("a") + F.col("b") * (F.col("n") + k) + season_value)
    band = 1.96 * F.col("sd") * (1 + 0.03 * k)
    return g.select(KEY, "step", mean.alias("forecast"), F.greatest(F.lit(0.0), mean - band).alias("lower"),
                    (mean + band).alias("upper"),
                    F.concat(F.lit("decomposition:"), F.col("period").cast("string")).alias("model"))


def fallback(daily: DataFrame, weights: DataFrame, horizon: int) -> DataFrame:
    """Average of the last 28 selling rows spread by weekday, with a 1.5-deviation band."""
    newest = Window.partitionBy(KEY).orderBy(F.col("date").desc())
    q = F.col("qty").cast("bigint")
    ranked = daily.withColumn("rn", F.row_number().over(newest))
    n, tot, sq = F.count(F.lit(1)), F.sum(q), F.sum(q * q)
    recent = F.col("rn") <= 28
    g = ranked.groupBy(KEY).agg(
        F.max("date").alias("last"), n.alias("n"), tot.alias("s"), sq.alias("ss"),
        F.sum(F.when(recent, q)).alias("rs"), F.min(F.when(recent, F.col("date"))).alias("rfirst"))
    mean = F.col("rs").cast("double") / F.greatest(F.lit(1), F.datediff("last", "rfirst") + 1)
    t = F.col("s").cast("double")
    sd = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("ss").cast("double") - t * t / F.col("n")) / (F.col("n") - 1)))).otherwise(mean * 0.5)
    g = steps_ahead(g.select(KEY, "last", mean.alias("mean"), sd.alias("sd")), horizon)
    g = g.withColumn("date", F.date_add("last", F.col("step"))).withColumn("wd", F.weekday("date"))
    f = F.greatest(F.lit(0.0), F.col("mean") * F.col("weight") * 7)
    return g.join(weights, [KEY, "wd"]).select(
        KEY, "step", "date", f.alias("forecast"), F.greatest(F.lit(0.0), f - 1.5 * F.col("sd")).alias("lower"),
        (f + 1.5 * F.col("sd")).alias("upper"))


def recent_average(filled: DataFrame, horizon: int) -> DataFrame:
    """Mean of the last 7 rows, band of two deviations of the last 14."""
    newest = Window.partitionBy(KEY).orderBy(F.col("date").desc())
    q = F.col("qty").cast("bigint")
    r = filled.withColumn("rn", F.row_number().over(newest)).filter("rn <= 14")
    n, t = F.count(F.lit(1)), F.sum(q).cast("double")
    g = r.groupBy(KEY).agg(
        F.max("date").alias("last"),
        (F.sum(F.when(F.col("rn") <= 7, q)).cast("double") / F.count_if(F.col("rn") <= 7)).alias("m"),
        F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (F.sum(q * q).cast("double") - t * t / n) / (n - 1)))).otherwise(0.0).alias("sd"))
    m, sd = F.col("m"), F.col("sd")
    return steps_ahead(g, horizon).select(
        KEY, "step", m.alias("forecast"), F.greatest(F.lit(0.0), m - 2 * sd).alias("lower"), (m + 2 * sd).alias("upper"),
        F.lit("recent_average").alias("model"))


# Weekday factors of the baseline for products without history, Monday first.
WEEKDAY_FACTORS = (1.05, 1.02, 1.0, 0.98, 1.08, 1.1, 0.77)


def baseline(products: DataFrame, as_of: dt.date, horizon: int) -> DataFrame:
    """Forecast from catalogue data alone: stated demand, else stock, else reorder point, else 1."""
    lead = F.when(F.coalesce(F.col("lead_time_days"), F.lit(0)) == 0, 7).otherwise(F.col("lead_time_days"))
    stock = F.col("current_stock")
    rop = F.coalesce(F.col("reorder_point"), F.lit(0.0))
    base = (
        F.when(F.col("average_daily_demand") > 0, F.col("average_daily_demand"))
        .when((F.col("unit_price") > 0) & (stock > 0), F.greatest(F.lit(1.0), stock / (lead * 3)))
        .when(rop > 0, F.greatest(F.lit(1.0), rop / F.greatest(lead, F.lit(7)))).otherwise(1.0))
    vol = F.when(F.coalesce(F.col("demand_volatility"), F.lit(0.0)) == 0, 0.3).otherwise(F.col("demand_volatility"))
    season = F.when(F.coalesce(F.col("seasonality_factor"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("seasonality_factor"))
    df = steps_ahead(products.select(KEY, (base * season).alias("base"), vol.alias("vol")), horizon)
    df = df.withColumn("date", F.date_add(F.lit(as_of), F.col("step") - 1))
    factor = F.get(F.array(*[F.lit(x) for x in WEEKDAY_FACTORS]), F.weekday("date"))
    p = F.col("base") * factor
    return df.select(KEY, "step", "date", p.alias("forecast"),
                     F.greatest(F.lit(0.0), p * (1.0 - 0.3 * (1.0 + F.col("vol")))).alias("lower"),
                     (p * (1.0 + 0.3 * (1.0 + F.col("vol")))).alias("upper"))


# ---- enrichment and disaggregation ----------------------------------------------

def enrich(forecast: DataFrame, periods: DataFrame) -> DataFrame:
    """Give flat forecasts the season of the history when that season is strong enough."""
    w = Window.partitionBy(KEY)
    f = forecast.withColumns({"_m": F.avg("forecast").over(w), "_s": F.stddev_pop("forecast").over(w),
                              "_h": F.count(F.lit(1)).over(w)})
    flat = (F.col("_h") >= 2) & (F.col("_m") > 0) & (F.col("_s") / F.col("_m") <= 0.12)
    # Only products with a flat forecast need the season of their history.
    history = periods.join(f.filter(flat).select(KEY).distinct(), KEY, "left_semi")
    s = ts.numbered(history.select(KEY, "date", "qty", "grain")).filter("n >= 8")
    weekly = F.col("grain") == "weekly"
    parts = ts.decompose(s, "qty", (3, 4, 6, 8, 13), {3: ~weekly, 4: weekly, 8: weekly, 13: weekly})
    n, p, i = F.col("n"), F.col("period"), F.col("i")
    span = p * F.least(F.lit(3), F.floor(n / p).cast("int"))
    # The preference order of the periods breaks ties between equal strengths.
    order = F.array_position(F.when(F.col("grain") == "biweekly", F.array(F.lit(6), F.lit(3)))
                             .otherwise(F.array(F.lit(13), F.lit(4), F.lit(8), F.lit(6))), F.col("period"))
    g = parts.withColumn("_o", order).groupBy(KEY, "period").agg(
        F.var_pop("seasonal").alias("vs"), F.var_pop("resid").alias("vr"), F.max("_o").alias("o"),
        F.avg(F.when(i >= n - span, F.col("qty"))).alias("level"),
        F.array_sort(F.collect_list(F.when(i >= n - p, F.struct("i", "seasonal")))).alias("cycle"))
    g = g.withColumn("strength", F.col("vs") / (F.col("vs") + F.col("vr") + 1e-10))
    best = g.groupBy(KEY).agg(F.max_by(F.struct("period", "strength", "level", "cycle"),
                                       F.struct(F.round("strength", 9), -F.col("o"))).alias("b")).select(KEY, "b.*")
    best = best.filter("strength >= 0.1 and level > 0")
    df = f.withColumn("_flat", flat).join(best, KEY, "left")
    use = F.col("_flat") & F.col("period").isNotNull()
    season = F.get("cycle", ((F.col("step") - 1) % F.col("period")).cast("int"))["seasonal"]
    idx = F.when(use, F.greatest(F.lit(0.4), F.least(F.lit(2.0), 1.0 + season / F.col("level")))).otherwise(1.0)
    return df.select(KEY, "step", *[F.greatest(F.lit(0.0), F.col(c) * idx).alias(c) for c in ("forecast", "lower", "upper")],
                     F.when(use & ~F.col("model").startswith("seasonal"), F.concat("model", F.lit("+season")))
                     .otherwise(F.col("model")).alias("model"))


def to_days(forecast: DataFrame, last_days: DataFrame, weights: DataFrame, horizon: int) -> DataFrame:
    """Period totals to days by weekday share.  ``last_days`` has product_id, last, period_days."""
    df = forecast.join(last_days, KEY)
    first = (F.col("step") - 1) * F.col("period_days") + 1
    final = F.max("step").over(Window.partitionBy(KEY)) == F.col("step")
    end = F.when(final, F.lit(horizon)).otherwise(F.least(F.lit(horizon), F.col("step") * F.col("period_days")))
    df = df.withColumns({"_a": first, "_b": end}).filter("_a <= _b").withColumn("day", F.explode(F.sequence("_a", "_b")))
    df = df.withColumn("date", F.date_add("last", F.col("day"))).withColumn("wd", F.weekday("date"))
    scale = F.col("period_days") / 7.0
    return df.join(weights, [KEY, "wd"]).select(
        KEY, "day", "date",
        *[F.greatest(F.lit(0.0), F.col(c) * F.col("weight") / scale).alias(c) for c in ("forecast", "lower", "upper")],
        "model")


# ---- the segment-driven pipeline ---------------------------------------------------

def model_choice(segment: Column, n: Column) -> Column:
    """First available model of the segment's list.

    The naive model always fits, decomposition fits from two seasons on, Holt-Winters from four
    periods on, and the pooled trees from one cycle of lags on, so the list reduces to a rule on
    segment and history length.
    """
    long = (
        F.when(segment.isin("SEASONAL_STABLE", "STABLE_TRENDING"), "holt_winters")
        .when(segment == "VOLATILE", "boosted")
        .when(segment == "INTERMITTENT", "seasonal_naive").otherwise("decomposition"))
    medium = F.when(segment.isin("SEASONAL_STABLE", "SEASONAL_VOLATILE", "VOLATILE"), "seasonal_naive").otherwise("holt_winters")
    return F.when(n < 4, "fallback").when(n >= 12, long).when(n >= 6, medium).otherwise("seasonal_naive")


def period_table(daily: DataFrame, trend_threshold: float = 0.05) -> DataFrame:
    """A row per product: segment, grain, periods with silent ones (``qty``), the same without spikes (``smooth``)."""
    seg = ts.segments(daily, trend_threshold).select(KEY, "segment")
    kind = dict(daily.dtypes)[KEY]

    def run(batches):
        for b in batches:
            qty, smooth, days, first = [], [], [], []
            for weeks, sold in zip(bt.lists(b["weeks"]), bt.lists(b["sold"])):
                y, length = bt.dense_periods(weeks, sold)
                first.append(7 * int(weeks[0]) + bt.MONDAY)
                qty.append(y)
                smooth.append(bt.capped(y))
                days.append(7 * length)
            floats = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [b[KEY], b["segment"], pa.array(first, pa.int32()), pa.array(days, pa.int32()), pa.array([len(y) for y in qty], pa.int32()),
                 pa.array(qty, floats), pa.array(smooth, floats)], [KEY, "segment", "first", "period_days", "n", "qty", "smooth"])

    sold = bt.sold_weeks(daily).select(KEY, F.col("sold.week").alias("weeks"), F.col("sold.y").alias("sold"))
    return sold.join(seg, KEY).mapInArrow(
        run, f"{KEY} {kind}, segment string, first int, period_days int, n int, qty array<double>, smooth array<double>")


#: Rounds and learning rate of the pooled trees inside the pipeline; alone they default to 100 and 0.1.
PIPELINE_TREES = (10, 0.4)
#: Products that a task forecasts; a few hundredths of them take the recursion.
PRODUCTS_PER_TASK = 4096


def forecast_periods(table: DataFrame, horizon: int, trees: tuple[int, float] = PIPELINE_TREES) -> DataFrame:
    """Period forecasts of ``period_table`` rows with ``choice``: model, then season for flat ones.

    The pooled trees learn from all products that they are chosen for, and forecast them first.
    """
    kind = dict(table.dtypes)[KEY]
    pooled = table.where("choice = 'boosted'").select(KEY, "first", "period_days", F.posexplode("smooth").alias("i", "qty")).select(
        KEY, F.date_from_unix_date(F.col("first") + F.col("i") * F.col("period_days")).alias("date"), "qty", F.col("period_days").alias("days"))
    steps = "array<struct<step: int, forecast: double, lower: double, upper: double>>"
    if pooled.isEmpty():
        table = table.withColumn("known", F.lit(None).cast(steps))
    else:
        ahead = boosted_forecast(pooled, max(1, -(-horizon // 7)), *trees).groupBy(KEY).agg(
            F.sort_array(F.collect_list(F.struct("step", "forecast", "lower", "upper"))).alias("known"))
        table = table.join(ahead, KEY, "left")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, bt.CHUNK):
                b = whole.slice(at, bt.CHUNK)
                qty, smooth = bt.lists(b["qty"]), bt.lists(b["smooth"])
                days = b["period_days"].to_pylist()
                grains = ["biweekly" if d == 14 else "weekly" for d in days]
                horizons = [max(1, -(-horizon // d)) for d in days]
                steps = bt.model_steps(smooth, qty, grains, b["choice"].to_pylist(), max(horizons))
                for k, known in enumerate(b["known"].to_pylist()):
                    if known:
                        steps[k] = (*(np.array([r[c] for r in known]) for c in ("forecast", "lower", "upper")), "boosted")
                steps = bt.enriched(steps, qty, grains, horizons)
                kept = [k for k, s in enumerate(steps) if s is not None]
                row = np.repeat(kept, [horizons[k] for k in kept]).astype("int64")
                mean, low, high = (np.concatenate([np.empty(0), *[steps[k][j][:horizons[k]] for k in kept]]) for j in range(3))
                step = np.concatenate([np.empty(0, "int32"), *[np.arange(1, horizons[k] + 1, dtype="int32") for k in kept]])
                names = pa.array([s[3] if s else None for s in steps], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [b[KEY].take(pa.array(row)), pa.array(step, pa.int32()), pa.array(mean), pa.array(low), pa.array(high), names.take(pa.array(row))],
                    [KEY, "step", "forecast", "lower", "upper", "model"])

    # Series of one model stand together, so that the recursion gets full matrices.
    dealt = table.repartition(bt.tasks_for(table, PRODUCTS_PER_TASK), KEY).sortWithinPartitions("choice")
    return dealt.mapInArrow(run, FORECAST.format(key=kind))


def forecast_products(daily: DataFrame, horizon: int = 30, trend_threshold: float = 0.05,
                      trees: tuple[int, float] = PIPELINE_TREES) -> DataFrame:
    """Segment, aggregate, smooth, fit, enrich and disaggregate; one row per product and day."""
    # Read by the segments, the periods, the weekdays and the fallback; days without a product have no forecast.
    daily = by_key(materialise(daily.select(KEY, "date", "qty").where(F.col(KEY).isNotNull())), KEY)
    # A row per product, read by the fits, the fallback and the lengths of the periods.
    table = materialise(period_table(daily, trend_threshold).withColumn("choice", model_choice(F.col("segment"), F.col("n"))))
    fitted = forecast_periods(table.where("choice != 'fallback'"), horizon, trees)
    weights = ts.weekday_weights(daily)
    last = daily.groupBy(KEY).agg(F.max("date").alias("last")).join(table.select(KEY, "period_days"), KEY)
    days = to_days(fitted, last, weights, horizon)
    short = daily.join(table.where("choice = 'fallback'").select(KEY), KEY, "left_semi")
    rest = fallback(short, weights, horizon).select(
        KEY, F.col("step").alias("day"), "date", "forecast", "lower", "upper", F.lit("fallback").alias("model"))
    return days.unionByName(rest).join(table.select(KEY, "segment"), KEY)


def first_generation(daily: DataFrame, horizon: int = 30) -> DataFrame:
    """Daily zero-filled series and one model by segment: Croston, Holt-Winters (7) or an average."""
    seg = ts.segments(daily).select(KEY, "recommended_model", "segment")
    filled = ts.fill_days(daily).join(seg, KEY)
    w = Window.partitionBy(KEY)
    filled = filled.withColumn("n_days", F.count(F.lit(1)).over(w))
    # sarima, prophet, xgboost and arima are single-series solvers that are left out.
    model = F.when(F.col("n_days") < 14, "average").when(F.col("recommended_model") == "croston", "croston") \
        .when(F.col("recommended_model") == "exponential_smoothing", "holt_winters").otherwise("average")
    filled = filled.withColumn("choice", model)
    cro = steps_ahead(ts.croston(filled.filter("choice = 'croston'").select(KEY, "date", "qty")), horizon).select(
        KEY, "step", F.col("rate").alias("forecast"), "lower", "upper", F.lit("croston").alias("model"))
    avg = recent_average(filled.filter("choice = 'average'").select(KEY, "date", "qty"), horizon)
    hw = seasonal_days(filled.filter("choice = 'holt_winters'").select(KEY, "date", "qty"), horizon)
    return cro.unionByName(avg).unionByName(hw)


def seasonal_days(filled: DataFrame, horizon: int = 30) -> DataFrame:
    """Season of 7 days on zero-filled daily rows."""
    rows = filled.select(KEY, "date", "qty", F.lit("daily").alias("grain"), F.lit(horizon).alias("horizon"))
    return hw.forecast_all(rows, KEY, "qty", hw.weekly_seasons, lambda k: 1.96 * np.sqrt(k + 1))


# ---- model comparison ---------------------------------------------------------------

def compare_models(series: DataFrame, alpha: float = 0.3, beta: float = 0.3, scoring: str = "reference",
                   shares: tuple[float, ...] = (0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """Error and last value of six models on an 80/20 split in time, per product.

    ``scoring="holdout"`` judges all models on the same rows: from each share of the rows on, a model
    fitted on the rows before forecasts those up to the next share.  Otherwise scores follow the usual practice of the dashboard: smoothing and the moving average
    on the held-out rows, Holt, weighted average and line on the training rows, and the
    decomposition on everything.  One pass: windows over the product give the predictions of
    each row, one aggregate scores them, and the two smoothers fold the ordered values.
    """
    if scoring == "holdout":
        return bt.rolling_scores(series, shares, alpha, beta)
    s = ts.trailing_decomposition(series).filter("n >= 14").withColumn("split", F.floor(F.col("n") * 0.8).cast("int"))
    i, n, k, q = F.col("i").cast("bigint"), F.col("n"), F.col("split"), F.col("qty").cast("bigint")
    held, train = i >= k, i < k
    every = Window.partitionBy(KEY)
    w = every.orderBy("i")

    size = F.least(i + 1, F.lit(7)).cast("bigint")
    total = F.lit(0).cast("bigint")
    for back in range(7):
        total = total + F.coalesce(F.lag(q, back).over(w), F.lit(0)) * F.greatest(F.lit(0).cast("bigint"), size - back)
    sums = {"_sx": i, "_sy": q, "_sxy": i * q, "_sxx": i * i}
    s = s.withColumns({
        "p_ma": F.sum(F.when(i >= n - 7, q)).over(every).cast("double") / 7,
        "p_wma": F.when(k < 7, q.cast("double")).otherwise(total.cast("double") / (size * (size + 1) / 2)),
        "p_dec": F.col("trend") + F.col("seasonal"),
        **{name: F.sum(F.when(train, x)).over(every) for name, x in sums.items()}})
    sx, sy, sxy, sxx = (F.col(c) for c in sums)
    b = F.coalesce(ratio((k * sxy - sx * sy).cast("double"), (k * sxx - sx * sx).cast("double")), F.lit(0.0))
    s = s.withColumn("b", b).withColumn("a", sy.cast("double") / k - F.col("b") * sx / k)
    s = s.withColumn("p_line", F.col("a") + F.col("b") * i)

    def score(pred: str, rows: Column) -> Column:
        e, known = F.col("qty") - F.col(pred), rows & (F.col("qty") != 0)
        return F.struct(
            F.coalesce(F.avg(F.when(known, F.abs(e / F.col("qty")))) * 100, F.lit(100.0)).alias("mape"),
            F.sqrt(F.avg(F.when(rows, F.pow(e, 2)))).alias("rmse"),
            F.max_by(F.when(rows, F.col(pred)), F.when(rows, F.col("i"))).alias("last"))

    g = s.groupBy(KEY).agg(
        F.max("split").alias("split"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("qty").cast("double").alias("y")))), lambda r: r["y"]).alias("ys"),
        F.greatest(F.lit(0.0), F.max("a") + F.max("b") * F.max("split")).alias("line_last"),
        score("p_ma", held).alias("ma"), score("p_wma", train).alias("wma"),
        score("p_line", train).alias("line"), score("p_dec", F.lit(True)).alias("dec"))

    # Single smoothing: level of all rows before this one (a fold over the ordered values).
    def fold_es(acc: Column, y: Column) -> Column:
        late = acc["t"] >= F.col("split")
        level, err = acc["level"], y - acc["level"]
        ok = late & (y != 0)
        return F.struct(
            (acc["t"] + 1).alias("t"), F.when(acc["t"] == 0, y).otherwise(alpha * y + (1 - alpha) * level).alias("level"),
            (acc["ape"] + F.when(ok, F.abs(err / y)).otherwise(0.0)).alias("ape"),
            (acc["m"] + F.when(ok, 1).otherwise(0)).alias("m"),
            (acc["sq"] + F.when(late, err * err).otherwise(0.0)).alias("sq"),
            F.when(late, level).otherwise(acc["last"]).alias("last"))

    zero = F.struct(F.lit(0).alias("t"), F.lit(0.0).alias("level"), F.lit(0.0).alias("ape"), F.lit(0).alias("m"),
                    F.lit(0.0).alias("sq"), F.lit(0.0).alias("last"))

    def fold_holt(acc: Column, y: Column) -> Column:
        first = acc["t"] == 0
        level = F.when(first, y).otherwise(alpha * y + (1 - alpha) * (acc["level"] + acc["trend"]))
        trend = F.when(first, F.get("ys", F.lit(1)) - y).otherwise(
            beta * (level - acc["level"]) + (1 - beta) * acc["trend"])
        pred = F.when(first, y).otherwise(level + trend)
        ok = y != 0
        return F.struct(
            (acc["t"] + 1).alias("t"), level.alias("level"), trend.alias("trend"),
            (acc["ape"] + F.when(ok, F.abs((y - pred) / y)).otherwise(0.0)).alias("ape"),
            (acc["m"] + F.when(ok, 1).otherwise(0)).alias("m"), (acc["sq"] + (y - pred) * (y - pred)).alias("sq"),
            pred.alias("last"))

    zero2 = F.struct(F.lit(0).alias("t"), F.lit(0.0).alias("level"), F.lit(0.0).alias("trend"), F.lit(0.0).alias("ape"),
                     F.lit(0).alias("m"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("last"))
    g = g.withColumns({
        "es": F.aggregate("ys", zero, fold_es),
        "holt": F.aggregate(F.slice("ys", F.lit(1), F.col("split")), zero2, fold_holt)})

    def folded(r: str, rows: Column, name: str) -> Column:
        m = F.when(F.col(f"{r}.m") > 0, F.col(f"{r}.ape") / F.col(f"{r}.m") * 100).otherwise(100.0)
        return row(m, F.sqrt(F.col(f"{r}.sq") / rows), F.col(f"{r}.last"), name)

    def row(mape: Column, rmse: Column, last: Column, name: str) -> Column:
        return F.struct(mape.alias("mape"), rmse.alias("rmse"), last.alias("last"), F.lit(name).alias("model"))

    return g.select(KEY, F.inline(F.array(
        folded("es", F.size("ys") - F.col("split"), "exponential_smoothing"),
        folded("holt", F.col("split"), "double_exponential_smoothing"),
        row(F.col("ma.mape"), F.col("ma.rmse"), F.col("ma.last"), "moving_average"),
        row(F.col("wma.mape"), F.col("wma.rmse"), F.col("wma.last"), "weighted_moving_average"),
        row(F.col("line.mape"), F.col("line.rmse"), F.col("line_last"), "linear_regression"),
        row(F.col("dec.mape"), F.lit(0.0), F.greatest(F.lit(0.0), F.col("dec.last")), "seasonal_decomposition"))))


def pick_models(scores: DataFrame, beside: str | None = None) -> DataFrame:
    """Best model and the mean of the three best last values, per product.

    ``beside`` names a model whose error is returned as ``naive_mape``.
    """
    order = Window.partitionBy(KEY).orderBy(F.round("mape", 6), "model")
    r = scores.withColumn("rn", F.row_number().over(order))
    naive = [F.max(F.when(F.col("model") == beside, F.col("mape"))).alias("naive_mape")] if beside else []
    return r.groupBy(KEY).agg(
        F.min_by("model", "rn").alias("best_model"), F.min_by("mape", "rn").alias("best_mape"),
        (F.sum(F.when(F.col("rn") <= 3, F.col("last"))) / 3).alias("ensemble"), *naive).withColumn(
        "confidence", F.when(F.col("best_mape") < 15, "high").when(F.col("best_mape") < 30, "medium").otherwise("low"))


# ---- adjustments, weights and metrics ---------------------------------------------------

def adjust(forecast: DataFrame, products: DataFrame) -> DataFrame:
    """Season, volatility, class and turnover adjustments from the catalogue, per product."""
    meta = products.select(KEY, "seasonality_factor", "demand_volatility", "xyz_class", "average_daily_demand", "inventory_turnover")
    # A catalogue file says little about its rows in memory, so it is not broadcast by the size of the file.
    df = forecast.join(meta.hint("merge"), KEY)
    w = Window.partitionBy(KEY)
    s = F.coalesce("seasonality_factor", F.lit(1.0))
    df = df.withColumns({c: F.col(c) * s for c in ("forecast", "lower", "upper")})
    mult = 1.0 + (F.coalesce("demand_volatility", F.lit(0.5)) - 0.5) * 0.5
    stretch = mult * F.when(F.col("xyz_class") == "Z", 1.4).when(F.col("xyz_class") == "X", 0.8).otherwise(1.0)
    mid, half = (F.col("upper") + F.col("lower")) / 2, (F.col("upper") - F.col("lower")) / 2
    df = df.withColumns({"_lo": mid - half * stretch, "_hi": mid + half * stretch, "_m": F.avg("forecast").over(w)})
    d = F.col("average_daily_demand")
    shift = F.when((d > 0) & (F.abs(F.col("_m") - d) / d > 0.5), (d - F.col("_m")) * 0.3).otherwise(0.0)
    df = df.withColumns({"_f": F.col("forecast") + shift, "_lo": F.col("_lo") + shift, "_hi": F.col("_hi") + shift})
    move = F.col("_f") - F.coalesce(F.lag("_f").over(w.orderBy("step")), F.col("_f"))
    t = F.col("inventory_turnover")
    final = F.when(t > 12, F.col("_f") + move * 0.15).when((t > 0) & (t < 4), F.col("_f") * 0.7 + F.avg("_f").over(w) * 0.3).otherwise(F.col("_f"))
    z = F.lit(0.0)
    return df.select(KEY, "step", F.greatest(final, z).alias("forecast"), F.greatest(F.col("_lo"), z).alias("lower"),
                     F.greatest(F.col("_hi"), z).alias("upper"))


def ensemble_weights(scored: DataFrame) -> DataFrame:
    """Weights from held-out absolute errors of a series model and a calendar model."""
    g = scored.groupBy(KEY).agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("held"),
        F.avg(F.abs(F.col("qty") - F.col("series_pred"))).alias("m1"),
        F.avg(F.abs(F.col("qty") - F.col("calendar_pred"))).alias("m2"))
    a, b = 1.0 / (F.col("m1") + 1), 1.0 / (F.col("m2") + 1)
    weight = F.greatest(F.lit(0.2), F.least(F.lit(0.8), a / (a + b)))
    weight = F.when((F.col("n") < 30) | (F.col("held") < 5), 0.7).when(
        F.col("m1").isNull() & F.col("m2").isNull(), 0.7).when(F.col("m1").isNull(), 0.3).when(F.col("m2").isNull(), 0.9).otherwise(weight)
    return g.select(KEY, F.col("m1").alias("series_mae"), F.col("m2").alias("calendar_mae"),
                    weight.alias("series_weight"), (1.0 - weight).alias("calendar_weight"))


def accuracy_metrics(scored: DataFrame) -> DataFrame:
    """MAPE without zero actuals, RMSE, MAE and the +1 variant of MAPE, per product."""
    a, p = F.col("actual"), F.col("predicted")
    return scored.groupBy(KEY).agg(
        F.coalesce(F.avg(F.when(a != 0, F.abs((a - p) / a))) * 100, F.lit(100.0)).alias("mape"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"), F.avg(F.abs(a - p)).alias("mae"),
        (F.avg(F.abs((a - p) / (a + 1))) * 100).alias("mape_plus_one"))


def feature_selection(series: DataFrame, min_corr: float = 0.1) -> DataFrame:
    """Calendar features whose rank correlation with demand is significant, best four.

    Ranks are averages over ties; the test is t² = r²(n−2)/(1−r²) against Student's t.
    """
    def correlation(a: str, b: str) -> Column:
        return ratio(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))  # null for a constant

    feats = ["day_of_week", "day_of_month", "month", "quarter", "is_weekend", "week_of_year"]
    s = ts.calendar_features(ts.numbered(series))
    w = Window.partitionBy(KEY)

    def rank(c: str) -> Column:
        same = Window.partitionBy(KEY, c)
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(same) - 1) / 2.0

    s = s.withColumn("_rq", rank("qty"))
    s = s.withColumns({f"_r_{f}": rank(f) for f in feats})
    g = s.groupBy(KEY).agg(F.max("n").alias("n"), *[correlation(f"_r_{f}", "_rq").alias(f) for f in feats])
    long = g.select(KEY, "n", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("r")) for f in feats])).alias("x")).select(KEY, "n", "x.*")
    n, r2 = F.col("n"), F.col("r") * F.col("r")
    strong = (F.abs("r") >= min_corr) & t_passes(r2, n) & (n >= 10)
    kept = long.filter(strong)
    o = Window.partitionBy(KEY).orderBy(F.abs("r").desc(), "feature")
    kept = kept.withColumns({"position": F.row_number().over(o), "found": F.count(F.lit(1)).over(w)}).filter("found >= 2 and position <= 4")
    default = g.select(KEY).join(kept.select(KEY).distinct(), KEY, "left_anti").select(
        KEY, F.posexplode(F.array(F.lit("day_of_week"), F.lit("month"), F.lit("is_weekend"))).alias("p", "feature"))
    return kept.select(KEY, "feature", "position", F.col("r").alias("correlation")).unionByName(
        default.select(KEY, "feature", (F.col("p") + 1).alias("position"), F.lit(None).cast("double").alias("correlation")))


# ---- holdout selection with a calendar regression -------------------------------------

def _smooth_level(y: np.ndarray) -> float:
    back = np.arange(len(y) - 1, -1, -1)
    return float(y @ (np.where(back == len(y) - 1, 1.0, 0.3) * 0.7 ** back))


def _simple(name: str, y: np.ndarray, h: int) -> np.ndarray:
    if name == "seasonal_naive":
        return y[-7:][np.arange(h) % min(7, len(y))]
    if name == "linear_trend":
        return np.polyval(np.polyfit(np.arange(len(y)), y, 1), np.arange(len(y), len(y) + h))
    return np.full(h, _smooth_level(y))


def holdout_models(series: list[np.ndarray], horizons: list[int]) -> list[tuple[str, np.ndarray, float | None]]:
    """(model, forecast, held-out error) of each series: the least mean error on its last fifth, from 30 rows on.

    Shorter series are smoothed and have no error; of equal models the first by name stands.
    """
    cuts = [int(len(y) * 0.8) for y in series]
    long = [k for k, y in enumerate(series) if len(y) >= 30]
    out = [("exponential_smoothing", _simple("", y, h), None) for y, h in zip(series, horizons)]
    if not long:
        return out
    trains = [series[k][:cuts[k]] for k in long]
    _, seasonal, _ = hw.fit(trains, max(len(series[k]) - cuts[k] for k in long), 7)
    picked: list[int] = []
    for k, train, ahead in zip(long, trains, seasonal):
        held = series[k][cuts[k]:]
        errors = {m: np.abs(held - _simple(m, train, len(held))).mean() for m in ("exponential_smoothing", "linear_trend", "seasonal_naive")}
        errors["holt_winters"] = np.abs(held - ahead[:len(held)]).mean()
        choice = min(sorted(errors), key=errors.get)
        out[k] = choice, _simple(choice, series[k], horizons[k]), float(errors[choice])
        picked += [k] if choice == "holt_winters" else []
    if picked:
        _, ahead, _ = hw.fit([series[k] for k in picked], max(horizons[k] for k in picked), 7)
        for k, values in zip(picked, ahead):
            out[k] = "holt_winters", values[:horizons[k]], out[k][2]
    return out


def auto_forecast(series: DataFrame, horizon: int | Column = 30) -> DataFrame:
    """Forecast of the holdout winner blended with the calendar regression, for every product.

    The weights are the inverse errors of the two on the last fifth of the rows; the regression uses the
    features selected for the product.  ``direction`` compares the last week ahead with the first.
    """
    h = horizon if isinstance(horizon, Column) else F.lit(horizon)
    kind = dict(series.dtypes)[KEY]
    # Read by the selection, the regression, its error and the models.
    s = by_key(materialise(ts.numbered(series.withColumn("horizon", h.cast("int")))), KEY, per_task=250_000)
    daily = s.select(KEY, "date", "qty")
    coefs = materialise(reg.calendar_fit(daily, reg.selected_features(daily)))
    held = ts.calendar_features(s.filter(F.col("i") >= F.floor(F.col("n") * 0.8)).filter("n >= 30")).join(coefs, KEY)
    error = held.groupBy(KEY).agg(F.avg(F.abs(F.col("qty") - reg.calendar_value())).alias("calendar_mae"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, bt.CHUNK):
                b = whole.slice(at, bt.CHUNK)
                ys, horizons = [np.array(y) for y in b["ys"].to_pylist()], b["horizon"].to_pylist()
                found = holdout_models(ys, horizons)
                take = pa.array(np.repeat(np.arange(len(ys)), horizons))
                steps = np.concatenate([np.arange(1, h + 1, dtype="int32") for h in horizons])
                yield pa.RecordBatch.from_arrays(
                    [b[KEY].take(take), b["last"].take(take), pa.array(steps, pa.int32()),
                     pa.array(np.concatenate([f[1] for f in found])), pa.array([f[0] for f in found]).take(take),
                     pa.array([f[2] for f in found], pa.float64()).take(take), pa.array([y.std() / np.sqrt(len(y)) for y in ys]).take(take)],
                    [KEY, "last", "step", "core", "model", "series_mae", "sd"])

    arrays = bt.as_arrays(s, "qty", F.max("date").alias("last"), F.max("horizon").alias("horizon"))
    core = arrays.repartition(bt.tasks_for(s.select(KEY).distinct()), KEY).mapInArrow(
        run, f"{KEY} {kind}, last date, step int, core double, model string, series_mae double, sd double")
    a, b = 1 / (F.col("series_mae") + 1), 1 / (F.col("calendar_mae") + 1)
    weight = F.coalesce(F.greatest(F.lit(0.2), F.least(F.lit(0.8), a / (a + b))), F.lit(0.7))
    ahead = ts.calendar_features(core.withColumn("date", F.date_add("last", F.col("step")))).join(coefs, KEY).join(error, KEY, "left")
    w = Window.partitionBy(KEY)
    mean = F.greatest(F.lit(0.0), weight * F.col("core") + (1 - weight) * reg.calendar_value())
    ahead = ahead.withColumn("forecast", mean).withColumn("_h", F.max("step").over(w)).withColumns({
        "_a": F.avg(F.when(F.col("step") <= 7, F.col("forecast"))).over(w),
        "_b": F.avg(F.when(F.col("step") > F.col("_h") - 7, F.col("forecast"))).over(w)})
    change = F.when(F.col("_h") > 7, (F.col("_b") - F.col("_a")) / F.greatest(F.col("_a"), F.lit(1.0)) * 100).otherwise(0.0)
    band = 1.96 * F.col("sd") * F.sqrt("step")
    return ahead.select(
        KEY, "step", "forecast", F.greatest(F.lit(0.0), F.col("forecast") - band).alias("lower"), (F.col("forecast") + band).alias("upper"),
        "model", F.when(change > 10, "increasing").when(change < -10, "decreasing").otherwise("stable").alias("direction"))


def backtest(series: DataFrame, min_rows: int = 30, share: float = 0.6) -> DataFrame:
    """Train on the first 60 % of the rows and forecast the dates of the rest."""
    s = ts.numbered(series).filter(F.col("n") >= min_rows).withColumn("cut", F.floor(F.col("n") * share).cast("int"))
    train = s.filter("i < cut")
    fc = auto_forecast(train.select(KEY, "date", "qty", (F.col("n") - F.col("cut")).cast("int").alias("h")), F.col("h"))
    held = s.filter("i >= cut").select(KEY, F.col("date").alias("forecast_date"), F.col("qty").alias("actual"),
                                       (F.col("i") - F.col("cut") + 1).cast("int").alias("step"))
    return fc.join(held, [KEY, "step"]).select(
        KEY, "forecast_date", F.col("forecast").alias("predicted"), "lower", "upper", "actual", "model")


# ---- pooled boosted trees -----------------------------------------------------------------

LAGS, ROLLS = (1, 2, 4, 8, 13), (4, 8, 13)
CAL = ("week_of_year", "month", "quarter")


def lag_table(weeks: DataFrame, own: bool = False) -> DataFrame:
    from granary.operators.classify import lag_features

    df = lag_features(weeks.select(KEY, "date", "qty"), LAGS, ROLLS, own)
    return ts.calendar_features(df).na.fill(0)


def boosted_forecast(weeks: DataFrame, horizon: int = 4, rounds: int = 100, rate: float = 0.1, own: bool = False) -> DataFrame:
    """One distributed tree ensemble over the periodic features of all products, stepped ahead.

    ``weeks`` has product_id, date, qty and optionally ``days``, the length of a product's periods (7).
    Rolling features end before the period they describe, and the forecast of a step stands in the
    lags of the next one, for all products at once.  With ``own`` the features hold the period's own
    demand and periods ahead stand with zero, as in the dashboard.  Bands are 1.96 deviations of the
    product's residuals.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    if "days" not in weeks.columns:
        weeks = weeks.withColumn("days", F.lit(7))
    feats = [f"lag_{k}" for k in LAGS] + [f"{m}_{k}" for k in ROLLS for m in ("mean", "sd")] + list(CAL)
    asm = VectorAssembler(inputCols=feats, outputCol="features")
    # Every round reads the features again; the weeks behind them are counted once.  Trees are bound by
    # CPU, so the tasks follow from the number of rows and not from their bytes, but their number stays small.
    table = materialise(lag_table(weeks, own))
    known = asm.transform(table.repartition(bt.training_tasks(table), KEY))
    model = GBTRegressor(labelCol="qty", maxIter=rounds, maxDepth=4, stepSize=rate, seed=42).fit(known.select("qty", "features"))
    spread_of = model.transform(known).groupBy(KEY).agg(F.stddev_pop(F.col("qty") - F.col("prediction")).alias("sd"))
    keep = Window.partitionBy(KEY).orderBy(F.col("date").desc())
    frame = materialise(weeks.select(KEY, "date", F.col("qty").cast("double").alias("qty"), "days").withColumn(
        "rn", F.row_number().over(keep)).filter("rn <= 13").withColumn("step", F.lit(0)).drop("rn"))
    newest = frame.groupBy(KEY).agg(F.max("date").alias("last"), F.max("days").alias("days"))

    def later(steps: Column) -> DataFrame:
        return newest.withColumn("step", F.explode(steps)).select(
            KEY, F.date_add("last", F.col("step") * F.col("days")).alias("date"), F.lit(0.0).alias("qty"), "days", "step")

    def predicted(rows: DataFrame) -> DataFrame:
        """Rows ahead with the features that the frame gives them."""
        marks = rows.select(KEY, "date", "step").where("step > 0")
        table = lag_table(rows.select(KEY, "date", "qty"), own).join(marks, [KEY, "date"])
        return model.transform(asm.transform(table)).select(KEY, "date", F.greatest(F.lit(0.0), F.col("prediction")).alias("qty"), "step")

    if own:
        ahead = predicted(frame.unionByName(later(F.sequence(F.lit(1), F.lit(horizon)))))
    else:
        # A few rows per product; a step needs the values of those before it.
        for step in range(1, horizon + 1):
            found = predicted(frame.unionByName(later(F.array(F.lit(step))))).where(F.col("step") == step)
            frame = materialise(frame.unionByName(found.join(newest.select(KEY, "days"), KEY)))
        ahead = frame.where("step > 0").select(KEY, "date", "qty", "step")
    mean, band = F.col("qty"), 1.96 * F.col("sd")
    return ahead.join(spread_of, KEY).select(
        KEY, "date", "step", mean.alias("forecast"), F.greatest(F.lit(0.0), mean - band).alias("lower"), (mean + band).alias("upper"))


# ---- views on forecasts ---------------------------------------------------------------------

# Extra stock per segment on top of the forecast.
SAFETY_SHARE = {"STABLE_FLAT": 0.10, "STABLE_TRENDING": 0.15, "SEASONAL_STABLE": 0.20, "SEASONAL_VOLATILE": 0.30,
                "MODERATE": 0.20, "VOLATILE": 0.35, "INTERMITTENT": 0.25}


def weekly_view(days: DataFrame) -> DataFrame:
    """Monday buckets of a daily forecast as whole units, and the stock they call for."""
    week = F.date_trunc("week", "date").cast("date")

    def whole(c: str) -> Column:
        return F.greatest(F.lit(0), F.bround(F.sum(c)).cast("int")).alias(c)

    per = days.groupBy(KEY, "segment", week.alias("week")).agg(whole("forecast"), whole("lower"), whole("upper"))
    share = F.create_map(*[F.lit(x) for kv in SAFETY_SHARE.items() for x in kv])
    total = F.sum("forecast").over(Window.partitionBy(KEY))
    return per.withColumn("recommended_stock", F.greatest(
        F.lit(1), F.bround(total * (1 + F.coalesce(share[F.col("segment")], F.lit(0.20)))).cast("int")))


def horizon_summary(days: DataFrame) -> DataFrame:
    return days.groupBy(KEY).agg(
        F.avg("forecast").alias("avg_daily"), F.min("forecast").alias("min_daily"), F.max("forecast").alias("max_daily"),
        F.sum("forecast").alias("total"), F.sum("lower").alias("total_lower"), F.sum("upper").alias("total_upper"))


def coverage(products: DataFrame, days: DataFrame, horizon: int) -> DataFrame:
    t = days.groupBy(KEY).agg(F.sum("forecast").alias("total"))
    df = products.select(KEY, "current_stock").join(t, KEY)
    rate = F.col("total") / horizon
    return df.withColumns({
        "coverage_days": F.when(rate > 0, F.col("current_stock") / rate),
        "shortage": F.greatest(F.lit(0.0), F.col("total") - F.col("current_stock"))})
