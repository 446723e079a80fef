"""Time series per product in long form: gap filling, buckets, decomposition, segments.

All series are (product_id, date, qty) with one row per product and period, so a group
is never longer than the calendar, whatever the number of transactions behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators import batched
from granary.operators.demand import population_sd
from granary.operators.series_terms import slope

KEY = "product_id"


def numbered(series: DataFrame) -> DataFrame:
    """Add the position ``i`` from 0 and the length ``n`` of the series."""
    w = Window.partitionBy(KEY)
    return series.withColumns({
        "i": F.row_number().over(w.orderBy("date")) - 1, "n": F.count(F.lit(1)).over(w)})


def fill_days(series: DataFrame) -> DataFrame:
    """Daily series from the first to the last day of each product, zeros where silent."""
    grid = series.groupBy(KEY).agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(
        KEY, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))
    return grid.join(series, [KEY, "date"], "left").withColumn("qty", F.coalesce("qty", F.lit(0)))


def weekly(series: DataFrame) -> DataFrame:
    """Monday weeks with zero weeks filled in; ``n_days`` counts selling days."""
    per = series.groupBy(KEY, F.date_trunc("week", "date").cast("date").alias("week")).agg(
        F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n_days"))
    sold = per.where("week is not null")
    # A selling week stands with the silent ones up to the next.
    following = F.lead("week").over(Window.partitionBy(KEY).orderBy("week"))
    upto = F.coalesce(F.date_sub(following, 7), F.col("week"))
    # Sales without a product count in no week of theirs.
    first = (F.col("date") == F.col("week")) & F.col(KEY).isNotNull()
    return sold.withColumn("_upto", upto).withColumn("date", F.explode(F.sequence("week", "_upto", F.expr("interval 7 days")))).select(
        KEY, "date", F.when(first, F.coalesce("qty", F.lit(0))).otherwise(0).alias("qty"),
        F.when(first, F.col("n_days")).otherwise(0).alias("n_days"))


def model_periods(series: DataFrame) -> DataFrame:
    """Weekly rows, or pairs of weeks where fewer than half of at least eight weeks sold.

    Pairs are counted from each product's first Monday.  The grain is decided on the
    selling weeks, before the silent ones are generated.
    """
    every = Window.partitionBy(KEY)
    sold = series.groupBy(KEY, F.date_trunc("week", "date").cast("date").alias("week")).agg(
        F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n_days"))
    sold = sold.withColumns({"lo": F.min("week").over(every), "hi": F.max("week").over(every),
                             "n_pos": F.count_if(F.col("qty") > 0).over(every)}).where("week is not null")
    n = F.floor(F.datediff("hi", "lo") / 7) + 1
    sparse = (F.col("n_pos") < 0.5 * n) & (n >= 8)
    sold = sold.withColumn("days", F.when(sparse, 14).otherwise(7))
    filled = sold.groupBy(KEY, "lo", "days", F.floor(F.datediff("week", "lo") / F.col("days")).cast("int").alias("slot")).agg(
        F.sum("qty").alias("qty"), F.sum("n_days").alias("n_days"))
    # A selling period stands with the silent ones up to the next.
    upto = F.coalesce(F.lead("slot").over(every.orderBy("slot")) - 1, F.col("slot"))
    first = (F.col("at") == F.col("slot")) & F.col(KEY).isNotNull()
    return filled.withColumn("_upto", upto).withColumn("at", F.explode(F.sequence("slot", "_upto"))).select(
        KEY, F.date_add("lo", F.col("at") * F.col("days")).alias("date"), F.when(first, F.coalesce("qty", F.lit(0))).otherwise(0).alias("qty"),
        F.when(first, F.col("n_days")).otherwise(0).alias("n_days"),
        F.when(F.col("days") == 14, "biweekly").otherwise("weekly").alias("grain"))


def winsorise(periods: DataFrame) -> DataFrame:
    """Cap at twice the 99th percentile of the selling periods.

    Where fewer than 30 % of the periods sold, a lone spike above five medians is also
    spread over its neighbours.
    """
    q = F.col("qty").cast("double")
    pos = F.when(q > 0, q)
    every = Window.partitionBy(KEY)
    df = periods.where(F.col(KEY).isNotNull()).withColumns({
        "_p": F.percentile(pos, F.array(F.lit(0.99), F.lit(0.5))).over(every), "_n": F.count(F.lit(1)).over(every),
        "_pos": F.count(pos).over(every), "_top": F.max(q).over(every)})
    cap = F.when((F.col("_n") >= 4) & (F.col("_pos") > 0), F.col("_p")[0] * 2.0)
    df = df.withColumns({"_cap": cap, "_limit": F.coalesce(F.col("_p")[1], F.lit(1.0)) * 5})
    lone = ((F.col("_n") >= 4) & (F.col("_pos") < 0.3 * F.col("_n"))
            & (F.coalesce(F.least("_top", "_cap"), F.col("_top")) > F.col("_limit")))
    df = df.withColumns({"lone": lone, "smooth": F.coalesce(F.least(q, F.col("_cap")), q)}).select(
        *periods.columns, "smooth", F.col("_limit").alias("limit"), "lone")
    spread = spread_spikes(df.filter("lone").drop("lone"))
    return df.filter(~F.col("lone")).select(*periods.columns, "smooth").unionByName(spread)


def spread_spikes(rows: DataFrame) -> DataFrame:
    """Share every value above ``limit`` with its neighbours, in time order.

    A raised neighbour may exceed the limit in turn, so the pass is a fold over the
    product's ordered values, as many as the calendar has periods.
    """
    other = [c for c in rows.columns if c not in (KEY, "date", "smooth", "limit")]
    g = rows.groupBy(KEY).agg(
        F.max("limit").alias("limit"), F.array_sort(F.collect_list(F.struct("date", "smooth", *other))).alias("rows"))
    g = g.withColumn("ys", F.transform("rows", lambda r: r["smooth"]))
    last = F.size("ys") - 1

    def width(i: Column) -> Column:
        return F.least(i + 1, last) - F.greatest(i - 1, F.lit(0)) + 1

    def step(acc: Column, i: Column) -> Column:
        v = F.greatest(F.get("ys", i), acc["carry"])
        share = F.when(v > F.col("limit"), v / width(i)).otherwise(0.0)
        return F.struct(F.concat(acc["out"], F.array(v)).alias("out"), share.alias("carry"))

    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("carry"))
    g = g.withColumn("fwd", F.aggregate(F.sequence(F.lit(0), last), start, step)["out"])

    def back(v: Column, i: Column) -> Column:
        nxt = F.get("fwd", i + 1)
        return F.when(nxt > F.col("limit"), F.greatest(v, nxt / width(i + 1))).otherwise(v)

    g = g.withColumn("final", F.transform("fwd", back))
    return g.select(KEY, F.explode(F.arrays_zip("rows", "final")).alias("z")).select(
        KEY, F.col("z.rows.date").alias("date"), F.col("z.final").alias("smooth"), *[F.col(f"z.rows.{c}").alias(c) for c in other])


def weekday_weights(series: DataFrame) -> DataFrame:
    """Share of each weekday (Monday = 0) in a product's sales; equal shares without sales."""
    per = series.groupBy(KEY).pivot("wd", list(range(7))).agg(F.sum("qty")) if "wd" in series.columns else \
        series.withColumn("wd", F.weekday("date")).groupBy(KEY).pivot("wd", list(range(7))).agg(F.sum("qty"))
    cols = [F.coalesce(F.col(str(d)), F.lit(0)) for d in range(7)]
    total = sum(cols[1:], cols[0])
    share = [F.when(total > 0, c.cast("double") / total).otherwise(1.0 / 7) for c in cols]
    return per.select(KEY, F.posexplode(F.array(*share)).alias("wd", "weight"))


def calendar_features(series: DataFrame) -> DataFrame:
    d = F.col("date")
    return series.withColumns({
        "day_of_week": F.weekday(d), "day_of_month": F.dayofmonth(d), "month": F.month(d),
        "quarter": F.quarter(d), "is_weekend": (F.weekday(d) >= 5).cast("int"), "week_of_year": F.weekofyear(d)})


# ---- decomposition -----------------------------------------------------------

def decompose(series: DataFrame, value: str, periods: tuple[int, ...],
              allowed: dict[int, Column] | None = None) -> DataFrame:
    """Additive decomposition for every period that fits twice into the series.

    Input has ``product_id, i, n`` and ``value``; output adds ``period, trend, seasonal,
    resid``.  The trend is a centred moving average whose ends are extended along the
    line through the nearest ``period`` points.  All windows share one partitioning.
    ``allowed`` limits a period to the series it is wanted for.
    """
    w = Window.partitionBy(KEY).orderBy("i")
    y = F.col(value).cast("double")
    means = {}
    for p in periods:
        h = p // 2
        full = (F.col("i") >= h) & (F.col("i") <= F.col("n") - 1 - h)
        total = F.sum(y).over(w.rowsBetween(-h, h))
        if p % 2 == 0:
            total = total - 0.5 * (F.lag(y, h).over(w) + F.lead(y, h).over(w))
        means[f"_ma{p}"] = F.when(full, total / p)
    options = [
        F.when((F.col("n") >= 2 * p) & (allowed or {}).get(p, F.lit(True)), F.struct(
            F.lit(p).alias("period"), F.lit(p // 2).alias("h"), F.col(f"_ma{p}").alias("ma")))
        for p in periods
    ]
    keep = [c for c in series.columns]
    long = series.withColumns(means).select(*keep, F.explode(F.array_compact(F.array(*options))).alias("o")).select(
        *keep, "o.period", "o.h", "o.ma")
    i, h, n, p = F.col("i"), F.col("h"), F.col("n"), F.col("period")
    back = n - 1 - h
    each = Window.partitionBy(KEY, "period")
    head = F.when((i >= h) & (i < F.least(h + p, back)), F.col("ma"))
    tail = F.when((i >= F.greatest(h, back - p)) & (i < back), F.col("ma"))
    x = i.cast("double")
    long = long.withColumns({
        "_hs": F.regr_slope(head, x).over(each), "_hi": F.regr_intercept(head, x).over(each),
        "_ts": F.regr_slope(tail, x).over(each), "_ti": F.regr_intercept(tail, x).over(each)})
    trend = F.when(i < h, x * F.col("_hs") + F.col("_hi")).when(i > back, x * F.col("_ts") + F.col("_ti")).otherwise(F.col("ma"))
    long = long.withColumn("trend", trend).withColumn("_off", y - F.col("trend"))
    phase = Window.partitionBy(KEY, "period", (i % p))
    long = long.withColumns({"_ph": F.avg("_off").over(phase), "_pc": F.count(F.lit(1)).over(phase)})
    centre = F.sum(F.col("_ph") / F.col("_pc")).over(each) / p
    long = long.withColumn("seasonal", F.col("_ph") - centre)
    return long.withColumn("resid", F.col("_off") - F.col("seasonal")).select(
        *keep, "period", "trend", "seasonal", "resid")


def seasonality(parts: DataFrame, floor: float = 0.0) -> DataFrame:
    """Strongest period per product: var(S) / (var(S) + var(R)); ties keep the shorter one."""
    s = parts.groupBy(KEY, "period").agg(
        F.var_pop("seasonal").alias("vs"), F.var_pop("resid").alias("vr"))
    s = s.withColumn("strength", F.when(F.col("vs") + F.col("vr") > 0, F.col("vs") / (F.col("vs") + F.col("vr"))).otherwise(0.0))
    best = F.max_by(F.struct("period", "strength"), F.struct(F.round("strength", 9), -F.col("period")))
    return s.groupBy(KEY).agg(best.alias("b")).select(
        KEY, F.when(F.col("b.strength") > floor, F.col("b.period")).alias("period"), F.col("b.strength").alias("strength"))


def trend_slope(series: DataFrame) -> DataFrame:
    """Least-squares slope of the numbered series; flat below one hundredth."""
    g = series.groupBy(KEY).agg(F.max("n").alias("n"), slope(F.col("i"), F.col("qty")).alias("s"))
    s, direction = trend_rule(F.col("n"), F.col("s"))
    return g.select(KEY, "n", s.alias("slope"), direction.alias("direction"))


def trend_rule(n: Column, fitted: Column) -> tuple[Column, Column]:
    """Slope (0 below seven rows) and direction."""
    s = F.when(n >= 7, F.coalesce(fitted, F.lit(0.0))).otherwise(0.0)
    return s, F.when(F.abs(s) < 0.01, "flat").when(s > 0, "increasing").otherwise("decreasing")


# Thresholds of the segment rules.
CV_STABLE, CV_VOLATILE, ZERO_SHARE, SEASONAL = 0.4, 0.6, 0.25, 0.3
SEGMENT_PERIODS = (7, 14, 30, 90)


def segment_rule(cv: Column, zeros: Column, strength: Column, slope_: Column, trend_threshold: float) -> Column:
    return (
        F.when(zeros > ZERO_SHARE, "INTERMITTENT")
        .when(strength > SEASONAL, F.when(cv < CV_STABLE, "SEASONAL_STABLE").otherwise("SEASONAL_VOLATILE"))
        .when(cv > CV_VOLATILE, "VOLATILE")
        .when(cv < CV_STABLE, F.when(F.abs(slope_) > trend_threshold, "STABLE_TRENDING").otherwise("STABLE_FLAT"))
        .otherwise("MODERATE"))


def segments(series: DataFrame, trend_threshold: float = 0.05) -> DataFrame:
    """Demand segment, recommended model and confidence of every product.

    ``trend_threshold=0`` treats every non-zero slope as a trend.
    """
    # One pass over the numbered rows gives the moments and the line.
    s = numbered(series).where(F.col(KEY).isNotNull())
    q = F.col("qty").cast("bigint")
    n, tot, sq = F.count(F.lit(1)), F.sum(q), F.sum(q * q)
    stats = s.groupBy(KEY).agg(
        n.alias("rows"), (tot.cast("double") / n).alias("mean"), population_sd(n, tot, sq).alias("sd"),
        (F.count_if(q == 0) / n).alias("zero_share"), slope(F.col("i"), F.col("qty")).alias("_s"))
    best = batched.seasonality(series, SEGMENT_PERIODS, 14)
    line, direction = trend_rule(F.col("rows"), F.col("_s"))
    df = stats.join(best, KEY, "left").withColumns({"slope": line, "direction": direction}).drop("_s")
    cv = F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(999.0)
    df = df.withColumns({"cv": cv, "strength": F.coalesce("strength", F.lit(0.0))})
    seg = F.when(F.col("rows") < 14, "INSUFFICIENT_DATA").otherwise(segment_rule(
        F.col("cv"), F.col("zero_share"), F.col("strength"), F.col("slope"), trend_threshold))
    # Model and confidence of every segment.
    table = {
        "INSUFFICIENT_DATA": ("simple_average", "low"), "INTERMITTENT": ("croston", "high"),
        "SEASONAL_STABLE": ("sarima", "high"), "SEASONAL_VOLATILE": ("prophet", "medium"),
        "VOLATILE": ("xgboost", "medium"), "STABLE_TRENDING": ("prophet", "high"),
        "STABLE_FLAT": ("exponential_smoothing", "high"), "MODERATE": ("arima", "medium")}
    model = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[0])])
    conf = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[1])])
    return df.withColumn("segment", seg).withColumns({
        "recommended_model": model[F.col("segment")], "confidence": conf[F.col("segment")]})


# ---- exponential smoothing as weighted sums -----------------------------------

def smoothing_weight(back: Column, first: Column, alpha: float) -> Column:
    """Weight of the value ``back`` steps before the end; the first value keeps the rest."""
    return F.pow(F.lit(1.0 - alpha), back) * F.when(first, 1.0).otherwise(alpha)


def smoothed_level(series: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Single exponential smoothing at the end of the series, as one weighted sum."""
    s = numbered(series)
    w = smoothing_weight(F.col("n") - 1 - F.col("i"), F.col("i") == 0, alpha)
    return s.groupBy(KEY).agg(F.sum(F.col("qty") * w).alias("level"), F.max("n").alias("n"))


def ordered_values(series: DataFrame) -> DataFrame:
    """Each product's values in time order; as long as the calendar at most."""
    return series.groupBy(KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("date", F.col("qty").cast("double").alias("y")))),
                    lambda r: r["y"]).alias("ys"))


def holt_level(series: DataFrame, alpha: float = 0.3, beta: float = 0.3) -> DataFrame:
    """Double smoothing: the last fitted value (level plus trend)."""
    g = ordered_values(series)

    def step(acc: Column, y: Column) -> Column:
        level = alpha * y + (1 - alpha) * (acc["level"] + acc["trend"])
        return F.struct(level.alias("level"),
                        (beta * (level - acc["level"]) + (1 - beta) * acc["trend"]).alias("trend"))

    first, second = F.get("ys", F.lit(0)), F.get("ys", F.lit(1))
    state = F.aggregate(F.slice("ys", 2, F.greatest(F.size("ys") - 1, F.lit(0))),
                        F.struct(first.alias("level"), (second - first).alias("trend")), step)
    return g.withColumn("_s", F.when(F.size("ys") >= 2, state)).select(
        KEY, F.coalesce(F.col("_s.level") + F.col("_s.trend"), first).alias("holt"), F.size("ys").alias("n"))


def line_fit(series: DataFrame) -> DataFrame:
    s = numbered(series)
    i, q = F.col("i").cast("bigint"), F.col("qty").cast("bigint")
    b = slope(i, q)
    g = s.groupBy(KEY).agg(F.max("n").alias("n"), b.alias("slope"), F.sum(q).alias("sy"), F.sum(i).alias("sx"))
    g = g.withColumn("slope", F.coalesce("slope", F.lit(0.0)))
    icpt = F.col("sy").cast("double") / F.col("n") - F.col("slope") * F.col("sx") / F.col("n")
    return g.select(KEY, "n", "slope", icpt.alias("intercept"))


def trailing_decomposition(series: DataFrame, period: int = 7) -> DataFrame:
    """Decomposition on a trailing mean; series under two periods keep their values as trend."""
    s = numbered(series)
    q = F.col("qty").cast("bigint")
    frame = Window.partitionBy(KEY).orderBy("i").rowsBetween(-(period - 1), 0)
    short = F.col("n") < 2 * period
    mean = F.sum(q).over(frame).cast("double") / F.count(F.lit(1)).over(frame)
    s = s.withColumn("trend", F.when(short, q.cast("double")).otherwise(mean))
    s = s.withColumn("_off", q - F.col("trend"))
    ph = Window.partitionBy(KEY, F.col("i") % period)
    s = s.withColumns({"_ph": F.avg("_off").over(ph), "_pc": F.count(F.lit(1)).over(ph)})
    centre = F.sum(F.col("_ph") / F.col("_pc")).over(Window.partitionBy(KEY)) / period
    s = s.withColumn("seasonal", F.when(short, 0.0).otherwise(F.col("_ph") - centre))
    return s.withColumn("resid", q - F.col("trend") - F.col("seasonal")).drop("_off", "_ph", "_pc")


def croston(daily: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Intermittent demand rate: smoothed size over smoothed interval, with a 95 % band.

    The gaps come from the dates, so the silent days need not be generated.
    """
    w = Window.partitionBy(KEY).orderBy("date")
    sold = daily.filter("qty > 0").withColumns({
        "k": F.row_number().over(w), "m": F.count(F.lit(1)).over(Window.partitionBy(KEY)),
        "gap": F.datediff("date", F.lag("date").over(w))})
    q = F.col("qty").cast("bigint")
    wt = F.when(F.col("k") >= 2, smoothing_weight(F.col("m") - F.col("k"), F.col("k") == 2, alpha))
    n, tot, sq = F.count(F.lit(1)), F.sum(q), F.sum(q * q)
    g = sold.groupBy(KEY).agg(
        n.alias("sales"), F.sum(wt * q).alias("size"), F.sum(wt * F.col("gap")).alias("interval"),
        (tot.cast("double") / n).alias("mean_positive"), population_sd(n, tot, sq).alias("sd"))
    rate = F.when(F.col("sales") < 2, F.col("mean_positive")).when(
        F.col("interval") > 0, F.col("size") / F.col("interval")).otherwise(0.0)
    g = g.withColumn("rate", rate)
    return g.select(KEY, "sales", "size", "interval", "rate",
                    F.greatest(F.lit(0.0), F.col("rate") - 1.96 * F.col("sd")).alias("lower"),
                    (F.col("rate") + 1.96 * F.col("sd")).alias("upper"))
