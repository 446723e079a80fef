"""ABC and Pareto classes, profitability categories and windowed series features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.mathx import ratio
from granary.functions.prefix import running_totals


def abc_by_value(df: DataFrame, value: str, key: str = "product_id", a: float = 80.0, b: float = 95.0) -> DataFrame:
    """ABC by cumulative share; the row that crosses a limit belongs to the next class.

    ``value`` must be exact (decimal) so that the running share does not depend on
    the order in which slices are summed.
    """
    run = running_totals(df, [F.col(value).desc(), F.col(key)], {"_cum": value}, position="value_rank")
    share = ratio(F.col("_cum").cast("double"), F.col("_cum_total").cast("double"), 1.0) * 100
    run = run.withColumns({"cumulative_pct": share, "total_value": F.col("_cum_total").cast("double")})
    return run.withColumn(
        "abc_class", F.when(F.col("cumulative_pct") <= a, "A").when(F.col("cumulative_pct") <= b, "B").otherwise("C")
    ).drop("_cum", "_cum_total", "value_rank_total")


def abc_by_rank(df: DataFrame, value: str, key: str = "product_id") -> DataFrame:
    """ABC by rank fraction: first fifth A, next three tenths B, rest C."""
    run = running_totals(df, [F.col(value).desc(), F.col(key)], {}, position="pos")
    frac = (F.col("pos") - 1) / F.col("pos_total")
    cls = F.when(frac < 0.2, "A").when(frac < 0.5, "B").otherwise("C")
    return run.withColumn("abc_class", cls).withColumns({
        "service_level": F.when(F.col("abc_class") == "A", 0.97).when(F.col("abc_class") == "B", 0.95).otherwise(0.90),
        "priority": F.when(F.col("abc_class") == "A", "HIGH").when(F.col("abc_class") == "B", "MEDIUM").otherwise("LOW"),
    })


def profitability(df: DataFrame) -> DataFrame:
    """ABC with margins, stock value and days of inventory (needs ``annual_units``)."""
    u, stock = F.col("annual_units"), F.col("current_stock")
    exact = (u.cast("decimal(18,4)") * F.col("unit_price").cast("decimal(12,2)")).cast("decimal(28,4)")
    df = df.withColumn("_rev", exact)
    df = abc_by_value(df, "_rev").withColumn("annual_revenue", F.col("_rev").cast("double")).drop("_rev")
    margin = F.col("annual_revenue") - u * F.col("unit_cost")
    df = df.withColumns({
        "annual_margin": margin, "inventory_value": stock * F.col("unit_cost"),
        "days_of_inventory": ratio(stock, u / 365)})
    return df.withColumn("margin_pct", ratio(F.col("annual_margin"), F.col("annual_revenue")) * 100)


def seven_way(abc: Column, margin: Column, days: Column) -> Column:
    return (
        F.when(abc == "A", F.when(margin > 40, "STAR").when(days > 90, "CASH_COW").otherwise("CORE"))
        .when(abc == "B", F.when(margin < 20, "PROBLEM_CHILD").otherwise("STEADY"))
        .otherwise(F.when(days > 180, "DEAD_STOCK").otherwise("NICHE")))


def is_dead_stock() -> Column:
    return (F.col("annual_units") < 50) & (F.col("current_stock") > F.col("annual_units") * 0.5)


def dead_stock(profit: DataFrame, top: int = 5, off: float = 0.4) -> DataFrame:
    """Clearance list in revenue order: price, proceeds and loss at 40 % off."""
    price = F.col("unit_cost") * (1 - off)
    proceeds = F.col("current_stock") * price
    return profit.filter(is_dead_stock()).orderBy(F.col("annual_revenue").desc(), "product_id").limit(top).select(
        "product_id", "current_stock", "inventory_value", price.alias("clearance_price"),
        proceeds.alias("clearance_revenue"), (F.col("inventory_value") - proceeds).alias("loss"))


def margin_opportunities(profit: DataFrame, threshold: float = 50.0, top: int = 5) -> DataFrame:
    return profit.filter(F.col("margin_pct") > threshold).orderBy(
        F.col("margin_pct").desc(), "product_id").limit(top).select(
        "product_id", "annual_margin", "margin_pct", (F.col("annual_revenue") * 2).alias("doubled_revenue"))


def class_summary(profit: DataFrame) -> DataFrame:
    exact = F.round("annual_revenue", 4).cast("decimal(24,4)")
    return profit.groupBy("abc_class").agg(
        F.count(F.lit(1)).alias("products"), F.sum(exact).cast("double").alias("revenue"),
        F.count_if(is_dead_stock()).alias("dead_stock"))


def class_advice(profit: DataFrame) -> DataFrame:
    advice = F.create_map(*[F.lit(x) for x in ("A", "95-99", "B", "90-95", "C", "BULK")])
    dead = profit.agg(F.count_if(is_dead_stock()).alias("n")).select(
        F.lit("DEAD").alias("abc_class"), F.col("n").alias("products"), F.lit("CLEARANCE").alias("advice"))
    return profit.groupBy("abc_class").agg(F.count(F.lit(1)).alias("products")).withColumn(
        "advice", advice[F.col("abc_class")]).unionByName(dead)


# ---- windowed features over (product_id, date, qty) ------------------------

def by_time() -> "Window":
    return Window.partitionBy("product_id").orderBy("date")


def moving_average(series: DataFrame, window: int = 7) -> DataFrame:
    """Trailing mean, expanding until full; a series shorter than the window is unchanged."""
    frame = by_time().rowsBetween(-(window - 1), 0)
    n = F.count(F.lit(1)).over(Window.partitionBy("product_id"))
    q = F.col("qty").cast("bigint")
    mean = F.sum(q).over(frame).cast("double") / F.count(F.lit(1)).over(frame)
    return series.withColumn("ma", F.when(n < window, F.col("qty").cast("double")).otherwise(mean))


def weighted_moving_average(series: DataFrame, window: int = 7) -> DataFrame:
    """Linearly weighted trailing mean: the newest row weighs most; the start uses fewer rows."""
    w = by_time()
    i = F.row_number().over(w)
    n = F.count(F.lit(1)).over(Window.partitionBy("product_id"))
    size = F.least(i, F.lit(window)).cast("bigint")
    total = F.lit(0).cast("bigint")
    for back in range(window):
        value = F.coalesce(F.lag("qty", back).over(w), F.lit(0)).cast("bigint")
        total = total + value * F.greatest(F.lit(0).cast("bigint"), size - back)
    mean = total.cast("double") / (size * (size + 1) / 2)
    return series.withColumn("wma", F.when(n < window, F.col("qty").cast("double")).otherwise(mean))


def lag_features(series: DataFrame, lags: tuple[int, ...], windows: tuple[int, ...], own: bool = True) -> DataFrame:
    """Lagged values and rolling mean and sample deviation (0 when undefined).

    Without ``own`` the rolling windows end before the row, so that they do not tell its value;
    the first row then has no mean.
    """
    w = by_time()
    q = F.col("qty").cast("bigint")
    out = {f"lag_{k}": F.lag("qty", k).over(w) for k in lags}
    for k in windows:
        frame = w.rowsBetween(-(k - 1), 0) if own else w.rowsBetween(-k, -1)
        n, s, ss = F.count(F.lit(1)).over(frame), F.sum(q).over(frame), F.sum(q * q).over(frame)
        out[f"mean_{k}"] = s.cast("double") / n if own else ratio(s.cast("double"), n)
        t = s.cast("double")
        out[f"sd_{k}"] = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (ss.cast("double") - t * t / n) / (n - 1)))).otherwise(0.0)
    return series.withColumns(out)


def trend_acceleration(series: DataFrame, window: int = 7) -> DataFrame:
    """Change of the short-minus-long moving average over four steps, at the last row."""
    w = by_time()
    q = F.col("qty").cast("bigint")

    def full_mean(k: int) -> Column:
        frame = w.rowsBetween(-(k - 1), 0)
        return F.when(F.count(F.lit(1)).over(frame) == k, F.sum(q).over(frame).cast("double") / k)

    df = series.withColumns({
        "short": full_mean(window), "long": full_mean(2 * window),
        "rn": F.row_number().over(Window.partitionBy("product_id").orderBy(F.col("date").desc()))})
    df = df.withColumn("_gap", F.col("short") - F.col("long")).withColumns({
        "previous_gap": F.lag("_gap", 4).over(w), "previous_short": F.lag("short", 4).over(w)})
    last = df.filter((F.col("rn") == 1) & F.col("previous_gap").isNotNull()).withColumn(
        "acceleration", F.col("_gap") - F.col("previous_gap"))
    a = F.col("acceleration")
    status = F.when(F.abs(a) < F.col("long") * 0.02, "STABLE").when(a > 0, "ACCELERATING").otherwise("DECELERATING")
    factor = F.when(status == "ACCELERATING", 1.05).when(status == "DECELERATING", 0.95).otherwise(1.0)
    return last.select("product_id", F.col("short").alias("current_mean"), "previous_short", "acceleration",
                       status.alias("status"), (F.col("short") * factor).alias("next_forecast"))


def anomalies(recent: DataFrame, sensitivity: float = 2.0, min_rows: int = 7) -> DataFrame:
    """Rows of the last values whose distance from the mean exceeds ``sensitivity`` deviations.

    ``recent`` holds at most N rows per product (``rn`` counts back from the last).
    """
    w = Window.partitionBy("product_id")
    q = F.col("qty").cast("bigint")
    n, s, ss = F.count(F.lit(1)).over(w), F.sum(q).over(w), F.sum(q * q).over(w)
    mean = s.cast("double") / n
    df = recent.withColumns({
        "n": n, "mean": mean,
        "sd": F.sqrt(F.greatest(F.lit(0.0), ss.cast("double") / n - mean * mean))})
    z = F.when(F.col("sd") > 0, F.abs(F.col("qty") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    df = df.filter(F.col("n") >= min_rows).withColumn("z", z).filter(F.col("z") > sensitivity)
    found = F.count(F.lit(1)).over(w)
    return df.withColumns({
        "severity": F.when(F.col("z") > 3.0, "HIGH").otherwise("MEDIUM"),
        "overall": F.when(found > 3, "HIGH").otherwise("MEDIUM"),
        "deviation_pct": F.when(F.col("mean") > 0, (F.col("qty") - F.col("mean")) / F.col("mean") * 100).otherwise(0.0)})


def promotion_lift(labelled: DataFrame, cost: float = 500.0, margin: float = 10.0) -> DataFrame:
    """Means before, during and after; lift, uplift, carry-over, payback and return.

    ``labelled`` has ``product_id``, ``phase`` (pre, during, post) and ``qty`` per day.
    """
    ph, q = F.col("phase"), F.col("qty")

    def mean(p: str) -> Column:
        return F.sum(F.when(ph == p, q)).cast("double") / F.nullif(F.count_if(ph == p), F.lit(0))

    g = labelled.groupBy("product_id").agg(
        mean("pre").alias("pre"), mean("during").alias("during"), mean("post").alias("post"),
        F.count_if(ph == "during").alias("n")).filter("pre is not null and during is not null")
    pre, dur, post = F.col("pre"), F.col("during"), F.col("post")
    g = g.withColumns({
        "lift_pct": F.when(pre > 0, (dur - pre) / pre * 100).otherwise(0.0), "uplift": (dur - pre) * F.col("n")})
    roi = ratio(F.col("uplift") * margin - cost, cost) * 100
    return g.withColumns({
        "carryover_pct": F.when(pre > 0, (post - pre) / pre * 100),
        "payback_days": F.when(post > pre, F.col("uplift") / (post - pre)).when(post.isNotNull(), 0.0),
        "roi_pct": roi,
        "verdict": F.when(roi > 50, "HIGHLY_EFFECTIVE").when(roi > 0, "EFFECTIVE").otherwise("LOW_RETURN")})
