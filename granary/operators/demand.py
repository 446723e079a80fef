"""Demand statistics per product.

The engine knows eight definitions of "average daily demand"; every caller names
the one it means.  All of them are one grouped aggregate: the counts and sums
combine on the map side, so one very large product costs one row per map task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = 63  # usable bits in one bigint


def since(sales: DataFrame, as_of: dt.date, days: int | None) -> DataFrame:
    if days is None:
        return sales
    return sales.filter(F.col("date") >= F.lit(as_of - dt.timedelta(days=days)))


def active_day_count(as_of: dt.date, days: int) -> Column:
    """Distinct selling days in a bounded window as bit sets.

    A bit set per day merges on the map side and needs one shuffle; a distinct
    count would shuffle every (product, day) pair first.
    """
    offset = F.datediff(F.lit(as_of), F.col("date"))
    total = F.lit(0)
    for word in range(days // _WORD + 1):
        bit = F.expr("shiftleft(1L, cast(pmod(_o, 63) as int))".replace("_o", f"datediff(date'{as_of}', date)"))
        mask = F.when(F.floor(offset / _WORD) == word, bit).otherwise(F.lit(0).cast("bigint"))
        total = total + F.bit_count(F.bit_or(mask))
    return total.cast("bigint")


def population_sd(n: Column, total: Column, squares: Column) -> Column:
    """Spread from exact integer sums, independent of row order."""
    mean = total.cast("double") / n
    return F.sqrt(F.greatest(F.lit(0.0), squares.cast("double") / n - mean * mean))


def sample_sd(n: Column, total: Column, squares: Column) -> Column:
    t = total.cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (squares.cast("double") - t * t / n) / (n - 1))))


def transaction_stats(sales: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    """Per product over a window: total, active days, squares, rows and row spread."""
    q = F.col("quantity_sold").cast("bigint")
    return (
        since(sales, as_of, days)
        .groupBy("product_id")
        .agg(
            F.sum(q).alias("total_qty"),
            active_day_count(as_of, days).alias("active_days"),
            F.sum(q * q).alias("sum_sq"),
            F.count(F.lit(1)).alias("n_sales"),
        )
        .withColumn(
            "sigma",
            F.when(F.col("n_sales") > 1,
                   population_sd(F.col("n_sales"), F.col("total_qty"), F.col("sum_sq"))),
        )
    )


def daily_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product_id", "date").agg(F.sum("quantity_sold").alias("qty"))


def daily_stats(sales: DataFrame, as_of: dt.date, days: int | None = None) -> DataFrame:
    """Per product: totals, selling days, span and the spread of daily totals.

    Two steps: a product with a third of all rows is first spread over its days,
    so the second step sees at most one row per product and day.
    """
    q = F.col("qty")
    return (
        daily_totals(since(sales, as_of, days))
        .groupBy("product_id")
        .agg(
            F.sum(q).alias("total_qty"),
            F.count(F.lit(1)).alias("active_days"),
            F.sum(q * q).alias("sum_sq"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
        .withColumns({
            "span_days": F.datediff("last_date", "first_date"),
            "sd_daily": sample_sd(F.col("active_days"), F.col("total_qty"), F.col("sum_sq")),
        })
    )


def daily_rate(definition: str, days: int = 30) -> Column:
    """Average daily demand over the columns of the two stats frames."""
    total = F.col("total_qty").cast("double")
    active = F.col("active_days")
    rates = {
        "active": total / F.greatest(active, F.lit(1)),
        "max30": total / F.greatest(active, F.lit(30)),
        "capped": total / F.greatest(F.lit(1), F.least(active, F.lit(90))),
        "fixed": F.greatest(F.lit(1.0), F.ceil(total / days).cast("double")),
        "span": total / (F.col("span_days") + 1) if definition == "span" else None,
        "span0": total / F.greatest(F.lit(1), F.col("span_days")) if definition == "span0" else None,
        "annual": total / active * 365,
    }
    return rates[definition]


def row_average(sales: DataFrame, as_of: dt.date, days: int, name: str) -> DataFrame:
    """Mean quantity per transaction in a window (not per day, by definition)."""
    return (
        since(sales, as_of, days)
        .groupBy("product_id")
        .agg((F.sum("quantity_sold").cast("double") / F.count(F.lit(1))).alias(name))
    )
