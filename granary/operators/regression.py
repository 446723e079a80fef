"""Calendar regression of every product by normal equations.

The features are whole numbers, so their sums and products are exact, and one grouped aggregate holds
all that a fit needs.  The centred normal equations are solved by a Cholesky factor in column
expressions, a row per product.  A feature that is constant, or depends on those before it, gets the
coefficient 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import series as ts

KEY = "product_id"
FEATURES = ("day_of_week", "day_of_month", "month", "quarter", "is_weekend", "week_of_year")
#: The features used where none were selected.
DEFAULT = ("day_of_week", "day_of_month", "month", "is_weekend")


def calendar_fit(series: DataFrame, selected: DataFrame | None = None, rows: Column | None = None) -> DataFrame:
    """``intercept`` and ``coef`` (an array along ``FEATURES``) of demand on the calendar, per product.

    ``selected`` has ``features``, the names to use for each product; ``rows`` limits the rows that count.
    """
    s = ts.calendar_features(series)
    if selected is None:
        use = {f: F.lit(f in DEFAULT) for f in FEATURES}
    else:
        s = s.join(selected.select(KEY, "features"), KEY, "left")
        use = {f: F.array_contains(F.coalesce("features", F.array(*map(F.lit, DEFAULT))), f) for f in FEATURES}
    counts = F.lit(True) if rows is None else rows
    x = [F.when(use[f] & counts, F.col(f)).otherwise(0).cast("long") for f in FEATURES]
    y = F.when(counts, F.col("qty")).otherwise(0).cast("long")
    m = len(x)
    g = s.groupBy(KEY).agg(
        F.count_if(counts).alias("n"), F.sum(y).alias("sy"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)],
        *[F.sum(v * y).alias(f"y{i}") for i, v in enumerate(x)],
        *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(m) for j in range(i + 1)])
    n = F.col("n")
    # Exact n² times covariances; the factor cancels in the solution.
    g = g.select(
        KEY, "n", "sy", *[f"s{i}" for i in range(m)],
        *[(n * F.col(f"y{i}") - F.col(f"s{i}") * F.col("sy")).cast("double").alias(f"b{i}") for i in range(m)],
        *[(n * F.col(f"s{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}")).cast("double").alias(f"a{i}_{j}") for i in range(m) for j in range(i + 1)])

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    for j in range(m):
        rest = F.col(f"a{j}_{j}") - sum((F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
        g = g.withColumn(f"l{j}_{j}", F.when(rest > 1e-9 * F.col(f"a{j}_{j}"), F.sqrt(rest)).otherwise(0.0))
        g = g.withColumns({
            f"l{i}_{j}": ratio(F.col(f"a{i}_{j}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0)), F.col(f"l{j}_{j}"))
            for i in range(j + 1, m)} | {
            f"z{j}": ratio(F.col(f"b{j}") - sum((F.col(f"l{j}_{k}") * F.col(f"z{k}") for k in range(j)), F.lit(0.0)), F.col(f"l{j}_{j}"))})
    for j in reversed(range(m)):
        later = sum((F.col(f"l{i}_{j}") * F.col(f"c{i}") for i in range(j + 1, m)), F.lit(0.0))
        g = g.withColumn(f"c{j}", ratio(F.col(f"z{j}") - later, F.col(f"l{j}_{j}")))
    mean = sum((F.col(f"c{i}") * F.col(f"s{i}") for i in range(m)), F.lit(0.0))
    return g.where("n > 0").select(KEY, ((F.col("sy") - mean) / n).alias("intercept"), F.array(*[f"c{i}" for i in range(m)]).alias("coef"))


def calendar_value() -> Column:
    """Prediction from ``intercept``, ``coef`` and the calendar features of a row."""
    return sum((F.get("coef", F.lit(i)) * F.col(f) for i, f in enumerate(FEATURES)), F.col("intercept"))


def selected_features(series: DataFrame) -> DataFrame:
    """``features`` per product, by ``forecast.feature_selection``."""
    from granary.operators.forecast import feature_selection

    return feature_selection(series).groupBy(KEY).agg(F.collect_set("feature").alias("features"))
