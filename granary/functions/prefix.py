"""Running totals over an ordering that does not fit in one task.

A window without ``partitionBy`` (or over one very large key) sends every row
to a single task.  Here the rows are range-partitioned on the ordering, the
layout is written to the checkpoint folder so that partition numbers can never
change on recomputation, every slice contributes one row of subtotals, and the
running value inside a slice is shifted by the subtotals of the slices before it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SLICE = "_slice"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it gets a private temporary folder.
    """
    current = spark.sparkContext.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="granary-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one, removed when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write a table into the checkpoint folder and read it back.

    Cuts the lineage like a checkpoint, but keeps columns, compression and sizes, so
    later steps prune columns and see how large the table is.
    """
    path = work_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_totals(
    df: DataFrame,
    order: list[Column],
    measures: dict[str, str],
    keys: tuple[str, ...] = (),
    position: str = "position",
) -> DataFrame:
    """Add running and overall totals of ``measures`` along ``order`` within ``keys``.

    For each ``name -> column`` this adds ``name`` (running sum including the
    row) and ``name_total``; ``position`` is the 1-based rank and
    ``position_total`` the row count.  ``order`` must be a total order.
    """
    key_cols = [F.col(k) for k in keys]
    laid_out = materialise(
        df.repartitionByRange(*key_cols, *order).withColumn(_SLICE, F.spark_partition_id())
    )
    subtotals = laid_out.groupBy(*keys, _SLICE).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_s_{n}") for n, c in measures.items()],
    )
    # At most one row per key and slice: small for every key, whatever its size.
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = subtotals.select(
        *keys,
        _SLICE,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
        F.sum("_n").over(whole).alias("_n_all"),
        *[F.sum(f"_s_{n}").over(before).alias(f"_b_{n}") for n in measures],
        *[F.sum(f"_s_{n}").over(whole).alias(f"_t_{n}") for n in measures],
    )
    inside = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = laid_out.join(offsets, [*keys, _SLICE])
    adds = {
        position: F.sum(F.lit(1)).over(inside) + F.col("_n_before"),
        f"{position}_total": F.col("_n_all"),
    }
    for n, c in measures.items():
        local = F.coalesce(F.sum(c).over(inside), F.lit(0))
        adds[n] = local + F.coalesce(F.col(f"_b_{n}"), F.lit(0))
        adds[f"{n}_total"] = F.col(f"_t_{n}")
    out = joined.withColumns(adds)
    return out.select(*df.columns, *adds)


#: Ranks of the sketch are true to one part in so many.
SKETCH = 10_000


def exact_quantiles(df: DataFrame, value: str, fractions: list[float], accuracy: int = SKETCH) -> DataFrame:
    """Linear-interpolated quantiles as one row ``q`` (array of doubles), without laying out the table.

    A sketch gives two values round each quantile.  Rows below the first are counted, and only those
    between the two are grouped by value and ranked, some parts in ten thousand of the table.  Counts tell
    whether the quantile lies between; if a sketch was off, its bounds are widened.  Nulls do not count.
    """
    spark = df.sparkSession
    v = F.col(value)
    rows = df.select(v.cast("double").alias(value)).where(v.isNotNull())
    n = rows.count()
    if not n:
        return spark.createDataFrame([([None] * len(fractions),)], "q array<double>")
    out: dict[float, float] = {}
    margin = 2.0 / accuracy
    while len(out) < len(set(fractions)):
        open_ = [f for f in dict.fromkeys(fractions) if f not in out]
        marks = [x for f in open_ for x in (max(f - margin, 0.0), min(f + margin, 1.0))]
        found = rows.agg(F.percentile_approx(value, marks, accuracy)).first()[0]
        # Beyond the ends of the table there is nothing to miss.
        bounds = {f: (None if marks[2 * k] == 0.0 else found[2 * k], None if marks[2 * k + 1] == 1.0 else found[2 * k + 1]) for k, f in enumerate(open_)}
        below = rows.agg(*[F.lit(0).cast("long") if low is None else F.count_if(v < low) for low, _ in bounds.values()]).first()
        for f, before in zip(open_, below):
            low, high = bounds[f]
            within = rows
            within = within if low is None else within.where(v >= low)
            within = within if high is None else within.where(v <= high)
            ranked = running_totals(within.groupBy(value).agg(F.count(F.lit(1)).alias("rows")), [v], {"upto": "rows"})
            place = f * (n - 1)
            first, second = int(place) + 1, min(int(place) + 2, n)
            at = [F.min(F.when(F.col("upto") + before >= rank, v)) for rank in (first, second)]
            x, y, held = ranked.agg(*at, F.coalesce(F.max("upto_total"), F.lit(0))).first()
            if before < first and before + held >= second:
                out[f] = x + (y - x) * (place - int(place))
        margin *= 8
    return spark.createDataFrame([([out[f] for f in fractions],)], "q array<double>")
