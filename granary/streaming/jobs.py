"""Stock ledger, snapshot sync, alerting and roll-ups as streams.

A table is read as a folder of files (or a single file) in any order, with a limit on bytes per
trigger.  Nothing is dropped for being late.  Results that depend on the order of events (ledger,
alert suppression) are keyed state with a summary of every run of time, so a late row takes its place and corrects
what came after it.  Tables are merged part by part under the number of the batch, so a batch
rewrites what it touches and a retry changes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from granary.functions.prefix import running_totals, work_folder
from granary.streaming.parts import PartTable, bucket, month, newest
from granary.streaming.state import LEAF, NEVER, Ledger, Suppression

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BYTES_PER_TRIGGER = 1 << 30
#: Parts of tables that hold one row per key; a batch rewrites those that its keys fall in.
BUCKETS = 64


def read_files(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream over the table ``name`` of a folder, be it a file or a folder of files."""
    path = f"{folder}/{name}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    path = f"{path[:-1]}[{path[-1]}]"  # as a pattern, which may stand for a single file too
    if files_per_trigger:
        return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return reader.option("maxBytesPerTrigger", BYTES_PER_TRIGGER).parquet(path)


def run_to_files(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process what is there, write Parquet next to the query's own checkpoint, read it back."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    base = folder or work_folder(spark, "stream")
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None):
    """Start ``step(batch, number)`` over what is there, or every ``interval``."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a table that is written as ``version=N`` folders."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    names = [f.getPath().getName() for f in files.listStatus(root)]
    numbers = [int(n.partition("=")[2]) for n in names if n.startswith("version=")]
    return spark.read.parquet(f"{path}/version={max(numbers)}") if numbers else None


def keyed(rows: DataFrame, keys: list[str], processor, shape: str) -> DataFrame:
    """Stream of what ``processor`` gives for the rows of each key; its state lies in RocksDB."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, shape, "update", "none")


# ---- stock ledger ---------------------------------------------------------------

LEDGER = "sku long, events long, floor long, total long"


def ledger_job(events: DataFrame, path: str, checkpoint: str, interval: str | None = None, leaf: int = LEAF,
               buckets: int = BUCKETS):
    """Keeps what all events of a sku (columns sku, ts, event_id, delta) do to its stock; see ``ledger_stock``.

    ``leaf`` is the number of events of an entry of the state.
    """
    table = PartTable(events.sparkSession, path, LEDGER)
    never = F.lit(NEVER)  # rows without a time come first, as they do in the batch form
    rows = events.select(
        F.col("sku").cast("long").alias("sku"), F.coalesce(F.unix_micros("ts"), never).alias("us"),
        F.coalesce(F.col("event_id").cast("long"), never).alias("event_id"), F.coalesce(F.col("delta").cast("long"), F.lit(0)).alias("delta"))

    def step(batch: DataFrame, number: int) -> None:
        # A sku is in one row of a batch, which replaces the one before.
        table.merge(batch, bucket(["sku"], buckets), number, newest(["sku"], ["events", "floor", "total"], []))

    return run_batches(keyed(rows, ["sku"], Ledger(leaf), LEDGER), step, checkpoint, interval)


def ledger_stock(spark: SparkSession, path: str, opening: DataFrame | None = None) -> DataFrame:
    """Stock per sku after the last batch; with ``opening`` (sku, stock), unknown skus are left out."""
    rows = PartTable(spark, path, LEDGER).read()
    if opening is None:
        start = F.lit(0)
    else:
        rows = rows.join(opening.groupBy("sku").agg(F.max("stock").alias("start")), "sku")
        start = F.col("start")
    return rows.select("sku", "events", F.greatest("floor", start + F.col("total")).cast("long").alias("stock"))


def known_skus(events: DataFrame, opening: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events of known skus, rejected events)."""
    skus = opening.select("sku").distinct()
    return events.join(skus, "sku", "left_semi"), events.join(skus, "sku", "left_anti")


def ledger_batch(events: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """Final stock per sku of a log: every event is added in time order and cut off at zero.

    In closed form the stock is s + S - min(0, s + m), with s the opening stock, S the total and m
    the lowest prefix sum.  The prefix sums are taken over slices of the ordered log, so one sku may
    own any share of the events.  With ``opening`` (sku, stock), events of unknown skus are rejected.
    """
    if opening is not None:
        events = known_skus(events, opening)[0]
    run = running_totals(events.select("sku", "ts", "event_id", "delta"), [F.col("ts"), F.col("event_id")],
                         {"s": "delta"}, keys=("sku",))
    moved = run.groupBy("sku").agg(F.count(F.lit(1)).alias("events"), F.max("s_total").alias("total"), F.min("s").alias("low"))
    if opening is None:
        start = F.lit(0)
    else:
        moved = moved.join(opening.groupBy("sku").agg(F.max("stock").alias("start")), "sku")
        start = F.col("start")
    return moved.select("sku", "events", (start + F.col("total") - F.least(F.lit(0), start + F.col("low"))).cast("long").alias("stock"))


def event_deltas(events: DataFrame) -> DataFrame:
    """Purchases take one unit, sign-ups bring three, everything else is neutral."""
    delta = F.when(F.col("event_type") == "purchase", -1).when(F.col("event_type") == "signup", 3).otherwise(0)
    return events.select(F.col("user_id").alias("sku"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
                         delta.cast("long").alias("delta"))


# ---- snapshots --------------------------------------------------------------------

def latest_counts(counts: DataFrame, *more: str) -> DataFrame:
    """Last absolute count per sku (ties by event id)."""
    return counts.groupBy("sku").agg(
        F.max_by(F.struct("stock", "ts", *more), F.struct("ts", "event_id")).alias("c")).select("sku", "c.*")


COUNTS = "sku long, stock long, ts timestamp, event_id long"


def sync_snapshots(counts: DataFrame, path: str, checkpoint: str, interval: str | None = None, buckets: int = BUCKETS):
    """Keeps the latest count per sku (ties by event id); a batch rewrites the buckets of its skus."""
    table = PartTable(counts.sparkSession, path, COUNTS)

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select("sku", F.col("stock").cast("long").alias("stock"), "ts", "event_id")
        table.merge(latest_counts(rows, "event_id"), bucket(["sku"], buckets), number,
                    newest(["sku"], ["stock", "ts", "event_id"], ["ts", "event_id"]))

    return run_batches(counts, step, checkpoint, interval)


def synced(spark: SparkSession, path: str) -> DataFrame:
    """Latest counts after the last batch."""
    return PartTable(spark, path, COUNTS).read().select("sku", "stock", "ts")


# ---- alerting ---------------------------------------------------------------------

FATES = "alert_key string, channel string, id long, ts timestamp, sent boolean"


def dedupe_job(alerts: DataFrame, path: str, checkpoint: str, minutes: int = 120, interval: str | None = None,
               horizon: dt.timedelta | None = None, leaf: int = LEAF):
    """Alerts that go out (columns alert_key, channel, id, ts), corrected when an earlier one arrives late.

    Alerts without a time never go out.  ``horizon`` forgets what is older than a key's newest alert by more.
    """
    table = PartTable(alerts.sparkSession, path, FATES)
    window = minutes * 60 * 1_000_000
    age = None if horizon is None else horizon // dt.timedelta(microseconds=1)
    rows = alerts.select("alert_key", "channel", F.col("id").cast("long").alias("id"), F.unix_micros("ts").alias("us")).where("us is not null")
    changes = keyed(rows, ["alert_key", "channel"], Suppression(window, age, leaf),
                    "alert_key string, channel string, id long, us long, sent boolean")

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("ts", F.timestamp_micros("us"))
        table.merge(rows, month("ts"), number, newest(["alert_key", "channel", "id"], ["ts", "sent"], []))

    return run_batches(changes, step, checkpoint, interval)


def sent_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts that go out, as known after the last batch."""
    return PartTable(spark, path, FATES).read().where("sent").drop("sent")


def route(alerts: DataFrame) -> DataFrame:
    """One row per alert and channel: e-mail when asked for, chat for critical and high."""
    hot = F.upper("severity").isin("CRITICAL", "HIGH")
    channels = F.array_compact(F.array(
        F.when(F.col("send_email"), "EMAIL"), F.when(hot, "SLACK"), F.when(hot, "TEAMS")))
    key = F.concat_ws(":", "type", F.col("product_id").cast("string"))
    return alerts.select("product_id", "type", "severity", key.alias("alert_key"), F.explode(channels).alias("channel"))


def evaluate_alerts(sales_stream: DataFrame, evaluate, path: str, checkpoint: str, interval: str | None = None):
    """Run ``evaluate(batch_number) -> alerts`` whenever new sales arrive; routed rows are kept per run."""
    def run(batch: DataFrame, number: int) -> None:
        route(evaluate(number)).write.mode("overwrite").parquet(f"{path}/version={number}")

    return run_batches(sales_stream, run, checkpoint, interval)


# ---- roll-ups ----------------------------------------------------------------------

_SUMS = {"quantity": "long", "revenue": "decimal(38,4)", "rows": "long"}


def _day_table(spark: SparkSession, path: str, keys: dict[str, str]) -> PartTable:
    columns = {"sale_date": "date"} | keys | _SUMS
    return PartTable(spark, path, ", ".join(f"`{n}` {t}" for n, t in columns.items()))


def day_sums(sales: DataFrame, keys: list[str], path: str, checkpoint: str, interval: str | None = None):
    """Sums per day and ``keys``; a batch adds to the months that it holds, however late."""
    kinds = {k: sales.schema[k].dataType.simpleString() for k in keys}
    table = _day_table(sales.sparkSession, path, kinds)

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy("sale_date", *keys).agg(*[F.sum(c).cast(t).alias(c) for c, t in _SUMS.items()])

    def step(batch: DataFrame, number: int) -> None:
        days = batch.groupBy(F.to_date("ts").alias("sale_date"), *keys).agg(
            F.sum("quantity_sold").alias("quantity"), F.sum("revenue").cast(_SUMS["revenue"]).alias("revenue"), F.count(F.lit(1)).alias("rows"))
        table.merge(days, month("sale_date"), number, added)

    return run_batches(sales, step, checkpoint, interval)


def summed(spark: SparkSession, path: str, keys: dict[str, str]) -> DataFrame:
    """Totals per day and ``keys`` (name to type) after the last batch."""
    return _day_table(spark, path, keys).read()


def daily_totals(sales: DataFrame, folder: str | None = None) -> DataFrame:
    """Daily totals of an append feed (columns ts, quantity_sold, revenue)."""
    base = folder or work_folder(sales.sparkSession, "daily")
    day_sums(sales, [], base, f"{base}/state").awaitTermination()
    return summed(sales.sparkSession, base, {}).select(
        "sale_date", F.col("quantity").alias("total_quantity"), F.col("revenue").cast("double").alias("total_revenue"),
        F.col("rows").alias("transactions"))


def sliding_rate(days_sold: DataFrame, key: str, spans: tuple[int, ...] = (30,)) -> DataFrame:
    """Mean daily units of the ``spans`` days before each day that has sales in them.

    The input has one row per key and day.  A sale enters a span on the day after it and leaves it after
    the span, so the sums run over these changes alone and are spread over the days between them.
    """
    dated = days_sold.where("sale_date is not null").select(key, F.unix_date("sale_date").alias("d"), F.col("quantity").cast("long").alias("quantity"))
    known = F.when(F.col("quantity").isNotNull(), 1).otherwise(0)
    changes = F.array(*[
        F.struct(F.lit(n).alias("days"), (F.col("d") + behind).alias("d"), (F.coalesce("quantity", F.lit(0)) * sign).alias("units"),
                 (known * sign).alias("known"), F.lit(sign).alias("seen"))
        for n in spans for behind, sign in ((1, 1), (n + 1, -1))])
    by_span = Window.partitionBy(key, "days").orderBy("d")
    so_far = by_span.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = dated.select(key, F.explode(changes).alias("c")).select(key, "c.*").groupBy(key, "days", "d").agg(
        *[F.sum(c).alias(c) for c in ("units", "known", "seen")])
    runs = moved.select(key, "days", "d", *[F.sum(c).over(so_far).alias(c) for c in ("units", "known", "seen")],
                        (F.lead("d").over(by_span) - 1).alias("upto")).where("seen > 0")
    units = F.when(F.col("known") > 0, F.col("units"))
    return runs.select(key, "days", units.alias("units"), (units.cast("double") / F.col("days")).alias("rate"),
                       F.explode(F.sequence("d", "upto")).alias("until")).select(
        key, "days", F.date_from_unix_date("until").alias("until"), "units", "rate")


def flag_anomalies(sales: DataFrame, baseline: DataFrame, sensitivity: float = 2.0) -> DataFrame:
    """Stateless stream-static join: rows further than ``sensitivity`` deviations from the mean."""
    z = F.when(F.col("sd") > 0, F.abs(F.col("quantity_sold") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return sales.join(baseline, "product_id").withColumn("z", z).filter(F.col("z") > sensitivity).withColumn(
        "severity", F.when(F.col("z") > 3.0, "HIGH").otherwise("MEDIUM"))


def sales_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The line items as a sales feed with an event-time column."""
    lines = read_files(spark, folder, "lineitem.parquet")
    money: Column = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return lines.select(
        F.col("l_partkey").alias("product_id"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_quantity").cast("int").alias("quantity_sold"), money.alias("revenue"))
