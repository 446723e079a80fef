"""Streaming queries: each runs over the files that are there and returns its output table."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.prefix import work_folder
from granary.operators.demand import population_sd
from granary.plans.inventory import ALERTS, _alerts
from granary.plans.registry import query
from granary.streaming import jobs
from granary.streaming.dedupe import dedupe_log

# Opening stock: customers stand for skus; users without a customer row are unknown and rejected.
OPENING = "select c_custkey as sku, cast(greatest(0, floor(c_acctbal / 1000)) as bigint) as stock from customer where c_custkey % 7 <> 3"
DELTA = "select user_id as sku, ts, event_id, case event_type when 'purchase' then -1 when 'signup' then 3 else 0 end as delta from events"
LEDGER = """select sku, count(*) as events, cast(max(start) + max(case when last then s end) - least(0, max(start) + min(s)) as bigint) as stock from (
   select d.*, o.stock as start, sum(delta) over (partition by d.sku order by ts, event_id) as s,
     row_number() over (partition by d.sku order by ts desc, event_id desc) = 1 as last from deltas d join opening o on d.sku = o.sku) group by sku"""
LEDGER_CTES = {"deltas": DELTA, "opening": OPENING, "ledger": LEDGER}


def _opening(t):
    stock = F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 1000)).cast("long")
    return t.raw("customer").filter("c_custkey % 7 <> 3").select(F.col("c_custkey").alias("sku"), stock.alias("stock"))


@query("STR01", "select * from ledger", "", LEDGER_CTES)
def str01(t):
    return jobs.ledger_batch(jobs.event_deltas(t.raw("events")), _opening(t))


@query("STR01_stream", "select sku, stock from ledger", "", LEDGER_CTES)
def str01_stream(t):
    stream = jobs.event_deltas(jobs.read_files(t.spark, t.folder, "events.parquet"))
    base = work_folder(t.spark, "ledger")
    jobs.ledger_job(stream, base, f"{base}/state").awaitTermination()
    return jobs.ledger_stock(t.spark, base, _opening(t)).select("sku", "stock")


@query("STR01_rejected", "select sku, count(*) as events from deltas where sku not in (select sku from opening) group by sku", "", LEDGER_CTES)
def str01_rejected(t):
    rejected = jobs.known_skus(jobs.event_deltas(t.raw("events")), _opening(t))[1]
    return rejected.groupBy("sku").agg(F.count(F.lit(1)).alias("events"))


COUNTS = """select user_id as sku, cast(arg_max(floor("value"), {'a': ts, 'b': event_id}) as int) as stock, max(ts) as ts from events where event_type = 'view' group by user_id"""


def _counts(events):
    """View events stand for stock counts; the other kinds of event are no counts."""
    return events.filter("event_type = 'view'").select(
        F.col("user_id").alias("sku"), F.floor("value").cast("int").alias("stock"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


@query("STR02", COUNTS)
def str02(t):
    return jobs.latest_counts(_counts(t.events))


@query("STR02_stream", COUNTS)
def str02_stream(t):
    base = work_folder(t.spark, "counts")
    jobs.sync_snapshots(_counts(jobs.read_files(t.spark, t.folder, "events.parquet")), base, f"{base}/state").awaitTermination()
    return jobs.synced(t.spark, base).withColumn("stock", F.col("stock").cast("int"))


ERRORS = "select 'user-' || user_id as alert_key, 'EMAIL' as channel, event_id as id, ts from events where event_type = 'error'"
SENT = """select alert_key, channel, min(ts) as ts from errors group by alert_key, channel
  union all select alert_key, channel, (select min(e.ts) from errors e where e.alert_key = s.alert_key and e.ts > s.ts + interval 120 minutes) from sent s where s.ts is not null"""
KEPT = """select s.alert_key, s.channel, min(e.id) as id, s.ts from sent s join errors e on s.alert_key = e.alert_key and s.ts = e.ts group by s.alert_key, s.channel, s.ts"""
SENT_CTES = {"errors": ERRORS, "sent": SENT, "kept": KEPT}


def _errors(events):
    return events.filter("event_type = 'error'").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("alert_key"), F.lit("EMAIL").alias("channel"),
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))


@query("STR04", "select * from kept", "", SENT_CTES)
def str04(t):
    return dedupe_log(_errors(t.raw("events")))


@query("STR04_stream", "select * from kept", "", SENT_CTES)
def str04_stream(t):
    base = work_folder(t.spark, "alerts")
    jobs.dedupe_job(_errors(jobs.read_files(t.spark, t.folder, "events.parquet")), base, f"{base}/state").awaitTermination()
    return jobs.sent_alerts(t.spark, base)


ROUTED = """select product_id, type, severity, type || ':' || product_id as alert_key, unnest(list_filter([case when send_email then 'EMAIL' end, case when severity in ('CRITICAL', 'HIGH') then 'SLACK' end,
   case when severity in ('CRITICAL', 'HIGH') then 'TEAMS' end], lambda x: x is not null)) as channel from alerts"""


@query("STR03", ROUTED, "", {"alerts": ALERTS})
def str03(t):
    base = work_folder(t.spark, "runs")
    feed = jobs.sales_stream(t.spark, t.folder)
    jobs.evaluate_alerts(feed, lambda number: _alerts(t), f"{base}/runs", f"{base}/state").awaitTermination()
    return jobs.latest_version(t.spark, f"{base}/runs")


@query("STR05", ROUTED, "", {"alerts": ALERTS})
def str05(t):
    return jobs.route(_alerts(t))


@query("STR06", """select date as sale_date, cast(sum(quantity_sold) as bigint) as total_quantity, cast(sum(revenue) as double) as total_revenue, count(*) as transactions from sales
  group by date""", "total_revenue")
def str06(t):
    return jobs.daily_totals(jobs.sales_stream(t.spark, t.folder))


RATES = """select {key}, w as days, cast(date + k as date) as until, cast(sum(quantity_sold) as bigint) as units, sum(quantity_sold)::double / w as rate
  from sales {brand}, (select unnest([7, 30]) as w) g, (select unnest(range(1, 31))::int as k) s where k <= w group by {by}, w, date + k"""


def _rates(t, feed, key: str):
    base = work_folder(t.spark, "rates")
    jobs.day_sums(feed, [key], base, f"{base}/state").awaitTermination()
    kind = {key: feed.schema[key].dataType.simpleString()}
    return jobs.sliding_rate(jobs.summed(t.spark, base, kind), key, (7, 30))


@query("STR07", RATES.format(key="p_brand as brand", brand="join part on product_id = p_partkey", by="p_brand"), "rate")
def str07(t):
    brand = t.raw("part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"))
    return _rates(t, jobs.sales_stream(t.spark, t.folder).join(brand, "product_id"), "brand")


@query("STR07_part", RATES.format(key="product_id", brand="", by="product_id"), "rate")
def str07_part(t):
    return _rates(t, jobs.sales_stream(t.spark, t.folder), "product_id")


@query("STR08", """with b as (select product_id, cast(sum(quantity_sold) as double) / count(*) as mean, sqrt(greatest(0.0::double, cast(sum(quantity_sold * quantity_sold) as double) / count(*)
      - (cast(sum(quantity_sold) as double) / count(*)) * (cast(sum(quantity_sold) as double) / count(*)))) as sd from sales group by product_id)
  select s.product_id, date, quantity_sold, case when sd > 0 then abs(quantity_sold - mean) / sd else 0.0 end as z, case when abs(quantity_sold - mean) / sd > 3.0 then 'HIGH' else 'MEDIUM' end as severity
  from sales s join b on s.product_id = b.product_id where sd > 0 and abs(quantity_sold - mean) / sd > 2.0""", "z")
def str08(t):
    q = F.col("quantity_sold").cast("bigint")
    n, s, ss = F.count(F.lit(1)), F.sum(q), F.sum(q * q)
    base = t.sales().groupBy("product_id").agg((s.cast("double") / n).alias("mean"), population_sd(n, s, ss).alias("sd"))
    flagged = jobs.flag_anomalies(jobs.sales_stream(t.spark, t.folder), base)
    return jobs.run_to_files(flagged).select(
        "product_id", F.col("ts").cast("date").alias("date"), "quantity_sold", "z", "severity")
