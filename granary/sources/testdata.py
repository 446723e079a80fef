"""Views of the benchmark tables as products, sales and logs.

Every view is a list of SQL expressions that mean the same in Spark and in the
checking engine.  ``Tables`` builds lazy DataFrames from them; ``BASE_CTES``
holds the same text for the checks.  Dates are pushed to the scan through the
raw column, because a predicate on ``cast(ts as date)`` does not reach Parquet.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.layout import tasks_for_rows

PRODUCT_EXPRS = """
p_partkey as product_id
concat('SKU-', lpad(cast(p_partkey as varchar(20)), 6, '0')) as sku
p_name as name
p_type as category
p_brand as brand
cast(cast(p_retailprice as decimal(12,2)) as double) as unit_price
cast(cast(round(p_retailprice * (40 + 11 * (p_partkey % 7)) / 100.0, 2) as decimal(12,2)) as double) as unit_cost
cast(case when p_partkey % 10 = 0 then 0 when p_partkey % 10 = 1 then 1 + p_partkey % 9 when p_partkey % 10 in (2,3) then 11 + p_partkey % 37 else 51 + (p_partkey * 13) % 450 end as int) as current_stock
cast(3 + p_partkey % 12 as int) as lead_time_days
cast(case when p_partkey % 9 = 0 then null else (1 + p_partkey % 23) / cast(2 as double) end as double) as average_daily_demand
cast(case when p_partkey % 4 = 0 then null else 20 + p_partkey % 180 end as double) as reorder_point
cast(case when p_partkey % 5 = 0 then null else 5 + p_partkey % 60 end as double) as safety_stock
cast(case when p_partkey % 5 = 0 then null else 1 + (p_partkey % 40) * 2 end as double) as storage_cost_per_unit
cast(case when p_partkey % 6 = 0 then null else 50 + p_partkey % 900 end as double) as stockout_cost_per_unit
cast(case when p_partkey % 3 = 0 then null else 7 + p_partkey % 60 end as int) as order_frequency_days
cast(case when p_partkey % 8 = 0 then 5 + p_partkey % 20 when p_partkey % 8 = 1 then 90 else null end as int) as shelf_life_days
cast(case when p_partkey % 2 = 0 then 5 + p_partkey % 30 else null end as int) as min_order_qty
cast(case when p_partkey % 7 = 0 then 60 + p_partkey % 50 else null end as int) as max_order_qty
case when p_partkey % 4 = 0 then 'HIGH' when p_partkey % 4 = 1 then 'MEDIUM' else 'LOW' end as product_priority
cast((p_partkey % 10) / cast(10 as double) as double) as demand_volatility
cast((5 + p_partkey % 16) / cast(10 as double) as double) as seasonality_factor
cast(case when p_partkey % 11 = 0 then null else (1 + p_partkey % 50) / cast(4 as double) end as double) as weight_kg
cast(case when p_partkey % 13 = 0 then null else (1 + p_partkey % 20) / cast(64 as double) end as double) as volume_m3
cast(p_partkey % 250 as int) as days_since_last_order
""".strip().splitlines()

SALE_EXPRS = """
cast(l_orderkey * 10 + l_linenumber as bigint) as id
l_partkey as product_id
cast(l_shipdate as date) as date
cast(l_quantity as int) as quantity_sold
cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as revenue
l_discount as discount_applied
""".strip().splitlines()

FEED_EXPRS = """
o_orderpriority as sales_channel
c_custkey as customer_id
r_name as region
""".strip().splitlines()

EVENT_EXPRS = """
event_id
cast(ts as timestamp) as ts
user_id
event_type
value
props
""".strip().splitlines()

# One row per import of the order feed: an audit log with status and duration.
IMPORT_EXPRS = """
o_orderkey as id
concat('feed-', lower(substr(o_orderpriority, 1, 1))) as source_name
case when o_orderkey % 2 = 0 then 'sales' else 'products' end as data_type
cast(1 + o_orderkey % 500 as int) as record_count
case when o_orderstatus = 'P' then 'FAILED' else 'SUCCESS' end as status
cast(10 + o_orderkey % 990 as int) as import_duration_ms
cast(o_orderdate as timestamp) as created_at
""".strip().splitlines()

# Notification attempts of the alerting service, one per error event.
NOTICE_EXPRS = """
event_id as id
case when event_id % 3 = 0 then 'email' when event_id % 3 = 1 then 'slack' else 'teams' end as channel
case when event_id % 7 = 0 then 'FAILED' else 'SENT' end as status
concat('user-', cast(user_id as varchar(20))) as alert_key
cast(ts as timestamp) as created_at
""".strip().splitlines()

RECIPIENT_EXPRS = """
c_custkey as recipient_id
case when c_nationkey % 3 = 0 then 'email' when c_nationkey % 3 = 1 then 'slack' else 'sms' end as channel
concat(lower(replace(c_name, '#', '.')), '@example.com') as address
case when c_acctbal > 0 then true else false end as is_active
""".strip().splitlines()

# Raw text feeds as a partner would send them: odd headers, stray spaces, bad values.
RAW_PRODUCT_EXPRS = """
concat('  ', concat('SKU-', lpad(cast(p_partkey as varchar(20)), 6, '0')), ' ') as product_code
p_name as product_name
case when p_partkey % 17 = 0 then 'n/a' else cast(cast(p_retailprice as decimal(12,2)) as varchar(20)) end as price
case when p_partkey % 19 = 0 then null else cast(cast(round(p_retailprice * (40 + 11 * (p_partkey % 7)) / 100.0, 2) as decimal(12,2)) as varchar(20)) end as cost
case when p_partkey % 13 = 0 then '-3' when p_partkey % 3 = 0 then concat(cast(p_partkey % 50 as varchar(20)), '.0') else cast(p_partkey % 50 as varchar(20)) end as stock
p_type as category
case when p_partkey % 23 = 0 then 'soon' else cast(3 + p_partkey % 12 as varchar(20)) end as lead_time
case when p_partkey % 5 = 0 then 'Yes' when p_partkey % 5 = 1 then '0' when p_partkey % 5 = 2 then 'Y' when p_partkey % 5 = 3 then 'false' else null end as perishable
p_partkey as line_no
""".strip().splitlines()

RAW_SALE_EXPRS = """
cast(l_orderkey * 10 + l_linenumber as bigint) as line_no
concat(' SKU-', lpad(cast(l_partkey + case when l_orderkey % 50 = 0 then 9000000 else 0 end as varchar(20)), 6, '0')) as product_code
case when l_orderkey % 41 = 0 then 'not-a-date' else substr(cast(l_shipdate as varchar(30)), 1, 10) end as sale_date
case when l_orderkey % 37 = 0 then 'many' else concat(cast(cast(l_quantity as int) as varchar(20)), '.0') end as qty
cast(cast(l_extendedprice as decimal(12,2)) as varchar(20)) as amount
case when l_linenumber = 1 then null else concat(cast(cast(floor(l_extendedprice / l_quantity) as int) as varchar(20)), '.25') end as price
case when l_linenumber = 2 then null else concat(cast(cast(floor(l_extendedprice / l_quantity * 0.75) as int) as varchar(20)), '.5') end as cost
l_returnflag as channel
""".strip().splitlines()


def _sel(exprs, source) -> str:
    return "select " + ", ".join(exprs) + " from " + source


def _spark_types(exprs):
    # Spark has varchar only as a table column type; casts use string.
    import re
    return [re.sub(r"varchar\(\d+\)", "string", e) for e in exprs]


_FEED_JOIN = (
    "lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey "
    "join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
)

# Priced transactions: the price at sale is revenue over quantity, the cost comes
# from the catalogue, and the profit follows.
PRICED_SQL = """
select s.*, p.sku, p.name, p.category, p.unit_price, p.unit_cost,
       cast(s.revenue as double) / nullif(s.quantity_sold, 0) as unit_price_at_sale,
       p.unit_cost as unit_cost_at_sale,
       s.revenue - cast(p.unit_cost as decimal(12,2)) * s.quantity_sold as profit_loss_amount
from sales s join products p on s.product_id = p.product_id
"""

# Forecast log: one stored forecast per selling day, two creation times per day.
FORECAST_SQL = """
select d.product_id, d.date as forecast_date,
       cast(m.mean_q + (d.product_id * 7 + day(d.date)) % 5 - 2 as double) as predicted_demand,
       cast(m.mean_q * 0.8 as double) as lower_bound, cast(m.mean_q * 1.2 as double) as upper_bound,
       cast((70 + d.product_id % 30) / cast(100 as double) as double) as confidence_level
from (select product_id, date from sales group by product_id, date) d
join (select product_id, cast(sum(quantity_sold) as double) / count(*) as mean_q
      from sales group by product_id) m on d.product_id = m.product_id
"""

SUPPLIER_RISK_SQL = """
select l_suppkey as supplier_id, cast(date_trunc('month', l_shipdate) as date) as scored_on,
       cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as double) * 100 / count(*) as overall_risk_score
from lineitem group by l_suppkey, cast(date_trunc('month', l_shipdate) as date)
"""

BASE_CTES: dict[str, str] = {
    "products": _sel(PRODUCT_EXPRS, "part"),
    "sales": _sel(SALE_EXPRS, "lineitem"),
    "clock": "select max(cast(l_shipdate as date)) as d from lineitem",
    "feed": _sel(SALE_EXPRS + FEED_EXPRS, _FEED_JOIN),
    "priced": PRICED_SQL,
    "forecasts": FORECAST_SQL,
    "supplier_risk": SUPPLIER_RISK_SQL,
    "imports": _sel(IMPORT_EXPRS, "orders"),
    "notices": _sel(NOTICE_EXPRS, "events") + " where event_type = 'error'",
    "recipients": _sel(RECIPIENT_EXPRS, "customer"),
    "raw_products": _sel(RAW_PRODUCT_EXPRS, "part"),
    "raw_sales": _sel(RAW_SALE_EXPRS, "lineitem"),
    "brand_daily": "select p_brand as product_id, cast(l_shipdate as date) as date, "
                   "cast(sum(cast(l_quantity as int)) as bigint) as qty from lineitem "
                   "join part on l_partkey = p_partkey group by p_brand, cast(l_shipdate as date)",
    "part_daily": "select product_id, date, cast(sum(quantity_sold) as bigint) as qty "
                  "from sales group by product_id, date",
}

_AS_OF: dict[tuple[str, str], dt.date] = {}
_LINES: dict[tuple[str, str], int] = {}


class Tables:
    """Lazy DataFrames over one folder of benchmark Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, df: DataFrame, exprs) -> DataFrame:
        return df.selectExpr(*_spark_types(exprs))

    @property
    def as_of(self) -> dt.date:
        """Last sales day of the feed: one aggregate over one column, kept per folder."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _AS_OF:
            _AS_OF[key] = self.raw("lineitem").agg(F.max("l_shipdate")).first()[0].date()
        return _AS_OF[key]

    def days_before(self, days: int) -> dt.date:
        return self.as_of - dt.timedelta(days=days)

    @property
    def tasks(self) -> int:
        """Tasks that the sales are dealt to by product; their number is in the footers and kept per folder."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _LINES:
            _LINES[key] = self.raw("lineitem").count()
        return tasks_for_rows(self.spark, _LINES[key])

    def _lines(self, since: dt.date | None) -> DataFrame:
        lines = self.raw("lineitem")
        if since is not None:
            lines = lines.filter(F.col("l_shipdate") >= F.lit(since).cast("timestamp_ntz"))
        return lines

    @property
    def products(self) -> DataFrame:
        return self._view(self.raw("part"), PRODUCT_EXPRS)

    def sales(self, since: dt.date | None = None) -> DataFrame:
        return self._view(self._lines(since), SALE_EXPRS)

    def feed(self, since: dt.date | None = None) -> DataFrame:
        """Sales with channel, customer and region, for operators that need them."""
        wide = (
            self._lines(since)
            .join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )
        return self._view(wide, SALE_EXPRS + FEED_EXPRS)

    def priced(self, since: dt.date | None = None) -> DataFrame:
        p = self.products.select("product_id", "sku", "name", "category", "unit_price", "unit_cost")
        money = F.col("revenue").cast("double")
        return self.sales(since).join(p, "product_id").withColumns({
            "unit_price_at_sale": money / F.nullif(F.col("quantity_sold"), F.lit(0)),
            "unit_cost_at_sale": F.col("unit_cost"),
            "profit_loss_amount": F.col("revenue") - F.col("unit_cost").cast("decimal(12,2)") * F.col("quantity_sold"),
        })

    @property
    def forecasts(self) -> DataFrame:
        q = F.col("quantity_sold")
        days = self._days(self.sales(), F.sum(q).alias("q"), F.count(F.lit(1)).alias("rows")).where("product_id is not null")
        w = Window.partitionBy("product_id")
        mean = F.sum("q").over(w).cast("double") / F.sum("rows").over(w)
        return days.repartition(self.tasks, "product_id").withColumn("mean_q", mean).selectExpr(
            "product_id", "date as forecast_date", "cast(mean_q + (product_id * 7 + day(date)) % 5 - 2 as double) as predicted_demand",
            "cast(mean_q * 0.8 as double) as lower_bound", "cast(mean_q * 1.2 as double) as upper_bound",
            "cast((70 + product_id % 30) / cast(100 as double) as double) as confidence_level")

    @property
    def supplier_risk(self) -> DataFrame:
        return self.spark.sql(
            SUPPLIER_RISK_SQL.replace("from lineitem", "from {l}"), l=self.raw("lineitem"))

    @property
    def events(self) -> DataFrame:
        return self._view(self.raw("events"), EVENT_EXPRS)

    @property
    def imports(self) -> DataFrame:
        return self._view(self.raw("orders"), IMPORT_EXPRS)

    @property
    def notices(self) -> DataFrame:
        return self._view(self.raw("events").filter("event_type = 'error'"), NOTICE_EXPRS)

    @property
    def recipients(self) -> DataFrame:
        return self._view(self.raw("customer"), RECIPIENT_EXPRS)

    @property
    def raw_products(self) -> DataFrame:
        return self._view(self.raw("part"), RAW_PRODUCT_EXPRS)

    @property
    def raw_sales(self) -> DataFrame:
        return self._view(self.raw("lineitem"), RAW_SALE_EXPRS)

    def _days(self, sales: DataFrame, *sums: Column) -> DataFrame:
        """A row per product and day; a product's rows are spread over its days."""
        return sales.repartition(self.tasks, "product_id", "date").groupBy("product_id", "date").agg(*sums)

    def part_days(self, since: dt.date | None = None) -> DataFrame:
        return self._days(self.sales(since), F.sum("quantity_sold").alias("qty"))

    def part_daily(self, since: dt.date | None = None) -> DataFrame:
        """``part_days`` laid out by product, so that windows over it need no further exchange."""
        return self.part_days(since).repartition(self.tasks, "product_id")

    def brand_daily(self) -> DataFrame:
        """Dense daily series: parts are first summed per day, then rolled up to brands."""
        brand = self.raw("part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand"))
        return (
            self.part_days().join(brand, "product_id")
            .groupBy(F.col("p_brand").alias("product_id"), "date")
            .agg(F.sum("qty").alias("qty"))
        )
