"""Files, contracts, upserts and sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from granary.sources import ingest, quality
from granary.sources import schema as sch

AS_OF = dt.date(2024, 1, 31)


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(
        [(1, "A1", "ring", "X", 5, 10.0, 15.0, 7), (2, "B2", "lamp", "Y", 0, 4.0, 3.0, 5)],
        "product_id long, sku string, name string, category string, current_stock int, unit_cost double, unit_price double, lead_time_days int")


def test_conversion_cases(spark):
    df = spark.createDataFrame([("s", "n", "45.0", "yes", "not-a-date"), ("t", "m", "x", "0", "2024-01-02"), ("u", "k", None, "Y", None)],
                               "sku string, name string, stock string, perishable string, last_sale_date string")
    rows = sch.conform_products(df).orderBy("sku").collect()
    assert [r.current_stock for r in rows] == [45, 0, 0]
    assert [r.is_perishable for r in rows] == [True, False, True]
    assert [r.last_sale_date for r in rows] == [None, dt.date(2024, 1, 2), None]


def test_colliding_headers_take_the_first_value(spark):
    df = spark.createDataFrame([("a", None, "n"), (None, "b", "m")], ["SKU ", "product_code", "Title"])
    assert [r.sku for r in sch.rename(df, sch.PRODUCT).collect()] == ["a", "b"]


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="name"):
        sch.conform_products(spark.createDataFrame([("a",)], "sku string"))
    with pytest.raises(ValueError, match="quantity_sold"):
        ingest.resolve_roles(["Order Date", "Item Code"])


def test_quality_cases(spark, products):
    bad = products.withColumn("unit_cost", F.when(F.col("sku") == "A1", -10.0).otherwise(F.col("unit_cost")))
    found = {r.check: (r.severity, r.rows) for r in quality.quality_report(bad.unionByName(bad), "product").collect()}
    assert found["negative_cost"] == ("error", 2) and found["duplicate_sku"] == ("warning", 2)
    sales = spark.createDataFrame([(AS_OF + dt.timedelta(days=30), "A1", 1)], "date date, sku string, quantity_sold int")
    assert {r.check: r.rows for r in quality.quality_report(sales, "sales", AS_OF).collect()}["future_date"] == 1


def test_csv_bulk_load(spark, products, tmp_path):
    (tmp_path / "s.csv").write_text(
        "Sale_Date,Product_SKU,Qty,Price,Cost\n2024-01-01, A1 ,3.0,10,6\nbad,A1,1,1,1\n2024-01-02,ZZ,1,1,1\n2024-01-03,B2,many,5,\n")
    path = str(tmp_path / "s.csv")
    raw = ingest.read_text_csv(spark, path, ingest.csv_header(spark, path))
    rows = {r.sku: r for r in ingest.bulk_sales(raw, products).collect()}
    assert set(rows) == {"A1", "B2"}
    assert rows["A1"].quantity_sold == 3 and rows["A1"].profit_loss_amount == 12.0 and rows["A1"].profit_margin_pct == pytest.approx(40.0)
    assert rows["B2"].quantity_sold == 0 and rows["B2"].profit_loss_amount is None
    fates = {r.sku: r.fate for r in ingest.split_sales(raw, products).filter("quantity_sold = 1").collect()}
    assert fates == {"A1": "BAD_DATE", "ZZ": "UNKNOWN_SKU"}


def test_upsert_keeps_updates_and_adds(spark, products):
    new = spark.createDataFrame([("A1", None, 9), ("C3", "vase", 1)], "sku string, name string, current_stock int")
    got = {r.sku: (r.name, r.current_stock, r.change) for r in ingest.upsert(products, new, "sku").collect()}
    assert got == {"A1": ("ring", 9, "updated"), "B2": ("lamp", 0, "kept"), "C3": ("vase", 1, "added")}


def test_new_products_are_all_or_nothing(spark, products):
    both = spark.createDataFrame([("A1",), ("N1",)], "sku string")
    assert {tuple(r) for r in ingest.load_new_products(both, products).collect()} == {("A1", "duplicate")}
    assert {tuple(r) for r in ingest.load_new_products(both.filter("sku = 'N1'"), products).collect()} == {("N1", "accepted")}


def test_smart_load_creates_unknown_products(spark, products):
    raw = spark.createDataFrame([("2024-01-01", "A1", "2", "5"), ("2024-01-02", "N9", "1", "7")], ["Order Date", "Item Code", "Units", "Amount"])
    new, sales = ingest.smart_load(raw, products)
    assert [tuple(r) for r in new.select("sku", "unit_cost", "unit_price", "lead_time_days").collect()] == [("N9", 10.0, 15.0, 7)]
    assert sales.agg(F.sum("quantity_sold"), F.sum("revenue")).first()[:] == (3, 12.0)


def test_documents_unwrap_land_and_replay(spark, products, tmp_path):
    item = {"product_code": "A1", "sale_date": "2024-01-05", "qty": "2", "amount": "9"}
    docs = [{"data": [item, item]}, {"items": [item]}, {"results": []}, item, [item]]
    src = tmp_path / "api"
    src.mkdir()
    for i, d in enumerate(docs):
        (src / f"{i}.json").write_text(json.dumps(d, indent=1))
    raw = spark.read.text(str(src), wholetext=True).select(F.col("value").alias("body"))
    schema = "product_code string, sale_date string, qty string, amount string"
    rows = ingest.import_documents(raw, products, "sales", schema)
    assert rows.count() == 5
    manifest = ingest.land_documents(raw, rows, str(tmp_path / "lake"), "run1")
    assert [(r.rows, r.documents) for r in manifest.collect()] == [(5, 5)]
    again = ingest.replay(spark, str(tmp_path / "lake"), "run1", products, "sales", schema)
    assert again.count() == 5


def test_documents_set_inventory_and_upsert_products(spark, products):
    docs = spark.createDataFrame([('{"data":[{"sku":"A1","stock":"7"},{"sku":"A1","stock":"8"}]}',)], "body string")
    got = {r.sku: r.current_stock for r in ingest.import_documents(docs, products, "inventory", "sku string, stock string").collect()}
    assert got == {"A1": 8, "B2": 0}
    docs = spark.createDataFrame([('[{"sku":"N5","title":"jug","price":"2.5"}]',)], "body string")
    out = ingest.import_documents(docs, products, "products", "sku string, title string, price string")
    assert {r.sku: r.unit_price for r in out.collect()} == {"A1": 15.0, "B2": 3.0, "N5": 2.5}


def test_strict_records_reject_warnings(spark, products):
    recs = [{"sku": "A1", "date": "2024-01-02", "quantity_sold": "3"}, {"sku": "A1", "date": "2024-1-2", "quantity_sold": "3"},
            {"sku": "A1", "date": "2024-01-02", "quantity_sold": "x"}, {"sku": "A1", "date": "2024-01-02", "quantity_sold": "1", "odd": "1"}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)], "n int, record string")
    loose = {r.n: (r.accepted, r.revenue) for r in ingest.ingest_records(df, products).collect()}
    assert [loose[i][0] for i in range(4)] == [True, False, False, True] and loose[0][1] == 30.0
    strict = {r.n: r.accepted for r in ingest.ingest_records(df, products, strict=True).collect()}
    assert strict == {0: True, 1: False, 2: False, 3: False}


def test_sinks_survive_a_retry(spark, tmp_path):
    fc = spark.createDataFrame([(1, 1, 2.0)], "product_id long, step int, forecast double")
    path = str(tmp_path / "fc")
    for day in (1, 2, 2):
        ingest.append_forecasts(fc, path, dt.date(2024, 1, day))
    assert spark.read.parquet(path).count() == 2
    ingest.append_recommendations(fc, str(tmp_path / "rec"), AS_OF)
    assert spark.read.parquet(str(tmp_path / "rec")).count() == 1


def test_clean_keeps_the_first_of_a_stated_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "sku string, line_no int, v string")
    assert [tuple(r) for r in quality.clean(df, ["sku"], ["line_no"]).collect()] == [("a", 1, "y")]
