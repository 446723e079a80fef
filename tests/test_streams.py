"""Streams against their batch twins and plain loops, over several micro-batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from granary.streaming import jobs
from granary.streaming.dedupe import dedupe_log

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def event_files(spark, tables, tmp_path_factory):
    """The events in time order, cut into four files that become four micro-batches."""
    path = tmp_path_factory.mktemp("events")
    df = tables.raw("events")
    rows = sorted(df.select("event_id", "ts", "user_id", "event_type", "value").collect(), key=lambda r: (r.ts, r.event_id))
    n = len(rows) // 4 + 1
    for k in range(4):
        spark.createDataFrame(rows[k * n:(k + 1) * n], df.select("event_id", "ts", "user_id", "event_type", "value").schema).coalesce(1).write.mode(
            "append").parquet(str(path))
    return str(path), rows


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module", params=["file", "folder", "shuffled"])
def layout(request, spark, tables, tmp_path_factory):
    """The smallest data set with its event and sales tables as one file, a folder, or four files in random order."""
    import os
    import shutil

    folder = tmp_path_factory.mktemp(request.param)
    for name in os.listdir(tables.folder):
        if request.param == "file" or name not in ("events.parquet", "lineitem.parquet"):
            shutil.copy(f"{tables.folder}/{name}", folder / name)
            continue
        rows = spark.read.parquet(f"{tables.folder}/{name}")
        if request.param == "folder":
            rows.coalesce(1).write.parquet(str(folder / name))
        else:
            rows.repartition(4, F.xxhash64(*rows.columns)).write.parquet(str(folder / name))
    return request.param, str(folder)


@pytest.mark.parametrize("key", ["STR01_stream", "STR02_stream", "STR04_stream", "STR06", "STR07", "STR07_part", "STR08"])
def test_any_layout_gives_the_same_rows(spark, tables, layout, key, monkeypatch):
    from granary.plans import catalogue

    kind, folder = layout
    read = jobs.read_files
    if kind == "shuffled":  # one file for each micro-batch
        monkeypatch.setattr(jobs, "read_files", lambda spark, folder, name: read(spark, folder, name, 1))
    got = catalogue.runnable()[key](spark, folder).collect()
    assert got and sorted(got) == sorted(_plain(spark, tables.folder, key))


_WANTED = {}


def _plain(spark, folder, key):
    """The rows by SQL."""
    if key not in _WANTED:
        import duckdb

        from granary.plans import catalogue

        con = duckdb.connect()
        con.execute("set timezone='UTC'")
        for t in ("events", "lineitem", "part", "customer", "orders", "supplier", "nation", "region"):
            con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
        columns = catalogue.runnable()[key](spark, folder).columns
        cur = con.execute(catalogue.oracles()[key])
        names = [d[0] for d in cur.description]
        _WANTED[key] = [tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()]
    return _WANTED[key]


def test_ledger_batch_equals_the_loop(spark, event_files):
    path, rows = event_files
    start = {k: k % 4 for k in range(0, 200, 3)}
    stock, known = {}, dict(start)
    for r in rows:
        d = {"purchase": -1, "signup": 3}.get(r.event_type, 0)
        stock[r.user_id] = max(0, stock.get(r.user_id, 0) + d)
        if r.user_id in known:
            known[r.user_id] = max(0, known[r.user_id] + d)
    events = jobs.event_deltas(spark.read.parquet(path))
    assert {r.sku: r.stock for r in jobs.ledger_batch(events).collect()} == stock
    opening = spark.createDataFrame(list(start.items()), "sku long, stock long")
    seen = {r.user_id for r in rows} & set(start)
    assert {r.sku: r.stock for r in jobs.ledger_batch(events, opening).collect()} == {k: known[k] for k in seen}
    assert {r.sku for r in jobs.known_skus(events, opening)[1].collect()} == {r.user_id for r in rows} - set(start)


def loop(rows, minutes=120):
    last, want = {}, set()
    for key, at, n in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or at - last[key] > dt.timedelta(minutes=minutes):
            last[key] = at
            want.add(n)
    return want


@pytest.mark.parametrize("stretch", [1, 3, 12])
def test_dedupe_log_equals_the_loop_on_a_hot_key(spark, stretch):
    rows = [("hot" if i % 3 == 0 else f"k{i % 5}", T0 + dt.timedelta(seconds=(i * 7919) % 400000), i) for i in range(4000)]
    rows += [("edge", T0 + dt.timedelta(minutes=120 * k), 5000 + k) for k in range(30)]
    rows += [("same", T0, 6000), ("same", T0, 6001), ("rare", T0 + dt.timedelta(days=40), 7000), ("rare", T0, 7001)]
    df = spark.createDataFrame(rows, "alert_key string, ts timestamp, id long").withColumn("channel", F.lit("EMAIL"))
    assert {r.id for r in dedupe_log(df, stretch_windows=stretch).collect()} == loop(rows)


def test_dedupe_log_continues_from_an_earlier_batch(spark):
    rows = [("a" if i % 2 else "b", T0 + dt.timedelta(seconds=i * 1700), i) for i in range(300)]
    df = spark.createDataFrame(rows, "alert_key string, ts timestamp, id long").withColumn("channel", F.lit("EMAIL"))
    first = dedupe_log(df.filter("id < 130"))
    before = first.groupBy("alert_key", "channel").agg(F.max(F.unix_micros("ts")).alias("last_us"))
    second = dedupe_log(df.filter("id >= 130"), before=before)
    assert {r.id for r in first.collect()} | {r.id for r in second.collect()} == loop(rows)


def test_late_rows_take_their_place(spark, event_files, tmp_path):
    """Files come newest first; every version equals a replay of what is known by then."""
    path, rows = event_files
    events = spark.read.parquet(path)
    late = str(tmp_path / "late")
    cuts = sorted(r.ts for r in rows)
    edges = [cuts[0], cuts[len(cuts) // 2], cuts[-1]]
    events.filter(F.col("ts") >= F.lit(edges[1])).coalesce(1).write.mode("append").parquet(late)
    events.filter(F.col("ts") < F.lit(edges[1])).coalesce(1).write.mode("append").parquet(late)
    base = str(tmp_path / "t")
    jobs.ledger_job(jobs.event_deltas(stream(spark, late)), base, f"{base}/state").awaitTermination()
    want = {r.sku: (r.events, r.stock) for r in jobs.ledger_batch(jobs.event_deltas(events)).collect()}
    assert {r.sku: (r.events, r.stock) for r in jobs.ledger_stock(spark, base).collect()} == want
    assert jobs.latest_version(spark, str(tmp_path / "nowhere")) is None


def test_dedupe_horizon_forgets_old_rows(spark, tmp_path):
    rows = [("k", "EMAIL", 1, T0), ("k", "EMAIL", 2, T0 + dt.timedelta(days=9)), ("k", "EMAIL", 3, T0 + dt.timedelta(days=9, minutes=1))]
    spark.createDataFrame(rows, "alert_key string, channel string, id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    base = str(tmp_path / "t")
    jobs.dedupe_job(stream(spark, str(tmp_path / "in")), base, f"{base}/state", horizon=dt.timedelta(days=1)).awaitTermination()
    assert {r.id for r in jobs.sent_alerts(spark, base).collect()} == {2}


def test_snapshots_keep_the_last_count(spark, event_files, tmp_path):
    path, rows = event_files
    s = stream(spark, path).filter("event_type = 'view'").select(
        F.col("user_id").alias("sku"), F.floor("value").alias("stock"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    q = jobs.sync_snapshots(s, str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination()
    got = {r.sku: r.stock for r in jobs.synced(spark, str(tmp_path / "t")).collect()}
    want = {r.user_id: int(r.value // 1) for r in rows if r.event_type == "view"}
    assert got == want


def test_periodic_alerts_are_routed_per_run(spark, tables, tmp_path):
    from granary.operators.inventory import live_alerts

    feed = jobs.sales_stream(spark, tables.folder)
    q = jobs.evaluate_alerts(feed, lambda n: live_alerts(tables.products, tables.sales(), tables.as_of, 180, 365),
                             str(tmp_path / "a"), str(tmp_path / "c"))
    q.awaitTermination()
    out = jobs.latest_version(spark, str(tmp_path / "a"))
    assert out.count() > 0 and {r[0] for r in out.select("channel").distinct().collect()} <= {"EMAIL", "SLACK", "TEAMS"}


def test_sliding_rate_adds_whole_days(spark, tables, tmp_path):
    feed = jobs.sales_stream(spark, tables.folder).withColumn("k", F.lit(1))
    jobs.day_sums(feed, ["k"], str(tmp_path / "p"), str(tmp_path / "c")).awaitTermination()
    got = {r.until: r.units for r in jobs.sliding_rate(jobs.summed(spark, str(tmp_path / "p"), {"k": "int"}), "k", (7,)).collect()}
    day = sorted(got)[len(got) // 2]
    want = tables.sales().filter((F.col("date") < F.lit(day)) & (F.col("date") >= F.lit(day - dt.timedelta(days=7)))).agg(
        F.sum("quantity_sold")).first()[0]
    assert got[day] == want
