"""Keyed state and part tables: many batches, late rows, hot keys, repeated batches, work per batch."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.streaming import jobs, state
from granary.streaming.dedupe import dedupe_log
from granary.streaming.parts import PartTable, bucket, month, newest

T0 = dt.datetime(2024, 1, 1)


class Values:
    """State variables of one key in memory, counting reads."""

    def __init__(self):
        self.maps, self.values, self.reads = {}, {}, 0

    def getMapState(self, name, *_):
        store, owner = self.maps.setdefault(name, {}), self

        class Map:
            def getValue(self, key):
                owner.reads += 1
                return store.get(key)

            def updateValue(self, key, value):
                store[key] = value

            def removeKey(self, key):
                store.pop(key, None)

        return Map()

    def getValueState(self, name, *_):
        store = self.values

        class Value:
            def get(self):
                return store.get(name)

            def update(self, value):
                store[name] = value

        return Value()


def fed(processor, batches, key):
    """Outputs per batch of one key."""
    handle = Values()
    processor.init(handle)
    for b in batches:
        start = handle.reads
        out = list(processor.handleInputRows(key, iter([b]), None))
        yield (pd.concat(out) if out else pd.DataFrame()), handle.reads - start, handle


@pytest.mark.parametrize("leaf", [2, 20, 10**6])
def test_ledger_state_equals_the_loop_after_every_batch(leaf):
    rng = random.Random(leaf)
    rows = [(rng.randrange(400), k, rng.choice([-4, -1, 0, 3])) for k in range(300)] + [(7, 7, -1)] * 3
    rng.shuffle(rows)
    cuts = [rows[k:k + 30] for k in range(0, len(rows), 30)]
    frames = [pd.DataFrame(c, columns=["us", "event_id", "delta"]) for c in cuts]
    seen = []
    for cut, (out, reads, handle) in zip(cuts, fed(state.Ledger(leaf), frames, (1,))):
        seen += cut
        stock = 5
        for _, _, d in sorted(seen):
            stock = max(0, stock + d)
        row = out.iloc[0]
        assert (row.events, max(row.floor, 5 + row.total)) == (len(seen), stock)
        assert reads <= len(cut)
    assert len(handle.maps["events"]) >= min(len(rows) // (leaf + 10), 100)


def test_a_batch_reads_its_own_leaves():
    """After many events, a late row opens one leaf of bounded size."""
    frames = [pd.DataFrame({"us": np.arange(50_000), "event_id": np.arange(50_000), "delta": 1}),
              pd.DataFrame({"us": [123], "event_id": [-1], "delta": [-1000]})]
    (_, _, _), (out, reads, handle) = fed(state.Ledger(), frames, (1,))
    assert reads == 1 and max(len(v[0]) // 24 for v in handle.maps["events"].values()) <= state.LEAF + 1
    assert (out.iloc[0].events, out.iloc[0].floor, out.iloc[0].total) == (50_001, 50_000 - 123, 49_000)


def test_runs_compose():
    rng = np.random.default_rng(3)
    delta = rng.integers(-5, 5, 200)
    cuts = np.split(delta, [10, 11, 60, 150])
    pairs = np.array([state.run_pair(c) for c in cuts])
    assert state.folded(pairs[:, 0], pairs[:, 1]) == state.run_pair(delta)


def suppressed(rows, window):
    last, sent = None, set()
    for us, n in sorted(rows):
        if last is None or us - last > window:
            last = us
            sent.add(n)
    return sent


@pytest.mark.parametrize("leaf", [3, 30, 1000])
def test_suppression_state_corrects_what_it_said(leaf):
    rng = random.Random(leaf)
    rows = [(rng.randrange(3000), k) for k in range(400)] + [(100, 900), (100, 901)]
    rng.shuffle(rows)
    cuts = [rows[k:k + 20] for k in range(0, len(rows), 20)]
    frames = [pd.DataFrame(c, columns=["us", "id"]) for c in cuts]
    seen, now = [], set()
    for cut, (out, _, _) in zip(cuts, fed(state.Suppression(60, leaf=leaf), frames, ("k", "c"))):
        seen += cut
        for r in out.itertuples():
            assert r.sent != (r.id in now)  # only what changed is told
            (now.add if r.sent else now.discard)(r.id)
        assert now == suppressed(seen, 60)


def test_a_late_alert_opens_only_what_it_changes():
    """Gaps longer than the window stop the correction in the leaf that the late row enters, or the next one."""
    rows = [(s * 1000 + k * 10, s * 10 + k) for s in range(200) for k in range(5)]
    frames = [pd.DataFrame(rows, columns=["us", "id"]), pd.DataFrame([(100_005, 9999)], columns=["us", "id"]),
              pd.DataFrame([(99_950, 9998)], columns=["us", "id"])]
    (first, _, handle), (second, reads, _), (third, more, _) = fed(state.Suppression(60, leaf=10), frames, ("k", "c"))
    assert len(handle.maps["alerts"]) > 100 and len(first) == 200
    assert reads <= 2 and len(second) == 0  # it falls in the block of an alert sent before
    assert more <= 3 and {(r.id, r.sent) for r in third.itertuples()} == {(9998, True), (1000, False), (1002, True)}


def test_horizon_forgets_leaves():
    frames = [pd.DataFrame([(d * 1000 + k, d * 10 + k) for k in range(4)], columns=["us", "id"]) for d in range(50)]
    *_, (out, _, handle) = fed(state.Suppression(60, 5000, leaf=4), frames, ("k", "c"))
    assert len(handle.maps["alerts"]) <= 12 and {r.id for r in out.itertuples()} == {490}
    late = pd.DataFrame([(44_000, 1), (49_100, 2)], columns=["us", "id"])
    processor = state.Suppression(60, 5000, leaf=4)
    processor.init(handle)
    assert {r.id for r in pd.concat(processor.handleInputRows(("k", "c"), iter([late]), None)).itertuples()} == {2}


def test_parts_after_fifty_batches(spark, tmp_path):
    """Sums equal the whole, each batch rewrites its own months, two versions of a part stay."""
    rng = random.Random(2)
    path = str(tmp_path / "t")
    table = PartTable(spark, path, "day date, k long, n long")

    def added(rows):
        return rows.groupBy("day", "k").agg(F.sum("n").alias("n"))

    total = {}
    for number in range(50):
        rows = [(dt.date(2024, rng.choice([1 + number // 5, 1]), rng.randint(1, 28)), rng.randint(0, 2), rng.randint(1, 9)) for _ in range(6)]
        for d, k, n in rows:
            total[d, k] = total.get((d, k), 0) + n
        df = spark.createDataFrame(rows, table.schema).coalesce(1)
        touched = table.merge(df, month("day"), number, added)
        assert touched == {f"part={d:%Y-%m}" for d, _, _ in rows}
        if number % 10 == 3:
            assert table.merge(df, month("day"), number, added) == touched  # run again
    assert {(r.day, r.k): r.n for r in table.read().collect()} == total
    versions = table.versions()
    assert len(versions) == 10 and max(map(len, versions.values())) <= 2
    assert len(list((tmp_path / "t/new").iterdir())) == 1


def test_a_batch_that_stopped_half_way_is_not_read(spark, tmp_path):
    table = PartTable(spark, str(tmp_path / "t"), "k long, n long")
    keep = newest(["k"], ["n"], [])
    table.merge(spark.createDataFrame([(1, 1), (2, 2)], "k long, n long"), F.lit("a"), 0, keep)
    table.merge(spark.createDataFrame([(1, 5)], "k long, n long"), F.lit("a"), 1, keep)
    (tmp_path / "t/table/batch=1/_SUCCESS").unlink()
    assert {(r.k, r.n) for r in table.read().collect()} == {(1, 1), (2, 2)}
    table.merge(spark.createDataFrame([(1, 5)], "k long, n long"), F.lit("a"), 1, keep)
    assert {(r.k, r.n) for r in table.read().collect()} == {(1, 5), (2, 2)}
    assert table.merge(spark.createDataFrame([], "k long, n long"), F.lit("a"), 2, keep) == set()
    assert {(r.k, r.n) for r in table.read().collect()} == {(1, 5), (2, 2)}


def test_buckets_hold_whole_keys(spark):
    rows = spark.range(500).selectExpr("id % 50 as k").withColumn("p", bucket(["k"], 7))
    assert rows.groupBy("k").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0


def hot_files(spark, path, n=6):
    rows = [("hot" if i % 3 == 0 else f"k{i % 5}", "EMAIL", i, T0 + dt.timedelta(seconds=(i * 7919) % 400000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "alert_key string, channel string, id long, ts timestamp")
    df.repartition(n, F.xxhash64("id")).write.parquet(path)
    return df


def test_alerts_on_a_hot_key_in_any_order(spark, tmp_path):
    path, base = str(tmp_path / "in"), str(tmp_path / "t")
    df = hot_files(spark, path)
    feed = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.dedupe_job(feed, base, f"{base}/state").awaitTermination()
    got = {(r.alert_key, r.id, r.ts) for r in jobs.sent_alerts(spark, base).collect()}
    assert got == {(r.alert_key, r.id, r.ts) for r in dedupe_log(df).collect()}


def test_a_restarted_ledger_goes_on_where_it_stood(spark, tmp_path):
    """The second run reads the new files only, and adds to the state of the first."""
    path, base = str(tmp_path / "in"), str(tmp_path / "t")
    rows = [(k % 3 and k % 40, T0 + dt.timedelta(seconds=(k * 7919) % 90000), k, (k * 7) % 5 - 2) for k in range(900)]
    df = spark.createDataFrame(rows, "sku long, ts timestamp, event_id long, delta long")
    for part in (df.where("event_id % 2 = 0"), df.where("event_id % 2 = 1")):
        part.coalesce(1).write.mode("append").parquet(path)
        feed = spark.readStream.schema(df.schema).parquet(path)
        query = jobs.ledger_job(feed, base, f"{base}/state", buckets=4)
        query.awaitTermination()
        assert sum(p["numInputRows"] for p in query.recentProgress) == 450
    want = {tuple(r) for r in jobs.ledger_batch(df).collect()}
    assert {tuple(r) for r in jobs.ledger_stock(spark, base).collect()} == want
