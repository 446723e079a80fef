"""Alert suppression over a whole log, with any share of it on one key.

Whether an alert goes out depends on the last one sent, which looks sequential.  The
log of a key is cut into fixed stretches of time.  Inside a stretch the outcome depends
only on the moment until which sending is blocked when it begins, so a stretch is
summed up as a step function from that moment to the last alert it sends.  The
functions are chained per key (a few rows per stretch), and every stretch then marks
its own rows.  Keys with few alerts, which are most of them, are followed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.prefix import materialise

NEVER = -(2 ** 62)


def _sent(at: np.ndarray, blocked_until: int, window: int) -> list[int]:
    """Positions sent from a sorted stretch; a search per alert sent, not per row."""
    out, i = [], int(np.searchsorted(at, blocked_until, side="right"))
    while i < len(at):
        out.append(i)
        i = int(np.searchsorted(at, at[i] + window, side="right"))
    return out


def _steps(window: int):
    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["us"].to_numpy())
        after = np.searchsorted(at, at + window, side="right")
        # Only the rows a block from before can reach, and the first one behind them: the
        # last alert before these rows is no later than the first of them.
        first = min(int(np.searchsorted(at, at[0] + window, side="right")) + 1, len(at))
        last = {}
        rows, previous = [], None
        for i in range(first - 1, -1, -1):
            j, path = i, []
            while j < len(at) and j not in last:
                path.append(j)
                j = int(after[j])
            end = last[j] if j < len(at) else int(at[path[-1]])
            for k in path:
                last[k] = end
        for i in range(first):
            if last[i] != previous:
                rows.append((NEVER if i == 0 else int(at[i - 1]), last[i]))
                previous = last[i]
        if first == len(at):  # a block beyond the final row lets nothing through
            rows.append((int(at[-1]), NEVER))
        head = pdf.iloc[0]
        return pd.DataFrame([(head["alert_key"], head["channel"], head["stretch"], b, e) for b, e in rows],
                            columns=["alert_key", "channel", "stretch", "blocked_from", "ends"])

    return summarise


def _chain(window: int):
    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        last, out = int(pdf["before"].iloc[0]), []
        for stretch, steps in pdf.sort_values(["stretch", "blocked_from"]).groupby("stretch", sort=True):
            blocked = NEVER if last == NEVER else last + window
            out.append((pdf["alert_key"].iloc[0], pdf["channel"].iloc[0], stretch, blocked))
            at = int(np.searchsorted(steps["blocked_from"].to_numpy(), blocked, side="right")) - 1
            end = int(steps["ends"].iloc[at])
            last = end if end != NEVER else last
        return pd.DataFrame(out, columns=["alert_key", "channel", "stretch", "blocked"])

    return follow


def _mark(window: int):
    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "id"])
        rows = pdf.iloc[_sent(pdf["us"].to_numpy(), int(pdf["blocked"].iloc[0]), window)]
        return rows[["alert_key", "channel", "id", "ts"]]

    return keep


#: Alerts of a key that are followed as one array; a fuller key is cut into stretches.
SHORT = 4096


def dedupe_log(alerts: DataFrame, minutes: int = 120, before: DataFrame | None = None,
               stretch_windows: int = 12, short: int = SHORT) -> DataFrame:
    """Alerts that go out: none of the same key and channel in the ``minutes`` before.

    ``alerts`` has alert_key, channel, id, ts; those without a key, a channel or a time do not go out.
    ``before`` optionally carries the last sent time per key and channel (``last_us``) from earlier
    batches.  Keys of up to ``short`` alerts are one array each, so the work per key is small; only
    fuller ones are cut into stretches.
    """
    group = ["alert_key", "channel"]
    known = alerts.where("alert_key is not null and channel is not null and ts is not null")
    sizes = known.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    full = materialise(sizes.where(F.col("n") > short).select(*group))
    few = _dedupe_short(known.join(full, group, "left_anti"), minutes, before)
    if full.isEmpty():
        return few
    return few.unionByName(_dedupe_long(known.join(full, group, "left_semi"), minutes, before, stretch_windows))


def _dedupe_short(alerts: DataFrame, minutes: int, before: DataFrame | None) -> DataFrame:
    """A key's alerts in order of (time, id), followed from one sent to the next."""
    window = minutes * 60 * 1_000_000
    rows = F.sort_array(F.collect_list(F.struct(F.unix_micros("ts").alias("us"), F.col("id").isNull().alias("last"), F.col("id").cast("long").alias("id"))))
    keys = alerts.groupBy("alert_key", "channel").agg(rows.alias("rows"))
    if before is None:
        keys = keys.withColumn("last_us", F.lit(None).cast("long"))
    else:
        keys = keys.join(before.select("alert_key", "channel", F.col("last_us").cast("long")), ["alert_key", "channel"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["rows"]
            first = lists.offsets.to_numpy()
            us = lists.values.field("us").to_numpy()
            sent: list[int] = []
            key: list[int] = []
            for k, last in enumerate(b["last_us"].to_pylist()):
                x, y = int(first[k]), int(first[k + 1])
                found = _sent(us[x:y], NEVER if last is None else last + window, window)
                sent += [x + i for i in found]
                key += [k] * len(found)
            rows = lists.values.take(pa.array(sent, pa.int64()))
            at = pa.array(key, pa.int64())
            yield pa.RecordBatch.from_arrays([b["alert_key"].take(at), b["channel"].take(at), rows.field("id"), rows.field("us")],
                                             ["alert_key", "channel", "id", "us"])

    return keys.mapInArrow(run, "alert_key string, channel string, id long, us long").select(
        "alert_key", "channel", "id", F.timestamp_micros("us").alias("ts"))


def _dedupe_long(alerts: DataFrame, minutes: int, before: DataFrame | None, stretch_windows: int) -> DataFrame:
    """Keys with any share of the log, stretch by stretch."""
    window = minutes * 60 * 1_000_000
    length = window * stretch_windows
    group = ["alert_key", "channel", "stretch"]
    df = alerts.select("alert_key", "channel", "id", "ts", F.unix_micros("ts").alias("us")).withColumns({
        "stretch": F.floor(F.col("us") / length).cast("long")})
    # Python work is bound by CPU: keep the configured number of partitions.
    parts = int(alerts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    head = "alert_key string, channel string, stretch long"
    steps = df.select(*group, "us").repartition(parts, *group).groupBy(*group).applyInPandas(
        _steps(window), f"{head}, blocked_from long, ends long")
    if before is None:
        steps = steps.withColumn("before", F.lit(NEVER).cast("long"))
    else:
        steps = steps.join(before.select("alert_key", "channel", F.col("last_us").alias("before")),
                           ["alert_key", "channel"], "left").na.fill(NEVER, ["before"])
    blocked = steps.repartition(parts, "alert_key", "channel").groupBy("alert_key", "channel").applyInPandas(_chain(window), f"{head}, blocked long")
    return df.join(blocked, group).select(*group, "id", "ts", "us", "blocked").repartition(parts, *group).groupBy(*group).applyInPandas(
        _mark(window), "alert_key string, channel string, id long, ts timestamp")
