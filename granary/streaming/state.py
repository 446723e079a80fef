"""Keyed state of the stock ledger and of alert suppression.

Both depend on the order of events, and events come in any order.  The state of a key holds its
events in leaves, runs of time that are split when they grow beyond ``LEAF`` rows, and one table
with a row per leaf that tells what the leaf does to whatever stood before it.  A late row changes
its own leaf; what follows is taken from the table.  A batch therefore reads the leaves that it has
rows for and one table per key, whatever the age of the stream and the share of the key.

A key's rows of one micro-batch meet in one task; bytes per trigger bound them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

NEVER = -(2 ** 62)
#: Rows of a leaf; a fuller one is split.
LEAF = 1024

_START = StructType([StructField("start", LongType())])
_TABLE = StructType([StructField("rows", BinaryType())])


def _packed(*columns: np.ndarray) -> tuple[bytes]:
    return (np.stack([np.asarray(c, "<i8") for c in columns]).tobytes(),)


def _unpacked(value: tuple | None, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(value[0], "<i8") if value else np.empty(0, "<i8")
    return list(raw.reshape(columns, -1))


def _collected(batches: Iterator[pd.DataFrame], names: list[str]) -> list[np.ndarray]:
    parts = [[b[n].to_numpy("int64") for n in names] for b in batches]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, "int64") for _ in names]


def _dealt(starts: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(leaf, columns) of rows whose first column is a time; a leaf goes on to the start of the next."""
    leaf = np.searchsorted(starts, columns[0], side="right") - 1
    order = np.argsort(leaf, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
        if len(rows):
            yield int(leaf[rows[0]]), [c[rows] for c in columns]


def _split(us: np.ndarray, size: int) -> list[slice]:
    """The rows of a leaf as one piece, or as pieces of about half its size; equal times stay together."""
    if len(us) <= size:
        return [slice(0, len(us))]
    cuts = sorted({int(np.searchsorted(us, us[at], side="left")) for at in range(0, len(us), max(size // 2, 1))})
    return [slice(x, y) for x, y in zip(cuts, [*cuts[1:], len(us)])]


# ---- ledger ------------------------------------------------------------------------

def run_pair(delta: np.ndarray) -> tuple[int, int]:
    """(floor, total) of a run of events: it takes a stock x to max(floor, x + total)."""
    sums = np.cumsum(delta)
    return int(sums[-1] - sums.min()), int(sums[-1])


def folded(floors: np.ndarray, totals: np.ndarray) -> tuple[int, int]:
    """(floor, total) of runs one after another."""
    after = totals.sum() - np.cumsum(totals)
    return int((floors + after).max()), int(totals.sum())


class Ledger(StatefulProcessor):
    """Rows (us, event_id, delta) of a sku; gives (sku, events, floor, total) of all its events so far.

    A leaf holds events in order of (us, event_id), its row in the table has (start, events, floor,
    total).  Equal rows are events of their own.
    """

    def __init__(self, leaf: int = LEAF):
        self.leaf = leaf

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", _START, _TABLE)
        self.runs = handle.getValueState("runs", _TABLE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = np.stack(_unpacked(self.runs.get(), 4))
        if not table.size:
            table = np.array([[NEVER], [0], [0], [0]])
        pieces, done = [], 0
        for leaf, new in _dealt(table[0], _collected(rows, ["us", "event_id", "delta"])):
            pieces += [table[:, done:leaf], self._merged(int(table[0, leaf]), new)]
            done = leaf + 1
        table = np.concatenate([*pieces, table[:, done:]], axis=1)
        self.runs.update(_packed(*table))
        floor, total = folded(table[2], table[3])
        yield pd.DataFrame({"sku": [key[0]], "events": [int(table[1].sum())], "floor": [floor], "total": [total]})

    def _merged(self, start: int, new: list[np.ndarray]) -> np.ndarray:
        """Rows of the table for the leaf with new events, one or more."""
        held = _unpacked(self.events.getValue((start,)), 3)
        us, event, delta = (np.concatenate(c) for c in zip(held, new))
        order = np.lexsort((event, us))
        us, event, delta = us[order], event[order], delta[order]
        out = []
        for k, piece in enumerate(_split(us, self.leaf)):
            at = int(us[piece.start]) if k else start
            self.events.updateValue((at,), _packed(us[piece], event[piece], delta[piece]))
            out.append((at, piece.stop - piece.start, *run_pair(delta[piece])))
        return np.array(out).T

    def close(self) -> None:
        pass


# ---- suppression ---------------------------------------------------------------------

def sent_positions(at: np.ndarray, blocked_until: int, window: int) -> np.ndarray:
    """Positions sent from sorted times; a search per alert sent, not per row."""
    out, i = [], int(np.searchsorted(at, blocked_until, side="right"))
    while i < len(at):
        out.append(i)
        i = int(np.searchsorted(at, at[i] + window, side="right"))
    return np.array(out, "int64")


class Suppression(StatefulProcessor):
    """Rows (us, id) of a key and channel; gives (alert_key, channel, id, us, sent) of alerts whose fate changed.

    A leaf holds alerts in order of (us, id) with a flag for those sent, its row in the table has (start,
    last alert sent up to its end).  A batch works on the leaves that it enters, and on those behind
    them until the last alert sent is what it was.

    With ``horizon``, rows older than the key's newest row by more than that are left out, and leaves
    that ended before are forgotten.
    """

    def __init__(self, window: int, horizon: int | None = None, leaf: int = LEAF):
        self.window, self.horizon, self.leaf = window, horizon, leaf

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alerts = handle.getMapState("alerts", _START, _TABLE)
        self.chain = handle.getValueState("chain", _TABLE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        starts, lasts = _unpacked(self.chain.get(), 2)
        if not len(starts):
            starts, lasts = np.array([NEVER]), np.array([NEVER])
        us, ids = _collected(rows, ["us", "id"])
        oldest, starts, lasts = self._forget(us, starts, lasts)
        counts = us >= oldest
        entered = dict(_dealt(starts, [us[counts], ids[counts]]))
        out: list[pd.DataFrame] = []
        chain: list[tuple[int, int]] = []
        last, was = NEVER, NEVER  # the last alert sent before a leaf, now and before this batch
        for leaf, (start, before) in enumerate(zip(starts.tolist(), lasts.tolist())):
            if leaf in entered or last != was:
                last = self._settled(key, start, entered.get(leaf), last, out, chain)
            else:
                last = before
                chain.append((start, last))
            was = before
        self.chain.update(_packed(*np.array(chain).T))
        yield from out

    def _forget(self, us: np.ndarray, starts: np.ndarray, lasts: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """(oldest time that counts, table without the leaves that ended before it)."""
        if self.horizon is None or not len(us):
            return NEVER, starts, lasts
        held = _unpacked(self.alerts.getValue((int(starts[-1]),)), 3)[0]
        oldest = max(int(us.max()), int(held.max(initial=NEVER))) - self.horizon
        gone = int(np.searchsorted(starts[1:], oldest, side="right"))
        for s in starts[:gone].tolist():
            self.alerts.removeKey((s,))
        # The last of them stays in the table, empty: it says until when sending is blocked.
        kept = max(gone - 1, 0)
        return oldest, starts[kept:], lasts[kept:]

    def _settled(self, key, start: int, new: list[np.ndarray] | None, last: int, out: list[pd.DataFrame], chain: list[tuple[int, int]]) -> int:
        """Decides a leaf anew, notes what changed, and returns the last alert sent up to its end."""
        us, ids, was = _unpacked(self.alerts.getValue((start,)), 3)
        if new is not None:
            us, ids, was = np.concatenate([us, new[0]]), np.concatenate([ids, new[1]]), np.concatenate([was, np.zeros(len(new[0]), "int64")])
            order = np.lexsort((was == 0, ids, us))
            us, ids, was = us[order], ids[order], was[order]
        sent = np.zeros(len(us), "int64")
        sent[sent_positions(us, NEVER if last == NEVER else last + self.window, self.window)] = 1
        for k, piece in enumerate(_split(us, self.leaf)):
            at = int(us[piece.start]) if k else start
            self.alerts.updateValue((at,), _packed(us[piece], ids[piece], sent[piece]))
            last = int(us[piece][sent[piece] == 1].max(initial=last))
            chain.append((at, last))
        changed = np.flatnonzero(sent != was)
        if len(changed):
            out.append(pd.DataFrame({"alert_key": key[0], "channel": key[1], "id": ids[changed], "us": us[changed], "sent": sent[changed] == 1}))
        return last

    def close(self) -> None:
        pass
