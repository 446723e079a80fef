"""Holt-Winters for many series at once.

A chunk of series is a matrix, series by parameters of the grid, and one step of time is one update
of the whole matrix.  Series are sorted by falling length, so those that still run at a step are
the upper rows.  Seasons are a cube with one layer per place in the cycle.  Memory is bounded by
``CHUNK`` series, and work is a number of array operations per step and chunk, not per series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.prefix import materialise

#: Series that are fitted together, and those that a task is given.
CHUNK = 128
SERIES_PER_TASK = 512

LEVELS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
TRENDS = (0.01, 0.05, 0.1, 0.3)
SEASONS = (0.05, 0.1, 0.3, 0.6)


def fit(series: list[np.ndarray], horizon: int, period: int = 0, seasonal: str = "add", damp: float = 1.0):
    """(AIC, forecast, deviation of residuals) of each series, by the best parameters of the grid for it.

    ``period`` 0 means no season; no series may be shorter than the period, or than 2 without one.
    """
    order = np.argsort([-len(y) for y in series], kind="stable")
    n = np.array([len(series[i]) for i in order])
    padded = np.zeros((len(order), n[0]))
    for row, i in enumerate(order):
        padded[row, :n[row]] = series[i]
    a, b, g = (v.ravel()[None, :] for v in np.meshgrid(LEVELS, TRENDS, SEASONS if period else (0.0,)))
    rows, grid, m, mul = len(order), a.shape[1], period, seasonal == "mul"

    def tiny(x: np.ndarray) -> np.ndarray:
        return np.where(np.abs(x) < 1e-9, 1e-9, x)

    if m:
        start = padded[:, :m].mean(axis=1)
        second = np.where(n >= 2 * m, padded[:, m:2 * m].sum(axis=1) / m, padded.sum(axis=1) / n)
        slope = (second - start) / m
        first = padded[:, :m] / np.maximum(start, 1e-9)[:, None] if mul else padded[:, :m] - start[:, None]
        season = np.repeat(first.T[:, :, None], grid, axis=2)
    else:
        start, slope = padded[:, 0], padded[:, 1] - padded[:, 0]
        season = np.full((1, rows, grid), 1.0 if mul else 0.0)
    level, trend = (np.repeat(v[:, None], grid, axis=1) for v in (start, slope))
    squares, sums = np.zeros((rows, grid)), np.zeros((rows, grid))
    running = np.searchsorted(-n, -np.arange(n[0]), side="left")  # series that are longer than t
    with np.errstate(all="ignore"):
        for t in range(n[0]):
            k = running[t]
            y, s, old = padded[:k, t, None], season[t % max(m, 1), :k], level[:k]
            base = old + damp * trend[:k]
            error = y - (base * s if mul else base + s)
            squares[:k] += error * error
            sums[:k] += error
            new = a * (y / tiny(s) if mul else y - s) + (1 - a) * base
            trend[:k] = b * (new - old) + (1 - b) * damp * trend[:k]
            if m:
                season[t % m, :k] = g * (y / tiny(new) if mul else y - new) + (1 - g) * s
            level[:k] = new
        best = np.argmin(np.where(np.isnan(squares), np.inf, squares), axis=1)
        at = (np.arange(rows), best)
        mean = squares[at] / n
        aic = n * np.log(np.maximum(mean, 1e-12)) + 2 * (3 + m + (damp < 1))
        ahead = level[at][:, None] + np.cumsum(damp ** np.arange(1, horizon + 1))[None, :] * trend[at][:, None]
        if m:
            tail = season[(n[:, None] + np.arange(horizon)) % m, np.arange(rows)[:, None], best[:, None]]
            ahead = ahead * tail if mul else ahead + tail
        deviation = np.sqrt(np.maximum(mean - (sums[at] / n) ** 2, 0.0))
    back = np.empty(rows, "int64")
    back[order] = np.arange(rows)
    return aic[back], ahead[back], deviation[back]


def season_length(n: int, grain: str) -> int:
    """Periods per season by grain and history length (0 = none)."""
    if grain == "biweekly":
        return 6 if n >= 12 else 3 if n >= 6 else 0
    return 13 if n >= 26 else 4 if n >= 8 else 0


#: A model of a series: values, horizon -> name, forecast, deviation of residuals.
Fitted = tuple[str, np.ndarray, float]


def best_of(series: list[np.ndarray], grains: list[str], horizon: int) -> list[Fitted]:
    """Seasonal (both kinds), monthly, damped and plain trends of each series; the lowest AIC wins, the first of equals.

    A series of one value is continued by it.
    """
    plans: dict[tuple, list[int]] = {}
    for i, (y, grain) in enumerate(zip(series, grains)):
        n, period, zero = len(y), season_length(len(y), grain), bool((y == 0).any())
        if n < 2:
            continue
        if period and n >= period + 2:
            plans.setdefault((0, "seasonal-add", period, "add", 1.0), []).append(i)
            if not zero:
                plans.setdefault((1, "seasonal-mul", period, "mul", 1.0), []).append(i)
        if period > 4 and n >= 6:
            plans.setdefault((2, "monthly-add", 4, "add", 1.0), []).append(i)
        plans.setdefault((3, "damped", 0, "add", 0.9), []).append(i)
        plans.setdefault((4, "linear", 0, "add", 1.0), []).append(i)
    scored: dict[int, tuple] = {}
    for (place, name, period, kind, damp), members in sorted(plans.items()):
        lifted = [series[i] + 0.1 if kind == "add" and period and (series[i] == 0).any() else series[i] for i in members]
        for i, aic, ahead, sd in zip(members, *fit(lifted, horizon, period, kind, damp)):
            if np.isfinite(aic) and np.isfinite(ahead).all() and (i not in scored or (aic, place) < scored[i][:2]):
                scored[i] = aic, place, name, ahead, float(sd)
    flat = [("flat", np.full(horizon, float(y.mean()) if len(y) else 0.0), 0.0) for y in series]
    return [scored[i][2:] if i in scored else flat[i] for i in range(len(series))]


def weekly_seasons(series: list[np.ndarray], grains: list[str], horizon: int) -> list[Fitted]:
    """Additive season of 7 days, or a plain line where two weeks are not there."""
    long = [i for i, y in enumerate(series) if len(y) >= 14]
    out: dict[int, Fitted] = {}
    if long:
        _, ahead, sd = fit([series[i] for i in long], horizon, 7)
        out = {i: ("holt_winters:7", ahead[r], float(sd[r])) for r, i in enumerate(long)}
    for i, y in enumerate(series):
        if i not in out:
            line = np.polyfit(np.arange(len(y)), y, 1) if len(y) > 1 else np.array([0.0, y[0]])
            out[i] = "linear", np.polyval(line, np.arange(len(y), len(y) + horizon)), float(y.std())
    return [out[i] for i in range(len(series))]


def forecast_all(
    rows: DataFrame, key: str, value: str, models: Callable[[list, list, int], list[Fitted]],
    band: Callable[[np.ndarray], np.ndarray], prefix: str = "",
) -> DataFrame:
    """``models`` over all series of ``rows`` (key, date, value, grain, horizon); a row per series and step.

    ``band`` gives the half width of the bounds in residual deviations for steps 0, 1, ...  A series is one
    array in order of time; the number of tasks follows from the number of series.
    """
    kind = dict(rows.dtypes)[key]
    series = rows.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("date", F.col(value).cast("double").alias("y")))).getField("y").alias("ys"),
        F.max("grain").alias("grain"), F.max("horizon").cast("int").alias("horizon"))
    # Written, so that the series are built once and then counted.
    series = materialise(series)
    tasks = -(-series.count() // SERIES_PER_TASK)
    tasks = max(tasks, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks * 8), 1)
    names = [key, "step", "forecast", "lower", "upper", "model"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                ys = [np.array(y, dtype=float) for y in b["ys"].to_pylist()]
                grains, horizons = b["grain"].to_pylist(), b["horizon"].to_pylist()
                fitted = models(ys, grains, max(horizons))
                row = np.repeat(np.arange(b.num_rows), horizons)
                step = np.concatenate([np.arange(h) for h in horizons])
                mean = np.maximum(np.concatenate([f[1][:h] for f, h in zip(fitted, horizons)]), 0)
                half = np.array([f[2] for f in fitted])[row] * band(step)
                yield pa.RecordBatch.from_arrays(
                    [b[key].take(pa.array(row)), pa.array(step + 1, pa.int32()), pa.array(mean), pa.array(np.maximum(mean - half, 0)),
                     pa.array(mean + half), pa.array([prefix + f[0] for f in fitted], pa.string()).take(pa.array(row))], names)

    return series.repartition(tasks, key).mapInArrow(
        run, f"{key} {kind}, step int, forecast double, lower double, upper double, model string")
