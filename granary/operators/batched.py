"""Series of many products as arrays: periods, caps, decomposition, models and seasons.

Every product is one row with its history as an array in order of time, as long as the calendar at
most.  Tasks take such rows in chunks; steps whose cost lies in the recursion or in moving windows
run on a matrix of all series of a chunk, the rest on one array at a time.  The results are those
of the long-form operators in ``series`` and ``forecast``, which need a sort and a window per step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import holtwinters as hw

KEY = "product_id"
CHUNK = hw.CHUNK
#: The first Monday of the calendar, in days; weeks are counted from it.
MONDAY = 4


def tasks_for(df: DataFrame, per_task: int = hw.SERIES_PER_TASK) -> int:
    """Partitions for CPU-bound work on the rows of ``df``: by their number, and no fewer than the cores can share."""
    found = -(-df.count() // per_task)
    return max(found, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), found * 8), 1)


def training_tasks(df: DataFrame, per_task: int = 500_000, few: int = 20_000) -> int:
    """Partitions of a table that trees learn from: each level of a tree shuffles between all of them.

    Their number squared is the cost of that shuffle, so beyond the tasks that the cores share a task gets many rows.
    """
    rows = df.count()
    return max(-(-rows // per_task), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // few) * 8), 1)


def lists(column: pa.ListArray) -> list[np.ndarray]:
    """The arrays of a column as views of its values."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in zip(at, at[1:])]


def variance(y: np.ndarray) -> float:
    """Variance of a short array, without the checks of ``ndarray.var`` that cost more than the sums."""
    away = y - y.sum() / len(y)
    return float(away @ away) / len(y)


# ---- decomposition -------------------------------------------------------------------

def decomposed(series: list[np.ndarray], p: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(trend, seasonal, residuals) of series of at least two periods ``p``, as one matrix.

    The trend is a centred moving average whose ends go on along the line through its nearest ``p`` values.
    """
    n = np.array([len(y) for y in series])[:, None]
    width = int(n.max())
    y = np.zeros((len(series), width))
    for k, s in enumerate(series):
        y[k, :len(s)] = s
    i, h = np.arange(width)[None, :], p // 2
    back = n - 1 - h
    sums = np.concatenate([np.zeros((len(series), 1)), np.cumsum(y, axis=1)], axis=1)
    mean = np.zeros_like(y)
    inner = slice(h, width - h)
    total = sums[:, 2 * h + 1:] - sums[:, :width - 2 * h]
    if p % 2 == 0:
        total = total - 0.5 * (y[:, :width - 2 * h] + y[:, 2 * h:])
    mean[:, inner] = total / p

    def line(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slope, intercept) through the chosen values of each row, centred first."""
        count = chosen.sum(axis=1, keepdims=True)
        mx = (i * chosen).sum(axis=1, keepdims=True) / count
        my = (mean * chosen).sum(axis=1, keepdims=True) / count
        dx = (i - mx) * chosen
        slope = (dx * (mean - my)).sum(axis=1, keepdims=True) / (dx * dx).sum(axis=1, keepdims=True)
        return slope, my - slope * mx

    head = line((i >= h) & (i < np.minimum(h + p, back)))
    tail = line((i >= np.maximum(h, back - p)) & (i < back))
    trend = np.where(i < h, head[0] * i + head[1], np.where(i > back, tail[0] * i + tail[1], mean))
    held = i < n
    off = np.where(held, y - trend, 0.0)
    layers = -(-width // p)
    cube = np.zeros((len(series), layers * p))
    cube[:, :width] = off
    places = np.zeros((len(series), layers * p))
    places[:, :width] = held
    phase = cube.reshape(-1, layers, p).sum(axis=1) / places.reshape(-1, layers, p).sum(axis=1)
    seasonal = (phase - phase.mean(axis=1, keepdims=True))[:, np.arange(width) % p]
    return [(trend[k, :m], seasonal[k, :m], off[k, :m] - seasonal[k, :m]) for k, m in enumerate(n[:, 0])]


def by_period(series: list[np.ndarray], wanted: list[tuple[int, ...]]) -> list[dict[int, tuple]]:
    """``decomposed`` of every series for each period wanted that fits twice into it."""
    out: list[dict[int, tuple]] = [{} for _ in series]
    for p in sorted({p for ps in wanted for p in ps}):
        rows = [k for k, (y, ps) in enumerate(zip(series, wanted)) if p in ps and len(y) >= 2 * p]
        if rows:
            for k, parts in zip(rows, decomposed([series[k] for k in rows], p)):
                out[k][p] = parts
    return out


def seasonality(series: DataFrame, periods: tuple[int, ...], min_rows: int) -> DataFrame:
    """Strongest period of each product and its share of the detrended variance; ties keep the shorter one.

    Input has ``product_id, date, qty``; products with fewer than ``min_rows`` rows drop out.
    """
    kind = dict(series.dtypes)[KEY]
    arrays = as_arrays(series, "qty").where(F.size("ys") >= min_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                ys = lists(b["ys"])
                best: list[tuple] = []
                for parts in by_period(ys, [periods] * len(ys)):
                    scored = []
                    for p, (_, seasonal, rest) in parts.items():
                        vs, vr = variance(seasonal), variance(rest)
                        scored.append((p, vs / (vs + vr) if vs + vr > 0 else 0.0))
                    best.append(max(scored, key=lambda s: (round(s[1], 9), -s[0]), default=(None, None)))
                yield pa.RecordBatch.from_arrays(
                    [b[KEY], pa.array([p if s and s > 0 else None for p, s in best], pa.int32()), pa.array([s for _, s in best], pa.float64())],
                    [KEY, "period", "strength"])

    return arrays.mapInArrow(run, f"{KEY} {kind}, period int, strength double").where("strength is not null")


def as_arrays(series: DataFrame, value: str, *more: Column) -> DataFrame:
    """A row per product with ``ys``, the values in order of time."""
    return series.groupBy(KEY).agg(
        F.sort_array(F.collect_list(F.struct("date", F.col(value).cast("double").alias("y")))).getField("y").alias("ys"), *more)


# ---- periods ---------------------------------------------------------------------------

def sold_weeks(daily: DataFrame) -> DataFrame:
    """A row per product with its selling weeks (number of the week, quantity) in order.

    Sales without a date belong to no week; weeks without a known quantity count as silent.
    """
    week = F.floor((F.unix_date("date") - MONDAY) / 7).cast("int")
    sold = daily.where("date is not null").groupBy(KEY, week.alias("week")).agg(F.coalesce(F.sum("qty").cast("double"), F.lit(0.0)).alias("y"))
    return sold.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("week", "y"))).alias("sold"))


def dense_periods(weeks: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int]:
    """(quantities with silent periods, weeks per period): pairs of weeks where fewer than half of eight or more sold."""
    n = int(weeks[-1] - weeks[0]) + 1
    length = 2 if n >= 8 and (y > 0).sum() < 0.5 * n else 1
    slot = (weeks - weeks[0]) // length
    return np.bincount(slot, weights=y, minlength=int(slot[-1]) + 1), length


def quantile(ordered: np.ndarray, share: float) -> float:
    """Linear quantile of sorted values."""
    place = share * (len(ordered) - 1)
    k = int(place)
    low, high = float(ordered[k]), float(ordered[min(k + 1, len(ordered) - 1)])
    return low + (high - low) * (place - k)


def capped(y: np.ndarray) -> np.ndarray:
    """At most twice the 99th percentile of selling periods; a lone spike is shared with its neighbours."""
    if len(y) < 4:
        return y
    positive = np.sort(y[y > 0])
    middle = quantile(positive, 0.5) if len(positive) else 1.0
    out = np.minimum(y, 2.0 * quantile(positive, 0.99)) if len(positive) else y
    limit = 5 * middle
    if len(positive) >= 0.3 * len(y) or not out.max() > limit:
        return out
    last = len(out) - 1
    width = np.minimum(np.arange(len(out)) + 1, last) - np.maximum(np.arange(len(out)) - 1, 0) + 1
    ahead, carry = [], 0.0
    for v, w in zip(out.tolist(), width.tolist()):
        v = max(v, carry)
        ahead.append(v)
        carry = v / w if v > limit else 0.0
    raised = np.array(ahead)
    following, shares = np.append(raised[1:], 0.0), np.append((raised / width)[1:], 0.0)
    return np.where(following > limit, np.maximum(raised, shares), raised)


# ---- models over a chunk -----------------------------------------------------------------

#: Mean of each step, lower and upper bound, name of the model.
Steps = tuple[np.ndarray, np.ndarray, np.ndarray, str]


def naive_steps(qty: np.ndarray, horizon: int) -> Steps:
    """The last cycle again."""
    n = len(qty)
    cycle = 52 if n >= 52 else 13 if n >= 26 else 4 if n >= 8 else n
    k = np.arange(horizon)
    mean = np.maximum(qty[n - cycle + k % cycle], 0.0)
    band = 1.5 * qty.std() * (1 + 0.05 * k)
    return mean, np.maximum(mean - band, 0.0), mean + band, f"seasonal_naive:{cycle}"


def decomposition_period(n: int, grain: str) -> int:
    """Period of the decomposition forecast (0 = too short)."""
    if grain == "biweekly":
        return 6 if n >= 12 else 3 if n >= 6 else 0
    return 13 if n >= 26 else 4 if n >= 8 else 0


def decomposition_steps(parts: tuple, p: int, horizon: int) -> Steps:
    """Line through the extended trend plus the last cycle."""
    trend, seasonal, rest = parts
    n, k = len(trend), np.arange(horizon)
    away = np.arange(n) - (n - 1) / 2
    slope = float(away @ trend) * 12 / (n * (n * n - 1))
    at0 = float(trend.mean()) - slope * (n - 1) / 2
    mean = np.maximum(at0 + slope * (n + k) + seasonal[n - p + k % p], 0.0)
    band = 1.96 * variance(rest) ** 0.5 * (1 + 0.03 * k)
    return mean, np.maximum(mean - band, 0.0), mean + band, f"decomposition:{p}"


def model_steps(smooth: list[np.ndarray], qty: list[np.ndarray], grains: list[str], choices: list[str], horizon: int) -> list[Steps | None]:
    """Forecast of each series by the model chosen for it."""
    out: list[Steps | None] = [None] * len(qty)
    rows = [k for k, c in enumerate(choices) if c == "holt_winters"]
    for k, (name, ahead, sd) in zip(rows, hw.best_of([smooth[k] for k in rows], [grains[k] for k in rows], horizon) if rows else []):
        mean = np.maximum(ahead, 0.0)
        band = 1.96 * sd * (1 + 0.02 * np.arange(horizon))
        out[k] = mean, np.maximum(mean - band, 0.0), mean + band, f"holt_winters:{name}"
    wanted = [(decomposition_period(len(y), g),) if c == "decomposition" else () for y, g, c in zip(smooth, grains, choices)]
    for k, parts in enumerate(by_period(smooth, [tuple(p for p in ps if p) for ps in wanted])):
        for p, found in parts.items():
            out[k] = decomposition_steps(found, p, horizon)
    for k, c in enumerate(choices):
        if c == "seasonal_naive":
            out[k] = naive_steps(qty[k], horizon)
    return out


#: Periods of the season given to flat forecasts, in order of preference.
ENRICH = {"weekly": (13, 4, 8, 6), "biweekly": (6, 3)}


def enriched(steps: list[Steps | None], qty: list[np.ndarray], grains: list[str], horizons: list[int]) -> list[Steps | None]:
    """Flat forecasts with the season of the history, where that is strong enough."""
    def flat(s: Steps | None, h: int) -> bool:
        if s is None or h < 2:
            return False
        mean = s[0][:h].mean()
        return mean > 0 and s[0][:h].std() / mean <= 0.12

    wanted = [ENRICH[g] if flat(s, h) and len(y) >= 8 else () for s, y, g, h in zip(steps, qty, grains, horizons)]
    out = list(steps)
    for k, parts in enumerate(by_period(qty, wanted)):
        scored = []
        for p, (_, seasonal, rest) in parts.items():
            n, vs = len(seasonal), variance(seasonal)
            level = qty[k][n - p * min(3, n // p):].mean()
            scored.append((vs / (vs + variance(rest) + 1e-10), p, level, seasonal[n - p:]))
        if not scored:
            continue
        strength, p, level, cycle = max(scored, key=lambda s: (round(s[0], 9), -wanted[k].index(s[1])))
        if strength >= 0.1 and level > 0:
            mean, low, high, name = steps[k]
            share = np.clip(1.0 + cycle[np.arange(len(mean)) % p] / level, 0.4, 2.0)
            out[k] = mean * share, low * share, high * share, name if name.startswith("seasonal") else f"{name}+season"
    return out


# ---- rolling-origin scores -----------------------------------------------------------------

MODELS = ("double_exponential_smoothing", "exponential_smoothing", "linear_regression", "moving_average",
          "seasonal_decomposition", "weighted_moving_average")


def smoothed_states(series: list[np.ndarray], alpha: float, beta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(single level, double level, trend) after every value; a matrix of all series, a step of time at once."""
    width = max(len(y) for y in series)
    y = np.zeros((len(series), width))
    for k, s in enumerate(series):
        y[k, :len(s)] = s
    single, level, trend = y.copy(), y.copy(), np.zeros_like(y)
    if width > 1:
        trend[:, 0] = y[:, 1] - y[:, 0]
    for t in range(1, width):
        single[:, t] = alpha * y[:, t] + (1 - alpha) * single[:, t - 1]
        level[:, t] = alpha * y[:, t] + (1 - alpha) * (level[:, t - 1] + trend[:, t - 1])
        trend[:, t] = beta * (level[:, t] - level[:, t - 1]) + (1 - beta) * trend[:, t - 1]
    return single, level, trend


def rolling_forecasts(y: np.ndarray, states: tuple, cuts: list[int], period: int = 7) -> dict[str, np.ndarray]:
    """Forecast of every row from the first cut on by each model, fitted on the rows before the last cut behind it.

    Sums over the rows before a cut are differences of running sums, so further cuts cost no further pass.
    """
    n, i = len(y), np.arange(len(y))
    run = {name: np.concatenate([[0.0], np.cumsum(v)]) for name, v in (("y", y), ("iy", i * y))}
    mean = np.array([(run["y"][k + 1] - run["y"][max(0, k + 1 - period)]) / min(period, k + 1) for k in range(n)])
    off = y - mean
    out: dict[str, list[np.ndarray]] = {m: [] for m in MODELS}
    single, level, trend = states
    for c, end in zip(cuts, [*cuts[1:], n]):
        rows = i[c:end]
        sx, sxx = c * (c - 1) / 2, (c - 1) * c * (2 * c - 1) / 6
        slope = (c * run["iy"][c] - sx * run["y"][c]) / (c * sxx - sx * sx)
        phase = np.bincount(i[:c] % period, weights=off[:c], minlength=period) / np.bincount(i[:c] % period, minlength=period)
        weights = np.arange(1, period + 1)
        ahead = {
            "exponential_smoothing": np.full(len(rows), single[c - 1]),
            "double_exponential_smoothing": level[c - 1] + trend[c - 1] * (rows - c + 1),
            "moving_average": np.full(len(rows), (run["y"][c] - run["y"][c - period]) / period),
            "weighted_moving_average": np.full(len(rows), (y[c - period:c] * weights).sum() / weights.sum()),
            "linear_regression": np.maximum((run["y"][c] - slope * sx) / c + slope * rows, 0.0),
            "seasonal_decomposition": np.maximum(mean[c - 1] + (phase - phase.mean())[rows % period], 0.0),
        }
        for m, v in ahead.items():
            out[m].append(v)
    return {m: np.concatenate(v) for m, v in out.items()}


def rolling_scores(series: DataFrame, shares: tuple[float, ...], alpha: float, beta: float, min_rows: int = 14) -> DataFrame:
    """Error and last value of six models on the same held-out rows: those from each cut to the next."""
    kind = dict(series.dtypes)[KEY]
    arrays = as_arrays(series, "qty").where(F.size("ys") >= min_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                ys = [np.array(y) for y in b["ys"].to_pylist()]
                single, level, trend = smoothed_states(ys, alpha, beta)
                rows = []
                for k, y in enumerate(ys):
                    cuts = sorted({int(len(y) * s) for s in shares})
                    held = y[cuts[0]:]
                    known = held != 0
                    for model, p in rolling_forecasts(y, (single[k], level[k], trend[k]), cuts).items():
                        mape = float(np.abs((held - p)[known] / held[known]).mean() * 100) if known.any() else 100.0
                        rows.append((mape, float(np.sqrt(((held - p) ** 2).mean())), float(p[-1]), model))
                mape, rmse, last, model = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [b[KEY].take(pa.array(np.repeat(np.arange(len(ys)), len(MODELS)))), pa.array(mape, pa.float64()), pa.array(rmse, pa.float64()),
                     pa.array(last, pa.float64()), pa.array(model, pa.string())], [KEY, "mape", "rmse", "last", "model"])

    return arrays.mapInArrow(run, f"{KEY} {kind}, mape double, rmse double, last double, model string")
