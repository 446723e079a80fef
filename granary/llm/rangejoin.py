"""Embedding near-duplicates: exact metric range join over pivots.

The angle between vectors is a metric, and a cosine limit is an angle limit.  Pivots taken from
the data partition the vectors: a vector's home is the cell of its nearest pivot.  If y has its
home in cell j and lies within the angle t of x, the triangle inequality gives
d(x, p_j) <= d(y, p_j) + t <= radius_j + t and d(x, p_j) <= d(x, p_home) + 2 t; x is replicated
to exactly the cells for which both can hold, and of two cells only to the one with the smaller
number.  Cells join independently: inside, vectors are compared in blocks, and blocks whose
distances to the pivot differ by more than t are skipped.

Large cells are cut into slices of home rows and of visiting rows; every pair of slices is a task
of its own, so memory is bounded and no vector is left out.  Equal vectors are one class with a
count, so copies are never paired.  A task returns one row per vector with links: how many
vectors it links with there, and one neighbour in the spanning forest of the task's links.

Defined results: null and zero vectors and vectors with a null, NaN or infinite component link
with nothing; vectors of unequal length are compared as if zeros filled the shorter one; repeated
rows count as further vectors; further columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.prefix import materialise
from granary.llm.components import components

#: Rows of a home slice (held by a task) and of a visiting slice (read by it in batches).
HOME_ROWS = 2048
VISIT_ROWS = 16_384
#: Number of pivots: a quarter of the square root of the number of vectors, at most this many.
MAX_PIVOTS = 512
#: Widens the bounds, so that rounding cannot lose a pair.
SLACK = 1e-7


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def classes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Table (vec, n, least, cid): the different vectors that can link, padded to one length."""
    v = vectors.select(vectors[id_col].alias("vec_id"), vectors[vec_col].cast("array<double>").alias("vec"))
    sound = v.filter(
        F.col("vec").isNotNull()
        & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vec", lambda x: x != 0)
    ).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # one zero
    size = sound.agg(F.max(F.size("vec"))).first()[0] or 0
    padded = sound.withColumn(
        "vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size("vec"), F.lit(0))))
    )
    # Written at once: the numbers cannot change when a task runs again.
    return materialise(
        padded.groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
        .withColumn("cid", F.monotonically_increasing_id())
    )


def _pivots(table: DataFrame, n: int) -> np.ndarray:
    k = max(1, min(MAX_PIVOTS, round(math.sqrt(n) / 4)))
    rows = table.select("vec").orderBy(F.xxhash64("vec"), "cid").limit(k).collect()
    p = np.array([r[0] for r in rows], dtype=np.float64)
    return p / np.linalg.norm(p, axis=1)[:, None]


def _placed(table: DataFrame, pivots: np.ndarray, limit: float) -> DataFrame:
    """Table (cell, role, part, cid, vec, n, d): home rows and visiting rows of every task."""

    def homes(batches):
        for b in batches:
            d = _angles(_matrix(b["vec"]), pivots)
            home = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b["cid"], b["vec"], b["n"], pa.array(home.astype(np.int32)), pa.array(d.min(axis=1))],
                ["cid", "vec", "n", "home", "near"],
            )

    at_home = materialise(
        table.select("cid", "vec", "n").mapInArrow(homes, "cid long, vec array<double>, n long, home int, near double")
    )
    radius = np.zeros(len(pivots))
    residents = np.zeros(len(pivots), dtype=np.int64)
    for r in at_home.groupBy("home").agg(F.max("near"), F.count(F.lit(1))).collect():  # a row per pivot
        radius[r[0]], residents[r[0]] = r[1], r[2]
    slices = [max(1, -(-int(x) // HOME_ROWS)) for x in residents]

    def visits(batches):
        for b in batches:
            x = _matrix(b["vec"])
            if not len(x):
                continue
            d = _angles(x, pivots)
            home, near = b["home"].to_numpy(), b["near"].to_numpy()
            reach = (d <= radius + limit + SLACK) & (d <= near[:, None] + 2 * limit + SLACK)
            reach &= np.arange(len(pivots)) < home[:, None]
            reach[np.arange(len(x)), home] = True  # compared with its own cell too
            row, cell = np.nonzero(reach)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b["cid"].take(rows), b["vec"].take(rows), b["n"].take(rows), pa.array(cell.astype(np.int32)),
                 pa.array(d[row, cell]), pa.array(home[row] == cell)],
                ["cid", "vec", "n", "cell", "d", "resident"],
            )

    seen = at_home.mapInArrow(
        visits, "cid long, vec array<double>, n long, cell int, d double, resident boolean"
    )
    seen = materialise(seen)
    counts = {r[0]: r[1] for r in seen.groupBy("cell").count().collect()}  # a row per pivot
    parts = [max(1, -(-int(counts.get(j, 0)) // VISIT_ROWS)) for j in range(len(pivots))]
    n_home = F.get(F.array(*map(F.lit, slices)), F.col("cell"))
    n_visit = F.get(F.array(*map(F.lit, parts)), F.col("cell"))
    slot = F.xxhash64("cid", F.lit("home"))
    home_rows = (
        seen.filter("resident").withColumn("h", F.pmod(slot, n_home).cast("int"))
        .withColumn("v", F.explode(F.sequence(F.lit(0), n_visit - 1))).withColumn("role", F.lit(0))
    )
    visit_rows = (
        seen.withColumn("v", F.pmod(F.xxhash64("cid", F.lit("visit")), n_visit).cast("int"))
        .withColumn("h", F.explode(F.sequence(F.lit(0), n_home - 1))).withColumn("role", F.lit(1))
    )
    columns = ["cell", "h", "v", "role", "d", "cid", "n", "resident", "vec"]
    return home_rows.select(*columns).unionByName(visit_rows.select(*columns))


def _joined(cosine: float, limit: float):
    """Arrow map over rows sorted by task, role and distance."""
    names = ["cid", "linked", "other"]

    class Task:
        def __init__(self, key):
            self.key, self.blocks, self.home = key, [], None

        def settle(self):
            """All home rows are read: they come in order of distance."""
            if self.home is None:
                t = pa.Table.from_batches(self.blocks) if self.blocks else None
                x = _matrix(t["vec"]) if t is not None else np.zeros((0, 1))
                self.home = (
                    x, np.linalg.norm(x, axis=1), *(t[c].to_numpy() if t is not None else np.zeros(0) for c in ("cid", "n", "d"))
                )
                self.links, self.first = np.zeros(len(x), dtype=np.int64), np.full(len(x), -1, dtype=np.int64)
                self.blocks = []

        def visit(self, b: pa.RecordBatch):
            self.settle()
            x, norm, cid, n, d = self.home
            if not len(x):
                return
            y, other, m, resident, e = (
                _matrix(b["vec"]), b["cid"].to_numpy(), b["n"].to_numpy(), b["resident"].to_numpy(zero_copy_only=False), b["d"].to_numpy()
            )
            lo, hi = np.searchsorted(d, [e.min() - limit - SLACK, e.max() + limit + SLACK])
            if lo >= hi:
                return
            near = (y @ x[lo:hi].T) / (np.linalg.norm(y, axis=1)[:, None] * norm[lo:hi]) >= cosine
            # Residents meet each other in both roles: only the ordered pair counts.
            near &= ~resident[:, None] | (other[:, None] < cid[lo:hi])
            if not near.any():
                return
            mine = near @ n[lo:hi]
            self.links[lo:hi] += m @ near
            # Spanning links: every visitor with its first home row, every home row with its first visitor.
            rows = np.flatnonzero(near.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(other[rows]), pa.array(mine[rows]), pa.array(cid[lo + near[rows].argmax(axis=1)])], names
            )
            cols = np.flatnonzero(near.any(axis=0))
            seen = near[:, cols].argmax(axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cid[lo + cols]), pa.array(np.zeros(len(cols), dtype=np.int64)), pa.array(other[seen])], names
            )
            # Visitors that share a home row, through any chain, are joined with the least of them.
            root = _block_parts(near)
            odd = np.flatnonzero(root >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(other[odd]), pa.array(np.zeros(len(odd), dtype=np.int64)), pa.array(other[root[odd]])], names
            )

        def close(self):
            self.settle()
            cid = self.home[2]
            rows = np.flatnonzero(self.links)
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[rows]), pa.array(self.links[rows]), pa.array(cid[rows])], names
                )

    def run(batches):
        task = None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in ("cell", "h", "v", "role")])
            cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                key, role = tuple(keys[:3, s]), keys[3, s]
                if task is None or task.key != key:
                    if task is not None:
                        yield from task.close()
                    task = Task(key)
                for at in range(s, e, HOME_ROWS):
                    part = batch.slice(at, min(HOME_ROWS, e - at))
                    if role == 0:
                        task.blocks.append(part)
                    else:
                        yield from task.visit(part)
        if task is not None:
            yield from task.close()

    return run


def _block_parts(near: np.ndarray) -> np.ndarray:
    """For each row of a link block the least row that it reaches through shared columns, or -1 if that is itself."""
    out = np.full(len(near), -1, dtype=np.int64)
    rows, cols = np.nonzero(near)
    if not len(rows):
        return out
    label = np.arange(len(near))
    while True:
        least = np.full(near.shape[1], len(near))
        np.minimum.at(least, cols, label[rows])
        new = label.copy()
        np.minimum.at(new, rows, least[cols])
        if (new == label).all():
            break
        label = new
    linked = np.zeros(len(near), dtype=bool)
    linked[rows] = True
    point = linked & (label != np.arange(len(near)))
    out[point] = label[point]
    return out


def groups(
    vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Table (vec_id, n_links, component_id, kept) with one row per input row."""
    table = classes(vectors, id_col, vec_col)
    n = table.count()
    everyone = vectors.select(vectors[id_col].alias("vec_id"), vectors[vec_col].cast("array<double>").alias("vec"))
    everyone = everyone.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    if n == 0:
        return everyone.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    limit = math.acos(cosine)
    placed = _placed(table, _pivots(table, n), limit)
    tasks = placed.repartition("cell", "h", "v").sortWithinPartitions("cell", "h", "v", "role", "d")
    found = materialise(tasks.mapInArrow(_joined(cosine, limit), "cid long, linked long, other long"))
    totals = found.groupBy("cid").agg(F.sum("linked").alias("linked"))
    roots = components(found.select("cid", "other"), "cid", "other")
    rooted = (
        table.select("cid", "n", "least", "vec").join(totals, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
        .select("vec", "n", "least", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "cid").alias("root"))
    )
    rooted = materialise(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    size = len(table.first()["vec"])
    whole = rooted.join(named, "root").select("vec", (F.col("n") - 1 + F.col("linked")).alias("n_links"), "component_id")
    padded = everyone.withColumn(
        "vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size("vec"), F.lit(0))))
    )
    out = padded.join(whole, "vec", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
