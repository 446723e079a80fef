"""Filter interaction audit: what each filter removes in every order of the filters.

Every document has a mask of the filters that it fails.  Masks are counted per part before any
shuffle, so a part comes down to at most 2^n weighted masks.  These make an ordered decision
diagram: a level per filter, a pass and a fail child per node, equal nodes of a level shared, and
in each node the documents below it.  Swapping two adjacent levels keeps the node above and
rebuilds the lower level; plain changes reach every order by such swaps.  The path on which all
filters pass then gives an order's steps: the fail child of a step holds what it removes, the pass
child what is left.

Defined results: null text is empty, null part the empty string.  A document is a copy if a row of
a smaller id has the same text; a null id is neither smaller than another nor a copy.  Repeated
rows count as often as they occur.  A document is good (toxic) if any row of ``labels`` with its id
says so; a null label says nothing.  An empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The filters of ``failures``: short, repetitive, upper case, symbols, copy of a smaller id.
FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
SYMBOLS = b"#$%&*|"

_COPY = 1 << FILTERS.index("E")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUATION = bytes(range(0x80, 0xC0))
_STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, " \
         "unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: bytes) -> int:
    """Filters that a UTF-8 text fails by itself, as bits."""
    words = text.split()  # bytes are parted at the ASCII white space alone
    points = len(text.translate(None, _CONTINUATION))
    upper = len(text) - len(text.translate(None, _UPPER))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * upper > UPPER_PERCENT * points,
        len(text.translate(None, SYMBOLS)) < len(text),
    )
    return sum(1 << k for k, f in enumerate(fails) if f)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Table (doc_id, part, mask, digest): the filters that each text fails by itself."""

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["part"], pa.array([text_mask(t) for t in texts], pa.int32()),
                 pa.array([sha256(t).digest()[:16] for t in texts], pa.binary())],
                ["doc_id", "part", "mask", "digest"],
            )

    source = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        docs[text_col].cast("string").cast("binary").alias("text"),
    )
    return source.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def weighted_masks(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Table (part, mask, n, good, toxic) of ``failures``, with copies of smaller ids as the last filter."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    ).where("doc_id is not null").select(F.col("doc_id").alias("key"), F.lit(True).alias("real"), "good", "toxic")
    rows = failed.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    # Rows without an id have no label; a key from their text spreads them.
    keyed = rows.withColumns({"real": F.col("doc_id").isNotNull(), "key": F.coalesce("doc_id", F.xxhash64("digest"))})
    labelled = keyed.join(known, ["key", "real"], "left").na.fill(False, ["good", "toxic"])
    # A group of copies is a few rows from here on, however many documents it has.
    first = F.min(F.when(F.col("real"), F.struct("doc_id", "n")))
    groups = labelled.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("real"), F.lit(0)).otherwise(F.col("n"))).alias("unnamed"), first.alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    marked = groups.withColumn("own", F.col("unnamed") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    either = F.array(
        F.struct("mask", F.col("own").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(_COPY)).alias("mask"), (F.col("n") - F.col("own")).alias("n")),
    )
    split = marked.select("part", "good", "toxic", F.explode(either).alias("x")).select("part", "good", "toxic", "x.*")
    count = F.sum("n")
    return split.groupBy("part", "mask").agg(
        count.alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


class Diagram:
    """Ordered decision diagram of weighted masks; node 0 is the empty one.

    ``levels[k]`` maps the nodes that decide filter ``order[k]`` to (pass child, fail child);
    ``weight[x]`` is the sum of the weights below node x.
    """

    def __init__(self, filters: int, weights: dict[int, tuple[int, ...]]):
        width = max((len(w) for w in weights.values()), default=1)
        self.weight: list[tuple[int, ...]] = [(0,) * width]
        self.order = list(range(filters))
        ends: dict[tuple[int, ...], int] = {}
        below: dict[int, int] = {}
        for mask, w in weights.items():
            if any(w):
                if w not in ends:
                    ends[w] = len(self.weight)
                    self.weight.append(w)
                below[mask] = ends[w]
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in self.order]
        for k in reversed(self.order):
            shared: dict[tuple[int, int], int] = {}
            bit = 1 << k
            below = {m: self._node(shared, below.get(m, 0), below.get(m | bit, 0)) for m in {m & ~bit for m in below}}
            self.levels[k] = {x: children for children, x in shared.items()}
        self.root = below.get(0, 0)

    def _node(self, shared: dict[tuple[int, int], int], passes: int, fails: int) -> int:
        if not passes and not fails:
            return 0
        if (passes, fails) not in shared:
            shared[passes, fails] = len(self.weight)
            self.weight.append(tuple(a + b for a, b in zip(self.weight[passes], self.weight[fails])))
        return shared[passes, fails]

    def swap(self, k: int) -> None:
        """Exchanges levels ``k`` and ``k + 1``; nodes above and below stay as they are."""
        upper, lower = self.levels[k], self.levels[k + 1]
        shared: dict[tuple[int, int], int] = {}
        for x, (passes, fails) in upper.items():
            pp, pf = lower.get(passes, (0, 0))
            fp, ff = lower.get(fails, (0, 0))
            upper[x] = self._node(shared, pp, fp), self._node(shared, pf, ff)
        self.levels[k + 1] = {x: children for children, x in shared.items()}
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, weight that it removes, weight that is left) down the path of passes."""
        at = self.root
        for filter_, level in zip(self.order, self.levels):
            at, fails = level.get(at, (0, 0))
            yield filter_, self.weight[fails], self.weight[at]


def plain_changes(n: int) -> Iterator[int]:
    """Places k whose swaps (k, k + 1) lead once through every order of n things."""
    if n < 2:
        return
    leftwards = True
    for inner in chain(plain_changes(n - 1), [None]):
        yield from range(n - 2, -1, -1) if leftwards else range(n - 1)
        if inner is not None:
            yield inner + leftwards  # the last thing stands in front after a way to the left
        leftwards = not leftwards


def audit(weights: DataFrame, names: str = FILTERS) -> DataFrame:
    """Rows (part, filter_order, step, ...) of every order from ``weighted_masks``; bit k is filter ``names[k]``."""

    def every_order(pdf: pd.DataFrame) -> pd.DataFrame:
        part, masks = pdf["part"].iloc[0], {m: (n, g, t) for m, n, g, t in zip(
            *(pdf[c].tolist() for c in ("mask", "n", "good", "toxic")))}
        failing = [sum(w[0] for m, w in masks.items() if m >> k & 1) for k in range(len(names))]
        alone = [masks.get(1 << k, (0,))[0] for k in range(len(names))]
        diagram, share, rows = Diagram(len(names), masks), [0] * len(names), []
        for change in chain([None], plain_changes(len(names))):
            if change is not None:
                diagram.swap(change)
            order = "".join(names[k] for k in diagram.order)
            for step, (k, gone, left) in enumerate(diagram.steps(), 1):
                share[k] += gone[0]
                rows.append((k, order, step, left[0], gone[0], failing[k] - gone[0], alone[k], gone[1], gone[2]))
        return pd.DataFrame([(part, *r[1:], share[r[0]]) for r in rows], columns=[c.split()[0] for c in _STEPS.split(", ")])

    return weights.groupBy("part").applyInPandas(every_order, _STEPS)
