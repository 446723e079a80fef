"""Chat formatting by cumulative-snapshot collapse.

A log holds snapshots of growing conversations.  Every turn gets a rolling hash of all turns up to
it; a conversation goes if its last hash also stands inside a longer one (an anti-join), or ends an
equal one of smaller id.  Only what is left is rendered.

The hash of a prefix is a pair of sums over hashes of (position, digest of the turn), so it rolls
on turn by turn and its parts can be added up across tasks.  Only digests move before rendering.

Every conversation is rendered in parts of about ``PART`` characters and at most one turn more,
numbered from 0: a turn belongs to the part in which it begins, so a number may be missing after a
turn that fills more than a part.  Joined by a newline in the order of ``part``, the parts are what
one rendering would be.

A conversation of more than ``long_rows`` turns or ``long_chars`` characters never stands in one
task: its turns are laid out in ranges and hashed by running totals.  The rows are the same.

Null role or text: empty.  Turns are ordered by turn (null first), role and digest; repeated rows
are repeated turns.  Rows of a null conversation go.  An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.prefix import materialise, running_totals

#: Above either, the turns of a conversation are spread over tasks.
LONG_ROWS = 4096
LONG_CHARS = 16_000_000

#: Characters after which a part of a conversation ends.
PART = 1_000_000

_ORDER = ("turn", "role", "d")
_HASHES = ("h1", "h2")


def _terms(pos: Column) -> dict[str, Column]:
    """What a turn adds to the two hashes of its prefix."""
    return {h: F.xxhash64(F.lit(k), pos.cast("long"), "d").cast("decimal(20,0)") for k, h in enumerate(_HASHES)}


def _narrow(name: str) -> Column:
    """A sum of hashes as a long; sums are equal only where these are, but for chance."""
    return (F.col(name) % F.lit(2**61 - 1)).cast("long").alias(name)


def _prefixes_short(turns: DataFrame) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(*_ORDER)
    every = Window.partitionBy("conv_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.select("conv_id", *_ORDER).withColumn("pos", F.row_number().over(order).cast("long"))
    summed = placed.withColumns({h: F.sum(t).over(upto) for h, t in _terms(F.col("pos")).items()})
    return summed.select("conv_id", *map(_narrow, _HASHES), "pos", F.count(F.lit(1)).over(every).alias("n_turns"))


def _placed_long(turns: DataFrame) -> DataFrame:
    """Turns of long conversations with ``pos``, ``pos_total`` and the characters up to each."""
    numbered = materialise(turns.withColumn("tie", F.monotonically_increasing_id()))
    order = [F.col(c) for c in (*_ORDER, "tie")]
    return materialise(running_totals(numbered, order, {"upto": "size"}, keys=("conv_id",), position="pos"))


def _prefixes_long(placed: DataFrame) -> DataFrame:
    terms = placed.select("conv_id", "pos", F.col("pos_total").alias("n_turns"), *[
        t.alias(f"t_{h}") for h, t in _terms(F.col("pos")).items()])
    summed = running_totals(
        terms, [F.col("pos")], {h: f"t_{h}" for h in _HASHES}, keys=("conv_id",), position="place")
    return summed.select("conv_id", *map(_narrow, _HASHES), "pos", "n_turns")


def _maximal(prefixes: DataFrame) -> DataFrame:
    """``conv_id`` and ``n_turns`` of the conversations that no other one begins with."""
    ends = prefixes.where("pos = n_turns").groupBy(*_HASHES, "pos").agg(F.min("conv_id").alias("conv_id"))
    # Counted before the shuffle: a first turn that all conversations share is one row of each task.
    inner = prefixes.where("pos < n_turns").select(*_HASHES, "pos").distinct()
    return ends.join(inner, [*_HASHES, "pos"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def _joined(rows: str, fields: list[str]) -> Column:
    turn = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"))
    told = F.array_sort(F.collect_list(F.struct(*fields, turn.alias("told"))))
    return F.concat_ws("\n", F.transform(told, lambda t: t["told"])).alias(rows)


def render(turns: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS, part: int = PART) -> DataFrame:
    """``conv_id``, ``n_turns``, ``part`` and ``rendered`` of every maximal conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.substring(F.unhex(F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256)), 1, 16).alias("d"),
        (F.length(role) + F.length(text) + 6).cast("long").alias("size"),
    )
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"))
    # A written table of known size: Catalyst broadcasts it only where that size allows.
    long = materialise(sizes.where((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select("conv_id"))
    if long.isEmpty():
        kept = _maximal(_prefixes_short(rows))
        return _whole(rows, kept, part)
    short = rows.join(long, "conv_id", "left_anti")
    placed = _placed_long(rows.join(long, "conv_id", "left_semi"))
    kept = materialise(_maximal(_prefixes_short(short).unionByName(_prefixes_long(placed))))
    # One row of ``kept`` for every part, so that no key of the join has more rows than a part.
    span = F.floor(F.col("last") / part)
    ends = placed.groupBy("conv_id").agg((F.max("upto") - 1).alias("last"))
    parts = kept.join(ends, "conv_id").select(
        "conv_id", "n_turns", F.explode(F.sequence(F.lit(0).cast("long"), span)).alias("part"))
    cut = placed.withColumn("part", F.floor((F.col("upto") - F.col("size")) / part))
    pieces = cut.groupBy("conv_id", "part").agg(_joined("rendered", ["pos"])).join(parts, ["conv_id", "part"])
    return _whole(short, kept, part).unionByName(pieces.select("conv_id", "n_turns", "part", "rendered"))


def _whole(rows: DataFrame, kept: DataFrame, part: int) -> DataFrame:
    """Conversations that fit a task: join, running size and grouping in one exchange."""
    upto = Window.partitionBy("conv_id").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows.join(kept, "conv_id").withColumn("part", F.floor((F.sum("size").over(upto) - F.col("size")) / part))
    told = cut.groupBy("conv_id", "n_turns", "part").agg(_joined("rendered", list(_ORDER)))
    return told.select("conv_id", "n_turns", "part", "rendered")
