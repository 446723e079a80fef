"""Trie of conversation prefixes, with subtree sums by the Euler-tour technique.

A node is a distinct sequence of first turns; its name is (smallest conversation that begins with
it, depth).  Prefixes are told apart by rolling hashes, two sums over hashes of (position, digest
of the turn), so a conversation of any length may be spread over tasks.

Each node has an enter and an exit arc.  The tour goes from an enter arc to that of the first
child, or to the node's own exit; from an exit arc to the enter arc of the next sibling, or to the
parent's exit.  Siblings are numbered by running totals, so a parent may have any share of all
nodes.  The tour is a linked list; ``ranks`` finds every arc's position in it:

* tasks hold ranges of arcs and contract the runs of the list that they hold whole to one record;
* of what is left, records are paired by coins: a record of coin 0 takes in the next one if that has
  coin 1, a quarter of all on average, so the list shrinks whatever its order;
* both alternate until the list fits a task; then positions are handed back, table by table.

Sums over subtrees are differences of prefix sums along the positions: at a node's exit, less those
before its enter.  Rounds grow with the logarithm of the number of arcs, their tables shrink.

Defined results: null role or text is empty; turns are ordered by turn (null first) and digest;
repeated rows are repeated turns; rows of a null conversation go; an empty table gives no rows;
further columns play no part.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.prefix import materialise, running_totals
from granary.llm.exprs import words

#: Arcs of a task; a list of so many is ranked at once.
TASK = 1 << 17
#: Rows of a key that meet in one task, where a long conversation or a large family is cut.
BLOCK = 4096
#: Members of a node that are joined to one text before the last grouping.
CHUNK = 2048

NO_MEMBERS = sha256(b"").hexdigest()

_HASHES = ("h1", "h2")
_PARENT = ("p1", "p2")


def placed_turns(conversations: DataFrame) -> DataFrame:
    """Table (conv_id, pos, d, words): turns numbered from 1, as digests of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256)), 1, 16).alias("d"),
        F.size(words(text)).cast("long").alias("words"),
    )
    # Written out first, as range partitioning reads its input twice, once for a sample.
    # Rows of equal turn and digest are equal, so their order does not matter.
    numbered = running_totals(materialise(turns), [F.col("turn"), F.col("d")], {}, keys=("conv_id",), position="pos")
    return materialise(numbered.select("conv_id", "pos", "d", "words"))


def heads_taken(conv_id: Column) -> Column:
    """Turns that a rebuilt conversation takes from its family's first one: 0 to 3."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(placed: DataFrame, family: int = 20) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each begins with the first turns of the conversation of its family's least id.

    Its own turns of the same number are left out.  Ids of a family share ``conv_id div family``.
    """
    head = F.col("conv_id") - F.col("conv_id") % family
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = materialise(sizes.select("conv_id", "n", head.alias("head"), heads_taken(F.col("conv_id")).alias("h")))
    heads = placed.where((F.col("conv_id") % family == 0) & (F.col("pos") <= 3)).select(F.col("conv_id").alias("head"), "pos", "d", "words")
    taken = convs.join(heads, "head").where("pos <= h").select("conv_id", "pos", "d", "words")
    # Where the head is shorter than what is asked of it, own turns move up.
    lengths = convs.where("conv_id = head").select("head", F.col("n").alias("head_n"))
    short = convs.join(lengths, "head", "left").withColumn("lack", F.col("h") - F.coalesce("head_n", F.lit(0))).where("lack > 0")
    blocks = short.select("conv_id", "lack", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / BLOCK))).alias("block"))
    own = placed.where(F.col("pos") > heads_taken(F.col("conv_id"))).withColumn("block", F.floor(F.col("pos") / BLOCK))
    moved = own.join(blocks, ["conv_id", "block"], "left").select(
        "conv_id", (F.col("pos") - F.coalesce("lack", F.lit(0))).alias("pos"), "d", "words")
    return taken.unionByName(moved), convs.select("conv_id")


def _narrow(total: Column) -> Column:
    """A sum of hashes as a long."""
    return (total % F.lit(2**61 - 1)).cast("long")


def prefixes(turns: DataFrame) -> DataFrame:
    """Turns with ``depth``, the hashes of the prefix that ends there and of the one before, and ``n_turns``."""
    terms = {f"t_{h}": F.xxhash64(F.lit(k), F.col("pos"), F.col("d")).cast("decimal(20,0)") for k, h in enumerate(_HASHES)}
    summed = running_totals(
        turns.select("conv_id", "pos", "words", *[t.alias(n) for n, t in terms.items()]), [F.col("pos")],
        {h: f"t_{h}" for h in _HASHES}, keys=("conv_id",), position="place")
    return materialise(summed.select(
        "conv_id", F.col("pos").alias("depth"), "words", F.col("place_total").alias("n_turns"),
        *[_narrow(F.col(h)).alias(h) for h in _HASHES],
        *[_narrow(F.col(h) - F.col(f"t_{h}")).alias(p) for h, p in zip(_HASHES, _PARENT)]))


def _nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node: hashes, parent's hashes, smallest member, members, words of the last text."""
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), *[zero.alias(h) for h in _HASHES], "conv_id", "n_convs", zero.alias("words"),
        *[F.lit(None).cast("long").alias(p) for p in _PARENT])
    grouped = rows.groupBy("depth", *_HASHES).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"),
        *[F.min(p).alias(p) for p in _PARENT])
    return materialise(grouped.unionByName(root))


def _linked(nodes: DataFrame) -> DataFrame:
    """Nodes with first child, next sibling, parent (each the other's ``conv_id``) and number of children."""
    up = ["depth", *_PARENT]
    children = materialise(running_totals(
        nodes.where("depth > 0").select(*up, "conv_id"), [F.col("conv_id")], {}, keys=tuple(up), position="sib"))
    firsts = children.where("sib = 1").select(
        (F.col("depth") - 1).alias("depth"), *[F.col(p).alias(h) for p, h in zip(_PARENT, _HASHES)],
        F.col("conv_id").alias("first_child"), F.col("sib_total").alias("n_children"))
    parents = materialise(nodes.join(firsts, ["depth", *_HASHES], "left").na.fill(0, ["n_children"]))
    # A parent stands once for every block of its children, so no key of the join is larger than a block.
    blocks = parents.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), *[F.col(h).alias(p) for p, h in zip(_PARENT, _HASHES)],
        F.col("conv_id").alias("parent"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_children") / BLOCK))).alias("block"))
    later = children.select(*up, (F.col("sib") - 1).alias("sib"), F.col("conv_id").alias("next_sibling"))
    family = children.join(later, [*up, "sib"], "left").withColumn("block", F.floor(F.col("sib") / BLOCK)).join(
        blocks, [*up, "block"]).select("depth", "conv_id", "next_sibling", "parent")
    return parents.join(family, ["depth", "conv_id"], "left")


def _arcs(linked: DataFrame) -> DataFrame:
    """Table (c, k, nc, nk): arcs and the arcs after them; enter arcs have k = 2 * depth, exits one more."""
    c, k = F.col("conv_id"), 2 * F.col("depth")
    leaf, next_ = F.col("n_children") == 0, F.col("next_sibling")

    def arc(own: Column, to: Column, at: Column) -> Column:
        return F.struct(c.alias("c"), own.alias("k"), to.alias("nc"), at.alias("nk"))

    enter = arc(k, F.when(leaf, c).otherwise(F.col("first_child")), F.when(leaf, k + 1).otherwise(k + 2))
    leave = arc(k + 1, F.coalesce(next_, F.col("parent")), F.when(next_.isNotNull(), k).when(F.col("parent").isNotNull(), k - 1))
    return linked.select(F.explode(F.array(enter, leave)).alias("a")).select("a.*")


# ---- list ranking ------------------------------------------------------------------

_RECORD = "c long, k long, nc long, nk long, w long"
_MEMBER = "c long, k long, hc long, hk long, off long, last boolean, nc long, nk long, w long"


def _contracted(records: DataFrame, parts: int) -> DataFrame:
    """Every record with the head of the run that its task holds, and the weight between them.

    The last record of a run also has the weight of the run and the record after it.
    """

    def run(batches):
        held = pa.Table.from_batches(list(batches), pa.schema([(x, pa.int64()) for x in ("c", "k", "nc", "nk", "w")]))
        c, k, w = (held[x].to_numpy() for x in ("c", "k", "w"))
        nc, nk = (held[x].to_pandas().fillna(-1).to_numpy("int64") for x in ("nc", "nk"))
        # No arc has k = -1, so the end of the list is found nowhere.
        to = pd.MultiIndex.from_arrays([c, k]).get_indexer(pd.MultiIndex.from_arrays([nc, nk])) if len(c) else np.empty(0, "int64")
        head = np.arange(len(c))
        inner = np.flatnonzero(to >= 0)
        head[to[inner]] = inner
        off = np.zeros(len(c), "int64")
        off[to[inner]] = w[inner]
        while not np.array_equal(jump := head[head], head):
            off += off[head]
            head = jump
        last = to < 0
        for b in pa.table({
            "c": c, "k": k, "hc": c[head], "hk": k[head], "off": off, "last": last,
            "nc": held["nc"].combine_chunks(), "nk": held["nk"].combine_chunks(), "w": off + w,
        }).to_batches(65_536):
            yield b

    dealt = records.repartition(1) if parts == 1 else records.repartitionByRange(parts, "c", "k")
    return dealt.mapInArrow(run, _MEMBER)


def _paired(records: DataFrame, round_: int) -> DataFrame:
    """Records after a round of coins; those taken in have ``hc, hk`` (by whom) and ``off`` (weight before them)."""

    def coin(c: str, k: str) -> Column:
        return F.xxhash64(F.lit(round_), F.col(c), F.col(k)) % 2 == 0

    tossed = records.withColumns({"taken": coin("c", "k"), "takes": ~coin("c", "k") & F.col("nc").isNotNull() & coin("nc", "nk")})
    takers = tossed.where("takes").select(F.col("c").alias("hc"), F.col("k").alias("hk"), F.col("nc").alias("c"), F.col("nk").alias("k"), F.col("w").alias("off"))
    met = tossed.where("taken").select("c", "k", "nc", "nk", "w").join(takers, ["c", "k"], "left")
    rest = tossed.where("not taken and not takes").select("c", "k", "nc", "nk", "w", *[F.lit(None).cast("long").alias(x) for x in ("hc", "hk", "off")])
    return met.unionByName(rest)


def ranks(arcs: DataFrame, task: int = TASK) -> DataFrame:
    """Table (c, k, at) of a linked list (c, k, nc, nk): the number of arcs before each."""
    records = arcs.select("c", "k", "nc", "nk", F.lit(1).cast("long").alias("w"))
    levels: list[DataFrame] = []
    while True:
        records = materialise(records)
        parts = -(-records.count() // task)
        if not parts:
            return records.select("c", "k", F.col("w").alias("at"))
        members = materialise(_contracted(records, parts))
        if parts == 1:
            break
        levels.append(members.select("c", "k", "hc", "hk", "off"))
        runs = members.where("last").select(F.col("hc").alias("c"), F.col("hk").alias("k"), "nc", "nk", "w")
        met = materialise(_paired(runs, len(levels)))
        levels.append(met.where("hc is not null").select("c", "k", "hc", "hk", "off"))
        merged = F.col("hc").isNotNull()
        records = met.select(
            F.coalesce("hc", "c").alias("c"), F.when(merged, F.col("hk")).otherwise(F.col("k")).alias("k"), "nc", "nk",
            (F.col("w") + F.coalesce("off", F.lit(0))).alias("w"))
    found = members.select("c", "k", F.col("off").alias("at"))
    while levels:
        taken = levels.pop()
        known = materialise(found.unionByName(_placed(taken, found)))
        found = materialise(_placed(levels.pop(), known))
    return found


def _placed(members: DataFrame, heads: DataFrame) -> DataFrame:
    at = heads.select(F.col("c").alias("hc"), F.col("k").alias("hk"), "at")
    return members.join(at, ["hc", "hk"]).select("c", "k", (F.col("at") + F.col("off")).alias("at"))


# ---- members that end at a node ------------------------------------------------------

def _end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, in order and comma-joined; an id list of any length is streamed."""
    key = ["depth", *_HASHES]
    shape = "depth long, h1 long, h2 long"

    def chunked(batches):
        for b in batches:
            ids, starts = b["conv_id"].to_pylist(), []
            keys = list(zip(*(b[x].to_pylist() for x in key)))
            for i, x in enumerate(keys):
                if not starts or x != keys[starts[-1]] or i - starts[-1] == CHUNK:
                    starts.append(i)
            stops = [*starts[1:], len(ids)]
            yield pa.RecordBatch.from_pylist([
                {**dict(zip(key, keys[s])), "least": ids[s], "told": ",".join(map(str, ids[s:e]))} for s, e in zip(starts, stops)
            ], pa.schema([*[(x, pa.int64()) for x in key], ("least", pa.int64()), ("told", pa.string())]))

    def digested(batches):
        kind = pa.schema([*[(x, pa.int64()) for x in key], ("ends_sha256", pa.string())])
        now, digest = None, None
        for b in batches:
            out = []
            for *x, told in zip(*(b[n].to_pylist() for n in (*key, "told"))):
                if x == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        out.append({**dict(zip(key, now)), "ends_sha256": digest.hexdigest()})
                    now, digest = x, sha256()
                digest.update(told.encode())
            yield pa.RecordBatch.from_pylist(out, kind)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{**dict(zip(key, now)), "ends_sha256": digest.hexdigest()}], kind)

    # Written out: range bounds are sampled anew when a lost task is computed again.
    told = materialise(ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(
        chunked, f"{shape}, least long, told string"))
    return told.repartition(*key).sortWithinPartitions(*key, "least").mapInArrow(digested, f"{shape}, ends_sha256 string")


# ---- the trie --------------------------------------------------------------------------

def trie(turns: DataFrame, convs: DataFrame, task: int = TASK) -> DataFrame:
    """A row per node of the prefixes of ``turns`` (conv_id, pos, d, words); ``convs`` also has turnless ids."""
    rows = prefixes(turns)
    nodes = _nodes(rows, convs)
    linked = materialise(_linked(nodes))
    arcs = materialise(_arcs(linked))
    # What an arc adds: leaves and words that sharing saves, at the enter arc of their node.
    weights = linked.select(
        F.col("conv_id").alias("c"), (2 * F.col("depth")).alias("k"), (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    weighed = ranks(arcs, task).join(weights, ["c", "k"], "left").na.fill(0, ["leaf", "saved"])
    toured = running_totals(weighed, [F.col("at")], {"leaves_upto": "leaf", "saved_upto": "saved"})
    enter = F.col("k") % 2 == 0

    def below(upto: str, own: str) -> Column:
        return F.sum(F.when(enter, F.col(own) - F.col(upto)).otherwise(F.col(upto)))

    sums = toured.groupBy(F.col("c").alias("conv_id"), F.shiftright("k", 1).alias("depth")).agg(
        below("leaves_upto", "leaf").alias("n_leaves"), below("saved_upto", "saved").alias("saved_tokens"))
    with_turns = rows.where("depth = n_turns").select("depth", *_HASHES, "conv_id")
    zero = F.lit(0).cast("long")
    turnless = convs.join(with_turns.select("conv_id"), "conv_id", "left_anti").select(
        zero.alias("depth"), *[zero.alias(h) for h in _HASHES], "conv_id")
    ends = _end_digests(with_turns.unionByName(turnless))
    return linked.join(ends, ["depth", *_HASHES], "left").join(sums, ["conv_id", "depth"]).select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"))
