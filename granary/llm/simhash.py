"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are the leaves of a binary trie.  Pairs of nodes are walked together from the root;
every level at which the two sides take different bits costs one of the error budget, and a pair
of nodes whose budget is exceeded is dropped with everything below it.

To deal the walk out, the trie is built once for each of ``budget + 1`` rotations that put another
block of the bits on top.  Two fingerprints within the budget agree on at least one whole block,
so in one of the rotations they lie below the same node at that depth.  Each such node is a task
key: its subtree is walked against itself, with the full budget left, independently of all others.
A node with more leaves than ``CELL`` is cut into slices, and every pair of slices is a cell of
its own, so that no task holds more than two slices.  From each cell only a spanning forest of
its links is kept (a leaf and the root of its tree), as the groups need no more.

Defined results: null text is the empty text; texts without words have fingerprint zero; copies
(and repeated rows) share a fingerprint and so a group; a group's id is the least non-null id in
it; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.prefix import materialise
from granary.llm.components import components

BITS = 64
SEED = 42
#: Leaves of one slice of a node, and pairs of nodes walked at once in a task.
CELL = 2048
FRONTIER = 200_000
#: Rows whose cells are walked together.
CHUNK = 32_768


def fingerprint(text: str, size: int = 4) -> int:
    """Signed 64-bit fingerprint of the word shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(words) - size + 1)
    firsts, lasts = starts[:n].tolist(), ends[min(size, len(words)) - 1:].tolist()
    ones = np.zeros(BITS, dtype=np.int64)
    hash_ = xxhash.xxh64_intdigest
    for at in range(0, n, 65_536):
        hashes = np.array(
            [hash_(whole[s:e], SEED) for s, e in zip(firsts[at:at + 65_536], lasts[at:at + 65_536])], dtype=np.uint64
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_ = np.packbits(2 * ones > n, bitorder="little")
    return int(set_.view(np.int64)[0])


def fingerprint_of(text: Column, size: int = 4) -> Column:
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size) for t in texts.fillna("")], dtype="int64")

    return fp(text.cast("string"))


def widths(budget: int) -> list[int]:
    """Widths of the blocks of the rotations: as even as they can be."""
    blocks = budget + 1
    return [BITS // blocks + (k < BITS % blocks) for k in range(blocks)]


def cells(leaves: DataFrame, budget: int) -> DataFrame:
    """Table (node, a, b, code): distinct fingerprints dealt to the cells of all rotations.

    ``code`` is the fingerprint rotated so that its block is on top, ``node`` says rotation and
    block value, and ``a <= b`` are the two slices that meet in the cell.
    """
    turned, at = [], 0
    for k, width in enumerate(widths(budget)):
        fp = F.col("fp")
        code = F.shiftleft(fp, at).bitwiseOR(F.shiftrightunsigned(fp, BITS - at)) if at else fp
        node = F.shiftrightunsigned(code, BITS - width) * (budget + 1) + k
        turned.append(F.struct(node.alias("node"), code.alias("code")))
        at += width
    dealt = leaves.select(F.explode(F.array(*turned)).alias("x")).select("x.node", "x.code")
    # At most (budget + 1) * 2 ** width rows, whatever the input: proven small, so it may be sent.
    crowded = (
        dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL)
        .select("node", F.ceil(F.col("n") / CELL).cast("int").alias("slices"))
    )
    split = dealt.join(F.broadcast(crowded), "node", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("code"), F.col("slices")).cast("int")
    return (
        split.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select("node", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "code")
    )


def _expand(lo_a, hi_a, lo_b, hi_b):
    """All index pairs of the products of leaf intervals."""
    wide = hi_b - lo_b
    count = (hi_a - lo_a) * wide
    which = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return lo_a[which] + k // wide[which], lo_b[which] + k % wide[which]


def trie_links(cell: np.ndarray, code: np.ndarray, budget: int, top: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of leaves of one cell with at most ``budget`` differing bits.

    ``cell`` and ``code`` (unsigned) are sorted together; ``top`` levels of a cell's codes agree.
    A node is the interval of its leaves, a frontier row is a pair of nodes and its errors so far.
    """
    n = len(code)
    if n < 2:
        return
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    last = np.r_[first[1:], n]
    big = last - first > 1
    roots = (first[big], last[big], first[big], last[big], np.zeros(big.sum(), dtype=np.int8))
    ones: dict[int, np.ndarray] = {}

    def middle(level, lo, hi):
        if level not in ones:
            bit = (code >> np.uint64(BITS - 1 - level)) & np.uint64(1)
            ones[level] = np.r_[0, np.cumsum(bit.astype(np.int64))]
        return hi - (ones[level][hi] - ones[level][lo])

    stack = [(top, roots)]
    while stack:
        level, (la, ha, lb, hb, err) = stack.pop()
        if len(la) == 0:
            continue
        if len(la) > FRONTIER:
            for part in np.array_split(np.arange(len(la)), -(-len(la) // FRONTIER)):
                stack.append((level, (la[part], ha[part], lb[part], hb[part], err[part])))
            continue
        few = ((ha - la) * (hb - lb) <= 16) | (level == BITS)
        if few.any():
            i, j = _expand(la[few], ha[few], lb[few], hb[few])
            near = (i < j) & (np.bitwise_count(code[i] ^ code[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            more = ~few
            la, ha, lb, hb, err = la[more], ha[more], lb[more], hb[more], err[more]
            if len(la) == 0:
                continue
        ma, mb, same = middle(level, la, ha), middle(level, lb, hb), la == lb
        spent = (err + 1).astype(np.int8)
        parts = [
            (la, ma, lb, mb, err), (ma, ha, mb, hb, err), (la, ma, mb, hb, spent),
            tuple(x[~same] for x in (ma, ha, lb, mb, spent)),
        ]
        la, ha, lb, hb, err = (np.concatenate(x) for x in zip(*parts))
        alive = (ha > la) & (hb > lb) & (err <= budget) & ~((la == lb) & (ha - la == 1))
        stack.append((level + 1, (la[alive], ha[alive], lb[alive], hb[alive], err[alive])))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n leaves the least leaf that it reaches."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def _walk(budget: int):
    """Arrow map: sorted cell rows in, spanning links (code, root code, node) out."""
    columns = ["node", "a", "b", "code"]
    names = ["node", "u", "v"]

    def walked(table: pa.Table) -> pa.RecordBatch:
        node, a, b, code = (table[c].to_numpy() for c in columns)
        new = np.r_[True, (node[1:] != node[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        cell, bits = np.cumsum(new), code.view(np.uint64)
        order = np.lexsort((bits, cell))
        cell, bits, node = cell[order], bits[order], node[order]
        root = forest(len(bits), trie_links(cell, bits, budget))
        linked = np.flatnonzero(root != np.arange(len(bits)))
        return pa.RecordBatch.from_arrays(
            [pa.array(node[linked]), pa.array(bits[linked].view(np.int64)), pa.array(bits[root[linked]].view(np.int64))], names
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            key = [table[c].to_numpy() for c in columns[:3]]
            # The last cell may go on in the next batch.
            same = np.logical_and.reduce([k == k[-1] for k in key])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield walked(table.slice(0, cut).combine_chunks())
                table = table.slice(cut)
            held, rows = table.to_batches(), table.num_rows
        if rows:
            yield walked(pa.Table.from_batches(held).combine_chunks())

    return run


def links(leaves: DataFrame, budget: int) -> DataFrame:
    """Links (u, v) between distinct fingerprints that connect all within ``budget`` bits."""
    dealt = cells(leaves, budget).repartition("node", "a", "b").sortWithinPartitions("node", "a", "b")
    found = dealt.mapInArrow(_walk(budget), "node long, u long, v long")
    back = F.lit(None).cast("long")
    at = 0
    for k, width in enumerate(widths(budget)):

        def unturned(c, at=at):
            return F.shiftrightunsigned(c, at).bitwiseOR(F.shiftleft(c, BITS - at)) if at else F.col(c)

        pair = F.struct(unturned("u").alias("u"), unturned("v").alias("v"))
        back = F.when(F.pmod("node", F.lit(budget + 1)) == k, pair) if k == 0 else back.when(
            F.pmod("node", F.lit(budget + 1)) == k, pair
        )
        at += width
    return found.select(back.alias("x")).select("x.u", "x.v").distinct()


def rooted(prints: DataFrame, budget: int) -> DataFrame:
    """Table (fp, root) of the distinct fingerprints; ``root`` is the same within a group."""
    leaves = materialise(prints.select("fp").distinct())
    roots = components(links(leaves, budget), "u", "v")
    return materialise(
        leaves.join(roots, leaves["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    )


def groups(
    docs: DataFrame, budget: int = 4, size: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Table (doc_id, fp, component_id) with one row per input row."""
    prints = materialise(docs.select(docs[id_col].alias("doc_id"), fingerprint_of(docs[text_col], size).alias("fp")))
    roots = rooted(prints, budget)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    by_print = roots.join(least, "fp")
    named = by_print.groupBy("root").agg(F.min("least").alias("component_id"))
    named_print = by_print.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(named_print, "fp").select("doc_id", "fp", "component_id")


def deduplicate(
    docs: DataFrame, budget: int = 4, size: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each group: that with the least id (null comes last; of repeated rows one)."""
    numbered = materialise(
        docs.select(
            F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_in"), docs[id_col].alias("_id"),
            fingerprint_of(docs[text_col], size).alias("fp"),
        ).withColumn("_row", F.monotonically_increasing_id())
    )
    roots = rooted(numbered, budget)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("_row")))
    kept = (
        numbered.select("fp", "_id", "_row").join(roots, "fp").groupBy("root").agg(first.alias("first")).select("first._row")
    )
    return numbered.join(kept, "_row", "left_semi").select("_in.*")
