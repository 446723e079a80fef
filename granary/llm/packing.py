"""Packing: first-fit decreasing over a tournament tree, in randomised groups of documents.

Documents become token ids and are cut into pieces of at most one sequence.  Pieces are dealt to
groups at random (by a hash of their row number), and each group is packed by itself: pieces in
order of falling length, each into the leftmost open bin with room.  The bins are the leaves of a
tournament tree whose inner nodes hold the largest free capacity below, so the leftmost bin with
room is found on one way down and updated on the way up.  Whole-sequence pieces are bins of their
own.  Groups hold about ``GROUP_TOKENS`` tokens, so memory and time of a task are bounded and the
unfilled last bins of a group weigh little.

Defined results: null text is the empty text (its only token is the end mark); repeated rows are
packed as often as they occur; further columns play no part.

Strings of special tokens in a text get the ids of these tokens, which is the library's default;
``special=False`` takes them for ordinary text.

Tokens of a word do not depend on its neighbours when words are parted at ASCII white space, so
each task keeps the ids of words and asks the tokenizer for new ones only, many of them joined to
one text by a character that stands in none of them.  The words are kept in two generations: what is
used moves to the young one, and when that is full it becomes the old one and the old one goes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.prefix import materialise
from granary.llm.exprs import parcels

LENGTH = 4096
END = 2
#: Tokens of a group: 512 sequences.
GROUP_TOKENS = 512 * LENGTH
#: Words of a generation whose ids a task remembers.
REMEMBERED = 400_000
#: Words that are encoded as one text, and the character between them.
JOINED = 500
BETWEEN = "\x01"
#: A run of letters and one of these behind it are tokens of their own.
MARKS = frozenset(".,!?;:")

_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, word by word."""

    def __init__(self, path: str, special: bool = True):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.marked = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        #: Words can be joined where the character between them is one token, which no other text gives.
        self.between = between[0] if len(between) == 1 else None
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, special: bool = True) -> WordEncoder:
        if (path, special) not in _ENCODERS:
            _ENCODERS[path, special] = cls(path, special)
        return _ENCODERS[path, special]

    def recall(self, words: set[str]) -> set[str]:
        """Brings words of the old generation into the young one; returns those in neither."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.old, self.known, new = self.known, {}, words
        back = self.old.keys() & new
        self.known.update((w, self.old[w]) for w in back)
        return new - back

    def learn(self, words: set[str]) -> None:
        # The run stays one of letters when the tokenizer normalises it: a dotted capital I does not.
        ending = {
            w for w in words if w[-1:] in MARKS and w[:-1].isalpha()
            and (w.isascii() or unicodedata.normalize("NFC", w[:-1]).lower().isalpha())
        }
        new = words - ending
        new.update({w[:-1] for w in ending}.difference(self.known), {w[-1] for w in ending})
        alone = [w for w in new if BETWEEN in w] if self.between is not None else list(new)
        joined = list(new.difference(alone))
        gap = f" {BETWEEN} "
        for at in range(0, len(joined), 100 * JOINED):
            part = joined[at:at + 100 * JOINED]
            runs = [gap.join(part[k:k + JOINED]) + gap for k in range(0, len(part), JOINED)]
            ids = np.concatenate([
                np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)
            ])
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, (4 * np.flatnonzero(ids == self.between)).tolist(), strict=True):
                self.known[w] = raw[start:end]
                start = end + 4
        for at in range(0, len(alone), 10_000):
            part = alone[at:at + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[w] = np.array(e.ids, dtype="<u4").tobytes()
        for w in ending:
            self.known[w] = self.known[w[:-1]] + self.known[w[-1]]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts; new words of about a million characters of text are learned at once."""
        for part in parcels(texts):
            split = [self.split(t) for t in part]
            self.learn(self.recall(set().union(*split)))
            known = self.known.__getitem__
            for words in split:
                yield b"".join(map(known, words))

    def split(self, text: str) -> list[str]:
        low = text.lower()  # as the tokenizer would; two letters excepted, which depend on their neighbours
        if (
            unicodedata.is_normalized("NFC", text) and "\u03a3" not in text and "\u0130" not in text
            and not any(t in low for t in self.marked)  # special tokens are found before lower-casing
        ):
            text = low
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def tokenise(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text",
    special: bool = True,
) -> DataFrame:
    """Table (doc_id, start, length, doc_tokens, ids): pieces with their ids, 4 bytes each, little-endian."""
    mark = np.array([end], dtype="<u4").tobytes()
    width = 4 * length

    def run(batches):
        encoder = WordEncoder.of(tokenizer, special)
        for b in batches:
            row, start, size, whole, ids = [], [], [], [], []
            texts = [t or "" for t in b["text"].to_pylist()]
            for k, tokens in enumerate(encoder.encode_all(texts)):
                tokens += mark
                for at in range(0, len(tokens), width):
                    part = tokens[at:at + width]
                    row.append(k)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    whole.append(len(tokens) // 4)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].take(pa.array(row, pa.int32())), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(whole, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


class Bins:
    """Free capacities of open bins under a tournament tree."""

    def __init__(self, capacity: int, count: int):
        self.leaves = 1 << max(0, (max(count, 1) - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """(bin, free capacity before) of the leftmost bin with room for ``size``."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        before = free[node]
        free[node] = before - size
        at = node // 2
        while at:
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at] = best
            at //= 2
        return node - self.leaves, before


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size; equal sizes go in their given order."""
    order = np.argsort(-sizes, kind="stable")
    bins = Bins(capacity, len(sizes))  # never more bins than pieces
    which, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for k, size in zip(order.tolist(), sizes[order].tolist()):
        b, before = bins.put(size)
        which[k], offset[k] = b, capacity - before
    return which, offset


def pack(pieces: DataFrame, length: int = LENGTH, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces, which have a column ``length`` of 1 to ``length``."""
    numbered = materialise(
        pieces.select(F.struct(*[pieces[f"`{c}`"] for c in pieces.columns]).alias("_in"), F.col("length").alias("_size"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    total = numbered.agg(F.sum("_size")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    dealt = numbered.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by group; a group never exceeds a few times its mean size.
        held: list[pd.DataFrame] = []

        def packed(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for group, part in frame.groupby("_group", sort=False):
                part = part.sort_values("_row")
                which, offset = first_fit_decreasing(part["_size"].to_numpy(), length)
                yield pd.DataFrame({
                    "_row": part["_row"].to_numpy(), "sequence_id": (int(group) << 32) + which, "offset": offset,
                })

        for b in batches:
            held.append(b)
            last = b["_group"].iloc[-1] if len(b) else None
            if last is None or (b["_group"] == last).all():
                continue
            frame = pd.concat(held, ignore_index=True)
            done = frame["_group"] != last
            yield from packed(frame[done])
            held = [frame[~done]]
        if held:
            yield from packed(pd.concat(held, ignore_index=True))

    sizes = dealt.select("_group", "_row", "_size").repartition("_group").sortWithinPartitions("_group")
    placed = sizes.mapInPandas(run, "_row long, sequence_id long, offset long")
    return numbered.join(placed, "_row").select("_in.*", "sequence_id", "offset")


def packed_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of ``docs`` packed; the ids of each as their CRC-32, which travels lighter than they do."""
    pieces = tokenise(docs, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces)
