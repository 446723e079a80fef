"""Byte-level BPE over length-bucketed, padded numpy matrices.

A text is parted into words at single spaces and newlines, which always begin a piece, and words
into pieces by the tokenizer's pattern.  A task remembers the ids of words in two generations: what
is used moves to the young one, and when that is full it becomes the old one and the old one goes,
so that frequent words are never learned again.  New pieces are bytes, bucketed by length into matrices of token ids padded with -1.  In
every round each unfinished row looks up the ranks of its neighbouring pairs in a hash table of
pairs, merges its leftmost pair of least rank, and closes the gap; rows without a mergeable pair
leave the matrix.  Pieces longer than the widest bucket, which would need as many rounds as they
have bytes, are merged by a heap of pairs with the same order (rank, then position).

Defined results: null text is the empty text; repeated rows and further columns are plain.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.exprs import parcels

#: Widths of the buckets; longer pieces go to the heap.
BUCKETS = (4, 8, 16, 32, 64, 128, 256)
#: Rows of one matrix.
ROWS = 8192
#: Words of a generation, and pieces inside words, whose ids a task remembers.
REMEMBERED = 400_000
#: Texts whose ids and bytes are held at once.
HELD = 1000
#: A run of letters and one of these behind it are pieces of their own.
MARKS = frozenset(".,!?;:")
NONE = np.int32(2**31 - 1)

_CODECS: dict[tuple[str, str], Codec] = {}


class PairTable:
    """Open-addressed hash table from (left id, right id) to the id of the merged token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.int64) << 32) | right
        self.mask = np.int64((1 << max(4, int(4 * len(keys)).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, -1, dtype=np.int64)
        self.values = np.full(int(self.mask) + 1, NONE, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            empty = self.keys[slot[todo]] == -1
            # Of several keys for one slot the first gets it.
            winners = todo[empty][np.unique(slot[todo[empty]], return_index=True)[1]]
            self.keys[slot[winners]], self.values[slot[winners]] = keys[winners], merged[winners]
            todo = np.setdiff1d(todo, winners, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)).view(np.int64) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id, which is the rank, of each pair, or ``NONE``."""
        keys = (left.astype(np.int64) << 32) | np.maximum(right, 0)
        flat = keys.ravel()
        out = np.full(len(flat), NONE, dtype=np.int32)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        slot = self._slot(flat[todo])
        while len(todo):
            here = self.keys[slot]
            hit = here == flat[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (here != -1)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out.reshape(left.shape)


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.size = max(self.ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [
            (self.ranks[t[:k]], self.ranks[t[k:]], r)
            for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks
        ]
        self.pairs = PairTable(*np.array(pairs, dtype=np.int64).T)
        self.pattern = regex.compile(pattern)
        self.ids: dict[str, bytes] = {}  # of pieces that do not begin with a space
        # A word ``w`` stands for " " + w, with a newline in front for itself; a text's first word is a tuple.
        self.known: dict[str | tuple, bytes | None] = {}
        self.old: dict[str | tuple, bytes | None] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in _CODECS:
            _CODECS[path, pattern] = cls(path, pattern)
        return _CODECS[path, pattern]

    def merged(self, ids: np.ndarray) -> np.ndarray:
        """Rows of token ids padded with -1, fully merged."""
        out = np.full_like(ids, -1)
        rows, m = np.arange(len(ids)), ids.copy()
        rank = self.pairs.ranks(m[:, :-1], m[:, 1:])
        while len(rows):
            every = np.arange(len(m))
            if m.shape[1] > 1:
                at = rank.argmin(axis=1)  # the leftmost of the least
                best = rank[every, at]
            else:
                at, best = np.zeros(len(m), dtype=np.int64), np.full(len(m), NONE)
            done = best == NONE
            if done.any():
                out[rows[done], :m.shape[1]] = m[done]
                keep = ~done
                rows, m, at, best, rank = rows[keep], m[keep], at[keep], best[keep], rank[keep]
                if not len(rows):
                    break
                every = np.arange(len(m))
            # Close the gap behind the merged token; every row shortens by one.
            m[every, at] = best
            m = np.where(np.arange(m.shape[1] - 1) <= at[:, None], m[:, :-1], m[:, 1:])
            rank = np.where(np.arange(rank.shape[1] - 1) < at[:, None], rank[:, :-1], rank[:, 1:])
            # Only the pairs on both sides of the merged token are new.
            for k in (at - 1, at):
                there = np.flatnonzero((k >= 0) & (k < rank.shape[1]))
                rank[there, k[there]] = self.pairs.ranks(m[there, k[there]], m[there, k[there] + 1])
        return out

    def heaped(self, piece: bytes) -> list[int]:
        """Merges one long piece by a heap of its pairs."""
        ids = self.of_byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        token = [self.bytes[i] for i in ids]
        ranks = self.ranks

        def push(k: int) -> None:
            nxt = after[k]
            if nxt < n and (r := ranks.get(token[k] + token[nxt])) is not None:
                heapq.heappush(heap, (r, k, len(token[k]), len(token[nxt])))

        heap: list[tuple[int, int, int, int]] = []
        for k in range(n - 1):
            push(k)
        while heap:
            rank, k, x, y = heapq.heappop(heap)
            nxt = after[k] if token[k] else n
            if nxt >= n or len(token[k]) != x or len(token[nxt]) != y:
                continue  # one of the two has been merged since
            token[k] += token[nxt]
            token[nxt] = b""
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
            push(k)
            if before[k] >= 0:
                push(before[k])
        return [ranks[t] for t in token if t]

    def pieces(self, new: list[bytes]) -> list[bytes]:
        """Ids of pieces, each as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = [b""] * len(new)
        lengths = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        low = 0
        for width in BUCKETS:
            chosen = np.flatnonzero((lengths > low) & (lengths <= width))
            for at in range(0, len(chosen), ROWS):
                part = chosen[at:at + ROWS]
                raw = b"".join(new[k].ljust(width, b"\0") for k in part)
                ids = self.of_byte[np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)]
                ids[np.arange(width) >= lengths[part][:, None]] = -1
                done = self.merged(ids)
                filled = (done >= 0).sum(axis=1)
                raw, ends = done[done >= 0].astype("<u4").tobytes(), (4 * np.cumsum(filled)).tolist()
                for k, start, end in zip(part.tolist(), [0, *ends], ends):
                    out[k] = raw[start:end]
            low = width
        for k in np.flatnonzero(lengths > BUCKETS[-1]).tolist():
            out[k] = np.array(self.heaped(new[k]), dtype="<u4").tobytes()
        return out

    def settle(self, distinct: set[str]) -> None:
        """Remembers the ids of pieces."""
        new = list(distinct.difference(self.ids))
        if len(self.ids) + len(new) > REMEMBERED:
            self.ids.clear()
            new = list(distinct)
        self.ids.update(zip(new, self.pieces([p.encode("utf-8", "surrogatepass") for p in new])))

    def recall(self, words: set) -> set:
        """Brings words of the old generation into the young one; returns those in neither."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.old, self.known, new = self.known, {}, words
        back = self.old.keys() & new
        self.known.update((w, self.old[w]) for w in back)
        return new - back

    def learn(self, words: set) -> None:
        """Remembers the ids of words; None for a word whose edge is white space, as it has no ids of its own."""
        known = self.known
        first = {w for w in words if type(w) is tuple}
        words = words - first
        whole = {w for w in words if w.isalpha()}
        words = words - whole
        ending = {w for w in words if w[-1:] in MARKS and w[:-1].isalpha()}
        whole.update({w[:-1] for w in ending}.difference(known))
        new = list(whole)
        known.update(zip(new, self.pieces([b" " + w.encode("utf-8", "surrogatepass") for w in new])))
        parts: dict[str | tuple, list[str]] = {}
        for w in words - ending:
            bare = w[1:] if w[:1] == "\n" else w
            if w == "\n":
                parts[w] = [w]
            elif not bare or bare[0].isspace() or bare[-1].isspace():
                known[w] = None
            else:
                parts[w] = self.pattern.findall(" " + w if bare is w else w)
        for w in first:
            if w[0][-1:].isspace():
                known[w] = None
            else:
                parts[w] = self.pattern.findall(w[0])
        self.settle({p for ps in parts.values() for p in ps} | MARKS)
        ids = self.ids
        for w in ending:
            known[w] = known[w[:-1]] + ids[w[-1]]
        for w, ps in parts.items():
            known[w] = b"".join([ids[p] for p in ps])

    def split(self, text: str) -> list | None:
        """Words of a text, which may be looked up one by one; None where the text must be parted as a whole.

        A single space between two characters that are not white space begins a piece, a single newline
        is one, and so is each of two newlines between such characters.
        """
        if " \n" in text:
            return None
        if not ("\r" in text or "\n\n\n" in text or "\n\n " in text or text.endswith("\n\n")):
            text = text.replace("\n", " \n")
        words: list = text.split(" ")
        words[0] = (words[0],)
        return words

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts, each as little-endian unsigned 32-bit bytes.

        New words of about a million characters of text are learned at once.
        """
        for part in parcels(texts):
            split = [self.split(t) for t in part]
            self.learn(self.recall(set().union(*[words for words in split if words])))
            known = self.known.__getitem__
            for text, words in zip(part, split):
                try:
                    yield b"".join(map(known, words))
                except TypeError:  # no words, or one without ids of its own
                    pieces = self.pattern.findall(text)
                    self.settle(set(pieces))
                    yield b"".join(map(self.ids.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def coded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Table (doc_id, ids, raw): ids of each text, four little-endian bytes each, and the bytes they decode to."""

    def run(batches):
        codec = Codec.of(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, HELD):
                part = b.slice(at, HELD)
                ids = list(codec.encode_all([t or "" for t in part["text"].to_pylist()]))
                raw = map(codec.decode, ids)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(ids, pa.binary()), pa.array(raw, pa.binary())], ["doc_id", "ids", "raw"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, ids binary, raw binary")


def encode(text: Column, path: str, pattern: str) -> Column:
    """Binary column: ids of the text, four little-endian bytes each."""

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        codec = Codec.of(path, pattern)
        return pd.Series(list(codec.encode_all(texts.fillna("").tolist())), dtype=object)

    return ids(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Binary column: the bytes that the ids stand for."""

    @F.pandas_udf("binary")
    def raw(values: pd.Series) -> pd.Series:
        codec = Codec.of(path, pattern)
        return pd.Series([codec.decode(v) if v is not None else None for v in values], dtype=object)

    return raw(ids)
