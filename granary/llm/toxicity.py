"""Toxicity: a linear-chain conditional random field over words.

Only documents are labelled, so words get labels first.  Over a bounded sample of labelled rows,
the support of a word is the number of different neighbourhoods (word before, word after) in which
toxic documents hold it, one per document, so that a copied document supports its words once.
Words with enough support that are several times likelier in toxic than in clean documents are
cue words; a cue word in a toxic document is labelled toxic, every other word clean.

The field has two states per word, a weight for every cue word in the toxic state (one common
weight for all other words) and four transition weights; it is fitted by maximum likelihood with
forward-backward expectations.  The sampled texts are cut from end to end into windows, equal
windows are counted, and windows without a cue word weigh together as much as those with one.  For
every document, forward-backward
over its whole text gives each word's probability of the toxic state.  Words at 1/2 or more are
offending: their runs are the spans, and the score is the probability that at least one of them is
right, each with its marginal times the measured reliability of cue words.

Learned from labels only where crc32(id as text) mod 3 is not 1.  Of the documents only the text
is read by the model.  Defined results: null and empty texts score 0; spans are in code points,
end exclusive; a label without a document, a null label and repeated labels (the largest counts)
do no harm; of repeated ids the largest text is learned from; without labels every score is 0; further columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.prefix import materialise

#: Labelled rows from which is learned, at most.
LEARN_ROWS = 20_000
#: A cue word needs this many neighbourhoods, or this share of the toxic documents if that is more.
LEAST_SUPPORT = 4
LEAST_SHARE = 0.02
#: Times likelier in toxic documents.
LEAST_RATIO = 8.0
#: Different windows that the fit takes, at most, by a hash of the window.
LEARN_WINDOWS = 40_000
#: Words of a window of the fit, and rounds of the fit.
WINDOW = 41
ROUNDS = 300
PENALTY = 1e-3
FLAG = 0.7

WORD = re.compile(r"\w+")


def lowered(text: str) -> str:
    """Lower case, one code point for one."""
    return text.replace("İ", "i").lower()


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


class Field:
    """Weights of the field: 0 is the clean state, 1 the toxic state, word number 0 any common word."""

    def __init__(self, cues: list[str], reliability: float):
        self.number = {w: k + 1 for k, w in enumerate(cues)}
        self.emit = np.zeros(len(cues) + 1)
        self.move = np.zeros((2, 2))
        self.reliability = reliability
        self.plain: dict[int, float] = {}

    def numbers(self, words: list[str]) -> list[int]:
        get = self.number.get
        return [get(w, 0) for w in words]

    def fit(self, numbers: np.ndarray, toxic: np.ndarray, weight: np.ndarray | None = None) -> None:
        """Maximum likelihood on windows: word numbers (-1 behind the end), states and weights of windows."""
        if not len(numbers):
            return
        weight = np.ones(len(numbers)) if weight is None else weight
        each = np.broadcast_to(weight[:, None], numbers.shape)
        here = numbers >= 0
        word = np.maximum(numbers, 0)
        pair = here[:, 1:]
        n, length = numbers.shape
        theta = np.concatenate([self.emit, self.move.ravel()])
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        counted = np.zeros_like(theta)
        np.add.at(counted, word[here], (toxic * each)[here])
        for a in (0, 1):
            for b in (0, 1):
                counted[len(self.emit) + 2 * a + b] = (((toxic[:, :-1] == a) & (toxic[:, 1:] == b) & pair) * each[:, 1:]).sum()
        for step in range(1, ROUNDS + 1):
            emit, move = theta[:len(self.emit)], np.exp(theta[len(self.emit):].reshape(2, 2))
            e = np.stack([np.ones((n, length)), np.exp(emit)[word]], axis=2)
            alpha, beta = np.zeros((n, length, 2)), np.ones((n, length, 2))
            alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, length):
                a = (alpha[:, t - 1] @ move) * e[:, t]
                alpha[:, t] = np.where(here[:, t, None], a / a.sum(axis=1, keepdims=True), alpha[:, t - 1])
            for t in range(length - 2, -1, -1):
                b = (beta[:, t + 1] * e[:, t + 1]) @ move.T
                beta[:, t] = np.where(here[:, t + 1, None], b / b.sum(axis=1, keepdims=True), beta[:, t + 1])
            post = alpha * beta
            post /= post.sum(axis=2, keepdims=True)
            both = alpha[:, :-1, :, None] * move * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
            both /= both.sum(axis=(2, 3), keepdims=True)
            expected = np.zeros_like(theta)
            np.add.at(expected, word[here], (post[..., 1] * each)[here])
            expected[len(self.emit):] = (both * (pair * each[:, 1:])[..., None, None]).sum(axis=(0, 1)).ravel()
            slope = (counted - expected) / weight.sum() - PENALTY * theta
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope**2
            theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        self.emit, self.move = theta[:len(self.emit)], theta[len(self.emit):].reshape(2, 2)

    def marginals(self, numbers: list[int]) -> list[float]:
        """Probability of the toxic state of every word."""
        n = len(numbers)
        weights = np.exp(self.emit).tolist()
        (m00, m01), (m10, m11) = np.exp(self.move).tolist()
        share = [0.0] * n  # of the toxic state, forward
        a0, a1 = 1.0, 1.0
        for t, k in enumerate(numbers):
            if t:
                a0, a1 = a0 * m00 + a1 * m10, a0 * m01 + a1 * m11
            a1 *= weights[k]
            total = a0 + a1
            a0 /= total
            a1 /= total
            share[t] = a1
        b0, b1 = 1.0, 1.0
        for t in range(n - 1, -1, -1):
            p1 = share[t] * b1
            p0 = (1.0 - share[t]) * b0
            share[t] = p1 / (p0 + p1)
            w1 = weights[numbers[t]] * b1
            b0, b1 = m00 * b0 + m01 * w1, m10 * b0 + m11 * w1
            total = b0 + b1
            b0 /= total
            b1 /= total
        return share

    def score(self, marginals: list[float]) -> float:
        """Probability that one of the offending words is right; without any, that of the likeliest word."""
        offending = [m for m in marginals if m >= 0.5]
        if not offending:
            return self.reliability * max(marginals, default=0.0)
        return 1.0 - math.exp(sum(math.log1p(-min(self.reliability * m, 1 - 1e-12)) for m in offending))

    def judge(self, text: str) -> tuple[float, list[dict]]:
        """Score and offending spans of a text."""
        low = lowered(text)
        numbers = self.numbers(WORD.findall(low))
        if not any(numbers):
            n = len(numbers)
            if n not in self.plain:
                self.plain[n] = self.score(self.marginals(numbers))
            if self.plain[n] < 0.5 * self.reliability:
                return self.plain[n], []
        marginals = self.marginals(numbers)
        spans: list[dict] = []
        before = None
        for t, match in enumerate(WORD.finditer(low)):
            if marginals[t] >= 0.5:
                if before == t - 1:
                    spans[-1]["end"] = match.end()
                    spans[-1]["marginal"] = max(spans[-1]["marginal"], marginals[t])
                else:
                    spans.append({"start": match.start(), "end": match.end(), "marginal": marginals[t]})
                before = t
        return self.score(marginals), spans


def sample(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """Table (text, toxic) of at most ``rows`` labelled documents, chosen by a hash of their id; one row per id."""
    known = (
        labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
        .filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # the bound that lets it be sent
    texts = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).select("text", "toxic")


def _supports(batches):
    """Per word its neighbourhoods, one per document."""
    for frame in batches:
        out = set()
        for text in frame["text"]:
            words = WORD.findall(lowered(text))
            seen = set()
            for k, w in enumerate(words):  # the first occurrence speaks for the document
                if w not in seen:
                    seen.add(w)
                    out.add((w, f"{words[k - 1] if k else ''} {words[k + 1] if k + 1 < len(words) else ''}"))
        yield pd.DataFrame(sorted(out), columns=["word", "around"], dtype=str)


def _counts(words: set[str]):
    """In how many documents each of ``words`` stands."""

    def run(batches):
        found: Counter = Counter()
        for frame in batches:
            for text in frame["text"]:
                found.update(words.intersection(WORD.findall(lowered(text))))
        yield pd.DataFrame({"word": list(found), "n": [int(x) for x in found.values()]}).astype({"word": str, "n": "int64"})

    return run


def _windows(number: dict[str, int]):
    """Windows of whole texts as word numbers, equal ones counted; without numbers: documents with a cue word."""

    def run(batches):
        for frame in batches:
            seen: Counter = Counter()
            for text, toxic in zip(frame["text"], frame["toxic"]):
                numbers = [number.get(w, 0) for w in WORD.findall(lowered(text))]
                if any(numbers):
                    seen[None, int(toxic)] += 1
                for k in range(0, len(numbers), WINDOW):
                    seen[tuple(numbers[k:k + WINDOW]), int(toxic)] += 1
            rows = [(None if w is None else list(w), x, n) for (w, x), n in seen.items()]
            yield pd.DataFrame(rows, columns=["numbers", "toxic", "n"])

    return run


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS, windows_limit: int = LEARN_WINDOWS) -> Field:
    """Fits the field; what comes to the driver is bounded by ``windows_limit`` and the words of the sample."""
    chosen = materialise(sample(docs, labels, rows))
    sizes = {r[0]: r[1] for r in chosen.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    least = max(LEAST_SUPPORT, LEAST_SHARE * toxic)
    support = {
        r[0]: r[1] for r in chosen.filter("toxic = 1").select("text").mapInPandas(_supports, "word string, around string")
        .distinct().groupBy("word").count().filter(F.col("count") >= least).collect()
    }
    against = Counter()
    if support:
        counted = chosen.filter("toxic = 0").select("text").mapInPandas(_counts(set(support)), "word string, n long")
        against.update({r[0]: r[1] for r in counted.groupBy("word").agg(F.sum("n")).collect()})
    cues = sorted(
        w for w, n in support.items() if (n / (toxic + 1)) / ((against[w] + 0.5) / (clean + 1)) >= LEAST_RATIO
    )
    field = Field(cues, 0.0)
    if not cues:
        return field
    windows = materialise(
        chosen.select("text", "toxic").mapInPandas(_windows(field.number), "numbers array<int>, toxic int, n long")
        .groupBy("numbers", "toxic").agg(F.sum("n").alias("n"))
    )
    hits = {r["toxic"]: r["n"] for r in windows.filter("numbers is null").collect()}
    field.reliability = (hits.get(1, 0) + 1) / (sum(hits.values()) + 2)
    used = windows.filter("numbers is not null").orderBy(F.xxhash64("numbers", "toxic"), "numbers", "toxic")
    held = used.limit(windows_limit).collect()  # the second bound that lets it be sent
    numbers = np.full((len(held), WINDOW), -1, dtype=np.int64)
    states = np.zeros_like(numbers)
    weight = np.array([r["n"] for r in held], dtype=float)
    for k, r in enumerate(held):
        numbers[k, :len(r["numbers"])] = r["numbers"]
        states[k] = (numbers[k] > 0) & (r["toxic"] == 1)
    plain = ~(numbers > 0).any(axis=1)
    if plain.any() and not plain.all():
        weight[plain] *= weight[~plain].sum() / weight[plain].sum()
    field.fit(numbers, states, weight)
    return field


def judged(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """Input row ``_in`` with ``score`` and ``spans`` (array of start, end, marginal)."""

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,marginal:double>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([field.judge(t) for t in texts.fillna("")], columns=["score", "spans"])

    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_in"), judge(docs[text_col].cast("string")).alias("_out")
    )
    return rows.select("_in", "_out.score", "_out.spans")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Table (doc_id, held_out, score, predicted, spans) with one row per input row."""
    return judged(docs.select("doc_id", "text"), learn(docs, labels)).select(
        F.col("_in.doc_id").alias("doc_id"), F.coalesce(held_out(F.col("_in.doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= FLAG).cast("int").alias("predicted"), "spans",
    )


def without_toxic(docs: DataFrame, labels: DataFrame, flag: float = FLAG) -> DataFrame:
    """The documents whose score is below ``flag``; columns as in the input."""
    return judged(docs, learn(docs, labels)).filter(F.col("score") < flag).select("_in.*")
