import itertools
import random
import zlib

import numpy as np
import pytest

from granary.llm import toxicity
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for k in range(900):
        words = prose(rng, rng.randint(5, 120)).split()
        toxic = k % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["Vileword", "nastyone,", "SLUR", "meanies"]))
        docs.append((k, " ".join(words)))
        if k % 3:
            labels.append((k, 1, int(toxic)))
    labels += [(5, 1, 0), (99999, 0, 1), (None, 0, 1), (7, 0, None)]
    return (docs, spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.fixture(scope="module")
def field(corpus):
    return toxicity.learn(corpus[1], corpus[2])


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    f = toxicity.Field(["a", "b"], 0.9)
    f.emit, f.move = rng.normal(size=3), rng.normal(size=(2, 2))
    for n in range(1, 8):
        numbers = rng.integers(0, 3, n).tolist()
        total, toxic = 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(f.emit[k] for k, s in zip(numbers, states) if s) + sum(f.move[a, b] for a, b in zip(states, states[1:])))
            total += weight
            toxic += weight * np.array(states)
        assert np.allclose(f.marginals(numbers), toxic / total)
    assert f.marginals([]) == [] and f.score([]) == 0.0


def test_fit_climbs_the_likelihood():
    f = toxicity.Field(["a"], 0.9)
    rng = np.random.default_rng(2)
    numbers = (rng.random((200, 9)) < 0.2).astype(np.int64)
    numbers[:50, 6:] = -1
    f.fit(numbers, (numbers == 1).astype(np.int64))
    m = f.marginals([0, 0, 1, 0])
    assert m[2] > 0.9 and max(m[0], m[3]) < 0.1
    f.fit(numbers[:0], numbers[:0])


def test_held_out_documents(corpus, field):
    docs, table, labels = corpus
    rows = {r.doc_id: r for r in toxicity.scores(table, labels).collect()}
    assert len(rows) == len(docs)
    held = [k for k, _ in docs if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(rows[k].held_out == (k in set(held)) for k, _ in docs)
    wrong = sum(rows[k].predicted != (k % 4 == 0) for k in held)
    assert wrong <= 0.02 * len(held)
    assert set(field.number) == {"vileword", "nastyone", "slur", "meanies"}
    texts = dict(docs)
    for k in held:
        for s in rows[k].spans:
            assert {w.strip(",.").lower() for w in texts[k][s.start:s.end].split()} <= set(field.number)


def plain_learning(rows):
    """Cue words, reliability and counted windows of (text, toxic) by loops."""
    around, against, sizes = {}, {}, [0, 0]
    for text, toxic in rows:
        words = toxicity.WORD.findall(text.replace("İ", "i").lower())
        sizes[toxic] += 1
        for w in set(words):
            k = words.index(w)
            if toxic:
                around.setdefault(w, set()).add((words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""))
            else:
                against[w] = against.get(w, 0) + 1
    least = max(toxicity.LEAST_SUPPORT, toxicity.LEAST_SHARE * sizes[1])
    cues = sorted(w for w, s in around.items() if len(s) >= least and (len(s) / (sizes[1] + 1))
                  / ((against.get(w, 0) + 0.5) / (sizes[0] + 1)) >= toxicity.LEAST_RATIO)
    held = [x for t, x in rows if set(cues) & set(toxicity.WORD.findall(t.replace("İ", "i").lower()))]
    return cues, (sum(held) + 1) / (len(held) + 2)


def test_learning_equals_loops(corpus, field):
    docs, _, labels = corpus
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r.toxic is not None:
            known[r.doc_id] = max(r.toxic, known.get(r.doc_id, 0))
    rows = [(t, known[k]) for k, t in docs if k in known and zlib.crc32(str(k).encode()) % 3 != 1]
    cues, reliability = plain_learning(rows)
    assert sorted(field.number) == cues and field.reliability == reliability


def test_windows_cover_whole_texts():
    import pandas as pd

    text = " ".join(["a"] * 60 + ["vile"] + ["b"] * 60 + ["vile"])
    out = pd.concat(toxicity._windows({"vile": 1})([pd.DataFrame({"text": [text, text, "a b", ""], "toxic": [1, 1, 0, 0]})]))
    rows = {(None if w is None else tuple(w), x): n for w, x, n in out.itertuples(index=False)}
    assert rows.pop((None, 1)) == 2 and rows.pop(((0, 0), 0)) == 1 and rows.pop(((0,) * 41, 1)) == 2
    whole = [0] * 60 + [1] + [0] * 60 + [1]
    assert rows == {(tuple(whole[41:82]), 1): 2, (tuple(whole[82:]), 1): 2}


def test_sample_holds_one_row_per_id(corpus, spark):
    _, table, labels = corpus
    many = table.crossJoin(spark.range(50)).drop("id").unionByName(table.selectExpr("doc_id", "concat(text, ' z') as text"))
    out = toxicity.sample(many, labels, rows=10).collect()
    assert len(out) == 10 and all(r.text.endswith(" z") for r in out)


def test_weights_stand_for_repeated_windows():
    a, b = toxicity.Field(["a"], 0.9), toxicity.Field(["a"], 0.9)
    numbers = np.array([[0, 1, 0, -1], [0, 0, 1, 0], [0, 0, 0, 0]])
    toxic = (numbers == 1).astype(np.int64)
    a.fit(numbers, toxic, np.array([3.0, 1.0, 2.0]))
    b.fit(np.repeat(numbers, [3, 1, 2], axis=0), np.repeat(toxic, [3, 1, 2], axis=0))
    assert np.allclose(a.emit, b.emit) and np.allclose(a.move, b.move)


def test_dirty_rows(dirty, nothing, corpus, spark):
    labels = corpus[2]
    out = toxicity.scores(dirty, labels).collect()
    assert len(out) == dirty.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
    kept = toxicity.without_toxic(dirty, labels)
    assert kept.columns == dirty.columns and kept.count() == dirty.count()
    assert toxicity.scores(nothing, labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.scores(dirty, none).collect()} == {0.0}


def test_offsets_survive_odd_letters(field):
    score, spans = field.judge("İİ ÉÉ vileword, Straße VILEWORD")
    assert score > 0.9 and [(s["start"], s["end"]) for s in spans] == [(6, 14), (23, 31)]


def test_benchmark_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.scores(docs, labels).collect() if r.held_out and r.doc_id in known]
    hit = sum(r.predicted and known[r.doc_id] == 1 for r in rows)
    assert hit / max(1, sum(r.predicted for r in rows)) > 0.95
    # About a fifth of the labels say toxic of texts without any sign of it.
    assert hit / sum(known[r.doc_id] == 1 for r in rows) > 0.6
