import random
import re
import time

import pytest

from granary.llm import licenses
from granary.llm.licenses import PHRASES, TEMPLATES


def find(text):
    """Labels by regular expressions and phrase places by slices."""
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    line = " " + "".join(w + " " for w in ws)
    base = [(label, i) for p, label in PHRASES.items() for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split()]
    accepted = {label for label, markup in TEMPLATES if re.search(" " + licenses.pattern(licenses.parse(markup)), line)}
    names, starts = {b[0] for b in base}, [b[1] for b in base]
    return (
        len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)),
        ",".join(sorted(names | accepted)), licenses.WHOLE if accepted else licenses.NAMED if base else 0.0,
    )


def sample(rng, seq):
    """Words that a parsed template accepts."""
    out = []
    for x in seq:
        if isinstance(x, str):
            out.append(x)
        elif x[0] == "opt":
            out += sample(rng, x[1]) if rng.random() < 0.5 else []
        elif x[0] == "alt":
            out += sample(rng, rng.choice(x[1]))
        else:
            out += [rng.choice(["acme", "the", "labs"]) for _ in range(rng.randint(x[1], x[2]))]
    return out


def planted():
    rng, texts = random.Random(5), []
    for label, markup in TEMPLATES:
        for _ in range(4):
            ws = sample(rng, licenses.parse(markup))
            texts.append("Some words, " + rng.choice([" ", "-", ".\n", "/*"]).join(w.upper() if rng.random() < 0.3 else w for w in ws) + "; é end")
            spoilt = list(ws)
            spoilt[rng.randrange(len(ws))] = "other"
            texts.append(" ".join(spoilt))
            texts.append(" ".join(ws[:-1]))
            texts.append(" ".join(ws[: len(ws) // 2] + ws))
    texts += ["MIT License mit license, the MIT-license license", "mit licenseé", "İ MIT License", "\x00mit\x01license\x7f",
              "general public license general public license", "under the cc by nc 4.0 by", "apache license " * 50]
    return texts


def test_texts_against_regular_expressions(spark, dirty):
    rows = [(k, t) for k, t in enumerate(planted())] + [(r["doc_id"], r["text"]) for r in dirty.collect()]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words long, labels string").repartition(3)
    got = sorted((tuple(r) for r in licenses.summary(licenses.scan(docs)).collect()), key=repr)
    assert got == sorted(((i, *find(t)) for i, t in rows), key=repr)
    assert {label for _, label in PHRASES.items()} | {label for label, _ in TEMPLATES} == {x for r in got for x in r[6].split(",") if x}


def test_benchmark_documents(spark, tables):
    docs = tables.raw("documents")
    want = sorted((r["doc_id"], *find(r["text"])) for r in docs.collect())
    assert sorted(map(tuple, licenses.summary(licenses.scan(docs)).collect())) == want


def test_empty_table(spark, nothing):
    assert licenses.summary(licenses.scan(nothing)).count() == 0


def test_nested_regions_and_places():
    automaton = licenses.Automaton([("x", "a [b [c] {d | e f}] {1,2} z"), ("y", "a z")])

    def labels(text):
        return {automaton.labels[k]: w for k, w in automaton.accepted([w.encode() for w in text.split()]).items()}

    assert labels("a q z") == {"x": 2}
    assert labels("a b c e f q q z") == {"x": 7}
    assert labels("a b c z") == {"x": 3}  # the region is left out, b and c are replaceable words
    assert labels("a a z") == {"x": 2, "y": 2}
    assert labels("a b c e f q q q z") == {}
    assert list(licenses.places(b" a a a b a a ", b"a a")) == [0, 1, 4]


def test_many_places_take_linear_time():
    def took(n):
        joined = b" " + b"mit license " * n
        start = time.perf_counter()
        assert sum(1 for _ in licenses.places(joined, b"mit license")) == n
        return time.perf_counter() - start

    took(1000)
    assert took(200_000) < 400 * max(took(2000), 1e-3)


@pytest.mark.parametrize("limit", [3, 50])
def test_a_small_table_of_states_starts_afresh(monkeypatch, limit):
    texts = [licenses.words(t.encode()) for t in planted()]
    whole = licenses.Automaton(TEMPLATES)
    monkeypatch.setattr(licenses, "STATES", limit)
    small = licenses.Automaton(TEMPLATES)
    assert [small.accepted(t) for t in texts] == [whole.accepted(t) for t in texts]
