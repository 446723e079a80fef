import random

import pytest

from granary.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, prefix string, d string, pos long, n_turns long, part long"


def brute(rows, digest):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append(((t is not None, t or 0), r, digest(r, x), x))
    seqs = {c: [(r, x) for _, r, _, x in sorted(vs)] for c, vs in convs.items()}
    return {
        c: (len(s), "\n".join(f"<|{r}|>\n{x}" for r, x in s)) for c, s in seqs.items()
        if not any(o != c and q[: len(s)] == s and (len(q) > len(s) or o < c) for o, q in seqs.items())
    }


def digest(role, text):
    from hashlib import sha256

    hexes = sha256(role.encode()).hexdigest() + sha256(text.encode()).hexdigest()
    return sha256(hexes.encode()).digest()[:16]


ROWS = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (3, 1, "bot", "b"),
        (4, 0, None, None), (5, None, "user", "x" * 100_000), (6, 0, "user", "ab"), (None, 0, "user", "a"),
        (7, 0, "user", "q"), (7, 1, "user", "q"), (8, 0, "user", "q"), (9, -3, "bot", "é日本"), (9, None, "user", ""),
        (10, 5, "user", "tie"), (10, 5, "user", "eit"), (10, 5, "bot", "tie"), (11, 1, "b", "c"), (12, 1, "", "bc")]


def grown(n):
    """Snapshots of growing conversations, one of many turns, one of many copies of one row."""
    rng = random.Random(n)
    rows = list(ROWS)
    for c in range(20, 60):
        root = [(rng.choice(["user", "bot"]), rng.choice("ab")) for _ in range(6)]
        for k in range(1, 4):
            rows += [(c * 10 + k, t, *root[t]) for t in range(rng.randint(1, 6))]
    rows += [(900, t, "user", f"t{t % 7}") for t in range(500)]
    rows += [(901, t + 4, "user", f"t{t % 7}") for t in range(400)]
    return rows + [(902, 3, "user", "same")] * 300 + [(903, 9, "user", "same")] * 301


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.conv_id, r.part)):
        n, parts = out.setdefault(r.conv_id, (r.n_turns, []))
        assert r.part not in [p for p, _ in parts] and n == r.n_turns
        parts.append((r.part, r.rendered))
    return {c: (n, "\n".join(x for _, x in parts)) for c, (n, parts) in out.items()}


@pytest.mark.parametrize("limits", [{}, {"long_rows": 3, "part": 50}, {"long_rows": 4, "part": 1}, {"long_chars": 20, "part": 1000}])
def test_maximal_conversations_stay(spark, limits):
    rows = grown(7)
    df = spark.createDataFrame([r + ("p", "d", 1, 2, 3) for r in rows], SCHEMA).repartition(4)
    want = brute(rows, digest)
    assert 901 not in want and 902 not in want and 900 in want and 903 in want
    assert told(chat.render(df, **limits)) == want


def test_parts_of_long_conversations_are_bounded(spark):
    df = spark.createDataFrame([(1, 3, "user", "same")] * 300 + [(2, 0, "bot", "z")], "conv_id long, turn long, role string, text string")
    out = chat.render(df, long_rows=100, part=200).collect()
    assert max(len(r.rendered) for r in out) < 200 + 15 and len([r for r in out if r.conv_id == 1]) >= 20


def test_parts_do_not_depend_on_the_way(spark):
    df = spark.createDataFrame([r + ("p", "d", 1, 2, 3) for r in grown(3)], SCHEMA).repartition(4)
    for part in (1, 40, 1000):
        rows = {tuple(r) for r in chat.render(df, part=part).collect()}
        assert rows == {tuple(r) for r in chat.render(df, long_rows=2, part=part).collect()}
        assert part == 1000 or len(rows) > len({r[0] for r in rows})


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.render(df).count() == 0
    nulls = spark.createDataFrame([(None,) * 9], SCHEMA)
    assert chat.render(nulls).count() == 0
