import random
import re
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from granary.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, d string, pos long, words long, depth long, h1 long, n_convs long"


def digest(role, text):
    hexes = sha256(role.encode()).hexdigest() + sha256(text.encode()).hexdigest()
    return sha256(hexes.encode()).digest()[:16]


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append(((t is not None, t or 0), digest(r, x), r, x))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    new = {}
    for c, seq in own.items():
        h = crc32(str(c).encode()) % 4
        new[c] = own.get(c - c % 20, [])[:h] + seq[h:]
    members = {}
    for c, seq in new.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    out, below = [], {}
    for key in sorted(members, key=len, reverse=True):
        kids = children.get(key, [])
        leaves = sum(below[k][0] for k in kids) or 1
        text = key[-1][1] if key else ""
        saved = sum(below[k][1] for k in kids) + (len(members[key]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", text))
        below[key] = leaves, saved
        ends = sorted(c for c in members[key] if len(new[c]) == len(key))
        out.append((min(members[key]), len(key), min(members[key[:-1]]) if key else None, len(members[key]), len(kids), leaves,
                    saved, sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def grown(n):
    """Families, copies, a long conversation, repeated rows, nulls and ties."""
    rng = random.Random(n)
    rows = [(1, 0, "user", "a b"), (1, None, None, None), (None, 0, "user", "x"), (2, 5, "bot", "tie"), (2, 5, "user", "tie"),
            (2, 5, "bot", "tie"), (3, 0, "user", " \n\t "), (4, 1, "user", "é日本   x\x0by"), (5, 0, "user", "w " * 50_000),
            (61, 0, "user", "alone"), (20, 0, "user", "only one")]
    for c in range(100, 260):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a", "b b", "c\nd e"])))
    for c in range(300, 420):  # one conversation, many times
        rows += [(c, t, "user", f"same {t}") for t in range(3)]
    rows += [(c, t, "user", f"deep {t % 5}") for c in (500, 511) for t in range(900)]
    return rows + [(440 + k, 0, "bot", f"child {k}") for k in range(80)]


def nodes(spark, rows, **limits):
    df = spark.createDataFrame([r + ("d", 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in trie.trie(*trie.rebuilt(trie.placed_turns(df)), **limits).collect()), key=repr)


@pytest.mark.parametrize("task, block, chunk", [(trie.TASK, trie.BLOCK, trie.CHUNK), (700, 7, 3)])
def test_nodes_against_a_loop(spark, monkeypatch, task, block, chunk):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = grown(4)
    assert nodes(spark, rows, task=task) == brute(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    short = [c for c in range(21, 40) if crc32(str(c).encode()) % 4 == 3][:2]  # no head, all own turns left out
    rows = [(c, 0, "user", "gone") for c in short]
    got = nodes(spark, rows)
    assert got == brute(rows) and got[0][1:6] == (0, None, 2, 0, 1)


def test_empty_table(spark):
    assert nodes(spark, []) == [] and nodes(spark, [(None, 0, "user", "x")]) == []


def test_a_random_list_is_ranked_by_pairs_and_runs(spark):
    """No locality at all: ranges of arcs hold hardly any successors."""
    rng = random.Random(9)
    order = [(rng.randint(-10**12, 10**12), k % 7) for k in range(3000)]
    after = [*order[1:], (None, None)]
    arcs = spark.createDataFrame([(*a, *b) for a, b in zip(order, after)], "c long, k long, nc long, nk long")
    got = {(r.c, r.k): r.at for r in trie.ranks(arcs, task=400).collect()}
    assert got == {a: i for i, a in enumerate(order)}


def test_pairs_shrink_the_list(spark):
    n = 4000
    arcs = spark.range(n).select(F.col("id").alias("c"), F.lit(0).cast("long").alias("k"), (F.col("id") + 1).alias("nc"),
                                 F.lit(0).cast("long").alias("nk"), F.lit(1).cast("long").alias("w")).withColumn(
        "nc", F.when(F.col("nc") < n, F.col("nc"))).withColumn("nk", F.when(F.col("nc").isNotNull(), F.col("nk")))
    left = trie._paired(arcs, 1).count()
    assert 0.70 * n < left < 0.80 * n
