import random

import numpy as np
import pytest
import xxhash

from granary.llm import components, simhash
from tests.llm.conftest import prose


def plain_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, budget=4):
    """(doc_id, fp, least id) by comparing all pairs."""
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return sorted(((i, prints[k], least[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def got_groups(docs):
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.groups(docs).collect()), key=repr)


def near_copies(seed=5):
    rng = random.Random(seed)
    rows = []
    for _ in range(40):
        words = prose(rng, rng.randint(30, 200)).split()
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(1000)}"
            rows.append((1000 - len(rows), " ".join(copy)))
    return rows


def test_dirty_rows(dirty, nothing):
    rows = [(r.doc_id, r.text) for r in dirty.collect()]
    assert got_groups(dirty) == plain_groups(rows)
    out = simhash.deduplicate(dirty)
    groups = {(g[2], None) if g[2] is not None else (None, g[1]) for g in plain_groups(rows)}
    assert out.columns == dirty.columns and out.count() == len(groups)
    assert simhash.groups(nothing).count() == 0 and simhash.deduplicate(nothing).count() == 0


@pytest.mark.parametrize("cell", [2048, 3])
def test_near_copies(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups(rows)
    assert len({g[2] for g in want}) < len({g[1] for g in want})
    assert got_groups(docs) == want
    if cell == 2048:
        assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == sorted({g[2] for g in want})


@pytest.mark.parametrize("frontier", [200_000, 7])
def test_trie_finds_all_links(monkeypatch, frontier):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in rng.integers(0, 5, 150)]
    codes = np.unique(np.concatenate([rng.choice(centres, 150) ^ np.array(flips, dtype=np.uint64), rng.integers(0, 2**64, 40, dtype=np.uint64)]))
    cell = np.sort(rng.integers(0, 3, len(codes)))
    order = np.lexsort((codes, cell))
    codes, cell = codes[order], cell[order]
    got = {(int(i), int(j)) for a, b in simhash.trie_links(cell, codes, 4) for i, j in zip(a, b)}
    want = {(i, j) for j in range(len(codes)) for i in range(j) if cell[i] == cell[j] and int(codes[i] ^ codes[j]).bit_count() <= 4}
    assert got == want and want
    assert not list(simhash.trie_links(cell[:1], codes[:1], 4))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(10, 40)] + [(900, 901), (901, 900), (7, 7)]
    rng = random.Random(1)
    rng.shuffle(links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = {k: 100 for k in range(101, 161)} | {k: 5 for k in range(10, 40)} | {901: 900}
    assert got == want
