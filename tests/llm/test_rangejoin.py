import numpy as np
import pytest

from granary.llm import rangejoin


def plain(rows, cosine=0.9):
    size = max((len(v) for _, v in rows if v), default=0)
    full = [None if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v)
            else np.pad(np.array(v, dtype=np.float64), (0, size - len(v))) for _, v in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(n):
        for j in range(i):
            a, b = full[i], full[j]
            if a is not None and b is not None and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    ids = {}
    for k in range(n):
        ids.setdefault(find(k), []).append(rows[k][0])
    return sorted((rows[k][0], links[k], min(ids[find(k)]), rows[k][0] == min(ids[find(k)])) for k in range(n))


def made():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(25):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            rows.append((centre + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25, 0.4])).astype(np.float32).tolist())
    rows += [rows[0]] * 5 + [[2 * x for x in rows[0]]]
    rows += [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [1.0, 2.0, 0.0]]
    rng.shuffle(rows := list(map(lambda v: v, rows)))
    return [(3 * k + 1, v) for k, v in enumerate(rows)]


@pytest.mark.parametrize("home,visit", [(2048, 16_384), (4, 8)])
def test_all_links(spark, monkeypatch, home, visit):
    monkeypatch.setattr(rangejoin, "HOME_ROWS", home)
    monkeypatch.setattr(rangejoin, "VISIT_ROWS", visit)
    rows = made()
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n_links int, cid string")
    got = sorted(tuple(r) for r in rangejoin.groups(table).collect())
    assert got == plain(rows) and max(x[1] for x in got) > 4


def test_empty_and_unlinkable(spark):
    schema = "vec_id long, embedding array<float>"
    assert rangejoin.groups(spark.createDataFrame([], schema)).count() == 0
    got = rangejoin.groups(spark.createDataFrame([(1, None), (2, [0.0]), (None, [0.0])], schema)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)], key=repr)
    twice = rangejoin.groups(spark.createDataFrame([(1, [1.0]), (1, [1.0])], schema)).collect()
    assert [tuple(r) for r in twice] == [(1, 1, 1, True)] * 2
