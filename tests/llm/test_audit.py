import random
import re
from collections import defaultdict
from itertools import permutations

import pytest

from granary.llm import audit

LABELS = "doc_id long, quality long, toxic long, part string, mask int"


def brute(docs, labels, names=audit.FILTERS):
    """Rows by applying the filters one after another, in every order."""
    least = {}
    for r in docs:
        t = r["text"] or ""
        if r["doc_id"] is not None:
            least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    good = {l[0] for l in labels if l[1] == 1 and l[0] is not None}
    toxic = {l[0] for l in labels if l[2] == 1 and l[0] is not None}
    parts = defaultdict(list)
    for r in docs:
        t, i = r["text"] or "", r["doc_id"]
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        parts[r["lang"] or ""].append((fails, i in good, i in toxic))
    rows = []
    for part, all_docs in parts.items():
        share, mine = defaultdict(int), []
        for order in permutations(names):
            left = all_docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                failing = [d for d in all_docs if d[0][f]]
                share[f] += len(gone)
                mine.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone),
                             sum(sum(d[0].values()) == 1 for d in failing), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        rows += [(*m[:-1], share[m[-1]]) for m in mine]
    return rows


def table(spark, docs, labels):
    failed = audit.failures(docs)
    return audit.audit(audit.weighted_masks(failed, spark.createDataFrame(labels, LABELS)))


def test_every_order_against_a_loop(spark, dirty):
    rng = random.Random(1)
    labels = [(k % 40 if k % 7 else None, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x", 3) for k in range(60)]
    want = brute(dirty.collect(), labels)
    assert sorted(map(tuple, table(spark, dirty, labels).collect())) == sorted(want)


def test_benchmark_rows(spark, tables):
    docs, labels = tables.raw("documents"), tables.raw("labels").selectExpr("doc_id", "quality", "toxic", "'' part", "0 mask")
    got = table(spark, docs, [tuple(r) for r in labels.collect()]).collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs.collect(), [tuple(r) for r in labels.collect()]))


def test_a_copied_text_under_one_id(spark):
    rows = [(5, "w " * 10, "en")] * 50 + [(5, "w " * 10, "de")] * 3 + [(4, "other", None), (None, "w " * 10, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = table(spark, docs, []).where("filter_order = 'EABCD' and step = 1").collect()
    assert {r.part: (r.kept, r.removed) for r in got} == {"en": (51, 0), "de": (3, 0), "": (1, 0)}


def test_empty_table(spark, nothing):
    assert table(spark, nothing, []).count() == 0


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_reach_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for k in audit.plain_changes(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(permutations(range(n))))


def test_diagram_shares_nodes_and_keeps_weights():
    rng = random.Random(3)
    weights = {m: (rng.randint(0, 2), 1) for m in range(64) if rng.random() < 0.6}
    diagram = audit.Diagram(6, weights)
    start = diagram.weight[diagram.root]
    for k in audit.plain_changes(6):
        diagram.swap(k)
        assert diagram.weight[diagram.root] == start
        for level in diagram.levels:
            assert len(set(level.values())) == len(level) and (0, 0) not in level.values()
