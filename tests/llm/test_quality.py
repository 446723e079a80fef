import re
from collections import Counter, defaultdict

from granary.llm import quality


def plain(rows, limit, left):
    """The rules by loops; rows are (doc_id, source, text)."""
    gap = r"[\x20\x09-\x0D]+"
    texts = [(i, s, t or "") for i, s, t in rows]
    docs, around = defaultdict(set), defaultdict(set)
    lines = []
    for k, (_, host, text) in enumerate(texts):
        own = [re.sub(gap, " ", x.lower()).strip(" ") for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        lines.append(own)
        for j, x in enumerate(own):
            docs[host, x].add(k)
            around[host, x].add((own[j - 1] if j else None, own[j + 1] if j + 1 < len(own) else None))
    out = []
    for k, (i, host, text) in enumerate(texts):
        w = [x for x in re.split(gap, text) if x]
        windows = [tuple(w[j:j + 5]) for j in range(len(w) - 4)]
        seen = Counter(windows)
        covered = {p for j, x in enumerate(windows) if seen[x] > 1 for p in range(j, j + 5)}
        raw = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        gone = [x for x in lines[k] if len(docs[host, x]) > limit and len(around[host, x]) > limit]
        chars = sum(map(len, lines[k]))
        kept = not failed and chars - sum(map(len, gone)) >= left * chars
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(raw) - len(set(raw)),
                    len(covered), failed, kept, len(gone), sum(map(len, gone))))
    return sorted(out, key=repr)


def furnished(spark):
    rows = []
    for k in range(30):
        own = " ".join(f"w{k}x{j}" for j in range(12))
        rows.append((k, "a" if k < 20 else "b", f"before {k}\nShared  furniture of the host\nafter {k} {own}"))
        rows.append((100 + k, "a", f"Shared furniture of the host {'x ' * 3}\nq{k}"))
    rows += [(200 + k, "a", "copied one two three four five\ncopied line six seven eight nine\nthe end of it") for k in range(20)]
    rows += [(300 + k, "a", f"tiny{k} t\nshared furniture OF the host\nand more of these {k}") for k in range(3)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_dirty_rows(spark, dirty):
    rows = [(r.doc_id, r.source, r.text) for r in dirty.collect()]
    for limit in (0, 1, 50):
        got = sorted((tuple(r) for r in quality.assess(dirty, limit).collect()), key=repr)
        assert got == plain(rows, limit, quality.LEFT)


def test_furniture_goes_and_copies_stay(spark):
    rows, docs = furnished(spark)
    got = sorted((tuple(r) for r in quality.assess(docs, 5).collect()), key=repr)
    assert got == plain(rows, 5, quality.LEFT)
    by_id = {r[0]: r for r in got}
    assert by_id[0][7] and by_id[0][8] == 1 and by_id[0][9] == len("shared furniture of the host")
    assert by_id[205][7] and by_id[205][8] == 0  # copies are no furniture
    texts = {r.doc_id: r.text for r in quality.clean(docs, 5).collect()}
    assert "urniture" not in texts[0] and texts[0].startswith("before 0\nafter 0")
    assert len(texts) == sum(r[7] for r in got)


def test_depleted_documents_are_rejected(spark):
    rows = [(k, "h", f"a{k}\nfour lines of boilerplate that every page of this host repeats again and again\nb{k}") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert not any(r.kept for r in quality.assess(docs, 3).collect())
    assert all(r.kept for r in quality.assess(docs, 30).collect())


def test_clean_keeps_columns(dirty, nothing):
    out = quality.clean(dirty)
    assert out.columns == dirty.columns and [f.dataType for f in out.schema] == [f.dataType for f in dirty.schema]
    assert quality.assess(nothing).count() == 0 and quality.clean(nothing).count() == 0
