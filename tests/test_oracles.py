"""Spark against an independent engine on the smallest data set.

A cross-section runs by default; GRANARY_ALL=1 runs every checked query.
"""

import os

import duckdb
import pytest

from granary.plans import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = """FIL05 FIL06 FIL07 FIL15 FIL16 AGG01 AGG05 AGG06 AGG08 AGG11 AGG14 AGG20 AGG22 JOI05 JOI07 WIN01 WIN06 WIN07 WIN11 WIN14 INV02 INV04
INV09 INV11 INV14 INV15 DEC01 DEC03 RSK03 FIN02 MKD01 MKD09 SCN04 SEN01 SEN03 SIG04 MAP05 MAP07 MAP09 MAP12 MAP15 SRC01 SRC08 SRC13 SRC14
TSF04 TSF07 TSF13 TSF15 TSF19 TSF23 TSF24 TSF26 TSF28 TSF29 SNK04 STR01 STR06 STR08""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def fix(v):
        if isinstance(v, float):
            return v + 0.0
        if hasattr(v, "hour"):
            return v.replace(tzinfo=None).isoformat()
        return tuple(fix(x) for x in v) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


KEYS = sorted(catalogue.oracles()) if os.environ.get("GRANARY_ALL") else SOME


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, duck, key):
    df = catalogue.runnable()[key](spark, SF)
    cur = duck.execute(catalogue.oracles()[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, cur.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
