"""Registry of runnable queries and, where SQL can say it, their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.testdata import BASE_CTES, Tables

PLACES = 4
# A few dozen ulps: decides exact decimal ties the same way on every engine.
NUDGE = "1.00000000000001"
_PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None, doubles: str = "", with_: dict[str, str] | None = None):
    """Register ``fn(Tables) -> DataFrame``; ``doubles`` names the rounded columns."""

    def wrap(fn):
        if key in _PLANS:
            raise ValueError(f"duplicate query {key}")
        _PLANS[key] = fn
        if oracle is not None:
            _ORACLES[key] = _compose(oracle, doubles.split(), with_ or {})
        return fn

    return wrap


def _compose(sql: str, doubles: list[str], extra: dict[str, str]) -> str:
    ctes = {**BASE_CTES, **extra}
    needed: list[str] = []
    open_: set[str] = set()  # relations being visited; a recursive one names itself

    def visit(text: str) -> None:
        for name, body in ctes.items():
            if name not in needed and name not in open_ and re.search(rf"\b(from|join)\s+{name}\b", text, re.I):
                open_.add(name)
                visit(body)
                needed.append(name)

    visit(sql)
    head = "with recursive " + ",\n".join(f"{n} as ({ctes[n].strip()})" for n in needed) + "\n" if needed else ""
    if not doubles:
        return head + f"select * from ({sql.strip()})"
    repl = ", ".join(f"round(cast({d} as double) * {NUDGE}::double, {PLACES}) + 0.0 as {d}" for d in doubles)
    return head + f"select * replace ({repl}) from ({sql.strip()})"


def rounded(df: DataFrame) -> DataFrame:
    """Round doubles so that summation order cannot show; adding 0.0 folds -0.0."""
    return df.select(*[
        (F.round(F.col(f.name) * F.lit(float(NUDGE)), PLACES) + F.lit(0.0)).alias(f.name)
        if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, folder: rounded(fn(Tables(spark, folder)))

    return {k: bind(fn) for k, fn in _PLANS.items()}


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
