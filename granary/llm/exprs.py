"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where inner lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Items after which ``scan`` sets a list aside.
CHUNK = 128


def scan(items: Column, state: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """Array of what a fold emits: ``step(state, item)`` is a struct of the next ``state`` and a ``value`` of type ``kind``.

    A list that grows in an aggregate is copied at every step; here the growing list is never longer
    than a chunk, so the work is in proportion to the items.
    """

    def emit(a: Column, i: Column) -> Column:
        return let(step(a["state"], i), lambda r: F.struct(
            r["state"].alias("state"), F.concat(a["out"], F.array(r["value"])).alias("out")))

    def chunk(x: Column):
        def go(acc: Column, k: Column) -> Column:
            zero = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
            return let(F.aggregate(F.slice(x, k * CHUNK + 1, F.lit(CHUNK)), zero, emit), lambda a: F.struct(
                a["state"].alias("state"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

        return go

    def whole(x: Column) -> Column:
        last = F.greatest(F.floor((F.size(x) - 1) / CHUNK).cast("int"), F.lit(0))
        zero = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), last), zero, chunk(x), lambda a: a["out"]))

    return let(items, whole)


def words(text: Column) -> Column:
    """Maximal runs of characters that are not white space."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def parcels(texts: list[str], characters: int = 1_000_000) -> Iterator[list[str]]:
    """The texts in runs of about so many characters; a longer text is a run of its own."""
    run: list[str] = []
    size = 0
    for t in texts:
        if run and size + len(t) > characters:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run

