"""Secret scans: patterns and sliding-window entropy, in DataFrame functions only.

Patterns give the base spans.  For keys without a pattern, candidate strings (long runs of key
characters) are read through a window of ``WINDOW`` characters: one count per character of the
class is kept, each step adds the entering character and takes the leaving one away, and the
Shannon entropy follows from the sum of n * log2(n), which changes by those two counts only.
Windows above the limit of their class (hexadecimal, or the 64-letter alphabet) merge into spans
of kind ``entropy``.  An allow list suppresses candidates that are no keys: words, one-case
identifiers, paths, UUIDs, dates, placeholders.

Defined results: null text is the empty text and has no spans; spans are in code points, end
exclusive; overlapping base spans of different kinds all stay; an entropy span inside a base span
is not repeated.  Every row is scanned by itself, so repeated rows and further columns are plain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.exprs import let, scan

# The patterns of the base spans, by kind, in the order in which ties are listed.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Greedy runs: those below 20 and 24 characters fail as a whole, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
ENTROPY = 3

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Entropy limits in bits per character: random strings reach about 3.3 and 4.0.
HEX_LIMIT = 2.9
KEY_LIMIT = 3.7
#: Candidates that match one of these as a whole are not keys.
ALLOW = (
    r"[A-Za-z_/=+-]+",  # no digit: words, identifiers, paths
    r"[0-9_/=+-]+",  # no letter: numbers, dates, rules
    r"[a-z]+(?:[-_/][a-z0-9]{1,12})+",  # lower-case slugs and paths
    r"[A-Z]+(?:_[A-Z0-9]{1,12})+",  # constants
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUIDs
    r".*(?:[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Xx]{6}|0123456789|123456789|[Pp]laceholder).*",
)

PLACE = "struct<start:int,end:int>"
SPAN = f"array<{PLACE}>"


def _placed(text: Column, pattern: str, keep=None) -> Column:
    """Spans of all leftmost non-overlapping matches; ``keep`` gets (match number) and filters.

    Parts between matches and matches alternate, so a match starts after the parts up to it and the
    matches before it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def spans(m: Column, g: Column) -> Column:
        both = F.zip_with(m, g, lambda x, y: F.struct(F.length(y).alias("gap"), F.length(x).alias("len")))
        both = F.filter(both, lambda x: x["len"].isNotNull())
        return scan(both, F.lit(0), lambda at, x: F.struct(
            (at + x["gap"] + x["len"]).alias("state"),
            F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["len"]).alias("end")).alias("value"),
        ), PLACE)

    placed = let(found, lambda m: let(gaps, lambda g: spans(m, g)))
    if keep is not None:
        placed = let(placed, keep)
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(SPAN))


def _assign(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return _placed(text, ASSIGN, lambda s: let(values, lambda v: F.filter(s, lambda x, i: F.length(F.get(v, i)) >= 6)))


def _suppressed(candidate: Column) -> Column:
    return candidate.rlike("^(?:" + "|".join(ALLOW) + ")$")


def window_spans(candidate: Column) -> Column:
    """Spans, relative to ``candidate``, of merged windows above the entropy limit of its class."""
    n_log = F.array(*[F.lit(0.0 if n == 0 else n * math.log2(n)) for n in range(WINDOW + 2)])
    symbols = len(ALPHABET)
    state = F.struct(
        F.array_repeat(F.lit(0), symbols).alias("counts"), F.lit(0.0).alias("total"), F.array().cast(SPAN).alias("out")
    )
    limit = F.when(candidate.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(HEX_LIMIT)).otherwise(F.lit(KEY_LIMIT))

    def step(codes: Column, top: Column, t: Column):
        def go(acc: Column, i: Column) -> Column:
            new = F.get(codes, i)
            old = F.when(i >= WINDOW, F.get(codes, F.greatest(i - WINDOW, F.lit(0)))).otherwise(F.lit(-1))
            n_new, n_old = F.get(acc["counts"], new), F.get(acc["counts"], F.greatest(old, F.lit(0)))
            # One enters, one leaves; if both are the same character nothing changes.
            total = F.when(new == old, acc["total"]).otherwise(
                acc["total"]
                + F.get(t, n_new + 1) - F.get(t, n_new)
                + F.when(old >= 0, F.get(t, F.greatest(n_old - 1, F.lit(0))) - F.get(t, n_old)).otherwise(F.lit(0.0))
            )
            counts = F.transform(
                acc["counts"], lambda c, k: c + (k == new).cast("int") - (k == old).cast("int")
            )
            entropy = F.lit(math.log2(WINDOW)) - total / WINDOW
            first = i - (WINDOW - 1)
            span = F.array(F.struct(first.cast("int").alias("start"), (i + 1).cast("int").alias("end")))
            last = F.get(acc["out"], F.greatest(F.size(acc["out"]) - 1, F.lit(0)))
            longer = F.array(F.struct(last["start"].alias("start"), (i + 1).cast("int").alias("end")))
            out = (
                F.when((i < WINDOW - 1) | (entropy < top), acc["out"])
                .when(last["end"] >= first, F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), longer))
                .otherwise(F.concat(acc["out"], span))
            )
            return F.struct(counts.alias("counts"), total.alias("total"), out.alias("out"))

        return go

    codes = F.transform(
        F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1
    )
    spans = let(
        codes,
        lambda c: let(limit, lambda top: let(n_log, lambda t: F.aggregate(
            F.sequence(F.lit(0), F.size(c) - 1), state, step(c, top, t), lambda a: a["out"]
        ))),
    )
    return F.when(_suppressed(candidate), F.array().cast(SPAN)).otherwise(spans)


def _entropy(text: Column) -> Column:
    """Entropy spans of the text's candidates."""
    # The candidates come with their places: cutting them out by position would walk the text for each.
    both = F.arrays_zip(
        _placed(text, CANDIDATE).alias("place"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("candidate")
    )
    return F.flatten(F.transform(
        both,
        lambda p: F.transform(window_spans(p["candidate"]), lambda s: F.struct(
            (s["start"] + p["place"]["start"]).alias("start"), (s["end"] + p["place"]["start"]).alias("end")
        )),
    ))


def _outside(base: Column, more: Column) -> Column:
    """The spans of ``more`` that lie in no span of ``base``, by one pass over both in order of their start."""
    both = F.array_sort(F.concat(base, _of_kind(more, ENTROPY)))
    seen = scan(both, F.lit(0), lambda reach, x: F.struct(
        F.when(x["kind"] < ENTROPY, F.greatest(reach, x["end"])).otherwise(reach).alias("state"),
        F.when((x["kind"] == ENTROPY) & (x["end"] > reach), x).alias("value"),
    ), "struct<start:int,kind:int,end:int>")
    return F.filter(seen, lambda x: x.isNotNull())


def _listed(spans: list[tuple[int, Column]]) -> Column:
    """Spans of all kinds as structs (start, kind number, end), in order."""
    return F.array_sort(F.concat(*[_of_kind(s, k) for k, s in spans]))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(
        spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))
    )


def found(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Input row ``_in`` with ``base`` and ``spans``: ordered arrays of (start, kind number, end)."""
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_in"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"),
    )
    text = F.col("_text")
    rows = rows.withColumn("base", _listed([(0, _assign(text)), (1, _placed(text, ACCESS)), (2, _placed(text, HEX))]))
    more = F.when(text.rlike(CANDIDATE), _entropy(text)).otherwise(F.array().cast(SPAN))
    rows = rows.withColumn("_extra", _outside(F.col("base"), more))
    return rows.withColumn(
        "spans",
        F.array_sort(F.concat("base", "_extra")),
    ).select("_in", "_text", "base", "spans")


def rendered(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(
            ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")
        )),
        ",",
    )


def mask(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span (overlapping ones as one) replaced by ``mark``."""
    rows = found(docs, text_col)

    def take(t: Column):
        # Up to the state the text is copied or masked; a span that begins before it only extends the mask.
        return lambda at, s: F.struct(
            F.greatest(at, s["end"]).alias("state"),
            F.when(s["start"] >= at, F.concat(F.substring(t, at + 1, s["start"] - at), F.lit(mark))).otherwise("").alias("value"),
        )

    def whole(t: Column) -> Column:
        rest = F.substring(t, F.array_max(F.transform("spans", lambda s: s["end"])) + 1, F.length(t))
        return F.concat(F.array_join(scan(F.col("spans"), F.lit(0), take(t), "string"), ""), rest)

    changed = F.size("spans") > 0
    rows = rows.withColumn("_masked", F.when(changed, let(F.col("_text"), whole)))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.when(changed, F.col("_masked")).otherwise(F.col("_in")[c]).alias(c))
        elif c == chars_col:
            out.append(F.when(changed, F.length("_masked").cast(docs.schema[c].dataType)).otherwise(F.col("_in")[c]).alias(c))
        else:
            out.append(F.col("_in")[c].alias(c))
    return rows.select(*out)
