"""Quality rules: cross-document line frequency, in DataFrame functions only.

Every document is measured by itself (words, symbols, repeated lines, repeated five-word
windows).  Its lines are normalised and hashed; per host the documents that hold a line are
counted, and so are the different neighbourhoods (line before, line after) in which it stands.
A line that exceeds the limit in both counts is furniture of the host and is removed.  The
second count keeps copied documents apart from furniture: the lines of a thousand copies always
stand between the same neighbours, and copies are the business of the duplicate stages.  A
document of which too little is left is depleted and rejected.

Defined results: null text is the empty text (rejected, it has fewer than ten words); a null
host is a host of its own; every row counts as a document, repeated rows too; further columns of
the input play no part.  Work per text is O(n log n); nothing is gathered by host, line or word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.prefix import materialise
from granary.llm.exprs import GAP, let, words

#: A line may stand in this many documents, and neighbourhoods, of one host.
LINE_LIMIT = 50
#: Share of a document's characters in lines that must be left after removal.
LEFT = 0.3
WINDOW = 5


def _covered(starts: Column) -> Column:
    """Words covered by windows that begin at the ascending positions ``starts``."""
    return let(
        starts,
        lambda s: F.aggregate(
            F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW)))),
            F.lit(0),
            lambda a, x: a + x,
        ),
    )


def _repeated_starts(hashes: Column) -> Column:
    """Positions of windows whose hash occurs at least twice, ascending."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(
        placed,
        lambda p: F.array_sort(
            F.transform(
                F.filter(
                    p,
                    lambda x, k: x["h"].eqNullSafe(F.get(p, k + 1)["h"])
                    | ((k > 0) & (x["h"] == F.get(p, F.greatest(k - 1, F.lit(0)))["h"])),
                ),
                lambda x: x["i"],
            )
        ),
    )


def repeat_words(text_words: Column) -> Column:
    """Number of words inside five-word windows that occur twice or more in the text."""
    hashed = F.transform(text_words, lambda w: F.xxhash64(w))
    windows = let(
        hashed,
        lambda h: F.when(
            F.size(h) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(h) - WINDOW),
                lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            _covered(_repeated_starts(w))
        ),
    )


def normalised(line: Column) -> Column:
    """The form in which lines are compared: lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), GAP, " "))


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _signed(lines: Column) -> Column:
    """Per line its hash, its length and the hash of its neighbourhood."""
    return let(
        F.transform(lines, lambda x: let(normalised(x), lambda y: F.struct(F.xxhash64(y).alias("h"), F.length(y).alias("n")))),
        lambda s: F.transform(
            s,
            lambda x, i: F.struct(
                x["h"].alias("h"),
                x["n"].alias("n"),
                F.xxhash64(
                    F.when(i > 0, F.get(s, F.greatest(i - 1, F.lit(0)))["h"]), F.get(s, i + 1)["h"]
                ).alias("c"),
            ),
        ),
    )


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str, carry: bool = False) -> DataFrame:
    """One row per document: its measures and signed lines; with ``carry`` the input row too."""
    raw = docs.select(
        docs[id_col].alias("doc_id"),
        docs[host_col].cast("string").alias("host"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *([F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_in")] if carry else []),
    )
    facts = let(
        words(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    lines = let(
        _lines(F.col("text")),
        lambda x: F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), _signed(x).alias("lines")
        ),
    )
    return (
        raw.withColumn("facts", facts)
        .withColumn("by_line", lines)
        .withColumn("n_symbols", F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long"))
        .drop("text")
        .select(
            F.monotonically_increasing_id().alias("_row"), "doc_id", "host", "facts.*", "n_symbols",
            "by_line.n_dup_lines", "by_line.lines", *(["_in"] if carry else []),
        )
        .withColumn(
            "base_failed",
            (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        )
    )


def frequent_lines(table: DataFrame, limit: int) -> DataFrame:
    """Lines (host, h) in more than ``limit`` documents and neighbourhoods of a host."""
    placed = table.select("host", F.explode("lines").alias("x")).select("host", "x.h", "x.c")
    # A document counts once for a line, however often it repeats it.
    once = table.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    documents = once.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > limit)
    around = (
        placed.groupBy("host", "h", "c").agg(F.lit(1).alias("one"))
        .groupBy("host", "h").agg(F.count(F.lit(1)).alias("places")).filter(F.col("places") > limit)
    )
    return documents.join(around, documents["h"].eqNullSafe(around["h"]) & documents["host"].eqNullSafe(around["host"])).select(
        documents["host"], documents["h"]
    )


def judged(table: DataFrame, limit: int = LINE_LIMIT, left: float = LEFT) -> DataFrame:
    """Adds ``removed`` (hashes of removed lines), ``removed_chars`` and ``kept``."""
    frequent = materialise(frequent_lines(table, limit)).select(F.col("host").alias("_host"), F.col("h").alias("_h"))
    lines = table.select("_row", "host", F.explode("lines").alias("x")).select("_row", "host", "x.h", "x.n")
    hits = lines.join(frequent, (lines["h"] == F.col("_h")) & lines["host"].eqNullSafe(F.col("_host")))
    per_row = hits.groupBy("_row").agg(
        F.sum("n").alias("removed_chars"), F.count(F.lit(1)).alias("n_removed"), F.collect_set("h").alias("removed")
    )
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    joined = table.withColumn("line_chars", chars).drop("lines").join(per_row, "_row", "left")
    gone = F.coalesce("removed_chars", F.lit(0))
    return joined.withColumns({
        "removed_chars": gone.cast("long"),
        "n_removed": F.coalesce("n_removed", F.lit(0)).cast("long"),
        "kept": ~F.col("base_failed") & (F.col("line_chars") - gone >= left * F.col("line_chars")),
    })


def assess(
    docs: DataFrame, limit: int = LINE_LIMIT, left: float = LEFT,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """Measures and verdict of every document, without its text."""
    table = materialise(measured(docs, id_col, text_col, host_col))
    return judged(table, limit, left).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed", "removed_chars",
    )


def clean(
    docs: DataFrame, limit: int = LINE_LIMIT, left: float = LEFT,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str | None = "n_chars",
) -> DataFrame:
    """The documents that stay, without the removed lines; columns as in the input."""
    table = materialise(measured(docs, id_col, text_col, host_col, carry=True))
    kept = judged(table, limit, left).filter("kept")
    text = F.col("_in")[text_col]
    rest = F.array_join(
        F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("removed"), F.xxhash64(normalised(x)))), "\n"
    )
    kept = kept.withColumn("_text", F.when(F.col("n_removed") > 0, rest).otherwise(text))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("_text").alias(c))
        elif c == chars_col:
            changed = F.length("_text").cast(docs.schema[c].dataType)
            out.append(F.when(F.col("n_removed") > 0, changed).otherwise(F.col("_in")[c]).alias(c))
        else:
            out.append(F.col("_in")[c].alias(c))
    return kept.select(*out)
