"""License scans by template-markup matching.

A template is the wording of a licence with markup: bare words are mandatory, ``[ ... ]`` is an
optional region, ``{m,n}`` a replaceable region of m to n words, ``{a | b c}`` a region that holds
one of the wordings given; regions nest.  All templates are compiled into one automaton over words.
A text is accepted for a template if some run of its words takes the automaton from the start to
that template's end, so every mandatory word must stand there exactly.  States of the automaton
that are alive together are one state of a table that grows as texts need it, so a text is read
once, a look-up per word, whatever the number of templates.

Texts that hold none of the runs of words that a template cannot do without are not read word by
word.  Words are maximal runs of digits, letters and characters beyond ASCII, with A-Z in lower
case.  Beside templates, places of short phrases are counted, overlapping ones too.

Defined results: null text is the empty text (no words, no labels, score 0); repeated rows are
scanned as often as they occur; further columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose words name a licence, in order of the labels' first use.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Wordings of public licences and of the notices that refer to them.
TEMPLATES = [
    ("mit-text", """permission is hereby granted free of charge to any person obtaining a copy of this software and
      associated documentation files [the software] to deal in the software without restriction including without
      limitation [on] the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
      and to permit persons to whom the software is furnished to do so subject to the following conditions"""),
    ("mit-notice", "{released | licensed | distributed | available} under the [terms of the] mit license"),
    ("isc", """permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby
      granted provided that the above copyright notice and this permission notice appear in all copies"""),
    ("bsd-2-clause", """redistribution and use in source and binary forms with or without modification are permitted provided
      that the following conditions are met [{1 | a | i}] redistributions of source code must retain the above copyright
      notice this list of conditions and the following disclaimer [{2 | b | ii}] redistributions in binary form must
      reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and
      or other materials provided with the distribution"""),
    ("bsd-3-clause", """neither the name of {1,20} nor the names of [{its | the | any}] contributors may be used to endorse or
      promote products derived from this software without specific prior written permission"""),
    ("apache-2.0", "{released | licensed | distributed | available} under the [terms of the] apache license [version] 2 0"),
    ("apache-2.0-text", """licensed under the apache license version 2 0 [the license] you may not use {this file | this work |
      this software | this project} except in compliance with the license you may obtain a copy of the license at"""),
    ("gpl-2.0", "licensed under the [terms of the] [gnu] general public license [{version | v}] 2 [0]"),
    ("gpl-3.0", "licensed under the [terms of the] [gnu] general public license [{version | v}] 3 [0]"),
    ("gpl-or-later", """is free software you can redistribute it and or modify it under the terms of the gnu [{lesser | affero |
      library}] general public license as published by the free software foundation either version {2 | 2 1 | 3} of the
      license or [at your option] any later version"""),
    ("lgpl", "gnu {lesser | library} general public license [{version | v}] {2 | 2 0 | 2 1 | 3 | 3 0}"),
    ("agpl-3.0", "gnu affero general public license [{version | v}] 3 [0]"),
    ("mpl-2.0", "subject to the terms of the mozilla public license [{version | v}] 2 0"),
    ("cc-by", "{cc by | creative commons attribution} {1 | 2 | 3 | 4} {0 | 5}"),
    ("cc-by-sa", "{cc by sa | creative commons attribution sharealike | creative commons attribution share alike} {1 | 2 | 3 | 4} {0 | 5}"),
    ("cc-by-nd", "{cc by nd | creative commons attribution noderivatives | creative commons attribution noderivs} {1 | 2 | 3 | 4} {0 | 5}"),
    ("cc-by-nc", "{cc by nc | creative commons attribution noncommercial | creative commons attribution non commercial} {1 | 2 | 3 | 4} {0 | 5}"),
    ("cc-by-nc-sa", "{cc by nc sa | creative commons attribution noncommercial sharealike} {1 | 2 | 3 | 4} {0 | 5}"),
    ("cc-by-nc-nd", "{cc by nc nd | creative commons attribution noncommercial noderivatives} {1 | 2 | 3 | 4} {0 | 5}"),
    ("cc0", "cc0 1 0 [universal]"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the {author | authors |
      copyright holders} be held liable for any damages arising from the use of this software permission is granted to
      anyone to use this software for any purpose including commercial applications"""),
]

#: Score of a text with a whole template, and of one with a phrase alone.
WHOLE, NAMED = 1.0, 0.5
#: Table states kept by a task; when full, the table starts afresh.
STATES = 20_000

_FOLD = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20
    for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z in lower case."""
    return text.translate(_FOLD).split()


# ---- markup ----------------------------------------------------------------------

def parse(markup: str) -> list:
    """Sequence of words, ("any", m, n), ("opt", sequence) and ("alt", [sequence, ...])."""
    tokens = re.findall(r"\{\s*\d+\s*,\s*\d+\s*\}|[\[\]{}|]|[^\s\[\]{}|]+", markup)
    place = 0

    def sequence(closing: str) -> list:
        nonlocal place
        out: list = []
        while place < len(tokens) and tokens[place] not in closing:
            token = tokens[place]
            place += 1
            if token == "[":
                out.append(("opt", sequence("]")))
                place += 1
            elif token == "{":
                options = [sequence("|}")]
                while tokens[place] == "|":
                    place += 1
                    options.append(sequence("|}"))
                place += 1
                out.append(("alt", options))
            elif token[0] == "{":
                low, high = map(int, token[1:-1].split(","))
                out.append(("any", low, high))
            else:
                out.append(token)
        return out

    return sequence("\0")


def pattern(seq: list) -> str:
    """The template as a regular expression over words that each have a space behind them."""
    out = []
    for x in seq:
        if isinstance(x, str):
            out.append(f"{x} ")
        elif x[0] == "opt":
            out.append(f"(?:{pattern(x[1])})?")
        elif x[0] == "alt":
            out.append("(?:" + "|".join(map(pattern, x[1])) + ")")
        else:
            out.append(f"(?:[^ ]+ ){{{x[1]},{x[2]}}}")
    return "".join(out)


def needed(seq: list) -> list[bytes]:
    """Runs of words of which every accepted text holds one, with a space before and behind each word."""
    choices, run = [], []
    for x in [*seq, ("end",)]:
        if isinstance(x, str):
            run.append(x)
            continue
        if run:
            choices.append([run])
        run = []
        if x[0] == "alt" and all(isinstance(w, str) for option in x[1] for w in option):
            choices.append(x[1])
    best = max(choices, key=lambda options: min(len(" ".join(r)) for r in options))
    return [f" {' '.join(r)} ".encode() for r in best]


class Automaton:
    """All templates over words; the states alive together form one row of a growing table."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        self.on: list[dict[bytes, list[int]]] = []
        self.always: list[list[int]] = []
        self.free: list[list[int]] = []
        self.end: dict[int, int] = {}
        parsed = [parse(markup) for _, markup in templates]
        self.needed = sorted({r for p in parsed for r in needed(p)})
        self.entry = self._state()
        for k, seq in enumerate(parsed):
            last = self._build(seq, self.entry)
            self.end[last] = k
        self._forget()

    def _state(self) -> int:
        self.on.append({})
        self.always.append([])
        self.free.append([])
        return len(self.on) - 1

    def _build(self, seq: list, at: int) -> int:
        for x in seq:
            if isinstance(x, str):
                to = self._state()
                self.on[at].setdefault(x.encode(), []).append(to)
            elif x[0] == "opt":
                inside, to = self._state(), self._state()
                self.free[at] += [inside, to]
                self.free[self._build(x[1], inside)].append(to)
            elif x[0] == "alt":
                to = self._state()
                for option in x[1]:
                    inside = self._state()
                    self.free[at].append(inside)
                    self.free[self._build(option, inside)].append(to)
            else:
                to = self._state()
                for k in range(x[2]):
                    if k >= x[1]:
                        self.free[at].append(to)
                    following = self._state()
                    self.always[at].append(following)
                    at = following
                self.free[at].append(to)
            at = to
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in out:
                    out.add(to)
                    todo.append(to)
        return frozenset(out)

    def _forget(self) -> None:
        self.numbers: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.table: list[dict[bytes, int]] = []
        self.other: list[int] = []
        self.ends: list[list[int]] = []
        self._number(self._closed({self.entry}))

    def _number(self, alive: frozenset[int]) -> int:
        if alive not in self.numbers:
            self.numbers[alive] = len(self.sets)
            self.sets.append(alive)
            self.table.append({})
            self.other.append(-1)
            self.ends.append(sorted(self.end[s] for s in alive if s in self.end))
        return self.numbers[alive]

    def _after(self, alive: frozenset[int], word: bytes | None) -> int:
        to = {self.entry}  # a template may begin at any word
        for s in alive:
            to.update(self.always[s])
            to.update(self.on[s].get(word, ()))
        return self._number(self._closed(to))

    def accepted(self, found: list[bytes]) -> dict[int, int]:
        """Template number -> number of the word that first completes it."""
        if len(self.sets) > STATES:
            self._forget()
        out: dict[int, int] = {}
        at = 0
        for place, word in enumerate(found):
            row = self.table[at]
            to = row.get(word, -1)
            if to < 0:
                alive = self.sets[at]
                if any(word in self.on[s] for s in alive):
                    to = row[word] = self._after(alive, word)
                else:  # one entry for all words that the states alive do not name
                    if self.other[at] < 0:
                        self.other[at] = self._after(alive, None)
                    to = self.other[at]
            at = to
            for k in self.ends[at]:
                out.setdefault(k, place)
        return out


_COMPILED: dict[tuple, Automaton] = {}


def compiled(templates: list[tuple[str, str]]) -> Automaton:
    key = tuple(templates)
    if key not in _COMPILED:
        _COMPILED[key] = Automaton(templates)
    return _COMPILED[key]


# ---- scan --------------------------------------------------------------------------

def places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Numbers of the words at which the phrase begins; ``joined`` has a space round every word."""
    wanted, at, word = b" " + phrase + b" ", 0, 0
    while (hit := joined.find(wanted, at)) >= 0:
        word += joined.count(b" ", at, hit)
        yield word
        at, word = hit + 1, word + 1


def scan(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Table (doc_id, n_words, named, accepted) of every text.

    ``named``: array of (label, word), the places of phrases; ``accepted``: array of (label, word),
    the templates that the text holds and the word that first completes each.
    """
    wanted = [(p.encode(), label) for p, label in phrases.items()]

    def run(batches):
        automaton = compiled(templates)
        for b in batches:
            n_words, named, accepted = [], [], []
            for text in b["text"].to_pylist():
                found = words(text or b"")
                joined = b" " + b" ".join(found) + b" "
                n_words.append(len(found))
                named.append([{"label": label, "word": w} for p, label in wanted for w in places(joined, p)])
                hits = automaton.accepted(found) if any(r in joined for r in automaton.needed) else {}
                accepted.append([{"label": automaton.labels[k], "word": w} for k, w in hits.items()])
            kind = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n_words, pa.int64()), pa.array(named, kind), pa.array(accepted, kind)],
                ["doc_id", "n_words", "named", "accepted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))
    hit = "array<struct<label: string, word: bigint>>"
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, named {hit}, accepted {hit}")


def summary(scanned: DataFrame) -> DataFrame:
    """A row per text of ``scan``: counts and places of phrases, labels and a score."""
    base = F.array_distinct("named.label")
    starts = F.col("named.word")

    def told(labels):
        return F.array_join(F.array_sort(labels), ",")

    return scanned.select(
        "doc_id", "n_words", F.size("named").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), told(base).alias("base_labels"),
        told(F.array_union(base, F.col("accepted.label"))).alias("labels"),
        F.when(F.size("accepted") > 0, F.lit(WHOLE)).when(F.size("named") > 0, F.lit(NAMED)).otherwise(F.lit(0.0)).alias("score"),
    )
