"""License scans: template markup compiled to token automata.

A template is a license text in which regions are optional
(``<<beginOptional>>`` to ``<<endOptional>>``, nested or not) or replaceable
(``<<var;name;most>>``: up to ``most`` words of any kind).  It is compiled to an
automaton over words; a text holds the license where the automaton accepts a run
of its words, so the mandatory wording must stand there exactly.  Runs are
tried where a template's first mandatory words stand.  Short phrases are looked
up beside the templates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, small_batches

#: (phrase, label): fixed values.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: (label, template): the wording of public licenses and of their notices, fixed values.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY 4.0"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC 4.0"),
    ("gpl-2.0-only", "<<beginOptional>>This work is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, version 2"),
    ("gpl-3.0-only", "<<beginOptional>>This work is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, version 3"),
    (
        "gpl-3.0-or-later",
        """<<var;program;12>> is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
        <<beginOptional>>(at your option)<<endOptional>> any later version.""",
    ),
    ("mit", "Released under <<beginOptional>>the terms of<<endOptional>> the MIT License"),
    (
        "mit",
        """<<beginOptional>>The MIT License (MIT)<<endOptional>> <<var;copyright;40>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>>
        shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var;holders;12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """<<beginOptional>>ISC License<<endOptional>> <<var;copyright;40>>
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;author;8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;author;8>> BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE
        OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd-2-clause",
        """<<var;copyright;40>> Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met:
        <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.
        THIS SOFTWARE IS PROVIDED BY <<var;holders;12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES""",
    ),
    (
        "bsd-3-clause",
        """<<var;copyright;40>> Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met:
        <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.
        <<beginOptional>>3.<<endOptional>> Neither the name of <<var;organization;16>> nor the names of its contributors may
        be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY <<var;holders;12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES""",
    ),
)

#: Bytes of a text to those of its words: A-Z lower-cased, ASCII other than letters and digits a space.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^;>]*;(\d+))>>")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all that is not ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


# ---------------------------------------------------------------- templates
def parse(template: str) -> list:
    """Markup as a list of words (bytes), replaceable regions (int, most words) and optional regions (lists)."""
    stack: list[list] = [[]]
    at = 0
    for m in _MARK.finditer(template):
        stack[-1] += words_of(template[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("an optional region ends that did not begin")
            inner = stack.pop()
            stack[-1].append(inner)
        else:
            stack[-1].append(int(m[2]))
    if len(stack) > 1:
        raise ValueError("an optional region does not end")
    return stack[0] + words_of(template[at:])


@dataclass
class Automaton:
    """A template as states over words: ``step`` gives all states that a word leads to."""

    label: str
    template: str
    on_word: list[dict[bytes, int]] = field(default_factory=list)
    on_any: list[int | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        parts = parse(self.template)
        first = next((k for k, p in enumerate(parts) if isinstance(p, bytes)), None)
        if first is None:
            raise ValueError(f"{self.label} has no mandatory words")
        parts = parts[first:]  # what may stand before the first mandatory word decides nothing
        run = next((k for k, p in enumerate(parts) if not isinstance(p, bytes)), len(parts))
        self.lead = b" " + b" ".join(parts[:run]) + b" "
        self._state()
        self.end = self._compile(parts, 0)
        self.closure = [self._reach(s) for s in range(len(self.free))]

    def _state(self) -> int:
        self.on_word.append({})
        self.on_any.append(None)
        self.free.append([])
        return len(self.free) - 1

    def _compile(self, parts: list, state: int) -> int:
        for p in parts:
            if isinstance(p, bytes):
                to = self._state()
                self.on_word[state][p] = to
            elif isinstance(p, int):
                inside, to = state, None
                ways = [state]
                for _ in range(p):
                    self.on_any[inside] = more = self._state()
                    ways.append(more)
                    inside = more
                to = self._state()
                for w in ways:
                    self.free[w].append(to)
            else:
                begin = self._state()
                self.free[state].append(begin)
                to = self._state()
                self.free[self._compile(p, begin)].append(to)
                self.free[state].append(to)
            state = to
        return state

    def _reach(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def match(self, words: list[bytes], start: int) -> int | None:
        """The end (exclusive) of the longest accepted run that begins at ``start``."""
        now, end = self.closure[0], None
        for i in range(start, len(words)):
            word, after = words[i], set()
            for s in now:
                to = self.on_word[s].get(word)
                if to is not None:
                    after |= self.closure[to]
                if self.on_any[s] is not None:
                    after |= self.closure[self.on_any[s]]
            if not after:
                break
            now = after
            if self.end in now:
                end = i + 1
        return end


def places(line: bytes, phrase: bytes) -> Iterator[int]:
    """Numbers of the words at which ``phrase`` begins; both have one space around each word."""
    at, word, counted = line.find(phrase), 0, 0
    while at >= 0:
        word += line.count(b" ", counted, at)
        counted = at
        yield word
        at = line.find(phrase, at + 1)


def scan_text(text: str | None, phrases: list[tuple[bytes, str]], automata: list[Automaton]) -> tuple:
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    base = [(at, label) for phrase, label in phrases for at in places(line, phrase)]
    spans = [(label.label, at, end) for label in automata for at in places(line, label.lead) if (end := label.match(words, at)) is not None]
    of_base = {label for _, label in base}
    starts = [at for at, _ in base]
    score = 1.0 if spans else len(base) / (len(base) + 1)
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(of_base)), ",".join(sorted(of_base | {s[0] for s in spans})), score,
        [{"label": n, "start": a, "end": e} for n, a, e in sorted(spans, key=lambda s: (s[1], s[2], s[0]))],
    )


_SCAN = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
_TYPE = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>"


def scan_licenses(docs: DataFrame, *, phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    Base columns tell of the places of ``phrases``; ``labels`` adds those of the
    templates that accept a run of words, which ``spans`` lists (label, start,
    end, in words).  The score is 1 where a template accepts, else n / (n + 1)
    for n places.  Null and empty texts have no words and score 0; long texts are
    scanned whole, in one step per row; repeated rows are scanned alike; an empty
    table stays empty; columns named like the new ones are replaced, all others
    pass through.  Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*_SCAN)
    wanted = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases]
    automata = [Automaton(label, t) for label, t in templates]

    def scan(texts: pd.Series) -> pd.DataFrame:
        got = list(zip(*[scan_text(t, wanted, automata) for t in texts])) or [()] * len(_SCAN)
        return pd.DataFrame({n: pd.array(c, dtype="Int64") if n.endswith("_word") else list(c) for n, c in zip(_SCAN, got)})

    found = docs.withColumn("labels", F.pandas_udf(scan, _TYPE)("text"))
    return found.select(*docs.columns, "labels.*")


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *_SCAN[:-1])


# ---------------------------------------------------------------- SQL
def pattern(parts: list) -> str:
    """A parsed template as a regular expression over words that a space follows each."""
    out = ""
    for p in parts:
        out += p.decode() + " " if isinstance(p, bytes) else f"(?:[^ ]+ ){{0,{p}}}" if isinstance(p, int) else f"(?:{pattern(p)})?"
    return out


def _sql(phrases=PHRASES, templates=TEMPLATES) -> str:
    tests = " AND ".join
    at = [f"list_filter(range(len(w)), lambda i: {tests(f'''w[i + {k + 1}] = '{x}' ''' for k, x in enumerate(p.split()))})" for p, _ in phrases]
    base = ", ".join(f"CASE WHEN len({a}) > 0 THEN '{label}' END" for a, (_, label) in zip(at, phrases))
    more = ", ".join(f"CASE WHEN regexp_matches(line, ' {pattern(parse(t))}') THEN '{label}' END" for label, t in templates)
    join = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter({x}, lambda x: x IS NOT NULL))), ','), '')"
    return rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f AS MATERIALIZED (
  SELECT doc_id, len(w) AS n_words, flatten([{", ".join(at)}]) AS starts, [{base}] AS base, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d),
m AS MATERIALIZED (SELECT *, [{more}] AS more FROM f)
SELECT doc_id, n_words, len(starts) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word,
  {join("base")} AS base_labels, {join("list_concat(base, more)")} AS labels,
  CASE WHEN len(list_filter(more, lambda x: x IS NOT NULL)) > 0 THEN 1.0 ELSE len(starts) / (len(starts) + 1.0) END::DOUBLE AS score
FROM m
"""


SQL = _sql()
