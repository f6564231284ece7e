"""License scans by template markup.

A template is a license text or notice with optional regions, ``<<optional>> ...
<<end>>``, which may nest, and replaceable ones, ``<<var most=N match=PATTERN>>``:
up to N words (at least one), each matching the pattern whole (any word if none is given).
All else is mandatory, word by word. The templates are compiled into one automaton
over words, made deterministic as it is used. It is started at each word that a
template can start with; as templates have no unbounded region, a start reads at most as
many words as the longest template can have, and a scan is linear in the text.
Texts are compared in lower-case words, so case, line breaks and punctuation
don't count, as in the matching guidelines of license lists.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .words import plain_words

# Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Wording of public licenses and of common notices, marked up. Labels may repeat.
_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE <<optional>>AUTHORS OR<<end>> COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
TEMPLATES = (
    ("mit-notice", "under the <<optional>>terms of the<<end>> MIT License"),
    ("gpl-notice", "licensed under the <<optional>>terms of the<<end>> GNU <<optional>>Lesser<<end>> <<optional>>Affero<<end>> General Public License<<optional>>,<<end>> <<optional>>either<<end>> version <<var most=2 match=v?[0-9]+>> <<optional>>or any later version<<end>>"),
    ("apache-notice", "licensed under the <<optional>>terms of the<<end>> Apache License<<optional>>,<<end>> Version <<var most=2 match=[0-9]+>>"),
    ("cc-notice", "licensed under <<optional>>a<<end>> <<optional>>the<<end>> <<optional>>Creative Commons<<end>> CC BY<<optional>>-NC<<end>><<optional>>-ND<<end>><<optional>>-SA<<end>> <<var most=2 match=[0-9]+>>"),
    ("cc-notice", "licensed under <<optional>>a<<end>> <<optional>>the<<end>> Creative Commons Attribution<<optional>>-NonCommercial<<end>><<optional>>-NoDerivatives<<end>><<optional>>-ShareAlike<<end>> <<var most=2 match=[0-9]+>> <<optional>>International<<end>> License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software. " + _DISCLAIMER),
    ("isc-text", "Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var most=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var most=8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<optional>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<optional>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<optional>><<optional>>3.<<end>> Neither the name of <<var most=12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.<<end>> THIS SOFTWARE IS PROVIDED BY <<var most=10>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU <<optional>>Lesser<<end>> <<optional>>Affero<<end>> General Public License as published by the Free Software Foundation, either version <<var most=2 match=[0-9]+>> of the License, or (at your option) any later version."),
    ("apache-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<optional>>http://www.apache.org/licenses/LICENSE-2.0<<end>> <<optional>>https://www.apache.org/licenses/LICENSE-2.0<<end>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mpl-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<optional>>http://mozilla.org/MPL/2.0<<end>> <<optional>>https://mozilla.org/MPL/2.0<<end>>"),
    ("unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("spdx-tag", "SPDX-License-Identifier: <<var most=6 match=[0-9a-z]+>>"),
)

_MARK = re.compile(r"(<<[^>]*>>)")
_VAR = re.compile(r"<<var most=([0-9]+)(?: match=(.*))?>>")


@dataclass
class Automaton:
    """Templates as states over words; sets of states are numbered as a scan meets them."""

    labels: list[str]
    #: Mandatory words of each template.
    wording: list[int] = field(default_factory=list)
    #: Sets of states and steps that are remembered at most; then both start anew.
    most: int = 100_000

    @classmethod
    def of(cls, templates) -> Automaton:
        out = cls([label for label, _ in templates])
        out.words: list[dict] = []
        out.vars: list[list] = []
        out.free: list[list] = []
        out.patterns: list = []
        out.ends: dict[int, int] = {}
        out.root = out._state()
        for k, (_, text) in enumerate(templates):
            out._add(k, text)
        out.vocabulary = {w for edges in out.words for w in edges}
        out._forget()
        out.first = set(out.vocabulary) if any(out.vars[s] for s in out.sets[0]) else {w for s in out.sets[0] for w in out.words[s]}
        return out

    def _state(self) -> int:
        self.words.append({})
        self.vars.append([])
        self.free.append([])
        return len(self.words) - 1

    def _add(self, k: int, text: str) -> None:
        at = self._state()
        self.free[self.root].append(at)
        open_: list[int] = []
        mandatory = 0
        for part in _MARK.split(text):
            if part == "<<optional>>":
                open_.append(at)
            elif part == "<<end>>":
                after = self._state()
                self.free[at].append(after)
                self.free[open_.pop()].append(after)
                at = after
            elif m := _VAR.fullmatch(part):
                kind = self._pattern(m[2] or ".*")
                after = self._state()
                for _ in range(int(m[1])):
                    nxt = self._state()
                    self.vars[at].append((kind, nxt))
                    self.free[nxt].append(after)
                    at = nxt
                at = after
            elif part.startswith("<<"):
                raise ValueError(f"unknown mark {part}")
            else:
                for word in plain_words(part):
                    nxt = self._state()
                    self.words[at][word] = nxt
                    at = nxt
                    mandatory += not open_
        if open_ or not mandatory:
            raise ValueError("a template needs mandatory words, and an end for each optional region")
        self.ends[at] = k
        self.wording.append(mandatory)

    def _pattern(self, pattern: str) -> int:
        compiled = re.compile(pattern.encode(), re.DOTALL)
        if compiled not in self.patterns:
            self.patterns.append(compiled)
        return self.patterns.index(compiled)

    def _forget(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.accepts: list[list[int]] = []
        self.steps: dict[tuple, int] = {}
        self._number({self.root})

    def _number(self, states) -> int:
        """The number of a set of states, closed over free steps; -1 of the empty one."""
        todo, closed = list(states), set(states)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in closed:
                    closed.add(n)
                    todo.append(n)
        if not closed:
            return -1
        key = frozenset(closed)
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.accepts.append(sorted(self.ends[s] for s in key if s in self.ends))
        return self.numbers[key]

    def _step(self, at: int, word: bytes) -> int:
        fits = tuple(bool(p.fullmatch(word)) for p in self.patterns)
        symbol = at, word if word in self.vocabulary else fits
        if symbol not in self.steps:
            there = {n for s in self.sets[at] for n in [self.words[s].get(word)] if n is not None}
            self.steps[symbol] = self._number(there | {n for s in self.sets[at] for kind, n in self.vars[s] if fits[kind]})
        return self.steps[symbol]

    def longest(self, words: list[bytes], start: int) -> dict[int, int]:
        """Template -> end of the longest text of it that starts here."""
        found: dict[int, int] = {}
        if len(self.sets) + len(self.steps) > self.most:
            self._forget()
        at, k = 0, start
        while k < len(words) and (at := self._step(at, words[k])) >= 0:
            k += 1
            for t in self.accepts[at]:
                found[t] = k
        return found

    def accepts_whole(self, text: str) -> list[str]:
        """Labels of the templates whose wording the whole text is."""
        words = plain_words(text)
        return [self.labels[t] for t, end in self.longest(words, 0).items() if end == len(words)]

    def scan(self, words: list[bytes], starts: list[int]) -> list[tuple[int, int, int]]:
        """(template, start, end) of each match, leftmost, longest and without overlaps for each template."""
        out, taken = [], [0] * len(self.labels)
        for i in starts:
            for t, end in self.longest(words, i).items():
                if i >= taken[t]:
                    out.append((t, i, end))
                    taken[t] = end
        return out


_COMPILED: list = []


def automaton() -> Automaton:
    """The automaton of this process."""
    if not _COMPILED:
        _COMPILED.append(Automaton.of(TEMPLATES))
    return _COMPILED[0]


_WORDS = [(tuple(p.encode().split()), label) for p, label in PHRASES]


def scan(text: str | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int]], float]:
    """(words, base places (label, start), template matches (label, start, end), score) of a text; null has no words.

    The score is m / (m + 5) for the m mandatory words of the longest wording found, 0 without any.
    """
    words = plain_words(text)
    a = automaton()
    heads = a.first | {p[0] for p, _ in _WORDS}
    starts = [i for i, w in enumerate(words) if w in heads]
    places = [(label, i) for i in starts for p, label in _WORDS if words[i] == p[0] and tuple(words[i : i + len(p)]) == p]
    matches = a.scan(words, [i for i in starts if words[i] in a.first])
    sizes = {label: len(p) for p, label in _WORDS}
    most = max([sizes[label] for label, _ in places] + [a.wording[t] for t, _, _ in matches], default=0)
    return len(words), places, [(a.labels[t], i, end) for t, i, end in matches], most / (most + 5)


KINDS = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double>"
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def row(text: str | None) -> tuple:
    """The row of ``KINDS`` for one text."""
    n, places, matches, score = scan(text)
    base = {label for label, _ in places}
    at = [i for _, i in places]
    return n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {label for label, _, _ in matches})), score


def found(text: Column) -> Column:
    """Array of (label, start, end) of the template matches of each text, in words from 0, end exclusive."""

    @F.arrow_udf("array<struct<label:string,start:bigint,end:bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.array([[{"label": x, "start": i, "end": j} for x, i, j in scan(t)[2]] for t in texts.to_pylist()], kind)

    return run(text)


def find_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts, places and labels of the phrases, labels of the templates too, and a score.

    A null text counts as empty: no words, no labels, null places. Repeated rows
    each get a row, null ids stay null, an empty table gives an empty result,
    other columns aren't read.
    """
    ship(docs.sparkSession)

    @F.arrow_udf(KINDS)
    def run(texts: pa.Array) -> pa.Array:
        cols = list(zip(*(row(x) for x in texts.to_pylist()), strict=True)) or [()] * len(_NAMES)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _NAMES)

    return docs.select("doc_id", run(F.col("text")).alias("l")).select("doc_id", "l.*")
