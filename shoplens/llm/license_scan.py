"""Licence scan: matching statistics on a generalised suffix automaton of licence texts.

The words of all templates (licence texts, notices and the base phrases) make
one suffix automaton, whose states know the template places that end there.
Every whole text is streamed through it word by word, which gives for each
word the longest run ending there that some template holds (the matching
statistics). Runs that end there for good and have ``least`` words or more
are chained, in text and template order and over gaps of at most ``gap``
words, into spans that cover a template; of spans that overlap the one that
covers most words counts. A template of ``short`` words or fewer must be
covered whole, a longer one by ``share`` of its words.

Base phrases are states of the same automaton: one occurs wherever the stream
stands on its state, or below it by suffix links, with a run long enough.

Texts are independent, so this is one map over the documents: nothing is
shuffled or grouped. The automaton grows with the templates alone, which are
a parameter of fixed size, not with the documents. Only runs of words whose
neighbours are neighbours in some template are streamed; any other run of two
words or more is in no template.

Rows: a null text counts as empty and has no spans. Very long texts are cut
into words block by block, whole. Templates that cover the same words equally
all count. Repeated rows each get their own result, an empty table an empty
one. Output columns replace input columns of the same name, in any case.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_blocks, slices, text_input, with_fields

#: Base phrases and their labels.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]

#: Short notices: label, name and version words, each put behind the openings below.
NAMED = [("mit", "the mit license"), ("isc", "the isc license"), ("apache-2.0", "the apache license version 2 0"),
         ("mpl-2.0", "the mozilla public license version 2 0"), ("cc0-1.0", "cc0 1 0"),
         ("bsd-2-clause", "the bsd 2 clause license"), ("bsd-3-clause", "the bsd 3 clause license"),
         *[(f"{label}-{v}.0", f"the gnu {name} public license version {v}") for label, name, versions in (
             ("gpl", "general", (2, 3)), ("lgpl", "lesser general", (3,)), ("agpl", "affero general", (3,))) for v in versions],
         *[(f"cc-{part}-4.0", f"cc {part.replace('-', ' ')} 4 0") for part in
           ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")]]
OPENINGS = ("licensed under", "released under")

#: Licence texts and notices as their stewards publish them.
TEXTS = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version."""),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version."""),
    ("lgpl-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
later version."""),
    ("agpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely"""),
]

TEMPLATES: list[tuple[str, str]] = [(label, f"{opening} {name}") for label, name in NAMED for opening in OPENINGS] + TEXTS

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: A-Z to lower case, what parts words to a space, the rest as it is.
_SPREAD = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    """The words of UTF-8 bytes: digits, letters a-z after lowering A-Z, and everything beyond ASCII."""
    return data.translate(_SPREAD).split()


class Automaton:
    """Suffix automaton of several word sequences, with the places where a state's runs end in them."""

    def __init__(self, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], least: int):
        words = [words_of(text.encode()) for _, text in [*phrases, *templates]]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        coded = [[self.ids[w] for w in ws] for ws in words]
        self.labels = [label for label, _ in [*phrases, *templates]]
        self.sizes = [len(c) for c in coded]
        self.phrases = len(phrases)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.near = np.zeros((len(self.ids) + 1,) * 2, dtype=bool)         # the last row and column: no template word
        ends: list[tuple[int, int, int]] = []
        for t, code in enumerate(coded):
            state = 0
            for at, c in enumerate(code):
                state = self._extend(state, c)
                ends.append((state, t, at + 1))
            self.near[code[:-1], code[1:]] = True
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.next]  # (template, end) of states with long runs
        self.hits: list[list[int]] = [[] for _ in self.next]                # base phrases that end a state's runs
        for state, t, end in ends:
            while state > 0 and self.length[state] >= least:
                if t >= self.phrases:
                    self.places[state].append((t, end))
                state = self.link[state]
        home: dict[int, list[int]] = {}
        for p in range(self.phrases):
            state = 0
            for c in coded[p]:
                state = self.next[state][c]
            home.setdefault(state, []).append(p)
        for state in range(len(self.next)):
            at = state
            while at > 0:
                self.hits[state] += home.get(at, [])
                at = self.link[at]

    def _new(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the runs of ``q`` that are at most one word longer than those of ``p``."""
        if self.length[q] == self.length[p] + 1:
            return q
        half = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = half
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = half
            p = self.link[p]
        return half

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:                            # another sequence has been here
            return self._split(last, self.next[last][c], c)
        made = self._new(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = made
            p = self.link[p]
        if p != -1:
            self.link[made] = self._split(p, self.next[p][c], c)
        return made

    def statistics(self, run: list[int]) -> list[tuple[int, int]]:
        """Per word of a run the state and the length of the longest template run that ends there."""
        out, state, length = [], 0, 0
        for c in run:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            out.append((state, length))
        return out

    def codes(self, text: str) -> np.ndarray:
        """A whole text as template word numbers (-1: no word of a template)."""
        parts = [np.fromiter(map(self.ids.get, ws := words_of(block), repeat(-1)), np.int32, len(ws))
                 for block in byte_blocks(text.encode())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


Span = tuple[str, int, int, int, float, bool]               # label, first word, word after the last, covered, share, base


def _chains(matches: list[tuple[int, int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Chains of one template's matches ``(start, end, template end, length)``, in text order: per stretch of
    overlapping chains the one that covers most words, as ``(start, end, covered)``."""
    live: list[tuple[int, int, int, int]] = []              # end, template end, covered, start
    best: list[tuple[int, int, int]] = []
    reach = -1
    for start, end, place, length in matches:
        live = [x for x in live if x[0] >= start - gap]
        covered, first = length, start
        for e, p, n, s in live:
            if e < end and 0 < place - p and place - length - p <= gap:
                gained = n + min(length, end - e, place - p)
                if gained > covered or (gained == covered and s > first):
                    covered, first = gained, s
        live.append((end, place, covered, first))
        if first >= reach:
            best.append((first, end, covered))
        elif covered > best[-1][2]:
            best[-1] = (first, end, covered)
        reach = max(reach, end)
    return best


def scan(text: str, machine: Automaton, least: int, gap: int, share: float, short: int) -> tuple[int, list[Span], float]:
    """Words of a text, its spans (base phrases and covered templates) by place, and the largest covered share."""
    codes = machine.codes(text)
    if len(codes) < 2:
        return len(codes), [], 0.0
    near = machine.near[codes[:-1], codes[1:]]
    if not near.any():
        return len(codes), [], 0.0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], near, [False]))))
    spans: list[Span] = []
    matches: dict[int, list[tuple[int, int, int, int]]] = {}
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        found = machine.statistics(codes[a:b + 1].tolist())
        for i, (state, length) in enumerate(found):
            end = a + i + 1
            for p in machine.hits[state]:
                if machine.sizes[p] <= length:
                    spans.append((machine.labels[p], end - machine.sizes[p], end, machine.sizes[p], 1.0, True))
            if length >= least and (i + 1 == len(found) or found[i + 1][1] <= length):
                for t, place in machine.places[state]:
                    matches.setdefault(t, []).append((end - length, end, place, length))
    score = 1.0 if spans else 0.0
    covered: list[tuple[int, int, int, int]] = []
    for t, ms in matches.items():
        size = machine.sizes[t]
        for start, end, n in _chains(ms, gap):
            score = max(score, n / size)
            if n >= (size if size <= short else share * size):
                covered.append((start, end, n, t))
    covered.sort()
    spans += [(machine.labels[t], start, end, n, n / machine.sizes[t], False) for start, end, n, t in _strongest(covered)]
    return len(codes), sorted(spans, key=lambda s: (s[1], s[2], s[0], s[5])), score


def _strongest(spans: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Of spans in text order, per stretch of overlapping ones those that no other one covering more words overlaps."""
    at = 0
    while at < len(spans):
        stop, reach = at + 1, spans[at][1]
        while stop < len(spans) and spans[stop][0] < reach:
            reach = max(reach, spans[stop][1])
            stop += 1
        kept: list[tuple[int, int, int, int]] = []
        for s in sorted(spans[at:stop], key=lambda s: (-s[2], s)):
            if not any(k[2] > s[2] and k[0] < s[1] and s[0] < k[1] for k in kept):
                kept.append(s)
        yield from kept
        at = stop


SPANS = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("covered", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("base", T.BooleanType())]))


def find(docs: DataFrame, text: str = "text", keep_text: bool = True, phrases: Sequence[tuple[str, str]] = PHRASES,
         templates: Sequence[tuple[str, str]] = TEMPLATES, least: int = 3, gap: int = 6, share: float = 0.8,
         short: int = 16) -> DataFrame:
    """Add ``n_words``, ``spans`` (label, first word, word after the last, covered words, their share of the template,
    base phrase or not) and ``score`` (the largest share of a template that the text covers) to every row."""
    new = {"n_words": T.LongType(), "spans": SPANS, "score": T.DoubleType()}
    src, names, column = text_input(docs, text, list(new), keep_text)
    fields = [f.name for f in SPANS.elementType.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Automaton(phrases, templates, least)
        for batch in batches:
            for pdf in slices(batch, column):
                made = pdf[names].copy()
                rows = [scan(x or "", machine, least, gap, share, short) for x in pdf[column]]
                made["n_words"] = np.array([r[0] for r in rows], dtype=np.int64)
                made["spans"] = [[dict(zip(fields, s)) for s in r[1]] for r in rows]
                made["score"] = np.array([r[2] for r in rows], dtype=np.float64)
                yield made

    return src.mapInPandas(run, with_fields(docs, names, new))


def labels(spans):
    """The distinct labels of spans, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row the counts, places and labels of its spans."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    return found.select(key, "n_words", F.size(base).cast("long").alias("n_base"),
                        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), "score")
