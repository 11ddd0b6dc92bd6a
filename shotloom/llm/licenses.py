"""License texts by template markup: optional and replaceable regions compiled into token automata.

A template is wording with two kinds of marks. ``<<beginOptional>> ... <<endOptional>>`` holds words that may be left out, and may be
nested. ``<<var;name=...;match=A-B>>`` stands for A to B words of any kind (a name, a year, a number). All other wording is
mandatory: a text is accepted only where every mandatory word stands as written. All templates become one automaton over words,
which is made deterministic as far as texts lead; it is run from every place of a text at which an accepted wording can begin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm.common import byte_slices, released, ship


class Template(NamedTuple):
    label: str
    text: str
    kind: str = "method"


#: Phrases that name a license; each is a template without marks.
BASE = (
    Template("mit", "under the MIT license", "base"),
    Template("apache-2", "Apache License Version 2", "base"),
    Template("cc-by-nc", "CC BY NC", "base"),
)

# Wording of public licenses and of their usual notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the <<beginOptional>>"<<endOptional>>Software<<beginOptional>>"<<endOptional>>), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be
included in all copies or substantial portions of the Software. <<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.<<endOptional>>"""
_ISC = """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<var;name=bullet;match=0-1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<var;name=bullet;match=0-1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_3 = _BSD + """ <<var;name=bullet;match=0-1>> Neither the name of <<var;name=organization;match=1-12>> nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the <<beginOptional>>"<<endOptional>>License<<beginOptional>>"<<endOptional>>); you may not use this file except in compliance with the License.
You may obtain a copy of the License at"""
_GPL = """This <<var;name=work;match=1-6>> is <<beginOptional>>free software<<endOptional>> <<beginOptional>>: you can redistribute it and/or modify it<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the
<<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either<<endOptional>> version <<var;name=number;match=1-1>>"""
_LGPL = """under the <<beginOptional>>terms of the<<endOptional>> GNU Lesser General Public License"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."""
_SPDX = "SPDX-License-Identifier: "

#: Labels that the method adds.
METHOD = (
    Template("mit", _MIT), Template("mit", "<<beginOptional>>Released<<endOptional>> <<beginOptional>>Licensed<<endOptional>> <<beginOptional>>Distributed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    Template("mit", _SPDX + "MIT"), Template("isc", _ISC), Template("isc", _SPDX + "ISC"),
    Template("bsd-2", _BSD), Template("bsd-3", _BSD_3), Template("bsd-2", _SPDX + "BSD-2-Clause"), Template("bsd-3", _SPDX + "BSD-3-Clause"),
    Template("apache-2", _APACHE), Template("apache-2", "Licensed under the Apache License, Version 2.0"), Template("apache-2", _SPDX + "Apache-2.0"),
    Template("gpl", _GPL), Template("gpl", _SPDX + "GPL-<<var;name=number;match=1-3>>"), Template("lgpl", _LGPL), Template("lgpl", _SPDX + "LGPL-<<var;name=number;match=1-3>>"),
    Template("mpl-2", _MPL), Template("mpl-2", _SPDX + "MPL-2.0"),
    Template("cc-by-nc", "Licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC <<var;name=version;match=1-2>>"),
    Template("cc-by-nc", "Creative Commons Attribution-NonCommercial <<var;name=version;match=0-2>> <<beginOptional>>International<<endOptional>> License"),
    Template("cc-by", "Creative Commons Attribution <<var;name=version;match=0-2>> <<beginOptional>>International<<endOptional>> License"),
)

#: Words are runs of letters, digits and everything outside ASCII; A-Z read as a-z.
_PLAIN = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_MARK = re.compile(r"<<\s*(beginOptional|endOptional|var)\s*([^>]*)>>")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


class Automaton:
    """All templates as one automaton over word numbers; number 0 is any word that no template has.

    A state of the non-deterministic form is a place in a template. Sets of places become numbered states when a text first
    leads there, so that a table look-up per word does for all later runs.
    """

    ANY = -1

    def __init__(self, templates: Sequence[Template]):
        self.templates = list(templates)
        self.numbers: dict[bytes, int] = {}
        self.edges: list[list[tuple[int, int]]] = []  # of a place: (word number or ANY, next place)
        self.skips: list[list[int]] = []
        self.ends: dict[int, int] = {}  # last place -> template
        firsts = [self._compile(k, t) for k, t in enumerate(self.templates)]
        self.sets: dict[frozenset, int] = {}
        self.places: list[frozenset] = []
        self.accepts: list[list[int]] = []
        self.table = np.empty((0, len(self.numbers) + 1), np.int32)
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed(firsts))
        self.pairs = self._first_pairs()

    def _place(self) -> int:
        self.edges.append([])
        self.skips.append([])
        return len(self.edges) - 1

    def _compile(self, k: int, template: Template) -> int:
        first = at = self._place()
        open_, pos = [], 0

        def wording(part: str, at: int) -> int:
            for w in words_of(part.encode()):
                nxt = self._place()
                self.edges[at].append((self.numbers.setdefault(w, len(self.numbers) + 1), nxt))
                at = nxt
            return at

        for m in _MARK.finditer(template.text):
            at = wording(template.text[pos:m.start()], at)
            pos = m.end()
            if m[1] == "beginOptional":
                open_.append(at)
            elif m[1] == "endOptional":
                if not open_:
                    raise ValueError(f"endOptional without beginOptional in a template of {template.label}")
                nxt = self._place()
                self.skips[at].append(nxt)
                self.skips[open_.pop()].append(nxt)
                at = nxt
            else:
                span = re.search(r"match\s*=\s*(\d+)-(\d+)", m[2])
                if not span or int(span[1]) > int(span[2]):
                    raise ValueError(f"var without match=A-B in a template of {template.label}")
                end = self._place()
                for n in range(int(span[2]) + 1):
                    if n >= int(span[1]):
                        self.skips[at].append(end)
                    if n < int(span[2]):
                        nxt = self._place()
                        self.edges[at].append((self.ANY, nxt))
                        at = nxt
                at = end
        if open_:
            raise ValueError(f"beginOptional without endOptional in a template of {template.label}")
        at = wording(template.text[pos:], at)
        self.ends[at] = k
        if at in self._closed([first]):
            raise ValueError(f"a template of {template.label} has no mandatory wording")
        return first

    def _closed(self, places) -> frozenset:
        seen, todo = set(places), list(places)
        while todo:
            for p in self.skips[todo.pop()]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return frozenset(seen)

    def _state(self, places: frozenset) -> int:
        if places not in self.sets:
            self.sets[places] = len(self.places)
            self.places.append(places)
            self.accepts.append(sorted(self.ends[p] for p in places if p in self.ends))
            if len(self.places) > len(self.table):
                self.table = np.concatenate([self.table, np.full((max(256, len(self.table)), self.table.shape[1]), -1, np.int32)])
            self.final = np.array([bool(a) for a in self.accepts])
        return self.sets[places]

    def _next(self, state: int, word: int) -> int:
        to = self.table[state, word]
        if to < 0:
            to = self._state(self._closed({nxt for p in self.places[state] for w, nxt in self.edges[p] if w in (word, self.ANY)}))
            self.table[state, word] = to
        return int(to)

    def _first_pairs(self) -> np.ndarray:
        """Which two words can begin a run that lives: [word, next word]. A run that ends before its second word may go on with any."""
        n = self.table.shape[1]
        out = np.zeros((n, n), bool)
        for a in range(n):
            s = self._next(self.start, a)
            if s != self.dead:
                out[a] = True if self.accepts[s] else [self._next(s, b) != self.dead for b in range(n)]
        return out

    def run(self, numbers: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (exclusive) and template of every accepted wording. ``numbers`` are the words of texts in a row, `owner` their texts."""
        n = len(numbers)
        if not n:
            return (np.empty(0, np.int64),) * 3
        following = np.append(numbers[1:], 0)
        at = np.flatnonzero(self.pairs[numbers, following])
        state = np.full(len(at), self.start, np.int32)
        ends, found = at.copy(), []
        while len(at):
            word = numbers[ends]
            to = self.table[state, word]
            for s, w in np.unique(np.column_stack([state, word])[to < 0], axis=0):
                self._next(int(s), int(w))
            state = self.table[state, word]
            ends = ends + 1
            hit = self.final[state]
            for i in np.flatnonzero(hit):
                found += [(at[i], ends[i], k) for k in self.accepts[state[i]]]
            go = (state != self.dead) & (ends < n)
            go[go] = owner[ends[go]] == owner[at[go]]
            at, ends, state = at[go], ends[go], state[go]
        out = np.array(found, np.int64).reshape(-1, 3)
        return out[:, 0], out[:, 1], out[:, 2]

    def mandatory(self) -> list[int]:
        """Words of each template outside optional and replaceable regions."""
        out = []
        for t in self.templates:
            depth = count = pos = 0
            for m in chain(_MARK.finditer(t.text), [None]):
                part = t.text[pos:m.start() if m else len(t.text)]
                count += len(words_of(part.encode())) if depth == 0 else 0
                if m:
                    pos = m.end()
                    depth += {"beginOptional": 1, "endOptional": -1}.get(m[1], 0)
            out.append(count)
        return out


SPAN = pa.struct([("kind", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find(docs: DataFrame, templates: Sequence[Template] = (*BASE, *METHOD), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, n_words, spans (kind, label, start, end in words, end exclusive), score.

    Words are runs of a-z, A-Z, 0-9 and of characters outside ASCII; A-Z are lower-cased. Spans stand in the order of start, end, kind
    and label; a wording with several possible ends gives one span for each, and overlapping ones all count. ``score`` is 0 without a
    span, else 1 - 2 ** -m for the most mandatory words m of an accepted template.

    Null and empty texts have no words and no spans. Very long texts are read whole, about 2 MB of text at once otherwise. Every row
    keeps its id as it is, also null or repeated. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    templates = [Template(*t) for t in templates]
    Automaton(templates)  # a faulty template is an error here, not in a task
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates)
        known = automaton.numbers.get
        weight = [1 - 2.0 ** -m for m in automaton.mandatory()]
        for b in batches:
            ids = b.column(0)
            for lo, hi, texts in byte_slices(b.column(1).to_pylist()):
                words = [words_of(t) for t in texts]
                counts = np.fromiter(map(len, words), np.int64, len(words))
                numbers = np.fromiter((known(w, 0) for w in chain.from_iterable(words)), np.int64, int(counts.sum()))
                owner = np.repeat(np.arange(len(words)), counts)
                starts, ends, which = automaton.run(numbers, owner)
                first = np.cumsum(counts) - counts
                spans, score = [[] for _ in words], [0.0] * len(words)
                for s, e, k in zip(starts.tolist(), ends.tolist(), which.tolist()):
                    i, t = int(owner[s]), automaton.templates[k]
                    spans[i].append({"kind": t.kind, "label": t.label, "start": s - int(first[i]), "end": e - int(first[i])})
                    score[i] = max(score[i], weight[k])
                for own in spans:
                    own.sort(key=lambda x: (x["start"], x["end"], x["kind"], x["label"]))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(counts), pa.array(spans, pa.list_(SPAN)), pa.array(score)], ["_id", "n_words", "spans", "score"])

    found = rows.mapInArrow(released(scan), f"_id {kind}, n_words bigint, spans array<struct<kind:string,label:string,start:bigint,end:bigint>>, score double")
    return found.withColumnRenamed("_id", id_col)


def label_list(spans: Column) -> Column:
    """Distinct labels in order, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
