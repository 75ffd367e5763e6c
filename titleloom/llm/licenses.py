"""License scans by patience alignment.

A template and a stretch of text are aligned on the words that are unique in both: the
longest increasing run of their places is the backbone, and the gaps between backbone
words are aligned the same way, their own unique words now counting. Coverage is the share
of the template's words that are aligned.

A long text is not aligned as a whole, where every common word repeats. Places of a
template's telling words (those not among the common ones) mark the stretches
that may hold it, with room for insertions. A notice of the least coverage lacks so many words
at most, so it holds one of any telling words that are one more: stretches are taken around every
occurrence of that many, the rarest of the text, at each of their places in the template.
Stretches with too few words of the template are skipped. Where stray words spoil the patience
alignment of a stretch, its longest common subsequence decides, which no part of it exceeds. The
best-covered stretch counts, the earliest of equals.

Whole texts are scanned, in one pass without a shuffle.

Defined cases: NULL or empty text holds no notice; templates of equal coverage go to the one with
more words, then by name; repeated rows each get a row; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from titleloom.llm.common import slices, text_of

COVERAGE = 0.8  # least coverage of a found notice
SLACK = 8  # inserted words a stretch has room for on either side, besides half the template

# License notices as they are usually written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "All-rights-reserved": "All rights reserved",
}
# Words too common to mark a stretch.
COMMON = frozenset("a all and any are as at be by for in is it may not of on or that the this to under use version with work you 0 2 3 4".split())

_WORD = re.compile(r"[^\W_]+")


class Template(NamedTuple):
    name: str
    words: tuple[str, ...]
    telling: frozenset[str]
    place: dict[str, list[int]]  # places of each word


def compiled(templates: dict[str, str] = TEMPLATES, common: frozenset[str] = COMMON) -> list[Template]:
    out = []
    for name, text in templates.items():
        words = tuple(_WORD.findall(text.lower()))
        telling = frozenset(words) - common or frozenset(words)
        out.append(Template(name, words, telling, {w: [i for i, x in enumerate(words) if x == w] for w in words}))
    return out


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    on_top: list[int] = []  # index of the value on each pile
    below: list[int] = []
    for i, value in enumerate(values):
        pile = bisect.bisect_left(tops, value)
        below.append(on_top[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [value]
        on_top[pile : pile + 1] = [i]
    out, at = [], on_top[-1] if on_top else -1
    while at >= 0:
        out.append(at)
        at = below[at]
    return out[::-1]


def align(text: list[str], template: tuple[str, ...]) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of the patience alignment, increasing in both."""
    found: list[tuple[int, int]] = []
    open_gaps = [(0, len(text), 0, len(template))]
    while open_gaps:
        a, b, c, d = open_gaps.pop()
        # Equal words at either end need no anchor.
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        counts, others = Counter(text[a:b]), Counter(template[c:d])
        unique = {w for w, n in others.items() if n == 1 and counts.get(w) == 1}
        if not unique:
            continue
        at = {w: i for i, w in enumerate(text[a:b], a) if w in unique}
        places = [(at[w], j) for j, w in enumerate(template[c:d], c) if w in unique]
        spine = [places[i] for i in increasing([i for i, _ in places])]
        found.extend(spine)
        edges = [(a - 1, c - 1), *spine, (b, d)]
        open_gaps.extend((x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:]))
    return sorted(found)


class Notice(NamedTuple):
    name: str
    coverage: float
    first: int  # words of the text, from .. to
    last: int


def needed(template: Template, least: float) -> int:
    """Words a notice of the least coverage has."""
    return max(1, math.ceil(least * len(template.words) - 1e-9))


def marking(template: Template, least: float) -> frozenset[str]:
    """Words that mark stretches: the telling ones, or all where a notice might lack every telling one."""
    return template.telling if len(template.telling) > len(template.words) - needed(template, least) else frozenset(template.words)


def longest(text: list[str], template: Template) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence: the longest increasing run over all equal words."""
    equal = [(i, j) for i, w in enumerate(text) for j in reversed(template.place.get(w, ()))]
    return [equal[k] for k in increasing([j for _, j in equal])]


def best_notice(words: list[str], places: dict[str, list[int]], template: Template, least: float = COVERAGE, slack: int = SLACK) -> Notice | None:
    """The best-covered stretch for one template; ``places`` holds where its marking words stand."""
    size, need = len(template.words), needed(template, least)
    room = slack + size // 2
    cost = lambda w: (len(places.get(w, ())) * len(template.place[w]), template.place[w][0])
    chosen = sorted(marking(template, least), key=cost)[: size - need + 1]
    others = Counter(template.words)
    best: Notice | None = None
    for d in sorted({p - q for w in chosen for p in places.get(w, ()) for q in template.place[w]}):
        start = max(0, d - room)
        stretch = words[start : d + size + room]
        held = Counter(stretch)
        if sum(min(n, held[w]) for w, n in others.items()) < need:
            continue
        pairs = align(stretch, template.words)
        if len(pairs) < need:
            pairs = longest(stretch, template)
        coverage = len(pairs) / size
        if pairs and (best is None or coverage > best.coverage):
            best = Notice(template.name, coverage, start + pairs[0][0], start + pairs[-1][0])
        if best and best.coverage == 1:
            break
    return best


def notices(text: str, templates: list[Template], least: float = COVERAGE) -> list[Notice]:
    """Found notices, best first."""
    lowered = text.lower()
    marking_of = {t.name: marking(t, least) for t in templates}
    marks = {w for held in marking_of.values() for w in held}
    present = {w for w in marks if w in lowered}
    near = [t for t in templates if len(marking_of[t.name] - present) <= len(t.words) - needed(t, least)]
    if not near:
        return []
    words = _WORD.findall(lowered)
    wanted = {w for t in near for w in marking_of[t.name]}
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in wanted:
            places.setdefault(w, []).append(i)
    found = [n for t in near if (n := best_notice(words, places, t, least)) and n.coverage >= least]
    size = {t.name: len(t.words) for t in templates}
    return sorted(found, key=lambda n: (-n.coverage, -size[n.name], n.name))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = COVERAGE) -> DataFrame:
    """doc_id, n_notices (templates found), license, coverage, first_word, last_word (of the best; NULL without)."""
    held = compiled(templates)
    names = ["doc_id", "n_notices", "license", "coverage", "first_word", "last_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [notices(t, held, least) for t in part.column("text").to_pylist()]
                top = [f[0] if f else Notice(None, None, None, None) for f in found]
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64()]
                columns = [pa.array([t[i] for t in top], k) for i, k in enumerate(kinds)]
                count = pa.array([len(f) for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), count, *columns], names)

    slim = docs.select("doc_id", text_of().alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_notices bigint, license string, coverage double, first_word bigint, last_word bigint"
    return slim.mapInArrow(run, schema)
