"""License scans by patience alignment of texts with license templates.

An alignment anchors on the words that stand exactly once in both sides, keeps the longest
increasing subsequence of them, and does the same in each gap between anchors; where a gap has no
such word, equal words at its two ends are matched. Coverage is the share of a template's words
that are matched.

A word that is rare in a license can be frequent in a long document, and a document can hold a
license twice. So a template is aligned with stretches of the text, not with all of it: the
shortest ones that hold enough different words of the template, widened to its length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fieldtally.llm.common import texts
from fieldtally.llm.decontaminate import words

#: Share of a template's words that must be matched.
COVERAGE = 0.8
#: Well-known notices. Others are given as a parameter.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by piles of patience."""
    tops: list[int] = []
    places: list[int] = []
    before = [-1] * len(values)
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            places.append(i)
        else:
            tops[pile], places[pile] = value, i
        before[i] = places[pile - 1] if pile else -1
    found, i = [], places[-1] if places else -1
    while i >= 0:
        found.append(i)
        i = before[i]
    return found[::-1]


def aligned(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched places of two rows of words, increasing on both sides."""
    out: list[tuple[int, int]] = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if count_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if count_a[w] == 1 and w in place]
        chain = [anchors[i] for i in increasing([y for _, y in anchors])]
        if not chain:
            continue
        out += chain
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        waiting += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(out)


def stretches(places: list[tuple[int, bytes]], need: int, room: int) -> Iterator[tuple[int, int]]:
    """Shortest stretches, none inside the next, of ``room`` words at most that hold ``need`` different words.

    ``places`` are the numbers of the words that a template has, with the words, in order.
    """
    held: Counter = Counter()
    first = 0
    for last, (at, word) in enumerate(places):
        held[word] += 1
        while at - places[first][0] >= room:
            _drop(held, places[first][1])
            first += 1
        while held[places[first][1]] > 1:
            _drop(held, places[first][1])
            first += 1
        if len(held) >= need:
            yield places[first][0], at
            _drop(held, places[first][1])
            first += 1


def _drop(held: Counter, word: bytes) -> None:
    held[word] -= 1
    if not held[word]:
        del held[word]


class Templates:
    """Templates as rows of words."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.rows = {name: words(text) for name, text in sorted(templates.items()) if words(text)}
        self.sets = {name: set(row) for name, row in self.rows.items()}
        self.vocabulary = set().union(*self.sets.values())

    def scan(self, text: str | None, every: bool = False) -> list[tuple[str, float, int, int]]:
        """Name, coverage, first and last word, of each template found; the best place of each, the first of equals.

        With ``every``, all places that don't overlap, best first chosen, in their order.
        """
        own = words(text)
        known = [(i, w) for i, w in enumerate(own) if w in self.vocabulary]
        there = {w for _, w in known}
        found = []
        for name, row in self.rows.items():
            # so many of the template's words can go unmatched, and all of them may be different ones
            need = max(1, len(self.sets[name]) - int(len(row) * (1 - self.coverage) + 1e-9))
            if len(self.sets[name] & there) < need:
                continue
            there_too = []
            places = [(i, w) for i, w in known if w in self.sets[name]]
            for a, b in stretches(places, need, 2 * len(row)):
                pad = len(row)
                while True:  # narrower too: a word that stands twice in a wide stretch is no anchor
                    low = max(0, a - pad)
                    pairs = aligned(own[low : b + 1 + pad], row)
                    if len(pairs) >= self.coverage * len(row) - 1e-9:
                        there_too.append((-len(pairs), low + pairs[0][0], low + pairs[-1][0]))
                    if not pad or len(pairs) == len(row):
                        break
                    pad //= 2
            chosen = apart(there_too) if every else sorted(there_too, key=lambda x: x[:2])[:1]
            found += [(name, -n / len(row), first, last) for n, first, last in chosen]
        return found


def apart(places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of places as words matched, negative, first and last: the best, the shortest of equals, that don't overlap."""
    starts: list[int] = []
    chosen: list[tuple[int, int, int]] = []
    for n, first, last in sorted(set(places), key=lambda x: (x[0], x[2] - x[1], x[1])):
        at = bisect_left(starts, first)
        if (at == 0 or chosen[at - 1][2] < first) and (at == len(starts) or last < starts[at]):
            starts.insert(at, first)
            chosen.insert(at, (n, first, last))
    return chosen


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, every: bool = False) -> DataFrame:
    """``doc_id, licenses`` of every whole text: an array of ``name, coverage, first, last``.

    ``first`` and ``last`` are numbers of words, from 0. Words are compared after A-Z are
    lower-cased. Of a template that stands in a text several times, the place of best coverage is
    given, the first of equals; with ``every``, all places that reach the coverage and don't overlap.
    A null or empty text, and templates without words, give nothing; very long texts are scanned whole;
    repeated rows give repeated results, an empty table an empty one; other columns are not looked at. The templates go to all
    tasks with the code, so they are meant to be some hundreds, not a table.
    """
    kind = pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("first", pa.int32()), ("last", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("licenses", pa.list_(kind))])
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Templates(chosen, coverage)
        for batch in batches:
            found = [[dict(zip(("name", "coverage", "first", "last"), x)) for x in scanner.scan(t, every)] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, schema.types[1])], schema=schema)

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return rows.mapInArrow(run, "doc_id long, licenses array<struct<name:string,coverage:double,first:int,last:int>>")
