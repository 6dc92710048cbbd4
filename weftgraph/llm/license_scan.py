"""License scans by patience alignment of texts with license templates.

Words that are unique both in the text and in the template are anchors; the longest increasing subsequence of their places is
matched, and the gaps between are aligned in the same way. The share of the template's words that are matched is its coverage.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.textkernel import blocks, words

MIN_COVERAGE, STRETCH, PAD = 0.8, 1.25, 3

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

#: (license, template); several templates may stand for one license.
TEMPLATES = [
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD", _BSD),
    ("ISC", _ISC),
    ("MPL-2.0", _MPL),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (i, j) of two word lists, both increasing."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        times, own = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if own[w] == 1 and times[w] == 1}
        anchors = [(i, where[a[i]]) for i in range(a0, a1) if a[i] in where]
        if not anchors:
            continue
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(anchors)
        for n, (_, j) in enumerate(anchors):
            at = bisect_left(tails, j)
            back[n] = ends[at - 1] if at else -1
            tails[at : at + 1] = [j]
            ends[at : at + 1] = [n]
        chain, n = [], ends[-1]
        while n >= 0:
            chain.append(anchors[n])
            n = back[n]
        chain.reverse()
        found += chain
        before = (a0 - 1, b0 - 1)
        for here in [*chain, (a1, b1)]:
            todo.append((before[0] + 1, here[0], before[1] + 1, here[1]))
            before = here
    return sorted(found)


class Template(NamedTuple):
    """A license's words as hashes, and the least number of them that has to be matched."""

    license: str
    words: list[int]
    needed: int


def compile_templates(templates: list[tuple[str, str]], min_coverage: float) -> list[Template]:
    """Templates as word hashes; one without any word is left out."""
    found = []
    for name, text in templates:
        block = next(blocks(pa.array([text])))
        own = words(block).hash.tolist()
        if own:
            found.append(Template(name, own, max(1, int(np.ceil(min_coverage * len(own) - 1e-9)))))
    return found


def regions(place: list[int], word: list[int], template: Template, n_words: int) -> list[tuple[int, int]]:
    """Parts of a text that can hold a copy of the template, by word numbers; no copy of enough coverage is missed.

    At most len - needed template words may be missing from a copy, so it holds at least one of any len - needed + 1 of
    them; those are chosen that are rarest in the text. Each occurrence tells where a copy would begin; near ones are one.
    """
    own = Counter(template.words)
    times = Counter(word)
    chosen: set[int] = set()
    left = len(template.words) - template.needed + 1
    for w in sorted(own, key=lambda x: (times[x], x)):
        chosen.add(w)
        left -= own[w]
        if left <= 0:
            break
    at = defaultdict(list)
    for j, w in enumerate(template.words):
        if w in chosen:
            at[w].append(j)
    starts = sorted({p - j for p, w in zip(place, word) if w in chosen for j in at[w]})
    size, near = len(template.words), max(2, len(template.words) // 4)
    spans: list[list[int]] = []
    for s in starts:
        if spans and s - spans[-1][1] <= near:
            spans[-1][1] = s
        else:
            spans.append([s, s])
    return [(max(0, a - PAD), min(n_words, b + int(size * STRETCH) + PAD)) for a, b in spans]


def scan_words(place: list[int], word: list[int], n_words: int, template: Template) -> tuple[int, int, int, int] | None:
    """Best copy of a template in a text: (matched, first word, last word, number of copies), or None.

    `place` and `word` list the words of the text that occur in the template, and where they stand.
    """
    best, copies, end = None, 0, -1
    for a, b in regions(place, word, template, n_words):
        i, j = bisect_left(place, a), bisect_left(place, b)
        if j - i < template.needed:
            continue
        pairs = patience(word[i:j], template.words)
        if len(pairs) >= template.needed:
            first, last = place[i + pairs[0][0]], place[i + pairs[-1][0]]
            if last - first + 1 > 2 * len(template.words) + PAD:
                continue
            if first > end:
                copies, end = copies + 1, last
            if best is None or len(pairs) > best[0]:
                best = (len(pairs), first, last)
    return best and (*best, copies)


def _scan(templates: list[Template]):
    vocabulary = np.unique(np.concatenate([np.array(t.words, np.uint64) for t in templates])) if templates else np.zeros(0, np.uint64)
    count = np.zeros((len(templates), len(vocabulary)))
    for t, template in enumerate(templates):
        np.add.at(count[t], np.searchsorted(vocabulary, np.array(template.words, np.uint64)), 1)
    needed = np.array([t.needed for t in templates])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for b in blocks(batch.column(1)):
                n = len(b.offsets) - 1
                w = words(b)
                at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == w.hash) if len(vocabulary) else np.zeros(0, int)
                number, row = at[hit], w.row[hit]
                there = np.zeros((n, len(vocabulary)), np.float32)
                there[row, number] = 1
                # a text can't match more words of a template than those that it has at all
                rows, which = np.nonzero(there @ count.T.astype(np.float32) >= needed)
                heads = np.searchsorted(w.row, np.arange(n + 1))
                cut = np.searchsorted(row, np.arange(n + 1))
                for r, t in zip(rows.tolist(), which.tolist()):
                    own = slice(cut[r], cut[r + 1])
                    use = count[t][number[own]] > 0
                    place = (hit[own][use] - heads[r]).tolist()
                    found = scan_words(place, w.hash[hit[own][use]].tolist(), int(heads[r + 1] - heads[r]), templates[t])
                    if found:
                        size = len(templates[t].words)
                        out.append((batch.column(0)[b.first + r].as_py(), templates[t].license, found[0] / size, found[0], size, *found[1:]))
            columns = list(zip(*out)) if out else [[]] * 8
            types = (pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "license", "coverage", "matched", "template_words", "first_word", "last_word", "copies"])

    return run


def scan_licenses(docs: DataFrame, *, templates: list[tuple[str, str]] = TEMPLATES, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses found in each text: (doc_id, license, coverage, matched, template_words, first_word, last_word, copies).

    A row for each template of which one copy, in one place of the text, has at least `min_coverage` of the words matched;
    copies counts such places, the other columns tell of the best one, the first of equals. Words are numbered from 0. A
    license with several templates may have several rows.

    Null and empty texts have none; a null id stays null; repeated rows are scanned each; texts of any length are scanned whole.
    Other columns are not read; an empty table gives an empty result.
    """
    found = _scan(compile_templates(templates, min_coverage))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        found, "doc_id long, license string, coverage double, matched long, template_words long, first_word long, last_word long, copies long"
    )
