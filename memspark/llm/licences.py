"""Licence scans with a generalised suffix automaton over the words of licence templates.

The automaton holds every run of consecutive words of every template. A file's words stream through
it; at each word it tells, for every template, the longest run ending there that the template contains (the
matching statistics). Matches of at least ``least`` words that cannot be lengthened are placed in their
template and chained while they move forward in both texts with gaps of at most ``gap`` file words; of matches
that overlap only what is new counts, and each file word in a gap costs one. A chain's score is its words
less its gaps, as a share of the template. Chains of ``cover`` or more (of all, for templates of less than
``short`` words) are reported under their template's label, unless a better chain lies over most of them.
Fixed phrases are reported wherever their words stand consecutively, whatever the automaton says.

Defined cases: null and empty texts have no words: counts 0, no labels, score 0, null first and last word.
Very long texts are scanned whole; only runs of words that templates know are looked at twice. Repeated rows
are scanned each. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ASCII_LOWER, WORD, in_workers, picked, texts_of

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Template texts by label: usual notices, and short licences clause by clause. Public wording.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
        "Released under the MIT License",
        "Licensed under the MIT License",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
        "Licensed under the Apache License, Version 2.0",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU General Public License along with this program",
        "This work is licensed under the GNU General Public License, version 3",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU Affero General Public License along with this program",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
        "Licensed under the BSD License",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    ],
    "boost": ["Distributed under the Boost Software License, Version 1.0"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ],
}
#: The parts of the names of Creative Commons licences; their notices follow from these.
CC_PARTS = {"nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
for _terms in ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd")):
    _long, _short = "-".join(("Attribution", *(CC_PARTS[t] for t in _terms))), "-".join(("by", *_terms))
    TEMPLATES[f"cc-{_short}"] = [
        *(f"This work is licensed under a Creative Commons {_long} {v} License" for v in ("4.0 International", "3.0 Unported")),
        *(f"Licensed under CC {_short} {v}" for v in ("4.0", "3.0")),
    ]
_word = re.compile(WORD)


def words_of(text: str) -> list[str]:
    return _word.findall(text.translate(ASCII_LOWER))


class SuffixAutomaton:
    """Of several word sequences; a state keeps where one of its runs ends in each sequence that has it."""

    def __init__(self, sequences: list[list[int]]):
        self.go: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for s, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].setdefault(s, []).append(i)
        for v in sorted(range(1, len(self.size)), key=lambda v: -self.size[v]):
            for s, at in self.ends[v].items():
                own = self.ends[self.link[v]].setdefault(s, [])
                own += [x for x in at if x not in own]

    def _new(self, size: int, go: dict, link: int) -> int:
        self.go.append(go)
        self.size.append(size)
        self.link.append(link)
        self.ends.append({})
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._new(self.size[p] + 1, dict(self.go[q]), self.link[q])
        while p != -1 and self.go[p].get(c) == q:
            self.go[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.go[last]:
            return self._split(last, c, self.go[last][c])
        cur = self._new(self.size[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.go[p]:
            self.go[p][c] = cur
            p = self.link[p]
        if p != -1:
            self.link[cur] = self._split(p, c, self.go[p][c])
        return cur

    def matches(self, seq: list[int], least: int) -> dict[int, list[tuple[int, int, list[int]]]]:
        """By template: (start, length, places of the end in the template) of the matches with it, of least words or more, that cannot be lengthened to the right or the left."""
        out: dict[int, list[tuple[int, int, list[int]]]] = {}
        before: dict[int, tuple[int, list[int]]] = {}
        v, n = 0, 0
        for i, c in enumerate([*seq, -1]):
            while v != -1 and c not in self.go[v]:
                v = self.link[v]
                n = self.size[v] if v != -1 else 0
            v, n = (0, 0) if v == -1 else (self.go[v][c], n + 1)
            # the longest run of each template that ends here: states along the suffix links, longest first
            now: dict[int, tuple[int, list[int]]] = {}
            u, m = v, n
            while m >= least:
                for s, ends in self.ends[u].items():
                    if s not in now:
                        now[s] = (m, ends)
                u = self.link[u]
                m = self.size[u]
            for s, (m, ends) in before.items():
                if now.get(s, (0,))[0] != m + 1:
                    out.setdefault(s, []).append((i - m, m, ends))
            before = now
        return out


def best_chain(hits: list[tuple[int, int, int]], gap: int) -> tuple[int, int, int, int]:
    """(words less gap words, words, file start, file end) of the best chain of matches (file start, template start, length)."""
    hits = sorted(hits)
    chains: list[tuple[int, int, int]] = []  # (value, words, file start) of the best chain that ends with each hit
    best = (0, 0, 0, 0)
    for i, (at, place, n) in enumerate(hits):
        own = (n, n, at)
        for (a, p, m), (value, words, start) in zip(hits[:i], chains):
            between, over = at - (a + m), max(0, a + m - at, p + m - place)
            if between <= gap and at > a and place > p and over < n:
                own = max(own, (value + n - over - max(0, between + over), words + n - over, start))
        chains.append(own)
        best = max(best, (own[0], own[1], own[2], at + n))
    return best


class Scanner:
    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str], least: int, cover: float, gap: int, short: int):
        self.least, self.cover, self.gap, self.short = least, cover, gap, short
        self.ids: dict[str, int] = {}
        texts = [(label, words_of(t)) for label, ts in templates.items() for t in ts]
        self.labels = [label for label, _ in texts]
        self.sizes = [len(ws) for _, ws in texts]
        self.automaton = SuffixAutomaton([[self._id(w) for w in ws] for _, ws in texts])
        self.phrases = [([self._id(w) for w in p.split(" ")], label) for p, label in phrases.items()]

    def _id(self, w: str) -> int:
        return self.ids.setdefault(w, len(self.ids))

    def _spans(self, ids: np.ndarray) -> dict[str, float]:
        """The best score by label, of the chains that no better one lies over."""
        known = ids >= 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], known.astype(np.int8), [0]))))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= self.least:
                for s, hits in self.automaton.matches(ids[a:b].tolist(), self.least).items():
                    found.setdefault(s, []).extend((a + start, e + 1 - n, n) for start, n, ends in hits for e in ends)
        chains = []
        for s, hits in found.items():
            hits.sort()
            group: list[tuple[int, int, int]] = []
            reach = 0
            for h in [*hits, None]:
                # matches further apart than a gap are never in one chain
                if group and (h is None or h[0] - reach > self.gap):
                    value, words, start, end = best_chain(group, self.gap)
                    if value >= self.sizes[s] * (self.cover if self.sizes[s] >= self.short else 1):
                        chains.append((min(1.0, value / self.sizes[s]), words, start, end, self.labels[s]))
                    group = []
                if h:
                    reach = max(reach, h[0] + h[2]) if group else h[0] + h[2]
                    group.append(h)
        best: dict[str, float] = {}
        kept: list[tuple] = []
        for c in sorted(chains, key=lambda c: (-c[0], -c[1], c[2:])):
            better = (k for k in kept if k[:2] > c[:2] and k[4] != c[4] and 2 * (min(k[3], c[3]) - max(k[2], c[2])) > c[3] - c[2])
            if next(better, None) is None:
                kept.append(c)
                best[c[4]] = max(best.get(c[4], 0.0), c[0])
        return best

    def scan(self, text: str) -> tuple:
        get = self.ids.get
        words = words_of(text)
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        starts, base = [], set()
        for p, label in self.phrases:
            ok = np.ones(max(0, len(ids) - len(p) + 1), bool)
            for k, w in enumerate(p):
                ok &= ids[k : len(ids) - len(p) + 1 + k] == w
            at = np.flatnonzero(ok)
            if len(at):
                starts.append(at)
                base.add(label)
        spans = self._spans(ids)
        at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        first, last = (int(at.min()), int(at.max())) if len(at) else (None, None)
        score = max([*spans.values(), 1.0 if base else 0.0])
        return len(words), len(at), first, last, ",".join(sorted(base)), ",".join(sorted(base | spans.keys())), score


_scanner: dict = {}


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict | None = None, phrases: dict | None = None, least: int = 3, cover: float = 0.8, gap: int = 8, short: int = 10) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    least: words a match must have to be chained; cover: the score a chain must have; gap: file words that
    may lie between two chained matches; short: templates of fewer words must stand whole. score is the best
    of the reported chains, 1 where a fixed phrase stands.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    key = repr((templates, phrases, least, cover, gap, short))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scanner:
            _scanner[key] = Scanner(templates, phrases, least, cover, gap, short)
        scan = _scanner[key].scan
        for b in batches:
            rows = [scan(t) for t in texts_of(b.column(1))]
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = dict(df.dtypes)[id_col]
    return picked(df, **{id_col: id_col, "text_": text_col}).transform(in_workers, run, f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
