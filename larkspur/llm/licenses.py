"""Licence scan: text passages against licence templates by the Dice coefficient of word bigrams.

Words are runs of digits, lower-case letters and characters beyond ASCII, after A-Z are lowered. A
passage is a line, a paragraph of several lines, a whole text, or any other run of lines, so a licence
of several paragraphs is found within a longer text. Lines without words don't count. With t the least
coefficient, a passage of n bigrams can only match templates of between n * t / (2 - t) and
n * (2 - t) / t bigrams; other templates are not compared. A match also needs n * t / (2 - t) of the
passage's bigrams to be in templates at all; passages that have fewer, and lines from which every run
has fewer, are ruled out for whole blocks of rows at once. From a line that is left, the coefficients
of all runs with all templates come from one pass over the words that the largest template allows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import batch
from larkspur.llm.vectors import ALNUM, Block, blocks, mix, word_hashes

LEAST = 0.75

_ROWS = "doc_id long,n_matches long,license string,dice double,licenses string"

# Public licence notices and short licence texts, by SPDX identifier.
NOTICES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("LicenseRef-proprietary", "All rights reserved."),
]
#: Whole licences, which lie beside this module; a file is named by its SPDX identifier.
TEXTS = [(x.name.removesuffix(".txt"), x.read_text()) for x in sorted(files("larkspur.llm").joinpath("licence_texts").iterdir(), key=lambda x: x.name)]
TEMPLATES = NOTICES + TEXTS


def dice(a: Counter, b: Counter) -> float:
    """2 |A and B| / (|A| + |B|) of bags of bigrams."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


def _bigrams(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * np.uint64(3) + mix(hashes[1:])) if len(hashes) > 1 else np.zeros(0, np.uint64)


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], least: float):
        self.least, self.templates = least, []
        for name, text in templates:
            data = np.frombuffer(text.encode(), np.uint8)
            self.templates.append((name, Counter(_bigrams(word_hashes(data, np.array([0, len(data)]), ALNUM)[1]).tolist())))
        self.templates.sort(key=lambda x: x[1].total())
        self.sizes = [x[1].total() for x in self.templates]
        self.known = np.unique(np.array([b for _, bag in self.templates for b in bag], np.uint64))
        by_name = sorted(self.templates, key=lambda x: x[0])
        self.names = np.array([name for name, _ in by_name])
        self.totals = np.array([bag.total() for _, bag in by_name])[:, None]
        # How often each template has each known bigram; the last column is for all other bigrams.
        self.counts = np.array([[*(bag[b] for b in self.known.tolist()), 0] for _, bag in by_name])

    def match(self, grams: np.ndarray) -> tuple[float, str] | None:
        """The best template for a passage's bigrams, if it is good enough; of equals the first by name."""
        n, t = len(grams), self.least
        lo, hi = np.searchsorted(self.sizes, [n * t / (2 - t) - 1e-9, n * (2 - t) / t + 1e-9])
        if lo == hi:
            return None
        bag = Counter(grams.tolist())
        best = min(((-dice(bag, b), name) for name, b in self.templates[lo:hi]), default=(0.0, ""))
        return (-best[0], best[1]) if -best[0] >= t else None

    def _runs(self, kinds: np.ndarray, known: np.ndarray, begins: np.ndarray, ends: np.ndarray, last: np.ndarray) -> Iterator[tuple[float, str, int, int]]:
        """From each line, the best run of two lines or more for each licence; of equals the shortest. `last` is the last line of each line's row."""
        share = self.least / (2 - self.least)
        hi = np.minimum(last, np.searchsorted(ends, begins + 2 + int(self.sizes[-1] / share + 1e-9), "left") - 1)
        lines = np.flatnonzero(hi > np.arange(len(begins)))
        if not len(lines):
            return
        # A run can only match if known bigrams less share * bigrams don't fall from its begin to its end.
        at_begin, at_end = known[begins] - share * begins, known[ends - 1] - share * (ends - 1)
        n = hi[lines] - lines
        level, most = np.frexp(n)[1] - 1, np.full(len(lines), -np.inf)
        highest = at_end  # of each line and the 2**k - 1 after it
        for k in range(int(level.max()) + 1):
            some = level == k
            most[some] = np.maximum(highest[lines[some] + 1], highest[hi[lines[some]] - (1 << k) + 1])
            highest = np.maximum(highest, np.append(highest[1 << k :], np.full(min(1 << k, len(highest)), -np.inf)))
        for i in lines[most >= at_begin[lines] - 1e-6].tolist():
            p, q = int(begins[i]), ends[i + 1 : hi[i] + 1]
            some = kinds[p : q[-1] - 1]
            order = np.argsort(some, kind="stable")
            steps = np.arange(len(some))
            rank = np.empty(len(some), np.int64)  # earlier bigrams of the run that equal it
            rank[order] = steps - np.maximum.accumulate(np.where(np.diff(some[order], prepend=-1) != 0, steps, 0))
            common = np.cumsum(self.counts[:, some] > rank, axis=1)
            n = q - 1 - p
            values = 2 * common[:, n - 1] / (n + self.totals)
            best = np.argmax(values, axis=0)
            value = values[best, np.arange(len(n))]
            names = self.names[best]
            for name in np.unique(names[value >= self.least]):
                k = int(np.argmax(np.where(names == name, value, 0)))
                yield float(value[k]), str(name), p, int(q[k])

    def rows(self, block: Block) -> list[list[tuple[float, str]]]:
        """For each row the matches of its passages: lines, paragraphs of several lines, the whole text, runs of lines."""
        w, hashes = word_hashes(block.data, block.offsets, ALNUM)
        out: list[list[tuple[float, str]]] = [[] for _ in range(block.hi - block.lo)]
        if len(w.starts) < 2:
            return out
        grams = _bigrams(hashes)
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        kinds = np.where(self.known[at] == grams, at, len(self.known))
        known = np.concatenate([[0], np.cumsum(kinds < len(self.known))])  # bigram k joins words k and k + 1
        newlines = np.concatenate([[0], np.cumsum(block.data == 10)])
        between = np.zeros(len(w.starts), np.int64)  # newlines in front of each word
        between[1:] = newlines[w.starts[1:]] - newlines[w.ends[:-1]]
        between[w.first[:-1][w.first[:-1] < len(between)]] = 1 << 40
        passages: set[tuple[int, int]] = set()
        share = self.least / (2 - self.least)
        for gap in (1, 2, 1 << 40):
            begins = np.flatnonzero(between >= gap)
            ends = np.append(begins[1:], len(between))
            n = ends - begins - 1
            # With n bigrams, at least share * n of them are in the template, which has share * n at least.
            possible = (n > 0) & (n >= share * self.sizes[0]) & (share * n <= self.sizes[-1]) & (known[np.maximum(ends - 1, 0)] - known[begins] >= share * n - 1e-9)
            passages.update(zip(begins[possible].tolist(), ends[possible].tolist(), strict=True))
        found = [(*x, p, q, False) for p, q in sorted(passages) if (x := self.match(grams[p : q - 1]))]
        begins = np.flatnonzero(between)
        ends = np.append(begins[1:], len(between))
        last = np.searchsorted(begins, w.first[np.searchsorted(w.first, begins, "right")]) - 1
        found += [(*x, True) for x in self._runs(kinds, known, begins, ends, last) if x[2:] not in passages]
        # A run counts if it overlaps no match of its licence that is as good.
        taken: dict[str, np.ndarray] = {}
        for d, name, p, q, run in sorted(found, key=lambda x: (-x[0], x[4], x[2], x[3])):
            words_taken = taken.setdefault(name, np.zeros(len(between), bool))
            if not (run and words_taken[p:q].any()):
                out[int(np.searchsorted(w.first, p, "right")) - 1].append((d, name))
                words_taken[p:q] = True
        return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per document: how many passages match a licence, the best match and its coefficient, and all licences found.

    Of runs of lines, other than paragraphs and the whole text, only the best from each line for each licence counts, and
    only if it overlaps no other match of that licence that is as good; one more or less line makes no further match.
    Of passages with equal coefficients the first by name is the best match; of equal runs of a licence the shortest, then
    the first, counts. Without a match, as for null and empty texts, license is null, dice is 0 and licenses is empty.
    Texts are read whole, however long. Repeated rows repeat, a null doc_id stays null, an empty table gives no row, other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for b in batches:
            names = b.column(0).to_pylist()
            for x in blocks(b.column(1)):
                found = scanner.rows(x)
                best = [min(((-d, n) for d, n in f), default=(0.0, None)) for f in found]
                yield batch(_ROWS, doc_id=names[x.lo : x.hi], n_matches=[len(f) for f in found], license=[n for _, n in best], dice=[abs(d) for d, _ in best], licenses=[",".join(sorted({n for _, n in f})) for f in found])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _ROWS)
