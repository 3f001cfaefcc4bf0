"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Templates are the whole wordings of licences and their usual notices and headers. A document's units are its sentences, lines,
paragraphs and its whole text, and beside them any window of consecutive words, across lines and paragraphs: for each template the
windows that begin and end with one of its bigrams, within the size bounds below. A window is left out if it overlaps a match of its
template of no lower Dice, or another template's at least as long, that is found already, the highest Dice first; it replaces its
template's weaker units that it overlaps.

A part with n distinct bigrams can reach Dice t with a template of m only if m t / (2 - t) <= n <= m (2 - t) / t, and only if it
shares m t / (2 - t) of the template's. A document with fewer of them in all has no match with the template, which leaves
few templates for few documents; the bounds on n cut the rest.

Null texts count as empty. A unit of fewer than two words matches nothing. Ties go to the template first in code point order
of its name. Rows are taken one by one, so repeated rows repeat; ids are carried as they are, and extra columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import importlib.resources
import itertools
import re
from collections import Counter, OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_batches, type_of

THRESHOLD = 0.8

# The usual notices and headers of licences.
NOTICES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    "BSD-3-Clause clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.""",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MIT notice": "Released under the MIT License.",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense notice": "This is free and unencumbered software released into the public domain.",
}

#: Whole licences, a file of that name each in licence_texts.
FULL_TEXTS = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")

_words = re.compile(r"[^\W_]+")
_stop = re.compile(r"[.!?]\s")
_sentence = re.compile(r".+?(?:[.!?](?=\s)|$)\s*", re.S)


def normalised(text: str) -> list[str]:
    """Words in lower case, without punctuation and mark-up."""
    return _words.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def units(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of sentences, lines of several sentences, paragraphs of several lines, and a text of several paragraphs."""
    at, paragraph, paragraphs = 0, [], []
    for line in [*text.split("\n"), ""]:
        words, n = [], 0
        if line.strip():
            for m in _sentence.finditer(line) if _stop.search(line) else [None]:
                own = normalised(line if m is None else m[0])
                words += own
                n += 1
                yield (at, at + len(line), own) if m is None else (at + m.start(), at + m.start() + len(m[0].rstrip()), own)
            if n > 1:
                yield at, at + len(line), words
            paragraph.append((at, at + len(line), words))
        elif paragraph:
            parts = [w for p in paragraph for w in p[2]]
            if len(paragraph) > 1:
                yield paragraph[0][0], paragraph[-1][1], parts
            paragraphs.append((paragraph[0][0], paragraph[-1][1], parts))
            paragraph = []
        at += len(line) + 1
    if len(paragraphs) > 1:
        yield 0, len(text), [w for p in paragraphs for w in p[2]]


@functools.cache
def known_templates() -> dict[str, str]:
    """Name -> wording of every notice, header and whole licence."""
    texts = importlib.resources.files("tessera.llm") / "licence_texts"
    return NOTICES | {name: (texts / f"{name}.txt").read_text(encoding="utf-8") for name in FULL_TEXTS}


class Found:
    """Matches (start, end, name, dice) of a text, with a grid of cells in which to look for those that overlap."""

    CELL = 256

    def __init__(self):
        self.matches: list[tuple | None] = []
        self.cells: dict[int, list[int]] = {}

    def add(self, match: tuple) -> None:
        for c in range(match[0] // self.CELL, match[1] // self.CELL + 1):
            self.cells.setdefault(c, []).append(len(self.matches))
        self.matches.append(match)

    def over(self, start: int, end: int) -> list[int]:
        near = {i for c in range(start // self.CELL, end // self.CELL + 1) for i in self.cells.get(c, ())}
        return [i for i in near if (m := self.matches[i]) and start < m[1] and m[0] < end]


class Templates:
    def __init__(self, texts: dict[str, str], threshold: float):
        self.threshold = threshold
        self.sets = sorted(((name, bigrams(normalised(t))) for name, t in texts.items()), key=lambda x: (len(x[1]), x[0]))
        #: bigram -> places in sets of the templates that have it
        self.holders: dict[tuple[str, str], list[int]] = {}
        for k, (_, b) in enumerate(self.sets):
            for pair in b:
                self.holders.setdefault(pair, []).append(k)
        #: A match with a template of m bigrams shares at least m t / (2 - t) of them.
        self.least = [len(b) * threshold / (2 - threshold) - 1e-9 for _, b in self.sets]

    def candidates(self, words: list[str]) -> list[int]:
        """Templates of which the text as a whole has enough bigrams for any part of it to match."""
        shared = Counter(k for pair in bigrams(words) & self.holders.keys() for k in self.holders[pair])
        return [k for k in sorted(shared) if shared[k] >= self.least[k]]

    def best(self, words: list[str], among: list[int] | None = None) -> tuple[str, float] | None:
        """The template of the highest Dice with all these words; among: places of templates, by size."""
        among = range(len(self.sets)) if among is None else among
        own, t, found = bigrams(words), self.threshold, None
        first = bisect.bisect_left(among, len(own) * t / (2 - t) - 1e-9, key=lambda k: len(self.sets[k][1]))
        for k in among[first : bisect.bisect_right(among, len(own) * (2 - t) / t + 1e-9, key=lambda k: len(self.sets[k][1]))]:
            name, b = self.sets[k]
            if (d := dice(own, b)) >= t and (found is None or (-d, name) < (-found[1], found[0])):
                found = name, d
        return found

    def windows(self, text: str, among: list[int]) -> list[tuple[int, int, str, float]]:
        """For each template the best window from each place where one begins.

        From the last word to the first, the bigrams are kept in the order in which they come next: those of the window from a
        place on, each once, are the first ones, however often any of them is repeated.
        """
        places = [(m.start(), m.end(), w) for m in _words.finditer(text) for w in normalised(m[0])]
        pairs = list(zip((p[2] for p in places), (p[2] for p in places[1:]), strict=False))
        sought = [(name, b, int(len(b) * (2 - self.threshold) / self.threshold + 1e-9)) for name, b in (self.sets[k] for k in among)]
        following: OrderedDict[tuple[str, str], int] = OrderedDict()
        found = []
        for i in range(len(pairs) - 1, -1, -1):
            following[pairs[i]] = i
            following.move_to_end(pairs[i], last=False)
            for name, b, most in sought:
                if pairs[i] in b:
                    shared, best = 0, None
                    for n, (pair, at) in enumerate(itertools.islice(following.items(), most), 1):
                        if pair in b:
                            shared += 1
                            d = 2 * shared / (n + len(b))
                            if d >= self.threshold and (best is None or d > best[1]):
                                best = at, d
                    if best:
                        found.append((places[i][0], places[best[0] + 1][1], name, best[1]))
        return found

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        among = self.candidates(normalised(text))
        if not among:
            return []
        own = Found()
        for start, end, words in units(text):
            if hit := self.best(words, among):
                own.add((start, end, *hit))
        n_units = len(own.matches)
        for a, b, name, d in sorted(self.windows(text, among), key=lambda x: (-x[3], x[0] - x[1], x[2], x[0])):
            over = own.over(a, b)
            if not any(h[3] >= d if h[2] == name else h[1] - h[0] >= b - a for h in (own.matches[i] for i in over)):
                for i in over:
                    if i < n_units and own.matches[i][2] == name:
                        own.matches[i] = None
                own.add((a, b, name, d))
        return [m for m in own.matches[:n_units] if m] + sorted(own.matches[n_units:])


def scan_licences(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, licence, dice, n_matches, matches): the best match, and all as name:start:end:dice in code points, joined by `; `."""
    texts = known_templates() if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(texts, threshold)
        for batch in batches:
            found = [known.scan(t or "") for t in batch.column("text").to_pylist()]
            best = [min(f, key=lambda x: (-x[3], x[2])) if f else (None, None, None, None) for f in found]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([b[2] for b in best], pa.string()), pa.array([b[3] for b in best], pa.float64()), pa.array([len(f) for f in found], pa.int64()),
                pa.array(["; ".join(f"{name}:{a}:{b}:{d:.6f}" for a, b, name, d in f) for f in found], pa.string()),
            ], ["id", "licence", "dice", "n_matches", "matches"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return rows.mapInArrow(scan, f"id {type_of(docs, id_column)}, licence string, dice double, n_matches long, matches string").withColumnRenamed("id", id_column)
