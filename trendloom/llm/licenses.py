"""License scans by template markup compiled to token automata.

A template is wording with `<<optional>> ... <<end>>` regions, which may be absent, and
`<<any N>>` regions, which stand for up to N words of any kind. It becomes an automaton over
words. A place matches where the automaton accepts; all wording outside the regions must be there
word for word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trendloom.llm.common import byte_set, ids_of, map_arrow, slices, utf8

# Phrases whose places are counted, and their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Wording of public licenses and notices, to the end of what they require.
TEMPLATES = (
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice <<optional>> (including the next paragraph) <<end>> shall be included "
        'in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Permission to use, copy, modify, <<optional>> and <<end>> <<optional>> or <<end>> distribute this software "
        "<<optional>> and its documentation <<end>> for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND '
        "<<any 12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
        "isc",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: <<any 3>> Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. <<any 3>> Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution. <<optional>> <<any 3>> Neither the name of <<any 12>> nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written "
        'permission. <<end>> THIS SOFTWARE IS PROVIDED BY <<any 12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
        "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
        "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "bsd",
    ),
    (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at <<any 1>> www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
        "apache-2",
    ),
    *(
        (
            f"free software <<any 1>> you can redistribute it and/or modify it under the terms of the GNU {kind} General Public "
            f"License as published by the Free Software Foundation <<optional>> either <<end>> version {version} of the License "
            "<<optional>> or (at your option) any later version <<end>> <<any 3>> is distributed in the hope that it will be "
            "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
            f"PURPOSE. See the GNU {kind} General Public License for more details.",
            label,
        )
        for kind, version, label in (
            ("", "3", "gpl-3"), ("", "2", "gpl-2"), ("Affero", "3", "agpl-3"),
            ("Lesser", "3", "lgpl-3"), ("Lesser", "2.1", "lgpl-2.1"), ("Library", "2", "lgpl-2"),
        )
    ),
    *(
        (
            f"licensed under the <<optional>> terms of the <<end>> GNU {kind} General Public License <<optional>> as published "
            f"by the Free Software Foundation <<end>> <<optional>> either <<end>> version {version}",
            label,
        )
        for kind, version, label in (
            ("", "3", "gpl-3"), ("", "2", "gpl-2"), ("Affero", "3", "agpl-3"),
            ("Lesser", "3", "lgpl-3"), ("Lesser", "2.1", "lgpl-2.1"), ("Library", "2", "lgpl-2"),
        )
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at <<any 1>> mozilla.org/MPL/2.0",
        "mpl-2",
    ),
    ("licensed under the Mozilla Public License <<optional>> v <<end>> <<optional>> version <<end>> 2.0", "mpl-2"),
    ("licensed under <<optional>> a <<end>> <<optional>> the <<end>> Creative Commons Attribution NonCommercial", "cc-by-nc"),
    ("released under the MIT license", "mit"),
    ("released into the public domain", "public-domain"),
)

#: Bytes that are no part of words; every byte from 0x80 belongs to a word.
NO_WORD = byte_set(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(optional|end|any (\d+))>>")


@dataclass(frozen=True)
class Automaton:
    """States 0 .. n; moves[s] = ((word, or None for any word), next state); skips[s]: next states without a word."""

    label: str
    moves: tuple[tuple[tuple[bytes | None, int], ...], ...]
    closure: tuple[frozenset[int], ...]
    depth: tuple[int, ...]
    accept: int
    mandatory: int
    first: bytes

    def run(self, found: list[bytes], at: int) -> tuple[bool, int]:
        """Whether it accepts words from at on, and the greatest count of mandatory words in place."""
        states, best = self.closure[0], 0
        for i in range(at, len(found) + 1):
            best = max(best, max(self.depth[s] for s in states))
            if self.accept in states:
                return True, self.mandatory
            if i == len(found):
                break
            word = found[i]
            states = frozenset().union(*(self.closure[t] for s in states for w, t in self.moves[s] if w is None or w == word))
            if not states:
                break
        return False, best


def compile_template(markup: str, label: str) -> Automaton:
    """The automaton of a template."""
    moves: list[list[tuple[bytes | None, int]]] = [[]]
    skips: list[set[int]] = [set()]
    depth, opened, first = [0], [], b""

    def step(word: bytes | None, counted: int) -> None:
        moves[-1].append((word, len(moves)))
        moves.append([])
        skips.append(set())
        depth.append(depth[-1] + counted)

    at = 0
    for mark in [*_MARK.finditer(markup), None]:
        for word in _WORD.findall(markup[at : mark.start() if mark else len(markup)].encode().lower()):
            first = first or (word if not opened else b"")
            step(word, 0 if opened else 1)
        if mark is None:
            break
        at = mark.end()
        if mark[1] == "optional":
            opened.append(len(moves) - 1)
        elif mark[1] == "end":
            skips[opened.pop()].add(len(moves) - 1)
        else:
            begin = len(moves) - 1
            for _ in range(int(mark[2])):
                step(None, 0)
            for s in range(begin, len(moves) - 1):
                skips[s].add(len(moves) - 1)
    closure = []
    for s in range(len(moves)):
        seen, todo = {s}, [s]
        while todo:
            new = skips[todo.pop()] - seen
            seen |= new
            todo += new
        closure.append(frozenset(seen))
    return Automaton(label, tuple(map(tuple, moves)), tuple(closure), tuple(depth), len(moves) - 1, depth[-1], first)


@cache
def automata() -> tuple[list[Automaton], dict[bytes, list[Automaton]]]:
    """Those of the base phrases, and those of the templates by their first word."""
    by_word: dict[bytes, list[Automaton]] = {}
    for markup, label in TEMPLATES:
        made = compile_template(markup, label)
        by_word.setdefault(made.first, []).append(made)
    return [compile_template(*x) for x in BASE_PHRASES], by_word


def _may_match() -> re.Pattern[bytes]:
    """What a text must hold to match any template or phrase: two words of it, one after the other."""
    pairs = set()
    for markup, _ in (*BASE_PHRASES, *TEMPLATES):
        fixed = _WORD.findall(markup[: (_MARK.search(markup) or re.search("$", markup)).start()].encode().lower())
        pairs.add((fixed[0], fixed[1]))
    return re.compile(b"|".join(re.escape(a) + rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+" + re.escape(b) for a, b in sorted(pairs)))


_CANDIDATE = _may_match()


def scan_text(lowered: bytes) -> tuple[int, int | None, int | None, set[str], set[str], float]:
    """Places of base phrases, first and last of them, base labels, all labels, score."""
    base, by_word = automata()
    found = _WORD.findall(lowered)
    places: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    score = 0.0
    wanted = {a.first for a in base} | by_word.keys()
    for i, word in enumerate(found):
        if word not in wanted:
            continue
        for a in base:
            if a.first == word and a.run(found, i)[0]:
                places.append(i)
                base_labels.add(a.label)
                score = 1.0
        for a in by_word.get(word, ()):
            accepted, matched = a.run(found, i)
            if accepted:
                labels.add(a.label)
            score = max(score, matched / a.mandatory if matched > 1 else 0.0)
    return len(places), min(places, default=None), max(places, default=None), base_labels, labels | base_labels, score


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its license wording.

    n_words; n_base, first_word and last_word (places of base phrases, as word numbers from 0;
    null without one); base_labels; labels (those and the templates' own; distinct, sorted,
    comma-joined); score: 1 where something matches, else the greatest share of a template's
    mandatory words that stand in order from its start, 0 below two words. Null and empty texts
    have no words. Rows are independent: repeated rows give repeated results, a null id stays null,
    an empty table gives an empty result, further columns are ignored. Nothing is shuffled.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            rows = []
            ids = batch.column(0).to_pylist()
            for low, high in slices(at):
                counts = word_counts(data, at[low : high + 1])
                for k in range(low, high):
                    lowered = data[at[k] : at[k + 1]].tobytes().lower()
                    row = (0, None, None, (), (), 0.0)
                    if _CANDIDATE.search(lowered):
                        row = scan_text(lowered)
                    rows.append((ids[k], int(counts[k - low]), *row[:3], ",".join(sorted(row[3])), ",".join(sorted(row[4])), row[5]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return map_arrow(
        ids_of(docs, id_col, text_col), run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )


def word_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of words of each of some consecutive texts; A-Z count as a-z."""
    block = data[at[0] : at[-1]]
    upper = (block >= 65) & (block <= 90)
    inside = ~NO_WORD[block] | upper
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = (at[:-1] - at[0])[at[:-1] < at[-1]]
    first[edges] = inside[edges]
    return np.diff(np.concatenate([[0], np.cumsum(first)])[at - at[0]])
