"""License scans: templates with optional and replaceable parts, compiled to automata over words.

Markup of a template: plain words are mandatory; ``[[ ... ]]`` encloses words that may be missing
(nesting is allowed); ``{{n}}`` stands for up to n words of any kind (a name, a year); ``{{#}}`` for
one number.  A text is accepted where its words pass from the first to the last state: mandatory
wording has to match exactly, in order and without gaps.

Texts are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters.  Base
phrases are reported where their words stand consecutively.  Null and empty texts have no words, no
labels and score 0; repeated rows are scanned each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import rolling
from weftline.llm.common import LOWER, UPPER, pieces, record

#: fixed values: phrases and their labels
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: fixed values: wordings of public licences and of the notices that point to them
TEMPLATES = [
    ("mit", "[[released]] [[licensed]] [[distributed]] under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software [[the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software]]"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies [[the software is provided as is and {{4}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{4}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software]]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by {{8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[3]] neither the name of {{8}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission [[this software is provided by {{8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed]]"),
    ("bsd", "[[licensed]] under the [[{{#}} clause]] bsd [[{{#}} clause]] license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("apache-2", "[[licensed]] [[released]] [[under]] [[the]] apache license version 2 [[0]] [[the license you may not use this file except in compliance with the license]]"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{12}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3", "[[this work is]] [[this program is]] [[licensed]] under the gnu general public license [[gpl]] version 3 [[or later]]"),
    ("gpl-2", "[[this work is]] [[this program is]] [[licensed]] under the gnu general public license [[gpl]] version 2 [[or later]]"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation [[either version {{#}} of the license]]"),
    ("lgpl", "under the [[terms of the]] gnu lesser general public license [[as published by the free software foundation]] [[version {{#}}]]"),
    ("agpl", "under the [[terms of the]] gnu affero general public license [[as published by the free software foundation]] [[either]] [[version {{#}}]]"),
    ("epl", "made available under the terms of the eclipse public license [[v]] {{#}} 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at {{8}}]]"),
    ("mpl-2", "[[licensed]] under the mozilla public license [[version]] 2 0"),
    ("cc-by-nc", "[[licensed]] [[under]] [[a]] [[creative commons]] cc by nc [[sa]] [[nd]] [[{{#}} 0]]"),
    ("cc-by-sa", "licensed under [[creative commons]] cc by sa [[{{#}} 0]]"),
    ("cc-by", "licensed under [[creative commons]] cc by {{#}} 0"),
    ("cc0", "[[licensed]] under [[creative commons]] cc0 [[{{#}} 0]] [[universal]]"),
    ("unlicense", "this is free and unencumbered software released into the public domain [[anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means]]"),
    ("proprietary", "copyright [[c]] {{6}} all rights reserved"),
]

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


class Automaton:
    """States are numbered; ``step[s]`` lists (test, next) moves on a word, ``free[s]`` moves without one."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.step: list[list[tuple[str, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.longest = 0
        opened: list[int] = []
        required: list[str] = []
        for part in re.findall(r"\[\[|\]\]|\{\{.*?\}\}|[^\s\[\]{}]+", template):
            here = len(self.step) - 1
            if part == "[[":
                opened.append(here)
                self._new()
                self.free[here].append(here + 1)
            elif part == "]]":
                self._new()
                self.free[here].append(here + 1)
                self.free[opened.pop()].append(here + 1)
            elif part == "{{#}}" or part[:2] != "{{":
                self._new()
                self.step[here].append((part, here + 1))
                self.longest += 1
                if not opened and part[:2] != "{{":
                    required.append(part)
            else:
                for _ in range(int(part[2:-2])):
                    here = len(self.step) - 1
                    self._new()
                    self.step[here].append(("*", here + 1))
                    self.free[here].append(here + 1)
        if opened or not required:
            raise ValueError(f"{label}: brackets don't match, or nothing is mandatory")
        self.last = len(self.step) - 1
        #: words that every accepted text holds; a text without the longest can't match
        self.needs = max(required, key=len)
        self.first = self._closure({0})
        self.starts = {w for s in self.first for w, _ in self.step[s]}

    def _new(self) -> None:
        self.step.append([])
        self.free.append([])

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, words: list[str], at: int) -> int:
        """End of the longest accepted run of words that starts at ``at``, or ``at`` if there is none."""
        states, end = self.first, at
        for i in range(at, len(words)):
            word = words[i]
            states = self._closure({n for s in states for w, n in self.step[s] if w == word or w == "*" or w == "{{#}}" and word.isdecimal()})
            if not states:
                break
            if self.last in states:
                end = i + 1
        return end

    def find(self, words: list[str]) -> list[tuple[int, int]]:
        """Accepted runs, leftmost longest, that don't overlap."""
        found, at, wild = [], 0, "*" in self.starts or "{{#}}" in self.starts
        while at < len(words):
            if (wild or words[at] in self.starts) and (end := self.match(words, at)) > at:
                found.append((at, end))
                at = end
            else:
                at += 1
        return found


def compiled(templates: list[tuple[str, str]] | None = None) -> list[Automaton]:
    return [Automaton(*t) for t in templates or TEMPLATES]


def scan_text(text: str | None, automata: list[Automaton], phrases: dict[str, str] | None = None) -> dict:
    """Base places and labels, runs that templates accept (label, first word, end), and the score."""
    low = (text or "").encode().translate(_LOWER).decode()
    base: list[tuple[int, str]] = []
    runs: list[tuple[str, int, int, float]] = []
    kept = [(p.split(), label) for p, label in (phrases or PHRASES).items() if all(w in low for w in p.split())]
    automata = [a for a in automata if a.needs in low]
    if kept or automata:
        words = _WORDS.findall(low)
        for phrase, label in kept:
            at = -1
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if words[at : at + len(phrase)] == phrase:
                    base.append((at, label))
        there = set(words)
        for a in automata:
            if a.needs in there:
                runs += [(a.label, s, e, min(1.0, (e - s) / a.longest)) for s, e in a.find(words)]
    return {"base": sorted(base), "runs": runs, "score": max((r[3] for r in runs), default=0.0)}


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches string"


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Labels of every row.  ``matches`` has the accepted runs as label:first word:end, comma-joined."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(templates)
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = rolling.buffers(part.column("text"))
                _, _, counts = rolling.words(data, offsets, rolling.WORD)
                found = [scan_text(x, automata, phrases) for x in part.column("text").to_pylist()]
                yield record(RESULT, {
                    "doc_id": part.column("doc_id"),
                    "n_words": pa.array(counts[1:] - counts[:-1], pa.int64()),
                    "n_base": [len(x["base"]) for x in found],
                    "first_word": [x["base"][0][0] if x["base"] else None for x in found],
                    "last_word": [x["base"][-1][0] if x["base"] else None for x in found],
                    "base_labels": [",".join(sorted({b for _, b in x["base"]})) for x in found],
                    "labels": [",".join(sorted({b for _, b in x["base"]} | {r[0] for r in x["runs"]})) for x in found],
                    "score": [x["score"] for x in found],
                    "matches": [",".join(f"{r[0]}:{r[1]}:{r[2]}" for r in sorted(x["runs"], key=lambda r: (r[1], r[0]))) for x in found],
                })

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, RESULT)
