"""License scans by template markup compiled into token automata.

A template is a line of lower-case words with two kinds of markup: ``[[ ... ]]`` is wording that
may be missing (and may be nested), ``{name:low-high}`` stands for ``low`` to ``high`` words of
any kind, such as a holder's name. The rest is mandatory and must match word by word. Templates
are compiled into one automaton whose edges are words; a text is accepted at a place if the
automaton reaches a template's end from there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import byte_column, map_batches

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licenses and notices, by label. Whole licenses and headers come
# with all their mandatory words, so one that is changed or cut short is not accepted.
_DISCLAIMED = (
    "this software is provided by {owner:1-8} as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {owner:1-8} be liable for any "
    "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods "
    "or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
    "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage")
_REDISTRIBUTED = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
    "are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution")
_NOTICE = (
    "this {{work:1-4}} is free software you can redistribute it and or modify it under the terms of the gnu {0} public license as published "
    "by the free software foundation either version {{number:1-2}} of the license or [[at your option]] any later version this {{work:1-4}} "
    "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
    "fitness for a particular purpose see the gnu {0} public license for more details")
TEMPLATES = {
    "agpl": "gnu affero general public license [[version 3]]",
    "agpl-header": _NOTICE.format("affero general"),
    "all-rights-reserved": "[[copyright {holder:1-8}]] all rights reserved",
    "apache-2.0": "[[licensed under the]] apache license [[version]] 2 0",
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use {work:2-3} except in compliance with the license you may "
        "obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 unless required by applicable law or agreed "
        "to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license"),
    "bsd-2-clause": f"{_REDISTRIBUTED} {_DISCLAIMED}",
    "bsd-3-clause": (
        f"{_REDISTRIBUTED} [[3]] neither the name of {{holder:1-12}} nor the names of its contributors may be used to endorse or promote "
        f"products derived from this software without specific prior written permission {_DISCLAIMED}"),
    "cc-by-4.0": "cc by 4 0",
    "cc-by-nc-4.0": "[[licensed under]] cc by nc 4 0",
    "cc-by-sa-4.0": "[[licensed under]] cc by sa 4 0",
    "creative-commons": "creative commons attribution [[{terms:1-3}]] {version:1-2} [[international]] license",
    "gpl-2.0": "gnu general public license [[as published by the free software foundation]] [[either]] version 2",
    "gpl-3.0": "gnu general public license [[as published by the free software foundation]] [[either]] version 3",
    "gpl-header": _NOTICE.format("general"),
    "isc": (
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies the software is provided as is and {owner:1-8} "
        "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event "
        "shall {owner:1-8} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss "
        "of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with "
        "the use or performance of this software"),
    "lgpl": "gnu lesser general public license [[version {number:1-2}]]",
    "lgpl-header": _NOTICE.format("lesser general"),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "[[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall "
        "be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind "
        "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall {owner:2-8} be liable for any claim damages or other liability whether in an action of contract "
        "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    "mit-notice": "[[released]] under the mit license",
    "mpl-2.0": "mozilla public license [[version]] 2 0",
    "mpl-2.0-header": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with "
        "this file you can obtain one at [[http]] [[https]] mozilla org mpl 2 0"),
    "public-domain": "[[released]] into the public domain",
    "spdx": "spdx license identifier {identifier:1-3}",
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will {owner:2-8} be held liable for any damages "
        "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
        "applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software "
        "must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an "
        "acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly "
        "marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from "
        "any source distribution"),
}

# Words are runs of digits, ASCII letters and bytes from 0x80 on; everything else separates.
_WORDS = bytes(b if chr(b).isalnum() and b < 0x80 or b >= 0x80 else 0x20 for b in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z in lower case."""
    return text.translate(_WORDS).split()


@dataclass
class Automaton:
    """Nondeterministic automaton over words. ``edges[s]`` maps a word to next states, ``any_[s]``
    are states reached by any word, ``empty[s]`` those reached by none; ``ends`` maps accepting
    states to the template's number."""

    edges: list[dict[bytes, list[int]]] = field(default_factory=list)
    any_: list[list[int]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)
    ends: dict[int, int] = field(default_factory=dict)

    def state(self) -> int:
        self.edges.append({})
        self.any_.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def close(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return frozenset(states)


_MARKUP = re.compile(r"\[\[|\]\]|\{\w+:\d+-\d+\}|[^\s\[\]{}]+")


def parse(template: str) -> list:
    """Nested parts of a template: words (bytes), (low, high) for a variable, lists for options."""
    stack: list[list] = [[]]
    for m in _MARKUP.findall(template):
        if m == "[[":
            stack.append([])
        elif m == "]]":
            if len(stack) == 1:
                raise ValueError(f"unopened ]] in {template!r}")
            part = stack.pop()
            stack[-1].append(part)
        elif m[0] == "{":
            low, high = m[1:-1].split(":")[1].split("-")
            if int(low) > int(high):
                raise ValueError(f"empty range {m}")
            stack[-1].append((int(low), int(high)))
        else:
            stack[-1] += words_of(m.encode())
    if len(stack) > 1:
        raise ValueError(f"unclosed [[ in {template!r}")
    return stack[0]


def compiled(templates: list[str]) -> Automaton:
    """One automaton for all templates; state 0 is the start."""
    a = Automaton()
    a.state()

    def chain(parts: list, s: int) -> int:
        for p in parts:
            if isinstance(p, bytes):
                t = a.state()
                a.edges[s].setdefault(p, []).append(t)
            elif isinstance(p, tuple):
                for _ in range(p[0]):
                    t = a.state()
                    a.any_[s].append(t)
                    s = t
                t = a.state()
                a.empty[s].append(t)
                for _ in range(p[1] - p[0]):
                    u = a.state()
                    a.any_[s].append(u)
                    a.empty[u].append(t)
                    s = u
            else:
                t = chain(p, s)
                a.empty[s].append(t)
            s = t
        return s

    for n, text in enumerate(templates):
        first = a.state()
        a.empty[0].append(first)
        a.ends[chain(parse(text), first)] = n
    return a


class Scanner:
    """Runs an automaton over word lists; sets of states are built once and kept."""

    def __init__(self, templates: list[str]):
        self.a = compiled(templates)
        self.start = self.a.close({0})
        if any(s in self.a.ends or self.a.any_[s] for s in self.start):
            raise ValueError("a template must begin with a mandatory or optional word")
        self.first = {w for s in self.start for w in self.a.edges[s]}
        self.steps: dict[tuple, tuple] = {}

    def step(self, states: frozenset[int], word: bytes) -> tuple[frozenset[int], tuple[int, ...]]:
        known = word if any(word in self.a.edges[s] for s in states) else None
        key = (states, known)
        if key not in self.steps:
            out = {t for s in states for t in [*self.a.edges[s].get(known, ()), *self.a.any_[s]]}
            out = self.a.close(out)
            self.steps[key] = out, tuple(sorted({self.a.ends[s] for s in out if s in self.a.ends}))
        return self.steps[key]

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, start, end) of the longest match of each template at each place."""
        found = []
        first = self.first
        for i in [i for i, w in enumerate(words) if w in first]:
            states, longest = self.start, {}
            for j in range(i, len(words)):
                states, ends = self.step(states, words[j])
                if not states:
                    break
                for n in ends:
                    longest[n] = j + 1
            found += [(n, i, j) for n, j in longest.items()]
        return found


_SCANNERS: dict[tuple, Scanner] = {}


def _scanner(templates: tuple[str, ...]) -> Scanner:
    if templates not in _SCANNERS:
        _SCANNERS[templates] = Scanner(list(templates))
    return _SCANNERS[templates]


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, spans array<struct<label: string, start: int, end: int>>")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: dict[str, str] | None = None,
         templates: dict[str, str] | None = None) -> DataFrame:
    """One row a document (see ``SCHEMA``).

    ``n_words``: words of the text; ``n_base``: places of all base phrases, ``first_word`` and
    ``last_word`` the least and greatest of their starts (null without any); ``base_labels`` and
    ``labels``: distinct labels of the base phrases, and of these and the templates, sorted and
    joined by commas; ``spans``: label and words [start, end) of each match, the longest a label
    has at its start; ``score``: share of the words within spans. A null or empty text has no
    words, empty labels and score 0. Repeated rows and null ids come out as they come in; further
    columns are ignored.
    """
    base = BASE if base is None else base
    templates = TEMPLATES if templates is None else templates
    labels = [*base.values(), *templates]
    lines = (*base, *templates.values())
    n_base = len(base)

    def one(b: pa.RecordBatch) -> dict:
        s = _scanner(lines)
        cols: list[list] = [[] for _ in range(8)]
        for t in byte_column(b, "t"):
            words = words_of(t)
            hits = s.matches(words)
            starts = sorted(i for n, i, _ in hits if n < n_base)
            covered, at = 0, 0
            for i, j in sorted((i, j) for _, i, j in hits):
                covered += max(0, j - max(i, at))
                at = max(at, j)
            own = sorted((i, j, labels[n]) for n, i, j in hits)
            row = (len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None,
                   ",".join(sorted({labels[n] for n, _, _ in hits if n < n_base})),
                   ",".join(sorted({x for _, _, x in own})), covered / len(words) if words else 0.0,
                   [{"label": x, "start": i, "end": j} for i, j, x in own])
            for col, v in zip(cols, row):
                col.append(v)
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
        return {"doc_id": b.column(0)} | dict(zip(names, cols))

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")), one, SCHEMA)
