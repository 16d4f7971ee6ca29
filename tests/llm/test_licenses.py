"""License automata against regular expressions over the joined words."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.llm import licenses as L
from tempora.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def pattern(parts):
    out = ""
    for p in parts:
        if isinstance(p, bytes):
            out += " " + re.escape(p.decode())
        elif isinstance(p, tuple):
            out += "(?: [^ ]+){%d,%d}" % p
        else:
            out += "(?:%s)?" % pattern(p)
    return out


def brute(text):
    words = plain_words(text)
    joined = "".join(" " + w for w in words)
    at = [m.start() for m in re.finditer(" ", joined)]
    starts, base, spans = [], set(), []
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                starts.append(i)
                base.add(label)
                spans.append((i, i + len(p), label))
    for label, t in L.TEMPLATES.items():
        whole = pattern(L.parse(t))
        some = re.compile(whole + "(?= |$)")
        if not some.search(joined):
            continue
        for i, a in enumerate(at):
            if not some.match(joined, a):
                continue
            ends = [j for j in range(i + 1, len(words) + 1)
                    if re.fullmatch(whole, joined[a:at[j] if j < len(at) else len(joined)])]
            if ends:
                spans.append((i, max(ends), label))
    covered = {k for i, j, _ in spans for k in range(i, j)}
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted({x for _, _, x in spans})), len(covered) / len(words) if words else 0.0, sorted(spans))


def row(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score,
            [(s.start, s.end, s.label) for s in r.spans])


TEXTS = [
    None, "", "   ", "Éa MIT License; the mit-license, MIT LICENSE", "GNU General Public License, version 3.",
    "gnu general public\x00license as published by the Free Software Foundation; either version 2",
    "licensed under CC BY-NC 4.0. cc by 4 0 CC-BY-SA 4.0", "Copyright (c) 2020 Some Holder All rights reserved.",
    "all rights reserved copyright all rights reserved", "Apache License, Version 2.0 apache license 2.0 apache licensee",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Creative Commons Attribution 4.0 International License creative commons attribution share alike 3.0 license",
    "SPDX-License-Identifier: MIT", "mit license mit license", "word " * 20000 + "MIT License", "cc by cc by nc 4 0",
]


def test_scan_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "mit license", "x"), (3, TEXTS[3], "x")],
                               "doc_id long, text string, labels string")
    got = L.scan(df).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.doc_id is not None and r.doc_id != 14:
            assert row(r) == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]
    long = next(r for r in got if r.doc_id == 14)
    assert (long.n_words, long.n_base, long.first_word) == (20002, 1, 20000)
    assert L.scan(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = REGISTRY["op1_license_templates"](spark, SF).collect()
    assert len(got) == len(docs) and any(r.n_base for r in got)
    for r in got:
        want = plain_words(docs[r.doc_id])
        assert r.n_words == len(want)
        if r.labels or "icen" in docs[r.doc_id]:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(docs[r.doc_id])[:7]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"x"]), max_size=12))
def test_automaton_equals_expression(words):
    templates = ["a [[b {v:0-2}]] c", "[[a]] b [[c [[a]]]] b", "c {v:1-3} a"]
    joined = "".join(" " + w.decode() for w in words)
    want = set()
    for n, t in enumerate(templates):
        for i in range(len(words)):
            ends = [j for j in range(i + 1, len(words) + 1) if re.fullmatch(pattern(L.parse(t)), joined[2 * i:2 * j])]
            if ends:
                want.add((n, i, max(ends)))
    assert set(L.Scanner(templates).matches(words)) == want


def test_bad_markup():
    for t in ("a [[b", "a ]] b", "a {v:3-1}"):
        with pytest.raises(ValueError):
            L.parse(t)
    with pytest.raises(ValueError):
        L.Scanner(["{v:1-2} a"])


MIT = """Copyright (c) 2021 Jane Q. Public

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def labels_of(text):
    s = L.Scanner(list(L.TEMPLATES.values()))
    return {list(L.TEMPLATES)[n] for n, _, _ in s.matches(L.words_of(text.encode()))}


def filled(template, options):
    """The words of a template, with or without its optional parts, and one word more than the least for
    each variable."""
    out = []

    def add(parts):
        for p in parts:
            if isinstance(p, bytes):
                out.append(p.decode())
            elif isinstance(p, tuple):
                out.extend(f"name{i}" for i in range(min(p[0] + 1, p[1])))
            elif options:
                add(p)

    add(L.parse(template))
    return out


def test_the_whole_license_is_accepted_and_a_clause_is_not():
    assert "mit" in labels_of(MIT) and "mit" in labels_of("/* " + MIT.replace("\n", "\n * ") + " */")
    assert "mit" in labels_of(MIT.replace("THE\nAUTHORS OR COPYRIGHT HOLDERS", "ACME WIDGETS INC."))
    clause = MIT[MIT.index("Permission"):MIT.index("to deal")] + "to look at it on Tuesdays only; selling is forbidden."
    assert labels_of(clause) == set()
    for old, new in (("without restriction", "with restriction"), ("sublicense, ", ""), ("shall be included", "may be included"), ("NONINFRINGEMENT", "INFRINGEMENT")):
        assert "mit" not in labels_of(MIT.replace(old, new)), old


WHOLE = [n for n in L.TEMPLATES if n.endswith("header") or n in ("bsd-2-clause", "bsd-3-clause", "isc", "mit", "zlib")]


@pytest.mark.parametrize("name", WHOLE)
@pytest.mark.parametrize("options", [True, False])
def test_every_mandatory_word_counts(name, options):
    words = filled(L.TEMPLATES[name], options)
    s = L.Scanner([L.TEMPLATES[name]])
    run = lambda w: any(j - i >= len(w) - 1 for _, i, j in s.matches([x.encode() for x in w]))
    assert run(words) and len(words) > 30
    fixed = [i for i, w in enumerate(filled(L.TEMPLATES[name], False)) if not w.startswith("name")]
    least = filled(L.TEMPLATES[name], False)
    for i in fixed:
        assert not run([*least[:i], "misprint", *least[i + 1:]]), least[i]
    assert not run(least[:-5])


def test_two_clauses_are_not_three():
    two, three = (" ".join(filled(L.TEMPLATES[n], True)) for n in ("bsd-2-clause", "bsd-3-clause"))
    assert labels_of(two) == {"bsd-2-clause"} and labels_of(three) == {"bsd-3-clause"}
