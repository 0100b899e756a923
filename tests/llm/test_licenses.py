from __future__ import annotations

import random
import re

import numpy as np
import pytest
from tests.llm.data import ROWS, documents, empty

from trendloom.llm import licenses

TEXTS = [
    "Released under the MIT License. Again: under-the (MIT) license!",
    "Apache License, Version 2.0 and apache license version 2",
    "cc BY nc cc by NC; cc by-nc4",
    "under the mit licenseé",
    "This work is licensed under the GNU General Public License, version 3.",
    "licensed under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Permission to use, copy, modify and sell this software for any purpose",
]


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES:
        wanted = phrase.split()
        for i in range(len(found) - len(wanted) + 1):
            if found[i : i + len(wanted)] == wanted:
                places.append(i)
                labels.add(label)
    return len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_fields(spark):
    rows = [(100 + i, t, "en", "a", len(t)) for i, t in enumerate(TEXTS)] + ROWS
    got = sorted((tuple(r)[:6] for r in licenses.scan(documents(spark, rows)).collect()), key=repr)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert licenses.scan(empty(spark)).count() == 0


def plain(markup, wide=1):
    """The words of a template with all optional wording, and so many words in place of each replaceable region."""
    markup = re.sub(r"<<any \d+>>", " x" * wide + " ", markup)
    return re.sub(r"<<\w+>>", " ", markup)


def pattern(markup):
    """A template as a regular expression over words that each follow a blank."""
    out = ""
    for part in re.split(r"(<<optional>>|<<end>>|<<any \d+>>)", markup):
        if part == "<<optional>>":
            out += "(?:"
        elif part == "<<end>>":
            out += ")?"
        elif part.startswith("<<any"):
            out += r"(?: \S+){0,%s}" % part[6:-2]
        else:
            out += "".join(" " + w for w in re.findall("[a-z0-9]+", part.lower()))
    return re.compile(out + "(?= )")


PATTERNS = [(pattern(markup), label) for markup, label in (*licenses.TEMPLATES, *licenses.BASE_PHRASES)]


def labels_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    line = " " + " ".join(words) + " "
    return {label for found, label in PATTERNS if found.search(line)}


@pytest.mark.parametrize(("number", "labels"), [(0, {"mit"}), (4, {"gpl-3"}), (5, {"lgpl-3"}), (6, set()), (7, set()), (8, set()), (3, set())])
def test_template_labels(number, labels):
    assert licenses.scan_text(TEXTS[number].encode().lower())[4] == labels == labels_of(TEXTS[number])


def test_whole_templates_have_their_label():
    for markup, label in licenses.TEMPLATES:
        for wide in (0, 1):
            got = licenses.scan_text(f"/* {plain(markup, wide)} */ and more".encode().lower())
            assert label in got[4] and got[5] == 1.0
    notice = "This is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    assert licenses.scan_text(notice.encode().lower())[4] == {"lgpl-2.1"}


def test_an_opening_with_other_wording_has_no_label():
    opening = plain(licenses.TEMPLATES[0][0]).split("THE SOFTWARE IS PROVIDED")[0]
    found = licenses.scan_text(f"{opening} but no one at all may use it".encode().lower())
    assert found[4] == set() and 0 < found[5] < 1


def test_labels_like_regular_expressions():
    rng = random.Random(5)
    seen = set()
    for _ in range(600):
        words = plain(rng.choice(licenses.TEMPLATES)[0], rng.choice((0, 1, 1, 3))).split()
        for _ in range(rng.choice((0, 0, 1, 2))):
            at = rng.randrange(len(words))
            words[at : at + rng.choice((0, 1))] = rng.choice(([], ["other"], words[:1]))
        text = " ".join(words + plain(rng.choice(licenses.TEMPLATES)[0], 0).split()[: rng.choice((0, 5, 999))])
        got = licenses.scan_text(text.encode().lower())
        assert got[4] == labels_of(text)
        assert (got[5] == 1.0) == bool(got[4])
        seen |= got[4] or {"none"}
    assert seen >= {"mit", "isc", "bsd", "apache-2", "gpl-3", "lgpl-2.1", "mpl-2", "none"}


def test_score_is_one_only_for_whole_templates():
    whole = plain(licenses.TEMPLATES[1][0])
    assert licenses.scan_text(whole.encode().lower())[5] == 1.0
    assert 0 < licenses.scan_text(TEXTS[7].encode().lower())[5] < 1
    assert 0 < licenses.scan_text(TEXTS[8].encode().lower())[5] < licenses.scan_text(TEXTS[7].encode().lower())[5]
    assert licenses.scan_text(b"nothing here")[5] == 0.0


def test_optional_and_replaceable_regions():
    made = licenses.compile_template("a <<optional>> b c <<end>> d <<any 2>> e", "x")
    run = lambda s: made.run([w.encode() for w in s.split()], 0)[0]
    assert run("a d e") and run("a b c d e") and run("a d x e") and run("a d x y e f")
    assert not run("a b d e") and not run("a d x y z e") and not run("a d") and not run("b c d e")


def test_word_counts_across_texts():
    texts = [b"ab", b"", b"cd ef", b"", "é é".encode(), b"-", b"A"]
    at = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    assert licenses.word_counts(data, at).tolist() == [1, 0, 2, 0, 2, 0, 1]
