from __future__ import annotations

import random
import re

import pytest

from clientlens.llm import licenses


def plain(text):
    """Base finds, word by word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def base(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_base_finds_equal_plain_search():
    rng, phrases = random.Random(5), licenses.automaton()
    bits = ["MIT", "mit", " ", "license", "License", "\n", "general", "public", "apache", "-", "é", " general public license ", "x", "2", "\x7f"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert base(licenses.scan(text, phrases)) == plain(text), text


@pytest.mark.parametrize(
    ("text", "licences", "terms"),
    [
        ("MIT", ["mit"], 0),
        ("MIT OR GPL-2.0-only AND BSD-3-Clause", ["mit"], 0),
        ("(MIT OR GPL-2.0) AND LGPL-3.0", ["mit", "lgpl-3.0"], 1),
        ("MIT or ISC", ["mit", "isc"], 0),
        ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-2.0", "classpath-exception-2.0"], 1),
        ("CC-BY-NC-4.0", ["cc-by-nc-4.0"], 3),
        ("LicenseRef-own", ["licenseref-own"], 4),
    ],
)
def test_expressions(text, licences, terms):
    assert licenses.evaluate(text) == (licences, terms)


@pytest.mark.parametrize("text", ["", "AND", "MIT OR", "()", "(MIT", "MIT)", "MIT ISC", "WITH x"])
def test_no_expressions(text):
    assert licenses.evaluate(text) is None


def test_tags_and_notices():
    r = licenses.scan("// SPDX-License-Identifier: (MIT OR GPL-2.0)\nLicensed under CC BY-NC 4.0. Released under the MIT License.", licenses.automaton())
    assert r["labels"] == "cc-by,cc-by-nc,mit"
    assert r["base_labels"] == "mit" and r["expressions"] == "(MIT OR GPL-2.0)" and r["terms"] == "permissive"
    assert 0.9 < r["score"] <= 1
    assert licenses.scan("nothing here", licenses.automaton())["score"] == 0


def test_awkward_rows(awkward, empty):
    for r in licenses.find_licences(awkward).select("text", "licence.*").collect():
        assert base(r.asDict()) == plain(r.text)
    assert licenses.find_licences(empty).collect() == []
