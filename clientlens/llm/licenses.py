"""Licences named in a text.

One Aho-Corasick automaton finds notice phrases and identifier tags in the words of a text. What follows a tag is read as an
expression of licence identifiers with and, or and with: a shunting-yard parser orders it, and evaluating it gives the
licences that apply and the terms that remain (`or` lets the reader choose the freer side, `and` binds to both).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import in_small_batches, pieces, valid

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Phrases of usual licence notices, as words, and the licence each stands for.
NOTICES = {
    "affero general public license": "agpl",
    "all rights reserved": "proprietary",
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "public domain": "public-domain",
    "released into the public domain": "public-domain",
    "the unlicense": "unlicense",
}

# How the families of licences bind, from the freest to the tightest.
TERMS = ("permissive", "weak-copyleft", "copyleft", "restricted", "unknown")
FAMILIES = {
    "0bsd": 0, "apache": 0, "bsd": 0, "bsl": 0, "cc-by": 0, "cc0": 0, "isc": 0, "mit": 0, "public-domain": 0, "unlicense": 0, "zlib": 0,
    "cddl": 1, "epl": 1, "lgpl": 1, "mpl": 1,
    "agpl": 2, "cc-by-sa": 2, "gpl": 2,
    "cc-by-nc": 3, "cc-by-nd": 3, "proprietary": 3,
}

TAG = "spdx license identifier"
TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
BINDS = {"or": 1, "and": 2, "with": 3}
# How sure a find makes us that the text carries a licence.
SURE = {"base": 0.9, "notice": 0.8, "tag": 0.95}

RESULT = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,expressions:string,terms:string>"

# A-Z in lower case; other ASCII that is no digit or letter ends a word; the rest is part of words.
WORD_BYTES = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256)
)


def terms_of(licence: str) -> int:
    """How a licence binds, by its family: the longest known name that it starts with."""
    known = [name for name in FAMILIES if licence == name or licence.startswith(name + "-")]
    return FAMILIES[max(known, key=len)] if known else len(TERMS) - 1


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: the tokens with operators after what they apply to; None if they are no expression."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in tokens:
        word = token.lower()
        if operand_next:
            if word == "(":
                waiting.append(word)
            elif word == ")" or word in BINDS:
                return None
            else:
                out.append(word)
                operand_next = False
        elif word == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif word in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        else:
            return None
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(expression: str) -> tuple[list[str], int] | None:
    """The licences that an expression leaves to the reader, and how they bind; None if it is no expression.

    `a or b` leaves the freer one (both, if they bind alike), `a and b` both with the tighter terms. An
    exception after `with` loosens copyleft by one step and is part of the name.
    """
    ordered = postfix(TOKEN.findall(expression))
    if ordered is None:
        return None
    stack: list[tuple[list[str], int]] = []
    for word in ordered:
        if word not in BINDS:
            stack.append(([word], terms_of(word)))
            continue
        (b, tight_b), (a, tight_a) = stack.pop(), stack.pop()
        if word == "with":
            stack.append((a + b, tight_a - 1 if tight_a in (1, 2) else tight_a))
        elif word == "and":
            stack.append((a + b, max(tight_a, tight_b)))
        else:
            stack.append((a + b, tight_a) if tight_a == tight_b else min((a, tight_a), (b, tight_b), key=lambda x: x[1]))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    """All phrases, between spaces, with what finding them means: (kind, label, length)."""
    found: dict[str, list[tuple[str, str]]] = {TAG: [("tag", "")]}
    for kind, phrases in (("base", BASE), ("notice", NOTICES)):
        for phrase, label in phrases.items():
            found.setdefault(phrase, []).append((kind, label))
    a = ahocorasick.Automaton()
    for phrase, meanings in found.items():
        a.add_word(f" {phrase} ", (len(phrase) + 1, meanings))
    a.make_automaton()
    return a


def scan(text: str | None, phrases: ahocorasick.Automaton) -> dict:
    """The result of one text; see `find_licences`."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
    joined = b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass")
    places, base, labels, unsure, tagged = [], set(), set(), 1.0, False
    at = before = 0
    for end, (length, meanings) in phrases.iter(joined):
        start = end - length
        for kind, label in meanings:
            if kind == "tag":
                tagged = True
                continue
            if kind == "base":
                before += joined.count(" ", at, start) if start > at else -joined.count(" ", start, at)
                at = start
                places.append(before)
                base.add(label)
            labels.add(label)
            unsure *= 1 - SURE[kind]
    expressions, binding = [], []
    if tagged:
        for line in TAG_LINE.findall(text):
            line = re.sub(r"(\*/|-->|#).*", "", line).strip()
            got = evaluate(line)
            if got:
                labels.update(got[0])
                expressions.append(line)
                binding.append(got[1])
                unsure *= 1 - SURE["tag"]
    binding += [terms_of(x) for x in labels if not expressions]
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels)),
        "score": 1 - unsure,
        "expressions": "; ".join(expressions),
        "terms": TERMS[max(binding)] if binding else None,
    }


def find_licences(docs: DataFrame, text_col: str = "text", as_col: str = "licence") -> DataFrame:
    """The documents with one more column, `as_col`, of type `RESULT`.

    n_words: the words of the text. n_base, first_word, last_word, base_labels: places of base phrases. labels: base
    labels, those of notices, and the licences that tagged expressions leave, distinct and sorted. score: how sure
    it is that the text carries a licence, 0 without any find. expressions: those after tags that could be parsed; others
    give no label. terms: the tightest that apply, null without a licence. A null text is an empty one. Texts of any length are scanned whole,
    each row by itself, repeated ones too; malformed UTF-8 is read with replacement characters. An empty table gives no rows. A column that is called `as_col` is replaced.
    """
    kind = pa.struct(
        [(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")]
        + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.string()), ("terms", pa.string())]
    )

    @F.arrow_udf(RESULT)
    def licences(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        phrases = automaton()
        for batch in batches:
            yield pa.array([scan(text, phrases) for texts in pieces(batch) for text in texts], kind)

    return in_small_batches(docs).withColumn(as_col, licences(valid(F.col(text_col))))
