"""Language mixtures trigram by trigram and segment by segment, without arrays."""

from __future__ import annotations

import math
import zlib
from collections import Counter

from clientlens.llm import mixture_language as ml

WORD = 2**32


def buckets(text: str) -> list[int]:
    """The bucket of the trigram around each letter, by the hash of the operator."""
    chars = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
    out = []
    for a, b, c in zip(chars, chars[1:], chars[2:]):
        if b != 32:
            x = (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) % WORD
            x ^= x >> 15
            out.append((x * 0x2C1B3C6D % WORD) >> 17)
    return out


def learned(rows: list[tuple]) -> dict[str, dict[int, float]]:
    """Log-probabilities of buckets by language, from the rows (id, text, lang) that may teach."""
    counts: dict[str, Counter] = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            counts.setdefault(lang, Counter()).update(buckets(text))
    model = {}
    for lang, n in counts.items():
        total = sum(n.values()) + ml.SMOOTHING * ml.BUCKETS
        model[lang] = {b: math.log((n.get(b, 0) + ml.SMOOTHING) / total) for b in range(ml.BUCKETS)}
    return dict(sorted(model.items()))


def fitted(like: list[dict[str, float]], langs: list[str]) -> tuple[dict[str, float], float]:
    """Proportions and log-likelihood after the rounds of expectation-maximisation."""
    share = {lang: 1 / len(langs) for lang in langs}
    for _ in range(ml.ROUNDS):
        found = dict.fromkeys(langs, 0.0)
        for segment in like:
            top = max(segment.values())
            joint = {lang: share[lang] * math.exp(segment[lang] - top) for lang in langs}
            total = max(sum(joint.values()), 1e-300)
            for lang in langs:
                found[lang] += joint[lang] / total
        share = {lang: found[lang] / len(like) for lang in langs}
    whole = 0.0
    for segment in like:
        top = max(segment.values())
        whole += top + math.log(max(sum(share[lang] * math.exp(segment[lang] - top) for lang in langs), 1e-300))
    return share, whole


def mixture(text: str | None, model: dict[str, dict[int, float]]) -> dict[str, float]:
    """The proportions of the languages that are worth their penalty; nothing without a letter or a model."""
    own = buckets(text or "")
    if not own or not model:
        return {}
    segments = [own[at : at + ml.SEGMENT] for at in range(0, len(own), ml.SEGMENT)]
    like = [{lang: sum(p[b] for b in segment) for lang, p in model.items()} for segment in segments]
    langs = list(model)
    share, best = fitted(like, langs)
    while len(langs) > 1:
        weakest = min(langs, key=lambda lang: share[lang])
        fewer = [lang for lang in langs if lang != weakest]
        new_share, new = fitted(like, fewer)
        if new + ml.PENALTY * math.log1p(len(segments)) < best:
            break
        langs, share, best = fewer, new_share, new
    return {lang: s for lang, s in share.items() if s > 0}
