"""Words of texts as 64-bit hashes, many texts at a time.

Words are what stands between blanks (space and the control characters 9 to 13). A word's hash depends on its bytes alone, so it is the same
in every task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BYTES = 250_000  # hashed at once
_RANDOM = np.random.default_rng(5)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_FACTORS = _RANDOM.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which near numbers go far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Keeps the powers it needs from one call to the next."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, BYTES)
            for name, base in (("powers", _BASE), ("inverses", pow(_BASE, -1, 2**64))):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def block(self, joined: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each begins."""
        codes = np.frombuffer(joined, dtype=np.uint8)
        blank = np.concatenate([[True], _BLANK[codes], [True]])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edges[::2], edges[1::2]
        self.grow(len(codes) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[codes] * self.powers[: len(codes)], dtype=np.uint64)])
        hashes = (sums[ends] - sums[starts]) * self.inverses[starts]
        return mixed(hashes + (ends - starts).astype(np.uint64)), starts

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of texts one after the other, and the number of words of each."""
        if len(texts) == 1 and len(texts[0]) > BYTES:
            hashes = np.concatenate([self.block(part)[0] for part in _parts(texts[0])])
            return hashes, np.array([len(hashes)])
        hashes, starts = self.block(b" ".join(texts))
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        return hashes, np.diff(np.searchsorted(starts, begins))


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text cut at blanks."""
    at = 0
    while at < len(text):
        end = at + BYTES
        while end < len(text) and not _BLANK[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def batched(rows: Iterable, size_of) -> Iterator[list]:
    """Rows in lists of at most BYTES, or of one row."""
    batch, size = [], 0
    for row in rows:
        n = size_of(row)
        if batch and size + n > BYTES:
            yield batch
            batch, size = [], 0
        batch.append(row)
        size += n
    if batch:
        yield batch


def grams(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _FACTORS[(k + 29 * seed) % len(_FACTORS)]
    return mixed(total + np.uint64(seed))
