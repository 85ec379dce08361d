"""Suffix arrays by induced sorting, and permuted common prefixes, on whole arrays.

A suffix is of type S if it is smaller than the next one, else of type L. Leftmost S suffixes (LMS) are those behind an L one; what stands
between two of them is an LMS substring. These are sorted by induction and named, and the names are a shorter text, whose suffix array
comes from the same function. From the LMS suffixes in order all others are induced, in one scan of the array forwards for L and
one backwards for S.

The scans go bucket by bucket (one for each symbol), and take all of a bucket that is known at once. So that there are few buckets, names are written in
two digits where they are many.
"""

from __future__ import annotations

import numpy as np

FEW = 256  # names that are symbols by themselves
DISTINCT = 0.4  # share of names from which on pairs are sorted


def symbols(buckets: int) -> type:
    """The smallest type that holds numbers below `buckets`; small ones sort in fewer steps."""
    return np.uint8 if buckets <= 256 else np.uint16 if buckets <= 65_536 else np.uint32


def types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the last symbol is the smallest and is."""
    rises = np.ones(len(text), dtype=np.int8)
    rises[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1])
    decides = np.flatnonzero(rises)  # equal symbols are decided by the next pair that differs
    runs = np.diff(decides, prepend=-1)
    return np.repeat(rises[decides] > 0, runs)


def _dealt(before: np.ndarray, symbols: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes by bucket, in the given order inside each: suffixes, buckets, how many go to each, and places inside their buckets."""
    order = np.argsort(symbols, kind="stable")
    each = np.bincount(symbols, minlength=buckets)
    to = np.flatnonzero(each)
    each = each[to]
    inside = np.arange(len(before)) - np.repeat(np.cumsum(each) - each, each)
    return before[order], to, each, inside


def induce(text: np.ndarray, buckets: int, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that follows from LMS suffixes, given by bucket."""
    sizes = np.bincount(text, minlength=buckets)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n_lms = np.bincount(text[lms], minlength=buckets)
    array = np.full(len(text), -1, dtype=np.int32)
    array[np.repeat(ends - np.cumsum(n_lms), n_lms) + np.arange(len(lms))] = lms
    present = np.flatnonzero(sizes).tolist()

    head = starts.copy()  # behind the last L suffix of each bucket

    def forwards(known: np.ndarray) -> None:
        before = known[known > 0] - 1
        before = before[~is_s[before]]
        if len(before):
            before, to, each, inside = _dealt(before, text[before], buckets)
            array[np.repeat(head[to], each) + inside] = before
            head[to] += each

    for b in present:
        done = starts[b]
        while done < head[b]:  # what is induced may land in this very bucket
            known, done = array[done : head[b]], head[b]
            forwards(known)
        forwards(array[ends[b] - n_lms[b] : ends[b]])

    tail = ends.copy()  # before the first S suffix of each bucket, as far as known

    def backwards(known: np.ndarray) -> None:
        known = known[::-1]
        before = known[known > 0] - 1
        before = before[is_s[before]]
        if len(before):
            before, to, each, inside = _dealt(before, text[before], buckets)
            array[np.repeat(tail[to], each) - 1 - inside] = before
            tail[to] -= each

    for b in reversed(present):
        done = ends[b]
        while tail[b] < done:
            known, done = array[tail[b] : done], tail[b]
            backwards(known)
        backwards(array[starts[b] : head[b]])
    return array


def named(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in the order of the text, equal ones alike, and how many names there are."""
    reach = np.zeros(len(text), dtype=np.int32)  # to the next LMS suffix; the last one has none after it
    reach[lms[:-1]] = np.diff(lms)
    one, two = ordered[:-1], ordered[1:]
    differ = reach[one] != reach[two]
    left, at = np.flatnonzero(~differ), 0
    while len(left):
        a, b = one[left] + at, two[left] + at
        unlike = text[a] != text[b]
        differ[left[unlike]] = True
        left = left[~unlike & (at < reach[one[left]])]
        at += 1
    names = np.empty(len(text), dtype=np.int32)
    numbers = np.cumsum(np.append(0, differ))
    names[ordered] = numbers
    return names[lms], int(numbers[-1]) + 1


def by_pairs(names: np.ndarray) -> np.ndarray:
    """The suffix array of numbers of which most are there once: ranks of pairs of neighbours, then of pairs of pairs."""
    rank, reach = names.astype(np.int64) + 1, 1
    while True:
        pair = rank * (len(rank) + 2)
        pair[:-reach] += rank[reach:]
        order = np.argsort(pair)
        new = np.append(True, pair[order[1:]] != pair[order[:-1]])
        rank[order] = np.cumsum(new)
        if new.all():
            return order
        reach *= 2


def suffix_array(text: np.ndarray, buckets: int) -> np.ndarray:
    """The starts of all suffixes in order; `text` holds numbers below `buckets`, of which 0 stands at the end and only there."""
    if len(text) == 1:
        return np.zeros(1, dtype=np.int32)
    is_s = types(text)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    roughly = induce(text, buckets, is_s, lms[np.argsort(text[lms], kind="stable")])
    is_lms = np.zeros(len(text), dtype=bool)
    is_lms[lms] = True
    ordered = roughly[is_lms[roughly]]
    names, n = named(text, lms, ordered)
    if n < len(lms):
        if n >= DISTINCT * len(lms):
            ordered = lms[by_pairs(names)]
        elif n <= FEW:
            ordered = lms[suffix_array(names.astype(symbols(n)), n)]
        else:
            base = int(np.ceil(n**0.5))
            digits = np.zeros(2 * len(names) + 1, dtype=symbols(base + 1))
            digits[:-1:2], digits[1::2] = names // base + 1, names % base + 1
            found = suffix_array(digits, base + 1)
            ordered = lms[found[(found % 2 == 0) & (found < len(digits) - 1)] // 2]
    return induce(text, buckets, is_s, ordered)


def permuted_common_prefixes(data: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in the order of the text: how many bytes it shares with the one before it in the array, and where that one starts.

    `data`: bytes, one for each suffix of `array` that counts; the array may hold longer positions, which are left out. Where the bytes before two
    neighbours are equal, these are neighbours too, and the figure is one less than theirs; only the others are compared.
    """
    n = len(data)
    array = array[array < n]
    before = np.full(n, -1, dtype=np.int64)
    before[array[1:]] = array[:-1]
    compared = np.ones(n, dtype=bool)
    later = np.flatnonzero(before > 0)
    later = later[later > 0]
    compared[later] = data[later - 1] != data[before[later] - 1]
    compared[before < 0] = True
    # The neighbour of the suffix before must be the one before the neighbour; equal ends of pieces may be in any order.
    chained = np.flatnonzero(~compared)
    compared[chained] = before[chained - 1] != before[chained] - 1

    words = np.lib.stride_tricks.as_strided(np.append(data, np.zeros(8, dtype=np.uint8))[: n + 8], (n + 1, 8), (1, 1))
    shared = np.zeros(n, dtype=np.int64)
    left = np.flatnonzero(compared & (before >= 0))
    at = 0
    while len(left):
        a, b = left + at, before[left] + at
        inside = np.maximum(a, b) < n
        left, a, b = left[inside], a[inside], b[inside]
        equal = words[a] == words[b]
        run = np.where(equal.all(axis=1), 8, equal.argmin(axis=1))
        shared[left] += np.minimum(run, n - np.maximum(a, b))
        left, at = left[run == 8], at + 8
    root = np.maximum.accumulate(np.where(compared, np.arange(n), 0))
    return shared[root] - (np.arange(n) - root), before
