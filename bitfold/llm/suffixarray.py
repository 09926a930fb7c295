"""Suffix arrays by induced sorting, and the common prefixes of their neighbours, in NumPy.

Suffixes are of type S when smaller than the next one and L when larger; an S after an L is a
leftmost-smaller (LMS) suffix.  Sorted LMS suffixes induce the order of all L suffixes in one sweep
over the buckets and these that of all S suffixes in a sweep back.  A first induction from
unsorted LMS suffixes sorts the LMS substrings; equal ones get equal names, and the string of
names, at most half as long, is sorted in turn by the same method.  A bucket is swept as a few
vectors; names form a large alphabet of small buckets, which are swept suffix by suffix.
"""

from __future__ import annotations

import numpy as np

CROWD = 64  # letters a bucket holds on average from which it is swept as a vector


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the last one counts as S."""
    n = len(text)
    rise = np.ones(n, np.int8)
    rise[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])
    # equal neighbours take the type of the next suffix that differs
    at = np.where(rise != 0, np.arange(n), n - 1)
    return rise[np.minimum.accumulate(at[::-1])[::-1]] > 0


def induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array that ``seeds`` (LMS suffixes in the order they are to have) induce."""
    n = len(text)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    used = np.flatnonzero(sizes)
    order = np.full(n, -1, np.int64)
    seed_of = np.split(seeds[np.argsort(text[seeds], kind="stable")], np.cumsum(np.bincount(text[seeds], minlength=len(sizes)))[:-1])
    # L suffixes, left to right
    head = starts.copy()
    for c in used:
        at = starts[c]
        while at < head[c]:  # L suffixes of this bucket, also those it induces in itself
            front = order[at : head[c]]
            at = head[c]
            spread(text, front[front > 0] - 1, is_s, False, order, head)
        if len(seed_of[c]):
            spread(text, seed_of[c][seed_of[c] > 0] - 1, is_s, False, order, head)
    # S suffixes, right to left, from the L suffixes and the S suffixes found so far
    tail = ends.copy()
    for c in used[::-1]:
        at = ends[c]
        while at > tail[c]:
            front = order[tail[c] : at][::-1]
            at = tail[c]
            spread(text, front[front > 0] - 1, is_s, True, order, tail)
        front = order[starts[c] : head[c]][::-1]
        spread(text, front[front > 0] - 1, is_s, True, order, tail)
    order[0] = n - 1  # the last suffix is the smallest and nothing induces it
    return order


def induce_singly(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same, suffix by suffix, for strings of many different letters."""
    n = len(text)
    # bucket of the suffix that a suffix induces, -1 where it is of the other type or there is none
    larger, smaller = np.full(n + 1, -1), np.full(n + 1, -1)
    larger[1:n] = np.where(is_s[:-1], -1, text[:-1])
    smaller[1:n] = np.where(is_s[:-1], text[:-1], -1)
    larger, smaller = larger.tolist(), smaller.tolist()
    ends = np.cumsum(sizes)
    order = [-1] * n
    tail = ends.tolist()
    for i, c in zip(seeds[::-1].tolist(), text[seeds[::-1]].tolist()):
        tail[c] -= 1
        order[tail[c]] = i
    head = (ends - sizes).tolist()
    for i in order:  # sees what the loop itself puts further on
        c = larger[i]
        if c >= 0:
            order[head[c]] = i - 1
            head[c] += 1
    tail = ends.tolist()
    for i in reversed(order):
        c = smaller[i]
        if c >= 0:
            tail[c] -= 1
            order[tail[c]] = i - 1
    order[0] = n - 1
    return np.array(order, np.int64)


def spread(text, found, is_s, wanted: bool, order, edge) -> None:
    """Put the suffixes of the wanted type at the edges of their buckets, in the given order."""
    found = found[is_s[found] == wanted]
    if not len(found):
        return
    letter = text[found]
    turn = np.argsort(letter, kind="stable")
    found, letter = found[turn], letter[turn]
    first = np.flatnonzero(np.concatenate(([True], letter[1:] != letter[:-1])))
    sizes = np.diff(np.append(first, len(letter)))
    step = np.arange(len(letter)) - np.repeat(first, sizes)
    if wanted:
        order[edge[letter] - 1 - step] = found
        edge[letter[first]] -= sizes
    else:
        order[edge[letter] + step] = found
        edge[letter[first]] += sizes


def names_of(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """A name per LMS suffix, in text order; equal LMS substrings share one."""
    ends = np.append(lms[1:] + 1, len(text))
    end_of = np.zeros(len(text), np.int64)
    end_of[lms] = ends
    a, b = ordered[:-1], ordered[1:]
    same = end_of[a] - a == end_of[b] - b
    # the last LMS suffix has no next one to end at and equals none
    same &= (a != lms[-1]) & (b != lms[-1])
    live, k = np.flatnonzero(same), 0
    while len(live):
        live = live[a[live] + k < end_of[a[live]]]
        differ = text[a[live] + k] != text[b[live] + k]
        same[live[differ]] = False
        live, k = live[~differ], k + 1
    name = np.zeros(len(text), np.int64)
    name[ordered] = np.concatenate(([0], np.cumsum(~same)))
    return name[lms]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers; a suffix that ends is smaller than its extensions."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = np.append(text.astype(np.int64) + 1, 0)  # a unique smallest letter ends the string
    is_s = suffix_types(text)
    sizes = np.bincount(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    # a sweep over whole buckets pays while they are few
    sort = induce if np.count_nonzero(sizes) * CROWD < n else induce_singly
    ordered = sort(text, is_s, lms, sizes)
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    ordered = ordered[is_lms[ordered]]
    names = names_of(text, lms, ordered)
    if names.max() + 1 < len(lms):
        ordered = lms[suffix_array(names)]
    return sort(text, is_s, ordered, sizes)[1:]


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the prefix each suffix shares with its predecessor in the suffix array, in text order.

    Where the same letter stands before both, the length is one less than that of the suffix before
    in the text.  Only the others are compared, four letters at a time; their lengths add up to
    n log n at most.  Letters are below 65,535.
    """
    n = len(text)
    at = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    compared = np.ones(n, bool)
    follows = np.flatnonzero((at > 0) & (before > 0))
    compared[follows] = text[follows - 1] != text[before[follows] - 1]
    ended = np.concatenate((text.astype(np.uint16), np.full(4, 0xFFFF, np.uint16)))
    words = np.ndarray((n + 1,), np.uint64, ended.tobytes(), 0, (2,)).copy()
    shared = np.zeros(n, np.int64)
    live, k = np.flatnonzero(compared & (before >= 0)), 0
    while len(live):
        differ = words[live + k] ^ words[before[live] + k]
        done = differ != 0
        low = differ[done]
        letters = sum((low & np.uint64((1 << bits) - 1) == 0).astype(np.int64) for bits in (16, 32, 48))
        shared[live[done]] = k + letters
        live, k = live[~done], k + 4
    source = np.maximum.accumulate(np.where(compared, at, 0))
    return shared[source] - (at - source)
