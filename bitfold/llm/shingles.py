"""Hashed word shingles of texts, computed over whole Arrow batches with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes that are hashed at a time
FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2^64
WHITE = (9, 10, 11, 12, 13, 32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """Hashes of white-space separated words with A-Z taken as a-z.

    A word's hash is a polynomial in its bytes.  Prefix sums of the whole chunk give all words at
    once; dividing by the power of its start makes a word's hash independent of its place.
    """

    def __init__(self):
        self.ink = np.ones(256, bool)
        self.ink[list(WHITE)] = False
        self.value = mix(np.arange(1, 257, dtype=np.uint64))
        self.value[ord("A") : ord("Z") + 1] = self.value[ord("a") : ord("z") + 1]
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.powers) < n:
            back = np.uint64(pow(int(FACTOR), -1, 1 << 64))
            self.powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, FACTOR))))
            self.inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, back))))

    def hashes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of the texts ``data[bounds[k]:bounds[k + 1]]``, and how many words each has."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
        self.reach(n)
        ink = self.ink[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = ink[:-1], ink[1:]
        borders = bounds[(bounds > 0) & (bounds < n)]
        before[borders] = False
        after[borders - 1] = False
        starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
        total = np.concatenate(([np.uint64(0)], np.cumsum(self.value[data] * self.powers[:n])))
        words = (total[ends] - total[starts]) * self.inverse[starts]
        words = mix(words ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        return words, np.diff(np.searchsorted(starts, bounds))


def word_hashes(texts: pa.Array, hasher: WordHasher) -> Iterator[np.ndarray]:
    """Word hashes of every text in turn; null counts as empty.

    Texts are taken together up to ``CHUNK`` bytes, and a longer one is cut at white space, so
    memory does not follow the batch.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, buffer = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1)
        if ends[stop] - ends[at] <= CHUNK:
            bounds = ends[at : stop + 1] - ends[at]
            words, counts = hasher.hashes(raw[ends[at] : ends[stop]], bounds)
            yield from np.split(words, np.cumsum(counts)[:-1])
        else:
            yield long_text(raw[ends[at] : ends[stop]], hasher)
        at = stop


def long_text(data: np.ndarray, hasher: WordHasher) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + CHUNK)
        while stop < len(data):  # up to the next white space
            gap = np.flatnonzero(~hasher.ink[data[stop : stop + CHUNK]])
            stop = min(len(data), stop + (int(gap[0]) if len(gap) else CHUNK))
            if len(gap):
                break
        parts.append(hasher.hashes(data[at:stop], np.array([0, stop - at]))[0])
        at = stop
    return np.concatenate(parts)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; fewer words are one run."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(width, len(words))
    factors = mix(np.arange(101, 101 + size, dtype=np.uint64)) | np.uint64(1)
    n = len(words) - size + 1
    total = np.full(n, np.uint64(size))
    for k in range(size):
        total += words[k : k + n] * factors[k]
    return np.unique(mix(total))
