"""Plain Python versions of what the operators compute."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from bitfold.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATTERNS = (
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text):
    spans, counts = [], []
    for k, (name, pattern, group, least) in enumerate(PATTERNS):
        hits = [m for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
        counts.append(len(hits))
        spans += [(m.start(), k, m.end(), name) for m in hits]
    line = ",".join(f"{name}:{start}:{end}" for start, _, end, name in sorted(spans))
    return (*counts, sha(line)), line


def statistics(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), failed


def quality_votes(text):
    """What each rule says of one text, from plain counts."""
    n_words, word_chars, n_symbols, n_dup, n_repeat, _ = statistics(text)
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    digits, capitals = len(re.findall("[0-9]", text or "")), len(re.findall("[A-Z]", text or ""))
    stops = len(set(words) & set(quality.STOP_WORDS))
    of = lambda a, b: a / b if b else 0.0
    length, some = of(word_chars, n_words), n_words >= 5
    said = [
        (n_words >= 50, n_words < 20),
        (some and 3 <= length <= 10, some and (length < 2.5 or length > 13)),
        (some and of(n_symbols, n_words) <= 0.02, some and of(n_symbols, n_words) > 0.1),
        (len(lines) >= 2 and n_dup / len(lines) <= 0.05, len(lines) >= 2 and n_dup / len(lines) > 0.3),
        (some and of(n_repeat, n_words) <= 0.05, some and of(n_repeat, n_words) > 0.2),
        (some and of(digits, word_chars) <= 0.05, some and of(digits, word_chars) > 0.2),
        (some and of(capitals, word_chars) <= 0.15, some and of(capitals, word_chars) > 0.5),
        (stops >= 3, n_words >= 30 and stops <= 1),
    ]
    return [-1 if bad else 1 if good else 0 for good, bad in said]


def quality_posteriors(votes, rounds=40, trust=0.2):
    """The chance that each row is good, by expectation-maximisation row by row, as plain products of probabilities."""
    votes = np.array(votes)
    lean = np.array([[0.1, 0.6], [0.2, 0.3], [0.7, 0.1]])  # of votes -1, 0, 1 by good and bad rows
    share, tables = 0.8, np.repeat(lean[None], votes.shape[1], axis=0)
    weight = trust * len(votes) + 1

    def good():
        likely = np.prod([tables[r, votes[:, r] + 1] for r in range(votes.shape[1])], axis=0) * [share, 1 - share]
        return likely[:, 0] / likely.sum(axis=1)

    for _ in range(rounds):
        p = good()
        share = (p.sum() + 0.8 * weight) / (len(votes) + weight)
        of = np.array([p.sum() + weight, (1 - p).sum() + weight])
        for r in range(votes.shape[1]):
            for v in (-1, 0, 1):
                at = votes[:, r] == v
                tables[r, v + 1] = (np.array([p[at].sum(), (1 - p)[at].sum()]) + weight * lean[v + 1]) / of
    return good()


def fluid_time(blocks, weights, i, level):
    """When source ``i`` has received ``level`` blocks, if all sources fill at rates in proportion to their weights."""
    got, t = [Fraction(0)] * len(blocks), Fraction(0)
    while got[i] < level:
        filling = [k for k, b in enumerate(blocks) if got[k] < b]
        total = sum(weights[k] for k in filling)
        step = min([(blocks[k] - got[k]) * total / weights[k] for k in filling] + [(level - got[i]) * total / weights[i]])
        t += step
        for k in filling:
            got[k] += step * weights[k] / total
    return t


def pfair(blocks, weights):
    """(source, block, release, deadline) by slot: the released block with the earliest deadline, smaller source first."""
    waiting = []
    for i, b in enumerate(blocks):
        times = [fluid_time(blocks, weights, i, Fraction(j)) for j in range(b + 1)]
        waiting += [(i, j, math.floor(times[j]), math.ceil(times[j + 1])) for j in range(b)]
    out = []
    for t in range(len(waiting)):
        best = min((x for x in waiting if x[2] <= t), key=lambda x: (x[3], x[0], x[1]))
        waiting.remove(best)
        out.append(best)
    return out


def exact_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id))
    return {
        doc_id: (min(members)[1], len(members), min(members)[1] == doc_id, sha(norm))
        for norm, members in groups.items() for _, doc_id in members
    }


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    size = min(width, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_groups(rows, width):
    sets = {doc_id: shingles(text, width) for doc_id, text in rows}
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for a, b in {(a, b) for ds in holders.values() for a in ds for b in ds if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def without_repeats(rows, length=100):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            if piece in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(piece)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
