"""Brute force over Python sets, for small fixtures."""

import math


def similarity(name, a, b):
    overlap = len(a & b)
    if name == "inner_product":
        return float(overlap)
    if name == "hamming_distance":
        return float(len(a ^ b))
    if name == "jaccard_similarity":
        return overlap / len(a | b) if a | b else 0.0
    return overlap / math.sqrt(len(a) * len(b)) if a and b else 0.0


def bits(words):
    return {63 * w + b for w, word in enumerate(words) for b in range(63) if word >> b & 1}


def or_size(c, k):
    return float(round(math.log(1 - c / k) / math.log(1 - 1 / k))) if c < k else float(c)


def or_overlap(a, b, k):
    s1, s2, common = or_size(len(a), k), or_size(len(b), k), len(a & b)
    q = 1 - 1 / k
    val = q**s1 + q**s2 - 1 + common / k
    if val > 0:
        est = round(s1 + s2 - math.log(val) / math.log(q))
        if est >= 0:
            return float(est)
    return float(common)


def estimate(algorithm, name, x, y, k):
    """x, y: raw sketches (word lists, or lane lists for MinHash)."""
    if algorithm == "MinHash":
        j = sum(p == q for p, q in zip(x, y)) / k
        return j if name == "jaccard_similarity" else (2 * j / (1 + j) if j > 0 else 0.0)
    a, b = bits(x), bits(y)
    if algorithm == "SimHash":
        ham = len(a ^ b)
        return float(ham) if name == "hamming_distance" else math.cos(math.pi * ham / k)
    if algorithm == "BCS":
        return similarity(name, a, b)
    s1, s2, ip = or_size(len(a), k), or_size(len(b), k), or_overlap(a, b, k)
    if name == "inner_product":
        return ip
    if name == "hamming_distance":
        return s1 + s2 - 2 * ip
    if name == "jaccard_similarity":
        return ip / (s1 + s2 - ip) if s1 + s2 - ip else 0.0
    return ip / (math.sqrt(s1) * math.sqrt(s2)) if s1 * s2 else 0.0
