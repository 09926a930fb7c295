"""Similarity estimates from two sketches of the same length k.

A sketch is an ARRAY<BIGINT>: packed words for the three bit sketches, one value per
lane for min-wise signatures.  All estimates follow from one count per pair: the bits set in
both (BinSketch, BCS), the equal lanes (MinHash) or the differing bits (SimHash).  An estimator takes
``(count, card_a, card_b, k)``, where ``card`` is the number of set bits, and returns a DOUBLE column;
``get_estimator`` gives the form that counts on two sketches, ``(a, card_a, b, card_b, k)``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitfold.functions.bits import and_count, xor_count
from bitfold.functions.similarity import ratio

Counted = Callable[[Column, Column, Column, int], Column]
Estimator = Callable[[Column, Column, Column, Column, int], Column]


# ---- BinSketch: bucketed OR with collision correction ----


def sparsity(card: Column, k: int) -> Column:
    """Estimated size of the set behind a sketch with ``card`` bits (half-even rounding).

    A full sketch carries no size information and is taken at face value.
    """
    c = card.cast("double")
    if k == 1:
        return c
    free = F.lit(1.0) - c / F.lit(float(k))
    return F.when(card < k, F.rint(F.ln(free) / F.lit(math.log(1 - 1 / k)))).otherwise(c)


def _corrected_overlap(shared: Column, size_a: Column, size_b: Column, k: int) -> Column:
    raw = shared.cast("double")
    if k == 1:
        return raw
    stay = F.lit(1 - 1 / k)
    left_free = F.pow(stay, size_a) + F.pow(stay, size_b) - 1 + raw / F.lit(float(k))
    corrected = F.rint(size_a + size_b - F.ln(left_free) / F.lit(math.log(1 - 1 / k)))
    return F.when((left_free > 0) & (corrected >= 0), corrected).otherwise(raw)


def _or_parts(shared, card_a, card_b, k):
    size_a, size_b = sparsity(card_a, k), sparsity(card_b, k)
    return size_a, size_b, _corrected_overlap(shared, size_a, size_b, k)


def or_inner_product(shared, card_a, card_b, k):
    return _or_parts(shared, card_a, card_b, k)[2]


def or_hamming(shared, card_a, card_b, k):
    size_a, size_b, overlap = _or_parts(shared, card_a, card_b, k)
    return size_a + size_b - 2 * overlap


def or_jaccard(shared, card_a, card_b, k):
    size_a, size_b, overlap = _or_parts(shared, card_a, card_b, k)
    return ratio(overlap, size_a + size_b - overlap)


def or_cosine(shared, card_a, card_b, k):
    size_a, size_b, overlap = _or_parts(shared, card_a, card_b, k)
    return ratio(overlap, F.sqrt(size_a) * F.sqrt(size_b))


# ---- BCS: bucketed parity, raw sketch statistics ----


def parity_inner_product(shared, card_a, card_b, k):
    return shared.cast("double")


def parity_hamming(shared, card_a, card_b, k):
    return (card_a + card_b - 2 * shared).cast("double")


def parity_jaccard(shared, card_a, card_b, k):
    return ratio(shared, card_a + card_b - shared)


def parity_cosine(shared, card_a, card_b, k):
    norms = F.sqrt(card_a.cast("double")) * F.sqrt(card_b.cast("double"))
    return ratio(shared, norms)


# ---- MinHash: share of equal lanes ----


def equal_lanes(a: Column, b: Column, k: int) -> Column:
    same = F.zip_with(a, b, lambda x, y: x == y)
    return F.size(F.filter(same, lambda s: s)).cast("bigint")


def lanes_jaccard(equal, card_a, card_b, k):
    return equal / F.lit(float(k))


def lanes_cosine(equal, card_a, card_b, k):
    j = lanes_jaccard(equal, card_a, card_b, k)
    return F.when(j > 0, 2 * j / (1 + j)).otherwise(F.lit(0.0))


# ---- SimHash: signs of random projections ----


def signs_hamming(differing, card_a, card_b, k):
    return differing.cast("double")


def signs_cosine(differing, card_a, card_b, k):
    return F.cos(F.lit(math.pi) * (differing / F.lit(float(k))))


# ---- which sketch can estimate what ----

COUNTS = {"BinSketch": and_count, "BCS": and_count, "MinHash": equal_lanes, "SimHash": xor_count}

ESTIMATORS: dict[str, dict[str, Counted]] = {
    "BinSketch": {
        "inner_product": or_inner_product,
        "hamming_distance": or_hamming,
        "jaccard_similarity": or_jaccard,
        "cosine_similarity": or_cosine,
    },
    "BCS": {
        "inner_product": parity_inner_product,
        "hamming_distance": parity_hamming,
        "jaccard_similarity": parity_jaccard,
        "cosine_similarity": parity_cosine,
    },
    "MinHash": {"jaccard_similarity": lanes_jaccard, "cosine_similarity": lanes_cosine},
    "SimHash": {"hamming_distance": signs_hamming, "cosine_similarity": signs_cosine},
}


def get_counted_estimator(algorithm: str, similarity: str) -> Counted:
    """The estimator from the count of a pair, or an error before any Spark job starts."""
    if algorithm not in ESTIMATORS:
        raise ValueError(f"unknown algorithm {algorithm!r}; one of {', '.join(ESTIMATORS)}")
    known = ESTIMATORS[algorithm]
    if similarity not in known:
        raise ValueError(f"{algorithm} cannot estimate {similarity!r}; it offers {', '.join(known)}")
    return known[similarity]


def get_estimator(algorithm: str, similarity: str) -> Estimator:
    """The estimator from two sketches, or an error before any Spark job starts."""
    counted = get_counted_estimator(algorithm, similarity)

    def estimate(a: Column, card_a: Column, b: Column, card_b: Column, k: int) -> Column:
        return counted(COUNTS[algorithm](a, b, k), card_a, card_b, k)

    return estimate
