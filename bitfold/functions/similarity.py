"""Exact similarities of two sets from their sizes and the size of their overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMILARITIES = ("inner_product", "hamming_distance", "jaccard_similarity", "cosine_similarity")
THRESHOLDABLE = ("inner_product", "jaccard_similarity", "cosine_similarity")


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, and 0 when the denominator is 0."""
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(quotient, F.lit(0.0))


def inner_product(overlap: Column, card_a: Column, card_b: Column) -> Column:
    return overlap.cast("double")


def hamming_distance(overlap: Column, card_a: Column, card_b: Column) -> Column:
    return (card_a + card_b - 2 * overlap).cast("double")


def jaccard_similarity(overlap: Column, card_a: Column, card_b: Column) -> Column:
    return ratio(overlap, card_a + card_b - overlap)


def cosine_similarity(overlap: Column, card_a: Column, card_b: Column) -> Column:
    return ratio(overlap, F.sqrt((card_a * card_b).cast("double")))


_EXACT = {
    "inner_product": inner_product,
    "hamming_distance": hamming_distance,
    "jaccard_similarity": jaccard_similarity,
    "cosine_similarity": cosine_similarity,
}


def exact_similarity(name: str, overlap: Column, card_a: Column, card_b: Column) -> Column:
    if name not in _EXACT:
        raise ValueError(f"unknown similarity {name!r}; one of {', '.join(SIMILARITIES)}")
    return _EXACT[name](overlap, card_a, card_b)


def require_thresholdable(name: str) -> None:
    if name not in THRESHOLDABLE:
        raise ValueError(f"unknown similarity {name!r}; one of {', '.join(THRESHOLDABLE)}")


# Comparators of the truth filters.  Fixed values: 'eq' means |s - t| <= 1e-8 + 1e-5 |t|.
EQ_ABSOLUTE = 1e-8
EQ_RELATIVE = 1e-5


def compare(value: Column, threshold: float, comparison: str = "ge") -> Column:
    t = F.lit(float(threshold))
    if comparison == "ge":
        return value >= t
    if comparison == "gt":
        return value > t
    if comparison == "le":
        return value <= t
    if comparison == "lt":
        return value < t
    if comparison == "eq":
        return F.abs(value - t) <= F.lit(EQ_ABSOLUTE + EQ_RELATIVE * abs(float(threshold)))
    raise ValueError(f"unknown comparison {comparison!r}; one of ge, gt, le, lt, eq")
