"""Rows whose *estimated* similarity reaches a threshold, found from the sketches alone.

A bit sketch is the set of its set buckets and a min-wise signature the set of its
(lane, value) pairs, so the counted prefix filter of the exact join applies to them: the
estimate grows with the number of shared tokens, and ``least_shared`` says how many are
needed.  Sign sketches are near in Hamming distance instead; those within distance r agree
on at least one of r + 1 runs of bits; where these would be short, tiles of sketches are compared.  Both filters only drop pairs below the threshold;
every pair left is estimated from its two sketches.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitfold.functions.bits import bit_run, set_positions
from bitfold.functions.estimators import get_estimator
from bitfold.functions.hashing import long_array
from bitfold.functions.similarity import compare, require_thresholdable
from bitfold.operators.classes import SetClasses
from bitfold.operators.overlap import SLACK, prefix_index, seen_often_enough
from bitfold.operators.postings import meet_on_key
from bitfold.operators.sketches import SketchModel
from bitfold.session import materialize

RUN_BITS = 62  # longest run of sign bits compared as one key
LEAST_RUN_BITS = 24  # shorter runs are equal by chance too often: below, sign sketches are compared tile by tile
LOW_THRESHOLD = 0.5  # up to this similarity most sketches share enough to be candidates: they are compared tile by tile, too


def set_sizes(algorithm: str, k: int) -> np.ndarray:
    """For c = 0..k: the size of set that the estimates take a sketch with c set bits for."""
    cards = np.arange(k + 1, dtype=float)
    if algorithm == "BCS" or k == 1:
        return cards
    with np.errstate(divide="ignore"):
        sizes = np.rint(np.log(1 - cards / k) / math.log(1 - 1 / k))
    sizes[k] = k
    return sizes


def shared_by_pair(algorithm: str, similarity: str, k: int, threshold: float, mine: np.ndarray, partner: np.ndarray) -> np.ndarray:
    """How many buckets two sketches of sets taken for these sizes must share before the estimate can reach
    ``threshold`` (a Hamming distance: not exceed it); never too many."""
    least = 1.0
    if similarity == "inner_product":
        wanted = np.full(np.broadcast(mine, partner).shape, float(threshold))
    elif similarity == "jaccard_similarity":
        wanted = threshold / (1 + threshold) * (mine + partner)
    elif similarity == "hamming_distance":
        wanted, least = (mine + partner - threshold) / 2, 0.0
    else:
        wanted = threshold * np.sqrt(mine * partner)
    overlap = np.maximum(np.ceil(wanted - SLACK), least)
    shared = overlap
    if algorithm == "BinSketch" and k > 1:
        # the rounded estimate reaches `overlap` once its argument reaches overlap - 1/2
        stay = 1 - 1 / k
        argument = stay ** (mine + partner - overlap + 0.5)
        corrected = k * (argument + 1 - stay**mine - stay**partner)
        shared = np.minimum(shared, np.ceil(corrected - 1e-6))
    return np.maximum(shared, least)


def estimates_near(
    algorithm: str, similarity: str, k: int, count: np.ndarray, mine: np.ndarray, partner: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The estimates of pairs with these counts and set bits up to rounding, and where rounding cannot matter for a size."""
    sure = np.ones(len(count), bool)
    if algorithm == "MinHash":
        share = count / k
        return (share if similarity == "jaccard_similarity" else 2 * share / (1 + share)), sure
    if algorithm == "SimHash":
        return (count.astype(float) if similarity == "hamming_distance" else np.cos(math.pi * (count / k))), sure
    sizes, overlap = set_sizes(algorithm, k), count.astype(float)
    a, b = sizes[mine], sizes[partner]
    if algorithm == "BinSketch" and k > 1:
        free = (1 - 1 / k) ** a + (1 - 1 / k) ** b - 1 + overlap / k
        with np.errstate(divide="ignore", invalid="ignore"):
            exact = a + b - np.log(free) / math.log(1 - 1 / k)
            corrected = np.rint(exact)
            usable = (free > 0) & (corrected >= 0)
            # halves are rounded one way or the other by the last digit, and so is what is left free near 0
            sure = (np.abs(exact - np.floor(exact) - 0.5) > 1e-6) & (np.abs(free) > 1e-9)
        overlap = np.where(usable, corrected, overlap)
    size = {"inner_product": 1.0, "jaccard_similarity": a + b - overlap, "cosine_similarity": np.sqrt(a) * np.sqrt(b)}.get(similarity)
    if size is None:
        return a + b - 2 * overlap, sure
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(size == 0, 0.0, overlap / size), sure


def least_shared(algorithm: str, similarity: str, k: int, threshold: float) -> list[int]:
    """For c = 0..k: how many buckets a sketch with c set bits must share at least with any
    partner before the estimate can reach ``threshold``; k + 1 if it never can."""
    cards, sizes = np.arange(k + 1, dtype=float), set_sizes(algorithm, k)
    out = [k + 1]
    for c in range(1, k + 1):
        shared = shared_by_pair(algorithm, similarity, k, threshold, sizes[c], sizes[1:])
        possible = shared <= np.minimum(c, cards[1:])
        out.append(int(shared[possible].min()) if possible.any() else k + 1)
    return out


def least_lanes(similarity: str, k: int, threshold: float) -> int:
    """How many lanes of two min-wise signatures must be equal."""
    jaccard = threshold if similarity == "jaccard_similarity" else threshold / (2 - threshold)
    return max(1, math.ceil(jaccard * k - SLACK))


def most_differing(similarity: str, k: int, threshold: float) -> int:
    """How many bits of two sign sketches may differ."""
    if similarity == "hamming_distance":
        return min(k, math.floor(threshold))
    return min(k, math.floor(k * math.acos(max(-1.0, min(1.0, threshold))) / math.pi + SLACK))


def _tokens(sketches: DataFrame, algorithm: str, k: int) -> DataFrame:
    if algorithm == "MinHash":
        lane = F.posexplode("sketch").alias("lane", "value")
        token = (F.col("lane").cast("bigint") * F.lit(1 << 31) + F.col("value")).alias("feature_id")
        return sketches.select("doc_id", lane).select("doc_id", token)
    positions = sketches.select("doc_id", F.explode(set_positions(F.col("sketch"), k)).alias("p"))
    return positions.select("doc_id", F.col("p").cast("bigint").alias("feature_id"))


def _by_shared_tokens(rows: DataFrame, model: SketchModel, similarity, k, threshold, two_sided):
    if model.name == "MinHash":
        card, need = F.lit(k).cast("bigint"), F.lit(least_lanes(similarity, k, threshold)).cast("bigint")
    else:
        card = F.col("card")
        needs = long_array(least_shared(model.name, similarity, k, threshold))
        need = F.get(needs, card.cast("int"))
    rows = rows.withColumn("card", card).withColumn("need", need).where(F.col("need") <= F.col("card"))
    sides = rows.select("doc_id", "card", "need", "n_left", "n_right")
    index = prefix_index(sides, _tokens(rows, model.name, k))
    return seen_often_enough(index, two_sided).select("i", "j", "n_i", "n_j")


def sign_runs(k: int, threshold: float) -> int:
    """Into how many runs sign sketches are cut so that those above ``threshold`` agree on one."""
    radius = most_differing("cosine_similarity", k, threshold)
    if radius >= k:
        raise ValueError("this threshold keeps every pair of sign sketches")
    return max(radius + 1, -(-k // RUN_BITS))


def _by_equal_runs(rows: DataFrame, k: int, threshold: float, two_sided: bool) -> DataFrame:
    n_runs = sign_runs(k, threshold)
    edges = [k * r // n_runs for r in range(n_runs + 1)]
    runs = [
        F.struct(F.lit(r).alias("run"), bit_run(F.col("sketch"), edges[r], edges[r + 1]).alias("bits"))
        for r in range(n_runs)
    ]
    tall = rows.select("doc_id", "n_left", "n_right", F.explode(F.array(*runs)).alias("r"))
    token = (F.col("r.run").cast("string"), F.col("r.bits").cast("string"))
    index = materialize(
        tall.select(F.concat_ws(":", *token).alias("run"), "doc_id", "n_left", "n_right"), "sign-runs"
    )
    met = meet_on_key(index, "run", "doc_id", ["n_left", "n_right"], two_sided)
    return met.select(
        F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j"),
        F.col("a.n_left").alias("n_i"), F.col("b.n_right").alias("n_j"),
    ).distinct()


def _sketch_side(sketches: DataFrame, row: str, side: str) -> DataFrame:
    return sketches.select(
        F.col("doc_id").alias(row), F.col("sketch").alias(f"{side}_sketch"), F.col("card").alias(f"{side}_card")
    )


def attach_sketches(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Gather both sketches of every ``(i, j)`` pair; Spark sizes and picks the joins."""
    return pairs.join(_sketch_side(sketches, "i", "a"), "i").join(_sketch_side(sketches, "j", "b"), "j")


def estimate_pairs(
    model: SketchModel, sketches: DataFrame, pairs: DataFrame, similarity: str, k: int
) -> DataFrame:
    """The pair list with an ``est`` column; other columns of ``pairs`` are kept."""
    get_estimator(model.name, similarity)
    est = model.estimate(similarity, k).alias("est")
    return attach_sketches(pairs, sketches).select(*pairs.columns, est)


def by_tiles(algorithm: str, similarity: str, threshold: float, k: int) -> bool:
    """Whether comparing tiles of sketches is better than an index: where next to every pair would be a candidate."""
    if algorithm == "SimHash":
        return k // sign_runs(k, threshold) < LEAST_RUN_BITS
    return similarity != "inner_product" and threshold <= LOW_THRESHOLD


def estimated_neighbors(
    model: SketchModel,
    sets: SetClasses,
    similarity: str,
    threshold: float,
    k: int,
    two_sided: bool = True,
    sketches: DataFrame | None = None,
    method: str | None = None,
) -> DataFrame:
    """Class pairs whose estimated similarity is at least ``threshold`` > 0.

    Returns ``(i, j, n_i, n_j, n_pairs, est)``; see ``overlap.similar_pairs`` for the sides.  ``sketches`` are
    those of ``sets`` if they are written already.  ``method`` is "tiles" or "index", by default what ``by_tiles`` says; short runs
    of signs are never an index.  Both find the same pairs.
    """
    require_thresholdable(similarity)
    get_estimator(model.name, similarity)
    if threshold <= 0:
        raise ValueError("a threshold that keeps disjoint pairs would list every pair")
    tiles = by_tiles(model.name, similarity, threshold, k)
    if method == "tiles" or (tiles and (method is None or model.name == "SimHash")):
        from bitfold.operators.tiles import tiled_neighbors  # which builds on this module

        return tiled_neighbors(model, sets, similarity, threshold, k, two_sided, sketches)
    if sketches is None:
        sketches = materialize(model.mapping(sets.as_sets(), k), "sketches")
    rows = sketches.join(sets.classes.select("doc_id", "n_left", "n_right"), "doc_id")
    if model.name == "SimHash":
        candidates = _by_equal_runs(rows, k, threshold, two_sided)
    else:
        candidates = _by_shared_tokens(rows, model, similarity, k, threshold, two_sided)
    n_l, n_r = F.col("n_left"), F.col("n_right")
    inside: Column = n_l * n_r if two_sided else F.floor(n_l * (n_l - 1) / 2)
    copies = rows.where(inside > 0).select(
        F.col("doc_id").alias("i"), F.col("doc_id").alias("j"), n_l.alias("n_i"), n_r.alias("n_j"),
        inside.cast("bigint").alias("n_pairs"),
    )
    pairs = candidates.withColumn("n_pairs", F.col("n_i") * F.col("n_j")).unionByName(copies)
    estimated = estimate_pairs(model, sketches, pairs, similarity, k)
    return estimated.where(compare(F.col("est"), threshold, "ge"))
