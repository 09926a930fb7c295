"""All pairs of rows whose exact similarity reaches a threshold, without comparing all pairs.

1. Copies collapse to weighted classes (``collapse_copies``).
2. Features are ordered rare-first, in bands of similar frequency.  Sets that reach the
   threshold share at least ``need`` features.  Each set drops its most frequent bands as
   long as fewer than ``need - MIN_SHARED`` features go with them; what is kept is indexed.
   Very common features are dropped by almost every set.
3. Indexed rows meet on the feature, in cells (``cells.met_in_cells``).  Of the features two
   sets share, at most ``max(dropped_i, dropped_j)`` are missing from the index of either, so
   a pair that reaches the threshold is seen ``need - max(dropped)`` times or more.  Pairs
   seen less often are discarded; none above the threshold is.
4. The remaining pairs are verified on the full sets.

At low thresholds next to nothing is dropped and most pairs that meet are candidates.  There all features are indexed,
and overlaps are counted where the rows meet (``cells.met_in_cells``): neither meetings nor candidates are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitfold.functions.similarity import compare, exact_similarity, require_thresholdable
from bitfold.operators import postings
from bitfold.operators.cells import met_in_cells
from bitfold.operators.classes import SetClasses
from bitfold.operators.encode import aligned_set_arrays, chunk_count
from bitfold.session import materialize

BANDS_PER_OCTAVE = 4
MIN_SHARED = 8  # indexed features a pair has to share when its sets are large enough
FEW_MEETINGS = 1 << 18  # meetings of two sides that are listed one by one
WHOLE_BELOW = 0.25  # share of its features a set must have in common, below which all are indexed
MET = "i bigint, j bigint, overlap bigint, card_i bigint, card_j bigint, n_i bigint, n_j bigint"
CANDIDATE = MET.replace("overlap bigint, ", "")
SLACK = 1e-9  # keeps the necessary conditions on the safe side of rounding


def _own_need(card: Column, similarity: str, threshold: float) -> Column:
    """Least overlap a set of this size must have with any partner."""
    t = F.lit(float(threshold))
    bound = {
        "inner_product": t,
        "jaccard_similarity": t * card,
        "cosine_similarity": t * t * card,
    }[similarity]
    return F.greatest(F.ceil(bound - SLACK), F.lit(1).cast("bigint"))


def _pair_need(similarity: str, threshold: float) -> Callable:
    """Least overlap two sizes need, as a function of NumPy arrays."""
    t = float(threshold)

    def need(card_a: np.ndarray, card_b: np.ndarray) -> np.ndarray:
        bound = {
            "inner_product": lambda: np.full(len(card_a), t),
            "jaccard_similarity": lambda: t / (1 + t) * (card_a + card_b),
            "cosine_similarity": lambda: t * np.sqrt(card_a.astype(float) * card_b),
        }[similarity]()
        return np.maximum(np.ceil(bound - SLACK), 1).astype(np.int64)

    return need


def prefix_index(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``(feature_id, doc_id, card, need, dropped, n_left, n_right)`` for the kept features.

    ``rows(doc_id, card, need, n_left, n_right)`` states how many features a set has to share
    at least with any partner.  Band sizes per set are map-side combined counts, so a huge set
    costs no more than its bands.  Frequencies and last bands are written before they meet the items: joined
    with a written table, the items of a feature that every row has, or of a huge row, can be split over tasks.
    """
    df = materialize(items.groupBy("feature_id").agg(F.count("*").alias("df")), "frequencies")
    band = F.ceil(F.log2(F.col("df").cast("double")) * BANDS_PER_OCTAVE).cast("int").alias("band")
    banded = materialize(items.join(df, "feature_id").select("doc_id", "feature_id", band), "banded")
    frequent_first = (
        Window.partitionBy("doc_id").orderBy(F.col("band").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sizes = banded.groupBy("doc_id", "band").agg(F.count("*").alias("n"))
    running = sizes.select("doc_id", "band", F.sum("n").over(frequent_first).alias("so_far"))
    goes = F.col("so_far") <= F.col("need") - MIN_SHARED
    kept = (
        running.join(rows, "doc_id")
        .groupBy("doc_id", "card", "need", "n_left", "n_right")
        .agg(
            F.max(F.when(~goes, F.col("band"))).alias("last_band"),
            F.coalesce(F.max(F.when(goes, F.col("so_far"))), F.lit(0).cast("bigint")).alias("dropped"),
        )
    )
    kept = materialize(kept, "last-bands")
    shared = banded.where(F.col("band") > 0)  # band 0: features of a single set
    index = shared.join(kept, "doc_id").where(F.col("band") <= F.col("last_band"))
    return materialize(
        index.select("feature_id", "doc_id", "card", "need", "dropped", "n_left", "n_right"),
        "prefix-index",
    )


def oriented(left: dict, right: dict, keep: np.ndarray, two_sided: bool) -> dict:
    """The kept pairs of a cell as ``i``, ``j``, ``card_i``, ``card_j``, ``n_i`` and ``n_j``; unless ``two_sided`` with i < j."""
    names = {"i": "doc_id", "card_i": "card", "n_i": "n_left"}
    out = {c: left[v][keep] for c, v in names.items()} | {c.replace("i", "j"): right[v.replace("left", "right")][keep] for c, v in names.items()}
    if not two_sided:
        turned = out["i"] > out["j"]
        for c in names:
            d = c.replace("i", "j")
            out[c], out[d] = np.where(turned, out[d], out[c]), np.where(turned, out[c], out[d])
    return out


def often_enough(two_sided: bool, pair_need: Callable | None):
    """Of the pairs that meet in a cell those that were seen as often as both rows need."""

    def run(left: dict, right: dict, seen: np.ndarray) -> dict | None:
        need = np.maximum(left["need"], right["need"])
        if pair_need is not None:
            need = np.maximum(need, pair_need(left["card"], right["card"]))
        smaller = np.minimum(left["card"], right["card"])
        keep = np.flatnonzero((smaller >= need) & (seen >= need - np.maximum(left["dropped"], right["dropped"])))
        return oriented(left, right, keep, two_sided) if len(keep) else None

    return run


def meetings_of(index: DataFrame) -> int:
    """How often left rows meet right ones on a feature: one number."""
    of_feature = index.groupBy("feature_id").agg(F.count_if(F.col("n_left") > 0).alias("l"), F.count_if(F.col("n_right") > 0).alias("m"))
    return of_feature.agg(F.sum(F.col("l") * F.col("m"))).first()[0] or 0


def few_often_enough(index: DataFrame, columns: list[str], pair_need: Callable | None) -> DataFrame:
    """``seen_often_enough`` of two sides whose meetings are listed."""
    names = ["doc_id", *columns]
    met = postings.meet_on_key(index, "feature_id", "doc_id", columns, True)
    # the block of a row is another for each feature
    of_pair = [F.col(f"{s}.{c}").cast("bigint").alias(f"{s}_{c}") for s in "ab" for c in names]
    met = met.select(*of_pair).groupBy(*[f"{s}_{c}" for s in "ab" for c in names]).agg(F.count("*").alias("seen"))
    enough, ordered = often_enough(True, pair_need), [c.split()[0] for c in CANDIDATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ({c: batch[f"{s}_{c}"].to_numpy() for c in names} for s in "ab")
            out = enough(left, right, batch["seen"].to_numpy()) if batch.num_rows else None
            if out is not None:
                # in the order of the schema: here columns do not go by name
                yield pa.RecordBatch.from_pydict({c: pa.array(out[c], pa.int64()) for c in ordered})

    return met.mapInArrow(run, CANDIDATE)


def seen_often_enough(index: DataFrame, two_sided: bool, pair_need: Callable | None = None) -> DataFrame:
    """``(i, j, card_i, card_j, n_i, n_j)`` for pairs whose index rows meet often enough.

    ``pair_need(card_i, card_j)``, of NumPy arrays, sharpens the need of a pair beyond that of its two rows.  Meetings are
    counted in cells and never shuffled, unless a few rows of one side make so few that dealing out the other side costs more.
    """
    columns = ["card", "need", "dropped", "n_left", "n_right"]
    if two_sided and meetings_of(index) <= FEW_MEETINGS:
        return few_often_enough(index, columns, pair_need)
    rows = materialize(index.select("doc_id", *columns).distinct(), "index-rows")
    return met_in_cells(rows, index.select("doc_id", "feature_id"), columns, often_enough(two_sided, pair_need), CANDIDATE, two_sided)


def index_whole(similarity: str, threshold: float) -> bool:
    """Whether dropping frequent features would drop next to none."""
    if similarity == "inner_product":
        return threshold <= MIN_SHARED
    return (threshold if similarity == "jaccard_similarity" else threshold * threshold) < WHOLE_BELOW


def reaching(similarity: str, threshold: float, two_sided: bool):
    """Of the pairs that meet in a cell those that may reach the threshold; never too few."""

    def run(left: dict, right: dict, overlap: np.ndarray) -> dict | None:
        a, b = left["card"], right["card"]
        size = {"inner_product": np.ones(len(a)), "jaccard_similarity": a + b - overlap}.get(similarity)
        if size is None:
            size = np.sqrt(a.astype(float) * b)
        keep = np.flatnonzero(overlap >= (threshold - SLACK) * size - SLACK)
        if not len(keep):
            return None
        return oriented(left, right, keep, two_sided) | {"overlap": overlap[keep]}

    def least(left: dict, right: dict) -> np.ndarray:
        a, b = left["card"], right["card"]
        bound = {
            "inner_product": lambda: np.full(np.broadcast(a, b).shape, threshold),
            "jaccard_similarity": lambda: threshold / (1 + threshold) * (a + b),
            "cosine_similarity": lambda: threshold * np.sqrt(a) * np.sqrt(b),
        }[similarity]()
        return np.maximum(bound * (1 - 1e-6) - 1e-6, 1)

    run.least = least
    return run


def met_overlaps(rows: DataFrame, items: DataFrame, similarity: str, threshold: float, two_sided: bool) -> DataFrame:
    """``(i, j, overlap, card_i, card_j, n_i, n_j)`` of the pairs of ``rows`` that may reach ``threshold``, with exact overlaps."""
    return met_in_cells(rows, items, ["card", "n_left", "n_right"], reaching(similarity, threshold, two_sided), MET, two_sided, distinct=True)


def verified_overlaps(candidates: DataFrame, sets: SetClasses) -> DataFrame:
    """Add the exact overlap of every candidate pair.

    Candidates are written first, and only the sets of those that are in a pair are gathered.
    """
    largest = sets.classes.agg(F.max("card")).first()[0] or 0  # one number
    n_chunks = chunk_count(largest)
    candidates = materialize(candidates, "candidates")
    asked = candidates.select(F.explode(F.array("i", "j")).alias("doc_id")).distinct()
    arrays = aligned_set_arrays(sets.items.join(asked, "doc_id", "left_semi"), n_chunks)
    of_i = arrays.select(F.col("doc_id").alias("i"), "chunk", F.col("features").alias("fi"))
    of_j = arrays.select(F.col("doc_id").alias("j"), "chunk", F.col("features").alias("fj"))
    met = candidates.join(of_i, "i").join(of_j, ["j", "chunk"])
    shared = F.size(F.array_intersect("fi", "fj")).cast("bigint")
    if n_chunks == 1:
        return met.select(*candidates.columns, shared.alias("overlap"))
    return met.groupBy(*candidates.columns).agg(F.sum(shared).alias("overlap"))


def covers(truth: DataFrame, threshold: float, comparison: str = "ge") -> bool:
    """Whether ``truth`` lists every pair on the upper side of ``threshold``.

    Tables from ``similar_pairs`` say in the metadata of ``sim`` how far down they were searched; a
    table that does not say is taken to be complete.
    """
    said = truth.schema["sim"].metadata
    if "threshold" not in said:
        return True
    return said["threshold"] < threshold or (
        said["threshold"] == threshold and (said["comparison"] == "ge" or comparison == "gt")
    )


def similar_pairs(
    sets: SetClasses,
    similarity: str,
    threshold: float,
    comparison: str = "ge",
    two_sided: bool = False,
) -> DataFrame:
    """Class pairs whose exact similarity is at least (or above) ``threshold`` > 0.

    Returns ``(i, j, overlap, card_i, card_j, n_i, n_j, n_pairs, sim)`` where ``n_pairs``
    counts the row pairs the class pair stands for.  Compared with itself a table gives
    ``i < j`` plus ``i = j`` for classes of several copies; with ``two_sided`` ``i`` is the
    left (query) and ``j`` the right (train) class.

    A threshold of 0 would list every pair; those pairs are only ever counted, see
    ``profile.pair_profile``.
    """
    found = _similar_pairs(sets, similarity, threshold, comparison, two_sided)
    return found.withMetadata("sim", {"threshold": float(threshold), "comparison": comparison})


def _similar_pairs(sets: SetClasses, similarity: str, threshold: float, comparison: str, two_sided: bool) -> DataFrame:
    require_thresholdable(similarity)
    if comparison not in ("ge", "gt"):
        raise ValueError("pairs are found by a lower bound: comparison must be 'ge' or 'gt'")
    if threshold <= 0:
        if comparison == "ge" or threshold < 0:
            raise ValueError("a threshold that keeps disjoint pairs would list every pair")
        threshold = 0.0
    # an integer overlap above t is at least floor(t) + 1
    bound = math.floor(threshold) + 1 if (similarity, comparison) == ("inner_product", "gt") else threshold
    rows = sets.classes.where(F.col("card") > 0).withColumn("need", _own_need(F.col("card"), similarity, bound))
    if index_whole(similarity, bound):
        verified = met_overlaps(rows.drop("need"), sets.items, similarity, bound, two_sided)
    else:
        candidates = seen_often_enough(
            prefix_index(rows, sets.items),
            two_sided,
            _pair_need(similarity, bound),
        )
        verified = verified_overlaps(candidates, sets)
    pairs = verified.withColumn("n_pairs", F.col("n_i") * F.col("n_j"))

    several = sets.classes.where(F.col("card") > 0)
    n_l, n_r = F.col("n_left"), F.col("n_right")
    inside = n_l * n_r if two_sided else F.floor(n_l * (n_l - 1) / 2)
    copies = several.where(inside > 0).select(
        F.col("doc_id").alias("i"), F.col("doc_id").alias("j"),
        F.col("card").alias("overlap"), F.col("card").alias("card_i"), F.col("card").alias("card_j"),
        n_l.alias("n_i"), n_r.alias("n_j"), inside.cast("bigint").alias("n_pairs"),
    )
    sim = exact_similarity(similarity, F.col("overlap"), F.col("card_i"), F.col("card_j"))
    return (
        pairs.unionByName(copies).withColumn("sim", sim)
        .where(compare(F.col("sim"), threshold, comparison))
    )
