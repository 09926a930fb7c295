"""Explicit pair lists: sampling, exact similarities, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitfold.functions.hashing import hash63
from bitfold.functions.similarity import compare, exact_similarity
from bitfold.operators.encode import BinarySets
from bitfold.operators.overlap import covers
from bitfold.operators.ranking import hash_rank


def sample_pairs(
    docs: DataFrame, n_pairs: int, seed: int = 42, with_replacement: bool = True
) -> DataFrame:
    """``(pair_id, i, j)``: ``n_pairs`` independent seeded draws of two rows.

    With replacement a row may meet itself; otherwise the second row differs from the first
    and there are never more draws than distinct pairs.
    """
    ranked = hash_rank(docs, "doc_id", seed, "pair-order")
    n = F.col("n_total")
    size = docs.agg(F.count("*").alias("n_total")).scalar()
    draws = docs.sparkSession.range(n_pairs).select(F.col("id").alias("pair_id"), size.alias("n_total"))
    first = hash63(F.col("pair_id"), seed, "pair-first") % n
    if with_replacement:
        second = hash63(F.col("pair_id"), seed, "pair-second") % n
    else:
        draws = draws.where((n > 1) & (F.col("pair_id") < F.floor(n * (n - 1) / 2)))
        second = (first + 1 + hash63(F.col("pair_id"), seed, "pair-second") % (n - 1)) % n
    draws = draws.select("pair_id", first.alias("ri"), second.alias("rj"))
    of_i = ranked.select(F.col("rank").alias("ri"), F.col("doc_id").alias("i"))
    of_j = ranked.select(F.col("rank").alias("rj"), F.col("doc_id").alias("j"))
    return draws.join(of_i, "ri").join(of_j, "rj").select("pair_id", "i", "j")


def exact_pairs(sets: BinarySets, pairs: DataFrame, *similarities: str) -> DataFrame:
    """A pair list with ``(overlap, card_i, card_j)`` and one column per similarity.

    Pairs without a shared feature keep overlap 0.  Overlaps are counted over tall rows, so
    a huge set is never gathered.
    """
    for name in similarities:
        exact_similarity(name, F.lit(0), F.lit(0), F.lit(0))
    ids = pairs.select("i", "j").distinct()
    of_i = sets.items.select(F.col("doc_id").alias("i"), "feature_id")
    of_j = sets.items.select(F.col("doc_id").alias("j"), "feature_id")
    shared = ids.join(of_i, "i").join(of_j, ["j", "feature_id"]).groupBy("i", "j").agg(
        F.count("*").alias("overlap")
    )
    cards = sets.items.groupBy("doc_id").agg(F.count("*").alias("card"))
    zero = F.lit(0).cast("bigint")
    full = (
        pairs.join(shared, ["i", "j"], "left")
        .join(cards.select(F.col("doc_id").alias("i"), F.col("card").alias("card_i")), "i", "left")
        .join(cards.select(F.col("doc_id").alias("j"), F.col("card").alias("card_j")), "j", "left")
        .select(*pairs.columns, *[F.coalesce(c, zero).alias(c) for c in ("overlap", "card_i", "card_j")])
    )
    o, ci, cj = F.col("overlap"), F.col("card_i"), F.col("card_j")
    return full.select("*", *[exact_similarity(s, o, ci, cj).alias(s) for s in similarities])


def filter_by_threshold(truth: DataFrame, threshold: float, comparison: str = "gt", sim: str = "sim") -> DataFrame:
    """The truth rows on one side of ``threshold``; an empty result stays a table."""
    return truth.where(compare(F.col(sim), threshold, comparison))


def unlisted_matter(truth: DataFrame, threshold: float, comparison: str) -> bool:
    """Whether pairs that ``truth`` leaves out could lie on either side of ``threshold``."""
    if comparison in ("ge", "gt") and threshold > 0:
        return not covers(truth, threshold, comparison)
    return not covers(truth, 0.0, "gt")


def one_number(given: int | DataFrame) -> Column:
    """A number, or the only value of a one-row table, as a BIGINT column."""
    return (given.scalar() if isinstance(given, DataFrame) else F.lit(int(given))).cast("bigint")


def filter_report(
    truth: DataFrame, threshold: float, comparison: str = "ge", universe: int | DataFrame | None = None
) -> DataFrame:
    """One row: how many pairs there were and how many the filter keeps.

    ``truth`` may carry ``n_pairs`` weights.  ``universe`` is the number of pairs, or a one-row
    table that holds it, when ``truth`` leaves out those of similarity 0.
    """
    if universe is not None and unlisted_matter(truth, threshold, comparison):
        raise ValueError("the pairs a truth leaves out can be told from its count only if it was searched far enough")
    weight = F.col("n_pairs") if "n_pairs" in truth.columns else F.lit(1)
    zero = F.lit(0).cast("bigint")
    held = F.coalesce(F.sum(weight), zero)
    kept = F.coalesce(F.sum(F.when(compare(F.col("sim"), threshold, comparison), weight)), zero)
    listed = truth.agg(held.alias("held"), kept.alias("kept"))
    counted = listed.withColumn("total_pairs", F.col("held") if universe is None else one_number(universe))
    unseen = F.when(compare(F.lit(0.0), threshold, comparison), F.col("total_pairs") - F.col("held")).otherwise(zero)
    counts = counted.select("total_pairs", (F.col("kept") + unseen).alias("filtered_count"))
    share = F.try_divide(F.col("filtered_count").cast("double"), F.col("total_pairs").cast("double"))
    return counts.select(
        F.lit(float(threshold)).alias("threshold"), F.lit(comparison).alias("comparison"), "*",
        F.coalesce(share * 100, F.lit(0.0)).alias("percentage"),
    )


def neighbors_by_threshold(pairs: DataFrame, thresholds: list[float], sim: str = "sim") -> DataFrame:
    """``(threshold, i, j, ...)`` for every threshold a pair reaches (``sim >= t``)."""
    ladder = F.array(*[F.lit(float(t)) for t in thresholds])
    reached = F.explode(F.filter(ladder, lambda t: F.col(sim) >= t)).alias("threshold")
    return pairs.select(reached, *pairs.columns)


def neighbor_counts(pairs: DataFrame, thresholds: list[float], n_query: DataFrame, sim: str = "sim") -> DataFrame:
    """Per threshold: mean neighbours per query (queries without any included) and total pairs.

    ``n_query`` is a one-row, one-column table with the number of queries.
    """
    zero = F.lit(0).cast("bigint")
    per_t = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.coalesce(F.sum(F.when(F.col(sim) >= t, F.col("n_pairs"))), zero).alias("total_pairs"),
        )
        for t in thresholds
    ]
    tall = pairs.agg(F.array(*per_t).alias("per_t")).select(F.inline("per_t"))
    mean = F.try_divide(F.col("total_pairs").cast("double"), n_query.scalar().cast("double"))
    return tall.select("threshold", F.coalesce(mean, F.lit(0.0)).alias("avg_neighbors"), "total_pairs")
