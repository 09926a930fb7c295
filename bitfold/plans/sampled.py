"""Error statistics of every suitable algorithm over sampled pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitfold.functions.estimators import get_estimator
from bitfold.operators.encode import BinarySets
from bitfold.operators.pairs import exact_pairs, sample_pairs
from bitfold.operators.retrieve import attach_sketches
from bitfold.operators.sketches import get_model
from bitfold.session import materialize

# fixed values: which algorithms are tried for which metric
DEFAULT_ALGORITHMS = {
    "inner_product": ("BinSketch", "BCS"),
    "jaccard_similarity": ("MinHash", "BinSketch"),
    "hamming_distance": ("SimHash", "BinSketch"),
    "cosine_similarity": ("BinSketch", "SimHash", "BCS"),
}
RELATIVE_GUARD = 1e-10  # fixed value: added to |truth| in the relative error


def sampled_errors(
    sets: BinarySets,
    k: int = 50,
    n_pairs: int = 20,
    algorithms: list[str] | None = None,
    metrics: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """``(algorithm, metric, mse, mae, max_error, relative_error, compression_ratio, ...)``.

    Sketches of an algorithm serve all its metrics; only the sampled rows are sketched.
    """
    metrics = list(DEFAULT_ALGORITHMS) if metrics is None or "all" in metrics else metrics
    pairs = materialize(
        exact_pairs(sets, sample_pairs(sets.docs, n_pairs, seed), *metrics), "sampled-pairs"
    )
    picked = pairs.select(F.col("i").alias("doc_id")).unionByName(pairs.select(F.col("j").alias("doc_id"))).distinct()
    rows = BinarySets(picked, sets.items.join(picked, "doc_id", "left_semi"), sets.vocab)
    n_cols = sets.vocab.agg(F.count("*").cast("bigint").alias("n")).scalar()
    n_rows = sets.docs.agg(F.count("*").cast("bigint").alias("n")).scalar()
    per_algorithm: dict[str, list[str]] = {}
    for metric in metrics:
        for algorithm in DEFAULT_ALGORITHMS[metric]:
            if algorithms is None or algorithm in algorithms:
                get_estimator(algorithm, metric)
                per_algorithm.setdefault(algorithm, []).append(metric)
    cells = []
    for algorithm, wanted in per_algorithm.items():
        model = get_model(algorithm, seed)
        scored = attach_sketches(pairs, model.mapping(rows, k))
        errors = [_errors(model.estimate(m, k), F.col(m), m) for m in wanted]
        cells.append(
            scored.agg(F.array(*errors).alias("e")).select(F.lit(algorithm).alias("algorithm"), F.inline("e"))
        )
    table = reduce(DataFrame.unionByName, cells)
    return table.select(
        "*",
        (n_cols.cast("double") / F.lit(float(k))).alias("compression_ratio"),
        n_rows.alias("matrix_rows"),
        n_cols.alias("matrix_cols"),
        F.lit(k).cast("bigint").alias("sketch_size"),
    )


def _errors(estimate: Column, truth: Column, metric: str) -> Column:
    miss = F.abs(estimate - truth)
    return F.struct(
        F.lit(metric).alias("metric"),
        F.avg(miss * miss).alias("mse"),
        F.avg(miss).alias("mae"),
        F.max(miss).alias("max_error"),
        F.avg(miss / (F.abs(truth) + RELATIVE_GUARD)).alias("relative_error"),
    )


def best_algorithms(results: DataFrame) -> DataFrame:
    """One row naming the algorithm with the least MSE and with the least MAE (ties by name)."""
    order = lambda value: F.struct(F.col(value), F.col("algorithm"), F.col("metric"))
    best = results.agg(F.min(order("mse")).alias("m"), F.min(order("mae")).alias("a"))
    return best.select(
        F.col("m.algorithm").alias("best_mse_algorithm"), F.col("m.mse").alias("best_mse"),
        F.col("a.algorithm").alias("best_mae_algorithm"), F.col("a.mae").alias("best_mae"),
    )
