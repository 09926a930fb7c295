"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Reported doubles are rounded to six digits so that engines agree on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitfold.catalog.datasets import (
    SEED, TRAIN_RATIO, classes, customer_sets, document_sets, once, purchases, split_classes, split_truth,
    table, truth,
)
from bitfold.functions.estimators import sparsity
from bitfold.functions.similarity import exact_similarity
from bitfold.operators.classes import collapse_copies
from bitfold.operators.encode import (
    BinarySets, binarize, coordinate_export, dataset_summary, head_sample, preview, row_support, set_arrays, value_check,
)
from bitfold.operators.hamming import near_sets, near_sketches, neighbor_rows, sketch_classes
from bitfold.operators.histogram import similarity_histogram
from bitfold.operators.overlap import similar_pairs
from bitfold.operators.pairs import (
    exact_pairs, filter_by_threshold, filter_report, neighbor_counts, neighbors_by_threshold, sample_pairs,
)
from bitfold.operators.profile import (
    max_sampled_similarity, pair_profile, pair_universe, suggested_thresholds, threshold_report,
)
from bitfold.operators.retrieve import attach_sketches, estimated_neighbors
from bitfold.operators.sketches import get_model
from bitfold.operators.split import same_split, train_query_split
from bitfold.operators.tiles import tiled_neighbors
from bitfold.operators.top import max_similarity, top_pairs
from bitfold.plans.accuracy import DEFAULT_LENGTHS, accuracy_grid, algorithm_accuracy
from bitfold.plans.growing import extended_truth
from bitfold.plans.retrieval import query_outcomes, retrieval_grid, summarize
from bitfold.plans.sampled import best_algorithms, sampled_errors
from bitfold.plans.truth import accuracy_truth, retrieval_filter, retrieval_truth
from bitfold.session import materialize, scratch_path
from bitfold.sources.bagofwords import load_bag_of_words, write_bag_of_words
from bitfold.sources.tables import load_sets, save_filtered_truth, save_sets, synthetic_like

JACCARD, COSINE, INNER = "jaccard_similarity", "cosine_similarity", "inner_product"
ERROR_THRESHOLDS = [0.1, 0.2, 0.3, 0.5, 0.8]
ERROR_CELLS = {"BinSketch": (256, 1000), "BCS": (256, 1000), "MinHash": (64,)}
FIND_THRESHOLDS = [0.2, 0.5, 0.85]
FIND_CELLS = (("BinSketch", 1000), ("BCS", 1000), ("MinHash", 64))
SIGN_THRESHOLDS = [0.8, 0.9, 0.95]
SIGN_CELLS = (("SimHash", 128),)
HAMMING_RADIUS = 20
SIGN_RADIUS = ("SimHash", 128, 12)
PARITY_RADIUS = ("BCS", 1000, 20)
TOP = 200
COMPARISONS = ("ge", "gt", "le", "lt", "eq")
SHARE = 0.025  # a Jaccard similarity that some pairs of customers have exactly
SHARE_THRESHOLDS = [0.01, 0.025, 0.05, 0.2]
GRID_THRESHOLDS = [0.5, 0.85, 1.5]  # nothing reaches the last
SIGN_GRID_THRESHOLDS = [0.8, 0.9, 1.5]
LOW_THRESHOLDS = [0.1, 0.3, 0.5, 0.7, 0.95]
LOW_CELLS = (("BinSketch", 100), ("BCS", 100), ("MinHash", 100))
LOW_QUERIES = {
    "query_train_low_binsketch": ("BinSketch", "jaccard_similarity", 0.1, 100),
    "query_train_low_bcs": ("BCS", "jaccard_similarity", 0.1, 100),
    "query_train_low_minhash": ("MinHash", "jaccard_similarity", 0.1, 100),
    "query_train_low_simhash": ("SimHash", "cosine_similarity", 0.1, 100),
    "query_train_hamming_binsketch": ("BinSketch", "hamming_distance", 20, 1000),
}
LANE_LENGTHS = (50, 63, 150)
LANE_THRESHOLDS = [0.3, 0.6]
GRID_CELLS = (("BinSketch", 500), ("BCS", 500), ("MinHash", 64))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes
    ])


# ---- encoding ----


def vocab_min_df(spark, sf):
    return document_sets(spark, sf).vocab.select("feature_id", "term", "df")


def items_binary(spark, sf):
    return document_sets(spark, sf).items.select("doc_id", "feature_id")


def items_customers(spark, sf):
    return purchases(spark, sf).items


def binarize_discounts(spark, sf):
    return binarize(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", "l_discount")


def binary_check(spark, sf):
    return rounded(value_check(table(spark, sf, "lineitem"), "l_discount"))


def coo_export(spark, sf):
    return coordinate_export(document_sets(spark, sf).items)


def doc_sets(spark, sf):
    arrays = set_arrays(purchases(spark, sf).items)
    text = F.concat_ws(" ", F.transform(F.sort_array("features"), lambda f: f.cast("string")))
    return arrays.select("doc_id", "chunk", F.size("features").cast("bigint").alias("n_items"), text.alias("features"))


def row_items(spark, sf):
    return row_support(purchases(spark, sf).items, 1)


def summary(spark, sf):
    return rounded(dataset_summary(document_sets(spark, sf)))


def corner_preview(spark, sf):
    return preview(purchases(spark, sf))


def first_documents(spark, sf):
    return head_sample(purchases(spark, sf), 500).items


def docword_roundtrip(spark, sf):
    def build():
        path = scratch_path(spark, "docword")
        write_bag_of_words(document_sets(spark, sf), path)
        return path

    return load_bag_of_words(spark, once(spark, sf, "docword", build)).items


def split_sides(spark, sf):
    return train_query_split(purchases(spark, sf).docs, TRAIN_RATIO, SEED)


def split_validity(spark, sf):
    docs = purchases(spark, sf).docs
    current = train_query_split(docs, TRAIN_RATIO, SEED)
    others = [("same", SEED), ("other", SEED + 1)]
    checks = [
        same_split(train_query_split(docs, TRAIN_RATIO, seed), current).select(F.lit(name).alias("saved"), "*")
        for name, seed in others
    ]
    return reduce(DataFrame.unionByName, checks)


# ---- sketches ----


def binsketch_map_balance(spark, sf):
    buckets = get_model("BinSketch", SEED).bucket_map(document_sets(spark, sf).vocab, 333)
    return buckets.groupBy("bucket").agg(F.count("*").alias("n_features"), F.sum("feature_id").alias("feature_sum"))


def bcs_map(spark, sf):
    return get_model("BCS", SEED).bucket_map(document_sets(spark, sf).vocab, 256)


def _words(sets, algorithm: str, k: int) -> DataFrame:
    sketches = get_model(algorithm, SEED).mapping(sets, k)
    return sketches.select("doc_id", F.posexplode("sketch").alias("word", "bits"))


def _tall_words(name, source, algorithm, k):
    def query(spark, sf):
        words = _words(source(spark, sf), algorithm, k)
        return words.select("doc_id", F.col("word").cast("bigint").alias("word"), "bits")

    query.__name__ = name
    return query


binsketch_sketch = _tall_words("binsketch_sketch", document_sets, "BinSketch", 256)
binsketch_sketch_long = _tall_words("binsketch_sketch_long", customer_sets, "BinSketch", 2000)
bcs_sketch = _tall_words("bcs_sketch", document_sets, "BCS", 256)
bcs_sketch_long = _tall_words("bcs_sketch_long", customer_sets, "BCS", 2000)
minhash_signature = _tall_words("minhash_signature", document_sets, "MinHash", 64)
simhash_sketch = _tall_words("simhash_sketch", document_sets, "SimHash", 128)


# ---- estimators over all truth pairs ----


def _estimates(spark, sf, algorithm, k, similarities):
    pairs = truth(spark, sf, "documents", JACCARD, 0.1).select("i", "j", "n_pairs")
    model = get_model(algorithm, SEED)
    met = attach_sketches(pairs, model.mapping(classes(spark, sf, "documents").as_sets(), k))
    sizes = []
    if algorithm == "BinSketch":
        sizes = [sparsity(F.col("a_card"), k).alias("size_i"), sparsity(F.col("b_card"), k).alias("size_j")]
    return rounded(met.select("i", "j", "n_pairs", *sizes, *[model.estimate(s, k).alias(s) for s in similarities]))


def binsketch_estimates(spark, sf):
    return _estimates(spark, sf, "BinSketch", 1000, (INNER, "hamming_distance", JACCARD, COSINE))


def bcs_estimates(spark, sf):
    return _estimates(spark, sf, "BCS", 1000, (INNER, "hamming_distance", JACCARD, COSINE))


def minhash_estimates(spark, sf):
    return _estimates(spark, sf, "MinHash", 64, (JACCARD, COSINE))


def simhash_estimates(spark, sf):
    return _estimates(spark, sf, "SimHash", 128, ("hamming_distance", COSINE))


# ---- exact similarities ----


def _pair_columns(pairs: DataFrame) -> DataFrame:
    return rounded(pairs.select("i", "j", "overlap", "card_i", "card_j", "n_pairs", "sim"))


def exact_jaccard(spark, sf):
    return _pair_columns(truth(spark, sf, "documents", JACCARD, 0.1))


def truth_after_append(spark, sf):
    """The truth of all documents, from that of the training rows and a comparison of the added ones."""
    sets = document_sets(spark, sf)
    first = train_query_split(sets.docs, TRAIN_RATIO, SEED).where("side = 'train'").select("doc_id")
    before = collapse_copies(BinarySets(first, sets.items.join(first, "doc_id", "left_semi"), sets.vocab))
    saved = materialize(similar_pairs(before, JACCARD, 0.1, "gt"), "truth")
    return _pair_columns(extended_truth(classes(spark, sf, "documents"), saved, before.shapes, JACCARD, 0.1))


def exact_cosine(spark, sf):
    return _pair_columns(truth(spark, sf, "documents", COSINE, 0.3))


def exact_inner_product(spark, sf):
    return _pair_columns(truth(spark, sf, "customers", INNER, 2))


def exact_hamming(spark, sf):
    pairs = truth(spark, sf, "documents", JACCARD, 0.1)
    ham = exact_similarity("hamming_distance", F.col("overlap"), F.col("card_i"), F.col("card_j"))
    return pairs.select("i", "j", "n_pairs", ham.alias("hamming_distance"))


def exact_pair_list(spark, sf):
    sets = customer_sets(spark, sf)
    pairs = sample_pairs(sets.docs, 500, SEED)
    return rounded(exact_pairs(sets, pairs, INNER, "hamming_distance", JACCARD, COSINE))


def query_train_exact(spark, sf):
    pairs = split_truth(spark, sf, "documents", JACCARD, min(FIND_THRESHOLDS))
    return rounded(pairs.select("i", "j", "n_pairs", "sim"))


def query_train_inner_product(spark, sf):
    pairs = split_truth(spark, sf, "customers", INNER, 3)
    return rounded(pairs.select("i", "j", "n_pairs", "sim"))


# ---- Hamming distance, from above ----


def hamming_pairs(spark, sf):
    return near_sets(classes(spark, sf, "documents"), HAMMING_RADIUS).select(
        "i", "j", "overlap", "card_i", "card_j", "n_pairs", "distance"
    )


def hamming_pairs_queries(spark, sf):
    found = near_sets(split_classes(spark, sf, "documents"), HAMMING_RADIUS, two_sided=True)
    return found.select("i", "j", "n_pairs", "distance")


def hamming_neighbors(spark, sf):
    return neighbor_rows(classes(spark, sf, "documents"), HAMMING_RADIUS)


def _sketch_pairs_query(name, algorithm, k, radius, source=classes, two_sided=False):
    def query(spark, sf):
        sets = source(spark, sf, "documents")
        sketches = get_model(algorithm, SEED).mapping(sets.as_sets(), k)
        return near_sketches(sketch_classes(sketches, sets.classes), k, radius, two_sided)

    query.__name__ = name
    return query


hamming_sketch_pairs = _sketch_pairs_query("hamming_sketch_pairs", *SIGN_RADIUS)
hamming_sketch_pairs_bcs = _sketch_pairs_query("hamming_sketch_pairs_bcs", *PARITY_RADIUS)
hamming_sketch_pairs_queries = _sketch_pairs_query("hamming_sketch_pairs_queries", *SIGN_RADIUS, split_classes, True)


# ---- retrieval from sketches ----


def found(spark, sf, algorithm, similarity, threshold, k):
    return once(
        spark, sf, f"found-{algorithm}-{similarity}-{threshold}-{k}",
        lambda: materialize(
            estimated_neighbors(
                get_model(algorithm, SEED), split_classes(spark, sf, "documents"), similarity, threshold, k
            ),
            "found",
        ),
    )


def _found_query(name, algorithm, similarity, threshold, k):
    def query(spark, sf):
        pairs = found(spark, sf, algorithm, similarity, threshold, k)
        return rounded(pairs.select("i", "j", "n_pairs", "est"))

    query.__name__ = name
    return query


query_train_binsketch = _found_query("query_train_binsketch", "BinSketch", JACCARD, 0.2, 1000)
query_train_bcs = _found_query("query_train_bcs", "BCS", JACCARD, 0.2, 1000)
query_train_minhash = _found_query("query_train_minhash", "MinHash", JACCARD, 0.2, 64)
query_train_simhash = _found_query("query_train_simhash", "SimHash", COSINE, 0.8, 128)


def _tiled_query(name, algorithm, similarity, threshold, k):
    def query(spark, sf):
        found = tiled_neighbors(get_model(algorithm, SEED), split_classes(spark, sf, "documents"), similarity, threshold, k)
        return rounded(found.select("i", "j", "n_pairs", "est"))

    query.__name__ = name
    return query


query_train_low = tuple(_tiled_query(name, *what) for name, what in LOW_QUERIES.items())


# ---- filters, neighbours, profiles ----


def filter_reports(spark, sf):
    pairs = truth(spark, sf, "documents", JACCARD, 0.1)
    return rounded(reduce(
        DataFrame.unionByName, [filter_report(pairs, 0.5, c) for c in COMPARISONS]
    ))


def filter_pairs(spark, sf):
    kept = filter_by_threshold(truth(spark, sf, "documents", JACCARD, 0.1), 0.15, "gt")
    return rounded(kept.select("i", "j", "sim"))


def filter_retrieval(spark, sf):
    pairs = split_truth(spark, sf, "documents", JACCARD, min(FIND_THRESHOLDS))
    return rounded(retrieval_filter(pairs, 0.5))


def _all_customer_pairs(spark, sf):
    """How often each similarity of customers that share a part occurs, and the number of all pairs."""
    n_rows = customer_sets(spark, sf).docs.agg(F.count("*").alias("n"))

    def build():
        return materialize(similarity_histogram(classes(spark, sf, "customers"), JACCARD), "histogram")

    return once(spark, sf, "customer-histogram", build), pair_universe(n_rows)


def _all_query_train_pairs(spark, sf):
    sizes = split_classes(spark, sf, "customers").classes.agg((F.sum("n_left") * F.sum("n_right")).alias("n_pairs"))

    def build():
        return materialize(similarity_histogram(split_classes(spark, sf, "customers"), JACCARD, two_sided=True), "histogram")

    return once(spark, sf, "query-train-histogram", build), sizes


def _universe_reports(pairs, universe):
    return rounded(reduce(DataFrame.unionByName, [filter_report(pairs, SHARE, c, universe) for c in COMPARISONS]))


def filter_universe(spark, sf):
    return _universe_reports(*_all_customer_pairs(spark, sf))


def filter_retrieval_reports(spark, sf):
    return _universe_reports(*_all_query_train_pairs(spark, sf))


def _retrieval_filter_query(comparison):
    def query(spark, sf):
        return rounded(retrieval_filter(split_truth(spark, sf, "customers", JACCARD, 0.0, "gt"), SHARE, comparison))

    query.__name__ = f"filter_retrieval_{comparison}"
    return query


filter_retrieval_by = tuple(_retrieval_filter_query(c) for c in COMPARISONS)


def profile_universe(spark, sf):
    return rounded(pair_profile(*_all_customer_pairs(spark, sf)))


def threshold_report_universe(spark, sf):
    pairs, universe = _all_customer_pairs(spark, sf)
    return rounded(threshold_report(pairs, SHARE_THRESHOLDS, universe))


def threshold_report_queries(spark, sf):
    pairs, universe = _all_query_train_pairs(spark, sf)
    n_query = split_classes(spark, sf, "customers").classes.agg(F.sum("n_left"))
    return rounded(threshold_report(pairs, SHARE_THRESHOLDS, universe, n_query))


def profile_queries(spark, sf):
    return rounded(pair_profile(*_all_query_train_pairs(spark, sf)))


def neighbors_grid(spark, sf):
    pairs = split_truth(spark, sf, "documents", JACCARD, min(FIND_THRESHOLDS)).select("i", "j", "n_pairs", "sim")
    return rounded(neighbors_by_threshold(pairs, FIND_THRESHOLDS))


def neighbors_summary(spark, sf):
    pairs = split_truth(spark, sf, "documents", JACCARD, min(FIND_THRESHOLDS))
    n_query = split_classes(spark, sf, "documents").classes.agg(F.sum("n_left"))
    return rounded(neighbor_counts(pairs, FIND_THRESHOLDS, n_query))


def truth_profile(spark, sf):
    return rounded(pair_profile(truth(spark, sf, "documents", JACCARD, 0.1)))


def truth_thresholds(spark, sf):
    return rounded(threshold_report(truth(spark, sf, "documents", JACCARD, 0.1)))


def max_similarity_sampled(spark, sf):
    return rounded(max_sampled_similarity(customer_sets(spark, sf), INNER, 1000, SEED))


def max_similarity_exact(spark, sf):
    return rounded(max_similarity(classes(spark, sf, "customers"), INNER))


def thresholds_exact(spark, sf):
    return rounded(suggested_thresholds(max_similarity(classes(spark, sf, "customers"), INNER)))


def top_pairs_documents(spark, sf):
    return rounded(top_pairs(classes(spark, sf, "documents"), JACCARD, TOP))


def top_pairs_customers(spark, sf):
    return rounded(top_pairs(classes(spark, sf, "customers"), COSINE, TOP))


def histogram_documents(spark, sf):
    # similarities are exact fractions: equal ones stay equal when they are rounded
    return rounded(similarity_histogram(classes(spark, sf, "documents"), COSINE), 12)


def thresholds_suggested(spark, sf):
    return rounded(suggested_thresholds(max_sampled_similarity(customer_sets(spark, sf), INNER, 1000, SEED)))


# ---- evaluation jobs ----


def _error_grid(spark, sf, metric):
    sets, pairs = classes(spark, sf, "documents"), truth(spark, sf, "documents", JACCARD, min(ERROR_THRESHOLDS))
    cells = [
        accuracy_grid(sets, [algorithm], ERROR_THRESHOLDS, JACCARD, metric, lengths, SEED, pairs)
        for algorithm, lengths in ERROR_CELLS.items()
    ]
    return reduce(DataFrame.unionByName, cells)


def exp1_error_grid(spark, sf):
    grid = once(spark, sf, "exp1-mse", lambda: materialize(_error_grid(spark, sf, "mse"), "exp1"))
    return rounded(grid)


def exp1_minus_log_mse(spark, sf):
    return rounded(_error_grid(spark, sf, "minus_log_mse"))


def exp1_default_lengths(spark, sf):
    """The whole default grid of lengths: sketches of an algorithm come from one pass over the items."""
    sets, pairs = classes(spark, sf, "documents"), truth(spark, sf, "documents", JACCARD, min(ERROR_THRESHOLDS))
    return rounded(accuracy_grid(sets, ["BinSketch", "BCS"], ERROR_THRESHOLDS, JACCARD, "mse", DEFAULT_LENGTHS, SEED, pairs))


def exp1_lane_lengths(spark, sf):
    sets, pairs = classes(spark, sf, "documents"), truth(spark, sf, "documents", COSINE, min(LANE_THRESHOLDS))
    return rounded(accuracy_grid(sets, ["MinHash", "SimHash"], LANE_THRESHOLDS, COSINE, "mse", LANE_LENGTHS, SEED, pairs))


def retrieval_grid_lengths(spark, sf):
    sets, pairs = split_classes(spark, sf, "documents"), split_truth(spark, sf, "documents", JACCARD, min(GRID_THRESHOLDS))
    return rounded(retrieval_grid(sets, ["BCS"], GRID_THRESHOLDS, JACCARD, "f1", LANE_LENGTHS, SEED, pairs))


def algorithm_errors(spark, sf):
    pairs = truth(spark, sf, "documents", COSINE, 0.3)
    return rounded(algorithm_accuracy(
        classes(spark, sf, "documents"), "SimHash", pairs, [128, 256], COSINE, "mse", SEED
    ))


def _outcomes(spark, sf, similarity, thresholds, cells):
    def build():
        pairs = split_truth(spark, sf, "documents", similarity, min(thresholds))
        parts = [
            query_outcomes(pairs, found(spark, sf, a, similarity, min(thresholds), k), thresholds)
            .select(F.lit(a).alias("algo"), F.lit(k).cast("bigint").alias("k"), "*")
            for a, k in cells
        ]
        return materialize(reduce(DataFrame.unionByName, parts), "outcomes")

    return once(spark, sf, f"outcomes-{similarity}", build)


def _retrieval(name, metric, similarity=JACCARD, thresholds=FIND_THRESHOLDS, cells=FIND_CELLS):
    def query(spark, sf):
        n_query = split_classes(spark, sf, "documents").classes.agg(F.sum("n_left"))
        outcomes = _outcomes(spark, sf, similarity, thresholds, cells)
        return rounded(summarize(outcomes, metric, n_query, "algo", "k"))

    query.__name__ = name
    return query


retrieval_precision = _retrieval("retrieval_precision", "precision")
retrieval_recall = _retrieval("retrieval_recall", "recall")
retrieval_f1 = _retrieval("retrieval_f1", "f1")
retrieval_accuracy = _retrieval("retrieval_accuracy", "accuracy")
retrieval_f1_cosine = _retrieval("retrieval_f1_cosine", "f1", COSINE, SIGN_THRESHOLDS, SIGN_CELLS)


def retrieval_grid_jaccard(spark, sf):
    sets, pairs = split_classes(spark, sf, "documents"), split_truth(spark, sf, "documents", JACCARD, min(GRID_THRESHOLDS))
    cells = [retrieval_grid(sets, [a], GRID_THRESHOLDS, JACCARD, "f1", [k], SEED, pairs) for a, k in GRID_CELLS]
    return rounded(reduce(DataFrame.unionByName, cells))


def retrieval_grid_low(spark, sf):
    sets, pairs = split_classes(spark, sf, "documents"), split_truth(spark, sf, "documents", JACCARD, min(LOW_THRESHOLDS))
    cells = [retrieval_grid(sets, [a], LOW_THRESHOLDS, JACCARD, "f1", [k], SEED, pairs) for a, k in LOW_CELLS]
    return rounded(reduce(DataFrame.unionByName, cells))


def retrieval_grid_cosine(spark, sf):
    sets = split_classes(spark, sf, "documents")
    return rounded(retrieval_grid(sets, ["SimHash"], SIGN_GRID_THRESHOLDS, COSINE, "f1", [128], SEED))


def retrieval_counts(spark, sf):
    outcomes = _outcomes(spark, sf, JACCARD, FIND_THRESHOLDS, FIND_CELLS)
    return outcomes.groupBy("algo", "k", "threshold").agg(
        *[F.sum(F.col(c) * F.col("n_queries")).alias(c) for c in ("tp", "fp", "fn")]
    )


def sampled_pair_errors(spark, sf):
    def build():
        return materialize(sampled_errors(customer_sets(spark, sf), k=50, n_pairs=200, seed=SEED), "sampled")

    errors = once(spark, sf, "sampled-errors", build)
    # a relative error divides by 1e-10 where the truth is 0: report it per unit of 1e10
    return rounded(errors.withColumn("relative_error", F.col("relative_error") * 1e-10))


def best_algorithm(spark, sf):
    def build():
        return materialize(sampled_errors(customer_sets(spark, sf), k=50, n_pairs=200, seed=SEED), "sampled")

    return rounded(best_algorithms(once(spark, sf, "sampled-errors", build)))


# ---- saved truth, saved sets, random sets of the same shape ----


def truth_job_accuracy(spark, sf):
    """Saved from a low threshold up, asked again for a higher one, which the saved table covers."""
    path = once(spark, sf, "accuracy-truth", lambda: scratch_path(spark, "accuracy-truth"))
    accuracy_truth(customer_sets(spark, sf), COSINE, 0.05, path, "customers")
    return _pair_columns(accuracy_truth(customer_sets(spark, sf), COSINE, 0.1, path, "customers"))


def truth_job_retrieval(spark, sf):
    path = once(spark, sf, "retrieval-truth", lambda: scratch_path(spark, "retrieval-truth"))
    for threshold in (0.05, 0.1):
        pairs, _ = retrieval_truth(customer_sets(spark, sf), COSINE, threshold, path, "customers", TRAIN_RATIO, SEED)
    return rounded(pairs.select("i", "j", "n_pairs", "sim"))


def filtered_truth_saved(spark, sf):
    """The kept pairs and the report of a filter, read back from JSON lines."""
    def build():
        path, pairs = scratch_path(spark, "filtered"), truth(spark, sf, "documents", JACCARD, 0.1)
        save_filtered_truth(filter_by_threshold(pairs, 0.5, "ge"), filter_report(pairs, 0.5, "ge"), path)
        return path

    path = once(spark, sf, "filtered", build)
    report = spark.read.schema("total_pairs bigint, filtered_count bigint").json(f"{path}/report")
    kept = spark.read.schema("i bigint, j bigint, n_pairs bigint, sim double").json(f"{path}/pairs")
    return rounded(kept.join(F.broadcast(report), F.lit(True)))


def sets_saved(spark, sf):
    """Sets of customers, written as a matrix is and loaded again."""
    def build():
        path = scratch_path(spark, "sets")
        save_sets(customer_sets(spark, sf), path)
        return path

    return load_sets(spark, once(spark, sf, "saved-sets", build)).items


def _twin(spark, sf):
    return once(
        spark, sf, "customers-twin", lambda: synthetic_like(customer_sets(spark, sf), SEED).materialize("customers-twin")
    )


def synthetic_items(spark, sf):
    return _twin(spark, sf).items


def synthetic_pair_errors(spark, sf):
    """Estimates on random sets of the customers' shape, where hardly any pair is similar."""
    errors = sampled_errors(_twin(spark, sf), k=50, n_pairs=200, seed=SEED)
    return rounded(errors.withColumn("relative_error", F.col("relative_error") * 1e-10))


REGISTERED = (
    vocab_min_df, items_binary, items_customers, binarize_discounts, binary_check, coo_export, doc_sets,
    row_items, summary, corner_preview, first_documents, docword_roundtrip, split_sides, split_validity,
    binsketch_map_balance, bcs_map, binsketch_sketch, binsketch_sketch_long, bcs_sketch, bcs_sketch_long,
    minhash_signature, simhash_sketch, binsketch_estimates, bcs_estimates, minhash_estimates,
    simhash_estimates, exact_jaccard, exact_cosine, exact_inner_product, exact_hamming, exact_pair_list,
    query_train_exact, query_train_binsketch, query_train_bcs, query_train_minhash, query_train_simhash,
    filter_reports, filter_pairs, filter_retrieval, neighbors_grid, neighbors_summary, truth_profile,
    truth_thresholds, max_similarity_sampled, thresholds_suggested, exp1_error_grid, exp1_minus_log_mse,
    algorithm_errors, retrieval_precision, retrieval_recall, retrieval_f1, retrieval_accuracy,
    retrieval_f1_cosine, retrieval_counts, sampled_pair_errors, best_algorithm,
    query_train_inner_product, filter_universe, filter_retrieval_reports, *filter_retrieval_by,
    profile_universe, profile_queries, threshold_report_universe, threshold_report_queries,
    retrieval_grid_jaccard, retrieval_grid_cosine,
    hamming_pairs, hamming_pairs_queries, hamming_neighbors, hamming_sketch_pairs, hamming_sketch_pairs_bcs,
    hamming_sketch_pairs_queries, *query_train_low, retrieval_grid_low,
    max_similarity_exact, thresholds_exact, top_pairs_documents, top_pairs_customers, histogram_documents,
    exp1_default_lengths, exp1_lane_lengths, retrieval_grid_lengths, truth_after_append,
    truth_job_accuracy, truth_job_retrieval, filtered_truth_saved, sets_saved, synthetic_items, synthetic_pair_errors,
)


def queries():
    return {q.__name__: q for q in REGISTERED}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to word sets, sketches, exact pairs, estimates and their error."""
    return rounded(accuracy_grid(
        classes(spark, sf, "documents"), ["BinSketch"], [0.2, 0.5], JACCARD, "mse", [256], SEED
    ))
