"""Sketching and similarity search over large collections of sparse binary sets, on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions sent to executors carry this package's code along, so it need not be installed there
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from bitfold.functions.estimators import get_estimator
from bitfold.operators.classes import SetClasses, collapse_copies
from bitfold.operators.encode import BinarySets, binarize, coordinate_export, encode_relation, encode_text
from bitfold.operators.hamming import near_sets, near_sketches, neighbor_rows, sketch_classes
from bitfold.operators.histogram import similarity_histogram
from bitfold.operators.overlap import similar_pairs
from bitfold.operators.pairs import exact_pairs, filter_report, neighbors_by_threshold, sample_pairs
from bitfold.operators.profile import max_sampled_similarity, pair_profile, suggested_thresholds, threshold_report
from bitfold.operators.retrieve import estimate_pairs, estimated_neighbors
from bitfold.operators.sketches import BinaryCompressionSchema, BinSketch, MinHash, SimHash, get_model
from bitfold.operators.split import same_split, train_query_split
from bitfold.operators.tiles import compared_pairs, tiled_neighbors
from bitfold.operators.top import max_similarity, top_pairs
from bitfold.plans.accuracy import accuracy_grid, algorithm_accuracy
from bitfold.plans.growing import extended_truth, growing_truth
from bitfold.plans.retrieval import retrieval_grid
from bitfold.plans.sampled import best_algorithms, sampled_errors
from bitfold.plans.truth import accuracy_truth, retrieval_truth
from bitfold.sources.bagofwords import encode_text_folder, load_bag_of_words, write_bag_of_words
from bitfold.sources.tables import load_sets, save_results, save_sets, synthetic_like, synthetic_sets

__all__ = [name for name in dir() if not name.startswith("_")]
