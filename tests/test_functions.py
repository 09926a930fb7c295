import math

import pytest
from pyspark.sql import functions as F

from bitfold.functions import scores
from bitfold.functions.estimators import ESTIMATORS, get_estimator, sparsity
from bitfold.functions.hashing import mix32
from bitfold.functions.similarity import compare


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def words(n_set, k, start=0):
    out = [0] * -(-k // 63)
    for p in range(start, start + n_set):
        out[p // 63] |= 1 << (p % 63)
    return out


def lit_words(ws):
    return F.array(*[F.lit(w).cast("bigint") for w in ws])


def estimate(spark, algorithm, similarity, a, b, k):
    card = lambda ws: F.lit(sum(w.bit_count() for w in ws)).cast("bigint")
    return value(spark, get_estimator(algorithm, similarity)(lit_words(a), card(a), lit_words(b), card(b), k))


def test_mix32_is_injective(spark):
    n = 200_000
    assert spark.range(n).select(mix32(F.col("id")).alias("h")).distinct().count() == n


def test_saturated_sketch_keeps_face_value(spark):
    full = words(100, 100)
    assert estimate(spark, "BinSketch", "inner_product", full, full, 100) == 169.0
    assert estimate(spark, "BinSketch", "hamming_distance", full, full, 100) == -138.0
    assert estimate(spark, "BinSketch", "jaccard_similarity", full, full, 100) == pytest.approx(169 / 31)
    assert estimate(spark, "BinSketch", "cosine_similarity", full, full, 100) == pytest.approx(1.69)


def test_sparsity_rounds_half_to_even(spark):
    assert value(spark, F.rint(F.lit(2.5))) == 2.0
    k = 50
    for c in (0, 1, 7, 30, 49, 50):
        expected = round(math.log(1 - c / k) / math.log(1 - 1 / k)) if c < k else c
        assert value(spark, sparsity(F.lit(c), k)) == expected


def test_k_of_one_gives_no_null(spark):
    for similarity in ESTIMATORS["BinSketch"]:
        for a in ([0], [1]):
            for b in ([0], [1]):
                assert estimate(spark, "BinSketch", similarity, a, b, 1) is not None


def test_empty_sketches_have_zero_similarity(spark):
    empty, some = words(0, 100), words(5, 100)
    for algorithm in ("BinSketch", "BCS"):
        for similarity in ("inner_product", "jaccard_similarity", "cosine_similarity"):
            assert estimate(spark, algorithm, similarity, empty, empty, 100) == 0.0
            assert estimate(spark, algorithm, similarity, empty, some, 100) == 0.0
    assert estimate(spark, "MinHash", "jaccard_similarity", [0, 0], [0, 0], 2) == 1.0


@pytest.mark.parametrize("algorithm,similarity", [
    ("MinHash", "inner_product"), ("MinHash", "hamming_distance"), ("SimHash", "jaccard_similarity"),
    ("SimHash", "inner_product"), ("Nope", "jaccard_similarity"), ("BCS", "euclid"),
])
def test_unsupported_estimates_fail_early(algorithm, similarity):
    with pytest.raises(ValueError):
        get_estimator(algorithm, similarity)


def test_long_and_short_forms_agree(spark):
    k = 63 * 30  # above the unrolled limit
    a, b = words(700, k), words(900, k, 300)
    assert estimate(spark, "BCS", "inner_product", a, b, k) == 400.0
    assert estimate(spark, "BCS", "hamming_distance", a, b, k) == 800.0


@pytest.mark.parametrize("metric,tp,fp,fn,expected", [
    ("precision", 0, 0, 0, 1.0), ("recall", 0, 0, 0, 1.0), ("f1", 0, 0, 0, 1.0), ("accuracy", 0, 0, 0, 1.0),
    ("precision", 0, 0, 3, 0.0), ("recall", 0, 0, 3, 0.0), ("f1", 0, 0, 3, 0.0), ("accuracy", 0, 0, 3, 0.0),
    ("precision", 0, 3, 0, 0.0), ("recall", 0, 3, 0, 1.0), ("f1", 0, 3, 0, 0.0), ("accuracy", 0, 3, 0, 0.0),
    ("precision", 2, 2, 1, 0.5), ("recall", 2, 2, 1, 2 / 3), ("f1", 2, 2, 1, 4 / 7), ("accuracy", 2, 2, 1, 0.4),
])
def test_query_scores(spark, metric, tp, fp, fn, expected):
    assert value(spark, scores.query_score(metric, F.lit(tp), F.lit(fp), F.lit(fn))) == pytest.approx(expected)


def test_minus_log_of_a_perfect_estimate_is_capped(spark):
    table = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "est double, gt double")
    est, gt = F.col("est"), F.col("gt")
    assert table.agg(scores.minus_log_mse(est, gt)).first()[0] == pytest.approx(-math.log(1e-10))
    assert table.agg(scores.minus_log_mse(est, gt, cap=False)).first()[0] == math.inf
    off = table.agg(scores.minus_log_mse(est + 1, gt)).first()[0]
    assert off == pytest.approx(0.0)


@pytest.mark.parametrize("comparison,expected", [("ge", True), ("gt", False), ("le", True), ("lt", False), ("eq", True)])
def test_comparison_at_the_threshold(spark, comparison, expected):
    assert value(spark, compare(F.lit(0.5), 0.5, comparison)) is expected


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError):
        compare(F.lit(0.1), 0.5, "ne")
    with pytest.raises(ValueError):
        scores.get_evaluation_metric("rmse")
