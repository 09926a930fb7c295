import math
import statistics

import pytest

from bitfold.operators.classes import collapse_copies
from bitfold.operators.overlap import similar_pairs
from bitfold.operators.pairs import filter_report
from bitfold.operators.profile import pair_profile, pair_universe, threshold_report
from bitfold.operators.sketches import get_model
from bitfold.operators.split import train_query_split
from bitfold.plans.accuracy import accuracy_grid, algorithm_accuracy
from bitfold.plans.retrieval import retrieval_grid
from bitfold.plans.sampled import best_algorithms, sampled_errors
from bitfold.plans.truth import accuracy_truth, retrieval_filter, retrieval_truth
from tests.brute import estimate, similarity

JACCARD = "jaccard_similarity"


def sketches(algorithm, sets, k):
    return {r["doc_id"]: list(r["sketch"]) for r in get_model(algorithm).mapping(sets, k).collect()}


@pytest.mark.parametrize("metric", ["mse", "minus_log_mse"])
def test_accuracy_grid_matches_brute_force(make_sets, random_rows, metric):
    rows, thresholds = random_rows(n=40), [0.2, 0.6, 1.0]
    sets = make_sets(rows, 150)
    got = accuracy_grid(collapse_copies(sets), ["BinSketch", "MinHash"], thresholds, JACCARD, metric, [64])
    got = {(r["algo"], r["threshold"]): (r["n_pairs"], r["score"]) for r in got.collect()}
    ids = sorted(rows)
    every = [(x, y, similarity(JACCARD, rows[x], rows[y])) for n, x in enumerate(ids) for y in ids[n + 1:]]
    expected = {}
    for algorithm in ("BinSketch", "MinHash"):
        raw = sketches(algorithm, sets, 64)
        for t in thresholds:
            errors = [(estimate(algorithm, JACCARD, raw[x], raw[y], 64) - s) ** 2 for x, y, s in every if s > t]
            if errors:
                score = sum(errors) / len(errors)
                if metric == "minus_log_mse":
                    score = -math.log(score) if score else -math.log(1e-10)
                expected[(algorithm, t)] = (len(errors), pytest.approx(score))
    assert got == expected  # no row for 1.0: no pair is above it


def test_one_algorithm_over_given_pairs(make_sets, random_rows):
    sets = collapse_copies(make_sets(random_rows(n=30), 150))
    pairs = similar_pairs(sets, JACCARD, 0.4, "gt")
    alone = {r["k"]: r["score"] for r in algorithm_accuracy(sets, "BCS", pairs, [50, 90], JACCARD).collect()}
    grid = accuracy_grid(sets, ["BCS"], [0.4], JACCARD, "mse", [50, 90])
    assert alone == {r["k"]: pytest.approx(r["score"]) for r in grid.collect()}


@pytest.mark.parametrize("metric", ["precision", "recall", "f1", "accuracy"])
def test_retrieval_grid_matches_brute_force(make_sets, random_rows, metric):
    rows, thresholds = random_rows(n=40), [0.3, 0.7, 1.5]
    sets = make_sets(rows, 150)
    split = train_query_split(sets.docs, 0.7, 42)
    side = {r["doc_id"]: r["side"] for r in split.collect()}
    queries, train = ([d for d in rows if side[d] == s] for s in ("query", "train"))
    got = retrieval_grid(collapse_copies(sets, split), ["BinSketch", "MinHash"], thresholds, JACCARD, metric, [64])
    got = {(r["algo"], r["threshold"]): tuple(r[3:]) for r in got.collect()}
    expected = {}
    for algorithm in ("BinSketch", "MinHash"):
        raw = sketches(algorithm, sets, 64)
        for t in thresholds:
            scores, counts = [], []
            for q in queries:
                true = {d for d in train if similarity(JACCARD, rows[q], rows[d]) >= t}
                hits = {d for d in train if estimate(algorithm, JACCARD, raw[q], raw[d], 64) >= t}
                tp, fp, fn = len(true & hits), len(hits - true), len(true - hits)
                counts.append(len(true))
                scores.append({
                    "precision": tp / (tp + fp) if hits else float(not true),
                    "recall": tp / (tp + fn) if true else 1.0,
                    "f1": 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 1.0,
                    "accuracy": tp / (tp + fp + fn) if tp + fp + fn else 1.0,
                }[metric])
            expected[(algorithm, t)] = (
                pytest.approx(sum(counts) / len(queries)), sum(counts),
                pytest.approx(statistics.mean(scores)), pytest.approx(statistics.pstdev(scores), abs=1e-7),
            )
    assert got == expected


def test_unknown_names_fail_before_any_job(make_sets):
    sets = collapse_copies(make_sets({0: {1}, 1: {1}}, 2))
    for call in (
        lambda: accuracy_grid(sets, ["SimHash"], [0.1], JACCARD),
        lambda: accuracy_grid(sets, ["BCS"], [0.1], JACCARD, "rmse"),
        lambda: retrieval_grid(sets, ["Nope"], [0.1], JACCARD),
        lambda: retrieval_grid(sets, ["BCS"], [0.1], JACCARD, "map"),
    ):
        with pytest.raises(ValueError):
            call()


def test_sampled_errors_cover_the_default_map(make_sets, random_rows):
    results = sampled_errors(make_sets(random_rows(n=30), 150), k=200, n_pairs=40)
    rows = results.collect()
    assert len(rows) == 9 and {r["compression_ratio"] for r in rows} == {0.75}
    wide = [r for r in rows if r["algorithm"] == "BinSketch" and r["metric"] == "inner_product"][0]
    assert wide["mae"] < 1.5  # k above the vocabulary: close to exact
    best = best_algorithms(results).first()
    assert best["best_mse"] == min(r["mse"] for r in rows)


def test_error_shrinks_with_k(spark):
    from bitfold.sources.tables import synthetic_sets

    sets = synthetic_sets(spark, 60, 400, 0.05, 1)
    mae = {
        k: sampled_errors(sets, k, 200, ["BCS"], ["inner_product"]).first()["mae"] for k in (20, 2000)
    }
    assert mae[2000] < mae[20]


def test_saved_truth_is_reused(spark, make_sets, random_rows, tmp_path):
    sets = make_sets(random_rows(n=20), 150)
    path = str(tmp_path / "truth")
    first = accuracy_truth(sets, JACCARD, 0.3, path, "demo")
    n = first.count()
    wider = accuracy_truth(sets, JACCARD, 0.1, path, "demo").count()
    assert wider > n > 0  # a truth searched down to 0.3 does not serve 0.1
    assert accuracy_truth(sets, JACCARD, 0.3, path, "demo").count() == n  # a wider one is filtered
    nothing = make_sets({0: {1}}, 150)
    assert accuracy_truth(nothing, JACCARD, 0.3, path, "demo").count() == 0  # another input is found anew

    pairs, split = retrieval_truth(sets, JACCARD, 0.3, str(tmp_path / "qt"), "demo")
    n = pairs.count()
    assert retrieval_truth(sets, JACCARD, 0.1, str(tmp_path / "qt"), "demo")[0].count() > n
    again, _ = retrieval_truth(sets, JACCARD, 0.3, str(tmp_path / "qt"), "demo")
    assert again.count() == n
    other, other_split = retrieval_truth(sets, JACCARD, 0.3, str(tmp_path / "qt"), "demo", seed=7)
    expected = similar_pairs(collapse_copies(sets, other_split), JACCARD, 0.3, two_sided=True)
    assert other.count() == expected.count()  # a different split is recomputed


def test_narrow_truth_is_refused(make_sets, random_rows):
    sets = make_sets(random_rows(n=20), 150)
    classes = collapse_copies(sets)
    narrow = similar_pairs(classes, JACCARD, 0.8, "gt")
    with pytest.raises(ValueError):
        accuracy_grid(classes, ["BCS"], [0.1, 0.8], JACCARD, lengths=[50], truth=narrow)
    split = collapse_copies(sets, train_query_split(sets.docs, 0.7, 42))
    with pytest.raises(ValueError):
        retrieval_grid(split, ["BCS"], [0.1, 0.8], JACCARD, lengths=[50], truth=similar_pairs(split, JACCARD, 0.8, two_sided=True))
    universe = pair_universe(sets.docs.groupBy().count().withColumnRenamed("count", "n"))
    with pytest.raises(ValueError):
        pair_profile(narrow, universe)
    with pytest.raises(ValueError):
        filter_report(narrow, 0.2, "le", universe=190)
    assert filter_report(narrow, 0.9, "ge", universe=190).first()["total_pairs"] == 190


def test_filters_and_reports_over_all_pairs(make_sets, random_rows):
    rows = random_rows(n=20)
    sets = make_sets(rows, 150)
    ids = sorted(rows)
    every = [similarity(JACCARD, rows[x], rows[y]) for n, x in enumerate(ids) for y in ids[n + 1:]]
    pairs = similar_pairs(collapse_copies(sets), JACCARD, 0.0, "gt")
    universe = pair_universe(sets.docs.groupBy().count().withColumnRenamed("count", "n"))
    t = sorted(every)[len(every) // 2] or 0.1
    wanted = {"ge": lambda s: s >= t, "gt": lambda s: s > t, "le": lambda s: s <= t, "lt": lambda s: s < t}
    for comparison, test in wanted.items():
        got = filter_report(pairs, t, comparison, universe).first()
        assert (got["total_pairs"], got["filtered_count"]) == (len(every), sum(map(test, every)))
    report = {r["threshold"]: r["n_at_least"] for r in threshold_report(pairs, [0.2, 0.6], universe).collect()}
    assert report == {v: sum(s >= v for s in every) for v in (0.2, 0.6)}
    profile = pair_profile(pairs, universe).first()
    assert profile["mean_sim"] == pytest.approx(statistics.mean(every))
    assert profile["std_sim"] == pytest.approx(statistics.pstdev(every), rel=1e-9)
    narrow = similar_pairs(collapse_copies(sets), JACCARD, 0.5, "gt")
    for refused in (lambda: threshold_report(narrow, [0.2], universe), lambda: retrieval_filter(narrow, 0.7, "le"),
                    lambda: retrieval_filter(narrow, 0.5, "ge")):
        with pytest.raises(ValueError):
            refused()


def test_spread_of_nearly_equal_values_keeps_its_digits(spark):
    values = [0.5 + k * 1e-9 for k in range(5)]
    got = pair_profile(spark.createDataFrame([(v, 3) for v in values], "sim double, n_pairs bigint")).first()
    assert got["std_sim"] == pytest.approx(statistics.pstdev(values), rel=1e-6)


def test_error_sums_are_written_length_by_length(make_sets, random_rows, monkeypatch):
    from bitfold.plans import accuracy

    written, write = [], accuracy.materialize
    monkeypatch.setattr(accuracy, "materialize", lambda df, name: written.append(name) or write(df, name))
    grid = accuracy.accuracy_grid(collapse_copies(make_sets(random_rows(n=20), 150)), ["BCS"], [0.2, 0.5], "jaccard_similarity", "mse", [20, 70])
    assert written.count("error-sums") == 2
    assert {(r["k"], r["threshold"]) for r in grid.collect()} == {(k, t) for k in (20, 70) for t in (0.2, 0.5)}
