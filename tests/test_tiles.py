"""Tiled retrieval against a comparison of all pairs of sketches."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bitfold.operators import tiles
from bitfold.operators.classes import collapse_copies
from bitfold.operators.sketches import get_model
from bitfold.operators.split import train_query_split
from tests.brute import estimate
from tests.test_joins import class_of, collected, weighted

CASES = [
    ("BinSketch", "jaccard_similarity", 0.1, 100), ("BinSketch", "cosine_similarity", 0.57, 30), ("BinSketch", "inner_product", 5, 40),
    ("BinSketch", "hamming_distance", 12, 100), ("BCS", "jaccard_similarity", 0.1, 100), ("BCS", "cosine_similarity", 0.47, 64),
    ("BCS", "inner_product", 3, 64), ("BCS", "hamming_distance", 6, 64), ("MinHash", "jaccard_similarity", 0.1, 32),
    ("MinHash", "cosine_similarity", 0.5, 70), ("SimHash", "cosine_similarity", 0.1, 70), ("SimHash", "hamming_distance", 9, 130),
]


@pytest.mark.parametrize("algorithm,name,threshold,k", CASES)
def test_tiled_neighbors_match_brute_force(make_sets, random_rows, algorithm, name, threshold, k):
    rows = random_rows(n=44, seed=k)
    sets, rep, model = make_sets(rows, 150), class_of(rows), get_model(algorithm)
    raw = {r["doc_id"]: list(r["sketch"]) for r in model.mapping(sets, k).collect()}
    keep = (lambda e: e <= threshold) if name == "hamming_distance" else (lambda e: e >= threshold)
    split = train_query_split(sets.docs, 0.6, 3)
    side = {r["doc_id"]: r["side"] for r in split.collect()}
    expected = weighted(
        (rep[q], rep[t], est)
        for q in rows if side[q] == "query" for t in rows if side[t] == "train"
        for est in [estimate(algorithm, name, raw[q], raw[t], k)] if keep(est)
    )
    assert expected
    got = tiles.tiled_neighbors(model, collapse_copies(sets, split), name, threshold, k, tile_rows=5)
    assert collected(got, "est") == expected
    ids = sorted(rows)
    expected = weighted(
        (min(rep[x], rep[y]), max(rep[x], rep[y]), est)
        for n, x in enumerate(ids) for y in ids[n + 1 :] for est in [estimate(algorithm, name, raw[x], raw[y], k)] if keep(est)
    )
    got = tiles.tiled_neighbors(model, collapse_copies(sets), name, threshold, k, two_sided=False, tile_rows=7)
    assert collected(got, "est") == expected


def test_set_bits_keep_tiles_apart(make_sets):
    rows = {d: set(range(d % 50 + 1)) for d in range(400)} | {d: set(range(60 + d % 40)) for d in range(400, 800)}
    rows = {d: s | {100 + d} for d, s in rows.items()}
    sets = collapse_copies(make_sets(rows, 1000))
    counts = {
        t: tiles.compared_pairs(get_model("BCS"), sets, "jaccard_similarity", t, 900, False, 20).first() for t in (0.1, 0.8)
    }
    assert counts[0.1]["n_all"] == counts[0.8]["n_all"] == 800 * 799 // 2
    assert counts[0.8]["n_compared"] < 0.4 * counts[0.8]["n_all"] and counts[0.8]["n_compared"] < counts[0.1]["n_compared"]


def test_no_table_of_candidates_is_written(make_sets, random_rows, monkeypatch):
    written = []
    monkeypatch.setattr(tiles, "materialize", lambda df, name: written.append(name) or df)
    found = tiles.tiled_neighbors(get_model("BCS"), collapse_copies(make_sets(random_rows(), 150)), "jaccard_similarity", 0.1, 64)
    assert set(written) == {"sketches", "tiles"}
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_thresholds_that_list_every_pair_are_refused(make_sets):
    classes = collapse_copies(make_sets({0: {1}, 1: set()}, 2))
    for threshold in (0, -1):
        with pytest.raises(ValueError):
            tiles.tiled_neighbors(get_model("BCS"), classes, "jaccard_similarity", threshold, 8)
    with pytest.raises(ValueError):
        tiles.tiled_neighbors(get_model("MinHash"), classes, "hamming_distance", 3, 8)
    none = tiles.tiled_neighbors(get_model("BCS"), classes, "jaccard_similarity", 0.5, 8, two_sided=False)
    assert none.isEmpty()


def test_pairs_of_a_cell_leave_block_by_block(monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 100)
    n = 40
    rows = {"p": [0] * 2 * n, "q": [1] * 2 * n, "is_left": [True] * n + [False] * n, "doc_id": range(2 * n), "n": [1] * 2 * n, "card": [3] * 2 * n, "sketch": [[7]] * 2 * n}
    cell = tiles.cell_compare(tiles.PairTest("BCS", "jaccard_similarity", 10, 0.1), False)
    found = list(cell(iter(pa.Table.from_pydict(rows).to_batches())))
    assert max(b.num_rows for b in found) <= 100 and sum(b.num_rows for b in found) == n * n
    assert len(np.unique(np.concatenate([b["i"].to_numpy() * 1000 + b["j"].to_numpy() for b in found]))) == n * n


@pytest.mark.parametrize("algorithm,similarity,k,threshold", [
    ("MinHash", "jaccard_similarity", 300, 0.2), ("MinHash", "cosine_similarity", 20, 0.3),
    ("SimHash", "cosine_similarity", 200, 0.1), ("SimHash", "hamming_distance", 130, 12), ("BCS", "cosine_similarity", 90, 0.4), ("BinSketch", "jaccard_similarity", 90, 0.3),
])
@pytest.mark.parametrize("few", [1, 16])
def test_blocks_of_a_cell_count_what_whole_words_give(monkeypatch, algorithm, similarity, k, threshold, few):
    for what, value in {"BLOCK": 60, "BLOCK_COLUMNS": 7, "FEW": few, "VERIFIED": 3}.items():
        monkeypatch.setattr(tiles, what, value)
    rng = np.random.default_rng(1)
    if algorithm == "MinHash":
        # lanes of equal bytes and unequal values are among them
        words = rng.integers(0, 2, (40, k)) + 2**20 * rng.integers(0, 2, (40, k))
        cards = np.zeros(40, np.int64)
        count = lambda a, b: int((a == b).sum())
        passes = lambda n, a, b: n >= tiles.least_lanes(similarity, k, threshold)
    else:
        base = rng.random((4, k)) < rng.uniform(0.1, 0.9, (4, 1))
        flags = base[rng.integers(0, 4, 40)] ^ (rng.random((40, k)) < 0.05)
        words = np.stack([(flags[:, w : w + 63].astype(np.int64) << np.arange(min(63, k - w))).sum(axis=1) for w in range(0, k, 63)], axis=1)
        cards = flags.sum(axis=1)
        order = np.argsort(cards, kind="stable")
        words, cards = words[order], cards[order]
        if algorithm == "SimHash":
            count = lambda a, b: int(np.bitwise_count(a ^ b).sum())
            passes = lambda n, a, b: n <= tiles.most_differing(similarity, k, threshold)
        else:
            count = lambda a, b: int(np.bitwise_count(a & b).sum())
            passes = lambda n, a, b: n >= test.least(cards[a : a + 1], cards[b : b + 1])[0, 0]
    test = tiles.PairTest(algorithm, similarity, k, threshold)
    side = words, test.lanes(words), cards
    got = [row for a, b, n in tiles.cell_blocks(test, side, side) for row in zip(a.tolist(), b.tolist(), n.tolist())]
    every = [(a, b, count(words[a], words[b])) for a in range(40) for b in range(40)]
    wanted = [row for row in every if passes(row[2], row[0], row[1])]
    assert sorted(got) == wanted and wanted


def test_a_cell_of_wide_tiles_counts_only_rows_that_can_match(monkeypatch):
    counted, hits = [], tiles.PairTest.hits
    monkeypatch.setattr(tiles.PairTest, "hits", lambda self, a, b: counted.append(len(a[0]) * len(b[0])) or hits(self, a, b))
    monkeypatch.setattr(tiles, "BLOCK", 8 * 300)
    words = np.array([[(1 << c // 5) - 1] for c in range(300)])
    test = tiles.PairTest("SimHash", "hamming_distance", 63, 3)
    side = words, test.lanes(words), np.bitwise_count(words[:, 0]).astype(np.int64)
    found = sum(len(a) for a, _, _ in tiles.cell_blocks(test, side, side))
    assert found == sum(abs(c // 5 - d // 5) <= 3 for c in range(300) for d in range(300))
    assert sum(counted) < 300 * 300 // 4


@pytest.mark.parametrize("algorithm,name,k,thresholds", [
    ("BCS", "jaccard_similarity", 40, [0.5, 0.3, 1.5]), ("BinSketch", "cosine_similarity", 64, [0.2, 0.5]),
    ("MinHash", "jaccard_similarity", 20, [0.1, 0.5]), ("SimHash", "cosine_similarity", 60, [0.5, 0.8]),
])
def test_hits_are_summed_up_in_cells(make_sets, random_rows, algorithm, name, k, thresholds):
    sets = make_sets(random_rows(), 150)
    model, classes = get_model(algorithm), collapse_copies(sets, train_query_split(sets.docs, 0.6))
    listed = tiles.tiled_neighbors(model, classes, name, min(thresholds), k, tile_rows=50).select("i", "n_i", "n_j", "est").collect()
    summed = tiles.tiled_hits(model, classes, name, thresholds, k, tile_rows=50).collect()

    def per_query(rows):
        held = Counter()
        for i, n_i, n_j, est in rows:
            held.update({(i, n_i, t): n_j for t in thresholds if est >= t})
        return held

    assert per_query(listed) == per_query(summed) and len(summed) < len(listed)


@pytest.mark.parametrize("algorithm,name,k", [("BCS", "jaccard_similarity", 20), ("BinSketch", "cosine_similarity", 24), ("MinHash", "cosine_similarity", 30), ("SimHash", "cosine_similarity", 90)])
def test_levels_of_sums_are_looked_up(monkeypatch, algorithm, name, k):
    """The table gives the sums of single estimates, and no pair is estimated on its own."""
    rng, n, thresholds = np.random.default_rng(k), 400, [0.3, 0.1, 0.7]
    cards, a, b = rng.integers(1, k, 12), np.sort(rng.integers(0, 12, n)), rng.integers(0, 12, n)
    shared = rng.integers(0, np.minimum(cards[a], cards[b]) + 1)
    estimated, near = [], tiles.estimates_near
    monkeypatch.setattr(tiles, "estimates_near", lambda *given: estimated.append(len(given[3])) or near(*given))

    def summed():
        sums = tiles.LevelSums(tiles.PairTest(algorithm, name, k, 0.1), thresholds, np.arange(12), np.ones(12, np.int64), cards)
        edge = [sums.add(a[part], np.full(len(a[part]), 2), cards[b[part]], shared[part]) for part in (slice(0, 150), slice(150, n))]
        return [np.concatenate([e[c] for e in edge]).tolist() for c in range(7)], [c.tolist() for c in sums.rows()]

    by_table = summed()
    assert n not in estimated and 150 not in estimated and len(estimated) == 1
    monkeypatch.setattr(tiles, "LEVELS", 0)
    assert summed() == by_table and sum(by_table[1][3]) > 0
