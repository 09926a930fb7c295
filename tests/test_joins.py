import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitfold.operators import cells, histogram, overlap, pairs, postings, profile
from bitfold.operators.classes import collapse_copies
from bitfold.operators.overlap import similar_pairs
from bitfold.operators.retrieve import estimated_neighbors, least_shared
from bitfold.operators.sketches import get_model
from bitfold.operators.split import same_split, train_query_split
from tests.brute import estimate, or_overlap, or_size, similarity


def class_of(rows):
    first = {}
    for d in sorted(rows):
        first.setdefault(frozenset(rows[d]), d)
    return {d: first[frozenset(rows[d])] for d in rows}


def weighted(found):
    out = {}
    for x, y, sim in found:
        n, _ = out.get((x, y), (0, 0))
        out[(x, y)] = (n + 1, pytest.approx(sim))
    return out


def brute_self(rows, name, keep):
    rep = class_of(rows)
    ids = sorted(rows)
    return weighted(
        (min(rep[x], rep[y]), max(rep[x], rep[y]), similarity(name, rows[x], rows[y]))
        for n, x in enumerate(ids) for y in ids[n + 1:] if keep(similarity(name, rows[x], rows[y]))
    )


def collected(df, value):
    return {(r["i"], r["j"]): (r["n_pairs"], r[value]) for r in df.collect()}


@pytest.mark.parametrize("name,threshold,comparison,block_rows,min_shared", [
    ("jaccard_similarity", 0.3, "gt", 2_048, 8), ("jaccard_similarity", 0.5, "ge", 5, 1),
    ("cosine_similarity", 0.5, "gt", 5, 2), ("inner_product", 4, "gt", 5, 1),
    ("inner_product", 4, "ge", 2_048, 8), ("jaccard_similarity", 0.0, "gt", 5, 1),
])
def test_similar_pairs_match_brute_force(make_sets, random_rows, monkeypatch, name, threshold, comparison, block_rows, min_shared):
    monkeypatch.setattr(postings, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(overlap, "MIN_SHARED", min_shared)
    rows = random_rows(seed=int(threshold * 10))
    got = collected(similar_pairs(collapse_copies(make_sets(rows, 150)), name, threshold, comparison), "sim")
    keep = (lambda s: s > threshold) if comparison == "gt" else (lambda s: s >= threshold)
    assert got == brute_self(rows, name, keep)


def test_huge_sets_are_verified_in_chunks(make_sets, random_rows, monkeypatch):
    monkeypatch.setattr(overlap, "chunk_count", lambda largest: 3)
    rows = random_rows()
    got = collected(similar_pairs(collapse_copies(make_sets(rows, 150)), "jaccard_similarity", 0.3), "sim")
    assert got == brute_self(rows, "jaccard_similarity", lambda s: s >= 0.3)


def test_copies_form_one_class(make_sets, random_rows):
    rows = random_rows()
    classes = collapse_copies(make_sets(rows, 150))
    assert {r["doc_id"]: r["class_id"] for r in classes.members.collect()} == class_of(rows)
    sizes = {r["doc_id"]: r["n_left"] for r in classes.classes.collect()}
    assert sizes[0] == sum(rows[d] == rows[0] for d in rows) and sum(sizes.values()) == len(rows)


def test_thresholds_that_list_every_pair_are_refused(make_sets):
    classes = collapse_copies(make_sets({0: {1}}, 2))
    for threshold, comparison in ((0, "ge"), (-1, "gt"), (0.5, "le")):
        with pytest.raises(ValueError):
            similar_pairs(classes, "jaccard_similarity", threshold, comparison)
    with pytest.raises(ValueError):
        similar_pairs(classes, "hamming_distance", 3)


@pytest.mark.parametrize("algorithm,name,threshold,k", [
    ("BinSketch", "jaccard_similarity", 0.2, 100), ("BinSketch", "cosine_similarity", 0.6, 100),
    ("BinSketch", "inner_product", 5, 40),
    ("BCS", "jaccard_similarity", 0.3, 100), ("BCS", "cosine_similarity", 0.5, 64), ("BCS", "inner_product", 3, 64),
    ("MinHash", "jaccard_similarity", 0.4, 32), ("MinHash", "cosine_similarity", 0.5, 70),
    ("SimHash", "cosine_similarity", 0.7, 70), ("SimHash", "cosine_similarity", 1.0, 200),
])
def test_estimated_neighbors_match_brute_force(make_sets, random_rows, monkeypatch, algorithm, name, threshold, k):
    monkeypatch.setattr(postings, "BLOCK_ROWS", 6)
    rows = random_rows(n=40, seed=k)
    sets = make_sets(rows, 150)
    split = train_query_split(sets.docs, 0.6, 3)
    side = {r["doc_id"]: r["side"] for r in split.collect()}
    model = get_model(algorithm)
    raw = {r["doc_id"]: list(r["sketch"]) for r in model.mapping(sets, k).collect()}
    rep = class_of(rows)
    expected = weighted(
        (rep[q], rep[t], est)
        for q in rows if side[q] == "query" for t in rows if side[t] == "train"
        for est in [estimate(algorithm, name, raw[q], raw[t], k)] if est >= threshold
    )
    got = estimated_neighbors(model, collapse_copies(sets, split), name, threshold, k)
    assert collected(got, "est") == expected


@pytest.mark.parametrize("name,threshold", [("jaccard_similarity", 0.25), ("cosine_similarity", 0.4), ("inner_product", 6)])
def test_least_shared_never_rules_out_a_match(name, threshold):
    k = 40
    needs = least_shared("BinSketch", name, k, threshold)
    for c1 in range(1, k + 1):
        for c2 in range(1, k + 1):
            for common in range(max(0, c1 + c2 - k), min(c1, c2) + 1):
                a, b = set(range(c1)), set(range(c1 - common, c1 - common + c2))
                s1, s2, ip = or_size(c1, k), or_size(c2, k), or_overlap(a, b, k)
                est = {
                    "inner_product": ip,
                    "jaccard_similarity": ip / (s1 + s2 - ip) if s1 + s2 - ip else 0.0,
                    "cosine_similarity": ip / (math.sqrt(s1) * math.sqrt(s2)),
                }[name]
                if est >= threshold:
                    assert common >= needs[c1] and common >= needs[c2]


def test_no_cross_join_in_the_candidate_plan(make_sets, random_rows):
    index = overlap.prefix_index(
        collapse_copies(make_sets(random_rows(), 150)).classes.withColumn("need", F.lit(2).cast("bigint")),
        make_sets(random_rows(), 150).items,
    )
    plan = overlap.seen_often_enough(index, False)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_hot_keys_spread_over_cells(spark):
    n = 40
    index = spark.range(n).select(F.lit(1).alias("key"), F.col("id").alias("doc_id"), F.lit(1).alias("n_left"), F.lit(1).alias("n_right"))
    met = postings.meet_on_key(index, "key", "doc_id", ["n_left", "n_right"], block_rows=7)
    got = sorted((r["a"]["doc_id"], r["b"]["doc_id"]) for r in met.collect())
    assert got == [(x, y) for x in range(n) for y in range(x + 1, n)]
    assert met.select("p", "q").distinct().count() > 10


SPLIT_EARLY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture
def early_splits(spark):
    before = {k: spark.conf.get(k) for k in SPLIT_EARLY}
    for k, v in SPLIT_EARLY.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def task_rows(df):
    """Rows that each task of the last join puts out."""
    counts = df.withColumn("part", F.spark_partition_id()).rdd.map(lambda r: (r["part"], 1)).reduceByKey(lambda a, b: a + b).values()
    return sorted(counts.collect())


def test_a_feature_of_every_row_fills_no_single_task(spark, early_splits):
    n = 60_000
    rest = spark.range(n).select((F.col("id") + 10).alias("feature_id"), F.col("id").alias("doc_id"))
    index = spark.range(n).select(F.lit(1).cast("bigint").alias("feature_id"), F.col("id").alias("doc_id")).unionByName(rest).repartition(8)
    found = postings.in_blocks(index, "feature_id", "doc_id", 2_048)
    sizes = task_rows(found)
    assert sum(sizes) == 2 * n and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    df = overlap.materialize(index.groupBy("feature_id").agg(F.count("*").alias("df")), "frequencies")
    sizes = task_rows(index.join(df, "feature_id"))
    assert sum(sizes) == 2 * n and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_split_sizes_are_exact(spark):
    docs = spark.range(103).withColumnRenamed("id", "doc_id")
    split = train_query_split(docs, 0.9, 42)
    assert split.where("side = 'train'").count() == int(103 * 0.9)
    assert same_split(split, train_query_split(docs.repartition(9), 0.9, 42)).first()["is_same"]
    assert not same_split(split, train_query_split(docs, 0.9, 43)).first()["is_same"]


def test_exact_pairs_keep_disjoint_and_empty_rows(spark, make_sets):
    rows = {0: {1, 2}, 1: {2, 3}, 2: {4}, 3: set(), 4: set()}
    listed = [(0, 1), (0, 2), (0, 3), (3, 4), (1, 1)]
    names = ("inner_product", "hamming_distance", "jaccard_similarity", "cosine_similarity")
    got = pairs.exact_pairs(make_sets(rows, 5), spark.createDataFrame(listed, "i bigint, j bigint"), *names)
    for r in got.collect():
        for name in names:
            assert r[name] == pytest.approx(similarity(name, rows[r["i"]], rows[r["j"]]))
    assert got.count() == len(listed)


def test_profile_counts_unlisted_pairs(spark, make_sets, random_rows):
    rows = random_rows(n=20)
    ids = sorted(rows)
    every = sorted(similarity("jaccard_similarity", rows[x], rows[y]) for n, x in enumerate(ids) for y in ids[n + 1:])
    truth = similar_pairs(collapse_copies(make_sets(rows, 150)), "jaccard_similarity", 0, "gt")
    universe = profile.pair_universe(spark.createDataFrame([(len(rows),)], "n bigint"))
    got = profile.pair_profile(truth, universe).first()
    mean = sum(every) / len(every)
    half = len(every) // 2
    median = every[half] if len(every) % 2 else (every[half - 1] + every[half]) / 2
    assert got["n_pairs"] == len(every)
    assert got["min_sim"] == every[0] and got["max_sim"] == pytest.approx(every[-1])
    assert got["mean_sim"] == pytest.approx(mean) and got["median_sim"] == pytest.approx(median)
    assert got["std_sim"] == pytest.approx(math.sqrt(sum((s - mean) ** 2 for s in every) / len(every)))
    for comparison, keep in (("ge", lambda s: s >= 0.3), ("lt", lambda s: s < 0.3), ("le", lambda s: s <= 0.3)):
        report = pairs.filter_report(truth, 0.3, comparison, universe=len(every)).first()
        assert report["filtered_count"] == sum(map(keep, every)) and report["total_pairs"] == len(every)


def test_sampled_pairs(spark):
    docs = spark.range(10).select((F.col("id") * 3).alias("doc_id"))
    drawn = pairs.sample_pairs(docs, 200, 1).collect()
    assert len(drawn) == 200 and {r["i"] for r in drawn} <= set(range(0, 30, 3))
    apart = pairs.sample_pairs(docs, 200, 1, with_replacement=False).collect()
    assert len(apart) == 45 and all(r["i"] != r["j"] for r in apart)


@pytest.mark.parametrize("name,threshold,comparison", [
    ("jaccard_similarity", 0.1, "gt"), ("jaccard_similarity", 0.0, "gt"), ("cosine_similarity", 0.3, "ge"), ("inner_product", 2, "gt"),
])
def test_low_thresholds_list_neither_meetings_nor_candidates(make_sets, random_rows, monkeypatch, name, threshold, comparison):
    def never(*given):
        raise AssertionError("meetings are shuffled")

    monkeypatch.setattr(overlap, "seen_often_enough", never)
    monkeypatch.setattr(overlap, "verified_overlaps", never)
    for what, value in {"TILE_ROWS": 9, "LIST_ROWS": 3, "CELL_IDS": 40, "MAX_CHUNK": 4, "BLOCK": 50}.items():
        monkeypatch.setattr(cells, what, value)
    rows = random_rows(seed=4)
    sets, ids = make_sets(rows, 150), sorted(rows)
    keep = (lambda s: s > threshold) if comparison == "gt" else (lambda s: s >= threshold)
    assert collected(similar_pairs(collapse_copies(sets), name, threshold, comparison), "sim") == brute_self(rows, name, keep)
    split = train_query_split(sets.docs, 0.6)
    side = {r["doc_id"]: r["side"] for r in split.collect()}
    found = similar_pairs(collapse_copies(sets, split), name, threshold, comparison, two_sided=True)
    want = [similarity(name, rows[x], rows[y]) for x in ids for y in ids if (side[x], side[y]) == ("query", "train")]
    assert sum(r["n_pairs"] for r in found.collect()) == sum(map(keep, want))


@pytest.mark.parametrize("n_features", [6, 4_000])
def test_overlaps_are_counted_in_a_table_or_by_sorting(monkeypatch, n_features):
    rng = np.random.RandomState(n_features)
    left, right = ([set(rng.randint(0, n_features, 5).tolist()) for _ in range(60)] for _ in "ab")
    starts, features = np.concatenate(([0], np.cumsum([len(s) for s in left]))), np.array([f for s in left for f in sorted(s)])
    held = sorted((f, r) for r, s in enumerate(right) for f in s)
    met = cells.counted_overlaps((starts, features), (np.array([f for f, _ in held]), np.array([r for _, r in held]), 60), 90)
    got = {(int(a), int(b)): int(n) for part in met for a, b, n in zip(*part)}
    assert got == {(a, b): len(left[a] & right[b]) for a in range(60) for b in range(60) if left[a] & right[b]}


def test_rare_features_are_sent_to_few_cells(make_sets, monkeypatch):
    """Rows that share with one other only: their ids go to two tiles, however many tiles there are."""
    rows = {d: {d // 2 * 3 + k for k in range(3)} | {1_000 + d} for d in range(300)}

    def counting(of_pairs, columns, two_sided, block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = pa.Table.from_batches(list(batches))
            n = sum(len(x) for x, kind in zip(held["ids"].to_pylist(), held["kind"].to_pylist()) if kind == 2)
            yield pa.RecordBatch.from_pydict({"overlap": [1], "size": [n], "n_pairs": [n]})

        return run

    monkeypatch.setattr(cells, "cell_run", counting)
    classes = collapse_copies(make_sets(rows, 2_000))
    found = histogram.met_in_cells(classes.classes, classes.items, ["card", "n_left", "n_right"], None, histogram.SUMS, False, 3)
    sent = [r["n_pairs"] for r in found.collect()]
    assert 0 < sum(sent) <= 300 * 3 * 2


def test_repeated_items_are_shared_once(make_sets):
    """Rows that come twice: their sizes count the repeats, as ever, what two of them share does not."""
    rows = {0: {1, 2, 3, 4}, 1: {1, 2, 3, 5}, 2: {1, 6}}
    sets = make_sets(rows, 8)
    twice = replace(sets, items=sets.items.unionByName(sets.items.where("doc_id < 2")))
    found = similar_pairs(collapse_copies(twice), "jaccard_similarity", 0.05, "gt").collect()
    got = {(r["i"], r["j"]): (r["overlap"], r["card_i"], r["card_j"]) for r in found}
    assert got == {(0, 1): (3, 8, 8), (0, 2): (1, 8, 2), (1, 2): (1, 8, 2)}


def test_short_runs_of_signs_are_not_met(make_sets, random_rows, monkeypatch):
    from bitfold.operators import retrieve

    sets = make_sets(random_rows(), 150)
    classes, model = collapse_copies(sets, train_query_split(sets.docs, 0.6)), get_model("SimHash")

    def pairs():
        rows = estimated_neighbors(model, classes, "cosine_similarity", 0.8, 128)
        return sorted(map(tuple, rows.collect())), rows.dtypes

    by_tiles = pairs()
    monkeypatch.setattr(retrieve, "LEAST_RUN_BITS", 0)
    assert pairs() == by_tiles and by_tiles[0]
    monkeypatch.undo()
    monkeypatch.setattr(retrieve, "_by_equal_runs", None)
    assert pairs() == by_tiles


@pytest.mark.parametrize("algorithm,name,threshold,k", [("BinSketch", "jaccard_similarity", 0.2, 100), ("BCS", "cosine_similarity", 0.4, 64), ("MinHash", "jaccard_similarity", 0.2, 32)])
def test_low_thresholds_of_sketches_are_not_indexed(make_sets, random_rows, monkeypatch, algorithm, name, threshold, k):
    from bitfold.operators import retrieve

    sets = make_sets(random_rows(), 150)
    classes, model = collapse_copies(sets, train_query_split(sets.docs, 0.6)), get_model(algorithm)
    indexed = estimated_neighbors(model, classes, name, threshold, k, method="index")
    want = sorted(map(tuple, indexed.collect()))
    monkeypatch.setattr(retrieve, "_by_shared_tokens", None)
    got = estimated_neighbors(model, classes, name, threshold, k)
    assert sorted(map(tuple, got.collect())) == want and want and got.dtypes == indexed.dtypes


@pytest.mark.parametrize("name,threshold", [("jaccard_similarity", 0.6), ("cosine_similarity", 0.8), ("inner_product", 12)])
def test_candidates_are_counted_in_cells(make_sets, random_rows, monkeypatch, name, threshold):
    """No meeting is listed, and only the sets of candidates are gathered to be verified."""
    monkeypatch.setattr(postings, "meet_on_key", None)
    for what, value in {"TILE_ROWS": 9, "LIST_ROWS": 3, "CELL_IDS": 40, "BLOCK": 50}.items():
        monkeypatch.setattr(cells, what, value)
    rows = random_rows(seed=6) | {900: {140, 141, 142}}
    gathered, gather = [], overlap.aligned_set_arrays
    monkeypatch.setattr(overlap, "aligned_set_arrays", lambda items, n: gathered.append({r["doc_id"] for r in items.collect()}) or gather(items, n))
    got = collected(similar_pairs(collapse_copies(make_sets(rows, 150)), name, threshold, "ge"), "sim")
    assert got == brute_self(rows, name, lambda s: s >= threshold)
    assert not hasattr(overlap, "meet_on_key") and len(gathered) == 1 and 900 not in gathered[0]


def test_frequent_features_are_counted_as_bits(monkeypatch):
    """Where most rows hold a feature its meetings are not listed one by one; repeated items still count as often as they meet."""
    left, right = ([[1, 2, 3 + r % 4, 100 + r] for r in range(40)] for _ in "ab")
    starts, features = np.arange(41) * 4, np.array([f for s in left for f in s])
    held = sorted((f, r) for r, s in enumerate(right) for f in s)
    table = np.array([f for f, _ in held]), np.array([r for _, r in held]), 40
    want = {(a, b): len(set(left[a]) & set(right[b])) for a in range(40) for b in range(40)}
    listed, repeat = [], np.repeat
    monkeypatch.setattr(cells.np, "repeat", lambda *given: listed.append(len(out := repeat(*given))) or out)
    met = list(cells.counted_overlaps((starts, features), table, 1 << 19))
    assert {(int(a), int(b)): int(n) for part in met for a, b, n in zip(*part)} == want
    assert max(listed) < 40 * 40
    few = list(cells.counted_overlaps((starts, features), table, 70, lambda rows: np.full((len(range(40)[rows]), 40), 3)))
    assert {(int(a), int(b)): int(n) for part in few for a, b, n in zip(*part)} == {p: n for p, n in want.items() if n >= 3}
    twice = np.concatenate((features, [1])), np.concatenate((starts[:-1], [161]))
    met = list(cells.counted_overlaps((twice[1], twice[0]), table, 1 << 19))
    assert {(int(a), int(b)): int(n) for part in met for a, b, n in zip(*part)} == {p: n + (p[0] == 39) for p, n in want.items()}


def test_written_tables_leave_no_shuffle_files(make_sets, random_rows, monkeypatch):
    """Each step of a join writes its table with the removal of its shuffle files switched on, and leaves the setting as it was."""
    from bitfold import session

    sets, seen, write = make_sets(random_rows(), 150), set(), session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: seen.add(spark.conf.get(session.CLEANUP_KEY)) or write(spark, name))
    spark = sets.docs.sparkSession
    with session.shuffles_removed(spark):
        session.materialize(sets.items.distinct(), "inside")
    session.materialize(sets.items.distinct(), "outside")
    assert seen == {"true", "false"} and spark.conf.get(session.CLEANUP_KEY) == "false"


@pytest.mark.parametrize("two_sided", [False, True])
def test_cells_are_counted_in_rounds(make_sets, random_rows, monkeypatch, two_sided):
    """Where all cells would be sent many times the items, a few left tiles are counted at a time, with the same pairs."""
    sets, written, write = make_sets(random_rows(seed=4), 150), [], cells.materialize
    classes = collapse_copies(sets, train_query_split(sets.docs, 0.6) if two_sided else None)
    monkeypatch.setattr(cells, "materialize", lambda df, name: written.append(name) or write(df, name))
    found = lambda: sorted(map(tuple, similar_pairs(classes, "jaccard_similarity", 0.1, "gt", two_sided).collect()))
    at_once = found()
    assert at_once and "round" not in written
    for what, value in {"TILE_ROWS": 5, "LIST_ROWS": 3, "ROUND_IDS": 40, "ROUND_SHARE": 0}.items():
        monkeypatch.setattr(cells, what, value)
    assert found() == at_once and written.count("round") > 3


def test_binary_digits_of_counts(monkeypatch):
    rng = np.random.default_rng(3)
    masks = rng.integers(0, 1 << 63, (9, 2), dtype=np.uint64)
    masks[0] = 0
    items = rng.integers(0, 9, (23, 5))
    bits = lambda words: np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")
    want = bits(masks)[items].sum(axis=0)
    digits = cells.added_up(masks, items)
    assert (sum(bits(d).astype(int) << k for k, d in enumerate(digits)) == want).all() and want.max() > 8
    least = rng.integers(0, 40, (5, 2))
    assert (bits(cells.reaching_bits(digits, least)) == (want >= np.repeat(least, 64, axis=1))).all()
    left = [rng.integers(0, 12, rng.integers(1, 30)) for _ in range(70)]
    held = sorted((int(f), r) for r, s in enumerate(left) for f in s)
    table = np.array([f for f, _ in held]), np.array([r for _, r in held]), 70
    starts, features = np.concatenate(([0], np.cumsum([len(s) for s in left]))), np.concatenate(left)
    want = np.array([[sum(np.count_nonzero(a == f) * np.count_nonzero(b == f) for f in range(12)) for b in left] for a in left])
    for frequent in (1, 5):
        monkeypatch.setattr(cells, "FREQUENT", frequent)
        for need in (1, 9, 30):
            met = cells.counted_overlaps((starts, features), table, 5_000, lambda rows: np.full((len(range(70)[rows]), 70), need))
            assert {(int(a), int(b)): int(n) for part in met for a, b, n in zip(*part)} == {(a, b): want[a, b] for a, b in zip(*np.nonzero(want >= need))}


@pytest.mark.parametrize("name,threshold", [("jaccard_similarity", 0.4), ("cosine_similarity", 0.6)])
def test_few_meetings_of_two_sides_are_listed(make_sets, random_rows, monkeypatch, name, threshold):
    """Whether meetings are listed, in blocks of hot features, or counted in cells: the same pairs."""
    sets = make_sets(random_rows(seed=8), 150)
    classes = collapse_copies(sets, train_query_split(sets.docs, 0.6))
    monkeypatch.setattr(postings, "BLOCK_ROWS", 3)
    found = lambda: sorted(map(tuple, similar_pairs(classes, name, threshold, "ge", True).collect()))
    listed = found()
    monkeypatch.setattr(overlap, "FEW_MEETINGS", -1)
    monkeypatch.setattr(postings, "meet_on_key", None)
    assert found() == listed and listed
