import numpy as np
import pytest
from pyspark.sql import functions as F

from bitfold.functions import bits as bit_functions
from bitfold.operators import encode, ranking, sketches
from bitfold.operators.sketches import BinSketch, get_model, sketches_by_length
from tests.brute import bits


def sketch_of(model, sets, k):
    return {r["doc_id"]: list(r["sketch"]) for r in model.mapping(sets, k).collect()}


def test_hash_rank_is_a_dense_permutation(spark):
    ids = spark.range(5000).select((F.col("id") * 7 + 3).alias("key"))
    rows = ranking.hash_rank(ids, "key", 42, "test").collect()
    assert sorted(r["rank"] for r in rows) == list(range(5000))
    assert {r["n_total"] for r in rows} == {5000}
    again = ranking.hash_rank(ids.repartition(13), "key", 42, "test")
    assert {(r["key"], r["rank"]) for r in again.collect()} == {(r["key"], r["rank"]) for r in rows}


def test_ordered_rank_follows_binary_order(spark):
    terms = ["b", "a", "ab", "é", "z", "Z", "0"]
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {r["term"]: r["rank"] for r in ranking.ordered_rank(df, "term").collect()}
    assert got == {t: i for i, t in enumerate(sorted(terms, key=lambda t: t.encode()))}


def test_bucket_sizes_differ_by_at_most_one(spark):
    vocab = spark.range(1000).withColumnRenamed("id", "feature_id")
    counts = [r["count"] for r in BinSketch(7).bucket_map(vocab, 33).groupBy("bucket").count().collect()]
    assert len(counts) == 33 and max(counts) - min(counts) <= 1


@pytest.mark.parametrize("k", [1, 62, 63, 64, 200, 1100])
def test_bit_sketches_match_their_maps(spark, make_sets, random_rows, k):
    rows = random_rows(n=12)
    sets = make_sets(rows, 150)
    for name in ("BinSketch", "BCS"):
        model = get_model(name, 5)
        bucket = {r["feature_id"]: r["bucket"] for r in model.bucket_map(sets.vocab, k).collect()}
        got = sketch_of(model, sets, k)
        assert got.keys() == rows.keys()
        for doc, features in rows.items():
            hits = [bucket[f] for f in features]
            expected = set(hits) if name == "BinSketch" else {b for b in hits if hits.count(b) % 2}
            assert bits(got[doc]) == expected and len(got[doc]) == -(-k // 63)


def test_long_packing_equals_direct_packing(spark, make_sets, random_rows, monkeypatch):
    sets = make_sets(random_rows(n=20), 150)
    direct = sketch_of(get_model("BCS"), sets, 300)
    monkeypatch.setattr(sketches, "DIRECT_WORDS", 0)
    assert sketch_of(get_model("BCS"), sets, 300) == direct


def test_external_bucket_map(spark, make_sets):
    sets = make_sets({0: {0, 2}, 1: {1}}, 3)
    given = spark.createDataFrame([(0, 4), (1, 4), (2, 1)], "feature_id bigint, bucket int")
    assert {d: bits(w) for d, w in sketch_of(BinSketch(bucket_map=given), sets, 5).items()} == {0: {4, 1}, 1: {4}}


def test_minhash_lanes_are_the_minima(spark, make_sets, random_rows):
    rows = random_rows(n=12)
    k = 70
    coefficients = np.random.RandomState(42).randint(1, 2147483647, size=(k, 2)).astype(np.int64)
    got = sketch_of(get_model("MinHash"), make_sets(rows, 150), k)
    for doc, features in rows.items():
        x = np.array(sorted(features), dtype=np.int64)
        expected = [int(((a * x + b) % 2147483647).min()) if len(x) else 0 for a, b in coefficients]
        assert got[doc] == expected


def test_oversized_rows_are_folded_in_chunks(spark, make_sets, random_rows, monkeypatch):
    sets = make_sets(random_rows(n=15), 150)
    whole = {a: sketch_of(get_model(a), sets, 70) for a in ("MinHash", "SimHash")}
    monkeypatch.setattr(encode, "MAX_CHUNK", 4)
    assert encode.set_arrays(sets.items).groupBy("doc_id").count().agg(F.max("count")).first()[0] > 1
    for algorithm, expected in whole.items():
        assert sketch_of(get_model(algorithm), sets, 70) == expected


def test_empty_rows(spark, make_sets):
    sets = make_sets({0: {1}, 1: set()}, 4)
    k = 70
    assert bits(sketch_of(get_model("BinSketch"), sets, k)[1]) == set()
    assert bits(sketch_of(get_model("BCS"), sets, k)[1]) == set()
    assert sketch_of(get_model("MinHash"), sets, k)[1] == [0] * k
    assert bits(sketch_of(get_model("SimHash"), sets, k)[1]) == set(range(k))


def test_simhash_signs_are_balanced_and_track_the_angle(spark, make_sets):
    rows = {0: set(range(200)), 1: set(range(100, 300)), 2: set(range(200))}
    k = 2000
    got = {d: bits(w) for d, w in sketch_of(get_model("SimHash"), make_sets(rows, 300), k).items()}
    assert abs(len(got[0]) / k - 0.5) < 0.06
    assert got[0] == got[2]
    assert abs(np.cos(np.pi * len(got[0] ^ got[1]) / k) - 0.5) < 0.08


def test_sketches_do_not_depend_on_partitioning(spark, make_sets, random_rows):
    sets = make_sets(random_rows(n=15), 150)
    moved = encode.BinarySets(sets.docs.repartition(3), sets.items.repartition(7, "feature_id"), sets.vocab.repartition(5))
    for algorithm in sketches.MODELS:
        assert sketch_of(get_model(algorithm), sets, 100) == sketch_of(get_model(algorithm), moved, 100)


def test_wide_enough_sketch_keeps_the_overlap(spark, make_sets, random_rows):
    rows = random_rows(n=10)
    got = {d: bits(w) for d, w in sketch_of(get_model("BinSketch"), make_sets(rows, 150), 150).items()}
    for a in rows:
        for b in rows:
            assert len(got[a] & got[b]) == len(rows[a] & rows[b])


def test_set_positions(spark):
    words = F.array(F.lit(5).cast("bigint"), F.lit(1 << 62).cast("bigint"))
    row = spark.range(1).select(bit_functions.set_positions(words, 126).alias("p")).first()
    assert list(row["p"]) == [0, 2, 125]


def test_minhash_takes_ids_beyond_31_bits(make_sets):
    big = {0: {2**33 + 5, 2**40 + 1, 7}, 1: {(2**33 + 5) % (2**31 - 1), (2**40 + 1) % (2**31 - 1), 7}}
    sets = make_sets(big, 10)
    signatures = {r["doc_id"]: list(r["sketch"]) for r in get_model("MinHash").mapping(sets, 16).collect()}
    assert signatures[0] == signatures[1]


def test_binsketch_refuses_features_without_bucket(make_sets):
    with pytest.raises(Exception, match="no bucket"):
        get_model("BinSketch").mapping(make_sets({0: {1, 99}}, 10), 5).collect()


@pytest.mark.parametrize("algorithm", ["BinSketch", "BCS", "MinHash", "SimHash"])
def test_sketches_of_several_lengths_equal_those_of_each(make_sets, random_rows, algorithm):
    sets, model = make_sets(random_rows(n=30), 150), get_model(algorithm)
    lengths = (7, 63, 64, 130, 63)
    made = sketches_by_length(model, sets, lengths)
    assert list(made) == [7, 63, 64, 130]
    for k, table in made.items():
        one = {r["doc_id"]: (list(r["sketch"]), r["card"]) for r in model.mapping(sets, k).collect()}
        assert {r["doc_id"]: (list(r["sketch"]), r["card"]) for r in table.collect()} == one


def test_several_lengths_read_the_items_once(make_sets, random_rows):
    sets = make_sets(random_rows(n=30), 150)
    plan = get_model("BCS").mappings(sets, (100, 500, 1000))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2  # the rows and their items
    with pytest.raises(ValueError):
        BinSketch(bucket_map=sets.vocab).mappings(sets, (5, 6))


def test_projections_are_drawn_once_for_each_feature_of_a_batch(monkeypatch):
    import pandas as pd

    from bitfold.functions import lanes

    rng, drawn, log = np.random.RandomState(1), [], np.log
    rows = [rng.choice(30, size=n, replace=False).astype(np.int64) * 1_000_003 for n in rng.randint(1, 20, size=50)]
    coefficients = lanes.draw_coefficients(3, 4, 4)
    sums = lanes.gaussian_sums_udf(coefficients, 7).func
    alone = [sums(pd.Series([r]))[0].tolist() for r in rows]
    monkeypatch.setattr(np, "log", lambda x, *a: drawn.append(len(x)) or log(x, *a))
    assert [v.tolist() for v in sums(pd.Series(rows))] == alone
    assert max(drawn) <= 30 < sum(map(len, rows))
