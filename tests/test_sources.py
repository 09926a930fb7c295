import gzip

import pytest
from pyspark.errors import AnalysisException

from bitfold.operators import encode
from bitfold.sources import bagofwords, tables

DOCWORD = "3\n5\n4\n1 1 2\n1 3 1\n1 3 7\n3 5 1\nnot a triple\n"


def cells(items):
    return sorted((r["doc_id"], r["feature_id"]) for r in items.collect())


@pytest.mark.parametrize("form", ["gzip", "plain text named gz", "latin-1", "plain"])
def test_docword_forms(spark, tmp_path, form):
    path = tmp_path / ("docword.txt" if form == "plain" else "docword.txt.gz")
    if form == "gzip":
        path.write_bytes(gzip.compress(DOCWORD.encode()))
    elif form == "latin-1":
        path.write_bytes(gzip.compress((DOCWORD + "caf\xe9\n").encode("latin-1")))
    else:
        path.write_text(DOCWORD)
    sets = bagofwords.load_bag_of_words(spark, str(path))
    assert cells(sets.items) == [(0, 0), (0, 2), (2, 4)]  # a repeated triple is one cell
    assert sorted(r[0] for r in sets.docs.collect()) == [0, 1, 2]  # document 2 is empty
    assert sets.vocab.count() == 5
    header = bagofwords.read_header(bagofwords.read_docword_lines(spark, str(path))).first()
    assert tuple(header) == (3, 5, 4)


def test_sample_keeps_the_first_documents(spark, tmp_path):
    path = tmp_path / "docword.txt"
    path.write_text(DOCWORD)
    sets = bagofwords.load_bag_of_words(spark, str(path), sample_size=2)
    assert cells(sets.items) == [(0, 0), (0, 2)] and sets.docs.count() == 2


def test_vocabulary_ids_are_line_numbers(spark, tmp_path):
    terms = [f"term{n * 7919 % 10007}" for n in range(3000)]
    terms[5] = ""
    path = tmp_path / "vocab.txt"
    path.write_text("\n".join(f"  {t} " for t in terms) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")  # many splits
    try:
        got = {r["feature_id"]: r["term"] for r in bagofwords.read_vocabulary(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(terms))


def test_bag_of_words_roundtrip(spark, make_sets, tmp_path):
    sets = make_sets({0: {1, 2}, 1: set(), 2: {0}}, 4)
    bagofwords.write_bag_of_words(sets, str(tmp_path / "dw"))
    back = bagofwords.load_bag_of_words(spark, str(tmp_path / "dw"))
    assert cells(back.items) == cells(sets.items) and back.docs.count() == 3 and back.vocab.count() == 4


def test_text_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("Caf\xe9 NOIR the noir".encode("latin-1"))
    (tmp_path / "sub" / "b.txt").write_bytes("caf\xe9 x noir tea".encode("latin-1"))
    (tmp_path / "c.md").write_text("caf noir")
    sets = bagofwords.encode_text_folder(spark, str(tmp_path))
    terms = {r["feature_id"]: r["term"] for r in sets.vocab.collect()}
    assert terms == {0: "caf\xe9", 1: "noir"}  # in both files, not a stop word, two letters or more
    assert cells(sets.items) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_set_tables_roundtrip(spark, make_sets, tmp_path):
    sets = make_sets({0: {1}, 1: set()}, 3)
    tables.save_sets(sets, str(tmp_path / "sets"))
    back = tables.load_sets(spark, str(tmp_path / "sets"))
    assert cells(back.items) == [(0, 1)] and back.docs.count() == 2 and back.vocab.count() == 3
    with pytest.raises(AnalysisException):
        tables.load_sets(spark, str(tmp_path / "missing")).items.count()


def test_truth_tables(spark, tmp_path):
    truth = spark.createDataFrame([(1, 2, 0.5, 1)], "i bigint, j bigint, sim double, n_pairs bigint")
    path = str(tmp_path / "truth")
    assert tables.load_truth(spark, path, "d", "jaccard_similarity") is None
    tables.save_truth(truth, path, "d", "jaccard_similarity")
    tables.save_truth(truth.limit(0), path, "d", "cosine_similarity")
    assert tables.load_truth(spark, path, "d", "jaccard_similarity").collect() == truth.collect()


def test_result_sinks(spark, tmp_path):
    results = spark.createDataFrame([("BCS", 0.25)], "algo string, score double")
    tables.save_results(results, str(tmp_path / "r.csv"))
    tables.save_results(results, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r.csv")).collect()[0]["score"] == "0.25"
    assert spark.read.json(str(tmp_path / "r")).collect()[0]["algo"] == "BCS"


def test_synthetic_sets_have_exactly_the_asked_cells(spark):
    for density in (0.1, 0.7):
        sets = tables.synthetic_sets(spark, 50, 40, density, 3)
        got = cells(sets.items)
        assert len(got) == len(set(got)) == int(density * 2000)
        assert all(0 <= d < 50 and 0 <= f < 40 for d, f in got)


def test_synthetic_sets_of_a_given_shape(spark):
    for n_rows, n_cols, density in ((7, 9, 0.3), (30, 11, 0.9), (5, 5, 0.0)):
        given = tables.synthetic_sets(spark, n_rows, n_cols, density, 1)
        twin = tables.synthetic_like(given, 2)
        assert twin.items.count() == given.items.count()
        assert twin.docs.count() == n_rows and twin.vocab.count() == n_cols
    nothing = tables.synthetic_sets(spark, 0, 4, 0.5, 1)
    assert tables.synthetic_like(nothing).items.isEmpty()


def test_binarize_and_check(spark):
    triples = spark.createDataFrame([(0, 1, 2.0), (0, 1, 1.0), (1, 0, 0.0)], "r int, c int, v double")
    assert cells(encode.binarize(triples, "r", "c", "v")) == [(0, 1)]
    report = encode.value_check(triples, "v").first()
    assert tuple(report) == (3, 0.0, 2.0, 1)


def test_summary_and_preview(spark, make_sets):
    sets = make_sets({0: {1, 2}, 1: set()}, 4)
    assert tuple(encode.dataset_summary(sets).first()) == (2, 4, 2, 1.0, 75.0)
    assert [tuple(r) for r in encode.preview(sets, 5, 4).collect()] == [(0, "0110"), (1, "0000")]
    assert cells(encode.head_sample(sets, 1).items) == [(0, 1), (0, 2)]


def test_vocabulary_of_two_files_and_missing_header(spark, tmp_path):
    folder = tmp_path / "vocab"
    folder.mkdir()
    (folder / "a.txt").write_text("one\n\ttwo \n")
    (folder / "b.txt").write_text("three\nfour\n")
    rows = sorted((r["feature_id"], r["term"]) for r in bagofwords.read_vocabulary(spark, str(folder)).collect())
    assert rows == [(0, "one"), (1, "two"), (2, "three"), (3, "four")]
    bare = tmp_path / "docword.bare.txt"
    bare.write_text("1 1 1\n2 1 1\n")
    with pytest.raises(Exception, match="header"):
        bagofwords.load_bag_of_words(spark, str(bare)).docs.count()


def test_bucket_map_and_filtered_truth_are_saved(spark, make_sets, tmp_path):
    from bitfold.operators.pairs import filter_report
    from bitfold.operators.sketches import get_model
    from bitfold.sources.tables import save_bucket_map, save_filtered_truth

    sets = make_sets({0: {1, 2}, 1: {3}}, 5)
    save_bucket_map(get_model("BinSketch").bucket_map(sets.vocab, 3), str(tmp_path / "map"))
    saved = spark.read.parquet(str(tmp_path / "map"))
    own = get_model("BinSketch").mapping(sets, 3).collect()
    assert sorted(map(tuple, saved.collect())) == sorted(map(tuple, get_model("BinSketch").bucket_map(sets.vocab, 3).collect()))
    again = type(get_model("BinSketch"))(bucket_map=saved).mapping(sets, 3).collect()
    assert sorted(map(str, again)) == sorted(map(str, own))

    pairs = spark.createDataFrame([(0, 1, 0.4), (0, 2, 0.9)], "i bigint, j bigint, sim double")
    save_filtered_truth(pairs.where("sim >= 0.5"), filter_report(pairs, 0.5), str(tmp_path / "kept"))
    assert [(r["i"], r["j"], r["sim"]) for r in spark.read.json(str(tmp_path / "kept/pairs")).collect()] == [(0, 2, 0.9)]
    assert spark.read.json(str(tmp_path / "kept/report")).first()["filtered_count"] == 1


def test_random_sets_are_drawn_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(tables, "RANGE_ROWS", 10)
    numbers = tables.numbered(spark, 1000)
    assert numbers.rdd.getNumPartitions() >= 100 and sorted(r["id"] for r in numbers.collect()) == list(range(1000))
    written = []
    write = tables.materialize
    monkeypatch.setattr(tables, "materialize", lambda df, name: written.append(name) or write(df, name))
    assert tables.synthetic_sets(spark, 50, 40, 0.1, 3).items.count() == 200 and written == ["drawn"]
