"""The pipeline's stages on the smallest documents, held against plain versions."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from bitfold.llm import mixing, pieces
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = registered.queries().keys()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language_id" and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op9_near_dedup"])
def test_dedup_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    answer = con.execute(registered.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    found = registered.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, found)) == sorted(answer.fetchall())


def test_pipeline_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    worded = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    first = brute.exact_groups(worded)
    left = [(d, t) for d, t in worded if first[d][2]]
    near = brute.near_groups(left, 5)
    assert set(out) == {d for d, _ in left if near[d][2]}
    library = pieces.ChunkCoder(pieces.default_model()).model
    texts = dict(rows)
    for d, r in out.items():
        ids = library.encode(texts[d])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == brute.sha(",".join(map(str, ids)))
        assert r["decoded_sha256"] == brute.sha(library.decode(ids))


def test_mixing_stage_orders_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = corpus_pipeline.in_target_mix(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.count() == docs.count()


def test_slots_follow_the_target_weights(spark):
    out = corpus_pipeline.run(spark, SF).select("doc_id", "source", "source_rank", "slot").collect()
    sizes = Counter(r["source"] for r in out)
    share = mixing.shares(sizes, None)
    slots = {}
    for r in out:
        assert slots.setdefault((r["source"], r["source_rank"] // mixing.BLOCK_ROWS), r["slot"]) == r["slot"]
    assert sorted(slots.values()) == list(range(len(slots)))
    blocks = {s: -(-n // mixing.BLOCK_ROWS) for s, n in sizes.items()}
    until = int(min(blocks[s] / share[s] for s in sizes))  # the first source runs out
    order = [s for _, s in sorted((slot, source) for (source, _), slot in slots.items())]
    for t in range(1, until + 1):
        got = Counter(order[:t])
        assert all(abs(got[s] - t * share[s]) < 1 for s in sizes)


def test_pipeline_of_repeated_null_and_renamed_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(2).withColumn("text", F.lit("")))
    odd = odd.unionByName(docs.limit(4).withColumn("doc_id", F.lit(None).cast("bigint")))
    clash = ("slot", "_mark", "row", "id", "others", "n_tokens", "label", "block")
    every = docs.unionByName(docs).unionByName(odd).withColumns({c: F.lit(f"own {c}") for c in clash})
    every.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in docs.collect()}
    assert {(r["_mark"], r["row"], r["id"], r["others"], r["label"]) for r in rows} == {("own _mark", "own row", "own id", "own others", "own label")}
    assert all(isinstance(r["slot"], int) and isinstance(r["n_tokens"], int) for r in rows)
    every.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    none = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert none.columns == out.columns and none.count() == 0


def test_places_are_those_of_the_mixing_stage(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    rows = [(d, "ab"[d % 3 == 0], f"text number {d}", "own") for d in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, block string")
    placed = stages["source_mixing"](spark, docs, SF)
    turned = placed.withColumn("slot", 1000 - F.col("slot"))
    want = {r["doc_id"]: (r["source_rank"], r["slot"]) for r in turned.collect()}
    found = {r["doc_id"]: (r["source_rank"], r["slot"]) for r in stages["sentencepiece"](spark, turned, SF).collect()}
    assert found == want
    assert placed.columns == ["doc_id", "source", "text", "source_rank", "slot"]
