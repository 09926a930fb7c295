"""A sample of the registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as registered
from bitfold.catalog import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "customer part orders lineitem documents".split()
SAMPLE = (
    "items_binary", "split_sides", "binsketch_sketch", "minhash_signature", "exact_jaccard",
    "query_train_bcs", "exp1_error_grid", "neighbors_summary", "truth_job_accuracy", "truth_job_retrieval", "synthetic_items",
)


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_its_sql():
    assert queries.queries().keys() == oracle.oracle_sql().keys()


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, engine, name):
    df = registered.queries()[name](spark, SF)
    answer = engine.execute(registered.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(map(str, answer.fetchall()))
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == expected
