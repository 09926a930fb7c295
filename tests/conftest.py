import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("bitfold-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_sets(spark):
    """{doc_id: set of features} -> BinarySets."""
    from bitfold.operators.encode import BinarySets

    def make(rows, n_features):
        docs = spark.createDataFrame([(d,) for d in rows], "doc_id bigint")
        cells = [(d, f) for d, fs in rows.items() for f in sorted(fs)]
        items = spark.createDataFrame(cells, "doc_id bigint, feature_id bigint")
        vocab = spark.range(n_features).withColumnRenamed("id", "feature_id")
        return BinarySets(docs, items, vocab)

    return make


@pytest.fixture
def random_rows():
    """Zipf-like random sets with exact copies, near copies, an empty pair and a hot feature."""
    import random

    def make(n=60, n_features=150, seed=0):
        rng = random.Random(seed)
        rows = {}
        for d in range(n):
            size = rng.randint(1, 40)
            rows[d] = {min(int(rng.paretovariate(0.7)) - 1, n_features - 1) for _ in range(size)} | {
                rng.randrange(n_features) for _ in range(size // 2)
            }
        for d in range(0, n // 3):  # a third of the rows are copies of one row
            rows[d] = set(rows[0])
        for d in range(n // 3, n // 2):
            rows[d] = set(rows[n // 2]) ^ {rng.randrange(n_features)}
        rows[n], rows[n + 1] = set(), set()
        return rows

    return make
