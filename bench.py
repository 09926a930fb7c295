"""Headline workloads at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bitfold.catalog.datasets import purchases, table  # noqa: E402
from bitfold.operators.classes import collapse_copies  # noqa: E402
from bitfold.operators.encode import encode_text  # noqa: E402
from bitfold.operators.overlap import similar_pairs  # noqa: E402
from bitfold.operators.sketches import get_model  # noqa: E402
from bitfold.operators.split import train_query_split  # noqa: E402
from bitfold.plans.accuracy import accuracy_grid  # noqa: E402
from bitfold.plans.retrieval import retrieval_grid  # noqa: E402
from bitfold.plans.sampled import sampled_errors  # noqa: E402
from bitfold.session import materialize  # noqa: E402

JACCARD, COSINE = "jaccard_similarity", "cosine_similarity"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bitfold-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", "64m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, work):
        start = time.time()
        result = work()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
        return result

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    documents = timed("encode_documents", lambda: encode_text(table(spark, sf_dir, "documents")).materialize("documents"))
    customers = timed("encode_customers", lambda: purchases(spark, sf_dir).materialize("customers"))
    for algorithm, k in (("BinSketch", 1000), ("BCS", 1000), ("MinHash", 256), ("SimHash", 256)):
        timed(f"sketch_{algorithm.lower()}_{k}", lambda a=algorithm, k=k: run(get_model(a).mapping(documents, k)))
    doc_classes = timed("collapse_copies_documents", lambda: collapse_copies(documents))
    truth = timed(
        "exact_jaccard_documents",
        lambda: materialize(similar_pairs(doc_classes, JACCARD, 0.3, "gt"), "truth"),
    )
    customer_classes = collapse_copies(customers)
    timed("exact_inner_product_customers", lambda: run(similar_pairs(customer_classes, "inner_product", 2, "gt")))
    timed("exp1_documents", lambda: accuracy_grid(
        doc_classes, ["BinSketch", "BCS", "MinHash"], [0.3, 0.4, 0.5, 0.7, 0.8, 0.9], JACCARD,
        "minus_log_mse", [256, 1000], truth=truth,
    ).collect())
    split = collapse_copies(documents, train_query_split(documents.docs))
    timed("exp2_documents", lambda: retrieval_grid(
        split, ["BinSketch", "BCS", "MinHash"], [0.5, 0.6, 0.7, 0.85, 0.95], JACCARD, "f1", [1000]
    ).collect())
    timed("sampled_errors_customers", lambda: sampled_errors(customers, k=50, n_pairs=1000).collect())

    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
