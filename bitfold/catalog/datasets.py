"""The binary sets the registered queries run on, prepared once per session and folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitfold.operators.classes import SetClasses, collapse_copies
from bitfold.operators.encode import BinarySets, encode_relation, encode_text
from bitfold.operators.overlap import similar_pairs
from bitfold.operators.split import train_query_split
from bitfold.session import materialize

SEED = 42
TRAIN_RATIO = 0.9

_prepared: dict[tuple, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(spark: SparkSession, sf_dir: str, what: str, build):
    """The encoded tables are written once and reused, as a converted data set is."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _prepared:
        _prepared[key] = build()
    return _prepared[key]


def document_sets(spark: SparkSession, sf_dir: str) -> BinarySets:
    """Documents as sets of their words."""
    return once(spark, sf_dir, "documents", lambda: encode_text(table(spark, sf_dir, "documents")).materialize("documents"))


def purchases(spark: SparkSession, sf_dir: str) -> BinarySets:
    """Customers as sets of the parts they ordered, not yet written."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    bought = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return encode_relation(
        bought, "o_custkey", "l_partkey",
        table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "part").select("p_partkey"),
    )


def customer_sets(spark: SparkSession, sf_dir: str) -> BinarySets:
    return once(spark, sf_dir, "customers", lambda: purchases(spark, sf_dir).materialize("customers"))


_SETS = {"documents": document_sets, "customers": customer_sets}


def classes(spark: SparkSession, sf_dir: str, name: str) -> SetClasses:
    return once(spark, sf_dir, f"{name}-classes", lambda: collapse_copies(_SETS[name](spark, sf_dir)))


def split_classes(spark: SparkSession, sf_dir: str, name: str) -> SetClasses:
    def build():
        sets = _SETS[name](spark, sf_dir)
        return collapse_copies(sets, train_query_split(sets.docs, TRAIN_RATIO, SEED))

    return once(spark, sf_dir, f"{name}-split-classes", build)


def truth(spark: SparkSession, sf_dir: str, name: str, similarity: str, threshold: float) -> DataFrame:
    """Class pairs above ``threshold``, written once."""
    return once(
        spark, sf_dir, f"truth-{name}-{similarity}-{threshold}",
        lambda: materialize(similar_pairs(classes(spark, sf_dir, name), similarity, threshold, "gt"), "truth"),
    )


def split_truth(
    spark: SparkSession, sf_dir: str, name: str, similarity: str, threshold: float, comparison: str = "ge"
) -> DataFrame:
    return once(
        spark, sf_dir, f"split-truth-{name}-{similarity}-{comparison}-{threshold}",
        lambda: materialize(
            similar_pairs(split_classes(spark, sf_dir, name), similarity, threshold, comparison, two_sided=True), "truth"
        ),
    )
