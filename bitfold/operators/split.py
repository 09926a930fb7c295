"""Random train/query split with exact sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitfold.operators.ranking import hash_rank


def train_query_split(docs: DataFrame, train_ratio: float = 0.9, seed: int = 42) -> DataFrame:
    """``(doc_id, side)``: exactly ``floor(n * train_ratio)`` rows are 'train', the rest 'query'.

    The order is a seeded hash, so the split does not depend on partitioning.
    """
    ranked = hash_rank(docs, "doc_id", seed, "split")
    n_train = F.floor(F.col("n_total") * F.lit(float(train_ratio)))
    return ranked.select(
        "doc_id", F.when(F.col("rank") < n_train, F.lit("train")).otherwise(F.lit("query")).alias("side")
    )


def same_split(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row saying whether two ``(doc_id, side)`` tables hold the same assignment.

    One aggregation over both tables: each row counts +1 or -1 under its own key, and the
    splits agree exactly when every key nets to zero.
    """
    both = left.select("doc_id", "side", F.lit(1).alias("v")).unionByName(
        right.select("doc_id", "side", F.lit(-1).alias("v"))
    )
    net = both.groupBy("doc_id", "side").agg(F.sum("v").alias("v"))
    return net.agg(
        F.count_if(F.col("v") != 0).alias("n_differences"),
        (F.count_if(F.col("v") != 0) == 0).alias("is_same"),
    )
