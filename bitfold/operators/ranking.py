"""Dense 0-based row numbers without a single-task global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitfold.functions.hashing import hash32
from bitfold.session import materialize

HASH_BIN_SHIFT = 20  # 32-bit hash -> 4096 bins
HASH_BINS = 1 << (32 - HASH_BIN_SHIFT)


def hash_rank(df: DataFrame, key: str, seed: int, purpose: str) -> DataFrame:
    """Number distinct BIGINT keys 0..n-1 in seeded-hash order.

    Returns ``(key, rank, n_total)``.  Rows are numbered inside hash bins; each bin
    starts where the bins before it end.  The bin table has at most 4096 rows by
    construction, so the one un-partitioned window and the broadcast are bounded.
    """
    hashed = df.select(
        F.col(key).cast("bigint").alias(key), hash32(F.col(key), seed, purpose).alias("_h")
    ).withColumn("_bin", F.shiftright("_h", HASH_BIN_SHIFT))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_bin").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    starts = (
        hashed.groupBy("_bin")
        .count()
        .select(
            "_bin",
            F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"),
            F.sum("count").over(everything).alias("n_total"),
        )
    )
    in_bin = Window.partitionBy("_bin").orderBy("_h", key)
    return hashed.join(F.broadcast(starts), "_bin").select(
        key,
        (F.col("_start") + F.row_number().over(in_bin) - 1).cast("bigint").alias("rank"),
        F.col("n_total").cast("bigint").alias("n_total"),
    )


def ordered_rank(df: DataFrame, key: str, rank_name: str = "rank") -> DataFrame:
    """Number the rows of ``df`` (distinct ``key``) 0..n-1 in the order of ``key``.

    Range partitioning balances any key distribution.  Its boundaries are sampled, so
    the partitioned table is written once and both the partition sizes and the row
    numbers are read from that table.
    """
    ranged = df.repartitionByRange(F.col(key).asc()).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition: bounded by the shuffle partition count
    starts = (
        ranged.groupBy("_part")
        .count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    in_part = Window.partitionBy("_part").orderBy(key)
    return ranged.join(F.broadcast(starts), "_part").select(
        *df.columns,
        (F.col("_start") + F.row_number().over(in_part) - 1).cast("bigint").alias(rank_name),
    )
