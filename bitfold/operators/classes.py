"""Rows with equal item sets collapse to one weighted class.

Similarities and sketches depend on the item set only.  Working on classes keeps the
result whole while a group of copies, however large, never has its pairs listed: a class
of m rows stands for m (m - 1) / 2 pairs of similarity 1, and two classes of m and n rows
for m n pairs of one similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitfold.functions.hashing import hash32
from bitfold.operators.encode import BinarySets
from bitfold.session import materialize


@dataclass(frozen=True)
class SetClasses:
    """``classes(doc_id, card, n_left, n_right)`` and the items of each class.

    ``doc_id`` is the smallest member id.  ``n_left``/``n_right`` count the members of each
    side (both are the class size when a table is compared with itself).
    ``members(doc_id, class_id)`` maps rows to classes, ``shapes(doc_id, card, f1, f2, f3)`` classes to the
    fingerprint of their set.
    """

    classes: DataFrame
    items: DataFrame
    vocab: DataFrame
    members: DataFrame
    shapes: DataFrame | None = None

    def as_sets(self) -> BinarySets:
        return BinarySets(self.classes.select("doc_id"), self.items, self.vocab)


def collapse_copies(sets: BinarySets, sides: DataFrame | None = None) -> SetClasses:
    """Group rows by item set; ``sides(doc_id, side)`` marks 'query' (left) and 'train' (right).

    Sets are compared by size and a 160-bit order-independent fingerprint (two XORs of
    64-bit hashes and a sum of 32-bit hashes), all combined map-side.
    """
    feature = F.col("feature_id")
    rows = sets.docs.select("doc_id", F.lit(None).cast("bigint").alias("feature_id")).unionByName(
        sets.items.select("doc_id", "feature_id")
    )
    known = feature.isNotNull()
    zero = F.lit(0).cast("bigint")
    prints = rows.groupBy("doc_id").agg(
        F.count("feature_id").alias("card"),
        F.coalesce(F.bit_xor(F.when(known, F.xxhash64(feature))), zero).alias("f1"),
        F.coalesce(F.bit_xor(F.when(known, F.xxhash64(feature, F.lit(1)))), zero).alias("f2"),
        F.coalesce(F.sum(hash32(feature, 0, "fingerprint")), zero).alias("f3"),
    )
    if sides is None:
        prints = prints.withColumn("n_left", F.lit(1)).withColumn("n_right", F.lit(1))
    else:
        prints = prints.join(sides, "doc_id").select(
            "*",
            F.when(F.col("side") == "query", 1).otherwise(0).alias("n_left"),
            F.when(F.col("side") == "train", 1).otherwise(0).alias("n_right"),
        )
    prints = materialize(prints, "fingerprints")
    shape = ["card", "f1", "f2", "f3"]
    grouped = prints.groupBy(*shape).agg(
        F.min("doc_id").alias("class_id"),
        F.sum("n_left").alias("n_left"),
        F.sum("n_right").alias("n_right"),
    )
    grouped = materialize(grouped, "classes")
    classes = grouped.select(F.col("class_id").alias("doc_id"), "card", "n_left", "n_right")
    items = sets.items.join(classes.select("doc_id"), "doc_id", "left_semi")
    members = prints.select("doc_id", *shape).join(grouped.select("class_id", *shape), shape)
    shapes = grouped.select(F.col("class_id").alias("doc_id"), *shape)
    return SetClasses(
        classes, materialize(items, "class-items"), sets.vocab, members.select("doc_id", "class_id"), shapes
    )
