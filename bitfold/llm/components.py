"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitfold.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node that ``links(i, j)`` connect each linked node with.

    In every round a node takes the smallest label among its neighbours' and then its label's
    label, so labels cover twice the distance each time.  Rounds are written tables; nothing but
    the number of changes reaches the driver.
    """
    both = links.select(F.col("i").alias("node"), F.col("j").alias("other")).unionByName(
        links.select(F.col("j").alias("node"), F.col("i").alias("other"))
    )
    edges = materialize(both.distinct(), "links")
    labels = materialize(edges.groupBy("node").agg(F.min("other").alias("low")).select(
        "node", F.least("node", "low").alias("component")
    ), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        own = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        wider = labels.join(own, "component").join(near, "node")
        found = materialize(
            wider.select("node", F.least("far", "near").alias("component"), (F.least("far", "near") < F.col("component")).alias("moved")),
            "labels",
        )
        labels = found.select("node", "component")
        if found.where("moved").isEmpty():
            return labels
