"""Where intermediate tables go, and how a plan is cut.

Long jobs write their intermediate results as Parquet in the shared folder the
session names in ``spark.checkpoint.dir``.  A written table survives the loss of
an executor, lets the next stage prune columns and gives Catalyst a real size.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    Outside local mode the session has to name one: a machine-local folder would
    not be readable from other executors.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    from_context = spark.sparkContext.getCheckpointDir()
    if from_context:
        return from_context
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="bitfold-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table.  Nothing else reads the shuffle files of that job: they go with its end."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs inside leave no shuffle files behind; else these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


def spread(df: DataFrame) -> DataFrame:
    """Give a CPU-heavy stage every slot when the input has fewer files than slots.

    Looks at the list of files only and runs nothing.  A large table has more files than slots
    and passes through untouched; a table in a few files is dealt out once.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= slots:
        return df
    return df.repartition(slots)
