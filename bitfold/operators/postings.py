"""Rows that share a key meet in pairs, a bounded number at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitfold.functions.hashing import hash32
from bitfold.session import materialize

BLOCK_ROWS = 2_048  # rows of one key that are held together


def in_blocks(index: DataFrame, key: str, row_id: str, block_rows: int) -> DataFrame:
    """``index`` with ``n_blocks`` of its key and its own ``block``.

    The hot keys are written before they are joined: there is at most one for every ``block_rows`` rows, and
    next to a written table Spark can broadcast it if it is small, or else split the rows of a hot key over tasks,
    which it cannot do next to an aggregation by the same key.
    """
    hot = (
        index.groupBy(key)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > block_rows)
        .select(key, F.ceil(F.col("n") / F.lit(float(block_rows))).cast("int").alias("n_blocks"))
    )
    rows = index.join(materialize(hot, "hot-keys"), key, "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    return rows.withColumn("block", (hash32(F.col(row_id), 0, "block") % F.col("n_blocks")).cast("int"))


def meet_on_key(
    index: DataFrame,
    key: str,
    row_id: str,
    payload: list[str],
    two_sided: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Every pair of index rows with the same key, as structs ``a`` and ``b``.

    Compared with itself a table gives each pair once (``a.id < b.id``); with ``two_sided``
    rows with ``n_left > 0`` meet rows with ``n_right > 0``.

    The rows of a key are cut into blocks by id hash; a key with up to ``block_rows`` rows is
    one block.  Each pair of blocks of a key is one grid cell: a row is sent to the cells of
    its own block, so cells are filled by one shuffle, hold about two blocks, and a hot key is
    spread over as many tasks as it has cells.  Key sizes are a map-side combined count.
    """
    block_rows = block_rows or BLOCK_ROWS
    rows = in_blocks(index, key, row_id, block_rows)
    near = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    row = F.struct(F.col(row_id), F.col("block"), *payload).alias("row")
    a_id, b_id = F.col(f"a.{row_id}"), F.col(f"b.{row_id}")
    if two_sided:
        return _across(rows.select(key, "block", "n_left", "n_right", near, row), key).where(a_id != b_id)
    # cell (p, q) with p <= q; a row of block b belongs to every cell that has b as p or q
    cells = rows.select(key, "block", near, row).select(
        key, F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "row"
    )
    held = cells.groupBy(key, "p", "q").agg(F.collect_list("row").alias("rows"))
    held = held.where(F.size("rows") > 1)
    first = held.select(key, "p", "q", "rows", F.explode("rows").alias("a"))
    pairs = first.select(key, "p", "q", "a", F.explode("rows").alias("b"))
    # in an off-diagonal cell only rows of different blocks meet; the others have their own cell
    own_cell = (F.col("p") == F.col("q")) | (F.col("a.block") != F.col("b.block"))
    return pairs.where(own_cell & (a_id < b_id))


def _across(rows: DataFrame, key: str) -> DataFrame:
    """Left rows meet right rows only: cell (p, q) holds left block p and right block q.

    Every pair has one cell, and a cell without rows of both sides gives nothing.
    """
    left = rows.where(F.col("n_left") > 0).select(
        key, F.col("block").alias("p"), F.col("other").alias("q"), F.lit(True).alias("is_left"), "row"
    )
    right = rows.where(F.col("n_right") > 0).select(
        key, F.col("other").alias("p"), F.col("block").alias("q"), F.lit(False).alias("is_left"), "row"
    )
    held = left.unionByName(right).groupBy(key, "p", "q").agg(
        F.collect_list(F.when(F.col("is_left"), F.col("row"))).alias("lefts"),
        F.collect_list(F.when(~F.col("is_left"), F.col("row"))).alias("rights"),
    )
    held = held.where((F.size("lefts") > 0) & (F.size("rights") > 0))
    first = held.select(key, "p", "q", "rights", F.explode("lefts").alias("a"))
    return first.select(key, "p", "q", "a", F.explode("rights").alias("b"))
