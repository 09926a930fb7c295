"""Sharding by a minimax contiguous partition.

Equal texts are one atomic group.  Groups stand in the order of their text's SHA-256, and shards are
contiguous runs of groups.  The smallest capacity that lets all groups fit into the shards is found by
binary search; a capacity is checked greedily: every shard takes groups while they fit.  Law ``bytes``: no
shard is larger than that capacity, and no other contiguous partition has a smaller largest shard.

Groups are only ever listed in Spark.  The search works on cells: groups whose digest begins alike, with
their total size, which at first are the ``16 ** FIRST_DIGITS`` values of the leading digits.  A cut can only fall
at the edge of a cell or inside a cell of several groups.  Taking the former alone gives a capacity that surely
suffices, allowing any place inside such cells one below which none does.  While the two differ, the cells in
which a cut may lie are split by further digits, at most ``MOST_SPLIT`` of them in one job and the largest first;
when they meet, the capacity is the exact one over single groups.  The driver holds cells, whose number follows
from the number of shards and not from the table.

Within that capacity the cuts are placed so that what is left is shared evenly: a group that is larger
than a fair share sets the capacity, but does not leave later shards empty.

Rows are numbered in hash bins of their shard, so neither a shard nor a group is numbered by one task.  All
of it is DataFrame expressions; only sums and cuts reach the driver.

Defined results: null counts as the empty text, whose size is ``ROW_BYTES``.  Repeated rows are rows of their
group, each with a slot of its own.  With fewer groups than shards some shards stay empty; an empty table
gives an empty result.  Other columns stay; columns named like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitfold.session import materialize

N_SHARDS = 40
ROW_BYTES = 16
FIRST_DIGITS = 3
MORE_DIGITS = 2
MOST_SPLIT = 1_024
BIN_ROWS = 1_000
SPOT_DIGITS = 10
LAW = "bytes"
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


@dataclass(frozen=True)
class Cells:
    """Groups by the first digits of their digest, in order: digits, total size, whether it is one group."""

    keys: list[str]
    sizes: np.ndarray
    single: np.ndarray

    @property
    def edges(self) -> np.ndarray:
        """Bytes before each cell, and all of them."""
        return np.concatenate(([0], np.cumsum(self.sizes)))

    @staticmethod
    def of(rows: list[tuple[str, int, int]]) -> Cells:
        rows = sorted(rows)
        return Cells([r[0] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] == 1 for r in rows], bool))

    def without(self, gone: set[int]) -> list[tuple[str, int, int]]:
        return [(k, int(s), 1 if one else 2) for i, (k, s, one) in enumerate(zip(self.keys, self.sizes, self.single)) if i not in gone]


def ends(cells: Cells, capacity: int, n_shards: int, inside: bool) -> list[int]:
    """Where greedy shards of ``capacity`` end, in bytes from the start.

    Shards end at edges of cells, or with ``inside`` at any byte of a cell of several groups: as
    the true greedy shards end at groups, the first are never after and the second never before them.
    """
    edges, total, at, out = cells.edges, int(cells.sizes.sum()), 0, []
    for _ in range(n_shards):
        reach = at + capacity
        if reach >= total:
            at = total
        else:
            cell = int(np.searchsorted(edges, reach, side="right")) - 1
            at = reach if inside and not cells.single[cell] else int(edges[cell])
        out.append(at)
    return out


def least_capacity(cells: Cells, n_shards: int, inside: bool) -> int:
    """The smallest capacity whose greedy shards reach the end, by binary search."""
    total = int(cells.sizes.sum())
    low, high = -(-total // n_shards), total
    while low < high:
        middle = (low + high) // 2
        if ends(cells, middle, n_shards, inside)[-1] >= total:
            high = middle
        else:
            low = middle + 1
    return low


def undecided(cells: Cells, low: int, high: int, n_shards: int) -> list[int]:
    """Cells of several groups in which a greedy cut of a capacity from ``low`` to ``high`` may lie, largest first."""
    edges, found = cells.edges, set()
    first, last = ends(cells, low, n_shards, False), ends(cells, high, n_shards, True)
    for a, b in zip([0, *first], [0, *last[:-1]]):
        start = int(np.searchsorted(edges, a + low, side="right")) - 1
        stop = int(np.searchsorted(edges, b + high, side="right")) - 1
        found.update(range(start, min(stop, len(cells.keys) - 1) + 1))
    several = [c for c in found if not cells.single[c]]
    return sorted(several, key=lambda c: (-int(cells.sizes[c]), c))


def counted(groups: DataFrame, key: Column) -> list[tuple[str, int, int]]:
    """(digits, total size, number of groups) of every cell: bounded by the digits and cells asked for."""
    rows = groups.select(key.alias("key"), "bytes").where("key is not null").groupBy("key")
    return [tuple(r) for r in rows.agg(F.sum("bytes"), F.count("*")).collect()]


def split(groups: DataFrame, cells: Cells, chosen: list[int], digits: int) -> Cells:
    """``cells`` with the chosen ones replaced by cells of more digits."""
    by_length: dict[int, list[str]] = {}
    for c in chosen:
        by_length.setdefault(len(cells.keys[c]), []).append(cells.keys[c])
    key = F.coalesce(*[
        F.when(F.substring("digest", 1, n).isin(keys), F.substring("digest", 1, n + digits)) for n, keys in by_length.items()
    ])
    return Cells.of(cells.without(set(chosen)) + counted(groups, key))


def searched(groups: DataFrame, n_shards: int, first_digits: int, most_split: int) -> tuple[Cells, int]:
    """The exact smallest capacity over ``groups(digest, bytes)``, and cells whose edges allow it."""
    cells = Cells.of(counted(groups, F.substring("digest", 1, first_digits)))
    while cells.keys:
        low, high = (least_capacity(cells, n_shards, inside) for inside in (True, False))
        if low == high:
            return cells, high
        cells = split(groups, cells, undecided(cells, low, high, n_shards)[:most_split], MORE_DIGITS)
    return cells, 0


def even_share(sizes: np.ndarray, single: np.ndarray, n_shards: int) -> float:
    """Bytes for each shard when every group larger than that has a shard of its own."""
    share = int(sizes.sum()) / n_shards
    while True:
        large = single & (sizes > share)
        left = n_shards - int(large.sum())
        less = int(sizes[~large].sum()) / left if left > 0 else share
        if less >= share:
            return share
        share = less


def cuts(cells: Cells, capacity: int, n_shards: int) -> list[str]:
    """The digits each shard after the first begins with; shards left empty at the end have none.

    Cuts are the edges nearest to an even share of what is left, larger groups set apart, among those that keep
    this shard within ``capacity`` and leave no more than the shards after it can take.
    """
    edges, total = cells.edges, int(cells.sizes.sum())
    least = [total]
    for _ in range(n_shards):
        least.append(int(edges[np.searchsorted(edges, max(0, least[-1] - capacity), side="left")]))
    least.reverse()
    out, at = [], 0
    for k in range(1, n_shards):
        here = int(np.searchsorted(edges, at, side="right"))  # the first edge that leaves no empty shard
        ideal = at + even_share(cells.sizes[here - 1 :], cells.single[here - 1 :], n_shards - k + 1)
        after = max(here, int(np.searchsorted(edges, ideal, side="left")))
        near = min(edges[max(here, after - 1) : after + 1], key=lambda e: (abs(e - ideal), e), default=total)
        top = edges[np.searchsorted(edges, at + capacity, side="right") - 1]
        at = int(min(max(near, least[k], at), top))
        place = int(np.searchsorted(edges, at, side="left"))
        if place < len(cells.keys):
            out.append(cells.keys[place])
    return out


def with_slots(placed: DataFrame, n_shards: int, bin_rows: int) -> DataFrame:
    """``placed(.., shard, spot, id, digest)`` with ``slot``: 0.. in each shard, in the order of ``spot``."""
    sizes = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row per shard
    bins = F.array(*[F.lit(-(-sizes.get(s, 0) // bin_rows)).cast("bigint") for s in range(n_shards)])
    unit = F.lit(16.0**SPOT_DIGITS)
    binned = placed.withColumn("bin", F.floor(F.col("spot") / unit * F.get(bins, F.col("shard"))).cast("bigint"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(binned.groupBy("shard", "bin").agg(F.count("*").alias("n")), "bins")
    starts = counts.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bin").orderBy("spot", "id", "digest")
    ranked = binned.withColumn("n", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["shard", "bin"]).withColumn("slot", (F.col("start") + F.col("n")).cast("bigint"))


def put(
    documents: DataFrame, n_shards: int = N_SHARDS, text: str = "text", doc_id: str = "doc_id",
    first_digits: int = FIRST_DIGITS, most_split: int = MOST_SPLIT, bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """``documents`` without the text, with ``RESULTS``."""
    others = [c for c in documents.columns if c != text and c not in RESULTS]
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    # the other columns travel in a struct, so none of their names can meet a working name
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), F.col(f"`{doc_id}`").alias("id"),
        F.sha2(data, 256).alias("digest"), (F.octet_length(data) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    cells, capacity = searched(groups, n_shards, first_digits, most_split)
    begins = [(F.col("digest") >= cut).cast("int") for cut in cuts(cells, capacity, n_shards)] if capacity else []
    spot = F.substring(F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.col("digest")).cast("binary"), 256), 1, SPOT_DIGITS)
    placed = rows.withColumns({
        "shard": reduce(lambda a, b: a + b, begins, F.lit(0)), "spot": F.conv(spot, 16, 10).cast("bigint"), "law": F.lit(LAW),
        "grown_shard": F.lit(None).cast("int"),
    })
    return with_slots(placed, n_shards, bin_rows).select(*[F.col(f"others.`{c}`") for c in others], *RESULTS)


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return put(documents.select("doc_id", "text"))
