"""Mixing sources to target weights by Pfair scheduling.

The documents of each source are put in a hash order and cut into blocks.  A source of weight w
should have received w * t blocks after t slots; its j-th block is released at floor(j / w) and due at
ceil((j + 1) / w), and in every slot the released block with the earliest deadline runs.  A source is
then never a whole block away from its share.

When a source has no blocks left, the others share its slots in proportion: in the fluid schedule
all sources fill at rates in proportion to their weights until they are empty, and releases and
deadlines are the times, rounded outwards, at which the fluid schedule begins and ends a block.  Every document is
placed once and none is dropped or repeated.  Weights are never rounded: times are whole numbers
calculated exactly from the weights as given.  Sources of weight 0 follow after all others.

Documents are numbered inside hash bins of their source, so one source with most of the rows fills no
single task; this and the placing are DataFrame expressions.  The driver holds one entry per source
and runs earliest deadline first over the blocks, not the documents; the slots are written in parts
of bounded size.

Defined results: a null source is a source of its own.  Rows are numbered by (hash of doc_id, doc_id,
hash of the row); rows that agree in all of these are placed next to each other.  Other columns stay;
columns named like the results are replaced.  An empty table gives an empty schedule.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bitfold.session import materialize

BLOCK_ROWS = 32
BIN_ROWS = 10_000
PART_SLOTS = 200_000
RESULTS = ("source_rank", "block", "release", "deadline", "slot")


def shares(counts: dict, weights: dict | None, slots: int | None = None) -> dict:
    """Exact shares of ``slots`` (of 1 if not given).

    Without ``weights`` a source weighs the square root of its rows, which lifts small sources.
    A given ``slots`` that is smaller than the number of sources is refused.
    """
    if slots is not None and len(counts) > slots:
        raise ValueError(f"{len(counts)} sources do not fit into {slots} slots; raise slots")
    raw = {s: Fraction(float(weights.get(s, 0.0)) if weights else math.sqrt(n)) for s, n in counts.items()}
    if any(w < 0 for w in raw.values()):
        raise ValueError("weights must not be negative")
    total = sum(raw.values())
    return {s: w / total * (slots or 1) if total else Fraction(slots or 1, len(raw)) for s, w in raw.items()}


def ranked(documents: DataFrame, n_rows: int, bin_rows: int) -> DataFrame:
    """``documents(row, doc_id, source)`` with ``source_rank``: 0.. inside each source, in hash order.

    Hash bins are numbered separately and shifted by the sizes of the bins before them.
    """
    n_bins = max(1, math.ceil(n_rows / bin_rows))
    spot = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40))
    placed = documents.withColumns(
        {"_spot": spot, "_tie": F.xxhash64("row")}
    ).withColumn("_bin", F.floor(F.col("_spot") * F.lit(n_bins) / F.lit(1 << 40)).cast("int"))
    before = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("source", "_bin").count().select(
        F.col("source").alias("_s"), F.col("_bin").alias("_b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    # numbered together with the texts' rows, so that one shuffle serves both
    inside = Window.partitionBy("source", "_bin").orderBy("_spot", "doc_id", "_tie")
    numbered = placed.withColumn("_n", F.row_number().over(inside) - 1)
    joined = numbered.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b")))
    return joined.withColumn("source_rank", (F.col("_start") + F.col("_n")).cast("bigint")).drop(
        "_spot", "_tie", "_bin", "_s", "_b", "_start", "_n"
    )


def whole(weights: list[Fraction]) -> list[int]:
    """The same weights as whole numbers."""
    unit = math.lcm(*[w.denominator for w in weights])
    scaled = [w.numerator * (unit // w.denominator) for w in weights]
    common = math.gcd(*scaled) or 1
    return [w // common for w in scaled]


def windows(blocks: list[int], weights: list[int]) -> Iterator[Iterator[tuple[int, int]]]:
    """For each source the (release, deadline) of its blocks in turn; weights are positive.

    The fluid schedule has filled ``min(blocks, weight * v)`` of each source at level v.  Sources
    run out in the order of ``blocks / weight``; between two of them time is linear in v.
    """
    order = sorted(range(len(blocks)), key=lambda i: Fraction(blocks[i], weights[i]))
    levels, gone, rates = [], [0], [sum(weights)]
    for i in order:
        levels.append((blocks[i], weights[i]))
        gone.append(gone[-1] + blocks[i])
        rates.append(rates[-1] - weights[i])

    def of(i: int) -> Iterator[tuple[int, int]]:
        w, p = weights[i], 0
        for j in range(blocks[i] + 1):
            # the stretch of time in which level j / w lies
            if j * levels[p][1] > levels[p][0] * w:
                p = bisect_left(levels, True, lo=p, key=lambda x: x[0] * w >= j * x[1])
            whole_part, rest = divmod(rates[p] * j, w)
            at = gone[p] + whole_part
            if j:
                yield begun, at + (rest > 0)
            begun = at

    for i in range(len(blocks)):
        yield of(i)


def earliest_deadline_first(blocks: list[int], weights: list[int], start: int = 0, first: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(source's number from ``first``, block, release, deadline) for each slot in turn, beginning with slot ``start``."""
    streams = list(windows(blocks, weights))
    waiting, ready, done = [], [], [0] * len(blocks)
    for i, stream in enumerate(streams):
        heapq.heappush(waiting, (*next(stream), i))
    for t in range(sum(blocks)):
        while waiting and waiting[0][0] <= t:
            release, deadline, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, i, release))
        deadline, i, release = heapq.heappop(ready)
        yield first + i, done[i], start + release, start + deadline
        done[i] += 1
        following = next(streams[i], None)
        if following:
            heapq.heappush(waiting, (*following, i))


def schedule(totals: list[tuple[object, int, Fraction]], spark, source_type, part_slots: int = PART_SLOTS) -> DataFrame:
    """``(source, block, release, deadline, slot)`` for every block; ``totals`` holds (source, blocks, weight)."""
    slots, at, number = [], 0, {}
    for some in ([x for x in totals if x[2] > 0], [x for x in totals if x[2] == 0]):
        weights = whole([w for _, _, w in some]) if some and some[0][2] > 0 else [1] * len(some)
        blocks = [b for _, b, _ in some]
        first = len(number)
        number |= {first + k: s for k, (s, _, _) in enumerate(some)}
        slots.append(earliest_deadline_first(blocks, weights, at, first))
        at += sum(blocks)
    form = "_number bigint, block bigint, release bigint, deadline bigint, slot bigint"
    parts, rows = [], []
    for slot, row in enumerate(x for part in slots for x in part):
        rows.append((*row, slot))
        if len(rows) == part_slots:
            parts.append(materialize(spark.createDataFrame(rows, form), "slots"))
            rows = []
    if rows:
        parts.append(materialize(spark.createDataFrame(rows, form), "slots"))
    plan = parts[0]
    for part in parts[1:]:
        plan = plan.unionByName(part)
    names = spark.createDataFrame(list(number.items()), StructType([StructField("_number", LongType()), StructField("source", source_type)]))
    return plan.join(names, "_number").select("source", "block", "release", "deadline", "slot")


def place(
    documents: DataFrame, weights: dict | None = None, slots: int | None = None, block_rows: int = BLOCK_ROWS, bin_rows: int = BIN_ROWS
) -> DataFrame:
    """``documents(doc_id, source, ...)`` with their rank in the source, block, window and slot."""
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in RESULTS]
    # all columns travel in a struct, so none of their names can meet a working name
    slim = documents.select(F.struct(*kept).alias("row"), "doc_id", "source")
    # one row per source
    counts = {r["source"]: r["count"] for r in slim.groupBy("source").count().collect()}
    if not counts:
        return slim.select("row.*", *[F.lit(None).cast("bigint").alias(c) for c in RESULTS])
    share = shares(counts, weights, slots)
    totals = sorted(((s, -(-n // block_rows), share[s]) for s, n in counts.items()), key=lambda x: (x[0] is None, str(x[0])))
    rank = ranked(slim, sum(counts.values()), bin_rows)
    rank = rank.withColumn("block", F.floor(F.col("source_rank") / F.lit(block_rows)).cast("bigint"))
    plan = schedule(totals, documents.sparkSession, documents.schema["source"].dataType)
    plan = plan.withColumnRenamed("source", "_source").withColumnRenamed("block", "_block")
    both = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_at"))
    return rank.join(plan.withColumnRenamed("_block", "_at"), both).select("row.*", *RESULTS)


def mixed(documents: DataFrame, weights: dict | None = None, places: bool = False, **limits) -> DataFrame:
    """``documents`` in schedule order: written files follow the target weights from start to end.

    With ``places`` they carry ``source_rank`` and ``slot``, and columns named like a result are replaced.  Places are found without the texts and written; the texts move to their place afterwards.
    """
    mark = F.xxhash64(F.col("text")).alias("mark")
    key = ["doc_id", "source", "mark"]
    rows = place(documents.select("doc_id", "source", mark), weights, **limits)
    spots = materialize(rows.groupBy(*key).agg(F.min("slot").alias("slot"), F.min("source_rank").alias("rank")), "places")
    spots = spots.select(*[F.col(c).alias(f"at_{c}") for c in key], "slot", "rank")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"at_{c}"))
    put = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "doc_id", "source", mark)
    found = put.join(spots.hint("merge"), same).orderBy("slot", "rank")
    if not places:
        return found.select("row.*")
    kept = [F.col(f"row.`{c}`") for c in documents.columns if c not in RESULTS]
    return found.select(*kept, F.col("rank").alias("source_rank"), "slot")


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return place(documents.select("doc_id", "source"))
