"""Estimated neighbours at low thresholds and from dense sketches: all that can be near is compared, tile by tile.

Where most pairs of sketches share a bucket, an index of buckets lists every pair many times.  Here
sketches are sorted by their set bits and cut into tiles.  What two sketches can have in common is
bounded by the one with fewer bits, so the set bits of a tile tell which others it can match; tiles
beyond that never meet.  Two tiles that do are one cell: a task counts common bits of packed words for all their pairs
and gives out only those that reach the threshold.  No table of candidates is written or shuffled.

The work is the number of compared pairs, which ``compared_pairs`` reports; it is quadratic unless set bits rule
tiles out, so at high thresholds and with sparse sketches the index of ``estimated_neighbors`` is the better way.
A row is sent to as many cells as it has partner tiles; a cell holds ``2 * tile_rows`` sketches at most.  Inside a cell
set bits rule out blocks of rows as they do tiles, so wide tiles cost no more comparisons than narrow ones.

Signs are counted word by word, only as long as many pairs of a block may still be near.  Min-wise signatures have
no set bits: all their tiles meet.  Of their lanes one byte is compared first, and all of a lane where enough bytes agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitfold.functions.estimators import get_counted_estimator
from bitfold.functions.similarity import compare
from bitfold.operators.classes import SetClasses
from bitfold.operators.ranking import ordered_rank
from bitfold.operators.retrieve import estimates_near, least_lanes, most_differing, set_sizes, shared_by_pair
from bitfold.operators.sketches import SketchModel
from bitfold.session import materialize

MOST_TILE_ROWS, LEAST_TILE_ROWS = 65_536, 128
CELLS_PER_SLOT = 8
BLOCK = 1 << 19  # pairs that are counted at a time
BLOCK_COLUMNS = 8_192  # right rows of a block at most
NEXT_TO = 1e-9  # estimates this near to a threshold are left to Spark
LEVELS = 1 << 21  # combinations of set bits and counts whose levels are looked up in a table; of more, each pair is estimated
FEW = 16  # of so many pairs one may still be near when the rest is looked up pair by pair
VERIFIED = 1 << 14  # pairs of min-wise signatures that are compared lane by lane at a time
FOUND = "i bigint, j bigint, n_i bigint, n_j bigint, card_i bigint, card_j bigint, shared bigint"


class PairTest:
    """Which counts of a pair can reach the threshold, and which set bits rule that out."""

    def __init__(self, algorithm: str, similarity: str, k: int, threshold: float):
        self.algorithm, self.similarity, self.k, self.threshold = algorithm, similarity, k, float(threshold)
        self.sizes = set_sizes(algorithm, k) if algorithm in ("BinSketch", "BCS") else None

    def least(self, cards: np.ndarray, partners: np.ndarray) -> np.ndarray:
        """Bits that every card (rows) has to share with every partner (columns)."""
        mine, other = self.sizes[cards][:, None], self.sizes[partners][None, :]
        return shared_by_pair(self.algorithm, self.similarity, self.k, self.threshold, mine, other)

    @cached_property
    def partners(self) -> tuple[np.ndarray, np.ndarray]:
        """For each number of set bits 0..k the least and most that a partner can have, neither ever falling."""
        cards = np.arange(self.k + 1)
        if self.algorithm == "MinHash":
            return np.zeros(self.k + 1, np.int64), np.full(self.k + 1, self.k)
        if self.algorithm == "SimHash":
            radius = most_differing(self.similarity, self.k, self.threshold)
            return np.maximum(cards - radius, 0), np.minimum(cards + radius, self.k)
        low, high = np.full(self.k + 1, self.k + 1), np.full(self.k + 1, -1)
        for c in cards:
            fits = np.flatnonzero(self.least(cards[c : c + 1], cards)[0] <= np.minimum(c, cards))
            if len(fits):
                low[c], high[c] = fits[0], fits[-1]
        return np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high)

    def lanes(self, words: np.ndarray) -> np.ndarray:
        """The words of all rows one after the other; of min-wise lanes a byte of each."""
        if self.algorithm == "MinHash":
            words = (words * 0x9E3779B1 >> 24).astype(np.uint8)
        return np.ascontiguousarray(words.T)

    def hits(self, left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left index, right index, count) of the pairs whose count reaches what is needed; a side is (words, lanes, cards)."""
        count_of = {"MinHash": self._equal_lanes, "SimHash": self._differing_bits}.get(self.algorithm, self._common_bits)
        a, b, count = count_of(left, right)
        return a, b, count.astype(np.int64)

    def _equal_lanes(self, left: tuple, right: tuple):
        need, shape = least_lanes(self.similarity, self.k, self.threshold), (len(left[0]), len(right[0]))
        count, same = np.zeros(shape, np.uint8 if self.k < 256 else np.uint16), np.empty(shape, bool)
        for mine, other in zip(left[1], right[1]):
            np.equal(mine[:, None], other[None, :], out=same)
            np.add(count, same.view(np.uint8), out=count)
        a, b = np.nonzero(count >= need)
        exact = np.zeros(len(a), np.int64)
        for at in range(0, len(a), VERIFIED):
            part = slice(at, at + VERIFIED)
            exact[part] = np.count_nonzero(left[0][a[part]] == right[0][b[part]], axis=1)
        keep = exact >= need
        return a[keep], b[keep], exact[keep]

    def _differing_bits(self, left: tuple, right: tuple):
        radius, (_, mine, _), (_, other, _) = most_differing(self.similarity, self.k, self.threshold), left, right
        count, differs = np.zeros((mine.shape[1], other.shape[1]), np.uint16), np.empty((mine.shape[1], other.shape[1]), np.int64)
        for w in range(len(mine)):
            np.bitwise_xor(mine[w][:, None], other[w][None, :], out=differs)
            count += np.bitwise_count(differs)
            near = count <= radius
            if w + 1 == len(mine) or np.count_nonzero(near) * FEW < near.size:
                break
        a, b = np.nonzero(near)
        exact = count[a, b].astype(np.int64)
        for later in range(w + 1, len(mine)):
            exact += np.bitwise_count(mine[later][a] ^ other[later][b])
        keep = exact <= radius
        return a[keep], b[keep], exact[keep]

    def _common_bits(self, left: tuple, right: tuple):
        (_, mine, left_cards), (_, other, right_cards) = left, right
        count, common = np.zeros((mine.shape[1], other.shape[1]), np.uint16), np.empty((mine.shape[1], other.shape[1]), np.int64)
        for w in range(len(mine)):
            np.bitwise_and(mine[w][:, None], other[w][None, :], out=common)
            count += np.bitwise_count(common)
        rows, row_of = np.unique(left_cards, return_inverse=True)
        columns, column_of = np.unique(right_cards, return_inverse=True)
        a, b = np.nonzero(count >= self.least(rows, columns)[row_of][:, column_of])
        return a, b, count[a, b]


def cell_blocks(test: PairTest, left: tuple, right: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left index, right index, count) of the pairs that reach the threshold, a block of pairs at a time.

    A side is (words, lanes, cards) in the order of cards; of the right side only rows that a block can match are counted.
    """
    low, high = test.partners
    cards, others = left[2], right[2]
    width = max(1, min(BLOCK_COLUMNS, len(others), BLOCK))
    height = max(1, BLOCK // width)
    for at in range(0, len(cards) if len(others) else 0, height):
        rows = slice(at, at + height)
        mine = left[0][rows], left[1][:, rows], cards[rows]
        first = np.searchsorted(others, low[mine[2][0]], side="left")
        last = np.searchsorted(others, high[mine[2][-1]], side="right")
        for start in range(first, last, width):
            columns = slice(start, min(start + width, last))
            a, b, count = test.hits(mine, (right[0][columns], right[1][:, columns], others[columns]))
            if len(a):
                yield a + at, b + start, count


def cell_compare(test: PairTest, two_sided: bool, thresholds: list[float] | None = None):
    """All pairs of the left and right rows of one cell.

    With ``thresholds`` (two sides) the pairs of a left row whose estimates lie between the same two thresholds are one
    row: ``n_j`` is summed, the counts are those of one of them.  Pairs whose estimate is next to a threshold are told
    apart by their counts, so that the estimate Spark makes of a row holds for all its pairs.
    """

    def part(cell: pa.Table, is_left: bool):
        rows = cell.filter(pa.compute.equal(cell["is_left"], is_left)).sort_by("card").combine_chunks()
        words = rows["sketch"].combine_chunks() if rows.num_rows else None
        words = np.asarray(words.flatten()).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1), np.int64)
        ids, n, cards = (rows[c].to_numpy() for c in ("doc_id", "n", "card"))
        return ids, n, (words, test.lanes(words), cards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        cell = pa.Table.from_batches(list(batches))
        ids_a, n_a, left = part(cell, True)
        ids_b, n_b, right = part(cell, False)
        names = ["i", "j", "n_i", "n_j", "card_i", "card_j", "shared"]
        sums = LevelSums(test, thresholds, ids_a, n_a, left[2]) if thresholds else None
        apart = two_sided and not len(np.intersect1d(ids_a, ids_b))
        for a, b, shared in cell_blocks(test, left, right):
            if not two_sided and cell["p"][0].as_py() != cell["q"][0].as_py():
                apart = True
            if not apart:
                ok = ids_a[a] != ids_b[b] if two_sided else ids_a[a] < ids_b[b]
                a, b, shared = a[ok], b[ok], shared[ok]
            if sums is not None:
                columns = sums.add(a, n_b[b], right[2][b], shared)
                if len(columns[0]):
                    yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(names, columns)})
                continue
            columns = [ids_a[a], ids_b[b], n_a[a], n_b[b], left[2][a], right[2][b]]
            if not two_sided:
                turned = ids_a[a] > ids_b[b]
                columns = [np.where(turned, columns[k ^ 1], columns[k]) for k in range(6)]
            # what a block finds leaves at once: a cell may find most of its pairs
            if len(a):
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(names, [*columns, shared])})
        if sums is not None:
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(names, sums.rows())})

    return run


class LevelSums:
    """Rows found by each left row of a cell, by the thresholds their estimates lie between."""

    def __init__(self, test: PairTest, thresholds: list[float], ids: np.ndarray, n: np.ndarray, cards: np.ndarray):
        self.test, self.thresholds, self.ids, self.n, self.cards = test, np.sort(np.array(thresholds, float)), ids, n, cards
        self.held, self.seen = (np.zeros(len(ids) * (len(thresholds) + 1), np.int64) for _ in range(2))

    def levels(self, shared: np.ndarray, cards_a: np.ndarray, cards_b: np.ndarray) -> np.ndarray:
        """How many thresholds each estimate reaches, -1 where it is next to one."""
        t = self.test
        est, sure = estimates_near(t.algorithm, t.similarity, t.k, shared, cards_a, cards_b)
        level = np.searchsorted(self.thresholds, est, side="right")
        for each in self.thresholds:
            sure &= np.abs(est - each) > NEXT_TO
        return np.where(sure, level, -1)

    @cached_property
    def table(self) -> np.ndarray | None:
        """The levels of all counts, or of all set bits of two sketches and counts; the counts come last."""
        wide = self.test.k + 1
        shape = (1, 1, wide) if self.test.sizes is None else (wide, wide, wide)
        if math.prod(shape) > LEVELS:
            return None
        cards_a, cards_b, shared = (x.reshape(-1) for x in np.indices(shape))
        return self.levels(shared, cards_a, cards_b).astype(np.int8 if len(self.thresholds) < 128 else np.int64)

    def add(self, a: np.ndarray, n_b: np.ndarray, cards_b: np.ndarray, shared: np.ndarray) -> list[np.ndarray]:
        """Take pairs of left rows ``a`` in, which rise; the columns of the pairs that are next to a threshold."""
        wide, n_levels = np.int64(self.test.k + 1), len(self.thresholds) + 1
        if not len(a):
            return [a] * 7
        seen = cards_b * wide + shared
        if self.table is None:
            level = self.levels(shared, self.cards[a], cards_b)
        else:
            level = self.table[shared if self.test.sizes is None else (self.cards * wide * wide)[a] + seen]
        edge = level < 0
        first = a[0] * n_levels
        key = (a - a[0]) * n_levels + level
        if edge.any():
            kept, n_kept, seen_kept = key[~edge], n_b[~edge], seen[~edge]
        else:
            kept, n_kept, seen_kept = key, n_b, seen
        held = np.bincount(kept, n_kept).astype(np.int64)
        self.held[first : first + len(held)] += held
        self.seen[first : first + len(held)][kept] = seen_kept
        keys, of_key = np.unique((a[edge] * wide + cards_b[edge]) * wide + shared[edge], return_inverse=True)
        n_j = np.bincount(of_key.reshape(-1), n_b[edge], len(keys)).astype(np.int64)
        row = keys // wide // wide
        return [self.ids[row], self.ids[row], self.n[row], n_j, self.cards[row], keys // wide % wide, keys % wide]

    def rows(self) -> list[np.ndarray]:
        """The columns of the sums; the lowest level, below all thresholds, is left out."""
        levels = len(self.thresholds) + 1
        key = np.flatnonzero((self.held > 0) & (np.arange(len(self.held)) % levels > 0))
        row = key // levels
        card, shared = np.divmod(self.seen[key], self.test.k + 1)
        return [self.ids[row], self.ids[row], self.n[row], self.held[key], self.cards[row], card, shared]


def tiled(rows: DataFrame, weight: str, tile_rows: int) -> DataFrame:
    """``(tile, low, high, doc_id, n, card, sketch)`` of the rows of one side, in the order of set bits."""
    own = rows.where(F.col(weight) > 0).select(
        F.struct("card", "doc_id").alias("key"), "doc_id", F.col(weight).cast("bigint").alias("n"), "card", "sketch"
    )
    ranked = ordered_rank(own, "key").withColumn("tile", F.floor(F.col("rank") / tile_rows)).drop("key", "rank")
    edges = ranked.groupBy("tile").agg(F.min("card").alias("low"), F.max("card").alias("high"))
    return materialize(ranked.join(edges, "tile"), "tiles")


def card_counts(rows: DataFrame, weight: str, k: int) -> np.ndarray:
    """How many rows of a side have 0..k set bits: at most k + 1 numbers."""
    out = np.zeros(k + 1, np.int64)
    for card, n in rows.where(F.col(weight) > 0).groupBy("card").agg(F.count("*")).collect():
        out[card] = n
    return out


def partner_tiles(tiles: DataFrame, counts: np.ndarray, test: PairTest, tile_rows: int) -> DataFrame:
    """``tiles`` with the first and last tile of the other side (``counts`` rows by set bits) they can match.

    The table that is joined has a row for each number of set bits, k + 1 at most.
    """
    low, high = test.partners
    upto = np.concatenate(([0], np.cumsum(counts)))  # rows of the other side with fewer set bits
    first = upto[np.minimum(low, test.k + 1)] // tile_rows
    last = (upto[np.clip(high + 1, 0, test.k + 1)] - 1) // tile_rows
    reach = tiles.sparkSession.createDataFrame(
        [(c, int(a), int(b)) for c, (a, b) in enumerate(zip(first, last))], "set_bits bigint, first bigint, last bigint"
    )
    ends = [reach.select(F.col("set_bits").alias(edge), end) for edge, end in (("low", "first"), ("high", "last"))]
    return tiles.join(F.broadcast(ends[0]), "low").join(F.broadcast(ends[1]), "high")


def tile_cells(rows: DataFrame, test: PairTest, two_sided: bool, tile_rows: int | None = None) -> DataFrame:
    """``(p, q, is_left, doc_id, n, card, sketch)``: every row once in each cell of its tile."""
    sides = ("n_left", "n_right") if two_sided else ("n_left", "n_left")
    counts = [card_counts(rows, side, test.k) for side in sides]
    if tile_rows is None:
        slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        even = math.isqrt(int(counts[0].sum()) * int(counts[1].sum()) // (CELLS_PER_SLOT * slots)) + 1
        tile_rows = min(MOST_TILE_ROWS, max(LEAST_TILE_ROWS, even))
    left = tiled(rows, sides[0], tile_rows)
    right = tiled(rows, sides[1], tile_rows) if two_sided else left
    first, last, own = F.col("first"), F.col("last"), F.col("tile")
    ranges = [(first, last), (first, last)] if two_sided else [(F.greatest(first, own), last), (first, F.least(last, own))]
    kept = ["doc_id", "n", "card", "sketch"]
    parts = []
    for is_left, (side, other, (low, high)) in enumerate(((right, counts[0], ranges[1]), (left, counts[1], ranges[0]))):
        reaching = partner_tiles(side, other, test, tile_rows).withColumns({"low": low, "high": high}).where(F.col("low") <= F.col("high"))
        cell = ["partner", "tile"] if not is_left else ["tile", "partner"]
        sent = reaching.select(own, F.explode(F.sequence("low", "high")).alias("partner"), *kept)
        parts.append(sent.select(F.col(cell[0]).alias("p"), F.col(cell[1]).alias("q"), F.lit(bool(is_left)).alias("is_left"), *kept))
    return parts[1].unionByName(parts[0])


def sketch_rows(model: SketchModel, sets: SetClasses, k: int, sketches: DataFrame | None = None) -> DataFrame:
    sketches = model.mapping(sets.as_sets(), k) if sketches is None else sketches
    sketches = sketches.withColumn("card", F.coalesce("card", F.lit(0).cast("bigint")))
    return materialize(sketches.join(sets.classes.select("doc_id", "n_left", "n_right"), "doc_id"), "sketches")


def compared_pairs(model: SketchModel, sets: SetClasses, similarity: str, threshold: float, k: int,
                   two_sided: bool = True, tile_rows: int | None = None) -> DataFrame:
    """One row: pairs of classes that ``tiled_neighbors`` compares, and all pairs there are."""
    rows = sketch_rows(model, sets, k)
    cells = tile_cells(rows, PairTest(model.name, similarity, k, threshold), two_sided, tile_rows)
    sizes = cells.groupBy("p", "q").agg(F.count_if("is_left").alias("a"), F.count_if(~F.col("is_left")).alias("b"))
    inside = F.lit(False) if two_sided else F.col("p") == F.col("q")
    met = F.when(inside, F.floor(F.col("a") * (F.col("a") - 1) / 2)).otherwise(F.col("a") * F.col("b")).cast("bigint")
    n_l, n_r = (F.count_if(F.col(c) > 0) for c in ("n_left", "n_right"))
    every = n_l * n_r if two_sided else F.floor(n_l * (n_l - 1) / 2)
    compared = sizes.agg(F.coalesce(F.sum(met), F.lit(0).cast("bigint")).alias("n_compared"))
    return compared.select("n_compared", rows.agg(every.cast("bigint").alias("n")).scalar().alias("n_all"))


def compared_cells(
    rows: DataFrame, test: PairTest, two_sided: bool, tile_rows: int | None = None, thresholds: list[float] | None = None
) -> DataFrame:
    """``FOUND``: the pairs of different ``rows(doc_id, sketch, card, n_left, n_right)`` that pass ``test``.

    With ``thresholds`` they are summed up for each left row and cell, see ``cell_compare``; ``j`` then has no meaning.
    """
    # cells are small but long to compare: as many tasks as there are configured slots, however few bytes they are
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = tile_cells(rows, test, two_sided, tile_rows).repartition(slots, "p", "q")
    return cells.groupBy("p", "q").applyInArrow(cell_compare(test, two_sided, thresholds), FOUND)


def tiled_hits(model: SketchModel, sets: SetClasses, similarity: str, thresholds: list[float], k: int,
               sketches: DataFrame | None = None, tile_rows: int | None = None) -> DataFrame:
    """``(i, n_i, n_j, est)``: for each left class how many right rows ``n_j`` the pairs that reach the lowest threshold
    stand for, summed up so that ``est`` is on the same side of every threshold for all of them."""
    return estimated_cells(model, sets, similarity, min(thresholds), k, True, sketches, tile_rows, [float(t) for t in thresholds]).select(
        "i", "n_i", "n_j", "est"
    )


def tiled_neighbors(model: SketchModel, sets: SetClasses, similarity: str, threshold: float, k: int,
                    two_sided: bool = True, sketches: DataFrame | None = None, tile_rows: int | None = None) -> DataFrame:
    """Class pairs whose estimate is at least ``threshold`` > 0, or a Hamming distance of at most ``threshold``.

    Returns ``(i, j, n_i, n_j, n_pairs, est)`` as ``estimated_neighbors`` does; ``sketches`` are those of ``sets``
    if they are written already.
    """
    return estimated_cells(model, sets, similarity, threshold, k, two_sided, sketches, tile_rows)


def estimated_cells(model: SketchModel, sets: SetClasses, similarity: str, threshold: float, k: int, two_sided: bool,
                    sketches: DataFrame | None, tile_rows: int | None, thresholds: list[float] | None = None) -> DataFrame:
    """What ``compared_cells`` gives and the copies inside classes, with estimates."""
    counted = get_counted_estimator(model.name, similarity)
    upper = similarity == "hamming_distance"
    if threshold < 0 or (threshold == 0 and not upper):
        raise ValueError("a threshold that keeps disjoint pairs would list every pair")
    test = PairTest(model.name, similarity, k, threshold)
    rows = sketch_rows(model, sets, k, sketches)
    found = compared_cells(rows, test, two_sided, tile_rows, thresholds)
    n_l, n_r = F.col("n_left"), F.col("n_right")
    inside = (n_l * n_r if two_sided else F.floor(n_l * (n_l - 1) / 2)).cast("bigint")
    itself = {"MinHash": F.lit(k), "SimHash": F.lit(0)}.get(model.name, F.col("card")).cast("bigint")
    copies = rows.where(inside > 0).select(
        F.col("doc_id").alias("i"), F.col("doc_id").alias("j"), n_l.cast("bigint").alias("n_i"), n_r.cast("bigint").alias("n_j"),
        F.col("card").alias("card_i"), F.col("card").alias("card_j"), itself.alias("shared"), inside.alias("n_pairs"),
    )
    pairs = found.withColumn("n_pairs", F.col("n_i") * F.col("n_j")).unionByName(copies)
    est = counted(F.col("shared"), F.col("card_i"), F.col("card_j"), k)
    return pairs.withColumn("est", est).where(compare(F.col("est"), threshold, "le" if upper else "ge")).select(
        "i", "j", "n_i", "n_j", "n_pairs", "est"
    )
