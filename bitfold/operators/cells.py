"""Overlaps of all pairs of rows that share a feature, counted where the rows meet: no table of meetings.

Left rows are dealt to tiles, right rows to groups of tiles.  A left tile and a right group are one cell.  It gets the
left rows as arrays and, of the right rows, for each feature of the left tile the ids that hold it.  A rare feature of m
rows is so sent to m tiles at most, a frequent one to as many as there are tiles, and never as single meetings of
rows.  A task counts the overlaps of a cell, a bounded number at a time, and gives out what its function keeps of them.
Where many pairs meet, the right rows that hold a frequent feature are one bit each, and the features of a left row are
added up in binary digits, 64 right rows at a time (``added_up``); only rare features are looked up row by row.

Compared with itself a table gives each pair once: a group's ids that belong to a tile before the left one stay away.

What all cells are sent together grows with rows times tiles.  Tiles are as large as a task's memory allows, and where it
still is more than a few times the items, cells are counted in rounds of a few left tiles each, whose results are written: what
is on its way at a time stays in proportion to the items.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitfold.functions.hashing import hash32
from bitfold.operators.encode import MAX_CHUNK
from bitfold.session import materialize

NO_NUMBERS = "CAST(NULL AS ARRAY<BIGINT>) AS numbers"
TILE_ROWS = 65_536  # left rows of a tile at most, about
TILE_ITEMS = 4 << 20  # features of the left rows of a tile at most, about
INFO_ROWS = 4_096  # rows whose columns are sent as one array, about
LIST_ROWS = 4_096  # ids of a feature that are sent as one array, about
CELL_IDS = 4 << 20  # right ids of a cell, about
CELLS_PER_SLOT = 2  # a table that is compared with itself uses about half of them
BLOCK = 1 << 20  # shared features, and pairs, that are counted at a time
#: up to so many cells of a table of counts for each shared feature, counting in the table beats sorting
DENSE = 16
WIDTH = 8_192  # right rows whose bits are added up at a time
FREQUENT = 700  # one right row in so many holds a feature: a bit for each of them then costs less than its meetings
FEW = 16  # of so many words one may need no more meetings than ``SPARE``; else pairs are counted in a table
SPARE = 2  # meetings in rare features that are not looked for unless a pair has more, or needs no more than these
ROUND_IDS = 64 << 20  # ids that are sent in a round at least, about
ROUND_SHARE = 2  # or so many times the items
LIST_COST = 24  # an array that is sent takes as much room as so many ids


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and which of them each value is."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    low, high = int(values.min()), int(values.max())
    if high - low > 16 * len(values) + (1 << 16):
        known, code = np.unique(values, return_inverse=True)
        return known, code.reshape(-1)
    there = np.zeros(high - low + 1, bool)
    there[values - low] = True
    return np.flatnonzero(there) + low, (np.cumsum(there, dtype=np.int32) - 1)[values - low]


def added_up(masks: np.ndarray, items: np.ndarray) -> list[np.ndarray]:
    """Binary digits, the lowest first, of how many of ``masks[items[:, r]]`` have each bit set: one table of words (rows by words) a digit."""
    shape, free, waiting = (items.shape[1], masks.shape[1]), [], [[]]

    def room() -> np.ndarray:
        return free.pop() if free else np.empty(shape, np.uint64)

    def carried(digit: list) -> np.ndarray:
        """Three tables of a digit, or two, become one; the table that is carried."""
        a, b, *c = digit
        u = room()
        np.bitwise_xor(a, b, out=u)
        np.bitwise_and(a, b, out=a)
        if c:
            np.bitwise_and(u, c[0], out=b)
            np.bitwise_or(a, b, out=a)
            np.bitwise_xor(u, c[0], out=u)
            free.append(c[0])
        free.append(b)
        digit[:] = [u]
        return a

    for each in items:
        table, d = room(), 0
        masks.take(each, 0, table, "clip")
        waiting[0].append(table)
        while len(waiting[d]) == 3:
            if d + 1 == len(waiting):
                waiting.append([])
            waiting[d + 1].append(carried(waiting[d]))
            d += 1
    d = 0
    while d < len(waiting):
        if len(waiting[d]) > 1:
            if d + 1 == len(waiting):
                waiting.append([])
            waiting[d + 1].append(carried(waiting[d]))
        d += 1
    return [digit[0] for digit in waiting if digit]


def reaching_bits(digits: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """Words whose bits tell where the numbers in ``digits`` reach ``least``, 0 or more for each word."""
    reached = np.full(digits[0].shape, ~np.uint64(0))
    for d, digit in enumerate(digits):
        zero = ((least >> d & 1) - 1).view(np.uint64)
        reached &= digit | zero
        reached |= digit & zero
    reached[least >> len(digits) > 0] = 0
    return reached


class RightBlock:
    """Some right rows: a bit for each that holds a frequent feature, and the rows of the other features.

    ``number`` tells the mask of each feature of the left rows (0: none), ``first`` and ``size`` where the rows of the rare ones are.
    """

    def __init__(self, features: np.ndarray, rows: np.ndarray, n_rows: int, known: np.ndarray):
        self.n_rows = n_rows
        starts = np.flatnonzero(np.concatenate(([True], features[1:] != features[:-1]))) if len(features) else np.zeros(0, np.int64)
        held, sizes = features[starts], np.diff(np.append(starts, len(features)))
        at = np.minimum(np.searchsorted(known, held), max(0, len(known) - 1))
        met = known[at] == held if len(known) else np.zeros(len(held), bool)
        frequent = met & (sizes * FREQUENT >= n_rows)
        masks = np.zeros((int(frequent.sum()) + 1, -(-n_rows // 64)), np.uint64)
        self.number, self.first, self.size = (np.zeros(len(known), np.int32) for _ in range(3))
        self.number[at[frequent]] = np.arange(1, len(masks))
        listed = np.repeat(met & ~frequent, sizes)
        of = np.repeat(np.cumsum(frequent) * frequent, sizes)
        as_bits = of > 0
        row = rows[as_bits]
        word = of[as_bits] * masks.shape[1] + row // 64
        bit = np.uint64(1) << (row % 64).astype(np.uint64)
        np.bitwise_or.at(masks.reshape(-1), word, bit)
        if int(np.bitwise_count(masks).sum(dtype=np.int64)) < len(row):
            # a row that holds a feature twice has one bit; the others are rows of a rare feature
            where = np.flatnonzero(as_bits)
            again = np.ones(len(where), bool)
            again[np.unique(word * 64 + row % 64, return_index=True)[1]] = False
            listed[where[again]] = True
        self.masks, self.rows = masks, rows[listed]
        per = np.add.reduceat(listed, starts, dtype=np.int64) if len(starts) else sizes
        self.first[at[met]], self.size[at[met]] = (np.cumsum(per) - per)[met], per[met]


def counted_in_block(starts: np.ndarray, code: np.ndarray, block: RightBlock, step: int, room: int, low: Callable | None):
    """(first left row, pairs, overlaps) of ``step`` left rows at a time; pairs are left row * ``block.n_rows`` + right row, from the first left row on.

    ``room`` meetings of rare features are listed at a time, about.  ``low(rows)`` gives for each of some left rows and each word
    overlaps below which pairs may be left out.
    """
    number, size, first = (v[code] for v in (block.number, block.size, block.first))
    upto, n = np.concatenate(([0], np.cumsum(size)))[starts], block.n_rows
    at = 0
    while at < len(starts) - 1:
        fits = int(np.searchsorted(upto, upto[at] + room, side="right")) - 1 - at
        stop = min(len(starts) - 1, at + max(1, min(step, fits)))
        part, r = slice(starts[at], starts[stop]), stop - at
        row_of = np.repeat(np.arange(r), np.diff(starts[at : stop + 1]))
        sizes = size[part]
        begins = np.repeat(first[part] - (np.cumsum(sizes) - sizes), sizes)
        begins = begins + np.arange(len(begins))
        meetings = block.rows[begins] + np.repeat(np.arange(r) * n, np.diff(upto[at : stop + 1]))
        frequent = number[part] > 0
        of, row_of = number[part][frequent], row_of[frequent]
        held = np.bincount(row_of, minlength=r)
        items = np.zeros((int(held.max()), r), np.int64)
        items[np.arange(len(of)) - (np.cumsum(held) - held)[row_of], row_of] = of
        digits = added_up(block.masks, items) if len(items) else []
        least = None if low is None else np.maximum(np.ceil(low(slice(at, stop))), 0).astype(np.int64)
        if least is None or not digits or np.count_nonzero(least <= SPARE) * FEW > least.size:
            counts = np.bincount(meetings, minlength=r * n)
            table = counts.reshape(r, n)
            for d, digit in enumerate(digits):
                table += np.unpackbits(digit.view(np.uint8), axis=1, bitorder="little", count=n).astype(np.uint16) << d
            found = np.flatnonzero(counts if least is None else table >= np.maximum(np.repeat(least, 64, axis=1)[:, :n], 1))
            counts = counts[found]
        else:
            meetings.sort()
            reached = reaching_bits(digits, np.maximum(least - SPARE, 0))
            bits = np.unpackbits(reached.view(np.uint8), axis=1, bitorder="little", count=n)
            found = np.flatnonzero(bits.reshape(-1).view(bool))
            often = meetings[SPARE:][meetings[SPARE:] == meetings[: len(meetings) - SPARE]]
            if len(often):
                found = np.concatenate((found, often))
                found.sort()
                found = found[np.concatenate(([True], found[1:] != found[:-1]))]
            counts = np.searchsorted(meetings, found, side="right") - np.searchsorted(meetings, found, side="left")
            row, column = found // n, found % n
            word, bit = column // 64, (column % 64).astype(np.uint64)
            for d, digit in enumerate(digits):
                counts += (digit[row, word] >> bit & np.uint64(1)).astype(np.int64) << d
        if len(found):
            yield at, found, counts
        at = stop


def counted_overlaps(
    left: tuple, right: tuple, block: int, least: Callable | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left row, right row, overlap) of all pairs that share a feature, a bounded number of rows at a time.

    ``left`` is (starts, features): row r holds ``features[starts[r]:starts[r + 1]]``.  ``right`` is (features, rows,
    number of rows), in the order of features.  ``least(rows, columns)``, the least overlaps of some left rows and right rows that are given by
    numbers, or ``least(rows)``, a table of those of a slice of left rows and all right rows, may leave pairs out early.
    """
    starts, features = left
    held, row_of, n_right = right
    n_left = len(starts) - 1
    known, code = numbered(features)
    low, high = (np.searchsorted(held, known, side=s) for s in ("left", "right"))
    met = int((np.bincount(code, minlength=len(known)) * (high - low)).sum())
    if n_right * n_left <= DENSE * met:
        yield from counted_densely(starts, known, code, right, block, least if least is None or hasattr(least, "lowest") else TableOfLeast(least))
        return
    low, high = low[code], high[code]
    hits = np.concatenate(([0], np.cumsum(high - low)))
    upto, at = hits[starts], 0
    while at < n_left:
        fits = int(np.searchsorted(upto, upto[at] + block, side="right")) - 1 - at
        stop = min(n_left, at + max(1, fits))
        first, last = starts[at], starts[stop]
        sizes = (high - low)[first:last]
        begins = np.repeat(low[first:last] - (hits[first:last] - hits[first]), sizes)
        partners = row_of[begins + np.arange(int(sizes.sum()))]
        row = np.repeat(np.arange(stop - at), np.diff(upto[at : stop + 1]))
        found, counts = np.unique(row * n_right + partners, return_counts=True)
        if len(found):
            yield found // n_right + at, found % n_right, counts
        at = stop


class TableOfLeast:
    """``least(rows, columns)`` and ``least.lowest`` from tables of least overlaps."""

    def __init__(self, table: Callable):
        self.table = table

    def __call__(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        known, at = np.unique(rows, return_inverse=True)
        return np.concatenate([self.table(slice(r, r + 1)) for r in known.tolist()])[at.reshape(-1), columns]

    def lowest(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        table = np.concatenate([self.table(slice(r, r + 1)) for r in rows.tolist()])[:, columns]
        return np.minimum.reduceat(table, np.arange(0, len(columns), 64), axis=1)


def counted_densely(starts: np.ndarray, known: np.ndarray, code: np.ndarray, right: tuple, block: int, least: Callable | None):
    """``counted_overlaps`` where many pairs meet; rows of similar size are counted together."""
    held, row_of, n_right = right
    by_size = np.argsort(np.diff(starts), kind="stable")
    sizes = np.diff(starts)[by_size]
    first = np.concatenate(([0], np.cumsum(sizes)))
    code = code[np.repeat(starts[by_size] - first[:-1], sizes) + np.arange(len(code))]
    order = np.argsort(np.bincount(row_of, minlength=n_right), kind="stable")
    rank = np.empty(n_right, np.int64)
    rank[order] = np.arange(n_right)
    ranked, width = rank[row_of], max(1, min(WIDTH, n_right, block))
    for start in range(0, n_right, width):
        columns = order[start : start + width]
        mine = (ranked >= start) & (ranked < start + width)
        part = RightBlock(held[mine], ranked[mine] - start, len(columns), known)
        low = None if least is None else (lambda rows, columns=columns: least.lowest(by_size[rows], columns))
        for at, pairs, counts in counted_in_block(first, code, part, max(1, block // width), max(block, 1), low):
            a, b = by_size[pairs // part.n_rows + at], columns[pairs % part.n_rows]
            if least is not None:
                keep = counts >= least(a, b)
                a, b, counts = a[keep], b[keep], counts[keep]
            if len(a):
                yield a, b, counts


class LeastOfPairs:
    """Least overlaps of rows of a cell from ``least`` of their columns, which never falls when one of them rises."""

    def __init__(self, least: Callable, left: dict, right: dict):
        self.least, self.left, self.right = least, left, right

    def __call__(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return self.least({c: v[rows] for c, v in self.left.items()}, {c: v[columns] for c, v in self.right.items()})

    def lowest(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """For each row and each 64 columns."""
        words = np.arange(0, len(columns), 64)
        return self.least(
            {c: v[rows, None] for c, v in self.left.items()}, {c: np.minimum.reduceat(v[columns], words)[None] for c, v in self.right.items()}
        )


def cell_run(of_pairs: Callable, columns: list[str], two_sided: bool, block: int):
    """The Arrow function of a cell; ``of_pairs(left, right, overlap)`` gets columns by name and gives BIGINT arrays by name or nothing.

    ``of_pairs.least(left, right)``, if there is one, gives overlaps of 1 or more below which it gives nothing, of columns
    that broadcast; it never falls when a column rises.
    """
    least = getattr(of_pairs, "least", None)

    def flat(lists: pa.ChunkedArray) -> np.ndarray:
        parts = [np.asarray(c.flatten()) for c in lists.chunks if len(c)]
        return np.concatenate(parts).astype(np.int64, copy=False) if parts else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        cell = pa.Table.from_batches(list(batches))
        lefts, infos, lists = (cell.filter(pc.equal(cell["kind"], kind)) for kind in range(3))
        if not (lefts.num_rows and lists.num_rows):
            return
        sizes = [pc.list_value_length(rows["ids"]).to_numpy().astype(np.int64) for rows in (lefts, lists)]
        own_tile = cell["tile"][0].as_py()
        del cell
        # a left row may come in several arrays
        order = np.argsort(lefts["id"].to_numpy(), kind="stable")
        ids, row = numbered(lefts["id"].to_numpy()[order])
        features = flat(lefts["ids"].take(order))
        starts = np.concatenate(([0], np.cumsum(np.bincount(row, sizes[0][order], len(ids)).astype(np.int64))))
        info = flat(infos["numbers"]).reshape(-1, len(columns) + 1)
        info = info[np.argsort(info[:, 0], kind="stable")]
        del lefts, infos
        order = np.argsort(lists["id"].to_numpy(), kind="stable")
        partners, features_b = flat(lists["ids"].take(order)), np.repeat(lists["id"].to_numpy()[order], sizes[1][order])
        known, row_b = numbered(partners)
        del lists, partners, order
        left, right = (dict(zip(["doc_id", *columns], info[np.searchsorted(info[:, 0], who)].T)) for who in (ids, known))
        bound = least and LeastOfPairs(least, left, right)
        for a, b, overlap in counted_overlaps((starts, features), (features_b, row_b, len(known)), block, bound):
            if two_sided:
                keep = ids[a] != known[b]
            else:
                keep = (right["tile"][b] != own_tile) | (ids[a] < known[b])
            a, b, overlap = a[keep], b[keep], overlap[keep]
            if not len(a):
                continue
            out = of_pairs({c: v[a] for c, v in left.items()}, {c: v[b] for c, v in right.items()}, overlap.astype(np.int64))
            if out is not None:
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def met_in_cells(
    rows: DataFrame, items: DataFrame, columns: list[str], of_pairs: Callable, schema: str, two_sided: bool, tile_rows: int | None = None,
    block: int | None = None, distinct: bool = False,
) -> DataFrame:
    """What ``of_pairs`` gives for all pairs of ``rows(doc_id, n_left, n_right, *columns)`` that share a feature of ``items``.

    ``columns`` are BIGINT.  Every pair comes once, with the left row of the smaller tile on the left; with ``two_sided``
    rows with ``n_left > 0`` stand on the left, those with ``n_right > 0`` on the right.  Items that are repeated count as
    often as they meet, or with ``distinct`` once.
    """
    slots = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_left, n_rows = rows.agg(F.count_if(F.col("n_left") > 0), F.count("*")).first()
    n_items, n_cells = items.count(), CELLS_PER_SLOT * slots
    of_left = -(-n_items * n_left // max(1, n_rows))
    n_tiles = max(-(-n_left // (tile_rows or TILE_ROWS)), -(-of_left // TILE_ITEMS), min(n_left // 64, math.isqrt(n_cells)), 1)
    tile = (hash32(F.col("doc_id"), 0, "tile") % n_tiles).cast("bigint")
    of_rows = rows.select("doc_id", tile.alias("tile"), *columns, (F.col("n_left") > 0).alias("is_left"), (F.col("n_right") > 0).alias("is_right"))
    # rows are gathered once, as arrays of bounded length
    of_items = items.select("doc_id", "feature_id").join(of_rows.select("doc_id", "tile", "is_left", "is_right"), "doc_id")
    chunk = F.lit(0).cast("bigint")
    if "card" in columns:
        of_items = of_items.join(rows.where(F.col("card") > MAX_CHUNK).select("doc_id", F.col("card").alias("size")), "doc_id", "left")
        chunk = hash32(F.col("feature_id"), 0, "chunk") % F.ceil(F.coalesce("size", F.lit(1)) / F.lit(MAX_CHUNK))
    arrays = of_items.groupBy("doc_id", "tile", "is_left", "is_right", chunk.alias("chunk")).agg(
        (F.collect_set if distinct else F.collect_list)("feature_id").alias("ids")
    )
    arrays = materialize(arrays, "dealt-rows")
    met = arrays.select("doc_id", "tile", "is_left", "is_right", F.explode("ids").alias("feature_id"))
    counts = materialize(met.groupBy("feature_id").agg(F.count_if("is_right").alias("m"), F.count_if("is_left").alias("l")), "frequencies")
    asked_by = F.least(F.col("l"), F.lit(n_tiles))
    sent, widest, n_asking = counts.agg(F.sum(F.col("m") * asked_by), F.max("feature_id"), F.sum("l")).first()
    sent, widest = sent or 0, max(widest or 0, rows.agg(F.max(F.abs("doc_id"))).first()[0] or 0)
    n_groups = max(1, -(-n_cells // n_tiles), -(-sent // n_tiles // CELL_IDS))
    if two_sided:
        grp = (hash32(F.col("doc_id"), 0, "group") % n_groups).cast("bigint")
    else:
        n_groups = min(n_tiles, n_groups)
        grp = F.floor(F.col("tile") * F.lit(n_groups) / F.lit(n_tiles)).cast("bigint")
    # ids are sent as INT where they fit
    narrow = lambda ids: F.col(ids).cast("array<int>" if widest < 1 << 31 else "array<bigint>").alias("ids")

    # the ids that hold a feature go to every tile that has it on the left; features that one row alone holds meet nothing
    alone = (F.col("l") == 0) | ((F.col("l") == 1) & (F.col("m") == 1) & F.lit(not two_sided))
    part = (hash32(F.col("doc_id"), 0, "block") % F.ceil(F.col("m") / F.lit(LIST_ROWS))).alias("part")
    holding = met.where("is_right").join(counts.where(~alone).select("feature_id", "m"), "feature_id")
    held = F.sort_array(F.collect_list(F.struct("tile", "doc_id"))).alias("held")
    holding = holding.groupBy("feature_id", grp.alias("grp"), part).agg(held, F.max("tile").alias("last"))
    tiles = [] if two_sided else [F.col("held.tile").cast("array<int>").alias("tiles")]
    asking = materialize(met.where("is_left").groupBy("feature_id").agg(F.collect_set("tile").alias("asking")), "askers")
    holding = holding.select("feature_id", "grp", "last", narrow("held.doc_id"), *tiles).join(asking, "feature_id")
    holding = materialize(holding, "holders")

    lists = F.least(F.col("m"), F.lit(n_groups) * F.ceil(F.col("m") / F.lit(LIST_ROWS)))
    n_lists = counts.where(~alone).agg(F.sum(asked_by * lists)).first()[0] or 0
    on_their_way = (sent + LIST_COST * n_lists + n_groups * (n_asking or 0)) // (1 if two_sided else 2)
    n_rounds = max(1, min(n_tiles, -(-on_their_way // max(ROUND_IDS, ROUND_SHARE * n_items))))
    n_tasks = max(slots, min(4 * n_tiles * n_groups, 16 * slots))
    run = cell_run(of_pairs, ["tile", *columns], two_sided, block or BLOCK)

    def counted(turn: int) -> DataFrame:
        """What is found by the left tiles whose turn it is."""
        now = lambda t: t % F.lit(n_rounds) == F.lit(turn)
        groups = F.sequence(F.lit(0).cast("bigint") if two_sided else grp, F.lit(n_groups - 1).cast("bigint"))
        lefts = arrays.where(F.col("is_left") & now(F.col("tile"))).select("tile", narrow("ids"), "doc_id", groups.alias("groups")).select(
            "tile", F.explode("groups").alias("grp"), F.lit(0).alias("kind"), F.col("doc_id").alias("id"), "ids", F.expr(NO_NUMBERS)
        )

        # both sides of a cell need the columns of their rows: some rows of a tile travel as one array
        numbers = F.array(*[F.col(c).cast("bigint") for c in ("doc_id", "tile", *columns)])
        some = (hash32(F.col("doc_id"), 0, "block") % F.lit(-(-TILE_ROWS // INFO_ROWS))).alias("some")

        def packed(side: DataFrame, *of: str) -> DataFrame:
            return side.groupBy(*of, some).agg(F.flatten(F.collect_list(numbers)).alias("numbers"))

        first = F.lit(0).cast("bigint")
        upto = F.lit(n_tiles - 1).cast("bigint") if two_sided else F.col("tile")
        reached = F.explode(F.filter(F.sequence(first, upto), now)).alias("t")
        asked = packed(of_rows.where("is_right").withColumn("grp", grp), *([] if two_sided else ["tile"]), "grp").select(reached, "grp", "numbers")
        no_ids = F.lit(None).cast(lefts.schema["ids"].dataType).alias("ids")
        infos = asked.select(F.col("t").alias("tile"), "grp", F.lit(1).alias("kind"), first.alias("id"), no_ids, "numbers")
        mine = packed(of_rows.where(F.col("is_left") & now(F.col("tile"))), "tile")
        mine = mine.select("tile", F.explode(groups).alias("grp"), F.lit(1).alias("kind"), first.alias("id"), no_ids, "numbers")

        able = lambda t: now(t) if two_sided else now(t) & (F.col("last") >= t)
        pairs = holding.withColumn("t", F.explode(F.filter("asking", able)))
        ids = F.col("ids") if two_sided else F.filter("ids", lambda _, at: F.get("tiles", at) >= F.col("t")).alias("ids")
        lists = pairs.select(F.col("t").alias("tile"), "grp", F.lit(2).alias("kind"), F.col("feature_id").alias("id"), ids, F.expr(NO_NUMBERS))

        # few cells hash unevenly to as few tasks
        cells = lefts.unionByName(mine).unionByName(infos).unionByName(lists).repartition(n_tasks, "tile", "grp")
        return cells.groupBy("tile", "grp").applyInArrow(run, schema)

    if n_rounds == 1:
        return counted(0)
    return reduce(DataFrame.unionByName, [materialize(counted(turn), "round") for turn in range(n_rounds)])
