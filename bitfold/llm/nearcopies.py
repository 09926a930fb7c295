"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Documents are sets of word shingles.  Two permutations of the 2^32 places give every signature
coordinate: a shingle is sent to its place by the first, and coordinate k is the smallest image
of the places, moved on circularly by k, under the second.  Coordinates are banded; documents
that agree in a band are candidates, and candidates are confirmed on their full sets.

With ``bands`` bands of ``rows`` coordinates two documents of similarity s miss each other with
probability (1 - s^rows)^bands: 1e-5 for 38 bands of 6 at s = 0.8, 2e-8 at 0.85.

Only connections matter for the result, so pairs inside a bucket are not all listed: members are
compared with one hub per bucket first, in rounds, and after that only across components that a
bucket still holds apart - those pairs completely.  Documents with equal sets are one node from
the start.  Buckets, links and components are tables; nothing of them reaches the driver.

Sets are compared as 64-bit shingle hashes.  Defined results: a null text or one without words has
an empty set and is linked with nothing.  Rows that share a doc_id count as linked; repeated rows are
as many rows of the result.  Rows without doc_id have no component and are kept.
Other columns are ignored by ``near_copies`` and kept by ``keep_smallest``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitfold.llm.components import components
from bitfold.llm.shingles import WordHasher, mix, shingle_set, word_hashes
from bitfold.session import materialize

WIDTH, SIMILARITY_PERCENT = 5, 80
BANDS, ROWS = 38, 6
HUB_ROUNDS = 2
BLOCK_ROWS = 256  # members of one bucket that are held together


def second_permutation(x: np.ndarray) -> None:
    """A bijection of 32-bit places, in place."""
    step = np.empty_like(x)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=step)
        np.bitwise_xor(x, step, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=step)
    np.bitwise_xor(x, step, out=x)


def signature(shingles: np.ndarray, size: int, block: int = 512) -> np.ndarray:
    """``size`` circulant MinHash coordinates of a non-empty set."""
    places = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    lowest = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), block):
        image = places[None, at : at + block] + shifts
        second_permutation(image)
        np.minimum(lowest, image.min(axis=1), out=lowest)
    return lowest


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    factors = mix(np.arange(7, 7 + rows, dtype=np.uint64)) | np.uint64(1)
    sums = (mix(coordinates.astype(np.uint64).reshape(bands, rows) + np.uint64(1)) * factors).sum(axis=1, dtype=np.uint64)
    return mix(sums + mix(np.arange(1, bands + 1, dtype=np.uint64))).view(np.int64)


def sketcher(width: int, bands: int, rows: int):
    """Set size, a 128-bit digest of the set, and the band keys of each text."""
    names = ["n_shingles", "key1", "key2", "bands"]

    @F.arrow_udf("struct<n_shingles: bigint, key1: bigint, key2: bigint, bands: array<bigint>>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher()
        for texts in batches:
            sizes, first, second, keys = [], [], [], []
            for words in word_hashes(texts, hasher):
                s = shingle_set(words, width)
                sizes.append(len(s))
                first.append(int(mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                second.append(int(mix(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64).view(np.int64)))
                keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else np.zeros(0, np.int64))
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))
            numbers = [pa.array(c, pa.int64()) for c in (sizes, first, second)]
            yield pa.StructArray.from_arrays([*numbers, lists], names=names)

    return sketch


def set_reader(width: int):
    @F.arrow_udf("array<bigint>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher()
        for texts in batches:
            sets = [shingle_set(words, width).view(np.int64) for words in word_hashes(texts, hasher)]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else [], pa.int64()))

    return read


def can_reach(a: Column, b: Column, percent: int) -> Column:
    """Sets of these sizes can be as similar as asked for."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(i, j)`` whose full sets are similar enough.

    The set of ``j`` travels with the pair to its hub ``i``; splitting a hub with many partners is
    left to the skew handling of the join.
    """
    right = sets.select(F.col("node").alias("j"), F.col("shingles").alias("b"))
    left = sets.select(F.col("node").alias("i"), F.col("shingles").alias("a"))
    held = pairs.select("i", "j").join(right.hint("merge"), "j").join(left.hint("merge"), "i")
    shared = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - shared
    return held.where(shared * 100 >= union * percent).select("i", "j")


def labelled(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """``members`` of buckets that still hold more than one component, with ``component``."""
    if links is None:
        rows = members.withColumn("component", F.col("node"))
    else:
        found = components(links).select(F.col("node"), F.col("component").alias("_c"))
        rows = members.join(found, "node", "left").withColumn("component", F.coalesce("_c", "node")).drop("_c")
    apart = rows.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where(F.col("a") < F.col("b"))
    apart = materialize(apart.select("band"), "apart")  # written: see near_copies
    return materialize(rows.join(apart.hint("merge"), "band", "left_semi"), "buckets")


def hub_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Each member with one hub, hence no more pairs than members.

    A bucket's hub is its most popular member, the one with most company over all its buckets: of a
    text and its edited copies that is the text, which is nearer to the copies than they are to
    each other.  In later turns hubs are hash-chosen.  A member takes the best hub of its buckets.
    """
    if turn == 0:
        sizes = materialize(rows.groupBy("band").agg(F.count("*").alias("size")), "sizes")
        company = rows.join(sizes.hint("merge"), "band").groupBy("node").agg((-F.sum("size")).alias("order"))
        rows = rows.join(company.hint("merge"), "node")
    else:
        rows = rows.withColumn("order", F.xxhash64("node", F.lit(turn)))
    hubs = materialize(rows.groupBy("band").agg(F.min(F.struct("order", "node", "n", "component")).alias("hub")), "hubs")
    met = rows.join(hubs.hint("merge"), "band").where(F.col("component") != F.col("hub.component"))
    best = met.groupBy("node", "n").agg(F.min("hub").alias("hub"))
    return best.select(F.col("hub.node").alias("i"), F.col("node").alias("j"), F.col("hub.n").alias("n_i"), F.col("n").alias("n_j"))


def cell_links(percent: int):
    """Similar pairs from different components among the sets of one cell."""

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        node, component, block = (cell[c].to_numpy() for c in ("node", "component", "block"))
        lists = cell["shingles"].combine_chunks()
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()[ends[0] : ends[-1]]
        starts, sizes = ends[:-1] - ends[0], np.diff(ends)
        values, token = np.unique(flat, return_inverse=True)
        mark = np.zeros(len(values), np.int32)
        found_i, found_j = [], []
        across = len(set(block.tolist())) > 1
        for x in range(len(node)):
            other = (component != component[x]) & (node > node[x])
            if across:
                other &= block != block[x]
            if not other.any():
                continue
            own = token[starts[x] : starts[x] + sizes[x]]
            mark[own] = 1
            shared = np.add.reduceat(mark[token], starts)
            mark[own] = 0
            good = other & (shared * 100 >= (sizes + sizes[x] - shared) * percent)
            found_j += node[good].tolist()
            found_i += [node[x]] * int(good.sum())
        return pa.table({"i": pa.array(found_i, pa.int64()), "j": pa.array(found_j, pa.int64())})

    return compare


def crossing_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between members of one bucket that lie in different components.

    A bucket's members are cut into blocks; every two blocks meet in a cell of their own, so no
    task holds more than two blocks, whatever the bucket's size, and only links leave a cell.
    """
    sizes = rows.groupBy("band").agg(F.ceil(F.count("*") / F.lit(float(BLOCK_ROWS))).cast("int").alias("blocks"))
    sizes = materialize(sizes, "blocks")
    placed = rows.join(sizes.hint("merge"), "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = spread.select("band", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "node", "component", "block")
    full = cells.join(sets.hint("merge"), "node")
    found = full.groupBy("band", "p", "q").applyInArrow(cell_links(percent), "i bigint, j bigint")
    return found.distinct()


def linked(members: DataFrame, sets: DataFrame, percent: int, hub_rounds: int) -> DataFrame | None:
    """Links ``(i, j)`` that connect all candidates which similar pairs connect; None without candidates."""
    links, tried = None, None
    for turn in range(hub_rounds + 1):
        rows = labelled(members, links)
        if rows.isEmpty():
            break
        if turn == hub_rounds:
            return materialize(links.unionByName(crossing_links(rows, sets, percent)), "confirmed")
        pairs = hub_pairs(rows, turn).where(can_reach(F.col("n_i"), F.col("n_j"), percent))
        pairs = pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["i", "j"], "left_anti")
        pairs = materialize(pairs, "candidates")
        good = materialize(confirmed(pairs, sets, percent), "confirmed")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = good if links is None else links.unionByName(good)
    return links


def near_copies(
    documents: DataFrame, text: str = "text", width: int = WIDTH, percent: int = SIMILARITY_PERCENT,
    bands: int = BANDS, rows: int = ROWS, hub_rounds: int = HUB_ROUNDS,
) -> DataFrame:
    """``(doc_id, n_shingles, key1, key2, component_id, kept)`` for every document.

    ``component_id`` is the smallest doc_id that links of Jaccard similarity ``percent`` / 100 or
    more lead to; ``key1`` and ``key2`` identify the document's set.
    """
    read = documents.select("doc_id", F.col(f"`{text}`").alias("text"))
    sketched = read.withColumn("s", sketcher(width, bands, rows)(F.col("text"))).select("doc_id", "s.*")
    sketches = materialize(sketched, "sketches")
    named = sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(named.groupBy("key1", "key2").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n")), "classes")
    # the node's own row has the bands of its class
    own = named.select("key1", "key2", F.col("doc_id").alias("node"), "bands").join(classes, ["key1", "key2", "node"])
    places = own.select("node", "n", F.explode("bands").alias("band"))
    met = places.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("b")).where(F.col("a") < F.col("b"))
    # tables of one row per band are written before they are joined: the members of a hot band can then be split over tasks
    met = materialize(met.select("band"), "met")
    members = materialize(places.join(met.hint("merge"), "band", "left_semi").distinct(), "members")
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    texts = read.join(wanted.hint("merge"), "doc_id", "left_semi")
    sets = materialize(
        texts.select(F.col("doc_id").alias("node"), set_reader(width)(F.col("text")).alias("shingles"))
        .where(F.size("shingles") > 0), "sets",
    )
    links = linked(members, sets, percent, hub_rounds)
    slim = sketches.select("doc_id", "n_shingles", "key1", "key2")
    full = slim.join(classes.select("key1", "key2", "node").hint("merge"), ["key1", "key2"], "left")
    if links is None:
        full = full.withColumn("_c", F.lit(None).cast("bigint"))
    else:
        found = components(links).select("node", F.col("component").alias("_c"))
        full = full.join(found.hint("merge"), "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "node", "doc_id"))
    return full.select("doc_id", "n_shingles", "key1", "key2", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_smallest(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """``documents`` without those linked with a smaller doc_id."""
    dropped = near_copies(documents, text, **options).where(~F.col("kept")).select("doc_id").distinct()
    return documents.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_copies(documents, width=4).select("doc_id", "n_shingles", "component_id", "kept")


#: Every pair of documents that share a shingle, and the components by walking the links.
OP9_SQL = r"""
WITH RECURSIVE
worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM worded),
sized AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
single AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM sets),
met AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS common FROM single a JOIN single b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT i, j FROM met JOIN sized a ON a.doc_id = i JOIN sized b ON b.doc_id = j
    WHERE 100 * common >= 80 * (a.n + b.n - common)),
both_ways AS MATERIALIZED (SELECT i, j FROM links UNION SELECT j, i FROM links),
reached AS (SELECT doc_id, doc_id AS seen FROM sized UNION SELECT both_ways.j, seen FROM reached JOIN both_ways ON both_ways.i = reached.doc_id),
least_seen AS (SELECT doc_id, min(seen) AS component_id FROM reached GROUP BY doc_id)
SELECT sized.doc_id, n AS n_shingles, component_id, sized.doc_id = component_id AS kept FROM sized JOIN least_seen USING (doc_id)
"""
