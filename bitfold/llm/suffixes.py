"""Exact substring dedup by suffix arrays.

A string of ``length`` bytes is removed where an equal one starts earlier in the corpus.  Every such
string holds an anchor: of its ``GRAM``-byte pieces the one with the smallest hash.  Equal strings
have equal anchors, so strings meet in the shard of their anchor, and only anchors that occur more
than once go on.  Occurrences of an anchor with the same surroundings are settled by counting;
the distinct surroundings of an anchor are laid end to end in a shard, whose suffix array is
built by induced sorting.  The permuted common prefixes tell which neighbours in the array share
``length`` bytes; those are equal strings, and all but the earliest are marked.

An anchor with more than ``CROWDED`` distinct surroundings would outgrow a task, so it is lengthened:
each of its strings goes on a way to the left or to the right of the anchor, and meets its equals under
the bytes that it has there.  This is repeated, six times at most, until every anchor fits its shard or
is as long as the strings.

Surroundings of one anchor are taken as equal when their shapes and 64-bit digests agree; two that
differ do so with probability 2^-64.  Everything else compares bytes.

Defined results: null counts as empty; documents are ordered by doc_id; rows that share a doc_id
are one document each, ordered by a digest of the text; of equal repeated rows each has a result,
and all but one are copies.  A null doc_id comes first.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitfold.llm.shingles import FACTOR, mix
from bitfold.llm.suffixarray import permuted_prefixes, suffix_array
from bitfold.operators.ranking import ordered_rank
from bitfold.session import materialize

LENGTH, GRAM = 100, 40
SHARD_BYTES = 1 << 20  # text of one suffix array
CROWDED = 20_000  # surroundings of one anchor from which it is lengthened
PLACE = np.uint64((1 << 24) - 1)
PIECE = 1 << 22  # bytes of one text that are scanned at a time


class AnchorFinder:
    """Anchors of all ``length``-byte strings of a text."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.value = mix(np.arange(1001, 1257, dtype=np.uint64))
        self.powers = self.inverse = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            back = np.uint64(pow(int(FACTOR), -1, 1 << 64))
            self.powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, FACTOR))))
            self.inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, back))))

    def find(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per anchor: hash of its bytes, digest of its surroundings, first string, further strings, bytes before it."""
        parts, at, step = [], 0, PIECE
        while at + self.length <= len(data):
            piece = data[at : at + step + self.length - 1]
            anchor, around, first, more, lead = self.piece(piece)
            parts.append((anchor, around, first + at, more, lead))
            at += step
        if not parts:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(c) for c in zip(*parts))

    def piece(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        n, k = len(data), self.gram
        self.reach(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(self.value[data] * self.powers[:n], out=total[1:])
        grams = mix((total[k:] - total[:-k]) * self.inverse[: n - k + 1])
        keys = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
        width, low, have = self.length - k + 1, keys, 1
        while have < width:  # smallest key of the next ``have`` pieces, doubled until it spans a string
            step = min(have, width - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        place = (low & PLACE).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        last = np.concatenate((first[1:] - 1, [len(place) - 1]))
        anchor = place[first]
        around = (total[last + self.length] - total[first]) * self.inverse[first]
        shape = ((anchor - first) * 256 + (last - first)).astype(np.uint64)
        digest = mix(around ^ mix(shape + np.uint64(1)))
        return grams[anchor].view(np.int64), digest.view(np.int64), first, last - first, anchor - first


def anchors(length: int, gram: int):
    """``array<struct<anchor, around, first, more, lead>>`` of each text."""
    kind = "array<struct<anchor: bigint, around: bigint, first: bigint, more: int, lead: int>>"

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = AnchorFinder(length, gram)
        for texts in batches:
            rows = [finder.find(np.frombuffer(t, np.uint8)) for t in texts_as_bytes(texts)]
            ends = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows]))).astype(np.int32)
            cells = [np.concatenate(c) if rows else np.zeros(0, np.int64) for c in (zip(*rows) if rows else [[]] * 5)]
            values = pa.StructArray.from_arrays(
                [pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                names=["anchor", "around", "first", "more", "lead"],
            )
            yield pa.ListArray.from_arrays(pa.array(ends), values)

    return run


def texts_as_bytes(texts: pa.Array) -> Iterator[bytes]:
    for t in texts.cast(pa.binary() if not pa.types.is_large_string(texts.type) else pa.large_binary()):
        yield t.as_py() or b""


def numbered(documents: DataFrame, text: str) -> DataFrame:
    """``(doc_id, doc, text)``: ``doc`` orders the documents and tells them apart.

    It is the doc_id itself, unless that is null or occurs twice somewhere; then documents are
    numbered by (doc_id, digest of the text, number of the row).
    """
    read = documents.select("doc_id", F.col(f"`{text}`").alias("text"))
    per_id = read.groupBy("doc_id").count()
    if per_id.where((F.col("count") > 1) | F.col("doc_id").isNull()).isEmpty():
        return read.select("doc_id", F.col("doc_id").alias("doc"), "text")
    # written, so that the numbers of the rows stay
    rows = materialize(read.withColumn("row", F.monotonically_increasing_id()), "rows")
    keys = rows.select(F.struct("doc_id", F.xxhash64("text").alias("mark"), "row").alias("key"))
    ranks = ordered_rank(keys, "key", "doc").select(F.col("key.row").alias("row"), "doc")
    return materialize(rows.join(ranks.hint("merge"), "row").select("doc_id", "doc", "text"), "numbered")


def shard_marker(length: int):
    """Earlier copies among the distinct surroundings of one shard, by its suffix array."""

    def mark(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("doc", "ascending"), ("first", "ascending")]).combine_chunks()
        doc, first, more = (shard[c].to_numpy() for c in ("doc", "first", "more"))
        pieces = shard["piece"].to_pylist()
        # documents and places ascend, so text order in the shard is corpus order
        sizes = np.array([len(p) + 1 for p in pieces])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        letters = data.astype(np.int64) + 1
        letters[starts + sizes - 1] = 0
        counts = more.astype(np.int64) + 1
        own = np.zeros(len(data), bool)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        places = np.repeat(starts, counts) + inside
        own[places] = True
        order = suffix_array(letters)
        run = np.cumsum(permuted_prefixes(letters, order)[order] < length)  # suffixes of a run share ``length`` bytes
        order, run = order[own[order]], run[own[order]]
        begins = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        lowest = np.repeat(np.minimum.reduceat(order, begins), np.diff(np.append(begins, len(order))))
        copied = np.zeros(len(data), bool)
        copied[order[order != lowest]] = True
        hit = copied[places]
        owner = np.repeat(np.arange(len(pieces)), counts)
        new = hit & np.concatenate(([True], ~hit[:-1] | (owner[1:] != owner[:-1])))
        stop = hit & np.concatenate((~hit[1:] | (owner[1:] != owner[:-1]), [True]))
        who = owner[new]
        begin = first[who] + inside[new]
        end = first[owner[stop]] + inside[stop] + length
        return pa.table({"doc": pa.array(doc[who], pa.int64()), "start": pa.array(begin, pa.int64()), "end": pa.array(end, pa.int64())})

    return mark


def copied_ranges(
    texts: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, crowded: int = CROWDED
) -> DataFrame:
    """``(doc, start, end)``: byte ranges of ``texts(doc, text)`` that copy something earlier; they may overlap."""
    found = texts.select("doc", F.inline(anchors(length, gram)("text")))
    repeated = materialize(found.groupBy("anchor").count().where(F.col("count") > 1).select("anchor"), "anchors")
    uses = materialize(found.join(repeated.hint("merge"), "anchor"), "uses")
    spot = F.struct("doc", "first", "more", "lead")
    around = materialize(uses.groupBy("anchor", "around").agg(F.min(spot).alias("spot")), "around")
    later = uses.join(around.hint("merge"), ["anchor", "around"])
    ranges = whole_copies(later, length)
    mixed = around.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    wanted = around.join(mixed.hint("merge"), "anchor").select("anchor", "n", "spot.*")
    pieces, width = materialize(cut_out(wanted, texts, length), "pieces"), gram
    while True:
        fits = F.col("n") <= crowded
        size = pieces.agg(F.sum(F.when(fits, F.octet_length("piece"))).alias("bytes"), F.max("n").alias("most")).first()
        if size["bytes"]:
            ranges = ranges.unionByName(copied_in_shards(pieces.where(fits), -(-size["bytes"] // shard_bytes), length))
        if (size["most"] or 0) <= crowded or width == length:
            return ranges
        pieces, copies, width = lengthened(pieces.where(~fits), width, length)
        ranges = ranges.unionByName(copies)


def whole_copies(later: DataFrame, length: int) -> DataFrame:
    """The ranges of surroundings next to the ``spot`` of the earliest equal ones, that itself left out."""
    again = later.where((F.col("doc") != F.col("spot.doc")) | (F.col("first") != F.col("spot.first")))
    return again.select("doc", F.col("first").alias("start"), (F.col("first") + F.col("more") + length).alias("end"))


def copied_in_shards(pieces: DataFrame, shards: int, length: int) -> DataFrame:
    """The ranges that suffix arrays find; the surroundings of an anchor share a shard."""
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return sharded.select("shard", "doc", "first", "more", "piece").groupBy("shard").applyInArrow(
        shard_marker(length), "doc bigint, start bigint, end bigint"
    )


def lengthened(pieces: DataFrame, width: int, length: int) -> tuple[DataFrame, DataFrame, int]:
    """``pieces`` under anchors longer than ``width``, the ranges settled on the way, and the new width.

    A string has ``length - width`` bytes beside its anchor, so half of them or more lie on one side.  Strings
    with enough bytes on the left go by those and the anchor, the others by the anchor and those on the right.
    Equal strings have their anchor at the same place and stay together.
    """
    grow = (length - width + 1) // 2
    reach = F.col("lead") - grow  # the last string with enough bytes on the left
    left = F.struct(F.lit(0).alias("low"), F.least("more", reach).alias("high"), F.lit(grow).alias("back"))
    right = F.struct(F.greatest(F.lit(0), reach + 1).alias("low"), F.col("more").alias("high"), F.lit(0).alias("back"))
    split = pieces.withColumn("part", F.explode(F.array(left, right))).where("part.low <= part.high")
    low, back, more = F.col("part.low"), F.col("part.back"), F.col("part.high") - F.col("part.low")
    longer = split.select(
        F.xxhash64("part.back", F.substring("piece", F.col("lead") - back + 1, F.lit(width + grow))).alias("anchor"),
        "doc",
        (F.col("first") + low).alias("first"),
        more.alias("more"),
        (F.col("lead") - back - low).alias("lead"),
        F.substring("piece", low + 1, more + length).alias("piece"),
    )
    alike = ["anchor", "lead", "piece"]
    distinct = materialize(longer.groupBy(*alike).agg(F.min(F.struct("doc", "first", "more")).alias("spot")), "alike")
    copies = whole_copies(longer.join(distinct.hint("merge"), alike), length)
    mixed = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > 1), "mixed")
    wanted = distinct.join(mixed.hint("merge"), "anchor").select("anchor", "n", "spot.*", "lead", "piece")
    return materialize(wanted, "longer"), copies, width + grow


def cut_out(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """``wanted`` with the bytes of its strings; one list per document fetches them from its text."""
    spots = F.collect_list(F.struct("anchor", "n", "first", "more", "lead")).alias("spots")
    by_doc = wanted.groupBy("doc").agg(spots)
    data = texts.join(by_doc.hint("merge"), "doc").select("doc", F.col("text").cast("binary").alias("data"), "spots")
    each = data.select("doc", "data", F.inline("spots"))
    piece = F.substring("data", F.col("first").cast("int") + 1, F.col("more") + length)
    return each.select("anchor", "n", "doc", "first", "more", "lead", piece.alias("piece"))


def remover():
    """Sizes and the digest of what is left, from a text and the ranges to remove."""
    names = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}

    @F.arrow_udf("struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string>")
    def remove(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ranges in batches:
            rows = []
            for data, spans in zip(texts_as_bytes(texts), ranges):
                merged = union_of(spans.values) if spans.is_valid else []
                digest, at = hashlib.sha256(), 0
                for start, end in merged:
                    digest.update(data[at:start])
                    at = end
                digest.update(data[at:])
                rows.append((len(data), sum(e - s for s, e in merged), len(merged), digest.hexdigest()))
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, names.values())], names=list(names))

    return remove


def union_of(spans: pa.StructArray) -> list[tuple[int, int]]:
    """Maximal runs covered by ``spans``; runs that touch are one."""
    start, end = spans.field("start").to_numpy(zero_copy_only=False), spans.field("end").to_numpy(zero_copy_only=False)
    turn = np.argsort(start, kind="stable")
    start, reach = start[turn], np.maximum.accumulate(end[turn])
    new = np.concatenate(([True], start[1:] > reach[:-1])) if len(start) else np.zeros(0, bool)
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:] - 1, len(start) - 1) if len(firsts) else firsts
    return list(zip(start[firsts].tolist(), reach[lasts].tolist()))


def remove_copies(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every document."""
    texts = numbered(documents, text)
    ranges = copied_ranges(texts.select("doc", "text"), **options)
    by_doc = ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    judged = texts.join(by_doc.hint("merge"), "doc", "left").select("doc_id", "doc", remover()(F.col("text"), F.col("ranges")).alias("r"))
    return judged.select("doc_id", "r.*")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_copies(documents.select("doc_id", "text"))
