"""Importance resampling towards a target distribution.

Texts are bags of hashed words.  Counted over all documents and over all target texts, every bucket
has a gain: the scaled logarithm of how much more common it is in the target.  A document's weight is
the sum of the gains of its words, looked up in one array, and its score adds Gumbel noise drawn from
its id, so the documents with the highest scores are a sample without replacement.

The highest scores are found without sorting all documents: scores are written once, and exact counts
over that table narrow the cutoff down, first in the score, then in the doc_id of those tied at it,
then in the number of the written row.  Every job counts ``PROBES`` cutoffs at once.  Only the rows drawn
are range-partitioned and numbered.

The driver holds two arrays of ``n_buckets`` counts and one number for each probe.  Tasks read texts in pieces
of about ``CHUNK`` bytes; a piece ends between words, so a very long text needs no more memory.

Defined results: null and empty texts have no features, weight 0 and the noise alone as score.  A null
doc_id counts as an empty one in the noise and comes first among ties.  Repeated rows have equal scores
and take consecutive ranks, so the cutoff can part them.  An empty target leaves the gains to the smoothing;
an empty table gives an empty result.  Other columns stay; columns named like the results are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitfold.llm.digests import crc32_sql
from bitfold.session import materialize, spread

N_BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
PROBES = 15  # cutoffs counted in one job
CHUNK = 1 << 20  # bytes of text that are read at a time
LONG_WORD = 64  # bytes; the few longer words are hashed one by one
RESULTS = ("n_features", "weight", "score", "rank")


def crc_table() -> np.ndarray:
    """The byte table of the reflected CRC-32 polynomial."""
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, (rows >> 1) ^ np.uint32(0xEDB88320), rows >> 1)
    return rows


class WordBuckets:
    """Buckets of the words of many texts at a time: runs of ASCII letters and digits and of other characters, A-Z as a-z."""

    def __init__(self, n_buckets: int):
        self.n_buckets = n_buckets
        self.table = crc_table()
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[ord("A") : ord("Z") + 1] += 32
        self.ink = np.arange(256) >= 0x80
        for first, last in ("09", "az", "AZ"):
            self.ink[ord(first) : ord(last) + 1] = True

    def buckets(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """CRC-32 of ``data[start:end]``, a byte of all words at once, longest words first."""
        sizes = ends - starts
        crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
        order = np.argsort(-np.minimum(sizes, LONG_WORD + 1), kind="stable")
        order = order[int((sizes > LONG_WORD).sum()) :]
        at, left = starts[order], sizes[order]
        part = crc[order]
        live = len(order)
        for k in range(int(left[0]) if live else 0):
            while live and left[live - 1] <= k:
                live = int(np.searchsorted(-left, -k, side="left"))
            part[:live] = self.table[(part[:live] ^ data[at[:live] + k]) & 255] ^ (part[:live] >> np.uint32(8))
        crc[order] = part ^ np.uint32(0xFFFFFFFF)
        for w in np.flatnonzero(sizes > LONG_WORD):
            crc[w] = zlib.crc32(data[starts[w] : ends[w]])
        return (crc % np.uint32(self.n_buckets)).astype(np.int64)

    def piece_end(self, raw: np.ndarray, stop: int, limit: int) -> int:
        """The first place from ``stop`` on where no word goes on, ``limit`` (its text's end) at the latest."""
        while stop < limit and self.ink[raw[stop - 1]]:
            gap = np.flatnonzero(~self.ink[raw[stop : min(limit, stop + CHUNK)]])
            if len(gap):
                return stop + int(gap[0])
            stop = min(limit, stop + CHUNK)
        return stop

    def read(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each piece of the batch: the text every word stands in, and its bucket."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, buffer = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if buffer is None or not len(texts):
            return
        raw = np.frombuffer(buffer, np.uint8)
        at, last = int(ends[0]), int(ends[-1])
        while at < last:
            stop = min(at + CHUNK, last)
            stop = self.piece_end(raw, stop, int(ends[np.searchsorted(ends, stop)]))
            data = self.lower[raw[at:stop]]
            ink = self.ink[data]
            before, after = np.zeros(len(ink), bool), np.zeros(len(ink), bool)
            before[1:], after[:-1] = ink[:-1], ink[1:]
            borders = ends[np.searchsorted(ends, at, side="right") : np.searchsorted(ends, stop)] - at
            before[borders], after[borders - 1] = False, False
            starts, stops = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
            yield np.searchsorted(ends, at + starts, side="right") - 1, self.buckets(data, starts, stops)
            at = stop


def bucket_counts(texts: DataFrame, text: str, n_buckets: int) -> list[int]:
    """How often each bucket occurs in all texts: one row per bucket and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = WordBuckets(n_buckets), np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, buckets in reader.read(batch.column(0)):
                total += np.bincount(buckets, minlength=n_buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    parts = spread(texts.select(F.col(f"`{text}`").alias("text"))).mapInArrow(count, "bucket bigint, n bigint")
    out = [0] * n_buckets
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most n_buckets rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + b) / ((s + 1) (T + b)))) for each of b buckets."""
    b = len(source)
    all_s, all_t = float(sum(source) + b), float(sum(target) + b)
    ratio = (((t + 1.0) * all_s) / ((s + 1.0) * all_t) for s, t in zip(source, target))
    return np.array([math.floor(1000.0 * math.log(r)) for r in ratio], np.int64)


def weigher(gain: np.ndarray):
    """A scalar function over texts: number of features, and sum of their gains."""

    @F.arrow_udf("struct<n_features: bigint, weight: bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = WordBuckets(len(gain))
        for texts in batches:
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for owner, buckets in reader.read(texts):
                if len(owner):
                    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                    n[owner[first]] += np.diff(np.append(first, len(owner)))
                    weight[owner[first]] += np.add.reduceat(gain[buckets], first)
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(weight)], names=["n_features", "weight"])

    return run


def noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)) for the u in (0, 1) that the id draws."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.ln(-F.ln(u)) * -1000.0)


def least_reaching(rows: DataFrame, key: Column, wanted: int, probes: int) -> int:
    """The smallest value that at least ``wanted`` rows do not exceed; counted, never sorted."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while low < high:
        marks = sorted({low + (high - low) * k // (probes + 1) for k in range(probes + 1)})
        counts = rows.agg(*[F.count_if(key <= m) for m in marks]).first()
        enough = next((i for i, n in enumerate(counts) if n >= wanted), len(marks))
        high = marks[enough] if enough < len(marks) else high
        low = marks[enough - 1] + 1 if enough else low
    return low


def rank_keys() -> list[Column]:
    """What ranks follow, lowest first, in the written scores."""
    return [-F.col("score"), F.coalesce("id", F.lit(-(1 << 63)).cast("bigint")), F.col("number")]


def drawn(rows: DataFrame, wanted: int, probes: int) -> Column:
    """Whether a row is among the ``wanted`` first by ``rank_keys``."""
    if wanted <= 0:
        return F.lit(False)
    chosen, tied = F.lit(False), F.lit(True)
    for key in rank_keys():
        cut = least_reaching(rows.where(tied), key, wanted, probes)
        below, equal = rows.where(tied).agg(F.count_if(key < cut), F.count_if(key == cut)).first()
        if below + equal == wanted:
            return chosen | (tied & (key <= cut))
        chosen, tied = chosen | (tied & (key < cut)), tied & (key == cut)
        wanted -= below
    return chosen


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3...: range partitions are written, counted and numbered one by one."""
    keys = rank_keys()
    parts = rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "drawn")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition: bounded by the shuffle partition count
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    return parts.join(F.broadcast(starts), "part").withColumn("rank", (F.col("start") + inside).cast("bigint")).drop("part", "start")


def resample(
    documents: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", doc_id: str = "doc_id",
    n_buckets: int = N_BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, probes: int = PROBES,
) -> DataFrame:
    """``documents`` without the text, with ``RESULTS``; ``rank`` is null for those not drawn.

    Of the N documents with ``least_words`` words or more, floor(percent * N / 100) are drawn.
    """
    gain = gains(bucket_counts(documents, text, n_buckets), bucket_counts(target, target_text, n_buckets))
    others = [c for c in documents.columns if c != text and c not in RESULTS]
    # the other columns travel in a struct, so none of their names can meet a working name
    read = spread(documents).select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), F.col(f"`{doc_id}`").alias("id"), weigher(gain)(F.col(f"`{text}`")).alias("w"),
    )
    scored = read.select(
        "others", "id", "w.n_features", "w.weight", (F.col("w.weight") + noise(F.col("id"), seed)).cast("bigint").alias("score"),
        F.monotonically_increasing_id().alias("number"),
    )
    scored = materialize(scored, "scores")
    enough = F.col("n_features") >= least_words
    keys = scored.where(enough).select("score", "id", "number")
    chosen = enough & drawn(keys, keys.count() * percent // 100, probes)
    ranks = numbered(scored.where(chosen)).unionByName(scored.where(~chosen).withColumn("rank", F.lit(None).cast("bigint")))
    return ranks.select(*[F.col(f"others.`{c}`") for c in others], *RESULTS)


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return resample(documents.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_sql() -> str:
    """The same rows, with every score sorted."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
    h = f"('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT"
    return f"""
WITH dw AS (SELECT doc_id, unnest({words}) AS w FROM documents),
tw AS (SELECT unnest({words}) AS w FROM benchmark),
names AS (SELECT w, {crc32_sql('w')} % {N_BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM tw)),
sb AS (SELECT b, count(*) AS n FROM dw JOIN names USING (w) GROUP BY b),
tb AS (SELECT b, count(*) AS n FROM tw JOIN names USING (w) GROUP BY b),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM sb)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM tb)::DOUBLE AS t),
gain AS (SELECT sb.b, floor(1000::DOUBLE * ln(((coalesce(tb.n, 0) + 1)::DOUBLE * (sums.s + {N_BUCKETS}))
    / ((sb.n + 1)::DOUBLE * (sums.t + {N_BUCKETS}))))::BIGINT AS g FROM sb LEFT JOIN tb USING (b) CROSS JOIN sums),
weighed AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS weight FROM dw JOIN names USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000::DOUBLE * ln(-ln(({h} + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM documents LEFT JOIN weighed USING (doc_id)),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n_all
    FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n_all // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranks USING (doc_id)"""
