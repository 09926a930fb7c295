"""Spelling variants: words one edit apart, found through Bloom filters of the vocabulary.

Words are counted over all texts.  The vocabulary is entered into blocked Bloom filters, one for each word
length, which every task gets.  For every word the neighbourhood is generated as hashes only: a word's hash is
a sum over its letters and their places, so the hash of a word with one letter replaced or deleted comes from
a few additions.  Edits the filter of their length does not know are gone; the others become words and are
joined with the vocabulary, which removes the filters' false positives.  Insertions are the deletions of
the longer word, and a replacement is generated from the side with the smaller letter, so each pair of near words
is generated once.

The most frequent near word is a word's form if it is ``ratio`` times as frequent or more, and forms
are followed to the last by joins of the table of forms with itself, doubling the distance each time; a chain
is no longer than the logarithm of the largest count.

Sizes: the filters have ``WORD_BITS`` bits for a word, but no more than ``MAX_BYTES`` in all.  A vocabulary
that outgrows this gets denser filters and with them more false positives to join, never a lost pair.  The driver
holds the filters, the letters in use and a count for each length.  A word has no more neighbours than letters times
places, so no join key is hot.  Words of one length are handled in pieces of ``CHUNK`` hashes, however long they are.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one in the draw of the
deleted letter; repeated rows count again.  Other columns are ignored; empty tables give no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitfold.llm.digests import crc32_sql
from bitfold.llm.shingles import mix
from bitfold.session import materialize, spread

# fixed values: the letters of a run once A-Z are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
DROP_EVERY = 31  # one in so many occurrences loses a letter
RATIO = 10

LONGEST = 64  # words of this length or more share a filter
WORD_BITS = 16
LANES = 8  # 64-bit words of a block; each holds one bit of an entry
MAX_BYTES = 64 << 20
LEAST_BLOCKS = 32
CHUNK = 1 << 20  # hashes at a time


def vocabulary(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """``(word, n)``: runs of letters, some of which lose the letter that their document and they draw."""
    runs = F.regexp_extract_all(F.translate(F.col(f"`{text}`"), UPPER, LOWER), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))
    read = spread(documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`"))).select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")
    )
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(h % drop_every == 0, shorter).otherwise(F.col("run"))
    words = read.select(word.alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letter_hash(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """What a letter at a place adds to the hash of its word."""
    return mix((place.astype(np.uint64) << np.uint64(8) | letter.astype(np.uint64)) + np.uint64(0x632BE59BD9B4E019))


def finished(total: np.ndarray, length: int) -> np.ndarray:
    return mix(total ^ np.uint64(length * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


@dataclass(frozen=True)
class Filters:
    """Blocked Bloom filters: ``bits[first + block, lane]``; a length has its first block and their number."""

    first: np.ndarray
    blocks: np.ndarray
    bits: np.ndarray

    def block(self, hashes: np.ndarray, length: int) -> np.ndarray:
        shard = min(length, LONGEST)
        many = np.uint64(self.blocks[shard])
        return self.first[shard] + ((hashes >> np.uint64(32)) * many >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def bit(hashes: np.ndarray, lane: int) -> np.ndarray:
        """The place inside a lane: six bits of the low half, spread anew for each lane."""
        odd = np.uint64((0x9E3779B1 * (2 * lane + 1)) | 1)
        return (hashes & np.uint64(0xFFFFFFFF)) * odd >> np.uint64(20) & np.uint64(63)

    def known(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Indexes of the (flat) hashes that may be words of this length; lane by lane, fewer each time."""
        if not self.blocks[min(length, LONGEST)]:
            return np.zeros(0, np.int64)
        left = np.arange(len(hashes))
        block = self.block(hashes, length)
        for lane in range(LANES):
            hit = self.bits[block, lane] >> self.bit(hashes, lane) & np.uint64(1) != 0
            left, block, hashes = left[hit], block[hit], hashes[hit]
        return left


def planned(vocab: DataFrame, word_bits: int, max_bytes: int) -> Filters:
    """Empty filters, sized for ``vocab`` within ``max_bytes``."""
    shard = F.least(F.char_length("word"), F.lit(LONGEST)).alias("shard")
    sizes = vocab.groupBy(shard).agg(F.count("*").alias("n")).collect()  # one row per length up to LONGEST
    per_block = 64 * LANES
    wanted = np.zeros(LONGEST + 1, np.int64)
    for r in sizes:
        wanted[r["shard"]] = max(LEAST_BLOCKS, -(-r["n"] * word_bits // per_block))
    most = max_bytes // (8 * LANES)
    if wanted.sum() > most:
        wanted = np.where(wanted > 0, np.maximum(1, (wanted * (most / wanted.sum())).astype(np.int64)), 0)
    first = np.concatenate(([0], np.cumsum(wanted)[:-1]))
    return Filters(first, wanted, np.zeros((int(wanted.sum()), LANES), np.uint64))


def matrices(words: list[str], cells: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, indexes, letters): words of one length as rows of a matrix of up to ``cells`` letters."""
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for length, held in by_length.items():
        step = max(1, cells // length)
        for at in range(0, len(held), step):
            some = held[at : at + step]
            letters = np.frombuffer("".join(words[k] for k in some).encode("latin-1"), np.uint8)
            yield length, np.array(some), letters.reshape(len(some), length)


def filled(vocab: DataFrame, word_bits: int = WORD_BITS, max_bytes: int = MAX_BYTES) -> Filters:
    """The filters of a vocabulary: blocks are combined in Spark; the driver gets each of them once."""
    empty = planned(vocab, word_bits, max_bytes)
    plan = Filters(empty.first, empty.blocks, np.zeros((0, LANES), np.uint64))
    names = ["block", *(f"b{lane}" for lane in range(LANES))]

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, letters in matrices(batch.column(0).to_pylist(), CHUNK):
                total = letter_hash(np.arange(length)[None, :], letters).sum(axis=1, dtype=np.uint64)
                hashes = finished(total, length)
                columns = [plan.block(hashes, length)]
                columns += [(np.uint64(1) << plan.bit(hashes, lane)).view(np.int64) for lane in range(LANES)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    entries = vocab.select("word").mapInArrow(enter, ", ".join(f"{c} bigint" for c in names))
    blocks = entries.groupBy("block").agg(*[F.bit_or(c).alias(c) for c in names[1:]]).toArrow()
    at = blocks.column(0).to_numpy()
    for lane in range(LANES):
        empty.bits[at, lane] = blocks.column(lane + 1).to_numpy().view(np.uint64)
    return empty


def edits(letters: np.ndarray, alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, letter) of the edits of a matrix of equally long words that the filters know; letter 0 deletes."""
    m, length = letters.shape
    own = letter_hash(np.arange(length)[None, :], letters)
    total = own.sum(axis=1, dtype=np.uint64)
    step = max(1, CHUNK // max(1, m * len(alphabet)))
    for at in range(0, length, step):
        places = np.arange(at, min(length, at + step))
        new = letter_hash(places[:, None], alphabet[None, :])
        hashes = finished((total[:, None] - own[:, places])[:, :, None] + new[None, :, :], length).reshape(-1)
        hit = filters.known(hashes, length)
        row, place, letter = np.unravel_index(hit, (m, len(places), len(alphabet)))
        up = alphabet[letter] > letters[row, places[place]]
        yield row[up], places[place[up]], alphabet[letter[up]]
    moved = letter_hash(np.maximum(np.arange(length) - 1, 0)[None, :], letters)
    front = np.cumsum(own, axis=1, dtype=np.uint64) - own
    back = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
    hit = filters.known(finished(front + back, length - 1).reshape(-1), length - 1)
    row, place = np.unravel_index(hit, letters.shape)
    # of equal letters in a row the last one is deleted: the word is the same
    last = (place == length - 1) | (letters[row, np.minimum(place + 1, length - 1)] != letters[row, place])
    yield row[last], place[last], np.zeros(int(last.sum()), np.uint8)


def probes(vocab: DataFrame, filters: Filters, alphabet: np.ndarray) -> DataFrame:
    """``(word, n, near)``: edits of each word that the filters let through."""
    shared = vocab.sparkSession.sparkContext.broadcast(filters)
    cells = max(1, CHUNK // max(1, len(alphabet)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for _, index, letters in matrices(words, cells):
                for row, place, letter in edits(letters, alphabet, known):
                    if not len(row):
                        continue
                    source = index[row]
                    near = [
                        words[k][:p] + (chr(c) if c else "") + words[k][p + 1 :] for k, p, c in zip(source, place.tolist(), letter.tolist())
                    ]
                    found = [pa.array([words[k] for k in source]), pa.array(counts[source]), pa.array(near)]
                    yield pa.RecordBatch.from_arrays(found, names=["word", "n", "near"])

    return vocab.select("word", "n").mapInArrow(probe, "word string, n bigint, near string")


def letters_of(vocab: DataFrame) -> np.ndarray:
    """The letters in use, in order: at most 26 + 64."""
    held = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()
    return np.array(sorted(ord(r["c"]) for r in held), np.uint8)


def last_forms(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: forms followed until a word has none."""
    roots = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = materialize(step, "roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            return roots


def variants(
    documents: DataFrame, text: str = "text", doc_id: str = "doc_id", ratio: int = RATIO,
    word_bits: int = WORD_BITS, max_bytes: int = MAX_BYTES, **counting,
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of the vocabulary."""
    vocab = materialize(vocabulary(documents, text, doc_id, **counting), "vocabulary")
    candidates = probes(vocab, filled(vocab, word_bits, max_bytes), letters_of(vocab))
    pairs = candidates.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    pairs = materialize(pairs.select("word", "n", "near", "near_n"), "near-words")
    both = pairs.select("word", "near", "near_n").unionByName(
        pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    )
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form")))
    around = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form_n = F.when(-F.col("best.n") >= F.col("n") * ratio, -F.col("best.n"))
    judged = vocab.join(around, "word", "left").withColumn("form_n", form_n).select(
        "word", F.when(F.col("form_n").isNotNull(), F.col("best.form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n",
    )
    judged = materialize(judged, "forms")
    roots = last_forms(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op13_sql() -> str:
    """The same words, compared through all strings that one deletion leaves."""
    runs = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]{{{LEAST_LENGTH},}}')"
    return f"""
WITH RECURSIVE run AS (SELECT doc_id, unnest({runs}) AS r FROM documents),
many AS (SELECT r, h, count(*) AS n FROM (SELECT r, {crc32_sql("doc_id || ':' || r")} AS h, doc_id FROM run) GROUP BY r, h, doc_id),
said AS (SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM many),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM said WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
    UNION SELECT a.word, v.word, v.n FROM cut a JOIN v ON a.rest = v.word
    UNION SELECT v.word, a.word, a.n FROM cut a JOIN v ON a.rest = v.word),
ranked AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS k FROM pairs),
judged AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n
    FROM v LEFT JOIN (SELECT * FROM ranked WHERE k = 1) USING (word)),
walk(word, place, form) AS (SELECT word, word, form FROM judged
    UNION ALL SELECT walk.word, judged.word, judged.form FROM walk JOIN judged ON judged.word = walk.form)
SELECT judged.word, judged.form, walk.place AS root, n, n_near, form_n FROM judged JOIN walk ON walk.word = judged.word AND walk.form IS NULL"""
