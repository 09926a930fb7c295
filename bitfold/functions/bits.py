"""Bit sketches packed 63 to a BIGINT word (so a word is never negative)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 63
UNROLLED_WORDS = 24  # longer unrolled expressions outgrow what the JVM compiles


def n_words(k: int) -> int:
    return -(-k // WORD_BITS)


def bit_at(position: Column) -> Column:
    """The bit of ``position`` inside its own word."""
    one = F.lit(1).cast("bigint")
    return F.call_function("shiftleft", one, (position % WORD_BITS).cast("int"))


def packed(position: Column, k: int, combine) -> Column:
    """Aggregate bucket positions into an ARRAY<BIGINT> of ceil(k / 63) words.

    ``combine`` is ``F.bit_or`` (presence) or ``F.bit_xor`` (parity).  Rows with a NULL
    position set no bit, so an empty row gets all-zero words.
    """
    word = F.floor(position / WORD_BITS)
    zero = F.lit(0).cast("bigint")
    bit = bit_at(position)
    return F.array(
        *[F.coalesce(combine(F.when(word == w, bit)), zero) for w in range(n_words(k))]
    )


def packed_long(docs: DataFrame, bucketed: DataFrame, k: int, combine) -> DataFrame:
    """``packed`` for long sketches: combine per (row, word) first, then place the words.

    One case per word and item would cost k / 63 tests per item; here an item is touched once.
    """
    word = F.floor(F.col("bucket") / WORD_BITS).alias("word")
    words = bucketed.groupBy("doc_id", word).agg(combine(bit_at(F.col("bucket"))).alias("bits"))
    entry = F.struct("word", "bits").alias("entry")
    nothing = F.lit(None).cast("struct<word:bigint,bits:bigint>").alias("entry")
    rows = docs.select("doc_id", nothing).unionByName(words.select("doc_id", entry))
    placed = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list("entry")).alias("m"))
    every_word = F.sequence(F.lit(0).cast("bigint"), F.lit(n_words(k) - 1).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    sketch = F.transform(every_word, lambda w: F.coalesce(F.try_element_at("m", w), zero))
    return placed.select("doc_id", sketch.alias("sketch"))


def packed_lengths(docs: DataFrame, bucketed: DataFrame, lengths, combine) -> DataFrame:
    """``(k, doc_id, sketch)`` for several lengths at once, from ``bucketed(doc_id, key)``.

    ``key`` is the number that is taken modulo each k.  An item gives one row per length to a map-side combined
    aggregation by (length, row, word); rows without items get all-zero words.
    """
    lengths = sorted(set(lengths))
    each = F.explode(F.array(*[F.lit(k).cast("bigint") for k in lengths])).alias("k")
    tall = bucketed.select("doc_id", "key", each).withColumn("bucket", F.col("key") % F.col("k"))
    word = F.floor(F.col("bucket") / WORD_BITS).alias("word")
    words = tall.groupBy("k", "doc_id", word).agg(combine(bit_at(F.col("bucket"))).alias("bits"))
    entry = F.struct("word", "bits").alias("entry")
    nothing = F.lit(None).cast("struct<word:bigint,bits:bigint>").alias("entry")
    rows = docs.select(each, "doc_id", nothing).unionByName(words.select("k", "doc_id", entry))
    placed = rows.groupBy("k", "doc_id").agg(F.map_from_entries(F.collect_list("entry")).alias("m"))
    last = F.ceil(F.col("k") / F.lit(WORD_BITS)).cast("bigint") - 1
    zero = F.lit(0).cast("bigint")
    sketch = F.transform(F.sequence(zero, last), lambda w: F.coalesce(F.try_element_at("m", w), zero))
    return placed.select("k", "doc_id", sketch.alias("sketch"))


def set_bits(words: Column) -> Column:
    """Number of set bits of a sketch of any length."""
    return _count_folded(words)


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms).cast("bigint")


def _count_folded(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w))


def cardinality(words: Column, k: int) -> Column:
    if n_words(k) > UNROLLED_WORDS:
        return _count_folded(words)
    return _total([F.bit_count(words[i]) for i in range(n_words(k))])


def and_count(a: Column, b: Column, k: int) -> Column:
    if n_words(k) > UNROLLED_WORDS:
        return _count_folded(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    return _total([F.bit_count(a[i].bitwiseAND(b[i])) for i in range(n_words(k))])


def xor_count(a: Column, b: Column, k: int, in_join: bool = False) -> Column:
    """Differing bits.  Inside a join condition the short form keeps the compiled join small."""
    if in_join or n_words(k) > UNROLLED_WORDS:
        return _count_folded(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)))
    return _total([F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(n_words(k))])


def set_positions(words: Column, k: int) -> Column:
    """Ascending positions of the set bits."""
    positions = F.sequence(F.lit(0), F.lit(k - 1))

    def is_set(p: Column) -> Column:
        word = F.get(words, F.floor(p / WORD_BITS).cast("int"))
        return F.call_function("shiftright", word, (p % WORD_BITS).cast("int")).bitwiseAND(
            F.lit(1).cast("bigint")
        ) == 1

    return F.filter(positions, is_set)


def bit_run(words: Column, start: int, end: int) -> Column:
    """The bits [start, end) as one BIGINT; the run is at most 62 bits long."""
    first, last = start // WORD_BITS, (end - 1) // WORD_BITS
    offset = start % WORD_BITS
    if first == last:
        mask = (1 << (end - start)) - 1
        return F.shiftright(words[first], offset).bitwiseAND(F.lit(mask).cast("bigint"))
    head = WORD_BITS - offset
    tail_mask = (1 << (end - start - head)) - 1
    tail = words[last].bitwiseAND(F.lit(tail_mask).cast("bigint"))
    return F.shiftright(words[first], offset).bitwiseOR(F.shiftleft(tail, head))
