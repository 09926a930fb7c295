"""Fixed-length sketches of binary rows: BinSketch, BCS, MinHash, SimHash.

``mapping(sets, k)`` returns ``(doc_id, sketch ARRAY<BIGINT>, card BIGINT)`` with one row
for every row of ``sets.docs``.  Rows without items enter the last aggregation as a NULL,
so no join is needed to keep them.

The bit sketches are pure aggregations with map-side combining: a huge row is folded where
its items lie and only partial sketches are shuffled.  The lane sketches (MinHash, SimHash)
evaluate k hashes for every item; those run as NumPy loops over bounded feature arrays
(an Arrow batch at a time), and Spark merges the partial results of a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitfold.functions.bits import WORD_BITS, cardinality, n_words, packed, packed_lengths, packed_long, set_bits
from bitfold.functions.estimators import get_estimator
from bitfold.functions.hashing import PRIME31, hash32
from bitfold.functions.lanes import draw_coefficients, gaussian_sums_udf, lane_minima_udf, pack_signs_udf
from bitfold.operators.encode import BinarySets, set_arrays
from bitfold.operators.ranking import hash_rank
from bitfold.session import materialize, scratch_path

DIRECT_WORDS = 16  # up to this many words one aggregation builds the whole sketch


def _with_empty_rows(docs: DataFrame, tall: DataFrame, column: str, sql_type: str) -> DataFrame:
    nothing = F.lit(None).cast(sql_type).alias(column)
    return docs.select("doc_id", nothing).unionByName(tall.select("doc_id", column))


class SketchModel:
    """Common interface of the four algorithms."""

    name = ""

    def __init__(self, seed: int = 42):
        self.seed = seed

    def mapping(self, sets: BinarySets, k: int) -> DataFrame:
        raise NotImplementedError

    def mappings(self, sets: BinarySets, lengths) -> DataFrame:
        """``(k, doc_id, sketch, card)``: the sketches ``mapping`` gives for each of several lengths, in one pass over the items."""
        raise NotImplementedError

    def estimate(self, similarity: str, k: int, left: str = "a", right: str = "b") -> Column:
        """Estimate over a pair table holding ``{left,right}_sketch`` and ``_card``."""
        estimator = get_estimator(self.name, similarity)
        return estimator(
            F.col(f"{left}_sketch"), F.col(f"{left}_card"),
            F.col(f"{right}_sketch"), F.col(f"{right}_card"), k,
        )


def _bit_sketches(docs: DataFrame, keyed: DataFrame, lengths, combine) -> DataFrame:
    sketch = packed_lengths(docs, keyed, lengths, combine)
    return sketch.select("k", "doc_id", "sketch", set_bits(F.col("sketch")).alias("card"))


def _by_length(longest: DataFrame, lengths, cut) -> DataFrame:
    """``(k, doc_id, sketch)`` from ``longest(doc_id, sketch)``; ``cut(sketch, k)`` makes it shorter."""
    each = F.explode(F.array(*[
        F.struct(F.lit(k).cast("bigint").alias("k"), cut(F.col("sketch"), k).alias("sketch")) for k in sorted(set(lengths))
    ]))
    return longest.select("doc_id", each.alias("cut")).select("cut.k", "doc_id", "cut.sketch")


def _first_bits(words: Column, k: int) -> Column:
    last = n_words(k) - 1
    mask = (1 << k - WORD_BITS * last) - 1
    return F.concat(F.slice(words, 1, last), F.array(words[last].bitwiseAND(F.lit(mask).cast("bigint"))))


def _bit_sketch(docs: DataFrame, bucketed: DataFrame, k: int, combine) -> DataFrame:
    if n_words(k) <= DIRECT_WORDS:
        rows = _with_empty_rows(docs, bucketed, "bucket", "bigint")
        sketch = rows.groupBy("doc_id").agg(packed(F.col("bucket"), k, combine).alias("sketch"))
    else:
        sketch = packed_long(docs, bucketed, k, combine)
    return sketch.select("doc_id", "sketch", cardinality(F.col("sketch"), k).alias("card"))


class BinSketch(SketchModel):
    """A bucket is set when any of its features is present.

    Features are dealt to the k buckets in seeded-hash order, so bucket sizes differ by at
    most one.  ``bucket_map(feature_id, bucket)`` overrides the map.
    """

    name = "BinSketch"

    def __init__(self, seed: int = 42, bucket_map: DataFrame | None = None):
        super().__init__(seed)
        self.external_map = bucket_map

    def bucket_map(self, vocab: DataFrame, k: int) -> DataFrame:
        if self.external_map is not None:
            return self.external_map.select("feature_id", F.col("bucket").cast("bigint").alias("bucket"))
        return self.ranks(vocab).select("feature_id", (F.col("rank") % k).alias("bucket"))

    def ranks(self, vocab: DataFrame) -> DataFrame:
        """Features in seeded-hash order; the rank modulo k is the bucket of every length."""
        return hash_rank(vocab.select("feature_id"), "feature_id", self.seed, "binsketch").select("feature_id", "rank")

    def _with_number(self, items: DataFrame, numbers: DataFrame, name: str) -> DataFrame:
        found = items.join(numbers, "feature_id", "left")
        missing = F.raise_error(F.concat(F.lit("no bucket for feature "), F.col("feature_id").cast("string"))).cast("bigint")
        return found.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(missing))

    def mapping(self, sets: BinarySets, k: int) -> DataFrame:
        """Raises while it runs when an item's feature has no bucket."""
        return _bit_sketch(sets.docs, self._with_number(sets.items, self.bucket_map(sets.vocab, k), "bucket"), k, F.bit_or)

    def mappings(self, sets: BinarySets, lengths) -> DataFrame:
        if self.external_map is not None:
            raise ValueError("a given bucket map is for one length")
        keyed = self._with_number(sets.items, self.ranks(sets.vocab).withColumnRenamed("rank", "key"), "key")
        return _bit_sketches(sets.docs, keyed, lengths, F.bit_or)


class BinaryCompressionSchema(SketchModel):
    """A bucket holds the parity of its present features; buckets are independent draws."""

    name = "BCS"

    def bucket(self, feature: Column, k: int) -> Column:
        return hash32(feature, self.seed, "bcs") % k

    def bucket_map(self, vocab: DataFrame, k: int) -> DataFrame:
        return vocab.select("feature_id", self.bucket(F.col("feature_id"), k).alias("bucket"))

    def mapping(self, sets: BinarySets, k: int) -> DataFrame:
        bucketed = sets.items.select("doc_id", self.bucket(F.col("feature_id"), k).alias("bucket"))
        return _bit_sketch(sets.docs, bucketed, k, F.bit_xor)

    def mappings(self, sets: BinarySets, lengths) -> DataFrame:
        keyed = sets.items.select("doc_id", hash32(F.col("feature_id"), self.seed, "bcs").alias("key"))
        return _bit_sketches(sets.docs, keyed, lengths, F.bit_xor)


def _merge_parts(docs: DataFrame, parts: DataFrame, k: int, merge) -> DataFrame:
    """Combine the partial lane arrays of each row; rows without items get k zeros.

    ``parts(doc_id, several, part)``.  Rows in several parts are merged lane by lane with map-side
    combining, so no task gathers all parts of a huge row; the others have one part and keep it.
    """
    lanes = parts.where("several").select("doc_id", F.posexplode("part").alias("lane", "value"))
    merged = lanes.groupBy("doc_id", "lane").agg(merge("value").alias("value"))
    in_order = F.array_sort(F.collect_list(F.struct("lane", "value")))
    whole = merged.groupBy("doc_id").agg(F.transform(in_order, lambda x: x["value"]).alias("part"))
    each = parts.where(~F.col("several")).select("doc_id", "part").unionByName(whole)
    rows = _with_empty_rows(docs, each, "part", "array<bigint>")
    zeros = F.array_repeat(F.lit(0).cast("bigint"), k)
    # one array or none besides the row of docs
    return rows.groupBy("doc_id").agg(F.coalesce(F.max("part"), zeros).alias("lanes"))


class MinHash(SketchModel):
    """k independent minima of (a x + b) mod (2^31 - 1) over the feature ids of a row."""

    name = "MinHash"

    def coefficients(self, k: int) -> list[list[int]]:
        return draw_coefficients(self.seed, k, 2)

    def lanes(self, sets: BinarySets, k: int) -> DataFrame:
        minima = lane_minima_udf(self.coefficients(k))
        parts = set_arrays(sets.items).select("doc_id", "several", minima("features").alias("part"))
        return _merge_parts(sets.docs, parts, k, F.min)

    def mapping(self, sets: BinarySets, k: int) -> DataFrame:
        return self.lanes(sets, k).select(
            "doc_id", F.col("lanes").alias("sketch"), F.lit(None).cast("bigint").alias("card")
        )

    def mappings(self, sets: BinarySets, lengths) -> DataFrame:
        """Coefficients are drawn lane by lane, so a shorter signature is the beginning of a longer one."""
        longest = self.lanes(sets, max(lengths)).withColumnRenamed("lanes", "sketch")
        cut = _by_length(longest, lengths, lambda lanes, k: F.slice(lanes, 1, k))
        return cut.withColumn("card", F.lit(None).cast("bigint"))


class SimHash(SketchModel):
    """Signs of k random Gaussian projections.

    The Gaussian of (feature, lane) is a Box-Muller draw from two modular hashes of the
    feature's 31-bit hash; two neighbouring lanes use the cosine and the sine of one draw.
    Draws are rounded to integers, so a sum does not depend on the order of its terms.
    """

    name = "SimHash"

    def coefficients(self, k: int) -> list[list[int]]:
        """Per pair of lanes: (a, b) of the radius hash, then (a, b) of the angle hash."""
        return draw_coefficients(self.seed, -(-k // 2), 4)

    def feature_hash(self, feature: Column) -> Column:
        return hash32(feature, self.seed, "simhash") % PRIME31

    def lanes(self, sets: BinarySets, k: int) -> DataFrame:
        sums = gaussian_sums_udf(self.coefficients(k), k)
        hashed = set_arrays(sets.items, self.feature_hash(F.col("feature_id")))
        parts = hashed.select("doc_id", "several", sums("features").alias("part"))
        return _merge_parts(sets.docs, parts, k, F.sum)

    def mapping(self, sets: BinarySets, k: int) -> DataFrame:
        signed = self.lanes(sets, k).select("doc_id", pack_signs_udf("lanes").alias("sketch"))
        return signed.select("doc_id", "sketch", cardinality(F.col("sketch"), k).alias("card"))

    def mappings(self, sets: BinarySets, lengths) -> DataFrame:
        """Projections are drawn lane by lane, so a shorter sketch is the first bits of a longer one."""
        longest = self.lanes(sets, max(lengths)).select("doc_id", pack_signs_udf("lanes").alias("sketch"))
        return _by_length(longest, lengths, _first_bits).withColumn("card", set_bits(F.col("sketch")))


def sketches_by_length(model: SketchModel, sets: BinarySets, lengths) -> dict[int, DataFrame]:
    """The written sketches of each length; several lengths are made in one pass and written once, one folder each."""
    lengths = sorted(set(lengths))
    if len(lengths) == 1:
        return {lengths[0]: materialize(model.mapping(sets, lengths[0]), "sketches")}
    path = scratch_path(sets.docs.sparkSession, "sketches")
    every = model.mappings(sets, lengths)
    every.write.partitionBy("k").parquet(path)
    schema = every.drop("k").schema
    return {k: sets.docs.sparkSession.read.schema(schema).parquet(f"{path}/k={k}") for k in lengths}


MODELS: dict[str, type[SketchModel]] = {
    m.name: m for m in (BinSketch, BinaryCompressionSchema, MinHash, SimHash)
}


def get_model(algorithm: str, seed: int = 42) -> SketchModel:
    if algorithm not in MODELS:
        raise ValueError(f"unknown algorithm {algorithm!r}; one of {', '.join(MODELS)}")
    return MODELS[algorithm](seed=seed)
