"""From raw text or (row, column, value) triples to distinct binary coordinates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitfold.functions.hashing import hash32
from bitfold.operators.ranking import ordered_rank
from bitfold.session import materialize, spread

# fixed value: a token is a maximal run of two or more letters, digits or underscores
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# a short list of English function words of our own (pass another with stop_words=)
ENGLISH_STOP_WORDS = tuple(
    """
    about above after again against all am an and any are as at be because been before
    being below between both but by can cannot could did do does doing down during each
    few for from further had has have having he her here hers herself him himself his how
    if in into is it its itself just me more most my myself no nor not now of off on once
    only or other our ours ourselves out over own same she should so some such than that
    the their theirs them themselves then there these they this those through to too under
    until up very was we were what when where which while who whom why will with would you
    your yours yourself yourselves
    """.split()
)


@dataclass(frozen=True)
class BinarySets:
    """A sparse 0/1 matrix: row universe, distinct non-zero cells, column universe.

    ``docs(doc_id)`` also holds rows without any item; ``items(doc_id, feature_id)`` is
    distinct; ``vocab(feature_id, ...)`` is the column universe.  Ids are BIGINT and
    feature ids lie below 2^31.
    """

    docs: DataFrame
    items: DataFrame
    vocab: DataFrame

    def materialize(self, name: str) -> "BinarySets":
        return BinarySets(
            materialize(self.docs, f"{name}-docs"),
            materialize(self.items, f"{name}-items"),
            materialize(self.vocab, f"{name}-vocab"),
        )


def binarize(triples: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Distinct coordinates of the non-zero cells."""
    return (
        triples.where(F.col(value) != 0)
        .select(
            F.col(row).cast("bigint").alias("doc_id"),
            F.col(column).cast("bigint").alias("feature_id"),
        )
        .distinct()
    )


def value_check(triples: DataFrame, value: str) -> DataFrame:
    """One row: cell count, smallest and largest value, and cells that are not 0/1."""
    v = F.col(value).cast("double")
    return triples.agg(
        F.count(v).alias("n_cells"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.count_if(~v.isin(0.0, 1.0)).alias("n_not_binary"),
    )


def tokens(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """Distinct ``(doc_id, term)`` of the whole text, without stop words.

    Duplicates inside a document are removed in its own row, so this needs no shuffle.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(TOKEN_PATTERN), F.lit(0)))
    texts = spread(documents.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col))
    exploded = texts.select("doc_id", F.explode(words).alias("term"))
    if not stop_words:
        return exploded
    return exploded.where(~F.col("term").isin(list(stop_words)))


def document_frequency(doc_terms: DataFrame, min_df: int = 2) -> DataFrame:
    """Terms found in at least ``min_df`` documents, with that count."""
    return doc_terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)


def encode_text(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    min_df: int = 2,
) -> BinarySets:
    """Binary document-term sets with alphabetic 0-based feature ids.

    The distinct terms of each document are written once, so texts are read and cut only once.
    """
    doc_terms = materialize(tokens(documents, id_col, text_col, stop_words), "terms")
    vocab = ordered_rank(document_frequency(doc_terms, min_df), "term", "feature_id")
    vocab = vocab.select("feature_id", "term", "df")
    items = doc_terms.join(vocab.select("term", "feature_id"), "term").select("doc_id", "feature_id")
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"))
    return BinarySets(docs, items, vocab)


def encode_relation(
    pairs: DataFrame, row: str, column: str, rows: DataFrame, columns: DataFrame
) -> BinarySets:
    """Binary sets of a many-to-many relation with integer keys on both sides.

    ``rows`` and ``columns`` are one-column tables holding the two universes.
    """
    items = pairs.select(
        F.col(row).cast("bigint").alias("doc_id"), F.col(column).cast("bigint").alias("feature_id")
    ).distinct()
    docs = rows.select(F.col(rows.columns[0]).cast("bigint").alias("doc_id"))
    vocab = columns.select(F.col(columns.columns[0]).cast("bigint").alias("feature_id"))
    return BinarySets(docs, items, vocab)


def coordinate_export(items: DataFrame) -> DataFrame:
    """1-based ``(docID, wordID, count)`` in row-major order."""
    return items.select(
        (F.col("doc_id") + 1).alias("docID"),
        (F.col("feature_id") + 1).alias("wordID"),
        F.lit(1).cast("bigint").alias("count"),
    ).orderBy("docID", "wordID")


def head_sample(sets: BinarySets, n_docs: int) -> BinarySets:
    """The first ``n_docs`` rows (ids below it) with all their items."""
    keep = F.col("doc_id") < n_docs
    return BinarySets(sets.docs.where(keep), sets.items.where(keep), sets.vocab)


def row_support(items: DataFrame, doc_id: int) -> DataFrame:
    """The feature ids of one row; the filter reaches the scan."""
    return items.where(F.col("doc_id") == doc_id).select("feature_id")


MAX_CHUNK = 8_192


def chunk_count(largest_set: int) -> int:
    """Into how many arrays a set is cut so that one holds about ``MAX_CHUNK`` at most."""
    return max(1, -(-largest_set // MAX_CHUNK))


def set_arrays(items: DataFrame, value: Column | None = None) -> DataFrame:
    """``(doc_id, chunk, several, features)``: the rows as arrays of bounded length.

    ``several`` says that the row may have further chunks.  A row above ``MAX_CHUNK`` items spreads over several chunks by feature, so no single
    group is collected whole.  Row sizes come from a map-side combined count; the table of
    oversized rows is joined back, and Spark broadcasts it only when it is small.
    """
    value = F.col("feature_id") if value is None else value
    oversized = (
        items.groupBy("doc_id")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > MAX_CHUNK)
        .select("doc_id", F.ceil(F.col("n") / MAX_CHUNK).alias("n_chunks"))
    )
    chunked = items.join(oversized, "doc_id", "left").select(
        "doc_id",
        (hash32(F.col("feature_id"), 0, "chunk") % F.coalesce("n_chunks", F.lit(1))).alias("chunk"),
        F.col("n_chunks").isNotNull().alias("several"),
        value.alias("value"),
    )
    # the arrays feed k hash evaluations per item: keep one partition per configured slot,
    # however few bytes they are
    slots = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked = chunked.repartition(slots, "doc_id", "chunk")
    return chunked.groupBy("doc_id", "chunk").agg(F.bool_or("several").alias("several"), F.collect_list("value").alias("features"))


def aligned_set_arrays(items: DataFrame, n_chunks: int) -> DataFrame:
    """Like ``set_arrays`` with one chunk count for all rows.

    The same feature falls in the same chunk of every row, so overlaps add up over chunks.
    """
    return items.groupBy("doc_id", (F.col("feature_id") % n_chunks).alias("chunk")).agg(
        F.collect_list("feature_id").alias("features")
    )


def dataset_summary(sets: BinarySets) -> DataFrame:
    """One row: rows, columns, non-zeros, mean row size, sparsity in percent."""
    rows = sets.docs.agg(F.count("*").alias("n"))
    cells = sets.items.agg(F.count("*").alias("n"))
    columns = sets.vocab.agg(F.count("*").alias("n"))
    tagged = (
        rows.select(F.lit("docs").alias("what"), "n")
        .unionByName(cells.select(F.lit("nnz").alias("what"), "n"))
        .unionByName(columns.select(F.lit("words").alias("what"), "n"))
    )
    one = tagged.agg(
        *[F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("docs", "words", "nnz")]
    )
    nnz, docs, words = F.col("nnz").cast("double"), F.col("docs").cast("double"), F.col("words").cast("double")
    return one.select(
        F.col("docs").alias("n_docs"),
        F.col("words").alias("n_words"),
        F.col("nnz"),
        F.coalesce(F.try_divide(nnz, docs), F.lit(0.0)).alias("avg_words_per_doc"),
        ((1 - F.coalesce(F.try_divide(nnz, docs * words), F.lit(0.0))) * 100).alias("sparsity_pct"),
    )


def preview(sets: BinarySets, n_docs: int = 5, n_words: int = 10) -> DataFrame:
    """The top-left corner of the 0/1 matrix as rows of ``(doc_id, bits)``."""
    corner = sets.items.where((F.col("doc_id") < n_docs) & (F.col("feature_id") < n_words))
    marks = [F.max(F.when(F.col("feature_id") == j, 1).otherwise(0)) for j in range(n_words)]
    seen = corner.groupBy("doc_id").agg(F.concat(*[m.cast("string") for m in marks]).alias("bits"))
    return (
        sets.docs.where(F.col("doc_id") < n_docs)
        .join(seen, "doc_id", "left")
        .select("doc_id", F.coalesce("bits", F.lit("0" * n_words)).alias("bits"))
        .orderBy("doc_id")
        .limit(n_docs)
    )
