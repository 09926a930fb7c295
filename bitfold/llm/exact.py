"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes.  Distinct blocks are sorted and
numbered, so equal blocks share one integer name; then names of adjacent pairs are sorted and
numbered in turn, halving every document's sequence, until one name is left.  Names come from
comparing the content itself: two documents end with the same name of the same level exactly
when their normalised texts are equal.  No hash stands for a text.

Distinct blocks and pairs are found by map-side combined aggregation, and names and groups return to
their rows through sort-merge joins with written tables, whose hot keys are split; so a text with very
many copies loads no single task.

Defined results: null counts as the empty text, which is one empty block.  Rows that agree in
doc_id and text go through the naming once, count as often as they occur and are as many rows of the result;
rows with one doc_id and different texts are different documents.  Other columns, whatever their names, are
ignored by ``group_copies`` and kept by ``keep_first``, which keeps one row of each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitfold.session import materialize

BLOCK_BYTES = 2_048
WHITE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null becomes the empty text."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """``distinct`` with ``name``: the partition's number and the rank of the sorted key in it.

    ``distinct`` comes out of an aggregation by ``keys``, so its partitions are fixed by the keys
    and a partition that is computed again, after a lost executor, gives the same names.
    """
    return distinct.select(*keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def blocks_of(texts: DataFrame, block_bytes: int) -> DataFrame:
    """``(doc_id, mark, pos, block)``; an empty text is one empty block."""
    data = texts.select("doc_id", "mark", F.col("norm").cast("binary").alias("data"))
    last = F.floor(F.greatest(F.octet_length("data") - 1, F.lit(0)) / F.lit(block_bytes)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(F.col("data"), i * F.lit(block_bytes) + 1, F.lit(block_bytes))
    )
    return data.select("doc_id", "mark", F.posexplode(cut).alias("pos", "block"))


def name_blocks(texts: DataFrame, block_bytes: int) -> DataFrame:
    """``(doc_id, mark, pos, name)`` for the blocks of ``texts(doc_id, mark, norm)``.

    Contents travel once, to be made distinct.  Positions look their name up by a 64-bit address
    of the block; the addresses that two different blocks share are known from the distinct
    blocks, and positions at those compare the contents too, so no collision can pass.
    """
    blocks = blocks_of(texts, block_bytes).withColumn("address", F.xxhash64("block"))
    contents = named(blocks.select("block").distinct(), ["block"]).withColumn("address", F.xxhash64("block"))
    names = materialize(contents.select("address", "name"), "block-names")
    shared = names.groupBy("address").count().where(F.col("count") > 1).select("address")
    if shared.isEmpty():
        return blocks.drop("block").join(names.hint("merge"), "address").select("doc_id", "mark", "pos", "name")
    both = materialize(contents, "block-contents")
    plain = blocks.drop("block").join(both.join(shared, "address", "left_anti").drop("block").hint("merge"), "address")
    compared = blocks.join(both.join(shared, "address", "left_semi").hint("merge"), ["address", "block"])
    cells = ["doc_id", "mark", "pos", "name"]
    return plain.select(*cells).unionByName(compared.select(*cells))


def name_pairs(sequence: DataFrame) -> DataFrame:
    """Half as many names: each adjacent pair of a document's names becomes one name."""
    side = F.col("pos") % 2
    pairs = sequence.groupBy("doc_id", "mark", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
        F.max(F.when(side == 0, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("right"),
    )
    names = materialize(named(pairs.select("left", "right").distinct(), ["left", "right"]), "pair-names")
    return pairs.join(names.hint("merge"), ["left", "right"]).select("doc_id", "mark", "pos", "name")


def name_texts(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, mark, level, name)``: equal ``(level, name)`` means equal ``norm``.

    ``texts(doc_id, mark, norm)``; (doc_id, mark) tells documents apart.  A document leaves as
    soon as one name is left; equal texts have equally many blocks and leave at the same level.
    The number of rounds is the logarithm of the longest document's blocks.
    """
    sequence = materialize(name_blocks(texts, block_bytes), "names")
    finished, level = [], 0
    while True:
        # longer documents still hold a second name; the first one alone cannot tell
        going = sequence.where(F.col("pos") > 0).select("doc_id", "mark").distinct()
        done = sequence.join(going, ["doc_id", "mark"], "left_anti")
        finished.append(done.select("doc_id", "mark", F.lit(level).alias("level"), "name"))
        if going.isEmpty():
            break
        sequence = materialize(name_pairs(sequence.join(going, ["doc_id", "mark"], "left_semi")), "names")
        level += 1
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out.distinct()


def mark_of(text: Column) -> Column:
    """A digest that tells rows with one doc_id, or without any, apart; it stands for no text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.col("doc_id").isNull())


def judged_identities(documents: DataFrame, text: str, block_bytes: int) -> DataFrame:
    """``(doc_id, mark, keep_id, group_size, kept, text_sha256, n_rows)``: rows that agree in doc_id and text once."""
    read = documents.select(
        F.col("doc_id").alias("own_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), mark_of(F.col(f"`{text}`")).alias("mark"),
        F.char_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("n"), normalised(F.col(f"`{text}`")).alias("norm"),
    )
    facts = read.select("doc_id", "mark", "own_id", "n", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    facts = facts.groupBy(*facts.columns).agg(F.count("*").alias("n_rows"))
    names = name_texts(read.select("doc_id", "mark", "norm"), block_bytes)
    rows = materialize(facts.join(names, ["doc_id", "mark"]).drop("doc_id"), "identities")
    first = F.min(F.struct((-F.col("n")).alias("n"), "own_id", "mark"))
    # written first: next to a written table the rows of a large group can be split over tasks
    groups = materialize(rows.groupBy("level", "name").agg(first.alias("first"), F.sum("n_rows").alias("group_size")), "groups")
    stays = F.col("first.own_id").eqNullSafe(F.col("own_id")) & (F.col("first.mark") == F.col("mark"))
    return rows.join(groups.hint("merge"), ["level", "name"]).select(
        F.col("own_id").alias("doc_id"), "mark", F.col("first.own_id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256", "n_rows"
    )


def group_copies(documents: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, mark, keep_id, group_size, kept, text_sha256)`` for every row of ``documents``.

    Of equal normalised texts the longest original stays, then the smallest doc_id (null first); ``kept`` is
    the same for rows that agree in doc_id and text.
    """
    judged = judged_identities(documents, text, block_bytes)
    nth = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows")))
    return judged.withColumn("n_rows", nth).drop("n_rows")


def keep_first(documents: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row of ``documents`` for each group of equal texts; of rows that agree in doc_id and text the smallest by all columns."""
    judged = materialize(judged_identities(documents, text, block_bytes).select("doc_id", "mark", "kept", "n_rows"), "judged")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "doc_id", mark_of(F.col(f"`{text}`")).alias("mark"))

    def having(keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("id"), F.col("mark").alias("of"))
        return rows.join(keys, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")), how)

    several = judged.where(F.col("kept") & (F.col("n_rows") > 1))
    if several.isEmpty():
        return having(judged.where(~F.col("kept")), "left_anti").select("row.*")
    single = having(judged.where(~F.col("kept") | (F.col("n_rows") > 1)), "left_anti").select("row")
    one = having(several, "left_semi").groupBy("doc_id", "mark").agg(F.min("row").alias("row"))
    return single.unionByName(one.select("row")).select("row.*")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return group_copies(documents).drop("mark")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
