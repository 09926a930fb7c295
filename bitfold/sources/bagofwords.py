"""Bag-of-words files and folders of text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitfold.operators.encode import ENGLISH_STOP_WORDS, BinarySets, coordinate_export, encode_text
from bitfold.operators.ranking import ordered_rank

# fixed values: a gzip file starts with these bytes
GZIP_MAGIC = (0x1F, 0x8B)
MOST_BYTES = 2**31 - 1  # of one binary value


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(feature_id, term)`` of a UTF-8 file with one term per line; id = line number.

    The lines of several files count on in the order of the paths.  Line numbers come from the splits of the file: the rows before a split are counted, and
    rows are numbered inside their split.
    """
    lines = spark.read.text(path).select(
        F.regexp_replace("value", r"^\s+|\s+$", "").alias("term"),
        F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file split
    starts = (
        lines.groupBy("block")
        .agg(F.count("*").alias("n"), F.min("at").alias("first"))
        .select("block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    return lines.join(starts, "block").select(
        (F.col("start") + F.col("at") - F.col("first")).cast("bigint").alias("feature_id"), "term"
    )


def _is_gzip(spark: SparkSession, path: str) -> bool:
    """Look at the first two bytes only."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(jvm_path)
    try:
        return (stream.read(), stream.read()) == GZIP_MAGIC
    finally:
        stream.close()


def _check_one_value(spark: SparkSession, path: str) -> None:
    """A file that has to be read as one value must fit into one."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(jvm_path).getLen()
    if size >= MOST_BYTES:
        raise ValueError(f"{path} is plain text named .gz and has {size} bytes; rename it, or cut it below {MOST_BYTES}")


def read_docword_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, at, parts)``: the whitespace-separated fields of every line.

    Spark picks the decompressor by file name.  A plain text that is named ``.gz`` is read as
    one binary value (up to 2 GB, like any unsplittable file in one task) and cut into lines.
    """
    if path.endswith(".gz") and not _is_gzip(spark, path):
        _check_one_value(spark, path)
        text = F.decode("content", "ISO-8859-1")
        lines = spark.read.format("binaryFile").load(path).select(
            F.col("path").alias("file"), F.posexplode(F.split(text, "\n")).alias("at", "value")
        )
    else:
        lines = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value"
        )
    return lines.select("file", F.col("at").cast("bigint").alias("at"), F.split(F.trim("value"), r"\s+").alias("parts"))


def read_header(lines: DataFrame) -> DataFrame:
    """One row ``(n_docs, n_words, nnz)`` from the three single-number lines; fails without them."""
    single = lines.where((F.size("parts") == 1) & F.col("parts")[0].rlike("^[0-9]+$"))
    head = single.orderBy("file", "at").limit(3)
    ordered = F.sort_array(F.collect_list(F.struct("file", "at", F.col("parts")[0].cast("bigint").alias("v"))))
    values = head.agg(ordered.alias("h")).select(F.col("h.v").alias("v"))
    missing = F.raise_error(F.lit("docword file without its three header lines")).cast("array<bigint>")
    values = values.select(F.when(F.size("v") == 3, F.col("v")).otherwise(missing).alias("v"))
    return values.select(
        F.get("v", F.lit(0)).alias("n_docs"), F.get("v", F.lit(1)).alias("n_words"), F.get("v", F.lit(2)).alias("nnz")
    )


def parse_triples(lines: DataFrame) -> DataFrame:
    """``(doc_id, word_id, count)`` of the lines with exactly three integers; ids 1-based."""
    names = ("doc_id", "word_id", "count")
    three = lines.where(F.size("parts") == 3)
    numbers = three.select(*[F.col("parts")[i].try_cast("bigint").alias(n) for i, n in enumerate(names)])
    return numbers.dropna()


def populate(triples: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Distinct 0-based ``items`` of the first ``n_docs`` documents (one row, one column).

    Counts are dropped: a listed cell is 1 whatever its count.
    """
    return (
        triples.where(F.col("doc_id") <= n_docs.scalar())
        .select((F.col("doc_id") - 1).alias("doc_id"), (F.col("word_id") - 1).alias("feature_id"))
        .distinct()
    )


def _ids(one_row: DataFrame, column: str, name: str) -> DataFrame:
    """0..n-1 for a one-row table holding n.  The count travels to the range as one number."""
    n = one_row.select(column).first()[0] or 0
    return one_row.sparkSession.range(n).select(F.col("id").alias(name))


def load_bag_of_words(
    spark: SparkSession, docword_path: str, vocab_path: str | None = None, sample_size: int | None = None
) -> BinarySets:
    """A bag-of-words data set as binary sets; ``sample_size`` keeps the first N documents."""
    lines = read_docword_lines(spark, docword_path)
    header = read_header(lines)
    if sample_size is not None:
        header = header.withColumn("n_docs", F.least("n_docs", F.lit(sample_size).cast("bigint")))
    items = populate(parse_triples(lines), header.select("n_docs"))
    if vocab_path is None:
        vocab = _ids(header, "n_words", "feature_id")
    else:
        vocab = read_vocabulary(spark, vocab_path)
    return BinarySets(_ids(header, "n_docs", "doc_id"), items, vocab)


def write_bag_of_words(sets: BinarySets, path: str) -> None:
    """Write the docword form: header lines first, then 1-based triples in row order."""
    spark = sets.docs.sparkSession
    sizes = [df.agg(F.count("*").alias("n")).scalar() for df in (sets.docs, sets.vocab, sets.items)]
    header = spark.range(0, 3, 1, 1).select(
        F.when(F.col("id") == 0, sizes[0]).when(F.col("id") == 1, sizes[1]).otherwise(sizes[2])
        .cast("string").alias("value")
    )
    triples = coordinate_export(sets.items).select(F.concat_ws(" ", "docID", "wordID", "count").alias("value"))
    header.unionByName(triples).write.text(path)


def read_text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, path, text)`` of every ``*.txt`` below ``folder``; latin-1, ids by path.

    Unreadable files are skipped.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.txt")
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .load(folder)
    )
    texts = files.select("path", F.decode("content", "ISO-8859-1").alias("text"))
    # only paths are sorted and numbered; the contents move once, to meet their numbers
    ranks = ordered_rank(files.select("path"), "path", "doc_id")
    return texts.join(ranks, "path").select("doc_id", "path", "text")


def encode_text_folder(
    spark: SparkSession, folder: str, stop_words: Sequence[str] = ENGLISH_STOP_WORDS, min_df: int = 2
) -> BinarySets:
    return encode_text(read_text_folder(spark, folder), "doc_id", "text", stop_words, min_df)
