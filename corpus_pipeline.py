"""A training-text pipeline: each stage's result is written as Parquet and read by the next.

Defined results: documents without text have no letter and go with the first stage; of rows that agree in doc_id
and text one stays; rows without doc_id pass the near-duplicate stage.  Columns beyond those of documents stay, those
named like a result are replaced.  An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitfold.llm import exact, language, mixing, nearcopies, pieces
from bitfold.session import materialize

LEAST_SCORE = 0.35  # a text none of the learned languages claims with more than this is rejected


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter, or that no learned language claims, go."""
    net = language.fit(docs)
    judged = language.identify(docs, net)
    kept = judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: one document of each group of equal texts stays."""
    return exact.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the smallest doc_id of each linked group stays."""
    return nearcopies.keep_smallest(docs)


def in_target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents alone, in the order that follows the sources' target weights."""
    return mixing.mixed(docs)


def placed_in_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document takes its place in that order and carries it along."""
    return mixing.mixed(docs, places=True)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: ids of every text, next to its document's columns and its place in the mix.

    The places are those the stage before wrote, in whatever order its files are read.
    """
    coded = pieces.encode_digests(docs, pieces.default_model()).drop("text")
    places = ("source_rank", "slot")
    return coded.select(*[F.col(f"`{c}`") for c in coded.columns if c not in places], *places)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("source_mixing", placed_in_mix),
    ("sentencepiece", token_ids),
]

#: Language ID and near duplicates have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
