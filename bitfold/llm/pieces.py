"""SentencePiece encoding and decoding with a table of distinct chunks.

A text is cut where a white-space marker follows another character: no piece of a supported
model crosses that border (checked when the model is loaded), so every chunk - its markers and
the word after them - is segmented on its own.  Each distinct chunk is segmented once per
task, kept in a table, and the ids are joined back in the order of the chunks.

The table belongs to a task and is emptied when it holds ``max_chunks`` entries; chunks longer
than ``max_length`` characters are segmented without being kept.  Memory is bounded whatever
the vocabulary of the corpus, nothing is shuffled or broadcast, and a lost task starts anew.

Defined results: null counts as empty; an empty text has no ids and decodes to the empty text.
Repeated rows are encoded alike; other columns are untouched and existing columns with the names
of the results are replaced.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"


class ChunkCoder:
    """Encodes and decodes whole texts chunk by chunk."""

    def __init__(self, model_path: str, max_chunks: int = 300_000, max_length: int = 64):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.max_chunks, self.max_length = max_chunks, max_length
        self.table: dict[str, tuple[str, int, str]] = {}
        if not self.separable():
            raise ValueError("a piece of this model crosses a white-space marker, or it normalises text")

    def separable(self) -> bool:
        """No piece has a marker after another character, and texts are taken as they are."""
        inside = any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(self.model.get_piece_size()))
        probe = " a  bé ﬁ "
        return not inside and self.model.decode(self.model.encode(probe)) == probe

    def segment(self, found: list[str]) -> dict[str, tuple[str, int, str]]:
        """Per chunk: ids as text, their number, and the decoded chunk with its leading space.

        Chunks come without their first marker: the library puts one before any text.  Those
        too long to keep are only in the returned table.
        """
        ids = self.model.encode(found, num_threads=1) if found else []
        ids = [i if c else [self.model.piece_to_id(MARK)] for c, i in zip(found, ids)]
        back = self.model.decode(ids, num_threads=1) if ids else []
        rows = {c: (",".join(map(str, i)), len(i), " " + b) for c, i, b in zip(found, ids, back)}
        if len(self.table) + len(rows) > self.max_chunks:
            self.table.clear()
        short = [c for c in rows if len(c) <= self.max_length][: self.max_chunks]
        self.table.update((c, rows[c]) for c in short)
        return rows

    def code(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """For each text: ids joined by commas, their number, and the text decoded from them."""
        cut = [chunks(t) if t else [] for t in texts]
        held = self.table
        distinct = set(itertools.chain.from_iterable(cut))
        table = {c: held[c] for c in distinct if c in held}
        table.update(self.segment([c for c in distinct if c not in held]))
        out = []
        for words in cut:
            if not words:
                out.append(("", 0, ""))
                continue
            ids, counts, back = zip(*map(table.__getitem__, words))
            out.append((",".join(ids), sum(counts), "".join(back)[1:]))
        return out


def grouped(texts: pa.Array, size: int = 1_000_000) -> Iterator[list[str]]:
    """Texts of a batch, null as empty, in runs of about ``size`` characters."""
    run, held = [], 0
    for t in texts:
        run.append(t.as_py() or "")
        held += len(run[-1])
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def chunks(text: str) -> list[str]:
    """The text cut at markers; a run of markers stays before the word it leads to.

    Every chunk lacks its first marker (the first chunk's is the library's own).
    """
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    out, lead = [], ""
    last = len(words) - 1
    for i, word in enumerate(words):
        if word or i == last:
            out.append(lead + word)
            lead = ""
        else:
            lead += " "
    return out


def coder(model_path: str, what: str = "ids array<int>, decoded string", **limits):
    """A scalar function over texts giving the struct ``what``: ids and decoded text, or digests."""
    digests = what.startswith("n_tokens")

    @F.arrow_udf(f"struct<{what.replace(' ', ': ').replace(',:', ',')}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = ChunkCoder(model_path, **limits)
        for texts in batches:
            got = (row for run in grouped(texts) for row in one.code(run))
            if digests:
                rows = [
                    (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
                    for ids, n, back in got
                ]
                kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
            else:
                rows = [([int(i) for i in ids.split(",")] if n else [], back) for ids, n, back in got]
                kinds = {"ids": pa.list_(pa.int32()), "decoded": pa.string()}
            columns = list(zip(*rows)) or [[] for _ in kinds]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds.values())]
            yield pa.StructArray.from_arrays(arrays, names=list(kinds))

    return run


def encode(documents: DataFrame, model_path: str, text: str = "text", **limits) -> DataFrame:
    """``documents`` with ``ids`` and ``decoded``."""
    kept = documents.drop("ids", "decoded")
    return kept.withColumn("_c", coder(model_path, **limits)(F.col(text))).select(
        *[F.col(f"`{c}`") for c in kept.columns], "_c.ids", "_c.decoded"
    )


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_digests(documents: DataFrame, model_path: str, text: str = "text", **limits) -> DataFrame:
    """``documents`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; ids stay in the task."""
    kept = documents.drop("n_tokens", "ids_sha256", "decoded_sha256")
    return kept.withColumn("_c", coder(model_path, DIGESTS, **limits)(F.col(text))).select(
        *[F.col(f"`{c}`") for c in kept.columns], "_c.*"
    )


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_digests(documents.select("doc_id", "text"), default_model()).drop("text")
