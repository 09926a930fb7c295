"""Language identification by a byte convolutional network.

Text is cut into fixed-length windows of UTF-8 bytes.  Filters of several widths slide over
a window, each keeps its largest response (max pooling), and a softmax layer turns the pooled
responses into language probabilities.  A text's probabilities are the mean over all of its
windows, so whole texts are judged, however long.

The network is trained with NumPy on the driver, on a bounded sample of labelled windows; it
is a few hundred kilobytes and travels to the tasks inside the function.  Texts never shuffle.

Defined results: a null text or one without a letter gets ``und`` with score 0; so does every
text when no labelled row exists.  Rows are judged one by one, so repeated rows and other
columns are left as they are; existing columns named ``lang_pred`` or ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"


@dataclass(frozen=True)
class ByteConvNet:
    """Filters per width as ``(256, width, filters)``, then one dense layer."""

    labels: tuple[str, ...]
    window: int
    filters: tuple[np.ndarray, ...]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return response_tables(self.filters, self.bias)


def response_tables(filters: tuple[np.ndarray, ...], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the first and the second pair of bytes of a position add to every filter.

    A filter response is a sum over single bytes, so responses of all filters up to width 4
    are one table row for bytes 0-1 plus one for bytes 2-3.
    """
    n = sum(f.shape[2] for f in filters)
    head = np.zeros((256, 256, n), np.float32)
    tail = np.zeros((256, 256, n), np.float32)
    at = 0
    for f in filters:
        part = slice(at, at + f.shape[2])
        for j in range(f.shape[1]):
            table = head if j < 2 else tail
            byte = f[:, j, :]
            table[:, :, part] += byte[:, None, :] if j % 2 == 0 else byte[None, :, :]
        at += f.shape[2]
    head += bias
    return head.reshape(65536, n), tail.reshape(65536, n)


def responses(windows: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Filter responses ``(positions, windows, filters)`` of uint8 ``windows``."""
    by_position = np.ascontiguousarray(windows.T)
    pairs = (by_position[:-1].astype(np.intp) << 8) | by_position[1:]
    out = head.take(pairs[:-2], axis=0)
    out += tail.take(pairs[2:], axis=0)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(
    windows: np.ndarray, target: np.ndarray, labels: tuple[str, ...], widths=(2, 3, 4), n_filters: int = 8,
    steps: int = 250, batch: int = 256, rate: float = 0.02, seed: int = 7,
) -> ByteConvNet:
    """Adam on cross-entropy.  The gradient of max pooling reaches only the winning position."""
    rng = np.random.default_rng(seed)
    n = n_filters * len(widths)
    filters = [rng.normal(0, 0.3, (256, w, n_filters)).astype(np.float32) for w in widths]
    bias = np.zeros(n, np.float32)
    dense = rng.normal(0, 0.3, (n, len(labels))).astype(np.float32)
    dense_bias = np.zeros(len(labels), np.float32)
    params = [*filters, bias, dense, dense_bias]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = np.bincount(target, minlength=len(labels)).astype(np.float64)
    weight = (share.sum() / np.maximum(share, 1) / len(labels))[target].astype(np.float32)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), min(batch, 4 * len(windows)))
        x, y = windows[pick], target[pick]
        head, tail = response_tables(tuple(filters), bias)
        conv = responses(x, head, tail)
        where = conv.argmax(axis=0)
        pooled = np.take_along_axis(conv, where[None], axis=0)[0]
        hidden = np.maximum(pooled, 0)
        p = softmax(hidden @ dense + dense_bias)
        p[np.arange(len(y)), y] -= 1
        p *= (weight[pick] / len(y))[:, None]
        back = (p @ dense.T) * (pooled > 0)
        grads = []
        for k, f in enumerate(filters):
            part = slice(k * n_filters, (k + 1) * n_filters)
            g, spot = back[:, part], where[:, part]
            grad = np.zeros_like(f)
            for j in range(f.shape[1]):
                byte = np.take_along_axis(x, spot + j, axis=1)
                np.add.at(grad[:, j, :], (byte, np.arange(n_filters)[None, :]), g)
            grads.append(grad)
        grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
        pace = rate * (1 - step / (steps + 1))
        for q, g, m, s in zip(params, grads, mean, square):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            q -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return ByteConvNet(labels, windows.shape[1], tuple(filters), bias, dense, dense_bias)


def labelled_windows(labelled: DataFrame, window: int, max_rows: int, per_row: int, seed: int) -> DataFrame:
    """``(lang, piece)``: hash-placed windows of a hash-chosen sample of labelled rows.

    At most ``max_rows`` rows are taken, the same number for each language, and at most
    ``per_row`` windows of each.  Ids are chosen without touching the texts.
    """
    known = labelled.where(F.col("lang").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id", F.lit(seed)).alias("_h"))
    counts = known.groupBy("lang").agg(F.count("*").alias("_rows"))
    n_langs = counts.count()
    if n_langs > max_rows:
        raise ValueError(f"{n_langs} languages are more than max_rows = {max_rows}")
    each = max_rows // max(1, n_langs)
    # the lowest hashes hold the sample: of any table, about twice as many rows as wanted are sorted
    share = F.lit(2.0 * each + 64) / F.col("_rows")
    low = known.join(F.broadcast(counts), "lang").where(F.col("_h") / F.lit(2.0**64) + 0.5 < share)
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    # counts and ids: at most max_rows of each
    chosen = low.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).select("doc_id", "lang")
    data = labelled.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", F.col("text").cast("binary").alias("data"))
    found = data.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    room = F.greatest(F.octet_length("data") - F.lit(window), F.lit(0)) + 1
    places = F.array(*[(F.pmod(F.xxhash64("doc_id", F.lit(seed + 1 + i)), room) + 1).cast("int") for i in range(per_row)])
    spots = found.withColumn("spot", F.explode(F.array_distinct(places)))
    return spots.select("lang", F.substring(F.col("data"), F.col("spot"), F.lit(window)).alias("piece"))


def fit(labelled: DataFrame, window: int = 128, max_rows: int = 2_400, per_row: int = 4, seed: int = 7) -> ByteConvNet | None:
    """Train on ``labelled(doc_id, text, lang)``; None when it holds no usable row.

    ``max_rows`` bounds the labelled rows and with ``per_row`` and ``window`` the bytes that
    reach the driver (1.2 MB by default, whatever the table's size).
    """
    rows = labelled_windows(labelled, window, max_rows, per_row, seed).collect()
    if not rows:
        return None
    rows = sorted((r["lang"], bytes(r["piece"])) for r in rows)
    labels = tuple(sorted({lang for lang, _ in rows}))
    number = {lang: i for i, lang in enumerate(labels)}
    joined = b"".join(piece.ljust(window, b"\0") for _, piece in rows)
    windows = np.frombuffer(joined, np.uint8).reshape(len(rows), window)
    return train(windows, np.array([number[lang] for lang, _ in rows]), labels, seed=seed)


def window_matrix(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all texts as zero-padded windows, and the first window of each text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    count = np.maximum(1, -(-np.diff(ends) // window))
    first = np.concatenate(([0], np.cumsum(count)))
    flat = np.zeros(first[-1] * window, np.uint8)
    for start, end, at in zip(ends[:-1].tolist(), ends[1:].tolist(), (first[:-1] * window).tolist()):
        flat[at : at + end - start] = raw[start:end]
    return flat.reshape(-1, window), first


def predictor(net: ByteConvNet, group: int = 64):
    """A scalar function over batches of texts; ``group`` windows are convolved at a time."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        head, tail = net.tables()
        for texts in batches:
            windows, first = window_matrix(texts, net.window)
            pooled = np.empty((len(windows), head.shape[1]), np.float32)
            for at in range(0, len(windows), group):
                part = windows[at : at + group]
                conv = responses(part, head, tail)
                pooled[at : at + group] = conv.reshape(len(conv), -1).max(axis=0).reshape(len(part), -1)
            p = softmax(np.maximum(pooled, 0) @ net.dense + net.dense_bias).astype(np.float64)
            mean = (np.add.reduceat(p, first[:-1], axis=0) / np.diff(first)[:, None]) if len(texts) else p
            best = mean.argmax(axis=1)
            score = np.clip(mean[np.arange(len(best)), best], 0, 1)
            yield pa.StructArray.from_arrays(
                [pa.array([net.labels[i] for i in best], pa.string()), pa.array(score, pa.float64())], fields=list(kind)
            )

    return predict


def identify(documents: DataFrame, net: ByteConvNet | None, text: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``."""
    kept = documents.drop("lang_pred", "score")
    if net is None:
        return kept.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    guess = kept.withColumn("_guess", predictor(net)(F.col(text)))
    worded = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return guess.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        F.when(worded, F.col("_guess.lang")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(worded, F.col("_guess.score")).otherwise(F.lit(0.0)).alias("score"),
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows set aside for measuring: crc32 of the id's text leaves remainder 1 by 3."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(documents.where(~held_out()))
    judged = identify(documents.select("doc_id", "text"), net)
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
