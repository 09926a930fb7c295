"""Vectorised lane kernels: k hash values for every feature of a batch of rows.

Both take a batch of feature arrays, lay them end to end and reduce each lane per row.
A lane costs one pass over the batch, so the temporary memory does not depend on k.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitfold.functions.bits import WORD_BITS
from bitfold.functions.hashing import PRIME31

LONGS = T.ArrayType(T.LongType())

GAUSS_SCALE = float(1 << 20)  # projections are summed as integers of 2^-20


def draw_coefficients(seed: int, rows: int, columns: int) -> list[list[int]]:
    """Hash coefficients, uniform in [1, 2^31 - 2], row by row."""
    draws = np.random.RandomState(seed).randint(1, PRIME31, size=(rows, columns))
    return [[int(v) for v in row] for row in draws]


def _end_to_end(features: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    arrays = features.to_numpy()
    lengths = np.fromiter((len(a) for a in arrays), dtype=np.int64, count=len(arrays))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.concatenate(arrays).astype(np.int64), starts


def lane_minima_udf(coefficients: list[list[int]]):
    """array of features -> array of the k smallest hashes, one per lane."""

    @F.pandas_udf(LONGS)
    def lane_minima(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        x, starts = _end_to_end(features)
        x %= PRIME31  # the hash is taken modulo the prime anyway, and products stay below 2^62
        out = np.empty((len(features), len(coefficients)), dtype=np.int64)
        for lane, (a, b) in enumerate(coefficients):
            out[:, lane] = np.minimum.reduceat((a * x + b) % PRIME31, starts)
        return pd.Series(list(out))

    return lane_minima


def gaussian_sums_udf(coefficients: list[list[int]], k: int):
    """array of 31-bit feature hashes -> array of k summed Gaussian draws (scaled integers)."""

    @F.pandas_udf(LONGS)
    def gaussian_sums(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        x, starts = _end_to_end(features)
        # a feature that many rows have is drawn for once a batch
        x, which = np.unique(x, return_inverse=True)
        which = which.reshape(-1)
        out = np.empty((len(features), 2 * len(coefficients)), dtype=np.int64)
        for pair, (ra, rb, ta, tb) in enumerate(coefficients):
            radius = np.sqrt(-2.0 * np.log(((ra * x + rb) % PRIME31 + 1) / float(PRIME31)))
            angle = 2 * math.pi * (((ta * x + tb) % PRIME31) / float(PRIME31))
            for lane, wave in ((2 * pair, np.cos(angle)), (2 * pair + 1, np.sin(angle))):
                draws = np.rint(radius * wave * GAUSS_SCALE).astype(np.int64)
                out[:, lane] = np.add.reduceat(draws[which], starts)
        return pd.Series(list(out[:, :k]))

    return gaussian_sums


@F.pandas_udf(LONGS)
def pack_signs_udf(lanes: pd.Series) -> pd.Series:
    """Words whose bit j says that lane j is not negative."""
    if not len(lanes):
        return pd.Series([], dtype=object)
    signs = np.stack(lanes.to_numpy()) >= 0
    k = signs.shape[1]
    words = [
        (signs[:, w : w + WORD_BITS].astype(np.int64) << np.arange(min(WORD_BITS, k - w))).sum(axis=1)
        for w in range(0, k, WORD_BITS)
    ]
    return pd.Series(list(np.stack(words, axis=1)))
