"""Seeded integer hashes written as plain BIGINT arithmetic.

Everything here is a Catalyst expression that stays inside whole-stage codegen,
and uses only ``+ * % & ^ >>`` on values below 2^62, so any SQL engine computes
the same numbers.
"""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
MIX_FACTOR = 0x45D9F3B  # odd 27-bit multiplier: 32-bit operand times it stays below 2^59
PRIME31 = 2147483647  # fixed value: the modulus of the min-wise hash family, 2^31 - 1


def seed_constant(seed: int, purpose: str) -> int:
    """A 32-bit constant that depends on the seed and on what it is used for."""
    return random.Random(f"{purpose}:{seed}").getrandbits(32)


def _fold_down(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftright(x, 16))


def mix32(x: Column) -> Column:
    """Bijective mixing of a value in [0, 2^32) to a value in [0, 2^32)."""
    for _ in range(2):
        x = (_fold_down(x) * F.lit(MIX_FACTOR)).bitwiseAND(F.lit(MASK32))
    return _fold_down(x)


def hash32(key: Column, seed: int, purpose: str) -> Column:
    """Seeded hash of a non-negative BIGINT into [0, 2^32)."""
    key = key.cast("bigint")
    low = key.bitwiseXOR(F.shiftright(key, 32)).bitwiseAND(F.lit(MASK32))
    return mix32(low.bitwiseXOR(F.lit(seed_constant(seed, purpose)).cast("bigint")))


def hash63(key: Column, seed: int, purpose: str) -> Column:
    """Seeded hash of a non-negative BIGINT into [0, 2^63): draws from tables of any size."""
    low = F.shiftright(hash32(key, seed, f"{purpose}-low"), 1)
    return hash32(key, seed, purpose) * F.lit(1 << 31) + low


def long_array(values) -> Column:
    """An ARRAY<BIGINT> literal; Catalyst folds it to one constant."""
    return F.array(*[F.lit(int(v)).cast("bigint") for v in values])
