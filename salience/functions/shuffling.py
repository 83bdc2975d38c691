"""Seeded pseudo-random orders built from 64-bit integer arithmetic.

Every random choice the engine makes (splits, blocks, permutations) is a pure
function of keys and a seed, so a recomputed task always draws the same order
and any SQL engine can reproduce it.  ``x -> x^5 mod (2^31 - 1)`` is a
bijection of the field, because 5 does not divide 2^31 - 2, so distinct
inputs never collide.
"""

from __future__ import annotations

from itertools import count
from math import gcd

from pyspark.sql import Column, functions as F

# Fixed values of the mixing function.
MODULUS = 2147483647
POSITION_FACTOR = 48271
REPEAT_FACTOR = 7368787
SEED_FACTOR = 15485863
OFFSET = 12345
# Starts of factors; factor times position stays below 2^63 for MAX_ROWS rows.
FACTOR_RANGE = 1 << 20
MAX_ROWS = 1 << 42


def fifth_power(x: Column) -> Column:
    """``x^5 mod 2^31-1`` for 0 <= x < 2^31-1, never leaving 64-bit range."""
    square = (x * x) % MODULUS
    return ((square * square) % MODULUS * x) % MODULUS


def hash_id(key: Column, data_type: str, seed: int = 0) -> Column:
    """Uniform integer in [0, 2^31-1) from an integer or string key."""
    if data_type in ("tinyint", "smallint", "int", "bigint"):
        folded = F.pmod(key.cast("bigint"), F.lit(MODULUS))
    else:
        digits = F.substring(F.md5(key.cast("string")), 1, 8)
        folded = F.conv(digits, 16, 10).cast("bigint") % MODULUS
    return fifth_power((folded * POSITION_FACTOR + (seed * SEED_FACTOR + OFFSET)) % MODULUS)


def affine_shuffle(rows: int, repeat: int, seed: int) -> tuple[int, int]:
    """Factor and shift of the permutation ``p -> (factor * p + shift) mod rows``.

    The factor is the first number from a seeded start on that has no divisor in
    common with ``rows``.
    """
    if rows > MAX_ROWS:
        raise ValueError(f"at most {MAX_ROWS} rows can be shuffled")
    shift = pow((repeat * REPEAT_FACTOR + seed * SEED_FACTOR + OFFSET) % MODULUS, 5, MODULUS)
    start = pow((shift * POSITION_FACTOR + OFFSET) % MODULUS, 5, MODULUS) % FACTOR_RANGE + 1
    factor = next(a for a in count(start) if gcd(a, rows) == 1)
    return factor, shift % rows
