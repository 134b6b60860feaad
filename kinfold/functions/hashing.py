"""Seeded randomness as plain column expressions.

Every random choice is a function of (seed, keys), so a retried task draws
the same numbers and plain SQL can restate the result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO32 = float(2**32)


def hash_key(seed, *keys: Column) -> Column:
    """Hex digest of ``seed:key:key...``; sorting by it is a seeded shuffle."""
    parts = [F.lit(str(seed))] + [k.cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hash_int(seed, *keys: Column) -> Column:
    """Uniform integer in [0, 2**32)."""
    return digest_int(hash_key(seed, *keys), 0)


def digest_int(digest: Column, word: int) -> Column:
    """The ``word``-th 32-bit integer of a hex digest; words are independent."""
    return F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("bigint")


def hash_uniform(seed, *keys: Column, method: str = "md5") -> Column:
    """Uniform double in [0, 1).

    ``md5`` can be restated in any SQL engine; ``xxhash64`` stays in generated
    code and costs a small part of it, for per-value draws over large data.
    """
    if method == "md5":
        return hash_int(seed, *keys) / F.lit(_TWO32)
    if method == "xxhash64":
        h = F.xxhash64(F.lit(str(seed)), *keys)
        return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(2**53))
    raise ValueError(f"unknown hash method {method!r}")
