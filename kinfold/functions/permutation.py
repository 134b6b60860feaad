"""A seeded permutation of 0..n-1 as a column expression.

A Feistel network over the digits (l, r) of a number in base ceil(sqrt(n)) is a
bijection of the numbers below that base's square, whatever hash it uses. A
result that is not below n is permuted again, which leaves a bijection of the
numbers below n. So a row's place in a shuffle follows from its own number: no
sort, no window and no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions.hashing import hash_int

ROUNDS = 6


def whole_quotient(x: Column, by: Column) -> Column:
    """x div by for whole numbers that are not negative, exact beyond those of a double."""
    return F.call_function("div", x, by)


def base_of(n: int) -> int:
    return math.isqrt(max(n - 1, 0)) + 1


def _walks(n: int) -> int:
    """Steps after which a number is below n but for a chance of 2^-64."""
    outside = 1 - n / base_of(n) ** 2
    return math.ceil(64 / -math.log2(outside)) if outside > 0 else 0


def permuted(number: Column, n: int, seed) -> Column:
    """The place of ``number`` in the permutation of 0..n-1 that ``seed`` names."""
    if n < 1 or n >= 1 << 62:
        raise ValueError("a permutation needs 1 to 2^62 numbers")
    base = base_of(n)

    def once(x: Column) -> Column:
        def turn(s: Column, k: Column) -> Column:
            moved = F.pmod(s["l"] + hash_int(seed, k, s["r"]), F.lit(base))
            return F.struct(s["r"].alias("l"), moved.alias("r"))

        digits = F.struct(whole_quotient(x, F.lit(base)).alias("l"), F.pmod(x, F.lit(base)).alias("r"))
        rounds = F.array(*[F.lit(k) for k in range(ROUNDS)])
        return F.aggregate(rounds, digits, turn, lambda s: s["l"] * F.lit(base) + s["r"])

    at = once(number.cast("bigint"))
    walks = _walks(n)
    if walks:
        at = F.aggregate(
            F.sequence(F.lit(1), F.lit(walks)), at, lambda x, _: F.when(x >= F.lit(n), once(x)).otherwise(x)
        )
        at = F.when(at < F.lit(n), at).otherwise(F.raise_error(F.lit("no place below n was found")).cast("bigint"))
    return at
