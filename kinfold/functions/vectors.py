"""Row-wise vector and scalar math on ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-16  # fixed value: guard used in every loss denominator and logarithm
L2_EPS = 1e-12  # fixed value: floor of the squared norm in l2_normalize


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def l1_norm(v: Column) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + F.abs(x))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def max_norm(v: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(as_double(v), lambda x: F.abs(x))), F.lit(0.0))


NORMS = {"l1": l1_norm, "l2": l2_norm, "max": max_norm}


def scale_by_norm(v: Column, norm: str) -> Column:
    """Divide by the named norm; all-zero rows stay zero."""
    if norm == "":
        return as_double(v)
    if norm not in NORMS:
        raise ValueError(f"norm must be one of '', {', '.join(NORMS)}; got {norm!r}")
    # Bound first, so that the norm is computed once and not in the test as well.
    return let(
        NORMS[norm](v),
        lambda size: F.transform(as_double(v), lambda x: x / F.when(size == 0.0, F.lit(1.0)).otherwise(size)),
    )


def l2_normalize(v: Column) -> Column:
    """Unit length, with the squared norm floored so that zero rows stay zero."""
    sq = F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x)
    inv = 1.0 / F.sqrt(F.greatest(sq, F.lit(L2_EPS)))
    return let(inv, lambda s: F.transform(as_double(v), lambda x: x * s))


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow; ``-log_sigmoid(-x)``."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


ACTIVATIONS = {"sigmoid": sigmoid, "tanh": F.tanh, "none": lambda x: x}


def activation(name: str):
    if name not in ACTIVATIONS:
        raise ValueError(f"activation must be one of {', '.join(ACTIVATIONS)}; got {name!r}")
    return ACTIVATIONS[name]


def safe_log(x: Column) -> Column:
    return F.ln(x + F.lit(EPS))


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded double with -0.0 folded into 0.0."""
    r = F.round(x.cast("double"), digits)
    return F.when(r == 0.0, F.lit(0.0)).otherwise(r)
