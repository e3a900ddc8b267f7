"""Numeric, vector and array functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def to_number(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).try_cast("double"), F.lit(0.0))


def salary_columns(low: Column | str, high: Column | str, extreme: float = 100.0) -> dict[str, Column]:
    """Bounds in order (one published bound stands for both), midpoint and flags; the logarithm is null where pay isn't disclosed."""
    a, b = to_number(low), to_number(high)
    hi = F.greatest(a, b)
    lo = F.when((F.least(a, b) == 0) & (hi > 0), hi).otherwise(F.least(a, b))
    mid = (lo + hi) / 2
    return {
        "salary_min": lo, "salary_max": hi, "salary_mid": mid, "salary_disclosed": (mid > 0).cast("int"), "salary_is_range": ((hi > lo) & (lo > 0)).cast("int"),
        "salary_mid_log": F.when(mid > 0, F.log1p(mid)), "salary_extreme": (mid >= extreme).cast("int"),
    }


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    """Euclidean length, 1 for a zero vector."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def argmax(a: Column | str) -> Column:
    """Position of the first largest element, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def softmax(a: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    shares = lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total))
    return let(F.array_max(a), lambda top: let(F.transform(a, lambda x: F.exp(x - top)), shares))


def back_transform(c: Column, floor: float = 0.5) -> Column:
    """Pay from its log1p, floor at least."""
    return F.greatest(F.expm1(c), F.lit(floor))


def relative_error(y: Column, p: Column) -> Column:
    return F.abs(y - p) / F.greatest(F.abs(y), F.lit(1e-6))


def standardized(c: Column, mean: Column, deviation: Column) -> Column:
    return (c - mean) / F.greatest(deviation, F.lit(1e-6))


def hash32(c: Column) -> Column:
    """A number below 2**32 from text, the same in any SQL engine with SHA-1."""
    return F.conv(F.substring(F.sha1(c), 1, 8), 16, 10).cast("long")


def rounded(x: Column, digits: int) -> Column:
    """x at so many digits, half away from zero, by the double product itself: 0.1234565, whose millionfold is 123456.5 as a double, goes up, whatever its decimal digits."""
    scaled = F.abs(x) * float(10**digits)
    whole = F.floor(scaled)
    return F.signum(x) * (whole + (scaled - whole >= 0.5).cast("int")) / float(10**digits)
