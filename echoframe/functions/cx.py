"""Complex numbers as pairs of DOUBLE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pair(re: str | Column, im: str | Column) -> Pair:
    return col(re), col(im)


def times(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def times_conjugate(a: Pair, b: Pair) -> Pair:
    """a times the conjugate of b."""
    return a[0] * b[0] + a[1] * b[1], a[1] * b[0] - a[0] * b[1]


def power(a: Pair) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def modulus(a: Pair) -> Column:
    return F.sqrt(power(a))


def turn(cycles: Column) -> Pair:
    """exp(2 pi j cycles); whole cycles are taken off first, so large phases keep their precision."""
    x = (cycles - F.round(cycles)) * (2 * 3.141592653589793)
    return F.cos(x), F.sin(x)
