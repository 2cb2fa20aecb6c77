"""Arithmetic on array columns, in doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x / by)


def _with_norm(v: Column, then: Callable[[Column, Column], Column]) -> Column:
    """then(v, its length), both computed once: within a lambda Spark would compute them again for each component."""
    pair = F.transform(F.array(v), lambda u: F.struct(u.alias("v"), norm(u).alias("n")))
    return F.get(F.transform(pair, lambda s: then(s["v"], s["n"])), F.lit(0))


def unit(v: Column, message: str = "a query vector has zero norm") -> Column:
    """v at length one; a zero vector is an error."""
    return _with_norm(v, lambda u, n: F.when(n == 0, F.raise_error(F.lit(message)).cast("array<double>")).otherwise(scaled(u, n)))


def unit_or_zero(v: Column) -> Column:
    """v at length one; a zero vector stays."""
    return _with_norm(v, lambda u, n: F.when(n == 0, u).otherwise(scaled(u, n)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)
