"""Vector operators as column expressions over arrays, in double precision; null unless both lengths agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this product of norms a cosine is 0 (fixed values: machine epsilon of 32- and 64-bit floats).
EPSILON_F32, EPSILON_F64 = 1.1920929e-7, 2.220446049250313e-16


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _doubles(c: Column | str) -> Column:
    return _col(c).cast("array<double>")


def _sized(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value)


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = _doubles(a), _doubles(b)
    return _sized(a, b, _sum(F.zip_with(a, b, lambda x, y: x * y)))


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, epsilon: float = EPSILON_F32) -> Column:
    """0 where a norm is (nearly) 0; never beyond -1 and 1."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(dot(a, b).isNotNull(), F.when(norms < epsilon, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), norms)))))


def euclidean(a: Column | str, b: Column | str) -> Column:
    a, b = _doubles(a), _doubles(b)
    return _sized(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))


def hadamard(a: Column | str, b: Column | str) -> Column:
    a, b = _doubles(a), _doubles(b)
    return _sized(a, b, F.zip_with(a, b, lambda x, y: x * y))
