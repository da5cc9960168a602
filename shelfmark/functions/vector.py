"""Vector expressions over ARRAY<FLOAT|DOUBLE> columns; all arithmetic is in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it, in lambdas too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalise(v: Column) -> Column:
    """At unit length; a zero vector stays as it is."""
    return bind(as_double(v), lambda d: bind(norm(d), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d)))


def quantise(v: Column) -> Column:
    """Codes -127 to 127 of the unit vector, as TINYINT."""
    return bind(as_double(v), lambda d: bind(norm(d), lambda n: F.transform(d, lambda x: F.round(F.try_divide(x, n) * 127).cast("tinyint"))))


def integer_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)


def malformed(v: Column) -> Column:
    """Whether an entry is null, infinite or no number."""
    return F.exists(as_double(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
