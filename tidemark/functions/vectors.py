"""Column expressions over vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """0 where the dimensions differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where the dimensions differ or a vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def euclidean_similarity(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), 1.0 / (1.0 + distance(a, b))).otherwise(0.0)


def normalized(a: Column) -> Column:
    """Unit length; a vector of no length stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(doubles(a))


def signed_round(x: Column, digits: int) -> Column:
    """Rounded; a negative number that becomes zero becomes -0.0, which Spark's rounding drops."""
    near = F.round(x, digits)
    return F.when((near == 0) & F.startswith(x.cast("string"), F.lit("-")), F.lit(-0.0)).otherwise(near)
