"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; a zero vector is like nothing."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def hashed_embedding(terms: Column, size: int = 64) -> Column:
    """A local stand-in for an embedding model: terms counted with signs in hashed places."""
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(size))
    sign = lambda t: F.when(F.pmod(F.shiftright(F.xxhash64(t), 20), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    own = F.transform(terms, lambda t: F.struct(place(t).alias("p"), sign(t).alias("s")))
    count = lambda i: F.aggregate(F.filter(own, lambda x: x["p"] == i), F.lit(0.0), lambda a, x: a + x["s"])
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: count(i).cast("float"))
