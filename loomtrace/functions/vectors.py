"""Column functions on numeric vectors (arrays of numbers), computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALLEST_NORM = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """A vector of length 1; zeros stay zeros."""
    return F.get(F.transform(F.array(F.greatest(norm(v), F.lit(SMALLEST_NORM))), lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors, kept in -1 to 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def to_share(score: Column) -> Column:
    """A cosine moved to 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 1) / 2))


def vector_key(v: Column, decimals: int = 7) -> Column:
    """Components rounded, so that equal directions compare equal."""
    return F.transform(v, lambda x: F.round(x.cast("double"), decimals) + 0.0)


def close(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a - b) <= tolerance


def weighted_mean(vectors: Column, weights: Column) -> Column:
    """The mean of an array of vectors by weight, as a unit vector; null for an empty array."""
    sized = F.transform(F.arrays_zip(vectors.alias("v"), weights.alias("w")), lambda p: F.transform(p["v"], lambda x: x.cast("double") * p["w"]))
    return unit(F.aggregate(F.slice(sized, 2, F.greatest(F.size(sized) - 1, F.lit(0))), F.get(sized, F.lit(0)), lambda total, v: F.zip_with(total, v, lambda x, y: x + y)))
