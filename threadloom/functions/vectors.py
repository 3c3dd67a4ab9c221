"""Vector scalars as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector is null, empty or zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def cosine_to(a: Column, vector: list[float]) -> Column:
    """Cosine similarity to a fixed vector, whose length is computed once."""
    size = math.sqrt(sum(float(x) * float(x) for x in vector))
    return F.try_divide(dot(a, literal(vector)), F.sqrt(dot(a, a)) * F.lit(size))
