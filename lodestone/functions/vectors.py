"""Vector column builders over arrays. Elements are doubles before they are multiplied and added."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def normalize(a: Column) -> Column:
    """Of length 1; null for a zero vector."""
    return F.when(norm(a) > 0, F.transform(doubles(a), lambda x: x / norm(a)))


def quantize(a: Column) -> Column:
    """To signed bytes: 127 times the value in [-1, 1], in single precision, halves to even."""
    return F.transform(a, lambda x: F.bround(F.greatest(F.lit(-1.0).cast("float"), F.least(F.lit(1.0).cast("float"), x.cast("float"))) * F.lit(127.0).cast("float"), 0).cast("tinyint"))


def cosine_bytes(query: list[float], quantized: Column) -> Column:
    """A query of length 1 against a quantized vector."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    real = F.transform(quantized, lambda b: b.cast("double") / 127.0)
    size = F.sqrt(_sum(F.transform(real, lambda x: x * x)))
    return F.when(size > 0, _sum(F.zip_with(literal, real, lambda x, y: x * y)) / size).otherwise(F.lit(0.0))


def unit(vector: list[float]) -> list[float]:
    size = math.sqrt(sum(x * x for x in vector))
    return [x / size for x in vector] if size else vector


def blend(similarities: Column, named: bool) -> Column:
    """The two best prompts' similarities: .65 and .35 for a named subject, else .82 and .18; one alone counts whole."""
    a, b = (0.65, 0.35) if named else (0.82, 0.18)
    best = F.sort_array(similarities, asc=False)
    return F.when(F.size(best) == 1, best[0]).otherwise(a * best[0] + b * F.get(best, F.lit(1)))
