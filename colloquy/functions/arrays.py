"""Numeric array expressions (vectors are plain ``array<double>`` columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(value)) for value in values])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a * b))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def squared_distance(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: (a - b) * (a - b)))


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine of the angle; 0 when either vector has zero length."""
    lengths = norm(left) * norm(right)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(left, right) / F.nullif(lengths, F.lit(0.0)))


def cosine_distance(left: Column, right: Column) -> Column:
    """1 − cosine; 0 when either vector has zero length."""
    lengths = norm(left) * norm(right)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(
        F.lit(1.0) - dot(left, right) / F.nullif(lengths, F.lit(0.0))
    )


def divide(vector: Column, scalar: Column) -> Column:
    return F.transform(vector, lambda x: x / scalar)


def vector_mean(vector: Column) -> Column:
    """Elementwise mean as an aggregate with map-side partial sums."""
    return vector_to_array(Summarizer.mean(array_to_vector(vector)))


def vector_sum(vector: Column) -> Column:
    """Elementwise sum as an aggregate with map-side partial sums."""
    return vector_to_array(Summarizer.sum(array_to_vector(vector)))
