"""Vector expressions over array columns; all arithmetic is in double."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 when a side has no length. Pass precomputed norms when a side is reused."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def _moments(v: Column, *names: str, weight: Column | None = None) -> Column:
    """Aggregate: Spark ML's mergeable vector summary, one tight JVM loop per row.

    It keeps central moments with the pairwise update of Chan et al. (1979), combines before
    the shuffle, and gives a spread of exactly zero for copies.
    """
    vector = array_to_vector(as_double(v))
    summary = Summarizer.metrics(*names)
    return summary.summary(vector) if weight is None else summary.summary(vector, weight)


def mean_vector(v: Column) -> Column:
    """Aggregate: element-wise mean."""
    return vector_to_array(_moments(v, "mean")["mean"])


def moments(v: Column, weight: Column | None = None) -> Column:
    """Aggregate: struct with element-wise mean and unbiased variance, see mean_of and variance_of."""
    return _moments(v, "mean", "variance", weight=weight)


def mean_of(summary: Column) -> Column:
    return vector_to_array(summary["mean"])


def variance_of(summary: Column) -> Column:
    """Sum of the element-wise unbiased variances."""
    return F.aggregate(vector_to_array(summary["variance"]), F.lit(0.0), lambda acc, x: acc + x)


def bessel(m2: Column, n: Column) -> Column:
    return F.when(n > 1, m2 / (n - 1)).otherwise(F.lit(0.0))


def pooled_variance(n1: Column, v1: Column, n2: Column, v2: Column, dist_sq: Column) -> Column:
    """Variance of the union of two samples given sizes, variances and squared centroid distance."""
    n = n1 + n2
    m2 = (n1 - 1) * v1 + (n2 - 1) * v2 + n1 * n2 * dist_sq / n
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), m2 / (n - 1)))
