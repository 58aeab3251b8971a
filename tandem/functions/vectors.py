"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions.cells import as_column


def to_doubles(vec: Column | str) -> Column:
    return as_column(vec).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_column(a), as_column(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column | str) -> Column:
    return F.sqrt(
        F.aggregate(to_doubles(vec), F.lit(0.0), lambda acc, x: acc + x * x)
    )


def unit(vec: Column | str) -> Column:
    """L2-normalised vector; the zero vector is returned unchanged."""
    v = to_doubles(vec)
    # The length is bound as a lambda variable so that it is computed once per vector.
    scaled = F.transform(
        F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)
    )
    return F.element_at(scaled, 1)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two vectors; null where either has no length."""
    denominator = norm(a) * norm(b)
    return F.when(denominator > 0, dot(to_doubles(a), to_doubles(b)) / denominator)
