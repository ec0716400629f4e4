"""Vector functions; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def similarity(a: Column, b: Column) -> Column:
    """Dot product, held within [-1, 1] against rounding."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def all_finite(v: Column) -> Column:
    return F.coalesce(F.forall(_double(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def is_unit(v: Column, tolerance: float = 1e-4) -> Column:
    return F.coalesce(all_finite(v) & (F.abs(norm(v) - 1) <= tolerance), F.lit(False))


def vector_problem(v: Column, dimension: Column) -> Column:
    """Why a stored vector cannot be used: missing, dimension, not_finite, not_unit; null if it can."""
    return (
        F.when(v.isNull() | dimension.isNull(), "missing")
        .when(F.size(v) != dimension, "dimension")
        .when(~all_finite(v), "not_finite")
        .when(~is_unit(v), "not_unit")
    )


def vector_sha(v: Column) -> Column:
    """Fingerprint of a vector: the hash of its entries as text."""
    return F.sha2(F.to_json(v), 256)
