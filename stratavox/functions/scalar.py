"""Column helpers: sigmoid, clipping, NaN scrubbing, vector arithmetic and linear voxel indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def scrub(c: Column) -> Column:
    """NaN, infinities and null become 0."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(0.0)).otherwise(d)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def all_within_rel(a: Column, b: Column, tol: float, eps: float = 1e-8) -> Column:
    """Every element of a differs from b's by at most tol, relative to b."""
    return F.forall(F.zip_with(a, b, lambda v, t: F.abs(v - t) / (F.abs(t) + F.lit(eps)) <= tol), lambda ok: ok)


def linear_index(z: Column, y: Column, x: Column, h: Column, w: Column) -> Column:
    return ((z.cast("long") * h + y) * w + x).cast("long")


def from_linear(i: Column, h: Column, w: Column) -> tuple[Column, Column, Column]:
    """(z, y, x) of a linear index."""
    plane = (h * w).cast("long")
    z = F.floor(i / plane)
    rest = i - z * plane
    y = F.floor(rest / w)
    return z.cast("int"), y.cast("int"), (rest - y * w).cast("int")
