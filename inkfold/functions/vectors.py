"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, least: float = 1e-9) -> Column:
    """Divided by the norm, or by `least` where that is larger."""
    n = F.greatest(norm(v), F.lit(least))
    return F.transform(v, lambda x: x / n)


def unit_soft(v: Column, eps: float = 1e-12) -> Column:
    """Divided by the norm plus eps."""
    n = norm(v) + eps
    return F.transform(v, lambda x: x / n)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Cosine similarity; near 0 for a zero vector."""
    return dot(a, b) / (norm(a) * norm(b) + eps)


def clipped(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def saturation(n: Column, tau: float) -> Column:
    """1 - exp(-n / tau)."""
    return 1 - F.exp(-n / F.lit(float(tau)))
