"""Expressions on vectors held as ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def quadratic(a: Column, m: Column) -> Column:
    """``a . M . a`` for a square matrix held as an array of rows."""
    return dot(a, F.transform(m, lambda row: dot(row, a)))


def mahalanobis(a: Column, b: Column, inverse: Column) -> Column:
    return F.sqrt(F.greatest(quadratic(F.zip_with(a, b, lambda x, y: x - y), inverse), F.lit(0.0)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two histograms; 1 when one of them is flat."""
    n = F.size(a)
    sa, sb = total(a), total(b)
    cov = dot(a, b) - sa * sb / n
    var = (dot(a, a) - sa * sa / n) * (dot(b, b) - sb * sb / n)
    return F.when(var > 1e-24, cov / F.sqrt(var)).otherwise(F.lit(1.0))


def hist_distance(a: Column, b: Column, metric: str = "correl") -> Column:
    """Distance of histogram ``a`` from ``b``; unequal sizes give -1 (2 for correlation).

    L1 and L2 are raw norms; the intersection stays a similarity.
    """
    z = F.zip_with
    if metric == "correl":
        return F.when(F.size(a) == F.size(b), 1.0 - correlation(a, b)).otherwise(F.lit(2.0))
    if metric == "l1":
        d = total(z(a, b, lambda x, y: F.abs(x - y)))
    elif metric == "l2":
        d = euclid(a, b)
    elif metric == "chisqr":
        d = total(z(a, b, lambda x, y: F.when(F.abs(x) > 2.220446049250313e-16, (x - y) * (x - y) / x).otherwise(0.0)))
    elif metric == "intersect":
        d = total(z(a, b, lambda x, y: F.least(x, y)))
    elif metric == "hellinger":
        norm = total(a) * total(b)
        scale = F.when(norm > 1.1920929e-07, 1.0 / F.sqrt(norm)).otherwise(1.0)
        d = F.sqrt(F.greatest(1.0 - total(z(a, b, lambda x, y: F.sqrt(x * y))) * scale, F.lit(0.0)))
    else:
        raise ValueError(metric)
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(-1.0))


def mean_block_distance(ds: Column) -> Column:
    """``1 - mean(|1 - d|)`` over the blocks of a frame."""
    return 1.0 - total(F.transform(ds, lambda d: F.abs(1.0 - d))) / F.size(ds)


def block_distance(a: Column, b: Column, n_blocks: int, metric: str = "correl") -> Column:
    """Mean distance over ``n_blocks`` equal slices of two concatenated block histograms."""
    ds = F.transform(
        F.sequence(F.lit(0), F.lit(n_blocks - 1)),
        lambda k: hist_distance(_slice(a, k, n_blocks), _slice(b, k, n_blocks), metric),
    )
    return mean_block_distance(ds)


def _slice(v: Column, k: Column, n_blocks: int) -> Column:
    w = F.floor(F.size(v) / n_blocks).cast("int")
    return F.slice(v, (k * w + 1).cast("int"), w)


def normalise(x: Column, inverse: Column | None = None, root: bool = False) -> Column:
    """Divide by ``x.x`` (or ``x.M.x``), the square as such; ``root`` divides by the norm."""
    n = dot(x, x) if inverse is None else quadratic(x, inverse)
    n = F.sqrt(n) if root else n
    return F.transform(x, lambda v: v / n)
