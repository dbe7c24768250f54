"""Distances between array columns, as column expressions and as NumPy matrices.

Both compute in double precision.  The expressions add up in element order, so that other engines
that do the same get bit-equal values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillvec.config import Metric


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _d(x: Column) -> Column:
    return x.cast("double")


def inner(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return _sum(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))))


def dot(a: Column, b: Column) -> Column:
    """Negated inner product."""
    return -inner(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: _d(x) * _d(x))))


def cosine_from(product: Column, norm_a: Column, norm_b: Column) -> Column:
    """1 - cosine similarity from parts: 1 where a norm is 0, similarity kept within [-1, 1]."""
    similarity = product / (norm_a * norm_b)
    return F.when(norm_a * norm_b == 0, F.lit(1.0)).otherwise(
        1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), similarity))
    )


def cosine(a: Column, b: Column) -> Column:
    return cosine_from(inner(a, b), norm(a), norm(b))


KERNELS = {Metric.L2: l2, Metric.DOT: dot, Metric.COSINE: cosine}


def distance(metric: Metric | str, a: Column, b: Column) -> Column:
    """Distance of ``a`` and ``b``; an error at run time where their sizes differ.

    Null where either is null.
    """
    kernel = KERNELS[Metric(metric)](a, b)
    return F.when(F.size(a) == F.size(b), kernel).otherwise(
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(
            F.raise_error(F.lit("vectors differ in size")).cast("double")
        )
    )


def matrix(metric: Metric | str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of ``a`` and of ``b``, in double precision."""
    metric = Metric(metric)
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    product = a @ b.T
    if metric is Metric.DOT:
        return -product
    if metric is Metric.L2:
        squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None]
        return np.maximum(0.0, squares - 2 * product)
    norms = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None]
    similarity = np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)
    return np.where(norms > 0, 1.0 - np.clip(similarity, -1.0, 1.0), 1.0)
