"""Distances between vectors: whole blocks of pairs at once with NumPy, and single pairs as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: np.ndarray, b: np.ndarray, term: Callable) -> np.ndarray:
    """Sum over the dimensions, one after another, of a term of the columns: exact differences, and no more memory than the result."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += term(a[:, k, None], b[None, :, k])
    return out


def _chebyshev(a, b):
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        np.maximum(out, np.abs(a[:, k, None] - b[None, :, k]), out=out)
    return out


def _canberra(p, q):
    s = np.abs(p) + np.abs(q)
    return np.divide(np.abs(p - q), s, out=np.zeros_like(s), where=s > 0)


def _divide(p, q):
    return np.divide(p, q, out=np.full_like(p, np.nan), where=q > 0)


def _cosine(a, b):
    n = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]
    return 1 - _divide(_sum(a, b, lambda p, q: p * q), n)


def _r(a, b):
    return 1 - _cosine(a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True))


def beta_tail(x: np.ndarray, p: float, q: float = 0.5) -> np.ndarray:
    """Regularized incomplete beta function by its continued fraction."""
    flip = x > (p + 1) / (p + q + 2)
    y = np.where(flip, 1 - x, x)
    a, b = np.where(flip, q, p), np.where(flip, p, q)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (a + b) * y / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 200):
        for t in (m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + t / np.where(np.abs(c) < tiny, tiny, c)
            h *= c * d
    log_beta = math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q)
    with np.errstate(divide="ignore"):
        front = np.exp(a * np.log(y) + b * np.log1p(-y) - log_beta) / a
    out = np.where(y <= 0, 0.0, np.nan_to_num(front * h))
    return np.where(flip, 1 - out, out)


def _pearson(a, b):
    """The larger of the correlation and its two-sided p-value. With fewer than three entries there is no p-value."""
    r = np.clip(_r(a, b), -1, 1)
    if a.shape[1] < 3:
        return r
    return np.fmax(r, beta_tail(1 - r * r, a.shape[1] / 2 - 1))


#: name -> matrix of the metric for all pairs of two blocks of row vectors. Where a metric isn't defined (zero vectors) it is NaN.
METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "euclidean": lambda a, b: np.sqrt(_sum(a, b, lambda p, q: (p - q) ** 2)),
    "manhattan": lambda a, b: _sum(a, b, lambda p, q: np.abs(p - q)),
    "minkowski3": lambda a, b: np.cbrt(_sum(a, b, lambda p, q: np.abs(p - q) ** 3)),
    "chebyshev": _chebyshev,
    "canberra": lambda a, b: _sum(a, b, _canberra),
    "braycurtis": lambda a, b: _divide(_sum(a, b, lambda p, q: np.abs(p - q)), _sum(a, b, lambda p, q: np.abs(p + q))),
    "mahalanobis_pair": lambda a, b: _sum(a, b, lambda p, q: (p - q) ** 2) / math.sqrt(2),
    "correlation": lambda a, b: 1 - _r(a, b),
    "cosine": _cosine,
    "pearson_r": _r,
    "pearson": _pearson,
    "rbf": lambda a, b: np.maximum(np.exp(-_sum(a, b, lambda p, q: (p - q) ** 2)), 0.01),
}
#: Metrics whose value itself is the weight of an edge; for rbf the weight is its inverse, like for distances.
OWN_WEIGHT = ("correlation", "cosine", "pearson_r", "pearson")


def minkowski(p: float) -> Callable:
    """The Minkowski distance of any order p >= 1."""
    return lambda a, b: _sum(a, b, lambda s, t: np.abs(s - t) ** p) ** (1 / p)


def rbf(gamma: float) -> Callable:
    return lambda a, b: np.maximum(np.exp(-gamma * _sum(a, b, lambda p, q: (p - q) ** 2)), 0.01)


def euclidean(x: Column, y: Column) -> Column:
    """Distance of two array columns of equal length."""
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t))
