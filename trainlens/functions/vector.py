"""Array<double> vector algebra as higher-order SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Inner product of two equal-length arrays, accumulated in double."""
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def repeated(value, a) -> Column:
    """``value`` once for each element of ``a``. As an argument of ``zip_with`` it is
    computed once a row; inside a lambda it would be for every element."""
    return F.array_repeat(_col(value), F.size(_col(a)))


def l2_norm(a) -> Column:
    sq = F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def l2_normalize(a, eps: float = 1e-12) -> Column:
    """x / max(||x||, eps), element-wise."""
    a = _col(a)
    denom = F.greatest(l2_norm(a), F.lit(eps))
    return F.zip_with(a, repeated(denom, a), lambda x, d: x.cast("double") / d)


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(z)))
