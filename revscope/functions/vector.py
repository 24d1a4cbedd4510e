"""Numeric array functions as higher-order Spark expressions (MTH1-MTH4, MAP1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Dot product of two equally long numeric arrays, in double precision."""
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda s, x: s + x)


def usable(a) -> Column:
    """Is it a vector of one component or more, all of them finite numbers?"""
    a = _col(a)
    finite = F.forall(a, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(a) > 0) & finite, F.lit(False))


def l2norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a) -> Column:
    """Unit-length copy of a vector (zero vectors stay zero)."""
    a = _col(a)
    # the length is bound to the variable of an outer lambda: in the inner one it would be computed anew for every component
    bound = F.array(F.struct(a.alias("v"), l2norm(a).alias("n")))
    unit = F.transform(bound, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(F.lit(0.0))))
    return unit[0]


def cosine_distance(a, b) -> Column:
    """MTH4: ``1 - cos`` of any two vectors (1 when one of them is zero)."""
    n = l2norm(a) * l2norm(b)
    return F.lit(1.0) - F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def softmax(logits) -> Column:
    """MTH2: numerically stable soft-max over an array."""
    a = _col(logits)
    m = F.array_max(a)
    exps = F.transform(a, lambda x: F.exp(x.cast("double") - m))
    total = F.aggregate(exps, F.lit(0.0).cast("double"), lambda s, x: s + x)
    return F.transform(exps, lambda x: x / total)


def argmax(values) -> Column:
    """0-based index of the first maximum."""
    a = _col(values)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def score_map(names, probs, digits: int = 6) -> Column:
    """MAP1: {label name: rounded probability}."""
    return F.map_from_arrays(_col(names), F.transform(_col(probs), lambda p: F.bround(p, digits)))
