"""Vector expressions on ``array<float>`` and ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Scaled to length one; a zero vector stays zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def squared_distance(v: Column, to: Sequence[float]) -> Column:
    """The squared L2 distance to a literal vector, unrolled so that it stays inside generated code."""
    terms = [(F.get(v, F.lit(i)).cast("double") - F.lit(float(x))) for i, x in enumerate(to)]
    total = F.lit(0.0)
    for t in terms:
        total = total + t * t
    return total


def similarity_of_distance(d: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + d)
