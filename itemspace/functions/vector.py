"""Array<double> expressions evaluated inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def array_dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def array_sqdist(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0), lambda acc, x: acc + x)


def array_norm(a, p: int = 2) -> Column:
    if p == 1:
        return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x))


def elementwise_agg(col, dims: int, fn=F.sum) -> Column:
    """One aggregate per position, returned as an array column.  Each is a
    plain aggregate with map-side partial aggregation, so a hot group costs
    one partial row per task, never a collected list."""
    c = _c(col)
    return F.array(*[fn(c[i]) for i in range(dims)])
