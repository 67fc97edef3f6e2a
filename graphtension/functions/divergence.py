"""Divergences between two whole distributions as array expressions (generated code, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphtension.operators.tension import EPS


def normalize(a: Column) -> Column:
    """Divide by the sum; uniform if the sum is 0."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.transform(a, lambda x: F.when(total > 0, x / F.nullif(total, F.lit(0.0))).otherwise(1.0 / F.size(a)))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def kl(p: Column, q: Column) -> Column:
    return _sum(F.zip_with(p, q, lambda x, y: F.when(x > 0, (x + EPS) * F.log2((x + EPS) / (y + EPS))).otherwise(0.0)))


def jsd(p: Column, q: Column) -> Column:
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return 0.5 * kl(p, m) + 0.5 * kl(q, m)


def hellinger(p: Column, q: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(p, q, lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), F.lit(2.0)))) / 2)


def wasserstein(p: Column, q: Column) -> Column:
    """Distance over positions: summed absolute difference of the running sums."""
    out = F.aggregate(F.zip_with(p, q, lambda x, y: x - y), F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")), lambda s, d: F.struct((s.run + d).alias("run"), (s["sum"] + F.abs(s.run + d)).alias("sum")))
    return out["sum"]
