"""Vector expressions and the sizes of vector indexes."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_METRICS = {"": "cosine", "cosine": "cosine", "euclidean": "l2", "l2": "l2", "dot": "dot", "dot_product": "dot", "innerproduct": "dot", "inner_product": "dot"}


def metric_name(metric: str | None) -> str:
    """cosine, l2 or dot; unknown names are cosine."""
    return _METRICS.get((metric or "").strip().lower(), "cosine")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """-1 where a vector is null or empty, lengths differ or a norm is 0."""
    a, b = as_doubles(a), as_doubles(b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits, F.coalesce(dot(a, b) / F.nullif(norms, F.lit(0.0)), F.lit(-1.0))).otherwise(-1.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y))))


def closeness(a: Column, b: Column, metric: str) -> Column:
    """Greater is nearer, whatever the metric."""
    kind = metric_name(metric)
    return cosine(a, b) if kind == "cosine" else -l2(a, b) if kind == "l2" else dot(as_doubles(a), as_doubles(b))


def is_missing(vector: Column) -> Column:
    return vector.isNull() | (F.size(vector) <= 0)


def choose_lists(n: int, configured: int | None = None) -> int:
    """How many lists a partitioned index of n vectors has."""
    if n <= 0:
        return 1
    if configured and configured > 0:
        return min(configured, n)
    return max(1, n // 2) if n < 50 else min(100, max(10, math.isqrt(n)))


def choose_probes(lists: int) -> int:
    return min(max(1, lists), 10)


def index_factory(lists: int, template: str | None, n: int = 0) -> str:
    """The description of an index with its number of lists put in; a small set gets a flat one."""
    lists, given = max(1, lists), (template or "").strip()
    if 0 < n < 40:
        return f"IVF{lists},Flat"
    if not given:
        return f"IVF{lists}_HNSW10,Flat"
    if re.search(r"IVF\d+", given) or given.upper().startswith("IVF"):
        return re.sub(r"IVF\d+", f"IVF{lists}", given, count=1)
    return f"IVF{lists}_{given}"
