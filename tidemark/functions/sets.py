"""Set algebra and ratios over arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; 0 for two empty sets."""
    return safe_ratio(overlap(a, b), F.size(F.array_union(a, b)))


def micro_prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return p, r, safe_ratio(2 * p * r, p + r)


def field_set(labels: Column, field: str) -> Column:
    """The distinct non-empty values of one level of the labels, sorted."""
    return F.sort_array(F.array_distinct(F.filter(F.transform(labels, lambda x: x[field]), lambda v: v != "")))


def changed(now: Column, before: Column) -> Column:
    """kept, added and removed items, in their order, and the Jaccard index."""
    kept = F.filter(now, lambda x: F.array_contains(before, x))
    return F.struct(kept.alias("kept"), F.array_except(now, before).alias("added"), F.array_except(before, now).alias("removed"), jaccard(now, before).alias("jaccard"))


def r6(c: Column) -> Column:
    return F.round(c, 6)
