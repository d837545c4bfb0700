"""Scalar arithmetic on intervals [start, end] in seconds and on boxes [x, y, w, h]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = F.lit


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Seconds that two intervals share; 0 when they only touch."""
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def overlap_of_shorter(s1: Column, e1: Column, s2: Column, e2: Column, floor: float | None = None) -> Column:
    """Overlap over the shorter interval; with a floor for its length, or 0 when the shorter is empty."""
    shorter = F.least(e1 - s1, e2 - s2)
    if floor is not None:
        return overlap(s1, e1, s2, e2) / F.greatest(F.lit(floor), shorter)
    return F.when(shorter > 0, overlap(s1, e1, s2, e2) / shorter).otherwise(F.lit(0.0))


def overlap_of_first(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Share of the first interval that the second covers."""
    return F.when(e1 > s1, overlap(s1, e1, s2, e2) / (e1 - s1)).otherwise(F.lit(0.0))


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    union = (e1 - s1) + (e2 - s2) - overlap(s1, e1, s2, e2)
    return F.when(union > 0, overlap(s1, e1, s2, e2) / union).otherwise(F.lit(0.0))


def gap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Seconds between two intervals, 0 when they overlap or touch."""
    return F.greatest(F.lit(0.0), s2 - e1, s1 - e2)


def _box_overlap(a: Column, b: Column) -> Column:
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes given as arrays."""
    both = _box_overlap(a, b)
    union = a[2] * a[3] + b[2] * b[3] - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def box_containment(inner: Column, outer: Column) -> Column:
    """Share of the inner box that lies in the outer."""
    area = inner[2] * inner[3]
    return F.when(area > 0, _box_overlap(inner, outer) / area).otherwise(F.lit(0.0))
