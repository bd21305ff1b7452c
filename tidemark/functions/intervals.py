"""Interval arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two intervals; 0 when the union is not positive."""
    shared = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    union = (e1 - s1) + (e2 - s2) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))
