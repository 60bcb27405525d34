"""Arithmetic whose edge cases are fixed: rounding, undefined ratios, Fisher's z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 0.9999  # correlations are held this far from 1 before they are transformed


def whole(x: Column) -> Column:
    """The nearest whole number, of two the even one."""
    return F.rint(x).cast("long")


def pearson(x: Column, y: Column) -> Column:
    """Correlation of a group; null where a side doesn't vary. Not corr(), which raises."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def fisher(r: Column) -> Column:
    """Fisher's z of a correlation that is held within the limits; null stays null."""
    return F.when(r.isNotNull(), F.atanh(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), r))))


def rounded(x: Column, places: int = 6) -> Column:
    return F.round(x, places)


def flattened(x: Column, depth: int = 1) -> Column:
    """An array without its inner nesting of so many levels."""
    for _ in range(depth):
        x = F.flatten(x)
    return x
