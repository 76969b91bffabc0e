"""Aggregates that stay defined where the built-in ones divide by zero."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(x: Column, y: Column, least: int = 2) -> Column:
    """Correlation over rows where both are present; 0 without variance or below ``least`` pairs."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when((F.count_if(both) < least) | flat, F.lit(0.0)).otherwise(
        F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)), F.lit(0.0))
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row.

    A helper column would be inlined by the optimizer and computed again for
    every element of an array; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
