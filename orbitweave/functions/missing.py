"""The three kinds of missing values of a measurement, and weights from variances.

A null or NaN reading is absent; a variance of plus infinity, NaN, zero or less means
weight zero; a NaN loss is a lost beam and leaves every sum. Spark sorts NaN above all
numbers, so each aggregate here guards against it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITE = float("inf")


def present(value: Column) -> Column:
    """Neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def usable_variance(variance: Column) -> Column:
    """Finite and positive; false for null."""
    return F.coalesce(present(variance) & (variance > 0) & (variance < INFINITE), F.lit(False))


def weight(variance: Column) -> Column:
    """Inverse variance, or 0 where the variance is not usable."""
    return F.when(usable_variance(variance), 1.0 / variance).otherwise(0.0)


def absent_to_null(value: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(present(value), value)
