"""Positions on a closed ring of monitors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(position: Column, start: Column, size: Column | int) -> Column:
    """Steps forward from ``start`` to ``position``, in [0, size)."""
    return F.pmod(position - start, F.lit(size) if isinstance(size, int) else size)


def in_range(position: Column, start: Column, end: Column) -> Column:
    """Whether a position lies from ``start`` forward to ``end`` inclusive, over the seam if ``end`` is behind."""
    straight = position.between(start, end)
    around = (end < start) & ((position >= start) | (position <= end))
    return straight | around


def fractional(phase: Column) -> Column:
    """A phase modulo 1, in [0, 1)."""
    return ((phase % 1.0) + 1.0) % 1.0
