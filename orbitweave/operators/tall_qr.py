"""Triangular factors of tall matrices by a tree, and what their singular values tell before a fit.

The normal matrix squares a condition number, so that directions 1e-8 below the largest
drown in rounding. A factor R of the derivatives themselves, joined up a tree of tasks,
keeps them: each task factors its own rows, and groups of factors are stacked and factored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.operators.solvers import Degeneracy
from orbitweave.sources.shared_tables import written

_FACTOR = "part long, r array<double>"


def _stacked(rows: np.ndarray, size: int) -> np.ndarray:
    """R of stacked rows with a diagonal that is not negative, ``size`` by ``size``."""
    r = np.linalg.qr(np.vstack([rows, np.zeros((max(0, size - len(rows)), size))]), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def tall_qr(rows: DataFrame, jacobian: Column, size: int, weight: Column | None = None, fan: int = 16) -> np.ndarray:
    """R of the derivatives of all rows, each times the root of its weight, with a diagonal that is not negative.

    Rows with a null derivative or of another size, and those whose weight is null, NaN or not positive, count nothing;
    without rows R is 0. A task holds its R and a batch of rows, a group ``fan`` factors, the driver as many.
    """

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((size, size))
        for batch in batches:
            j = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            r = _stacked(np.vstack([r, j * np.sqrt(batch.column(1).to_numpy())[:, None]]), size)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel().tolist()])], ["part", "r"])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        stack = np.concatenate([np.asarray(r, float).reshape(size, size) for r in group["r"]])
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // fan], "r": [_stacked(stack, size).ravel().tolist()]})

    w = F.lit(1.0) if weight is None else weight.cast("double")
    full = rows.select(jacobian.cast("array<double>").alias("j"), w.alias("w"))
    full = full.where((F.size("j") == size) & ~F.exists("j", lambda x: x.isNull()) & (F.col("w") > 0) & ~F.isnan("w"))
    parts = written(full.mapInArrow(factor, _FACTOR), "factors")
    while (top := parts.agg(F.max("part")).first()[0] or 0) >= fan:
        by = F.expr(f"part div {fan}").alias("up")
        parts = written(parts.groupBy(by).applyInPandas(joined, _FACTOR), "factors")
        if top == 0:
            break
    stack = [np.asarray(r["r"], float).reshape(size, size) for r in parts.collect()]  # at most ``fan`` factors
    return _stacked(np.concatenate(stack) if stack else np.zeros((0, size)), size)


def degeneracy_of(r: np.ndarray, names: Sequence[str], rel_tol: float = 1e-12, zero: float = 1e-15, share: float = 0.1) -> Degeneracy:
    """Which knobs, and combinations of them, a factor of their derivatives cannot tell apart.

    Columns are scaled to length 1 first. ``relative`` are singular values over the largest, ascending.
    """
    length = np.sqrt((r * r).sum(axis=0))
    dead = length <= zero * max(float(length.max(initial=0.0)), zero)
    scaled = r * np.where(dead, 0.0, 1 / np.where(dead, 1.0, length))
    _, values, directions = np.linalg.svd(scaled)
    values, directions = values[::-1], directions[::-1]
    top = max(float(values.max(initial=0.0)), 1e-300)
    relative = values / top
    weak = relative < rel_tol
    told = []
    for k in np.flatnonzero(weak):
        part = np.abs(directions[k])
        order = [i for i in np.argsort(-part, kind="stable") if part[i] >= share * part.max()]
        told.append((float(relative[k]), tuple((names[i], float(directions[k, i])) for i in order)))
    condition = float("inf") if weak.any() or not len(values) else float(top / values.min())
    return Degeneracy(int((~weak).sum()), condition, relative, tuple(n for n, d in zip(names, dead, strict=True) if d), tuple(told))
