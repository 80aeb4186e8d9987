"""Sums of small dense matrices by key, added up in numpy within tasks and once more after one shuffle.

A row of the result holds what a key's readings amount to: the upper triangle of the
sum of weight times the outer product of a row's vector. However many keys there
are, readings are read once and only a matrix per task and key is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers that a task holds before it hands its sums on.
_HELD = 4_000_000


def unpack(sums: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrices from rows of upper triangles."""
    out = np.zeros((len(sums), size, size))
    a, b = np.triu_indices(size)
    out[:, a, b] = sums
    out[:, b, a] = sums
    return out


def _added(keys: np.ndarray, rows: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """For each of ``count`` keys the packed sum of weighted outer products of its rows."""
    a, b = np.triu_indices(rows.shape[1])
    out = np.zeros((count, len(a)))
    order = np.argsort(keys, kind="stable")
    step = max(1, _HELD // max(1, len(a)))
    for k in range(0, len(order), step):
        own = order[k : k + step]
        products = rows[own][:, a] * rows[own][:, b] * weights[own, None]
        heads = np.flatnonzero(np.diff(keys[own], prepend=-1))
        out[keys[own][heads]] += np.add.reduceat(products, heads, axis=0)
    return out


def sums_by_key(rows: DataFrame, keys: Sequence[str], vector: Column, size: int, weight: Column) -> DataFrame:
    """(keys, n, sums): per key its number of readings and the packed sum of weight times the vector's outer product.

    Readings with a null weight, of weight 0, or whose vector has another size or a null in it count nothing. Keys may
    be null; an empty table gives an empty one.
    """
    kinds = [rows.schema[k] for k in keys]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            groups = table.select(range(len(keys))).to_pandas().groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy() if len(batch) else np.zeros(0, int)
            count = int(groups.max(initial=-1)) + 1
            vectors = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            weights = batch.column(len(keys) + 1).to_numpy(zero_copy_only=False)
            first = np.full(count, len(batch), np.int64)
            np.minimum.at(first, groups, np.arange(len(batch)))
            sums = _added(groups, vectors, weights, count)
            n = np.bincount(groups, minlength=count)
            yield _row([batch.column(k).take(pa.array(first)) for k in range(len(keys))], n, sums, keys)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: pa.RecordBatch | None = None
        for batch in batches:
            batch = batch if pending is None else pa.Table.from_batches([pending, batch]).combine_chunks().to_batches()[0]
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            new[0] = True
            for k in range(len(keys)):
                values = batch.column(k)
                same = np.array([x == y for x, y in zip(values[1:].to_pylist(), values[:-1].to_pylist(), strict=True)], bool)
                new[1:] |= ~same
            heads = np.flatnonzero(new)
            n = np.add.reduceat(batch.column(len(keys)).to_numpy(), heads)
            sums = np.add.reduceat(batch.column(len(keys) + 1).flatten().to_numpy().reshape(len(batch), -1), heads, axis=0)
            merged = _row([batch.column(k).take(pa.array(heads)) for k in range(len(keys))], n, sums, keys)
            # The last key may go on in the next batch.
            yield merged.slice(0, len(heads) - 1)
            pending = merged.slice(len(heads) - 1)
        if pending is not None:
            yield pending

    full = F.when((F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull()), vector)
    usable = rows.select(*keys, full.cast("array<double>").alias("vector"), weight.cast("double").alias("weight"))
    usable = usable.where("vector is not null and weight is not null and weight <> 0")
    schema = f"{ddl}, n long, sums array<double>"
    parts = usable.mapInArrow(partial, schema).repartition(*keys).sortWithinPartitions(*keys)
    return parts.mapInArrow(final, schema)


def _row(keys: list[pa.Array], n: np.ndarray, sums: np.ndarray, names: Sequence[str]) -> pa.RecordBatch:
    width = sums.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * width, pa.int32()), pa.array(sums.ravel()))
    return pa.RecordBatch.from_arrays([*keys, pa.array(n.astype(np.int64)), lists], [*names, "n", "sums"])


def mapped(table: DataFrame, columns: Sequence[T.StructField], work: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], out: str) -> DataFrame:
    """The key columns of a table of packed sums with what ``work(n, sums)`` gives: arrays of a number or a list a row."""
    names = [f.name for f in columns]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sums = batch.column("sums").flatten().to_numpy().reshape(len(batch), -1)
                made = work(batch.column("n").to_numpy(), sums)
                arrays = [pa.array(v) if v.ndim == 1 else pa.array(list(v)) for v in made.values()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *arrays], [*names, *made])

    return table.mapInArrow(rows, f"{ddl}, {out}")
