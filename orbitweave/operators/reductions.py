"""Sums of weighted residuals: losses, gradients, normal matrices, shared readings.

Every reduction is a partial and a final sum, so Spark combines before it shuffles;
matrices travel as (a, b, value) entries of their lower triangle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitweave.functions.missing import INFINITE, present, weight


def with_global_weights(rows: DataFrame, variance: str = "variance", active: Column | None = None) -> DataFrame:
    """Adds ``weight``: inverse variance over the largest one of all ``active`` rows; a scale of 1 if none is positive.

    Rows that are not active are on the same scale, and may exceed 1.
    """
    raw = rows.withColumn("raw", weight(F.col(variance)))
    scale = raw.agg(F.max("raw" if active is None else F.when(active, F.col("raw"))).alias("scale"))  # one row
    joined = raw.join(F.broadcast(scale))
    return joined.withColumn("weight", F.col("raw") / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)).drop("raw", "scale")


def kept_sums(rows: DataFrame, keys: Sequence[str], residual: Column, weight_col: str, particles: int = 1) -> DataFrame:
    """(keys, n_kept, loss, grad): sums over readings of positive weight, by their number and, the loss, by particles too."""
    kept, w = F.count_if(F.col(weight_col) > 0), F.col(weight_col)
    points = F.greatest(kept, F.lit(1))
    return rows.groupBy(*keys).agg(
        kept.alias("n_kept"), (F.sum(w * residual * residual) / (particles * points)).alias("loss"), (F.sum(2 * w * residual) / points).alias("grad")
    )


def against_reference(signal: DataFrame, reference: DataFrame, keys: Sequence[str], relative: Mapping[str, bool]) -> DataFrame:
    """A row per signal and plane with ``residual``: less the reference of the same keys where the plane is relative."""
    shared = reference.select(*keys, *(F.col(p).alias(f"{p}_reference") for p in relative))
    each = [
        F.struct(F.lit(p).alias("plane"), (F.col(p) - F.col(f"{p}_reference") if off else F.col(p)).alias("residual")) for p, off in relative.items()
    ]
    return signal.join(shared, list(keys)).select("*", F.inline(F.array(*each)))


def normalisation(rows: DataFrame, weight_col: str = "weight") -> DataFrame:
    """One row: the largest weight as ``scale`` (1 if none is positive) and the number of non-zero weights, at least 1."""
    largest = F.max(weight_col)
    return rows.agg(
        F.when(largest > 0, largest).otherwise(1.0).alias("scale"),
        F.greatest(F.lit(1), F.sum((F.col(weight_col) != 0).cast("int"))).cast("long").alias("points"),
    )


def chi_square(rows: DataFrame, keys: Sequence[str], residual: Column, weight_col: str = "weight") -> DataFrame:
    """Sum of weight times squared residual and number of weighted readings per key; absent residuals count 0."""
    here = present(residual) & (F.col(weight_col) > 0)
    return rows.groupBy(*keys).agg(
        F.sum(F.when(here, F.col(weight_col) * residual * residual).otherwise(0.0)).alias("chi2"),
        F.sum(here.cast("int")).cast("long").alias("n_points"),
    )


def gradient(rows: DataFrame, jacobian: str, residual: Column, weight_col: str = "weight") -> DataFrame:
    """(k, grad): twice the sum of weight, residual and the k-th derivative, k from 0."""
    each = rows.select((2.0 * F.col(weight_col) * residual).alias("c"), F.posexplode(jacobian).alias("k", "j"))
    return each.groupBy("k").agg(F.sum(F.col("c") * F.col("j")).alias("grad"))


def normal_matrix(rows: DataFrame, jacobian: str, weight_col: str = "weight") -> DataFrame:
    """(a, b, value), a >= b from 0: the lower triangle of the weighted sum of outer products.

    A task adds its readings up as one matrix, so what is shuffled are pairs of knobs
    per task and not per reading. Readings with a null weight or derivative count nothing.
    """

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in parts:
            w, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                own = np.repeat(lengths == size, lengths)
                j = flat[own].reshape(-1, size)
                sums[size] = sums.get(size, 0.0) + (j * w[lengths == size, None]).T @ j
        for matrix in sums.values():
            at, to = np.tril_indices(len(matrix))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(to, pa.int32()), pa.array(matrix[at, to])], ["a", "b", "v"])

    usable = rows.where(F.col(weight_col).isNotNull() & F.col(jacobian).isNotNull() & ~F.exists(jacobian, lambda x: x.isNull()))
    each = usable.select(F.col(weight_col).cast("double"), F.col(jacobian).cast("array<double>"))
    return each.mapInArrow(partial, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("value"))


def merge_readings(parts: DataFrame) -> DataFrame:
    """(reading_id, g, variance): sensitivities of a reading summed over all parts before any squaring.

    ``g`` is a list by knob, or a list of (knob, value) where few of many knobs count; the result is of the same kind, the
    pairs in order of knobs. One shuffle by reading, and as many rows as there are values: no aggregate per knob.
    """
    sparse = isinstance(parts.schema["g"].dataType.elementType, T.StructType)
    dealt = parts.repartition("reading_id")
    each = dealt.select("reading_id", "variance", F.inline_outer("g").alias("knob", "value") if sparse else F.posexplode_outer("g").alias("knob", "value"))
    sums = each.groupBy("reading_id", "knob").agg(F.sum("value").alias("value"), F.max("variance").alias("variance"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("knob").isNotNull(), F.struct("knob", "value"))))
    merged = sums.groupBy("reading_id").agg(pairs.alias("g"), F.max("variance").alias("variance"))
    return merged if sparse else merged.withColumn("g", F.transform("g", lambda p: p["value"]))


def outer_blocks(readings: DataFrame, weight_col: str, block: int = 256, held: int = 64) -> DataFrame:
    """(a, b, value), a >= b: the weighted sum of outer products of sparse rows ``g`` of (knob, value), zeros left out.

    A task adds up blocks of ``block`` by ``block`` knobs, only those that occur, and hands its blocks on when it has
    ``held`` of them; so it needs memory for so many blocks, whatever the number of knobs.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def handed() -> pa.RecordBatch:
            out = [(x * block + i, y * block + j, v[i, j]) for (x, y), v in sums.items() for i, j in zip(*np.nonzero(v), strict=True)]
            a, b, value = zip(*out, strict=True) if out else ([], [], [])
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.float64())], ["a", "b", "v"])

        for batch in batches:
            lists, weights = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            knob, value = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(float)
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            of, at = np.divmod(knob, block)
            members = {x: np.flatnonzero(of == x) for x in np.unique(of)}
            for x, in_x in members.items():
                for y, in_y in members.items():
                    shared = np.intersect1d(row[in_x], row[in_y]) if y <= x else []
                    if not len(shared):
                        continue
                    left, right = np.zeros((len(shared), block)), np.zeros((len(shared), block))
                    for dense, own in ((left, in_x), (right, in_y)):
                        own = own[np.isin(row[own], shared)]
                        np.add.at(dense, (np.searchsorted(shared, row[own]), at[own]), value[own])
                    product = (left * weights[shared, None]).T @ right
                    sums[x, y] = sums.get((x, y), 0.0) + (np.tril(product) if x == y else product)
                    if len(sums) >= held:
                        yield handed()
        yield handed()

    usable = rows_with(readings, weight_col)
    each = usable.select(F.col(weight_col).cast("double"), F.col("g").cast("array<struct<knob: long, value: double>>"))
    return each.mapInArrow(partial, "a long, b long, v double").groupBy("a", "b").agg(F.sum("v").alias("value"))


def rows_with(rows: DataFrame, weight_col: str) -> DataFrame:
    """Rows with a weight other than 0, whose sensitivities are all there."""
    whole = F.col("g").isNotNull() & ~F.exists("g", lambda p: p.isNull() | p["knob"].isNull() | p["value"].isNull())
    return rows.where(F.col(weight_col).isNotNull() & (F.col(weight_col) != 0) & whole)


def noise_matrix(readings: DataFrame) -> DataFrame:
    """(a, b, value): the sum of variance times the outer product of merged sensitivities; unusable variances count 0."""
    v = F.col("variance")
    usable = F.when(present(v) & (v < INFINITE), v).otherwise(0.0)
    return normal_matrix(readings.withColumn("w", usable), "g", "w")


def reduce_replies(replies: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Sums over replies with a loss that is not NaN, how many those are, and whether any beam was lost.

    A null loss is a disabled worker and leaves the sums without a trace; an infinite
    one is a worker's failure and an error.
    """
    loss = F.col("loss")
    checked = F.when(loss == INFINITE, F.raise_error(F.lit("a worker failed")).cast("double")).otherwise(loss)
    rows = replies.withColumn("loss", checked)
    good = present(F.col("loss"))
    sums = [F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0.0)).alias(c) for c in values]
    lost = F.coalesce(F.bool_or(F.isnan("loss")), F.lit(False))
    return rows.groupBy(*keys).agg(*sums, F.sum(good.cast("int")).cast("long").alias("n_valid"), lost.alias("lost"))


def exact_mean(digits: int) -> Callable[[str], Column]:
    """A mean of values rounded to so many digits, whose sum is exact in any order."""
    return lambda c: F.sum(F.col(c).cast(f"decimal(24,{digits})")).cast("double") / F.count(c)


def validation_loss(
    losses: DataFrame, keys: Sequence[str] = (), means: tuple[Callable[[str], Column], Callable[[str], Column]] = (F.avg, F.avg)
) -> DataFrame:
    """Mean over batches per worker, then the plain mean over enabled workers; null if none is."""
    per_worker = losses.where("enabled").groupBy(*keys, "worker_id").agg(means[0]("loss").alias("loss"))
    return per_worker.groupBy(*keys).agg(means[1]("loss").alias("loss"))


def gains(rows: DataFrame, keys: Sequence[str], model: Column, measured: Column, ridge: float, batches: int = 1) -> DataFrame:
    """Closed-form gain of each key: sum w m (y - m) over sum w m^2 + ridge / batches, 0 without curvature."""
    w = F.col("weight")
    sums = rows.groupBy(*keys).agg(F.sum(w * model * (measured - model)).alias("num"), F.sum(w * model * model).alias("curv"))
    total = F.col("curv") + ridge / batches
    return sums.withColumn("gain", F.when((F.col("curv") > 0) & (total > 0), F.col("num") / total).otherwise(0.0))


def calibration_blocks(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(block, a, b, value) of a fit with knobs (``jac``) and one gain per key (``gain_id``, model value ``m``).

    Blocks ``uu`` (knobs by knobs), ``ub`` (knob by gain), ``bb`` (diagonal), ``gu`` and
    ``gb`` (gradients of half the weighted squared residual ``r``).
    """
    w, m, r = F.col("weight"), F.col("m"), F.col("r")
    label = F.concat_ws(".", *keys)
    base = rows.withColumn("gain_id", label)
    uu = normal_matrix(base, "jac").select(F.lit("uu").alias("block"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "value")
    knobs = base.select("gain_id", w.alias("w"), m.alias("m"), r.alias("r"), F.posexplode("jac").alias("k", "j"))
    ub = knobs.groupBy("k", "gain_id").agg(F.sum(F.col("w") * F.col("j") * F.col("m")).alias("value"))
    gu = knobs.groupBy("k").agg(F.sum(F.col("w") * F.col("j") * F.col("r")).alias("value"))
    own = base.groupBy("gain_id").agg(F.sum(w * m * m).alias("bb"), F.sum(w * m * r).alias("gb"))
    none = F.lit("")
    return (
        uu.unionAll(ub.select(F.lit("ub"), F.col("k").cast("string"), "gain_id", "value"))
        .unionAll(gu.select(F.lit("gu"), F.col("k").cast("string"), none, "value"))
        .unionAll(own.select(F.lit("bb"), "gain_id", "gain_id", "bb"))
        .unionAll(own.select(F.lit("gb"), "gain_id", none, "gb"))
    )
