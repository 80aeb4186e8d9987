"""Outlying monitors and workers: found on training data, carried over to validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbitweave.functions.missing import INFINITE, present


def positive_z(value: str, stats: DataFrame | None = None, over: Column | None = None) -> Column:
    """Standard deviations above the mean, not below 0; from columns mean, sd, n of the finite values."""
    finite = present(F.col(value)) & (F.abs(value) < INFINITE)
    usable = finite & (F.col("n") >= 2) & (F.col("sd") > 0)
    return F.when(usable, F.greatest((F.col(value) - F.col("mean")) / F.col("sd"), F.lit(0.0))).otherwise(0.0)


def with_z(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``z``: ``positive_z`` within the rows of each key, from statistics that are combined before the shuffle."""
    finite = F.when(present(F.col(value)) & (F.abs(value) < INFINITE), F.col(value))
    stats = rows.groupBy(*keys).agg(F.avg(finite).alias("mean"), F.stddev_pop(finite).alias("sd"), F.count(finite).alias("n"))
    joined = rows.join(stats, list(keys)) if keys else rows.join(F.broadcast(stats))  # one row
    return joined.withColumn("z", positive_z(value)).drop("mean", "sd", "n")


def carry_over(training: DataFrame, validation: DataFrame, exact: Sequence[str], fallback: Sequence[str]) -> DataFrame:
    """Validation workers with ``dropped`` monitors, ``disabled`` and ``matched``.

    ``training`` has the keys, ``dropped`` (array) and ``disabled``. A key's dropped set
    is the union over its enabled workers, and it is disabled if all its workers are.
    Workers take the outcome of their exact key, else of the fallback key, else nothing.
    """
    def outcome(keys: Sequence[str], tag: str) -> DataFrame:
        names = F.when(~F.col("disabled"), F.col("dropped")).otherwise(F.array().cast("array<string>"))
        each = F.array_sort(F.array_distinct(F.flatten(F.collect_set(names))))  # monitors of a machine
        return training.groupBy(*keys).agg(each.alias(f"{tag}_dropped"), F.bool_and("disabled").alias(f"{tag}_disabled"))

    found = validation.join(outcome(exact, "e"), list(exact), "left").join(outcome(fallback, "f"), list(fallback), "left")
    none = F.array().cast("array<string>")
    matched = F.when(F.col("e_disabled").isNotNull(), "exact").when(F.col("f_disabled").isNotNull(), "fallback").otherwise("none")
    return found.select(
        *validation.columns,
        F.coalesce("e_dropped", "f_dropped", none).alias("dropped"),
        F.coalesce("e_disabled", "f_disabled", F.lit(False)).alias("disabled"),
        matched.alias("matched"),
    )


def screening_totals(diagnostics: DataFrame) -> DataFrame:
    """Loss before and after masking, means per worker and the reduction in per cent."""
    before = F.sum(F.when(present(F.col("loss")), F.col("loss")).otherwise(0.0))
    after = F.sum(F.when(present(F.col("loss")) & F.col("keep"), F.col("loss")).otherwise(0.0))
    workers = F.countDistinct("worker_id")
    out = diagnostics.agg(before.alias("before"), after.alias("after"), workers.alias("n_workers"))
    return out.select(
        "before", "after", "n_workers",
        F.try_divide("before", "n_workers").alias("mean_before"),
        F.try_divide("after", "n_workers").alias("mean_after"),
        (100.0 * F.try_divide(F.col("before") - F.col("after"), F.col("before"))).alias("reduction"),
    )
