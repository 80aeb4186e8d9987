"""Histories of fits: best points, moving averages, changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_steps(history: DataFrame, loss: str = "loss", validation: str | None = None) -> DataFrame:
    """(run_id, step, loss): the earliest step of the lowest loss, of the validation loss where there is one."""
    value = F.coalesce(validation, loss) if validation else F.col(loss)
    rows = history.where(value.isNotNull() & ~F.isnan(value))
    best = F.min(F.struct(value.cast("double").alias("loss"), F.col("step").alias("step")))
    return rows.groupBy("run_id").agg(best.alias("b")).select("run_id", "b.step", "b.loss")


def running_best(history: DataFrame, loss: str = "loss") -> DataFrame:
    """Adds ``best`` (lowest so far) and ``new_best`` (lower than all before)."""
    order = W.partitionBy("run_id").orderBy("step")
    before = F.min(loss).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = history.withColumn("before", before)
    return rows.select(
        *history.columns, F.least("before", loss).alias("best"), (F.col("before").isNull() | (F.col(loss) < F.col("before"))).alias("new_best")
    )


def smoothed(history: DataFrame, alpha: float = 0.2, loss: str = "loss") -> DataFrame:
    """(run_id, ema): the moving average after all steps; ``alpha`` weighs the old average, which restarts when 0."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("step", F.col(loss).cast("double").alias("v")))), lambda s: s["v"])
    fold = F.aggregate("steps", F.lit(0.0), lambda a, v: F.when(a == 0.0, v).otherwise(alpha * a + (1 - alpha) * v))
    return history.groupBy("run_id").agg(steps.alias("steps")).select("run_id", fold.alias("ema"))


def relative_change(history: DataFrame, loss: str = "loss") -> DataFrame:
    """Adds ``change``: loss against the step before, relative to it; 0 after a loss of 0, null on the first step."""
    last = F.lag(loss).over(W.partitionBy("run_id").orderBy("step"))
    rows = history.withColumn("last", last)
    change = F.when(F.col("last") == 0, 0.0).otherwise((F.col(loss) - F.col("last")) / F.col("last"))
    return rows.withColumn("change", change).drop("last")


def change_from_start(values: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Adds ``moved`` (since the row before) and ``drift`` (since the first row)."""
    w = W.partitionBy(*keys).orderBy(order)
    return values.withColumn("moved", F.col(value) - F.lag(value).over(w)).withColumn("drift", F.col(value) - F.first(value).over(w))


def top_movers(values: DataFrame, change: Column, tie: str, n: int = 12) -> DataFrame:
    """The ``n`` rows of the largest absolute change, ties to the smaller ``tie``."""
    return values.withColumn("change", change).orderBy(F.desc(F.abs("change")), tie).limit(n)


def pivot_turns(rows: DataFrame, key: str, turn: str, turns: Sequence[int], value: str) -> DataFrame:
    """One row per key with a column per turn; a gap or a repeated reading is an error."""
    cells = rows.where(F.col(turn).isin(list(turns))).groupBy(key).pivot(turn, list(turns)).agg(
        F.count(turn).alias("n"), F.first(value).alias("v")
    )
    columns = []
    for t in turns:
        bad = F.raise_error(F.concat(F.lit(f"turn {t} of "), F.col(key).cast("string"))).cast("double")
        columns.append(F.when(F.coalesce(F.col(f"{t}_n"), F.lit(0)) == 1, F.col(f"{t}_v")).otherwise(bad).alias(f"t{t}"))
    return cells.select(key, *columns)
