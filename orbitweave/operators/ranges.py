"""Ranges of monitors on the ring, and readings gathered along them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbitweave.functions.ring import distance, in_range


def range_product(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """(start, end, sdir) for every start, every other end and both directions.

    Lists of range points are a few names; they are paired as arrays in one row.
    """
    lists = starts.agg(F.array_sort(F.collect_list("start")).alias("s")).join(ends.agg(F.array_sort(F.collect_list("end")).alias("e")))
    each = lists.select("e", F.explode("s").alias("start")).select("start", F.explode("e").alias("end"))
    both = each.select("start", "end", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sdir"))
    return both.where("start <> end")


def fixed_pairs(starts: DataFrame, ends: DataFrame, fixed_start: str, fixed_end: str) -> DataFrame:
    """Every start forward to the fixed end, and from the fixed start every end backward."""
    forward = starts.select("start", F.lit(fixed_end).alias("end"), F.lit(1).alias("sdir"))
    backward = ends.select(F.lit(fixed_start).alias("start"), "end", F.lit(-1).alias("sdir"))
    return forward.unionAll(backward).where("start <> end")


def range_points(ranges: DataFrame, ring: DataFrame, size: int) -> DataFrame:
    """(range columns, name, point): the monitors of each range in its order, from 0.

    Both tables are dimensions of a machine; the join is on positions, expanded from
    each range, so it stays an equi-join however many ranges there are.
    """
    start = ring.select(F.col("name").alias("start"), F.col("ring_pos").alias("sp"))
    end = ring.select(F.col("name").alias("end"), F.col("ring_pos").alias("ep"))
    placed = ranges.join(start, "start").join(end, "end")
    length = distance(F.col("ep"), F.col("sp"), size)
    steps = placed.withColumn("step", F.explode(F.sequence(F.lit(0), length)))
    point = F.when(F.col("sdir") > 0, F.col("step")).otherwise(length - F.col("step"))
    steps = steps.withColumn("ring_pos", F.pmod(F.col("sp") + F.col("step"), F.lit(size))).withColumn("point", point)
    return steps.join(ring, "ring_pos").drop("sp", "ep", "step")


def reroute(ranges: DataFrame, ring: DataFrame, before: str, after: str, keys: Sequence[str] = ()) -> DataFrame:
    """Ranges whose forward span holds both markers swap start and end; then each (keys, start, end, sdir) once."""
    names = ring.select("name", "ring_pos")
    marks = names.where(F.col("name").isin(before, after)).agg(
        F.max(F.when(F.col("name") == before, F.col("ring_pos"))).alias("bp"),
        F.max(F.when(F.col("name") == after, F.col("ring_pos"))).alias("ap"),
    )
    start = names.select(F.col("name").alias("start"), F.col("ring_pos").alias("sp"))
    end = names.select(F.col("name").alias("end"), F.col("ring_pos").alias("ep"))
    placed = ranges.join(start, "start").join(end, "end").join(F.broadcast(marks))  # one row
    crosses = in_range(F.col("bp"), F.col("sp"), F.col("ep")) & in_range(F.col("ap"), F.col("sp"), F.col("ep"))
    crosses = F.coalesce(crosses, F.lit(False))
    return placed.select(
        *keys,
        F.when(crosses, F.col("end")).otherwise(F.col("start")).alias("start"),
        F.when(crosses, F.col("start")).otherwise(F.col("end")).alias("end"),
        "sdir",
    ).distinct()


def turn_offsets(points: DataFrame) -> DataFrame:
    """Adds ``offset``: how many turns a range's point is after its start.

    Going forward a step to a smaller ``col`` enters the next turn; going backward a
    step to a larger one enters the turn before.
    """
    order = W.partitionBy("range_id").orderBy("point")
    last = F.lag("col").over(order)
    wraps = F.when(F.col("sdir") > 0, F.col("col") < last).otherwise(F.col("col") > last)
    marked = points.withColumn("wrap", F.coalesce(wraps.cast("int"), F.lit(0)))
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return marked.withColumn("offset", F.sum("wrap").over(so_far) * F.col("sdir")).drop("wrap")


def gather(starts: DataFrame, points: DataFrame, grid: DataFrame) -> DataFrame:
    """Readings of each start turn along its range.

    ``starts`` (file_idx, turn, range_id), ``points`` (range_id, point, name, offset),
    ``grid`` (file_idx, turn, name, ...). Points are few and expanded first, so that the
    one large join is on equal keys; a point without a reading stays, with nulls.
    """
    wanted = starts.withColumnRenamed("turn", "start_turn").join(points, "range_id")
    wanted = wanted.withColumn("turn", F.col("start_turn") + F.col("offset"))
    return wanted.join(grid, ["file_idx", "turn", "name"], "left")
