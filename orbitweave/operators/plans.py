"""Tracking plans: which points serve in which file, ranges between them, batches and workers.

Points, ranges and batches are a few rows per file; readings are only counted. What a
file lacks it gets from the model's list of names, so a monitor without any reading is
there as one that is not good.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbitweave.functions.ring import distance


def observed_points(rows: DataFrame, names: Sequence[str], percent: int, reading: str = "x") -> DataFrame:
    """(file_idx, name, n_turns, n, good) for every name in every file; good ones have readings in ``percent`` of its turns."""
    files = rows.groupBy("file_idx").agg(F.count_distinct("turn").alias("n_turns"))
    every = files.select("file_idx", "n_turns", F.explode(F.array(*map(F.lit, names))).alias("name"))
    counts = rows.groupBy("file_idx", "name").agg(F.count(reading).alias("n"))
    found = every.join(counts, ["file_idx", "name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.withColumn("good", 100 * F.col("n") >= percent * F.col("n_turns"))


def turn_summary(rows: DataFrame, reading: str) -> DataFrame:
    """(file_idx, bunch, turn, seen): a row per turn with the names of its monitors, repeated ones too, whose ``reading`` is not null."""
    seen = F.collect_list(F.when(F.col(reading).isNotNull(), F.col("name")))
    return rows.groupBy("file_idx", "bunch", "turn").agg(seen.alias("seen"))


def summary_points(summary: DataFrame, names: Sequence[str], percent: int) -> DataFrame:
    """What ``observed_points`` gives, from ``turn_summary``: turns are added up per file before anything is shuffled."""
    files = summary.groupBy("file_idx").agg(F.count_distinct("turn").alias("n_turns"))
    every = files.select("file_idx", "n_turns", F.explode(F.array(*map(F.lit, names))).alias("name"))
    counts = summary.select("file_idx", F.explode("seen").alias("name")).groupBy("file_idx", "name").agg(F.count("*").alias("n"))
    found = every.join(counts, ["file_idx", "name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.withColumn("good", 100 * F.col("n") >= percent * F.col("n_turns"))


def resolve_window(points: DataFrame, window: str) -> DataFrame:
    """(file_idx, start, end): the window's two points (``start/end``), each replaced by the file's first point in the ring if it has none."""
    first = F.min_by("name", "ring_pos")
    ends = [F.coalesce(F.max(F.when(F.col("name") == n, F.col("name"))), first) for n in window.split("/", 1)]
    return points.groupBy("file_idx").agg(ends[0].alias("start"), ends[1].alias("end"))


def file_ranges(points: DataFrame, starts: Sequence[str], ends: Sequence[str]) -> DataFrame:
    """(file_idx, start, end, sp, ep): a file's starts with its other ends; ``points`` (file_idx, name, ring_pos)."""
    start = points.where(F.col("name").isin(list(starts))).select("file_idx", F.col("name").alias("start"), F.col("ring_pos").alias("sp"))
    end = points.where(F.col("name").isin(list(ends))).select("file_idx", F.col("name").alias("end"), F.col("ring_pos").alias("ep"))
    return start.join(end, "file_idx").where("start <> end")


def with_point_counts(ranges: DataFrame, points: DataFrame, size: int) -> DataFrame:
    """Adds ``n_points``, the ring's monitors from start to end, and ``n_observed``, those of them among ``points``."""
    steps = ranges.withColumn("n_points", distance(F.col("ep"), F.col("sp"), size) + 1)
    each = steps.withColumn("ring_pos", F.explode(F.transform(F.sequence(F.lit(0), F.col("n_points") - 1), lambda k: F.pmod(F.col("sp") + k, F.lit(size)))))
    seen = each.join(points.select("file_idx", "ring_pos", F.lit(1).alias("seen")), ["file_idx", "ring_pos"], "left")
    return seen.groupBy(*steps.columns).agg(F.count("seen").alias("n_observed"))


def batch_spans(turns: DataFrame, batches: int) -> DataFrame:
    """(file_idx, batch, n_turns, first_turn): a file's turns in contiguous batches, no more of them than turns."""
    order = W.partitionBy("file_idx").orderBy("turn")
    dealt = turns.select("file_idx", "turn").distinct().withColumn("batch", F.ntile(batches).over(order))
    return dealt.groupBy("file_idx", "batch").agg(F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"))


def whole_ring(points: DataFrame, starts: DataFrame, size: int) -> DataFrame:
    """(file_idx, start, name, point, end): all points of a file from its start round the ring; the end is the one behind the start."""
    at = points.select("file_idx", F.col("name").alias("start"), F.col("ring_pos").alias("sp"))
    rows = points.join(starts.select("file_idx", "start").join(at, ["file_idx", "start"]), "file_idx")
    rows = rows.withColumn("away", distance(F.col("ring_pos"), F.col("sp"), size))
    ring = W.partitionBy("file_idx", "start")
    point = F.row_number().over(ring.orderBy("away")) - 1
    return rows.select("file_idx", "start", "name", point.alias("point"), F.max_by("name", "away").over(ring).alias("end"))


def from_markers(points: DataFrame, ring: DataFrame, forward: str, backward: str, size: int) -> DataFrame:
    """(file_idx, sdir, start, name, point, ...): a file's points forward from one marker and backward from the other, without the markers."""
    marks = ring.where(F.col("name").isin(forward, backward)).select(F.col("name").alias("start"), F.col("ring_pos").alias("sp"))
    marks = marks.withColumn("sdir", F.when(F.col("start") == forward, 1).otherwise(-1))
    rows = points.where(~F.col("name").isin(forward, backward)).withColumn("start", F.explode(F.array(F.lit(forward), F.lit(backward))))
    rows = rows.join(marks, "start")
    away = F.when(F.col("sdir") > 0, distance(F.col("ring_pos"), F.col("sp"), size)).otherwise(distance(F.col("sp"), F.col("ring_pos"), size))
    point = F.row_number().over(W.partitionBy("file_idx", "sdir").orderBy(away)) - 1
    return rows.withColumn("point", point).drop("sp")


def worker_counts(specs: DataFrame, workers: int) -> DataFrame:
    """Adds ``n_workers`` to (file_idx, n_specs, n_turns): all workers over the file's ranges, at least one, at most one a turn."""
    share = F.greatest(F.lit(1), F.expr(f"{workers} div greatest(n_specs, 1)"))
    return specs.withColumn("n_workers", F.least("n_turns", share).cast("long"))


def clamp_batches(sizes: DataFrame, wanted: int) -> DataFrame:
    """Adds ``n_batches``, at most the smallest file's turns, and ``n_validation``, the largest divisor of ``n_turns`` up to that."""
    least = sizes.agg(F.greatest(F.lit(1), F.least(F.lit(wanted), F.min("n_turns"))).cast("int").alias("n_batches"))  # one row
    rows = sizes.join(F.broadcast(least))
    divisors = F.filter(F.sequence(F.lit(1), F.col("n_batches")), lambda d: F.col("n_turns") % d == 0)
    return rows.withColumn("n_validation", F.array_max(divisors))


def contiguous(order: DataFrame, keys: Sequence[str], position: Column) -> DataFrame:
    """(keys, n_targets, contiguous, first, last) of names in the order of a position; contiguous if no position is left out."""
    named = order.withColumn("at", position)
    return named.groupBy(*keys).agg(
        F.count("*").alias("n_targets"), (F.max("at") - F.min("at") + 1 == F.count("*")).alias("contiguous"),
        F.min_by("name", "at").alias("first"), F.max_by("name", "at").alias("last"),
    )


def bunch_turns(rows: DataFrame, row: str) -> DataFrame:
    """(file_idx, bunch, turns): each turn's bunch is its first row's, and a bunch's turns are in order."""
    of = rows.groupBy("file_idx", "turn").agg(F.min_by("bunch", row).alias("bunch"))
    return of.groupBy("file_idx", "bunch").agg(F.array_sort(F.collect_list("turn")).alias("turns"))


def turn_blocks(rows: DataFrame) -> DataFrame:
    """(file_idx, first_turn, last_turn, block_start, block_end): files' turns one after another on one axis, without overlap."""
    spans = rows.groupBy("file_idx").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    before = W.orderBy("file_idx").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    size = F.col("last_turn") - F.col("first_turn") + 1
    placed = spans.withColumn("block_start", F.coalesce(F.sum(size).over(before), F.lit(0)))
    return placed.withColumn("block_end", F.col("block_start") + size)


def content_hash(rows: DataFrame, keys: Sequence[str], name: Column, value: Column) -> DataFrame:
    """(keys, content): sha256 of a group's sorted ``name=value`` lines, the same for equal contents."""
    lines = F.array_sort(F.collect_list(F.concat(name, F.lit("="), value)))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("content"))
