"""From raw readings to weighted, complete grids of turns and monitors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbitweave.functions.missing import INFINITE, absent_to_null, present
from orbitweave.functions.ring import distance


def rebase_turns(rows: DataFrame) -> DataFrame:
    """Adds ``global_turn``: each file's turns from 0, files one after another without gaps.

    One row per file decides; the join spreads it, so readings are shuffled at most
    once, and not at all while the files fit a broadcast.
    """
    spans = rows.groupBy("file_idx").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    before = W.orderBy("file_idx").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    length = F.col("last") - F.col("first") + 1
    offsets = spans.select("file_idx", "first", F.coalesce(F.sum(length).over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "file_idx").withColumn("global_turn", F.col("turn") - F.col("first") + F.col("offset")).drop("first", "offset")


def assign_variances(rows: DataFrame, noise: DataFrame, bad: Sequence[str] = ()) -> DataFrame:
    """Adds ``variance`` by upper-cased name; std 0 and bad monitors get infinity; an unknown name is an error."""
    name = F.upper("name")
    table = noise.select(F.upper("name").alias("key"), F.col("std").cast("double").alias("std"), F.lit(True).alias("known"))
    found = rows.join(table, name == F.col("key"), "left")
    infinite = (F.col("std") == 0) | name.isin([b.upper() for b in bad])
    variance = F.when(infinite, INFINITE).otherwise(F.col("std") * F.col("std"))
    checked = F.when(F.col("known"), variance).otherwise(F.raise_error(F.concat(F.lit("no noise for monitor "), name)))
    return found.withColumn("variance", checked).drop("key", "std", "known")


def blank_variances(rows: DataFrame, patterns: Sequence[str], name: str = "name", variance: str = "variance") -> DataFrame:
    """Variances become NaN where any pattern is found in the name, whatever the case."""
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    return rows.withColumn(variance, F.when(F.col(name).rlike(pattern), float("nan")).otherwise(F.col(variance)))


def trim_to_kick(rows: DataFrame, kicks: DataFrame) -> DataFrame:
    """From each file's kick on, turns from 1.

    ``kicks`` has (file_idx, kick_turn, kick_pos). On the kick's turn the monitors
    before it are dropped; a file without a kick is kept whole.
    """
    found = rows.join(kicks, "file_idx", "left")
    after = (F.col("turn") > F.col("kick_turn")) | ((F.col("turn") == F.col("kick_turn")) & (F.col("ring_pos") >= F.col("kick_pos")))
    kept = found.where(F.col("kick_turn").isNull() | after)
    return kept.withColumn("trimmed_turn", F.col("turn") - F.coalesce("kick_turn", F.lit(1)) + 1).drop("kick_turn", "kick_pos")


def complete_grid(rows: DataFrame, markers: Sequence[str], values: Sequence[str], keys: Sequence[str] = ("file_idx", "turn")) -> DataFrame:
    """Every marker in every turn: an absent coordinate becomes 0 with infinite variance.

    ``values`` are coordinates; the variance of ``x`` is ``var_x``. A present coordinate
    keeps its own variance, even a null one. One shuffle by turn: a turn's readings are
    a map of at most as many entries as there are markers, and markers are looked up in it.
    A marker that a turn has twice is an error that names both.
    """
    cell = F.struct(*[c for v in values for c in (v, f"var_{v}")])
    turns = rows.groupBy(*keys).agg(F.collect_list(F.struct("name", cell.alias("cell"))).alias("cells"))
    names = F.transform("cells", lambda c: c["name"])
    twice = F.concat_ws(" ", F.lit("a reading is there twice:"), *(F.col(k).cast("string") for k in keys), F.array_join(names, " "))
    checked = F.when(F.size("cells") == F.size(F.array_distinct(names)), F.col("cells")).otherwise(F.raise_error(twice))
    turns = turns.select(*keys, F.map_from_entries(checked).alias("cells"))
    grid = turns.select(*keys, "cells", F.posexplode(F.array(*map(F.lit, markers))).alias("col", "name"))
    grid = grid.withColumn("cell", F.try_element_at("cells", F.col("name")))
    columns: list[Column] = [F.col(k) for k in keys] + [F.col("name"), F.col("col")]
    for v in values:
        here = present(F.col(f"cell.{v}")) & F.col("cell").isNotNull()
        columns.append(F.when(here, F.col(f"cell.{v}")).otherwise(0.0).alias(v))
        columns.append(F.when(here, F.col(f"cell.var_{v}")).otherwise(INFINITE).alias(f"var_{v}"))
    return grid.select(*columns)


def merge_updates(rows: DataFrame, updates: DataFrame, values: Sequence[str], order: str) -> DataFrame:
    """Values of ``updates`` (name, turn, values, ``order``) over those of ``rows``.

    Names match in any case; of several updates the last by ``order`` counts; an absent
    value overwrites nothing; an update without a row is ignored.
    """
    last = updates.groupBy(F.upper("name").alias("key"), "turn").agg(
        F.max_by(F.struct(*values), F.col(order)).alias("new")
    )
    joined = rows.withColumn("key", F.upper("name")).join(last, ["key", "turn"], "left")
    for v in values:
        joined = joined.withColumn(v, F.coalesce(absent_to_null(F.col(f"new.{v}")), F.col(v)))
    return joined.drop("key", "new")


def kick_planes(rows: DataFrame, ratio: float = 10.0, least: float = 1e-12) -> DataFrame:
    """(file_idx, plane) from the spans of x, px and of y, py over present readings.

    ``xy`` unless one plane moves by less than ``least`` or by ``ratio`` times less than
    the other.
    """
    def span(c: str) -> Column:
        v = absent_to_null(F.col(c))
        return F.coalesce(F.max(v) - F.min(v), F.lit(0.0))

    spans = rows.groupBy("file_idx").agg(
        F.greatest(span("x"), span("px")).alias("sx"), F.greatest(span("y"), span("py")).alias("sy")
    )
    only_x = (F.col("sx") > least) & ((F.col("sy") <= least) | (F.col("sx") >= ratio * F.col("sy")))
    only_y = (F.col("sy") > least) & ((F.col("sx") <= least) | (F.col("sy") >= ratio * F.col("sx")))
    return spans.select("file_idx", F.when(only_x, "x").when(only_y, "y").otherwise("xy").alias("plane"))


def marker_order(rows: DataFrame, ring: DataFrame, size: int) -> DataFrame:
    """(file_idx, name, col): each file's monitors in ring order from the one it recorded first.

    ``rows`` needs ``row_index``, the order of the file; names off the ring come first,
    as they appeared. One row per file and name is ordered, never the readings.
    """
    first = rows.groupBy("file_idx", "name").agg(F.min("row_index").alias("seen"))
    placed = first.join(ring, "name", "left")
    file = W.partitionBy("file_idx")
    pivot = F.min_by("ring_pos", F.when(F.col("ring_pos").isNotNull(), F.col("seen"))).over(file)
    placed = placed.withColumn("step", distance(F.col("ring_pos"), pivot, size))
    order = W.partitionBy("file_idx").orderBy(F.col("step").isNotNull(), F.coalesce("step", "seen"), "seen")
    return placed.select("file_idx", "name", (F.row_number().over(order) - 1).alias("col"))


def append_markers(rows: DataFrame, others: DataFrame, suffixes: Sequence[str] = ("_before", "_after")) -> DataFrame:
    """``rows`` and those of ``others`` whose name ends in a suffix, in any case; columns as in ``rows``."""
    name = F.lower("name")
    chosen = others.where(F.greatest(*[name.endswith(s) for s in suffixes]))
    shared = [c for c in rows.columns if c in chosen.columns]
    return rows.unionByName(chosen.select(*shared), allowMissingColumns=True)


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by ``order``, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("r")))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.r.*")


def last_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key by ``order``, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("r")))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.r.*")
