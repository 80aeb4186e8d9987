"""Rules of consistency, judged together in one pass as bits of one number.

A rule is a condition under which a row is wrong. A row's bits say which rules it breaks,
so that any number of rules costs one reading of the rows; violations are listed, or the
first ones raised as an error while the rows are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Mapping[str, Column]


def broken(rules: Rules) -> Column:
    """A number with bit i set where the i-th rule is broken; a condition that is null breaks nothing."""
    if len(rules) > 63:
        raise ValueError("63 rules at most")
    bits = [F.when(condition, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, condition in enumerate(rules.values())]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))


def violations(rows: DataFrame, keys: Sequence[str], rules: Rules) -> DataFrame:
    """(keys, rule): a row for each rule that a row of ``rows`` breaks."""
    names = F.array(*(F.when(F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(n)) for i, n in enumerate(rules)))
    marked = rows.select(*keys, broken(rules).alias("bits")).where("bits <> 0")
    return marked.select(*keys, F.explode(F.array_compact(names)).alias("rule"))


def checked(rows: DataFrame, keys: Sequence[str], rules: Rules) -> DataFrame:
    """``rows``, with an error that names the keys and all broken rules when a wrong one is read."""
    # A name that is no column of the rows, whatever they have.
    bits = "broken_rules"
    while bits in rows.columns:
        bits += "_"
    marked = rows.withColumn(bits, broken(rules))
    names = F.array_compact(F.array(*(F.when(F.col(bits).bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(n)) for i, n in enumerate(rules))))
    told = F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys), F.lit("breaks"), F.concat_ws(", ", names))
    return marked.where((F.col(bits) == 0) | F.raise_error(told).cast("boolean")).drop(bits)


def series_rules(supported: Sequence[str], phases: Sequence[str], orbits: Sequence[str]) -> dict[str, Column]:
    """Rules for rows of ``series_of``: what a closed-orbit series must satisfy."""
    names, absolute = F.col("observables"), F.col("absolute")
    literal = lambda values: F.array(*map(F.lit, values))
    only_phases = (F.size("observables") > 0) & (F.size(F.array_except(names, literal(phases))) == 0)
    relative = F.size(F.array_except(names, absolute)) > 0
    return {
        "no observable": F.size("observables") == 0,
        "unsupported observable": F.size(F.array_except(names, literal(supported))) > 0,
        "orbit and phase mixed": F.arrays_overlap(names, literal(phases)) & F.arrays_overlap(names, literal(orbits)),
        "observable twice": F.size(F.array_distinct(names)) < F.size(names),
        "observables differ": F.col("orders") > 1,
        "several phase measurements": only_phases & (F.col("measurements") > 1),
        "unknown absolute plane": ~only_phases & (F.size(F.array_except(absolute, names)) > 0),
        "nothing changes": ~only_phases & F.col("same_state") & ~F.col("momentum_changes") & relative & (F.size("absolute") == 0),
    }


def compatibility_rules(gradient_sensitive: Sequence[str]) -> dict[str, Column]:
    """Rules for rows of ``series_of`` with ``fits_gradients``: gradients are fitted only with observables that respond to them."""
    sensitive = F.arrays_overlap(F.col("observables"), F.array(*map(F.lit, gradient_sensitive)))
    return {"gradients without a sensitive observable": F.col("fits_gradients") & ~sensitive, "negative prior": F.col("prior") < 0}


def series_of(measurements: DataFrame, series: str, order: str) -> DataFrame:
    """A row per series for its rules, from rows (series, order, observables, absolute, state, reference_state, pt, reference_pt).

    ``observables`` and ``absolute`` are the first measurement's, ``orders`` the number of different lists of observables; one
    shuffle of sums that are combined before it. A null list counts as empty, states that are both null as the same.
    """
    whole = measurements.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("observables", "absolute")})
    first = F.min_by(F.struct(F.col("observables").alias("o"), F.col("absolute").alias("a"), "state", "reference_state"), order)
    low, high = F.min("observables"), F.max("observables")
    out = whole.groupBy(series).agg(
        first.alias("f"), F.count("*").alias("measurements"), F.when(low == high, 1).otherwise(2).alias("orders"),
        F.coalesce(F.bool_or(~F.col("pt").eqNullSafe(F.col("reference_pt"))), F.lit(False)).alias("momentum_changes"),
    )
    return out.select(
        series, F.col("f.o").alias("observables"), F.array_distinct("f.a").alias("absolute"), "measurements", "orders", "momentum_changes",
        F.col("f.state").eqNullSafe(F.col("f.reference_state")).alias("same_state"),
    )
