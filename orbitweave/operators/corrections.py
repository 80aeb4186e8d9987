"""Smaller corrections of readings, states and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbitweave.functions.missing import INFINITE, present, usable_variance


def scale_cleaned_variances(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Position variances after cleaning by singular values: times kept rank over monitors, per plane.

    ``ranks`` has at most one row (rank_x, rank_y, n_monitors); a plane without a rank stays.
    """
    joined = rows.join(F.broadcast(ranks.limit(1)), how="left")  # one row
    out = joined
    for plane in ("x", "y"):
        scale = F.coalesce(F.col(f"rank_{plane}") / F.col("n_monitors"), F.lit(1.0))
        out = out.withColumn(f"var_{plane}", F.col(f"var_{plane}") * scale)
    return out.select(*rows.columns)


def pt_from_deltap(deltap: Column, beta: Column) -> Column:
    """Relative energy offset of a relative momentum offset for a beam of relative speed ``beta``; 1 where it is absent.

    From E = sqrt(p^2 + m^2): pt = (sqrt((1 + d)^2 beta^2 + 1 - beta^2) - 1) / beta.
    """
    b = F.coalesce(F.when(present(beta) & (beta > 0), beta), F.lit(1.0))
    return (F.sqrt((1 + deltap) * (1 + deltap) * b * b + 1 - b * b) - 1) / b


def beta_of(energy: Column, mass: Column) -> Column:
    """Relative speed from total energy and mass; null where the energy is not above the mass."""
    return F.when(energy > mass, F.sqrt(1 - (mass / energy) * (mass / energy)))


def add_noise(rows: DataFrame, value: str, variance: str, seed: int) -> DataFrame:
    """Gaussian noise of each reading's variance; readings without a usable variance stay."""
    noise = F.randn(seed) * F.sqrt(F.when(usable_variance(F.col(variance)), F.col(variance)).otherwise(0.0))
    return rows.withColumn(value, F.col(value) + noise)


def drop_absent_momenta(rows: DataFrame) -> DataFrame:
    """Rows whose px and py are present."""
    return rows.where(present(F.col("px")) & present(F.col("py")))


def shared_positions(members: DataFrame) -> DataFrame:
    """(knob, s): the mean position of a knob's members."""
    return members.groupBy("knob").agg(F.avg("s").alias("s"))


def distance_to_truth(values: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, distance): sum of absolute differences over knobs with a true value, or of the values if none has one."""
    joined = values.join(truth.select("knob", F.col("value").alias("true")), "knob", "left")
    known = F.count("true")
    return joined.groupBy(*keys).agg(
        F.when(known > 0, F.sum(F.abs(F.col("value") - F.col("true")))).otherwise(F.sum("value")).alias("distance")
    )


def realign_turns(rows: DataFrame, marker: str) -> DataFrame:
    """Turns counted from ``marker``: readings before it in their turn belong to the turn before.

    ``rows`` has file_idx, turn, name and ``point``, the order within a turn.
    """
    order = W.partitionBy("file_idx", "turn").orderBy("point")
    passed = F.max((F.col("name") == marker).cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("passed", passed).withColumn("turn", F.col("turn") - 1 + F.col("passed")).drop("passed")


def cycle_target(cycle: Column, init: Column, start: Column, end: Column, sdir: Column) -> Column:
    """Where a ring is opened: the cycle marker, else the start marker, else the range's first point in its direction."""
    return F.coalesce(cycle, init, F.when(sdir > 0, start).otherwise(end))


def dynamic_planes(planes: Column) -> Column:
    """``dynamic`` if both planes are, ``absolute`` if neither is; a mix or another name is an error."""
    both = F.forall(planes, lambda p: p == "dynamic")
    none = F.forall(planes, lambda p: p == "absolute")
    return F.when(both, "dynamic").when(none, "absolute").otherwise(F.raise_error(F.lit("planes are mixed or unknown")))


def corrected_kick(kick: Column, gain: Column, knob: Column) -> Column:
    """A corrector's kick under a fixed gain and a fitted one."""
    return kick * (1 + F.coalesce(gain, F.lit(0.0)) + F.coalesce(knob, F.lit(0.0)))


def gain_reading(position: Column, gain: Column) -> Column:
    """What a monitor with a gain error shows of a position."""
    return (1 + F.coalesce(gain, F.lit(0.0))) * position


def with_gains(rows: DataFrame, gains: DataFrame, keys: list[str], position: str, derivatives: str) -> DataFrame:
    """``rows`` with ``reading``, ``scaled`` and ``by_gain``: what a monitor shows, its derivatives by the knobs, and that by its own gain.

    ``gains`` has at most one row (keys, gain) each; a monitor without one has gain 0 and the derivative by it is null.
    """
    found = rows.join(gains.select(*keys, F.col("gain").alias("own_gain")), keys, "left")
    factor = 1 + F.coalesce("own_gain", F.lit(0.0))
    return found.select(
        *rows.columns, gain_reading(F.col(position), F.col("own_gain")).alias("reading"), F.transform(derivatives, lambda d: factor * d).alias("scaled"),
        F.when(F.col("own_gain").isNotNull(), F.col(position)).alias("by_gain"),
    )


def common_measurements(frames: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """The columns of all frames side by side for the keys that all of them have, each column with its frame's name before it."""
    out: DataFrame | None = None
    for label, frame in frames:
        named = frame.select(key, *(F.col(c).alias(f"{label}_{c}") for c in frame.columns if c != key))
        out = named if out is None else out.join(named, key)
    return out


def optics_measurement(rows: DataFrame, columns: dict[str, tuple[str, str]], observables: list[str]) -> DataFrame:
    """``rows`` with the value and error columns of the observables; a missing value column is an error that names all of them, a missing error is NaN."""
    if missing := sorted(columns[o][0] for o in observables if columns[o][0] not in rows.columns):
        raise ValueError(f"the measurement lacks {missing}")
    return rows.withColumns({columns[o][1]: F.lit(float("nan")) for o in observables if columns[o][1] not in rows.columns})


def unweighted_variance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``variance``: the mean square of the finite values of each key, 1 if that is not positive."""
    v = F.when(present(F.col("value")) & (F.abs("value") < INFINITE), F.col("value"))
    squares = rows.groupBy(*keys).agg(F.avg(v * v).alias("square"))
    return rows.join(squares, keys).withColumn("variance", F.when(F.col("square") > 0, F.col("square")).otherwise(1.0)).drop("square")


def measured_or_absent(rows: DataFrame, value: str, error: str) -> DataFrame:
    """``rows`` with an error column: as it is, or NaN throughout where the table has none."""
    if value not in rows.columns:
        raise ValueError(f"{value} was asked for and is not there")
    return rows if error in rows.columns else rows.withColumn(error, F.lit(float("nan")))
