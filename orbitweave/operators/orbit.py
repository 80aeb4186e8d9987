"""Closed orbits and optics: differences, phase advances, means, alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbitweave.functions.missing import absent_to_null
from orbitweave.functions.ring import fractional


def difference_orbit(signal: DataFrame, reference: DataFrame, value: str, error: str, key: str = "name") -> DataFrame:
    """Signal minus reference, errors in quadrature; a name without reference is an error."""
    ref = reference.select(key, F.col(value).alias("ref"), F.col(error).alias("ref_error"), F.lit(True).alias("found"))
    joined = signal.join(ref, key, "left")
    checked = F.when(F.col("found"), F.col(value) - F.col("ref")).otherwise(
        F.raise_error(F.concat(F.lit("no reference for "), F.col(key).cast("string"))).cast("double")
    )
    return joined.withColumn(value, checked).withColumn(error, F.hypot(error, "ref_error")).drop("ref", "ref_error", "found")


def phase_advance(rows: DataFrame, keys: Sequence[str], order: str, phase: str, variance: str) -> DataFrame:
    """From each monitor to the next: phase advance in [0, 1) and its variance; the last monitor has none."""
    w = W.partitionBy(*keys).orderBy(order)
    ahead = rows.withColumn("next_phase", F.lead(phase).over(w)).withColumn("next_variance", F.lead(variance).over(w))
    return ahead.where("next_phase is not null").select(
        *keys, order, fractional(F.col("next_phase") - F.col(phase)).alias("advance"), (F.col("next_variance") - F.col(variance)).alias("variance")
    )


def common_names(frames: DataFrame, series: str = "series_id", measurement: str = "measurement_id") -> DataFrame:
    """(series, name) for names that every measurement of the series has."""
    total = frames.groupBy(series).agg(F.countDistinct(measurement).alias("total"))
    seen = frames.groupBy(series, "name").agg(F.countDistinct(measurement).alias("seen"))
    return seen.join(total, series).where("seen = total").select(series, "name")


def mean_orbit(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, rms, population deviation and 1.96 standard errors of the present values of each key."""
    v = absent_to_null(F.col(value))
    n = F.count(v)
    sd = F.stddev_pop(v)
    return rows.groupBy(*keys).agg(
        n.alias("n"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"), sd.alias("sd"), (1.96 * sd / F.sqrt(n)).alias("ci")
    )
