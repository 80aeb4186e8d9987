"""Fits as driver loops over one Spark aggregation per step.

Readings stay on the executors. A step sends the knobs out and brings back a loss, a
gradient and the entries of a normal matrix: numbers of knobs, not of readings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.jobs.registry import query
from orbitweave.functions.missing import weight
from orbitweave.jobs.estimation import _MERGED, merged
from orbitweave.jobs.views import JAC, MEAS, MONITORS, NOISE, jacobians, measurements, noise, ring, solved_sql
from orbitweave.operators import reductions
from orbitweave.operators.solvers import Degeneracy, Evaluation, Outcome, add_prior, covariance, degeneracy, eliminate_gains, levenberg_marquardt, sandwich


def gauss_newton_sums(rows: DataFrame, knobs: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, normal matrix) from rows (jac, residual, weight), summed per partition in numpy and then by Spark.

    Rows whose weight is 0 or null, whose residual is absent or whose derivatives are not all there count nothing.
    """
    low = np.tril_indices(knobs)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + knobs + len(low[0]))
        for batch in batches:
            j = batch.column("jac").flatten().to_numpy(zero_copy_only=False).reshape(-1, knobs)
            r = batch.column("residual").to_numpy(zero_copy_only=False).astype(float)
            w = batch.column("weight").to_numpy(zero_copy_only=False).astype(float)
            w = np.where(np.isfinite(r), w, 0.0)
            r = np.where(np.isfinite(r), r, 0.0)
            weighted = j * w[:, None]
            total += np.concatenate([[w @ (r * r)], weighted.T @ r, (weighted.T @ j)[low]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    usable = rows.where((F.size("jac") == knobs) & ~F.exists("jac", lambda x: x.isNull()) & F.col("weight").isNotNull())
    parts = usable.select("jac", "residual", "weight").mapInArrow(partial, "i long, v double")
    sums = np.zeros(1 + knobs + len(low[0]))
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():  # a row per knob and pair of knobs
        sums[r["i"]] = r["v"]
    normal = np.zeros((knobs, knobs))
    normal[low] = sums[1 + knobs :]
    return float(sums[0]), 2 * sums[1 : 1 + knobs], normal + np.tril(normal, -1).T


@dataclass(frozen=True)
class Fit:
    """A fit's outcome with standard deviations and what the data cannot tell."""

    knobs: tuple[str, ...]
    outcome: Outcome
    sigma: np.ndarray
    degeneracy: Degeneracy


def fit_linear(readings: DataFrame, response: DataFrame, knobs: Sequence[str], prior: float = 0.0, steps: int = 20) -> Fit:
    """Knobs of a linear machine from ``readings`` (name, measured, weight) and each monitor's derivatives, ``response`` (name, jac).

    The response is a row per monitor and joined to the readings once; a step sends only the knobs out.
    """
    rows = readings.join(response, "name").select("jac", "measured", "weight").cache()

    def at(values: np.ndarray) -> Evaluation:
        model = sum((F.col("jac")[k] * float(v) for k, v in enumerate(values)), F.lit(0.0))
        loss, gradient, normal = gauss_newton_sums(rows.withColumn("residual", model - F.col("measured")), len(knobs))
        return add_prior(Evaluation(loss, gradient, 2 * normal), np.full(len(knobs), prior), values)

    try:
        outcome = levenberg_marquardt(at, np.zeros(len(knobs)), steps=steps, damping=1e-9, loss_limit=1e-12)
        normal = gauss_newton_sums(rows.withColumn("residual", F.lit(0.0)), len(knobs))[2]
    finally:
        rows.unpersist()
    sigma = np.sqrt(np.diag(covariance(normal + np.eye(len(knobs)) * prior / 2)))
    return Fit(tuple(knobs), outcome, sigma, degeneracy(normal, list(knobs)))


def _rows(spark: SparkSession, columns: dict[str, Sequence]) -> DataFrame:
    return spark.createDataFrame(pa.table({k: pa.array(v) for k, v in columns.items()}))


_SYSTEM = ", ".join(
    [f"sum(w * j[{i + 1}] * j[{k + 1}]) AS a{i}_{k}" for i in range(4) for k in range(4)] + [f"sum(w * j[{i + 1}] * target) AS b{i}_0" for i in range(4)]
    + [f"CAST({int(i == k)} AS DOUBLE) AS b{i}_{k + 1}" for i in range(4) for k in range(4)]
)


@query(f"""
WITH {JAC},
m AS (SELECT {_SYSTEM} FROM jac), yy AS (SELECT sum(w * target * target) AS yy FROM jac),
{solved_sql("x", "m", 4, 5)},
loss AS (SELECT yy - ({" + ".join(f"m.b{i}_0 * x.x{i}_0" for i in range(4))}) AS loss FROM m, x, yy)
""" + " UNION ALL ".join(f"SELECT 'k{i}' AS knob, round(x{i}_0, 7) AS value, round(sqrt(x{i}_{i + 1}), 8) AS sigma, round(loss, 4) AS loss FROM x, loss" for i in range(4)))
def lm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four linear knobs fitted to the readings by damped Gauss-Newton steps."""
    base = jacobians(spark, sf_dir).cache()

    def at(values: np.ndarray) -> Evaluation:
        model = sum((F.col("jac")[k] * float(v) for k, v in enumerate(values)), F.lit(0.0))
        loss, gradient, normal = gauss_newton_sums(base.withColumn("residual", model - F.col("target")), 4)
        return Evaluation(loss, gradient, 2 * normal)

    found = levenberg_marquardt(at, np.zeros(4), damping=1e-6, steps=8, loss_limit=1e-9)
    sigma = np.sqrt(np.diag(covariance(gauss_newton_sums(base.withColumn("residual", F.lit(0.0)), 4)[2])))
    base.unpersist()
    return _rows(spark, {"knob": [f"k{i}" for i in range(4)], "value": np.round(found.values, 7), "sigma": np.round(sigma, 8), "loss": [round(found.loss, 4)] * 4})


@query(f"""
WITH {JAC},
r AS (SELECT 'g' || vec_id % 6 AS name, w, j, target AS m, target - 4.5 AS r FROM jac),
s AS (
  SELECT name, sum(w * m * m) + 1.0 AS d, sum(w * m * r) AS g, {", ".join(f"sum(w * j[{i + 1}] * m) AS u{i}, sum(w * j[{i + 1}] * r) AS g{i}" for i in range(4))},
         {", ".join(f"sum(w * j[{i + 1}] * j[{k + 1}]) AS q{i}_{k}" for i in range(4) for k in range(4))}
  FROM r GROUP BY name),
m AS (SELECT {", ".join([f"sum(q{i}_{k} - u{i} * u{k} / d) AS a{i}_{k}" for i in range(4) for k in range(4)] + [f"-sum(g{i} - u{i} * g / d) AS b{i}_0" for i in range(4)])} FROM s),
{solved_sql("x", "m", 4, 1)}
SELECT name, round(-(g + {" + ".join(f"u{i} * x{i}_0" for i in range(4))}) / d, 8) AS step FROM s, x
""" + "".join(f" UNION ALL SELECT 'k{i}', round(x{i}_0, 8) FROM x" for i in range(4)))
def schur_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step for knobs and gains together, the gains eliminated."""
    rows = jacobians(spark, sf_dir).select(
        "jac", "weight", F.col("target").alias("m"), (F.col("target") - 4.5).alias("r"), F.concat(F.lit("g"), (F.col("vec_id") % 6).cast("string")).alias("name")
    )
    entries = reductions.calibration_blocks(rows, ["name"]).collect()  # knobs times monitors
    names = sorted({r["a"] for r in entries if r["block"] == "gb"})
    place = {n: i for i, n in enumerate(names)}
    uu, ub = np.zeros((4, 4)), np.zeros((4, len(names)))
    bb, gb, gu = np.zeros(len(names)), np.zeros(len(names)), np.zeros(4)
    for r in entries:
        block, a, b, v = r["block"], r["a"], r["b"], r["value"]
        if block == "uu":
            uu[int(a), int(b)] = uu[int(b), int(a)] = v
        elif block == "ub":
            ub[int(a), place[b]] = v
        elif block == "gu":
            gu[int(a)] = v
        elif block == "bb":
            bb[place[a]] = v
        else:
            gb[place[a]] = v
    reduced = eliminate_gains(uu, ub, bb, gu, gb, ridge=1.0)
    step = -np.linalg.solve(reduced.hessian, reduced.gradient)
    gains = reduced.gains(step)
    return _rows(spark, {"name": [f"k{i}" for i in range(4)] + names, "step": np.round(np.concatenate([step, gains]), 8)})


@query(_MERGED + """,
m AS (
  SELECT sum(g0 * g0) AS n00, sum(g0 * g1) AS n01, sum(g1 * g1) AS n11,
         sum(v * g0 * g0) AS m00, sum(v * g0 * g1) AS m01, sum(v * g1 * g1) AS m11
  FROM (SELECT *, CASE WHEN isinf(variance) THEN 0 ELSE variance END AS v FROM merged)),
d AS (SELECT *, n00 * n11 - n01 * n01 AS det FROM m)
SELECT 'k0' AS knob, round(sqrt(n11 * n11 * m00 - 2 * n11 * n01 * m01 + n01 * n01 * m11) / det, 9) AS sigma FROM d
UNION ALL SELECT 'k1', round(sqrt(n01 * n01 * m00 - 2 * n01 * n00 * m01 + n00 * n00 * m11) / det, 9) FROM d
""")
def sandwich_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard deviations of two knobs whose workers share readings."""
    readings = merged(spark, sf_dir)
    size = 2

    def matrix(entries: DataFrame) -> np.ndarray:
        out = np.zeros((size, size))
        for r in entries.collect():  # pairs of knobs
            out[r["a"], r["b"]] = out[r["b"], r["a"]] = r["value"]
        return out

    normal = matrix(reductions.normal_matrix(readings.withColumn("w", F.lit(1.0)), "g", "w"))
    sigma = np.sqrt(np.diag(sandwich(normal, matrix(reductions.noise_matrix(readings)))))
    return _rows(spark, {"knob": ["k0", "k1"], "sigma": np.round(sigma, 9)})


#: Tune and the ring positions of two kicks; the orbit that they are fitted against is flat.
TUNE, KICKS, FLAT = 0.31, (3, 9), 250.0
_RESPONSE = [f"cos(abs(ring_pos - {at}) * {float(2 * np.pi * TUNE / MONITORS)!r} - {float(np.pi * TUNE)!r}) / {float(2 * np.sin(np.pi * TUNE))!r}" for at in KICKS]


@query(f"""
WITH {MEAS}, {NOISE},
j AS (
  SELECT m.x - {FLAT} AS r, CASE WHEN n.std > 0 THEN 1.0 / (n.std * n.std) ELSE 0.0 END AS w, CAST({_RESPONSE[0]} AS DOUBLE) AS a, CAST({_RESPONSE[1]} AS DOUBLE) AS b
  FROM meas m JOIN noise n ON n.name = m.name WHERE m.x IS NOT NULL),
s AS (SELECT sum(w * a * a) AS aa, sum(w * a * b) AS ab, sum(w * b * b) AS bb, sum(w * a * r) AS ar, sum(w * b * r) AS br FROM j),
d AS (SELECT *, aa * bb - ab * ab AS det FROM s)
SELECT 'kick3' AS knob, round((ar * bb - br * ab) / det, 5) AS value, round(sqrt(bb / det), 8) AS sigma FROM d
UNION ALL SELECT 'kick9', round((br * aa - ar * ab) / det, 5), round(sqrt(aa / det), 8) FROM d
""")
def ring_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kicks fitted to the measured orbit of all readings, by each monitor's closed-orbit response."""
    stds = noise(spark, sf_dir).select(F.upper("name").alias("name"), weight(F.col("std") * F.col("std")).alias("weight"))
    readings = measurements(spark, sf_dir).where("x is not null").select("name", (F.col("x") - FLAT).alias("measured")).join(stds, "name")
    response = ring(spark).select("name", F.array(*(F.expr(f"cast({r} as double)") for r in _RESPONSE)).alias("jac"))
    fit = fit_linear(readings, response, ["kick3", "kick9"])
    return _rows(spark, {"knob": list(fit.knobs), "value": np.round(fit.outcome.values, 5), "sigma": np.round(fit.sigma, 8)})
