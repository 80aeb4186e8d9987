"""Fits of knobs together with one gain per monitor, over all steps, without a gain ever reaching the driver.

A monitor with gain g shows (1 + g) times the position. For a linear machine the position
is the model's plus derivatives times knobs, so that a monitor's readings count through one
small matrix: the weighted outer product of (position, derivatives, reading). Readings
are read once. A step is a pass over monitors: each takes its gain out of the system by a
Schur complement and adds its downdate to the knobs' matrix, which Spark sums up.

A gain depends on the steps taken and on its own matrix alone. A pass therefore gets the
list of steps and every monitor goes through them again; there is no table of gains to
join, to update or to lose.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.jobs.registry import query
from orbitweave.jobs.views import table
from orbitweave.operators import packed_sums
from orbitweave.operators.solvers import Evaluation, add_prior, covariance, damped_step, family_alphas
from orbitweave.sources.shared_tables import written

Steps = tuple[tuple[np.ndarray, np.ndarray], ...]


def _parts(matrices: np.ndarray, u: np.ndarray, gain: np.ndarray, ridge: float) -> dict[str, np.ndarray]:
    """A monitor's loss and blocks at knobs ``u`` and its gain; the gain's prior is half ``ridge`` times its square."""
    k = len(u)
    e = np.concatenate([[1.0], u])
    model, by, yy = matrices[:, : k + 1, : k + 1], matrices[:, : k + 1, k + 1], matrices[:, k + 1, k + 1]
    p = model @ e  # position, then each derivative, times the position
    pp, py = p @ e, by @ e
    h = 1 + gain
    return {
        "loss": 0.5 * (h * h * pp - 2 * h * py + yy) + 0.5 * ridge * gain * gain,
        "uu": h[:, None, None] ** 2 * model[:, 1:, 1:],
        "ub": h[:, None] * p[:, 1:],
        "bb": pp + ridge,
        "gu": h[:, None] ** 2 * p[:, 1:] - h[:, None] * by[:, 1:],
        "gb": h * pp - py + ridge * gain,
    }


def _replayed(matrices: np.ndarray, steps: Steps, ridge: float) -> np.ndarray:
    """Every monitor's gain after the steps (knobs at its start, change of knobs)."""
    gain = np.zeros(len(matrices))
    for u, change in steps:
        b = _parts(matrices, u, gain, ridge)
        gain = gain - (b["gb"] + b["ub"] @ change) / np.where(b["bb"] > 0, b["bb"], 1.0)
    return gain


@dataclass(frozen=True)
class Calibrated:
    """Knobs with standard deviations, the loss of every accepted point, and (key, gain, sigma) of all monitors."""

    values: np.ndarray
    sigma: np.ndarray
    losses: tuple[float, ...]
    reason: str
    gains: DataFrame


def fit_calibrated(
    readings: DataFrame, key: str, knobs: Sequence[str], ridge: float, strengths: Mapping[str, float] | None = None, families: Sequence[str] | None = None,
    steps: int = 20, damping: float = 0.0, loss_limit: float = 1e-12,
) -> Calibrated:
    """Damped Gauss-Newton steps for knobs and gains from ``readings`` (key, model, jac, measured, weight).

    ``ridge`` is a gain's prior. ``strengths`` by family are the knobs' prior, times the median of the family's
    curvature at the first point, where they are frozen. Readings without a value, derivative or positive weight
    count nothing; a monitor without curvature keeps gain 0. The driver holds numbers of knobs, never of monitors.
    """
    k = len(knobs)
    vector = F.concat(F.array("model"), "jac", F.array("measured"))
    finite = readings.where(~F.isnan("measured") & (F.col("weight") > 0))
    sums = written(packed_sums.sums_by_key(finite, [key], vector, k + 2, F.col("weight")), "calibration-sums")
    columns = [sums.schema[key]]
    low = np.triu_indices(k)

    def totals(path: Steps, u: np.ndarray) -> Evaluation:
        """Loss, reduced gradient and reduced matrix at ``u``, and the knobs' own diagonal."""

        def work(_: np.ndarray, packed: np.ndarray) -> dict[str, np.ndarray]:
            matrices = packed_sums.unpack(packed, k + 2)
            b = _parts(matrices, u, _replayed(matrices, path, ridge), ridge)
            inverse = 1 / np.where(b["bb"] > 0, b["bb"], np.inf)
            reduced = b["uu"] - b["ub"][:, :, None] * b["ub"][:, None, :] * inverse[:, None, None]
            gradient = b["gu"] - b["ub"] * (inverse * b["gb"])[:, None]
            own = np.diagonal(b["uu"], axis1=1, axis2=2)
            total = np.concatenate([[b["loss"].sum()], gradient.sum(axis=0), reduced.sum(axis=0)[low], own.sum(axis=0)])
            rows = np.zeros((len(packed), len(total)))
            rows[0] = total  # a batch's sum rides in its first row
            return {"v": rows[:1].repeat(len(packed), axis=0) * (np.arange(len(packed)) == 0)[:, None]}

        each = packed_sums.mapped(sums, columns, work, "v array<double>").select(F.posexplode("v").alias("i", "v")).where("v <> 0")
        out = np.zeros(1 + 2 * k + len(low[0]))
        for r in each.groupBy("i").agg(F.sum("v").alias("v")).collect():  # pairs of knobs
            out[r["i"]] = r["v"]
        matrix = np.zeros((k, k))
        matrix[low] = out[1 + k : 1 + k + len(low[0])]
        diagonal.append(out[1 + k + len(low[0]) :])
        return Evaluation(float(out[0]), out[1 : 1 + k], matrix + np.triu(matrix, 1).T)

    diagonal: list[np.ndarray] = []
    u, path = np.zeros(k), ()
    best = totals(path, u)
    names = list(families) if families is not None else [n.rpartition(".")[2] for n in knobs]
    alphas = family_alphas(diagonal[0], names, strengths) if strengths else np.zeros(k)
    plain, best = best, add_prior(best, alphas, u)
    losses, reason = [best.loss], "steps_exhausted"
    for _ in range(steps):
        while True:
            change = damped_step(best.hessian, best.gradient, damping)
            trial = (*path, (u, change))
            seen = totals(trial, u + change)
            found = add_prior(seen, alphas, u + change)
            if found.loss < best.loss or damping > 1e12 or not np.abs(change).max(initial=0.0):
                break
            damping = max(10 * damping, 1e-6)
        if not found.loss < best.loss:
            reason = "no_progress"
            break
        lower = (best.loss - found.loss) / max(abs(best.loss), 1e-300)
        u, path, plain, best, damping = u + change, trial, seen, found, damping / 10 if damping > 1e-6 else 0.0
        losses.append(best.loss)
        if lower <= loss_limit:
            reason = "loss_converged"
            break
    inverse = covariance(plain.hessian + np.diag(alphas))

    def told(_: np.ndarray, packed: np.ndarray) -> dict[str, np.ndarray]:
        matrices = packed_sums.unpack(packed, k + 2)
        gain = _replayed(matrices, path, ridge)
        b = _parts(matrices, u, gain, ridge)
        scale = 1 / np.where(b["bb"] > 0, b["bb"], np.inf)
        spread = np.einsum("ni,ij,nj->n", b["ub"], inverse, b["ub"]) * scale * scale
        return {"gain": gain, "sigma": np.sqrt(scale + spread)}

    gains = packed_sums.mapped(sums, columns, told, "gain double, sigma double")
    return Calibrated(u, np.sqrt(np.diag(inverse)), tuple(losses), reason, gains)


#: Prior of the gains and strength of the knobs' prior, and steps, of the query.
RIDGE, STRENGTH, STEPS = 2.0, 0.01, 3


def _schur_sql() -> str:
    """The steps of ``schur_fit`` one after the other, over sums by monitor."""
    parts = [f"""
WITH s AS (
  SELECT l_partkey AS name, sum(w * m * m) AS mm, sum(w * m * a) AS ma, sum(w * m * b) AS mb, sum(w * a * a) AS aa, sum(w * a * b) AS ab,
         sum(w * b * b) AS bb, sum(w * m * y) AS my, sum(w * a * y) AS ay, sum(w * b * y) AS by_
  FROM (SELECT l_partkey, 1.0 + l_linenumber % 3 AS w, 1 + CAST(l_tax AS DOUBLE) AS m, CAST(l_quantity AS DOUBLE) / 50 AS a,
               10 * CAST(l_discount AS DOUBLE) AS b, CAST(l_extendedprice AS DOUBLE) / 20000 AS y FROM lineitem)
  GROUP BY l_partkey),
g0 AS (SELECT name, CAST(0.0 AS DOUBLE) AS g FROM s), u0 AS (SELECT CAST(0.0 AS DOUBLE) AS u, CAST(0.0 AS DOUBLE) AS v),
alpha AS (SELECT {STRENGTH} * (sum(aa) + sum(bb)) / 2 AS alpha FROM s)"""]
    for k in range(STEPS):
        parts.append(f"""
p{k} AS (
  SELECT s.*, g, u, v, 1 + g AS h, mm + 2 * (u * ma + v * mb) + u * u * aa + 2 * u * v * ab + v * v * bb AS pp,
         ma + u * aa + v * ab AS ap, mb + u * ab + v * bb AS bp, my + u * ay + v * by_ AS py
  FROM s JOIN g{k} USING (name) CROSS JOIN u{k}),
b{k} AS (SELECT *, h * ap AS ua, h * bp AS ub, pp + {RIDGE} AS d, h * h * ap - h * ay AS ga, h * h * bp - h * by_ AS gb_, h * pp - py + {RIDGE} * g AS gg FROM p{k}),
r{k} AS (
  SELECT sum(h * h * aa - ua * ua / d) + any_value(alpha) AS haa, sum(h * h * ab - ua * ub / d) AS hab, sum(h * h * bb - ub * ub / d) + any_value(alpha) AS hbb,
         sum(ga - ua * gg / d) + any_value(alpha * u) AS xa, sum(gb_ - ub * gg / d) + any_value(alpha * v) AS xb
  FROM b{k}, alpha),
c{k} AS (SELECT -(xa * hbb - xb * hab) / (haa * hbb - hab * hab) AS du, -(xb * haa - xa * hab) / (haa * hbb - hab * hab) AS dv FROM r{k}),
u{k + 1} AS (SELECT u + du AS u, v + dv AS v FROM u{k}, c{k}),
g{k + 1} AS (SELECT name, g - (gg + ua * du + ub * dv) / d AS g FROM b{k}, c{k})""")
    return ",".join(parts) + f"""
SELECT 'knob.a' AS name, round(u, 7) AS value FROM u{STEPS} UNION ALL SELECT 'knob.b', round(v, 7) FROM u{STEPS}
UNION ALL SELECT 'gain.' || name, round(g, 7) FROM g{STEPS}
"""


def calibration_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings from ``lineitem``: a part is a monitor."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("name"), (1 + F.col("l_tax").cast("double")).alias("model"),
        F.array(F.col("l_quantity").cast("double") / 50, 10 * F.col("l_discount").cast("double")).alias("jac"),
        (F.col("l_extendedprice").cast("double") / 20000).alias("measured"), (1.0 + F.col("l_linenumber") % 3).alias("weight"),
    )


@query(_schur_sql())
def schur_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two knobs with a prior and a gain for each of thousands of monitors, three Gauss-Newton steps."""
    fit = fit_calibrated(calibration_readings(spark, sf_dir), "name", ["knob.a", "knob.b"], RIDGE, {"kick": STRENGTH}, ["kick", "kick"], steps=STEPS, loss_limit=0.0)
    knobs = spark.createDataFrame([("knob.a", float(fit.values[0])), ("knob.b", float(fit.values[1]))], "name string, value double")
    gains = fit.gains.select(F.concat(F.lit("gain."), F.col("name").cast("string")).alias("name"), F.col("gain").alias("value"))
    return knobs.union(gains).select("name", F.round("value", 7).alias("value"))
