"""Many fits in one job: a system per momentum and series, solved in tasks, read at a reference momentum."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.jobs.registry import query
from orbitweave.jobs.views import JAC_ALL, jacobians, table
from orbitweave.operators import packed_sums
from orbitweave.operators.tall_qr import degeneracy_of, tall_qr


def fit_each(rows: DataFrame, keys: Sequence[str], jacobian: Column, residual: Column, weight: Column, knobs: int, strength: float) -> DataFrame:
    """(keys, n, values, sigma) for every key: knobs that explain its residuals, with standard deviations.

    The prior towards 0 has ``strength`` times the median of the key's positive curvature; it is not to be negative.
    Readings are read once and a matrix per task and key is shuffled, however many fits there are. A system that
    is singular for want of a prior is solved by least squares. Readings without a value or a positive weight count nothing.
    """
    if strength < 0:
        raise ValueError("a prior is not negative")
    usable = rows.where(~F.isnan(residual) & (weight > 0))
    sums = packed_sums.sums_by_key(usable, keys, F.concat(jacobian, F.array(residual)), knobs + 1, weight)

    def solve(_: np.ndarray, packed: np.ndarray) -> dict[str, np.ndarray]:
        whole = packed_sums.unpack(packed, knobs + 1)
        normal, right = whole[:, :knobs, :knobs], whole[:, :knobs, knobs]
        diagonal = np.diagonal(normal, axis1=1, axis2=2)
        positive = np.where(diagonal > 0, diagonal, np.nan)
        some = (diagonal > 0).any(axis=1)
        alpha = np.zeros(len(packed))
        alpha[some] = strength * np.nanmedian(positive[some], axis=1)
        inverse = np.linalg.pinv(normal + alpha[:, None, None] * np.eye(knobs), rcond=1e-14, hermitian=True)
        return {"values": np.einsum("nij,nj->ni", inverse, right), "sigma": np.sqrt(np.maximum(np.diagonal(inverse, axis1=1, axis2=2), 0))}

    columns = [*(sums.schema[k] for k in keys), sums.schema["n"]]
    return packed_sums.mapped(sums, columns, solve, "values array<double>, sigma array<double>")


def at_reference(fits: DataFrame, series: str, momentum: str, reference: float) -> DataFrame:
    """(series, momenta, values): each series' knobs at the reference momentum, between the two nearest fits around it.

    Outside the fitted momenta the nearest fit stands. A series with fewer than two momenta cannot tell its
    magnets apart and is an error. One row per fit is grouped by series, combined before the shuffle.
    """
    m = F.col(momentum)
    below, above = m <= reference, m >= reference
    row = F.struct(m.alias("m"), "values")
    ends = fits.groupBy(series).agg(
        F.count_distinct(m).alias("momenta"), F.max(F.when(below, row)).alias("low"), F.min(F.when(above, row)).alias("high")
    )
    low, high = F.coalesce("low", "high"), F.coalesce("high", "low")
    ends = ends.select(series, "momenta", low.alias("low"), high.alias("high"))
    share = F.coalesce(F.try_divide(F.lit(reference) - F.col("low.m"), F.col("high.m") - F.col("low.m")), F.lit(0.0))
    few = F.raise_error(F.concat(F.lit("a single momentum in series "), F.col(series).cast("string")))
    values = F.zip_with("low.values", "high.values", lambda a, b: a + (b - a) * share)
    return ends.select(series, F.when(F.col("momenta") >= 2, F.col("momenta")).otherwise(few.cast("bigint")).alias("momenta"), values.alias("values"))


REFERENCE, PRIOR = 0.0005, 0.05

_FITS = f"""
WITH r AS (
  SELECT l_suppkey % 40 AS series, (l_linenumber - 4) / 1000.0 AS momentum, CAST(l_quantity AS DOUBLE) / 10 AS a, CAST(l_discount AS DOUBLE) * 100 - 5 AS b,
         CAST(l_extendedprice AS DOUBLE) / 1000 - 30 AS r, 1 / (1 + CAST(l_tax AS DOUBLE)) AS w
  FROM lineitem),
s AS (
  SELECT series, CAST(momentum AS DOUBLE) AS momentum, count(*) AS n, sum(w * a * a) AS aa, sum(w * a * b) AS ab, sum(w * b * b) AS bb, sum(w * a * r) AS ar, sum(w * b * r) AS br
  FROM r GROUP BY ALL),
t AS (SELECT * REPLACE (aa + {PRIOR} * (aa + bb) / 2 AS aa, bb + {PRIOR} * (aa + bb) / 2 AS bb) FROM s),
fits AS (SELECT series, momentum, n, (ar * bb - br * ab) / (aa * bb - ab * ab) AS a, (br * aa - ar * ab) / (aa * bb - ab * ab) AS b,
                sqrt(bb / (aa * bb - ab * ab)) AS sa, sqrt(aa / (aa * bb - ab * ab)) AS sb FROM t)
"""


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 40).alias("series"), ((F.col("l_linenumber") - 4) / 1000).alias("momentum"),
        F.array(F.col("l_quantity").cast("double") / 10, F.col("l_discount").cast("double") * 100 - 5).alias("jac"),
        (F.col("l_extendedprice").cast("double") / 1000 - 30).alias("r"), (1 / (1 + F.col("l_tax").cast("double"))).alias("w"),
    )
    return fit_each(rows, ["series", "momentum"], F.col("jac"), F.col("r"), F.col("w"), 2, PRIOR)


@query(_FITS + "SELECT series, momentum, n, round(a, 8) AS a, round(b, 8) AS b, round(sa, 8) AS sigma_a, round(sb, 8) AS sigma_b FROM fits")
def momentum_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two knobs of every series and momentum."""
    out = _fits(spark, sf_dir)
    return out.select(
        "series", "momentum", "n", *(F.round(F.col(c)[i], 8).alias(n) for c, i, n in (("values", 0, "a"), ("values", 1, "b"), ("sigma", 0, "sigma_a"), ("sigma", 1, "sigma_b")))
    )


@query(_FITS + f"""
SELECT series, count(*) AS momenta,
       round(arg_max(a, momentum) FILTER (momentum <= {REFERENCE}) + (arg_min(a, momentum) FILTER (momentum >= {REFERENCE}) - arg_max(a, momentum) FILTER (momentum <= {REFERENCE}))
             * ({REFERENCE} - max(momentum) FILTER (momentum <= {REFERENCE})) / (min(momentum) FILTER (momentum >= {REFERENCE}) - max(momentum) FILTER (momentum <= {REFERENCE})), 7) AS a,
       round(arg_max(b, momentum) FILTER (momentum <= {REFERENCE}) + (arg_min(b, momentum) FILTER (momentum >= {REFERENCE}) - arg_max(b, momentum) FILTER (momentum <= {REFERENCE}))
             * ({REFERENCE} - max(momentum) FILTER (momentum <= {REFERENCE})) / (min(momentum) FILTER (momentum >= {REFERENCE}) - max(momentum) FILTER (momentum <= {REFERENCE})), 7) AS b
FROM fits GROUP BY series
""")
def momentum_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knobs of every series at a reference momentum between two fitted ones."""
    out = at_reference(_fits(spark, sf_dir), "series", "momentum", REFERENCE)
    return out.select("series", "momenta", F.round(F.col("values")[0], 7).alias("a"), F.round(F.col("values")[1], 7).alias("b"))


@query(f"""
WITH {JAC_ALL},
l AS (SELECT vec_id, w, j, unnest(generate_series(1, len(j))) AS a FROM jac WHERE w > 0),
p AS (SELECT a, w * j[a] AS wj, j, unnest(generate_series(1, a)) AS b FROM l)
SELECT CAST(a - 1 AS INTEGER) AS a, CAST(b - 1 AS INTEGER) AS b, round(sum(wj * j[b]), 5) AS value, any_value(len(j)) AS rank FROM p GROUP BY a, b
""")
def tall_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor of all derivatives, squared to compare it, and the rank that its singular values tell before any fit."""
    rows = jacobians(spark, sf_dir, None)
    size = rows.select(F.max(F.size("jac"))).first()[0]
    r = tall_qr(rows, F.col("jac"), size, F.col("weight"))
    rank = degeneracy_of(r, [f"k{i}" for i in range(size)]).rank
    square = np.round(r.T @ r, 5)
    rows = [(a, b, float(square[a, b]), rank) for a in range(size) for b in range(a + 1)]  # pairs of knobs
    return spark.createDataFrame(rows, "a int, b int, value double, rank long")
