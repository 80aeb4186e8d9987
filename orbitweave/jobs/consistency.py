"""Queries over rules of consistency, ids of readings and sums of sensitivities that readings share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.functions import reading_ids
from orbitweave.jobs.registry import query
from orbitweave.jobs.views import JAC_ALL, MEAS, jacobians, measurements, table
from orbitweave.operators import reductions, rules

#: Observables of a line by its number, and the groups that rules are about.
OBSERVABLES = ("x", "y", "mu1", "mu2", "dx", "tune")
ORBITS, PHASES, SUPPORTED, SENSITIVE = ("x", "y"), ("mu1", "mu2"), ("x", "y", "mu1", "mu2", "dx"), ("mu1", "mu2", "dx")
_SHIFTS = 7


def series_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the measurements of a series; an order's lines are its observables."""
    names = F.array(*map(F.lit, OBSERVABLES))
    lines = table(spark, sf_dir, "lineitem")
    place = F.when(F.col("l_orderkey") % _SHIFTS < 3, F.col("l_linenumber") % 2).otherwise((F.col("l_linenumber") + F.col("l_orderkey")) % 6)
    seen = lines.where("l_linenumber <= 3").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.get(names, place.cast("int")).alias("o")))).alias("l"))
    orders = table(spark, sf_dir, "orders").join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select(
        F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("number"), F.transform("l", lambda x: x["o"]).alias("observables"),
        F.when(F.col("o_custkey") % 5 == 0, F.array(F.lit("x"), F.lit("mu1"))).otherwise(F.array().cast("array<string>")).alias("absolute"),
        F.col("o_orderstatus").alias("state"), F.lit("F").alias("reference_state"),
        (F.col("o_orderkey") % 4 / 1000).alias("pt"), F.lit(0.0).alias("reference_pt"),
    )


_SERIES = f"""
WITH seen AS (
  SELECT l_orderkey, list(CASE WHEN l_orderkey % {_SHIFTS} < 3 THEN {list(OBSERVABLES)}[l_linenumber % 2 + 1] ELSE {list(OBSERVABLES)}[(l_linenumber + l_orderkey) % 6 + 1] END ORDER BY l_linenumber) AS observables
  FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey),
m AS (
  SELECT o_custkey AS series, o_orderkey AS number, observables, CASE WHEN o_custkey % 5 = 0 THEN ['x', 'mu1'] ELSE [] END AS absolute,
         o_orderstatus AS state, o_orderkey % 4 / 1000.0 AS pt
  FROM orders LEFT JOIN seen ON o_orderkey = l_orderkey),
s AS (
  SELECT series, coalesce(arg_min({{'o': observables}}, number).o, []) AS o, any_value(absolute) AS a, arg_min(state, number) = 'F' AS same_state, count(*) AS measurements,
         count(DISTINCT coalesce(observables, [])) AS orders, bool_or(pt <> 0) AS momentum_changes, min(number) AS first
  FROM m GROUP BY series),
f AS (
  SELECT *, len(o) > 0 AND len([x FOR x IN o IF x NOT IN {PHASES}]) = 0 AS only_phases FROM s)
"""
_RULES = f"""
SELECT series, 'no observable' AS rule FROM f WHERE len(o) = 0
UNION ALL SELECT series, 'unsupported observable' FROM f WHERE len([x FOR x IN o IF x NOT IN {SUPPORTED}]) > 0
UNION ALL SELECT series, 'orbit and phase mixed' FROM f WHERE len([x FOR x IN o IF x IN {PHASES}]) > 0 AND len([x FOR x IN o IF x IN {ORBITS}]) > 0
UNION ALL SELECT series, 'observable twice' FROM f WHERE len(list_distinct(o)) < len(o)
UNION ALL SELECT series, 'observables differ' FROM f WHERE orders > 1
UNION ALL SELECT series, 'several phase measurements' FROM f WHERE only_phases AND measurements > 1
UNION ALL SELECT series, 'unknown absolute plane' FROM f WHERE NOT only_phases AND len([x FOR x IN a IF NOT list_contains(o, x)]) > 0
UNION ALL SELECT series, 'nothing changes' FROM f WHERE NOT only_phases AND same_state AND NOT momentum_changes AND len(a) = 0 AND len(o) > 0
UNION ALL SELECT series, 'gradients without a sensitive observable' FROM f WHERE series % 3 = 0 AND len([x FOR x IN o IF x IN {SENSITIVE}]) = 0
UNION ALL SELECT series, 'negative prior' FROM f WHERE series % 11 = 4
"""


@query(_SERIES + _RULES)
def series_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of ten rules each series breaks, judged in one pass."""
    series = rules.series_of(series_measurements(spark, sf_dir), "series", "number")
    series = series.withColumns({"fits_gradients": F.col("series") % 3 == 0, "prior": F.when(F.col("series") % 11 == 4, -0.5).otherwise(0.1)})
    every = rules.series_rules(SUPPORTED, PHASES, ORBITS) | rules.compatibility_rules(SENSITIVE)
    return rules.violations(series, ["series"], every)


@query(f"""
WITH {MEAS}
SELECT event_id, (((file_idx * {1 << 24} + turn) * {1 << 16} + mk) * 8 + p) AS reading_id, file_idx AS file, turn, CAST(mk AS BIGINT) AS monitor, p AS plane
FROM meas, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) t(p)
""")
def reading_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed id of every reading's planes, and its parts unpacked again."""
    rows = measurements(spark, sf_dir).withColumn("plane", F.explode(F.array(F.lit(0), F.lit(1))))
    packed = reading_ids.pack(file=F.col("file_idx"), turn=F.col("turn"), monitor=F.col("mk"), plane=F.col("plane"))
    ids = rows.select("event_id", packed.alias("reading_id"))
    return ids.select("*", *reading_ids.unpack(F.col("reading_id")))


@query(f"""
WITH {JAC_ALL},
e AS (SELECT vec_id // 3 AS reading_id, k - 1 AS knob, -w * j[k] AS v FROM (SELECT *, unnest(generate_series(1, len(j))) AS k FROM jac) WHERE (vec_id + k) % 4 <> 0),
m AS (SELECT reading_id, knob, sum(v) AS v FROM e GROUP BY ALL),
r AS (SELECT *, CASE WHEN reading_id % 11 = 0 THEN 0 ELSE 0.25 END AS variance FROM m)
SELECT x.knob AS a, y.knob AS b, round(sum(x.variance * x.v * y.v), 5) AS value
FROM r x JOIN r y ON x.reading_id = y.reading_id AND y.knob <= x.knob WHERE x.variance > 0 GROUP BY x.knob, y.knob
HAVING sum(x.variance * x.v * y.v) <> 0
""")
def sparse_noise_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise matrix of all knobs from sparse sensitivities that three workers share, merged by reading first."""
    parts = jacobians(spark, sf_dir, None).select(
        F.expr("vec_id div 3").alias("reading_id"),
        F.filter(
            F.transform("jac", lambda x, k: F.struct(k.cast("long").alias("knob"), (-F.col("weight") * x).alias("value"))), lambda p: (F.col("vec_id") + p["knob"] + 1) % 4 != 0
        ).alias("g"),
        F.when(F.expr("vec_id div 3") % 11 == 0, float("inf")).otherwise(0.25).alias("variance"),
    )
    merged = reductions.merge_readings(parts).withColumn("w", F.when(F.col("variance") < float("inf"), F.col("variance")).otherwise(0.0))
    return reductions.outer_blocks(merged, "w", block=16).select("a", "b", F.round("value", 5).alias("value"))
