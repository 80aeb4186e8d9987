"""Measurement-shaped views of the benchmark tables, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.functions.missing import INFINITE

MONITORS = 16
NAMES = [f"BPM.{k:02d}" for k in range(MONITORS)]
#: Ring position of each monitor: a permutation of 0 to 15.
RING = [(name, k * 7 % MONITORS) for k, name in enumerate(NAMES)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings from ``events``: 16 monitors a turn, 200 turns a file, 50 turns a bunch, some readings missing."""
    rows = table(spark, sf_dir, "events").where("event_type <> 'signup'")
    k = F.get_json_object("props", "$.k").cast("double")
    rows = rows.select(
        "event_id", "event_type", F.expr("event_id div 16").alias("turn"), (F.col("event_id") % 16).cast("int").alias("mk"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("x"), k.alias("px"), (F.col("value") * k).alias("y"),
    )
    return rows.select(
        "event_id", "event_type", "turn", "mk", F.concat(F.lit("BPM."), F.lpad(F.col("mk").cast("string"), 2, "0")).alias("name"),
        F.expr("turn div 200").alias("file_idx"), F.expr("(turn div 50) % 4").alias("bunch"),
        (F.col("mk") * 7 % 16).cast("int").alias("ring_pos"), "x", "px", "y", (F.col("px") / 10).alias("py"),
    )


MEAS = """
raw_events AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_id // 16 AS turn_no, CAST(event_id % 16 AS INTEGER) AS mk_no
  FROM events WHERE event_type <> 'signup'),
meas AS (
  SELECT event_id, event_type, turn_no AS turn, mk_no AS mk, 'BPM.' || lpad(CAST(mk_no AS VARCHAR), 2, '0') AS name,
         turn_no // 200 AS file_idx, (turn_no // 50) % 4 AS bunch, CAST(mk_no * 7 % 16 AS INTEGER) AS ring_pos,
         CASE WHEN event_type <> 'error' THEN value END AS x, k AS px, value * k AS y, k / 10 AS py
  FROM raw_events)"""


def ring(spark: SparkSession) -> DataFrame:
    """(name, ring_pos, col) of the machine's monitors."""
    positions = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("ring_pos"), F.lit(p).alias("col")) for n, p in RING))
    return spark.range(1).select(F.inline(positions))


RING_SQL = "ring AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {p})" for n, p in RING) + ") r(name, ring_pos))"


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, std) from ``nation``; region 0 has no noise figure."""
    rows = table(spark, sf_dir, "nation").where(F.col("n_nationkey") < MONITORS)
    name = F.concat(F.lit("bpm."), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    return rows.select(name.alias("name"), (F.col("n_regionkey") * 0.05).alias("std"))


NOISE = """
noise AS (
  SELECT 'BPM.' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS name, n_regionkey * CAST(0.05 AS DOUBLE) AS std
  FROM nation WHERE n_nationkey < 16)"""


def jacobians(spark: SparkSession, sf_dir: str, knobs: int | None = 4) -> DataFrame:
    """(vec_id, jac, target, weight) from ``embeddings``: a derivative per component, or sums of as many groups of them as there are knobs.

    Every seventh reading has no weight.
    """
    rows = table(spark, sf_dir, "embeddings")
    each = F.transform("embedding", lambda x: x.cast("double"))
    if knobs:
        size = F.expr(f"cast(size(embedding) div {knobs} as int)")
        sums = lambda k: F.aggregate(F.slice(each, k * size + 1, size), F.lit(0.0), lambda a, x: a + x)
        each = F.array(*(sums(F.lit(k)) for k in range(knobs)))
    return rows.select(
        "vec_id", each.alias("jac"), F.col("label").cast("double").alias("target"), F.when(F.col("vec_id") % 7 == 0, 0.0).otherwise(1.0).alias("weight")
    )


JAC_ALL = """
jac AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS j, CAST(label AS DOUBLE) AS target,
         CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE 1.0 END AS w
  FROM embeddings)"""

#: Four sums of a quarter of the components each.
JAC = JAC_ALL.replace(
    "CAST(embedding AS DOUBLE[])",
    "[" + ", ".join(f"list_sum(CAST(embedding[{k} * (len(embedding) // 4) + 1 : {k + 1} * (len(embedding) // 4)] AS DOUBLE[]))" for k in range(4)) + "]",
)


def solved_sql(name: str, source: str, size: int, rights: int) -> str:
    """CTEs up to ``name``: the row (x<i>_<r>) of solutions for the row ``source`` of a system a<i>_<j> and right sides b<i>_<r>, by Gauss and Jordan."""
    parts, last = [], source
    for k in range(size):
        terms = []
        for i in range(size):
            for c, n in (("a", size), ("b", rights)):
                for j in range(n):
                    row = f"{c}{k}_{j} / a{k}_{k}"
                    terms.append(f"{row if i == k else f'{c}{i}_{j} - a{i}_{k} * {row}'} AS {c}{i}_{j}")
        parts.append(f"{name}{k} AS (SELECT {', '.join(terms)} FROM {last})")
        last = f"{name}{k}"
    out = ", ".join(f"b{i}_{r} AS x{i}_{r}" for i in range(size) for r in range(rights))
    return ",\n".join([*parts, f"{name} AS (SELECT {out} FROM {last})"])


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, step, loss) from ``conversations``; of a repeated step the longest text counts."""
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy(F.col("conv_id").alias("run_id"), F.col("turn").alias("step")).agg(F.max(F.length("text")).cast("double").alias("loss"))


STEPS = """
steps AS (
  SELECT conv_id AS run_id, turn AS step, CAST(max(length(text)) AS DOUBLE) AS loss
  FROM conversations GROUP BY conv_id, turn)"""

INFINITY_SQL = "CAST('infinity' AS DOUBLE)"
assert INFINITE == float("inf")
