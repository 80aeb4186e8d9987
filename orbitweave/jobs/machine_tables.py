"""Queries over monitors, knobs and groups of magnets as tables of a machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.functions.names import is_gain
from orbitweave.jobs.registry import query
from orbitweave.jobs.views import JAC_ALL, MEAS, jacobians, measurements, table
from orbitweave.operators import corrections, machine

#: A user's order of parts, one of them twice, and prefixes of names that are not wanted.
WANTED, UNWANTED = ("Part 7", "Part 3", "Part 11", "Part 3", "no part"), ("part 1", "PART 20")


@query(f"WITH {MEAS} SELECT event_id, px, py FROM meas WHERE px IS NOT NULL AND py IS NOT NULL")
def momenta_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that have both momenta."""
    return corrections.drop_absent_momenta(measurements(spark, sf_dir)).select("event_id", "px", "py")


@query("SELECT l_suppkey AS knob, round(CAST(sum(l_quantity) AS DOUBLE) / count(*), 7) AS s FROM lineitem GROUP BY l_suppkey")
def knob_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean position of each knob's members."""
    members = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("knob"), F.col("l_quantity").cast("double").alias("s"))
    return corrections.shared_positions(members).select("knob", F.round("s", 7).alias("s"))


@query("""
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'xy' END AS plane FROM supplier
""")
def monitor_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane that a monitor's name tells."""
    letters = F.when(F.col("s_suppkey") % 3 == 0, "H").when(F.col("s_suppkey") % 3 == 1, "V").otherwise("HV")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("BPM."), letters, F.lit("."), F.col("s_suppkey").cast("string")).alias("name"))
    return rows.select("s_suppkey", machine.monitor_plane(F.col("name"), r"\.H", r"V\.").alias("plane"))


@query(f"""
WITH {JAC_ALL},
g AS (SELECT k AS monitor, k / 100.0 AS gain FROM generate_series(0, 6) t(k) WHERE k <> 2)
SELECT vec_id, round((1 + coalesce(gain, 0)) * target, 9) AS reading, round(list_sum([(1 + coalesce(gain, 0)) * x FOR x IN j]), 6) AS scaled_sum,
       CASE WHEN gain IS NOT NULL THEN target END AS by_gain
FROM jac LEFT JOIN g ON monitor = vec_id % 7
""")
def gains_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings and their derivatives under monitors' gains; one monitor has none."""
    gains = spark.range(7).where("id <> 2").select(F.col("id").alias("monitor"), (F.col("id") / 100).alias("gain"))
    rows = jacobians(spark, sf_dir, None).withColumn("monitor", F.col("vec_id") % 7)
    out = corrections.with_gains(rows, gains, ["monitor"], "target", "jac")
    total = F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", F.round("reading", 9).alias("reading"), F.round(total, 6).alias("scaled_sum"), "by_gain")


@query("""
WITH v AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'bpmgain.x.' ELSE 'k.' END || p_partkey AS name, p_size AS value, p_partkey FROM part)
SELECT name, value, CASE WHEN p_partkey % 3 = 0 THEN 'knob' WHEN p_partkey % 4 = 0 THEN 'fixed' ELSE 'unknown' END AS role, name LIKE 'bpmgain.%' AS gain FROM v
""")
def knob_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given values as fitted knobs, fixed values or unknown ones, gains marked."""
    name = F.concat(F.when(F.col("p_partkey") % 5 == 0, "bpmgain.x.").otherwise("k."), F.col("p_partkey").cast("string"))
    values = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.col("p_size").alias("value"))
    knobs, fixed = values.where("p_partkey % 3 = 0"), values.where("p_partkey % 4 = 0")
    return machine.split_knobs(values, knobs, fixed).withColumn("gain", is_gain(F.col("name")))


@query("""
WITH f AS (
  SELECT 0 AS frame, l_partkey AS name, min(l_orderkey) AS pos FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey
  UNION ALL SELECT 1, p_partkey, p_size FROM part WHERE p_size > 25
  UNION ALL SELECT 2, ps, 0 FROM (SELECT DISTINCT l_partkey AS ps FROM lineitem WHERE l_linenumber = 7))
SELECT name, min(frame) AS frame, arg_min(pos, frame) AS pos FROM f GROUP BY name
""")
def ordered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of three frames, each at its first place over them."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    frames = [
        lines.where("l_quantity > 45").groupBy(F.col("l_partkey").alias("name")).agg(F.min("l_orderkey").cast("long").alias("pos")),
        part.where("p_size > 25").select(F.col("p_partkey").alias("name"), F.col("p_size").cast("long").alias("pos")),
        lines.where("l_linenumber = 7").select(F.col("l_partkey").alias("name"), F.lit(0).cast("long").alias("pos")).distinct(),
    ]
    return machine.ordered_union(frames, "name").select("name", "position.frame", "position.pos")


@query("""
SELECT p_partkey, upper('Part ' || p_partkey) AS name FROM part WHERE NOT (starts_with(upper('Part ' || p_partkey), 'PART 1') OR starts_with(upper('Part ' || p_partkey), 'PART 20'))
""")
def prefix_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without those that start, in whatever case, with unwanted prefixes."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("name"))
    return machine.drop_prefixes(rows, "name", UNWANTED).withColumn("name", F.upper("name"))


@query("SELECT p_partkey, CASE p_partkey WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS place FROM part WHERE p_partkey IN (7, 3, 11)")
def given_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that a user's list names, in its order."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("name"))
    return machine.in_given_order(rows, "name", WANTED).select("p_partkey", "place")


_GROUPS = """
WITH e AS (
  SELECT p_partkey, p_partkey % 9 AS cell, CAST(p_retailprice AS DOUBLE) / 100 - 14 AS strength, CAST(p_size AS DOUBLE) AS length,
         p_partkey % 2 = 0 AS bend FROM part),
g AS (SELECT *, 'g' || cell || CASE WHEN bend THEN CASE WHEN strength >= 0 THEN '_p' ELSE '_n' END ELSE '' END AS grp FROM e),
s AS (SELECT grp, sum(strength * length) / sum(length) AS strength, count(*) AS n FROM g GROUP BY grp)
"""


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("member"), (F.col("p_retailprice").cast("double") / 100 - 14).alias("strength"), F.col("p_size").cast("double").alias("length"),
        F.concat(F.lit("g"), (F.col("p_partkey") % 9).cast("string")).alias("cell"),
    )
    return rows.withColumn("grp", machine.by_sign(F.col("cell"), F.col("strength"), F.col("member") % 2 == 0))


@query(_GROUPS + 'SELECT grp AS "group", round(strength, 8) AS strength, n FROM s')
def sign_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean strengths by length of groups, those of bends told apart by sign."""
    return machine.length_weighted(_elements(spark, sf_dir), F.col("grp"), "strength", "length").select("group", F.round("strength", 8).alias("strength"), "n")


@query(_GROUPS + "SELECT p_partkey AS member, round(s.strength, 8) AS value FROM g JOIN s USING (grp)")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every magnet with the strength of its group: grouping turned back."""
    elements = _elements(spark, sf_dir)
    groups = machine.length_weighted(elements, F.col("grp"), "strength", "length").withColumnRenamed("group", "grp")
    return machine.expand_groups(groups, elements, "grp", "strength").select("member", F.round("value", 8).alias("value"))


@query("""
WITH m AS (SELECT l_partkey AS name, l_linenumber AS k, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem WHERE l_linenumber IN (1, 4, 7) GROUP BY ALL)
SELECT a.name, a.n AS a_n, a.q AS a_q, b.n AS b_n, b.q AS b_q, c.n AS c_n, c.q AS c_q
FROM m a JOIN m b ON b.name = a.name AND b.k = 4 JOIN m c ON c.name = a.name AND c.k = 7 WHERE a.k = 1
""")
def common_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three measurements side by side for the names that all of them have."""
    lines = table(spark, sf_dir, "lineitem")

    def part(k: int) -> DataFrame:
        rows = lines.where(F.col("l_linenumber") == k).groupBy(F.col("l_partkey").alias("name"))
        return rows.agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("q"))

    return corrections.common_measurements([("a", part(1)), ("b", part(4)), ("c", part(7))], "name")
