"""Queries over scans, preparation and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.functions.missing import usable_variance, weight
from orbitweave.jobs.registry import query
from orbitweave.jobs.views import MEAS, NAMES, NOISE, RING_SQL, measurements, noise, ring, table
from orbitweave.operators import prepare, reductions


@query(f"""
WITH {MEAS}
SELECT file_idx, turn, name, x, px FROM meas WHERE name IN ('BPM.00', 'BPM.03', 'BPM.05')
""")
def scan_filter_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of three monitors, only the columns asked for."""
    rows = measurements(spark, sf_dir).where(F.col("name").isin("BPM.00", "BPM.03", "BPM.05"))
    return rows.select("file_idx", "turn", "name", "x", "px")


@query(f"""
WITH {MEAS},
spans AS (SELECT file_idx, min(turn) AS first, max(turn) - min(turn) + 1 AS n FROM meas WHERE turn % 200 >= 5 GROUP BY file_idx),
offsets AS (SELECT *, coalesce(sum(n) OVER (ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM spans)
SELECT m.event_id, m.file_idx, m.turn, CAST(m.turn - first + o AS BIGINT) AS global_turn
FROM meas m JOIN offsets USING (file_idx) WHERE m.turn % 200 >= 5
""")
def turn_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of all files, each without its first five, on one gapless axis."""
    rows = measurements(spark, sf_dir).where("turn % 200 >= 5")
    return prepare.rebase_turns(rows).select("event_id", "file_idx", "turn", F.col("global_turn").cast("long").alias("global_turn"))


@query(f"""
WITH {MEAS}, {NOISE}
SELECT event_id, m.name, std = 0 OR m.name = 'BPM.07' AS excluded,
       CASE WHEN std > 0 AND m.name <> 'BPM.07' THEN 1.0 / (std * std) ELSE 0.0 END AS weight
FROM meas m JOIN noise n ON n.name = m.name
""")
def noise_variance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse-variance weights from the noise table, one monitor excluded."""
    rows = prepare.assign_variances(measurements(spark, sf_dir), noise(spark, sf_dir), bad=["bpm.07"])
    return rows.select("event_id", "name", (~usable_variance(F.col("variance"))).alias("excluded"), weight(F.col("variance")).alias("weight"))


@query("""
SELECT p_partkey, p_type, regexp_matches(p_type, '(?i)(brass|^promo)') AS blanked,
       CASE WHEN regexp_matches(p_type, '(?i)(brass|^promo)') OR p_size = 0 THEN 0.0 ELSE 1.0 / (p_size * 1.0) END AS weight
FROM part
""")
def regex_nan_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements whose type matches a pattern, in any case, get no weight."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.col("p_size").cast("double").alias("variance"))
    rows = prepare.blank_variances(rows, ["brass", "^promo"], name="p_type")
    return rows.select("p_partkey", "p_type", F.isnan("variance").alias("blanked"), weight(F.col("variance")).alias("weight"))


@query(f"WITH {MEAS}, {NOISE} SELECT event_id, name FROM meas WHERE name IN (SELECT name FROM noise WHERE std > 0)")
def semi_join_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of monitors that the model has."""
    model = noise(spark, sf_dir).where("std > 0").select(F.upper("name").alias("name"))
    return measurements(spark, sf_dir).join(model, "name", "left_semi").select("event_id", "name")


@query(f"WITH {MEAS}, {RING_SQL} SELECT name, ring_pos FROM ring WHERE name NOT IN (SELECT name FROM meas WHERE x > 300)")
def anti_join_unmeasured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitors of the ring without a large reading."""
    seen = measurements(spark, sf_dir).where("x > 300").select("name")
    return ring(spark).join(seen, "name", "left_anti").select("name", "ring_pos")


_KICKS = "kicks AS (SELECT file_idx, min(turn) + 3 AS kick_turn FROM meas WHERE file_idx % 2 = 0 GROUP BY file_idx)"


@query(f"""
WITH {MEAS}, {_KICKS}
SELECT event_id, m.file_idx, turn, turn - coalesce(kick_turn, 1) + 1 AS trimmed_turn
FROM meas m LEFT JOIN kicks k USING (file_idx)
WHERE kick_turn IS NULL OR turn > kick_turn OR (turn = kick_turn AND ring_pos >= 5)
""")
def trim_after_kick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second file from its kick on, monitors before the kicker dropped on the kick's turn."""
    rows = measurements(spark, sf_dir)
    kicks = rows.where("file_idx % 2 = 0").groupBy("file_idx").agg((F.min("turn") + 3).alias("kick_turn"))
    return prepare.trim_to_kick(rows, kicks.withColumn("kick_pos", F.lit(5))).select("event_id", "file_idx", "turn", "trimmed_turn")


_GRID = f"""
WITH {MEAS}, {RING_SQL},
turns AS (SELECT DISTINCT file_idx, turn FROM meas),
grid AS (
  SELECT t.file_idx, t.turn, r.name, coalesce(m.x, 0.0) AS x, m.x IS NULL AS missing, coalesce(m.px, 0.0) AS px
  FROM turns t CROSS JOIN ring r LEFT JOIN meas m ON m.turn = t.turn AND m.name = r.name)
"""


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measurements(spark, sf_dir).withColumns({"var_x": F.lit(1.0), "var_px": F.lit(0.25)})
    return prepare.complete_grid(rows, NAMES, ["x", "px"])


@query(_GRID + "SELECT file_idx, turn, name, x, missing, px FROM grid")
def grid_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every monitor in every turn."""
    missing = ~usable_variance(F.col("var_x"))
    return completed(spark, sf_dir).select("file_idx", "turn", "name", "x", missing.alias("missing"), "px")


@query(f"""
WITH {MEAS},
last AS (
  SELECT upper(name) AS name, turn, arg_max(struct_pack(v := CASE WHEN event_id % 5 = 0 THEN NULL ELSE 1 - px END), event_id).v AS px
  FROM (SELECT event_id, name, turn // 2 AS turn, px FROM meas WHERE event_type = 'click') GROUP BY 1, 2)
SELECT m.event_id, m.turn, m.name, coalesce(u.px, m.px) AS px
FROM meas m LEFT JOIN last u ON u.name = upper(m.name) AND u.turn = m.turn
""")
def merge_update_momenta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momenta patched by later readings; the last update counts, an absent value overwrites nothing."""
    rows = measurements(spark, sf_dir)
    new = F.when(F.col("event_id") % 5 != 0, 1 - F.col("px"))
    updates = rows.where("event_type = 'click'").select("event_id", F.lower("name").alias("name"), F.expr("turn div 2").alias("turn"), new.alias("px"))
    return prepare.merge_updates(rows, updates, ["px"], "event_id").select("event_id", "turn", "name", "px")


@query(f"""
WITH {MEAS},
s AS (
  SELECT file_idx, greatest(coalesce(max(x) - min(x), 0), coalesce(max(px) - min(px), 0)) AS sx,
         greatest(coalesce(max(y) - min(y), 0), coalesce(max(py) - min(py), 0)) AS sy
  FROM meas GROUP BY file_idx)
SELECT file_idx, CASE WHEN sx > 1e-12 AND (sy <= 1e-12 OR sx >= 10 * sy) THEN 'x'
                      WHEN sy > 1e-12 AND (sx <= 1e-12 OR sy >= 10 * sx) THEN 'y' ELSE 'xy' END AS plane
FROM s
""")
def kick_plane_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane in which each file's beam was kicked."""
    return prepare.kick_planes(measurements(spark, sf_dir))


@query(f"""
WITH {MEAS},
seen AS (SELECT file_idx, name, any_value(ring_pos) AS ring_pos, min(event_id) AS seen FROM meas GROUP BY file_idx, name),
pivots AS (SELECT file_idx, arg_min(ring_pos, seen) AS p FROM seen GROUP BY file_idx)
SELECT file_idx, name, CAST(row_number() OVER (PARTITION BY file_idx ORDER BY (ring_pos - p + 16) % 16) - 1 AS INTEGER) AS col
FROM seen JOIN pivots USING (file_idx)
""")
def marker_order_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's monitors in ring order from the first one recorded."""
    rows = measurements(spark, sf_dir).select("file_idx", "name", F.col("event_id").alias("row_index"))
    return prepare.marker_order(rows, ring(spark).select("name", "ring_pos"), 16)


@query(f"""
WITH {MEAS}
SELECT event_id, turn, name, x FROM meas WHERE event_type <> 'purchase'
UNION ALL SELECT event_id, turn, 'ACD_' || event_type || '_before', NULL FROM meas WHERE event_type = 'purchase' AND mk < 8
""")
def append_marker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker rows appended under the columns of the readings."""
    rows = measurements(spark, sf_dir)
    suffix = F.when(F.col("mk") < 8, "_Before").otherwise("_other")
    markers = rows.where("event_type = 'purchase'").select(
        "event_id", "turn", F.concat(F.lit("ACD_"), "event_type", suffix).alias("name"), F.lit(1).alias("extra")
    )
    out = prepare.append_markers(rows.where("event_type <> 'purchase'").select("event_id", "turn", "name", "x"), markers)
    return out.withColumn("name", F.when(F.lower("name").endswith("_before"), F.regexp_replace("name", "_Before$", "_before")).otherwise(F.col("name")))


@query("""
SELECT conv_id, role, turn, n FROM (
  SELECT conv_id, role, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, length(text)) AS k FROM conversations)
WHERE k = 1
""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each conversation and role."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.length("text").cast("long").alias("n"))
    return prepare.first_rows(rows, ["conv_id", "role"], ["turn", "n"])


@query("""
SELECT conv_id, role, turn, n FROM (
  SELECT conv_id, role, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, length(text) DESC) AS k FROM conversations)
WHERE k = 1
""")
def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each conversation and role."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.length("text").cast("long").alias("n"))
    return prepare.last_rows(rows, ["conv_id", "role"], ["turn", "n"])


_WEIGHTED = f"""
WITH {MEAS}, {NOISE},
w AS (SELECT m.*, CASE WHEN std > 0 THEN 1.0 / (std * std) ELSE 0.0 END AS raw FROM meas m JOIN noise n ON n.name = m.name),
mean AS (SELECT name, avg(x) AS model FROM w GROUP BY name)
"""


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare.assign_variances(measurements(spark, sf_dir), noise(spark, sf_dir))
    return reductions.with_global_weights(rows)


@query(_WEIGHTED + """
SELECT w.name, round(sum(CASE WHEN x IS NOT NULL AND raw > 0 THEN raw / (SELECT max(raw) FROM w) * (x - model) * (x - model) ELSE 0 END), 4) AS chi2,
       CAST(sum(CASE WHEN x IS NOT NULL AND raw > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_points
FROM w JOIN mean USING (name) GROUP BY w.name
""")
def chi2_per_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted chi-square of each monitor's readings against its mean orbit: the flagship query."""
    rows = weighted(spark, sf_dir)
    means = measurements(spark, sf_dir).groupBy("name").agg(F.avg("x").alias("model"))
    rows = rows.join(means, "name")
    out = reductions.chi_square(rows, ["name"], F.col("x") - F.col("model"))
    return out.select("name", F.round("chi2", 4).alias("chi2"), "n_points")


@query(_WEIGHTED + "SELECT event_id, round(raw / (SELECT max(raw) FROM w), 9) AS weight FROM w")
def global_weight_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights over the largest one of the whole table."""
    return weighted(spark, sf_dir).select("event_id", F.round("weight", 9).alias("weight"))


@query(_WEIGHTED + "SELECT round(max(raw), 9) AS scale, greatest(1, count(*) FILTER (raw <> 0)) AS points FROM w")
def optics_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest weight and the number of weighted readings."""
    rows = prepare.assign_variances(measurements(spark, sf_dir), noise(spark, sf_dir))
    out = reductions.normalisation(rows.withColumn("weight", weight(F.col("variance"))))
    return out.select(F.round("scale", 9).alias("scale"), "points")
