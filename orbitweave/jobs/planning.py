"""Queries over turns, batches and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.jobs.registry import query
from orbitweave.jobs.views import MEAS, NOISE, RING_SQL, measurements, noise, ring, table
from orbitweave.operators import batches, ranges

_TURNS = f"WITH {MEAS}, turns AS (SELECT DISTINCT file_idx, bunch, turn FROM meas)"


def turns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements(spark, sf_dir).select("file_idx", "bunch", "turn").distinct()


@query(_TURNS + """
SELECT file_idx, bunch, turn FROM (
  SELECT *, row_number() OVER (PARTITION BY file_idx, bunch ORDER BY turn) AS a,
         row_number() OVER (PARTITION BY file_idx, bunch ORDER BY turn DESC) AS b FROM turns)
WHERE a > 2 AND b > 2
""")
def bunch_boundary_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without the first and last two of each bunch."""
    return batches.drop_bunch_edges(turns_of(spark, sf_dir), 2)


@query(_TURNS + " SELECT file_idx, bunch, min(turn) AS turn FROM turns GROUP BY file_idx, bunch")
def bunch_first_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of each bunch."""
    return batches.first_bunch_turns(turns_of(spark, sf_dir))


_SPLIT = _TURNS + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file_idx ORDER BY md5(CAST(turn AS VARCHAR) || ':42'), turn) AS r,
         count(*) OVER (PARTITION BY file_idx) AS n FROM turns),
held AS (SELECT *, greatest(0, least(CAST(round_even(n * 0.25, 0) AS BIGINT), n - 1)) AS h FROM ranked),
split AS (
  SELECT file_idx, bunch, turn,
         CASE WHEN r <= h THEN 'validation'
              WHEN r <= h + greatest(1, CAST(round_even((n - h) * 0.5, 0) AS BIGINT)) THEN 'training' ELSE 'unused' END AS split
  FROM held)
"""


@query(_SPLIT + "SELECT file_idx, bunch, turn, split FROM split")
def split_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each file dealt to validation and training."""
    return batches.split_turns(turns_of(spark, sf_dir), 0.25, 0.5)


@query(_SPLIT + "SELECT file_idx, split, count(*) AS n_turns FROM split GROUP BY file_idx, split")
def data_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns of each file serve what."""
    return batches.split_turns(turns_of(spark, sf_dir), 0.25, 0.5).groupBy("file_idx", "split").agg(F.count("*").alias("n_turns"))


@query(_TURNS + """,
sizes AS (SELECT file_idx, count(*) AS n_turns FROM turns GROUP BY file_idx),
ranked AS (SELECT file_idx, n_turns / CAST(k AS DOUBLE) AS p, k FROM sizes, generate_series(1, 11) g(k) WHERE k <= n_turns),
top AS (SELECT * FROM ranked ORDER BY p DESC, file_idx, k LIMIT 11)
SELECT s.file_idx, count(t.k) AS n_batches FROM sizes s LEFT JOIN top t USING (file_idx) GROUP BY s.file_idx
""")
def batch_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven batches dealt to files by their turns."""
    sizes = turns_of(spark, sf_dir).groupBy("file_idx").agg(F.count("*").alias("n_turns"))
    return batches.apportion_batches(sizes, 11)


@query(_TURNS + """,
kept AS (SELECT *, row_number() OVER (PARTITION BY file_idx ORDER BY turn) AS r, count(*) OVER (PARTITION BY file_idx) AS n FROM turns)
SELECT file_idx, turn, CAST(ntile(7) OVER (PARTITION BY file_idx ORDER BY turn) AS INTEGER) AS batch
FROM kept WHERE r <= CASE WHEN n >= 7 THEN n - n % 7 ELSE n END
""")
def batch_even_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each file, trimmed to a multiple of seven, in seven contiguous batches."""
    rows = batches.trim_to_multiple(turns_of(spark, sf_dir), 7)
    return batches.even_batches(rows, 7).select("file_idx", "turn", "batch")


@query(f"""
WITH {NOISE}, s AS (SELECT name FROM noise WHERE std = 0), e AS (SELECT name FROM noise WHERE std < 0.1)
SELECT s.name AS start, e.name AS "end", CAST(d.sdir AS INTEGER) AS sdir FROM s, e, (VALUES (1), (-1)) d(sdir) WHERE s.name <> e.name
""")
def range_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges from every start to every end, both ways."""
    names = noise(spark, sf_dir).withColumn("name", F.upper("name"))
    starts, ends = names.where("std = 0"), names.where("std < 0.1")
    return ranges.range_product(starts.select(F.col("name").alias("start")), ends.select(F.col("name").alias("end")))


@query(f"""
WITH {NOISE}
SELECT name AS start, 'BPM.09' AS "end", 1 AS sdir FROM noise WHERE std = 0 AND name <> 'BPM.09'
UNION ALL SELECT 'BPM.00', name, -1 FROM noise WHERE std < 0.1 AND name <> 'BPM.00'
""")
def range_fixed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges to a fixed end forward and from a fixed start backward."""
    names = noise(spark, sf_dir).withColumn("name", F.upper("name"))
    starts = names.where("std = 0").select(F.col("name").alias("start"))
    ends = names.where("std < 0.1").select(F.col("name").alias("end"))
    return ranges.fixed_pairs(starts, ends, "BPM.00", "BPM.09")


_RANGES = "ranges AS (SELECT * FROM (VALUES (0, 'BPM.02', 'BPM.09', 1), (1, 'BPM.09', 'BPM.02', 1), (2, 'BPM.13', 'BPM.04', -1)) r(range_id, s, e, sdir))"
_POINTS = _RANGES + """,
points AS (
  SELECT range_id, sdir, ring.name, ring.ring_pos,
         CASE WHEN sdir > 0 THEN (ring.ring_pos - a.ring_pos + 16) % 16
              ELSE (b.ring_pos - a.ring_pos + 16) % 16 - (ring.ring_pos - a.ring_pos + 16) % 16 END AS point
  FROM ranges JOIN ring a ON a.name = s JOIN ring b ON b.name = e
  JOIN ring ON (ring.ring_pos BETWEEN a.ring_pos AND b.ring_pos)
            OR (b.ring_pos < a.ring_pos AND (ring.ring_pos >= a.ring_pos OR ring.ring_pos <= b.ring_pos)))"""


def three_ranges(spark: SparkSession) -> DataFrame:
    rows = [(0, "BPM.02", "BPM.09", 1), (1, "BPM.09", "BPM.02", 1), (2, "BPM.13", "BPM.04", -1)]
    each = (F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("range_id", "start", "end", "sdir"), strict=True))) for r in rows)
    return spark.range(1).select(F.inline(F.array(*each)))


@query(f"""
WITH {MEAS}, {RING_SQL}, {_POINTS}
SELECT range_id, p.name, CAST(point AS INTEGER) AS point, count(m.x) AS n_readings, round(sum(m.x), 4) AS total
FROM points p LEFT JOIN meas m USING (name) GROUP BY range_id, p.name, point
""")
def circular_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the monitors of three ranges, two of them over the seam of the ring."""
    points = ranges.range_points(three_ranges(spark), ring(spark).select("name", "ring_pos"), 16)
    sums = measurements(spark, sf_dir).groupBy("name").agg(F.count("x").alias("n_readings"), F.sum("x").alias("total"))
    out = points.join(sums, "name", "left")
    return out.select("range_id", "name", F.col("point").cast("int").alias("point"), F.coalesce("n_readings", F.lit(0)).alias("n_readings"), F.round("total", 4).alias("total"))


@query(f"""
WITH {NOISE}, {RING_SQL},
r AS (SELECT a.name AS s, b.name AS e, a.ring_pos AS sp, b.ring_pos AS ep FROM noise n JOIN ring a ON a.name = n.name JOIN ring b ON a.name <> b.name WHERE n.std < 0.1),
m AS (SELECT (SELECT ring_pos FROM ring WHERE name = 'BPM.06') AS bp, (SELECT ring_pos FROM ring WHERE name = 'BPM.11') AS ap),
c AS (SELECT s, e, (bp BETWEEN sp AND ep OR (ep < sp AND (bp >= sp OR bp <= ep))) AND (ap BETWEEN sp AND ep OR (ep < sp AND (ap >= sp OR ap <= ep))) AS x FROM r, m)
SELECT DISTINCT CASE WHEN x THEN e ELSE s END AS start, CASE WHEN x THEN s ELSE e END AS "end", 1 AS sdir FROM c
""")
def acd_reroute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges over the exciter turned round, each kept once."""
    names = ring(spark).select("name", "ring_pos")
    starts = noise(spark, sf_dir).where("std < 0.1").select(F.upper("name").alias("start"))
    each = ranges.range_product(starts, names.select(F.col("name").alias("end"))).where("sdir = 1")
    return ranges.reroute(each, names, "BPM.06", "BPM.11")


def offset_points(spark: SparkSession) -> DataFrame:
    points = ranges.range_points(three_ranges(spark), ring(spark), 16)
    return ranges.turn_offsets(points.select("range_id", "sdir", "name", "col", "point"))


_OFFSETS = _POINTS + """,
offsets AS (
  SELECT *, CAST(coalesce(sum(w) OVER (PARTITION BY range_id ORDER BY point), 0) * sdir AS BIGINT) AS "offset" FROM (
    SELECT *, CASE WHEN (sdir > 0 AND ring_pos < lag(ring_pos) OVER o) OR (sdir < 0 AND ring_pos > lag(ring_pos) OVER o) THEN 1 ELSE 0 END AS w
    FROM points WINDOW o AS (PARTITION BY range_id ORDER BY point)))"""


@query(f'WITH {RING_SQL}, {_OFFSETS} SELECT range_id, name, CAST(point AS INTEGER) AS point, "offset" FROM offsets')
def wrap_turn_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by which each point of a range is ahead of or behind its start, for monitors that the table has."""
    seen = measurements(spark, sf_dir).select("name").distinct()
    out = offset_points(spark).join(seen, "name", "left_semi")
    return out.select("range_id", "name", F.col("point").cast("int").alias("point"), F.col("offset").cast("long").alias("offset"))


@query(f"""
WITH {MEAS}, {RING_SQL}, {_OFFSETS},
starts AS (SELECT DISTINCT file_idx, turn, CAST(turn % 3 AS INTEGER) AS range_id FROM meas WHERE turn % 200 BETWEEN 2 AND 197)
SELECT s.file_idx, s.turn AS start_turn, s.range_id, CAST(point AS INTEGER) AS point, o.name, m.x, coalesce(m.event_id, -1) AS event_id
FROM starts s JOIN offsets o USING (range_id) LEFT JOIN meas m ON m.turn = s.turn + o."offset" AND m.name = o.name AND m.file_idx = s.file_idx
""")
def wrap_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings along a range from each start turn, over the seam into the next or the last turn."""
    rows = measurements(spark, sf_dir)
    starts = rows.where("turn % 200 between 2 and 197").select("file_idx", "turn", (F.col("turn") % 3).cast("int").alias("range_id")).distinct()
    points = offset_points(spark).select("range_id", "name", "point", "offset")
    out = ranges.gather(starts, points, rows.select("file_idx", "turn", "name", "x", "event_id"))
    return out.select("file_idx", "start_turn", "range_id", F.col("point").cast("int").alias("point"), "name", "x", F.coalesce("event_id", F.lit(-1)).alias("event_id"))


@query(f"""
WITH {MEAS}
SELECT file_idx, count(DISTINCT turn) AS n_turns, count(DISTINCT name) AS n_monitors, count(*) AS n_rows,
       count(*) - count(x) AS n_missing, count(DISTINCT turn) * 2 AS n_tracked
FROM meas GROUP BY file_idx
""")
def file_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file contributes."""
    turns = F.countDistinct("turn")
    return measurements(spark, sf_dir).groupBy("file_idx").agg(
        turns.alias("n_turns"), F.countDistinct("name").alias("n_monitors"), F.count("*").alias("n_rows"),
        (F.count("*") - F.count("x")).alias("n_missing"), (turns * 2).alias("n_tracked"),
    )


@query("""
SELECT o_custkey AS name, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY o_custkey
""")
def state_layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of layered values of each name."""
    from orbitweave.operators.machine import layer_states

    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("prio"), F.col("o_totalprice").alias("value"))
    return layer_states(rows)
