"""Queries over tracking plans, weights of active observables, and series on shared references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbitweave.functions.missing import usable_variance
from orbitweave.jobs.registry import query
from orbitweave.jobs.views import MEAS, MONITORS, NAMES, NOISE, RING_SQL, measurements, noise, ring, table
from orbitweave.operators import batches, plans, ranges, reductions
from orbitweave.sources.shared_tables import written

#: Least share of turns with a reading, in a hundred, of a good monitor; and the plan's points.
GOOD = 56
STARTS, ENDS, WINDOW = ("BPM.00", "BPM.03", "BPM.08"), ("BPM.05", "BPM.11", "BPM.14"), "BPM.05/BPM.12"
WORKERS, BATCHES = 24, 4

_POINTS = f"""
WITH {MEAS}, {RING_SQL},
turns AS (SELECT DISTINCT file_idx, bunch, turn FROM meas),
files AS (SELECT file_idx, count(DISTINCT turn) AS n_turns FROM meas GROUP BY file_idx),
counts AS (SELECT file_idx, name, count(x) AS n FROM meas GROUP BY file_idx, name),
points AS (
  SELECT f.file_idx, r.name, r.ring_pos, f.n_turns, coalesce(c.n, 0) AS n, 100 * coalesce(c.n, 0) >= {GOOD} * f.n_turns AS good
  FROM files f CROSS JOIN ring r LEFT JOIN counts c ON c.file_idx = f.file_idx AND c.name = r.name),
good AS (SELECT * FROM points WHERE good),
window_of AS (
  SELECT file_idx, coalesce(max(name) FILTER (name = 'BPM.05'), arg_min(name, ring_pos)) AS start,
         coalesce(max(name) FILTER (name = 'BPM.12'), arg_min(name, ring_pos)) AS "end"
  FROM good GROUP BY file_idx),
pairs AS (
  SELECT s.file_idx, s.name AS start, e.name AS "end", s.ring_pos AS sp, e.ring_pos AS ep
  FROM good s JOIN good e ON e.file_idx = s.file_idx AND e.name <> s.name
  WHERE s.name IN {STARTS} AND e.name IN {ENDS})
"""


def points_of(spark: SparkSession, sf_dir: str, reading: str = "x", percent: int = GOOD) -> DataFrame:
    """All monitors of all files with their ring position and whether they are good."""
    found = plans.observed_points(measurements(spark, sf_dir), NAMES, percent, reading)
    return found.join(ring(spark).select("name", "ring_pos"), "name")


def planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(points, turns) of all files from one reading of the measurements: a row per turn is written, points from it."""
    summary = written(plans.turn_summary(measurements(spark, sf_dir), "x"), "plan-turns")
    points = plans.summary_points(summary, NAMES, GOOD).join(ring(spark).select("name", "ring_pos"), "name")
    return written(points, "plan-points"), summary.select("file_idx", "bunch", "turn")


@query(_POINTS + "SELECT file_idx, name, n_turns, n, good FROM points")
def observed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which monitors of the model a file has enough readings of; the others are bad there."""
    return points_of(spark, sf_dir).select("file_idx", "name", "n_turns", "n", "good")


@query(_POINTS + 'SELECT file_idx, start, "end" FROM window_of')
def range_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed window's points in each file, or the file's first point where they are bad."""
    return plans.resolve_window(points_of(spark, sf_dir).where("good"), WINDOW)


_BATCHES = f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file_idx, bunch ORDER BY turn) AS a,
         row_number() OVER (PARTITION BY file_idx, bunch ORDER BY turn DESC) AS b FROM turns),
dealt AS (SELECT file_idx, turn, ntile({BATCHES}) OVER (PARTITION BY file_idx ORDER BY turn) AS batch FROM (SELECT DISTINCT file_idx, turn FROM ranked WHERE a > 2 AND b > 2)),
spans AS (SELECT file_idx, batch, count(*) AS n_turns, min(turn) AS first_turn FROM dealt GROUP BY file_idx, batch)
"""


@query(_POINTS + _BATCHES + """
SELECT p.file_idx, CAST(s.batch AS INTEGER) AS batch, p.start, p."end", CAST(d.sdir AS INTEGER) AS sdir, s.n_turns, s.first_turn,
       CAST((ep - sp + 16) % 16 + 1 AS INTEGER) AS n_points,
       (SELECT count(*) FROM good g WHERE g.file_idx = p.file_idx AND (g.ring_pos - sp + 16) % 16 <= (ep - sp + 16) % 16) AS n_observed
FROM pairs p JOIN spans s ON s.file_idx = p.file_idx CROSS JOIN (VALUES (1), (-1)) d(sdir)
""")
def arc_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of an arc-by-arc fit: every batch of turns of a file with every range between its good points, both ways."""
    points, turns = planned(spark, sf_dir)
    good = points.where("good")
    pairs = plans.with_point_counts(plans.file_ranges(good, STARTS, ENDS), good, MONITORS)
    spans = plans.batch_spans(batches.drop_bunch_edges(turns, 2), BATCHES)
    both = pairs.withColumn("sdir", F.explode(F.array(F.lit(1), F.lit(-1))))
    return spans.join(both, "file_idx").select("file_idx", "batch", "start", "end", "sdir", "n_turns", "first_turn", F.col("n_points").cast("int").alias("n_points"), "n_observed")


@query(_POINTS + f"""
SELECT f.file_idx, count(p.start) * 2 AS n_specs, any_value(f.n_turns) AS n_turns,
       least(any_value(f.n_turns), greatest(1, {WORKERS} // greatest(count(p.start) * 2, 1))) AS n_workers
FROM files f LEFT JOIN pairs p ON p.file_idx = f.file_idx GROUP BY f.file_idx
""")
def plan_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ranges a file has and how many workers each of them gets."""
    points = points_of(spark, sf_dir)
    pairs = plans.file_ranges(points.where("good"), STARTS, ENDS).groupBy("file_idx").agg((F.count("*") * 2).alias("n_specs"))
    files = points.select("file_idx", "n_turns").distinct().join(pairs, "file_idx", "left")
    return plans.worker_counts(files.select("file_idx", F.coalesce("n_specs", F.lit(0)).alias("n_specs"), "n_turns"), WORKERS)


@query(_POINTS + """,
rows_of AS (
  SELECT g.file_idx, w.start, g.name, row_number() OVER (PARTITION BY g.file_idx ORDER BY (g.ring_pos - s.ring_pos + 16) % 16) - 1 AS point
  FROM good g JOIN window_of w ON w.file_idx = g.file_idx JOIN ring s ON s.name = w.start),
last AS (SELECT file_idx, arg_max(name, point) AS "end" FROM rows_of GROUP BY file_idx),
firsts AS (SELECT file_idx, bunch, min(turn) AS turn FROM turns GROUP BY file_idx, bunch)
SELECT r.file_idx, f.bunch, f.turn, r.start, l."end", CAST(r.point AS INTEGER) AS point, r.name
FROM rows_of r JOIN last l USING (file_idx) JOIN firsts f USING (file_idx)
""")
def kicker_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of a kicker fit: the whole ring from a file's start, at the first turn of each bunch."""
    points, turns = planned(spark, sf_dir)
    good = points.where("good").select("file_idx", "name", "ring_pos")
    whole = plans.whole_ring(good, plans.resolve_window(good, WINDOW), MONITORS)
    firsts = batches.first_bunch_turns(turns)
    return whole.join(firsts, "file_idx").select("file_idx", "bunch", "turn", "start", "end", "point", "name")


@query(_POINTS + """
SELECT file_idx, CAST(sdir AS INTEGER) AS sdir, d.start, g.name, g.n,
       CAST(row_number() OVER (PARTITION BY file_idx, sdir ORDER BY CASE WHEN sdir > 0 THEN (g.ring_pos - m.ring_pos + 16) % 16 ELSE (m.ring_pos - g.ring_pos + 16) % 16 END) - 1 AS INTEGER) AS point
FROM good g CROSS JOIN (VALUES (1, 'BPM.06'), (-1, 'BPM.11')) d(sdir, start) JOIN ring m ON m.name = d.start
WHERE g.name NOT IN ('BPM.06', 'BPM.11')
""")
def exciter_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of an exciter fit, forward and backward from its two markers, which are not observed themselves."""
    good = points_of(spark, sf_dir).where("good").select("file_idx", "name", "ring_pos", "n")
    return plans.from_markers(good, ring(spark), "BPM.06", "BPM.11", MONITORS).select("file_idx", "sdir", "start", "name", "n", "point")


@query(_POINTS + """,
m AS (SELECT (SELECT ring_pos FROM ring WHERE name = 'BPM.06') AS bp, (SELECT ring_pos FROM ring WHERE name = 'BPM.11') AS ap),
c AS (
  SELECT file_idx, start, "end", (bp BETWEEN sp AND ep OR (ep < sp AND (bp >= sp OR bp <= ep))) AND (ap BETWEEN sp AND ep OR (ep < sp AND (ap >= sp OR ap <= ep))) AS x
  FROM pairs, m)
SELECT DISTINCT file_idx, CASE WHEN x THEN "end" ELSE start END AS start, CASE WHEN x THEN start ELSE "end" END AS "end", 1 AS sdir FROM c
""")
def exciter_arc_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of each file, those over the exciter turned round."""
    pairs = plans.file_ranges(points_of(spark, sf_dir).where("good"), STARTS, ENDS)
    each = pairs.select("file_idx", "start", "end", F.lit(1).alias("sdir"))
    return ranges.reroute(each, ring(spark).select("name", "ring_pos"), "BPM.06", "BPM.11", keys=["file_idx"])


@query(f"""
WITH {MEAS}, {RING_SQL},
files AS (SELECT file_idx, count(DISTINCT turn) AS n_turns FROM meas GROUP BY file_idx),
counts AS (SELECT file_idx, mk, count(x) AS nx, count(y) AS ny FROM meas GROUP BY file_idx, mk),
planes AS (
  SELECT f.file_idx, p.plane, k.mk,
         CASE p.plane WHEN 'x' THEN k.mk % 3 <> 2 AND 100 * coalesce(nx, 0) >= {GOOD} * n_turns ELSE k.mk % 3 <> 1 AND 100 * coalesce(ny, 0) >= 78 * n_turns END AS good
  FROM files f CROSS JOIN (VALUES ('x'), ('y')) p(plane) CROSS JOIN generate_series(0, 15) k(mk) LEFT JOIN counts c ON c.file_idx = f.file_idx AND c.mk = k.mk)
SELECT file_idx, plane, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad,
       bool_or(good AND mk = 3) AND count(*) FILTER (good) >= 2 AS kept
FROM planes GROUP BY file_idx, plane
""")
def plane_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers of single planes: monitors blind in a plane are bad there, and without its first marker a worker is dropped."""
    number = F.substring("name", 5, 2).cast("int")
    planes = [points_of(spark, sf_dir, r, p).select("file_idx", F.lit(r).alias("plane"), "name", (F.col("good") & (number % 3 != blind)).alias("good")) for r, p, blind in (("x", GOOD, 2), ("y", 78, 1))]
    has_first = F.bool_or(F.col("good") & (F.col("name") == "BPM.03"))
    return planes[0].unionAll(planes[1]).groupBy("file_idx", "plane").agg(
        F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"), (has_first & (F.count_if("good") >= 2)).alias("kept")
    )


#: Observables: reading, standard deviation over that of the noise table, and whether a fit without momenta uses it.
OBSERVABLES = (("x", 1.0, True), ("y", 2.0, True), ("px", 0.25, False), ("py", 0.5, False))


@query(f"""
WITH {MEAS}, {NOISE},
observables AS (SELECT * FROM (VALUES {", ".join(f"('{o}', CAST({f} AS DOUBLE), {a})" for o, f, a in OBSERVABLES)}) o(observable, factor, active)),
raw AS (
  SELECT n.name, observable, active, CASE WHEN std > 0 THEN 1.0 / (std * factor * (std * factor)) ELSE 0.0 END AS raw FROM noise n CROSS JOIN observables),
scale AS (SELECT max(raw) AS scale FROM raw WHERE active),
readings AS (SELECT name, count(x) AS nx, count(y) AS ny, count(px) AS npx, count(py) AS npy FROM meas GROUP BY name)
SELECT name, observable, active, round(raw / CASE WHEN scale > 0 THEN scale ELSE 1.0 END, 9) AS weight,
       CASE observable WHEN 'x' THEN nx WHEN 'y' THEN ny WHEN 'px' THEN npx ELSE npy END AS n
FROM raw JOIN readings USING (name), scale
""")
def active_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights over the largest one of the active observables; inactive ones are on the same scale."""
    kinds = F.array(*(F.struct(F.lit(o).alias("observable"), F.lit(f).alias("factor"), F.lit(a).alias("active")) for o, f, a in OBSERVABLES))
    counts = measurements(spark, sf_dir).groupBy("name").agg(*(F.count(o).alias(o) for o, _, _ in OBSERVABLES))
    stds = noise(spark, sf_dir).withColumn("name", F.upper("name")).join(counts, "name")
    each = stds.select("*", F.inline(kinds))
    std = F.col("std") * F.col("factor")
    n = F.coalesce(*(F.when(F.col("observable") == o, F.col(o)) for o, _, _ in OBSERVABLES))
    each = each.select("name", "observable", "active", (std * std).alias("variance"), n.alias("n"))
    out = reductions.with_global_weights(each, active=F.col("active"))
    return out.select("name", "observable", "active", F.round("weight", 9).alias("weight"), "n")


@query(_POINTS + f""",
{NOISE},
used AS (
  SELECT m.file_idx, m.x, CASE WHEN n.std > 0 AND p.good THEN 1.0 / (n.std * n.std) ELSE 0.0 END AS w
  FROM meas m JOIN noise n ON n.name = m.name JOIN points p ON p.file_idx = m.file_idx AND p.name = m.name WHERE m.x IS NOT NULL)
SELECT file_idx, count(*) FILTER (w > 0) AS n_kept, round(sum(w * x * x) / (2 * greatest(count(*) FILTER (w > 0), 1)), 5) AS loss,
       round(sum(2 * w * x) / greatest(count(*) FILTER (w > 0), 1), 5) AS grad
FROM used GROUP BY file_idx
""")
def kept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and gradient of each file over the readings that its mask keeps, by their number and two particles."""
    rows = measurements(spark, sf_dir).where("x is not null").select("file_idx", "name", "x")
    rows = rows.join(noise(spark, sf_dir).select(F.upper("name").alias("name"), (F.col("std") * F.col("std")).alias("variance")), "name")
    mask = points_of(spark, sf_dir).select("file_idx", "name", "good")
    w = F.when(usable_variance(F.col("variance")) & F.col("good"), 1.0 / F.col("variance")).otherwise(0.0)
    out = reductions.kept_sums(rows.join(mask, ["file_idx", "name"]).withColumn("w", w), ["file_idx"], F.col("x"), "w", particles=2)
    return out.select("file_idx", "n_kept", F.round("loss", 5).alias("loss"), F.round("grad", 5).alias("grad"))


_MEANS = f"""
WITH {MEAS},
means AS (
  SELECT file_idx, name, CAST(sum(CAST(x AS DECIMAL(24, 4))) AS DOUBLE) / count(x) AS x, CAST(sum(CAST(y AS DECIMAL(24, 4))) AS DOUBLE) / count(y) AS y
  FROM meas GROUP BY file_idx, name)
"""


def file_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = reductions.exact_mean(4)
    return measurements(spark, sf_dir).groupBy("file_idx", "name").agg(mean("x").alias("x"), mean("y").alias("y"))


@query(_MEANS + """
SELECT s.file_idx, s.name, p.plane, CASE p.plane WHEN 'x' THEN s.x - r.x ELSE s.y END AS residual
FROM means s JOIN means r ON r.file_idx = 0 AND r.name = s.name CROSS JOIN (VALUES ('x'), ('y')) p(plane) WHERE s.file_idx > 0
""")
def relative_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean orbits of files against the first one's, which is taken off in the relative plane x and not in the absolute plane y."""
    means = file_means(spark, sf_dir)
    reference = means.where("file_idx = 0").drop("file_idx")
    rows = reductions.against_reference(means.where("file_idx > 0"), reference, ["name"], {"x": True, "y": False})
    return rows.select("file_idx", "name", "plane", "residual")


@query(_MEANS + """
SELECT coalesce(a.name, b.name) AS name, a.x AS before, b.x AS after
FROM (SELECT * FROM means WHERE file_idx = 0 AND x > 47) a FULL JOIN (SELECT * FROM means WHERE file_idx = 1 AND x > 47) b ON a.name = b.name
""")
def outer_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two files side by side, null where one has none."""
    means = file_means(spark, sf_dir).where("x > 47")
    before, after = (means.where(F.col("file_idx") == k).select("name", F.col("x").alias(c)) for k, c in ((0, "before"), (1, "after")))
    return before.join(after, "name", "full")


@query(_POINTS + """
SELECT file_idx, count(*) AS n_targets, max(ring_pos) - min(ring_pos) + 1 = count(*) AS contiguous, arg_min(name, ring_pos) AS first, arg_max(name, ring_pos) AS last
FROM good GROUP BY file_idx
""")
def series_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's good monitors in the model's order, and whether none between them is missing."""
    return plans.contiguous(points_of(spark, sf_dir).where("good"), ["file_idx"], F.col("ring_pos"))


@query(f"WITH {MEAS} SELECT name, arg_min(x, turn) AS value, arg_min(file_idx, turn) AS file_idx FROM meas WHERE x IS NOT NULL GROUP BY name")
def first_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value of each monitor over files and turns that is there."""
    order = F.struct("file_idx", "turn")
    return measurements(spark, sf_dir).where("x is not null").groupBy("name").agg(F.min_by("x", order).alias("value"), F.min_by("file_idx", order).alias("file_idx"))


@query(_POINTS + f""", {NOISE}
SELECT p.file_idx, p.name, round(sum(p.n * n.std * n.std) OVER (PARTITION BY p.file_idx ORDER BY p.ring_pos), 6) AS total
FROM points p JOIN noise n ON n.name = p.name
""")
def running_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variances of all readings summed along the ring."""
    stds = noise(spark, sf_dir).select(F.upper("name").alias("name"), "std")
    along = W.partitionBy("file_idx").orderBy("ring_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum(F.col("n") * F.col("std") * F.col("std")).over(along)
    return points_of(spark, sf_dir).join(stds, "name").select("file_idx", "name", F.round(total, 6).alias("total"))


@query(f"""
WITH {MEAS}, b AS (SELECT file_idx, turn, arg_min(bunch, event_id) AS bunch FROM meas GROUP BY file_idx, turn)
SELECT file_idx, bunch, count(*) AS n_turns, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM b GROUP BY file_idx, bunch
""")
def bunch_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each bunch."""
    out = plans.bunch_turns(measurements(spark, sf_dir), "event_id")
    return out.select("file_idx", "bunch", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t.cast("string")), ",").alias("turns"))


@query(f"""
WITH {MEAS}, s AS (SELECT file_idx, min(turn) AS first_turn, max(turn) AS last_turn FROM meas GROUP BY file_idx),
o AS (SELECT *, CAST(coalesce(sum(last_turn - first_turn + 1) OVER (ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_start FROM s)
SELECT *, block_start + last_turn - first_turn + 1 AS block_end FROM o
""")
def turn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's block of turns on one axis."""
    return plans.turn_blocks(measurements(spark, sf_dir))


@query(f"""
WITH {MEAS}, f AS (SELECT file_idx, count(DISTINCT turn) AS n_turns FROM meas GROUP BY file_idx),
c AS (SELECT greatest(1, least(40, min(n_turns))) AS n_batches FROM f)
SELECT file_idx, n_turns, CAST(n_batches AS INTEGER) AS n_batches, CAST(list_max(list_filter(generate_series(1, n_batches), lambda d: n_turns % d = 0)) AS INTEGER) AS n_validation FROM f, c
""")
def batch_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches for training and, without leaving out a turn, for validation."""
    return plans.clamp_batches(measurements(spark, sf_dir).groupBy("file_idx").agg(F.count_distinct("turn").alias("n_turns")), 40)


@query("""
SELECT o_custkey, sha256(string_agg(lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '=' || CAST(o_orderstatus AS VARCHAR), chr(10) ORDER BY o_orderkey)) AS content
FROM orders GROUP BY o_custkey
""")
def knob_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each group's names and values that is the same for equal contents."""
    name = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    return plans.content_hash(table(spark, sf_dir, "orders"), ["o_custkey"], name, F.col("o_orderstatus"))
