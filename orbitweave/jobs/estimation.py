"""Queries over reductions, screening, gains and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.functions.names import family, result_name
from orbitweave.functions.schedules import learning_rate
from orbitweave.jobs.registry import query
from orbitweave.jobs.views import JAC, JAC_ALL, MEAS, STEPS, jacobians, measurements, steps, table
from orbitweave.operators import history, machine, orbit, reductions, screening


@query(f"""
WITH {JAC_ALL}
SELECT CAST(k - 1 AS INTEGER) AS k, round(sum(2.0 * w * (-target) * j[k]), 6) AS grad FROM (SELECT *, unnest(generate_series(1, len(j))) AS k FROM jac) GROUP BY k
""")
def gradient_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the weighted loss at zero knobs."""
    return reductions.gradient(jacobians(spark, sf_dir, None), "jac", -F.col("target")).select("k", F.round("grad", 6).alias("grad"))


@query(f"""
WITH {JAC_ALL},
l AS (SELECT vec_id, w, j, unnest(generate_series(1, len(j))) AS a FROM jac WHERE w > 0),
p AS (SELECT a, w * j[a] AS wj, j, unnest(generate_series(1, a)) AS b FROM l)
SELECT CAST(a - 1 AS INTEGER) AS a, CAST(b - 1 AS INTEGER) AS b, round(sum(wj * j[b]), 5) AS value FROM p GROUP BY a, b
""")
def normal_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower triangle of the normal matrix of all knobs."""
    return reductions.normal_matrix(jacobians(spark, sf_dir, None), "jac").select("a", "b", F.round("value", 5).alias("value"))


_MERGED = f"""
WITH {JAC},
merged AS (
  SELECT vec_id // 3 AS reading_id, sum(-w * j[1]) AS g0, sum(-w * j[2]) AS g1,
         max(CASE WHEN (vec_id // 3) % 11 = 0 THEN CAST('infinity' AS DOUBLE) ELSE 0.25 END) AS variance
  FROM jac GROUP BY vec_id // 3)
"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jacobians(spark, sf_dir).withColumn("reading_id", F.expr("vec_id div 3"))
    parts = rows.select(
        "reading_id", F.transform(F.slice("jac", 1, 2), lambda x: -F.col("weight") * x).alias("g"),
        F.when(F.col("reading_id") % 11 == 0, float("inf")).otherwise(0.25).alias("variance"),
    )
    return reductions.merge_readings(parts)


@query(_MERGED + "SELECT reading_id, round(g0, 9) AS g0, round(g1, 9) AS g1, isinf(variance) AS excluded FROM merged")
def reading_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivities of readings that several workers share."""
    out = merged(spark, sf_dir)
    return out.select(
        "reading_id", F.round(F.col("g")[0], 9).alias("g0"), F.round(F.col("g")[1], 9).alias("g1"), (F.col("variance") == float("inf")).alias("excluded")
    )


@query(_MERGED + """
SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(sum(CASE WHEN isinf(variance) THEN 0 ELSE variance END * (CASE a WHEN 0 THEN g0 ELSE g1 END) * (CASE b WHEN 0 THEN g0 ELSE g1 END)), 6) AS value
FROM merged, (VALUES (0, 0), (1, 0), (1, 1)) p(a, b) GROUP BY a, b
""")
def noise_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise matrix from merged sensitivities."""
    return reductions.noise_matrix(merged(spark, sf_dir)).select("a", "b", F.round("value", 6).alias("value"))


@query("""
SELECT event_type, round(sum(CASE WHEN event_id % 10 <> 0 AND event_id % 7 <> 0 THEN value ELSE 0 END), 4) AS loss,
       round(sum(CASE WHEN event_id % 10 <> 0 AND event_id % 7 <> 0 THEN value * 2 ELSE 0 END), 4) AS grad,
       CAST(sum(CASE WHEN event_id % 10 <> 0 AND event_id % 7 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid,
       bool_or(event_id % 10 = 0) AS lost
FROM events GROUP BY event_type
""")
def reply_reduction_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over replies, some lost (NaN) and some disabled (null)."""
    loss = F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select("event_type", loss.alias("loss"), (F.col("value") * 2).alias("grad"))
    out = reductions.reduce_replies(rows, ["loss", "grad"], ["event_type"])
    return out.select("event_type", F.round("loss", 4).alias("loss"), F.round("grad", 4).alias("grad"), "n_valid", "lost")


_DIAG = """
WITH diag AS (
  SELECT l_suppkey % 10 AS worker_id, l_partkey % 50 AS name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS loss
  FROM lineitem GROUP BY 1, 2),
z AS (
  SELECT worker_id, name, loss, (loss - avg(loss) OVER w) / nullif(stddev_pop(loss) OVER w, 0) AS raw FROM diag WINDOW w AS (PARTITION BY worker_id)),
masks AS (SELECT worker_id, name, loss, greatest(coalesce(raw, 0), 0) AS z FROM z)
"""


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    loss = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return rows.groupBy((F.col("l_suppkey") % 10).alias("worker_id"), (F.col("l_partkey") % 50).alias("name")).agg(loss.alias("loss"))


@query(_DIAG + "SELECT worker_id, name, round(z, 6) AS z, z <= 1.5 AS keep FROM masks")
def monitor_zscore_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitors whose loss stands out within their worker."""
    out = screening.with_z(diagnostics(spark, sf_dir), "loss", ["worker_id"])
    return out.select("worker_id", "name", F.round("z", 6).alias("z"), (F.col("z") <= 1.5).alias("keep"))


@query(_DIAG + """,
totals AS (SELECT worker_id, sum(loss) AS total FROM diag GROUP BY worker_id),
t AS (SELECT worker_id, total, (total - avg(total) OVER ()) / nullif(stddev_pop(total) OVER (), 0) AS raw FROM totals)
SELECT worker_id, round(total, 2) AS total, greatest(coalesce(raw, 0), 0) > 1.0 AS disabled FROM t
""")
def worker_disable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers whose total loss stands out among all."""
    totals = diagnostics(spark, sf_dir).groupBy("worker_id").agg(F.sum("loss").alias("total"))
    return screening.with_z(totals, "total").select("worker_id", F.round("total", 2).alias("total"), (F.col("z") > 1.0).alias("disabled"))


@query(_DIAG + """,
training AS (
  SELECT worker_id % 2 AS file_idx, worker_id % 5 AS range_id, worker_id % 3 = 0 AS disabled,
         list(CAST(name AS VARCHAR)) FILTER (z > 1.5) AS dropped
  FROM masks GROUP BY worker_id),
flat AS (SELECT file_idx, range_id, disabled, unnest(coalesce(dropped, [])) AS d FROM training),
e AS (SELECT t.file_idx, t.range_id, bool_and(t.disabled) AS disabled FROM training t GROUP BY 1, 2),
ed AS (SELECT file_idx, range_id, list_sort(list(DISTINCT d)) AS dropped FROM flat WHERE NOT disabled GROUP BY 1, 2),
f AS (SELECT range_id, bool_and(disabled) AS disabled FROM training GROUP BY 1),
fd AS (SELECT range_id, list_sort(list(DISTINCT d)) AS dropped FROM flat WHERE NOT disabled GROUP BY 1),
validation AS (SELECT DISTINCT s_suppkey % 4 AS file_idx, s_suppkey % 7 AS range_id FROM supplier)
SELECT v.file_idx, v.range_id,
       CASE WHEN e.disabled IS NOT NULL THEN coalesce(array_to_string(ed.dropped, ','), '')
            WHEN f.disabled IS NOT NULL THEN coalesce(array_to_string(fd.dropped, ','), '') ELSE '' END AS dropped,
       coalesce(e.disabled, f.disabled, false) AS disabled,
       CASE WHEN e.disabled IS NOT NULL THEN 'exact' WHEN f.disabled IS NOT NULL THEN 'fallback' ELSE 'none' END AS matched
FROM validation v LEFT JOIN e USING (file_idx, range_id) LEFT JOIN ed USING (file_idx, range_id)
LEFT JOIN f ON f.range_id = v.range_id LEFT JOIN fd ON fd.range_id = v.range_id
""")
def screening_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training masks applied to validation workers by exact or fallback key."""
    masks = screening.with_z(diagnostics(spark, sf_dir), "loss", ["worker_id"])
    names = F.collect_list(F.when(F.col("z") > 1.5, F.col("name").cast("string")))  # nulls are not collected
    training = masks.groupBy("worker_id").agg(names.alias("dropped")).select(
        (F.col("worker_id") % 2).alias("file_idx"), (F.col("worker_id") % 5).alias("range_id"), "dropped", (F.col("worker_id") % 3 == 0).alias("disabled")
    )
    validation = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4).alias("file_idx"), (F.col("s_suppkey") % 7).alias("range_id")).distinct()
    out = screening.carry_over(training, validation, ["file_idx", "range_id"], ["range_id"])
    return out.withColumn("dropped", F.array_join("dropped", ","))


@query(_DIAG + """
SELECT round(sum(loss), 2) AS before, round(sum(CASE WHEN z <= 1.5 THEN loss ELSE 0 END), 2) AS after, count(DISTINCT worker_id) AS n_workers,
       round(100.0 * (sum(loss) - sum(CASE WHEN z <= 1.5 THEN loss ELSE 0 END)) / sum(loss), 6) AS reduction
FROM masks
""")
def screening_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss before and after masking."""
    rows = screening.with_z(diagnostics(spark, sf_dir), "loss", ["worker_id"]).withColumn("keep", F.col("z") <= 1.5)
    out = screening.screening_totals(rows)
    return out.select(F.round("before", 2).alias("before"), F.round("after", 2).alias("after"), "n_workers", F.round("reduction", 6).alias("reduction"))


@query(f"""
WITH {MEAS}
SELECT name, round(coalesce(sum(px * (coalesce(x, px) - px)) / nullif(sum(px * px) + 10.0 / 4, 0), 0), 9) AS gain FROM meas GROUP BY name
""")
def gain_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best gain of each monitor under a ridge."""
    rows = measurements(spark, sf_dir).withColumn("weight", F.lit(1.0))
    out = reductions.gains(rows, ["name"], F.col("px"), F.coalesce("x", "px"), ridge=10.0, batches=4)
    return out.select("name", F.round("gain", 9).alias("gain"))


@query("""
WITH s AS (SELECT l_returnflag AS f, l_suppkey AS name, avg(l_extendedprice) AS v, avg(l_discount) AS e FROM lineitem GROUP BY 1, 2)
SELECT a.name, round(a.v - b.v, 4) AS value, round(sqrt(a.e * a.e + b.e * b.e), 9) AS error FROM s a JOIN s b USING (name) WHERE a.f = 'R' AND b.f = 'N'
""")
def difference_orbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal orbit less reference orbit of the same monitors."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_suppkey").alias("name")).agg(
        F.avg("l_extendedprice").alias("value"), F.avg("l_discount").alias("error")
    )
    signal = sums.where("l_returnflag = 'R'").drop("l_returnflag")
    reference = sums.where("l_returnflag = 'N'").drop("l_returnflag")
    out = orbit.difference_orbit(signal.join(reference.select("name"), "name", "left_semi"), reference, "value", "error")
    return out.select("name", F.round("value", 4).alias("value"), F.round("error", 9).alias("error"))


@query(f"""
WITH {MEAS},
o AS (SELECT file_idx, ring_pos, round(avg(x), 6) AS phase, CAST(count(x) AS DOUBLE) AS v FROM meas GROUP BY file_idx, ring_pos),
n AS (SELECT *, lead(phase) OVER w AS np, lead(v) OVER w AS nv FROM o WINDOW w AS (PARTITION BY file_idx ORDER BY ring_pos))
SELECT file_idx, ring_pos, round((((np - phase) % 1.0) + 1.0) % 1.0, 6) AS advance, nv - v AS variance FROM n WHERE np IS NOT NULL
""")
def phase_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase advances between neighbours on the ring."""
    rows = measurements(spark, sf_dir).groupBy("file_idx", "ring_pos").agg(
        F.round(F.avg("x"), 6).alias("phase"), F.count("x").cast("double").alias("variance")
    )
    out = orbit.phase_advance(rows, ["file_idx"], "ring_pos", "phase", "variance")
    return out.select("file_idx", "ring_pos", F.round("advance", 6).alias("advance"), "variance")


@query("""
SELECT split_part(p_type, ' ', 1) AS family, round(coalesce(median(CASE WHEN p_size > 10 THEN p_retailprice END), 0) * 0.5, 6) AS alpha FROM part GROUP BY 1
""")
def family_median_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior strength of each family from the median of its positive diagonal."""
    rows = table(spark, sf_dir, "part").select(
        F.split("p_type", " ")[0].alias("family"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).otherwise(0.0).alias("value")
    )
    strengths = rows.select("family", F.lit(0.5).alias("strength")).distinct()
    return machine.family_prior(rows, strengths).select("family", F.round("alpha", 6).alias("alpha"))


@query("""
SELECT p_brand || CASE WHEN p_retailprice >= 1400 THEN '_p' ELSE '_n' END AS "group",
       round(coalesce(sum(p_retailprice * (p_size % 5)) / nullif(sum(p_size % 5), 0), 0), 6) AS strength, count(*) AS n
FROM part GROUP BY 1
""")
def length_weighted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean strength of grouped magnets by length, split by sign."""
    rows = table(spark, sf_dir, "part").withColumn("len", F.col("p_size") % 5)
    group = F.concat("p_brand", F.when(F.col("p_retailprice") >= 1400, "_p").otherwise("_n"))
    return machine.length_weighted(rows, group, "p_retailprice", "len").select("group", F.round("strength", 6).alias("strength"), "n")


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand || '.dk' || (p_size % 6) || 'l'
                       WHEN p_size % 3 = 1 THEN p_brand || '.dk' || (p_size % 6) || 'sl' ELSE p_brand || '.kick' END AS knob,
       CASE WHEN p_size % 3 = 0 THEN 'dk' || (p_size % 6) || 'l' WHEN p_size % 3 = 1 THEN 'dk' || (p_size % 6) || 'sl' ELSE 'kick' END AS family
FROM part
""")
def knob_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipole attributes under their result names."""
    order = (F.col("p_size") % 6 + 1).cast("string")
    knob = F.when(F.col("p_size") % 3 == 0, F.concat("p_brand", F.lit(".knl["), order, F.lit("]")))
    knob = knob.when(F.col("p_size") % 3 == 1, F.concat("p_brand", F.lit(".ksl["), order, F.lit("]"))).otherwise(F.concat("p_brand", F.lit(".kick")))
    rows = table(spark, sf_dir, "part").select("p_partkey", result_name(knob).alias("knob"))
    return rows.withColumn("family", family(F.col("knob")))


@query(f"""
WITH {STEPS}
SELECT run_id, max(loss) FILTER (step = 0) AS t0, max(loss) FILTER (step = 1) AS t1 FROM steps
WHERE run_id IN (SELECT run_id FROM steps WHERE step = 1) GROUP BY run_id
""")
def pivot_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns side by side for runs that have both."""
    rows = steps(spark, sf_dir)
    both = rows.where("step = 1").select("run_id")
    return history.pivot_turns(rows.join(both, "run_id", "left_semi"), "run_id", "step", [0, 1], "loss")


@query(f"WITH {STEPS} SELECT run_id, arg_min(step, struct_pack(l := loss, s := step)) AS step, min(loss) AS loss FROM steps GROUP BY run_id")
def history_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest best step of each run."""
    return history.best_steps(steps(spark, sf_dir))


@query(f"""
WITH {STEPS}, b AS (SELECT *, min(loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM steps)
SELECT run_id, step, loss, least(before, loss) AS best, before IS NULL OR loss < before AS new_best FROM b
""")
def history_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best loss so far at each step."""
    return history.running_best(steps(spark, sf_dir))


@query(f"""
WITH RECURSIVE {STEPS},
o AS (SELECT run_id, loss, row_number() OVER (PARTITION BY run_id ORDER BY step) AS k FROM steps),
e AS (
  SELECT run_id, k, loss AS ema FROM o WHERE k = 1
  UNION ALL SELECT o.run_id, o.k, CASE WHEN e.ema = 0 THEN o.loss ELSE 0.2::DOUBLE * e.ema + (1 - 0.2::DOUBLE) * o.loss END
  FROM e JOIN o ON o.run_id = e.run_id AND o.k = e.k + 1)
SELECT run_id, round(arg_max(ema, k), 6) AS ema FROM e GROUP BY run_id
""")
def history_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moving average of each run's loss."""
    return history.smoothed(steps(spark, sf_dir)).select("run_id", F.round("ema", 6).alias("ema"))


@query(f"""
WITH {STEPS}, l AS (SELECT *, lag(loss) OVER (PARTITION BY run_id ORDER BY step) AS last FROM steps)
SELECT run_id, step, loss, CASE WHEN last = 0 THEN 0.0 ELSE round((loss - last) / last, 9) END AS change FROM l WHERE last IS NOT NULL
""")
def rel_loss_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative change of the loss from step to step."""
    out = history.relative_change(steps(spark, sf_dir)).where("change is not null")
    return out.withColumn("change", F.round("change", 9))


@query(f"""
WITH {STEPS}
SELECT run_id, step, coalesce(loss - lag(loss) OVER w, 0) AS moved, loss - first_value(loss) OVER w AS drift
FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY step)
""")
def start_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movement of pushed values since the step before and since the first."""
    out = history.change_from_start(steps(spark, sf_dir), ["run_id"], "step", "loss")
    return out.select("run_id", "step", F.coalesce("moved", F.lit(0.0)).alias("moved"), "drift")


@query("""
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE), 9) AS change FROM embeddings
ORDER BY abs(CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE)) DESC, vec_id LIMIT 12
""")
def topk_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve largest changes."""
    rows = table(spark, sf_dir, "embeddings")
    change = F.col("embedding")[0].cast("double") - F.col("embedding")[1].cast("double")
    return history.top_movers(rows.select("vec_id", "embedding"), change, "vec_id").select("vec_id", F.round("change", 9).alias("change"))


@query(f"""
WITH {MEAS}
SELECT name, count(x) AS n, round(avg(x), 6) AS mean, round(sqrt(avg(x * x)), 6) AS rms, round(stddev_pop(x), 6) AS sd,
       round(1.96 * stddev_pop(x) / sqrt(count(x)), 6) AS ci
FROM meas GROUP BY name
""")
def orbit_mean_rms_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed orbit of each monitor with its spread."""
    out = orbit.mean_orbit(measurements(spark, sf_dir), ["name"], "x")
    return out.select("name", "n", *(F.round(c, 6).alias(c) for c in ("mean", "rms", "sd", "ci")))


@query(f"""
WITH {MEAS}, seen AS (SELECT file_idx, name, count(DISTINCT bunch) AS s FROM meas WHERE x > 150 GROUP BY 1, 2),
total AS (SELECT file_idx, count(DISTINCT bunch) AS t FROM meas WHERE x > 150 GROUP BY 1)
SELECT file_idx, name FROM seen JOIN total USING (file_idx) WHERE s = t
""")
def series_common_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitors with a large reading in every bunch of a file."""
    rows = measurements(spark, sf_dir).where("x > 150").select("file_idx", "bunch", "name")
    return orbit.common_names(rows, "file_idx", "bunch")


@query(f"""
WITH {STEPS}
SELECT run_id, step, round(CASE WHEN step < 2 THEN 0.1 + 0.9 * 0.5 * (1 - cos(pi() * step / 2.0))
       WHEN step < 6 THEN 0.01 + 0.99 * 0.5 * (1 + cos(pi() * (step - 2) / 4.0)) ELSE 0.01 END, 9) AS rate
FROM steps
""")
def schedule_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learning rate at each step of each run."""
    return steps(spark, sf_dir).select("run_id", "step", F.round(learning_rate(F.col("step"), 2, 4, 0.1, 1.0, 0.01), 9).alias("rate"))


@query("""
WITH l AS (
  SELECT l_orderkey % 100 AS run, l_suppkey % 7 AS worker, l_linenumber AS batch,
         CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS DECIMAL(24, 6)) AS loss
  FROM lineitem WHERE (l_suppkey % 7) <> 3 GROUP BY 1, 2, 3),
w AS (SELECT run, worker, CAST(CAST(sum(loss) AS DOUBLE) / count(*) AS DECIMAL(24, 8)) AS loss FROM l GROUP BY 1, 2)
SELECT run, CAST(sum(loss) AS DOUBLE) / count(*) AS loss FROM w GROUP BY run
""")
def validation_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over batches, then over the enabled workers of each run."""
    rows = table(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_orderkey") % 100).alias("run"), (F.col("l_suppkey") % 7).alias("worker_id"), F.col("l_linenumber").alias("batch")
    )
    losses = rows.agg(reductions.exact_mean(2)("l_extendedprice").alias("loss")).withColumn("enabled", F.col("worker_id") != 3)
    return reductions.validation_loss(losses, ["run"], (reductions.exact_mean(6), reductions.exact_mean(8))).select("run", "loss")


@query("""
WITH t AS (
  SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS s, ['hkicker', 'vkicker', 'tkicker', 'monitor'][1 + l_suppkey % 4] AS kind,
         round(l_discount, 2) AS ho, round(l_tax, 2) AS h FROM lineitem)
SELECT k || '.' || n || '.hkick' AS name, h AS value FROM t WHERE kind IN ('hkicker', 'tkicker') AND h <> ho
UNION ALL SELECT k || '.' || n || '.vkick', h FROM t WHERE kind IN ('vkicker', 'tkicker') AND h <> ho
""")
def corrector_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State entries of the correctors whose kick changed."""
    kinds = F.array(*map(F.lit, ("hkicker", "vkicker", "tkicker", "monitor")))
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("name"),
        F.element_at(kinds, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("kind"),
        F.round("l_discount", 2).alias("hkick_old"), F.round("l_tax", 2).alias("hkick"),
        F.round("l_discount", 2).alias("vkick_old"), F.round("l_tax", 2).alias("vkick"),
    )
    return machine.corrector_changes(rows)
