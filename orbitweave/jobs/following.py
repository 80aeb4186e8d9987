"""A run log that grows, written from ``conversations`` in two installments and followed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.jobs.registry import query
from orbitweave.jobs.views import STEPS, steps
from orbitweave.sources.shared_tables import new_path
from orbitweave.streaming.growing_files import read_growing
from orbitweave.streaming.run_state import PROVIDER, keep_changes, newest, run_progress

#: Seconds that an installment may take.
LIMIT_S = 900
_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


@query(f"""
WITH RECURSIVE {STEPS},
o AS (SELECT run_id, step, loss, row_number() OVER (PARTITION BY run_id ORDER BY step) AS k FROM steps),
e AS (
  SELECT run_id, step, k, loss, loss AS ema FROM o WHERE k = 1
  UNION ALL SELECT o.run_id, o.step, o.k, o.loss, CASE WHEN e.ema = 0 THEN o.loss ELSE 0.2::DOUBLE * e.ema + (1 - 0.2::DOUBLE) * o.loss END
  FROM e JOIN o ON o.run_id = e.run_id AND o.k = e.k + 1)
SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(step AS BIGINT) AS step, loss, min(loss) OVER w AS best,
       CAST(arg_min(step, loss) OVER w AS BIGINT) AS best_step, round(ema, 6) AS ema
FROM e WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def followed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of every run as keyed state: first even steps with other losses, then all of them, late and repeated ones in any order."""
    logs, table, checkpoint = (new_path(spark, n) for n in ("logs", "progress", "progress-checkpoint"))
    rows = steps(spark, sf_dir).select(F.col("run_id").cast("string").alias("run_id"), "step", "loss")
    first = rows.where("step % 2 = 0").withColumn("loss", F.col("loss") / 2 - 1).withColumn("written", F.lit(0))
    later = rows.withColumn("written", F.lit(1))
    before = spark.conf.get(_PROVIDER_KEY)
    spark.conf.set(_PROVIDER_KEY, PROVIDER)
    try:
        for installment in (first, later):
            installment.select(F.to_json(F.struct("run_id", "step", "loss", "written")).alias("value")).write.mode("append").text(logs)
            line = F.from_json(F.col("record").cast("string"), "run_id string, step long, loss double, written long")
            stream = read_growing(spark, logs, "part-*").select(line.alias("r")).select("r.*")
            stream_query = keep_changes(run_progress(stream), table, checkpoint).trigger(once=True).start()
            if not stream_query.awaitTermination(LIMIT_S):
                stream_query.stop()
                raise TimeoutError(f"the stream took more than {LIMIT_S} seconds")
    finally:
        spark.conf.set(_PROVIDER_KEY, before)
    return newest(spark, table).where("not finished").select("run_id", "step", "loss", "best", "best_step", F.round("ema", 6).alias("ema"))
