"""Measurements as bucketed, sorted tables, on which jobs by file and turn need no shuffle.

A table is written once with its rows dealt by (file, turn) over a fixed number of
buckets and sorted in each. Grids of turns, merges of corrections and gathered ranges
group and join by these columns, so that their plans start from the buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("file_idx", "turn")


def write_turn_table(rows: DataFrame, name: str, buckets: int = 200, path: str | None = None) -> None:
    """Write ``rows`` as the table ``name``, one sorted file a bucket; ``buckets`` should let a bucket fit a task.

    Within a turn rows are in order of ``name``, where they have it. An existing table is an error.
    """
    order = [c for c in (*KEYS, "name") if c in rows.columns]
    dealt = rows.repartition(buckets, *KEYS)
    writer = dealt.write.format("parquet").bucketBy(buckets, *KEYS).sortBy(*order)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def read_turn_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def gather_turns(requests: DataFrame, readings: DataFrame) -> DataFrame:
    """``requests`` (file_idx, turn, name, ...) with the other columns of the readings asked for, null where there is none.

    A turn's readings become a map of at most as many entries as there are monitors, so that the join is by turn alone and
    needs no shuffle where both sides are turn tables of as many buckets. A reading that is there twice is an error.
    """
    values = [c for c in readings.columns if c not in (*KEYS, "name")]
    entry = F.struct("name", F.struct(*values).alias("value"))
    turns = readings.where(F.col("name").isNotNull()).groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(entry)).alias("turn_readings"))
    found = requests.join(turns, list(KEYS), "left").withColumn("turn_readings", F.try_element_at("turn_readings", F.col("name")))
    return found.select(*requests.columns, *(F.col("turn_readings")[c].alias(c) for c in values))


def shuffles(df: DataFrame) -> int:
    """Exchanges in the plan of ``df``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(1 for line in plan.split("\n") if line.lstrip(" :+-*()0123456789").startswith("Exchange"))

