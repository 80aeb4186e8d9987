"""Queries over tables that are kept: optics by what they were computed from, and readings in buckets of turns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.functions.missing import usable_variance
from orbitweave.jobs.preparation import _GRID
from orbitweave.jobs.registry import query
from orbitweave.jobs.views import NAMES, measurements, table
from orbitweave.operators import plans, prepare
from orbitweave.sources.optics_cache import OpticsCache
from orbitweave.sources.shared_tables import new_path, written
from orbitweave.sources.turn_tables import read_turn_table, write_turn_table

KEPT = 40


@query(f"""
WITH groups AS (
  SELECT o_custkey, sha256(string_agg(lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '=' || o_orderstatus, chr(10) ORDER BY o_orderkey)) AS content,
         CAST(sum(o_totalprice) AS DOUBLE) AS total, count(*) AS n
  FROM orders GROUP BY o_custkey)
SELECT content, round(total, 2) AS total, n, CAST(1 AS BIGINT) AS computed FROM groups ORDER BY content LIMIT {KEPT}
""")
def cached_optics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optics by the hash of a customer's knobs: two requests that overlap compute each key once, then all but the latest used go."""
    orders = table(spark, sf_dir, "orders")
    name = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    keys = written(plans.content_hash(orders, ["o_custkey"], name, F.col("o_orderstatus")), "cache-keys")
    runs = new_path(spark, "cache-runs")

    def optics(missing: DataFrame) -> DataFrame:
        missing.select("content").write.mode("append").parquet(runs)
        rows = orders.join(missing, "o_custkey")
        return rows.groupBy("content").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("n"))

    cache = OpticsCache(spark, new_path(spark, "cache"), {"machine": "ring"}, "content", "content string, total double, n long", optics)
    cache.get(keys.where("o_custkey % 3 <> 0"))
    cache.get(keys)
    cache.evict(KEPT)
    computed = spark.read.parquet(runs).groupBy("content").agg(F.count("*").alias("computed"))
    left = cache.get(cache.keys())
    return left.join(computed, "content").select("content", F.round("total", 2).alias("total"), "n", "computed")


@query(_GRID + "SELECT file_idx, turn, name, x, missing, px FROM grid")
def grid_from_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every monitor in every turn, from a bucketed table of turns on which the grid needs no shuffle."""
    name = f"turns_{uuid.uuid4().hex}"
    rows = measurements(spark, sf_dir).withColumns({"var_x": F.lit(1.0), "var_px": F.lit(0.25)})
    write_turn_table(rows, name, buckets=8, path=new_path(spark, "turn-table"))
    grid = prepare.complete_grid(read_turn_table(spark, name), NAMES, ["x", "px"])
    return grid.select("file_idx", "turn", "name", "x", (~usable_variance(F.col("var_x"))).alias("missing"), "px")
