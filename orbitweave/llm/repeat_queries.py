"""Registered queries on repetition: periodic runs, repeated passages, collocations."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .passages import remove_repeats
from .periodic_runs import periodic_runs


def periodic_tail(doc: object, n: int) -> tuple[int, int] | None:
    """Where a text of ``n`` words becomes periodic and with which period, for one id in ten; none for null ids."""
    if doc is None:
        return None
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    return (g % n, 1 + (n - g % n) // (3 + g % 8)) if h % 10 == 0 else None


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all ``documents``, every tenth with a periodic tail."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=periodic_tail)
    # Runs are in the order of ties, so an equal exponent does not replace the one before it.
    best = F.expr("aggregate(runs, runs[0], (b, r) -> CASE WHEN r.length * b.period > b.length * r.period THEN r ELSE b END)")
    listed = F.expr("concat_ws('', transform(runs, r -> concat_ws(',', r.start, r.length, concat(r.period, '\\n'))))")
    rows = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without bytes of strings of 200 bytes that occur elsewhere."""
    rows = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.length)")
    return rows.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words in each language of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
