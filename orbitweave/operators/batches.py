"""Which turns train, which validate, and in which batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(value: Column, seed: int) -> Column:
    """A reproducible shuffle key."""
    return F.md5(F.concat_ws(":", value.cast("string"), F.lit(str(seed))).cast("binary"))


def drop_bunch_edges(turns: DataFrame, margin: int) -> DataFrame:
    """Turns of each (file, bunch) without its first and last ``margin``; short bunches vanish."""
    bunch = W.partitionBy("file_idx", "bunch")
    rank = F.row_number().over(bunch.orderBy("turn"))
    size = F.count("*").over(bunch)
    ranked = turns.withColumn("rank", rank).withColumn("size", size)
    return ranked.where((F.col("rank") > margin) & (F.col("rank") <= F.col("size") - margin)).drop("rank", "size")


def first_bunch_turns(turns: DataFrame) -> DataFrame:
    """The first turn of each (file, bunch)."""
    return turns.groupBy("file_idx", "bunch").agg(F.min("turn").alias("turn"))


def split_turns(turns: DataFrame, validation: float, fraction: float, seed: int = 42) -> DataFrame:
    """Adds ``split`` per file: ``validation``, ``training`` or ``unused``.

    Of a file's n turns, bround(validation * n) but at most n - 1 validate; of the rest
    m, bround(fraction * m) but at least 1 train. Turns count once, whatever readings
    they have; a file's turns are ordered in one task, its readings are not.
    """
    file = W.partitionBy("file_idx")
    ranked = turns.withColumn("rank", F.row_number().over(file.orderBy(hash_order(F.col("turn"), seed), "turn")))
    n = F.count("*").over(file)
    ranked = ranked.withColumn("held", F.greatest(F.lit(0), F.least(F.bround(n * validation), n - 1)).cast("int")).withColumn("n", n)
    kept = F.greatest(F.lit(1), F.bround((F.col("n") - F.col("held")) * fraction).cast("int"))
    split = F.when(F.col("rank") <= F.col("held"), "validation").when(F.col("rank") <= F.col("held") + kept, "training").otherwise("unused")
    return ranked.withColumn("split", split).drop("rank", "held", "n")


def apportion_batches(sizes: DataFrame, batches: int) -> DataFrame:
    """(file_idx, n_batches): batches dealt one by one to the file with most turns per batch, the smaller index first.

    The k-th batch of a file has priority size / k, so the first ``batches`` priorities
    over all files are the outcome. A file gets at most as many batches as turns.
    """
    ranks = sizes.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.col("n_turns"), F.lit(batches)).cast("int"))))
    top = ranks.withColumn("priority", F.col("n_turns") / F.col("k")).orderBy(F.desc("priority"), "file_idx", "k").limit(batches)
    counts = top.groupBy("file_idx").agg(F.count("*").alias("n_batches"))
    return sizes.join(counts, "file_idx", "left").select("file_idx", F.coalesce("n_batches", F.lit(0)).cast("long").alias("n_batches"))


def even_batches(turns: DataFrame, batches: int) -> DataFrame:
    """Adds ``batch`` from 1 per file: contiguous, as equal as possible, larger ones first."""
    return turns.withColumn("batch", F.ntile(batches).over(W.partitionBy("file_idx").orderBy("turn")))


def trim_to_multiple(turns: DataFrame, batches: int) -> DataFrame:
    """The first turns of each file, as many as ``batches`` divides; files shorter than that stay whole."""
    file = W.partitionBy("file_idx")
    n = F.count("*").over(file)
    ranked = turns.withColumn("rank", F.row_number().over(file.orderBy("turn"))).withColumn("n", n)
    keep = F.when(F.col("n") >= batches, F.col("n") - F.col("n") % batches).otherwise(F.col("n"))
    return ranked.where(F.col("rank") <= keep).drop("rank", "n")
