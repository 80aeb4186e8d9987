"""A table of computed optics, addressed by what they were computed from.

Rows are kept by a key, such as the hash of knobs. What is asked for and not there is
found by an anti join, computed once and added; nothing that is there is computed again.
Every request is noted, and the least recently used keys go when the table has too many.
Parts are added, never changed: a part is there once it is complete, and of two jobs that
compute the same key at once readers see one.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitweave.sources.shared_tables import written


class OpticsCache:
    """Results under ``folder`` by ``key``; ``model`` is hashed into the folder, so that models share nothing.

    ``compute`` takes the distinct rows (key and what else was asked with it) that are missing and
    returns rows with the key, as many as a key's optics have, of the columns of ``schema``.
    """

    def __init__(self, spark: SparkSession, folder: str, model: dict, key: str, schema: str, compute: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.key, self.compute = spark, key, compute
        self.schema = T.StructType.fromDDL(schema)
        name = spark.range(1).select(F.sha2(F.lit(json.dumps(model, sort_keys=True, default=str)), 256).alias("h")).first().h
        self.folder = f"{folder}/{name}"

    def _read(self, part: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], schema)

    def _rows(self) -> DataFrame:
        return self._read("optics", T.StructType([*self.schema, T.StructField("made", T.StringType())]))

    def _uses(self) -> DataFrame:
        return self._read("uses", T.StructType([self.schema[self.key], T.StructField("used", T.DoubleType())]))

    def _dropped(self) -> DataFrame:
        return self._read("dropped", T.StructType([self.schema[self.key], T.StructField("part", T.StringType())]))

    def _held(self) -> DataFrame:
        """Rows that count: of a key that two jobs made the part that sorts first, without what was evicted."""
        rows = self._rows().join(self._dropped().withColumnRenamed("part", "made"), [self.key, "made"], "left_anti")
        first = rows.groupBy(self.key).agg(F.min("made").alias("made"))
        return rows.join(first, [self.key, "made"])

    def keys(self) -> DataFrame:
        """The keys that are there."""
        return self._held().select(self.key).distinct()

    def get(self, asked: DataFrame) -> DataFrame:
        """The optics of all keys in ``asked``, computed where they are missing; null keys ask for nothing."""
        asked = asked.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        missing = written(asked.join(self.keys(), self.key, "left_anti"), "cache-missing")
        if not missing.isEmpty():
            part = uuid.uuid4().hex
            made = self.compute(missing).select(*self.schema.names, F.lit(part).alias("made"))
            made.write.mode("append").parquet(f"{self.folder}/optics")
        uses = asked.select(F.col(self.key), F.lit(time.time()).alias("used"))
        uses.write.mode("append").parquet(f"{self.folder}/uses")
        return self._held().join(asked.select(self.key), self.key, "left_semi").select(*self.schema.names)

    def evict(self, keep: int) -> int:
        """Drop the least recently used keys but ``keep``, ties by key; their number. What was dropped is computed anew when asked for."""
        last = self._uses().groupBy(self.key).agg(F.max("used").alias("used"))
        held = self._held().select(self.key, "made").distinct().join(last, self.key, "left")
        # The kept ones are found by a top-k of bounded size, and everything else goes.
        kept = written(held.orderBy(F.desc_nulls_last("used"), self.key).limit(keep).select(self.key), "cache-kept")
        gone = written(held.join(kept, self.key, "left_anti").select(self.key, F.col("made").alias("part")), "cache-gone")
        gone.write.mode("append").parquet(f"{self.folder}/dropped")
        return gone.count()
