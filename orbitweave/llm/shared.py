"""The folder that driver and executors share, and tables written there to cut lineage.

A table written to the shared folder survives the loss of any executor, is read
back with column pruning and has sizes that the planner knows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _FALLBACK.get(app) or _FALLBACK.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to ``path``, by default under the shared folder, and read it back."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
