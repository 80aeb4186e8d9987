"""Tables in the folder that driver and executors share: intermediate results and versions of a state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and the master is one machine's threads."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _FALLBACK.get(app) or _FALLBACK.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lost executors cost no earlier work."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Versions:
    """A small state as versions of one table: each is written whole, none is changed, any can be gone back to."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def save(self, version: int, state: DataFrame) -> None:
        """Write a version; one that is written again, after going back, takes the place of itself."""
        state.write.mode("overwrite").parquet(f"{self.folder}/version={version}")

    def load(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/version={version}")

    def history(self, last: int) -> DataFrame:
        """All versions up to ``last``, with the column ``version``."""
        return self.spark.read.parquet(self.folder).where(f"version <= {last}")
