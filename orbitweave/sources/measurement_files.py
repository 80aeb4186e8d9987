"""Turn-by-turn measurement files."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a measurement file, in order.
COLUMNS = ("name", "turn", "bunch_number", "x", "px", "y", "py", "var_x", "var_y", "var_px", "var_py")
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
SCHEMA = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("turn", T.IntegerType()), T.StructField("bunch_number", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in COLUMNS[3:]]
)


def read_measurements(spark: SparkSession, paths: Sequence[str], markers: Sequence[str] | None = None) -> DataFrame:
    """Readings of all files with ``file_idx`` (the place in the list of the file or of its folder) and ``row_index`` (place in the file).

    The list of markers and the columns reach the Parquet scan; what a file is called
    and where a row stood are taken there, before any shuffle. A file that lacks a
    column is an error that names it, and so is one that is given twice, in whatever way.
    """
    plain = [_plain(path) for path in paths]
    if twice := sorted({p for p in plain if plain.count(p) > 1 or any(p.startswith(f"{q}/") for q in plain)}):
        raise ValueError(f"given twice: {twice}")
    with ThreadPoolExecutor(16) as pool:  # one footer a path
        columns = pool.map(lambda path: spark.read.parquet(path).columns, paths)
    for path, names in zip(paths, columns, strict=True):
        if missing := set(COLUMNS) - set(names):
            raise ValueError(f"{path} lacks {sorted(missing)}; write the measurement again")
    # Spark writes the path as an address; a plus is itself there.
    address = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = spark.read.schema(SCHEMA).parquet(*paths).select(
        "*", F.regexp_replace(address, _SCHEME, "").alias("file_path"), F.col("_metadata.row_index").alias("row_index")
    )
    if markers is not None:
        rows = rows.where(F.col("name").isin(list(markers)))
    index = spark.createDataFrame(list(zip(plain, range(len(plain)), strict=True)), "path string, file_idx int")
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    as_file, as_folder = (index.select(F.col("path").alias(c), F.col("file_idx").alias(f"{c}_idx")) for c in ("file_path", "folder"))
    found = rows.withColumn("folder", folder).join(as_file, "file_path", "left").join(as_folder, "folder", "left")
    known = F.coalesce("file_path_idx", "folder_idx", F.raise_error(F.concat(F.lit("no index for "), "file_path")).cast("int"))
    return found.withColumn("file_idx", known).select(*COLUMNS, "row_index", "file_idx")


def _plain(path: str) -> str:
    """A path without scheme and host, as Spark names the files below it."""
    bare = re.sub(_SCHEME, "", path)
    return os.path.abspath(bare) if bare == path or path.startswith("file:") else bare.rstrip("/")


def write_measurements(rows: DataFrame, path: str) -> None:
    """The columns of a measurement file, partitioned as ``rows`` are."""
    rows.select(*COLUMNS).write.mode("errorifexists").parquet(path)
