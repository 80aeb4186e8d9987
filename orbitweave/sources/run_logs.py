"""Run logs: a stage description, a growing history of JSON lines, binary knob rows, a result.

Every reader tolerates a tail that is still being written.
"""

from __future__ import annotations

import json
import os
import struct
import time
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("time", T.DoubleType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("validation_loss", T.DoubleType()),
        T.StructField("new_best", T.BooleanType()),
    ]
)
ATTEMPTS = "attempt int, name string, started double, knob_names array<string>, resume_step long"
RESULT = "loss double, values map<string,double>, uncertainties map<string,double>"
STAGE = "name string, started double, knob_names array<string>, metadata map<string,string>"


def read_stages(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(path, name, started, knob_names, metadata) of all stages under the roots, oldest first."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "stage.json").option("multiLine", True)
    rows = reader.schema(STAGE).json(list(roots)).select(F.col("_metadata.file_path").alias("path"), "*")
    return rows.withColumn("path", F.regexp_replace("path", "/stage\\.json$", "")).orderBy("started", "path")


def read_results(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(path, loss, values, uncertainties) of all results under the roots; a file that is no JSON object has null columns."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "result.json").option("multiLine", True)
    rows = reader.schema(RESULT).json(list(roots)).select(F.col("_metadata.file_path").alias("path"), "*")
    return rows.withColumn("path", F.regexp_replace("path", "/result\\.json$", ""))


def unfinished(stages: DataFrame, results: DataFrame, histories: DataFrame, name: str) -> DataFrame:
    """The newest stage of a name with history and without result, at most one row; others have a ``path``."""
    open_ones = stages.where(F.col("name") == name).join(results.select("path"), "path", "left_anti")
    return open_ones.join(histories.select("path"), "path", "left_semi").orderBy(F.desc("started"), F.desc("path")).limit(1)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a history up to its first line that is no JSON object; of a repeated step the last line counts."""
    # Lines keep their file's order within a task and from task to task, so a long log is read by many.
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("row"), F.col("value").alias("line")).where(F.trim("line") != "")
    parsed = lines.withColumn("r", F.from_json("line", HISTORY, {"mode": "PERMISSIVE"}))
    # A cut line parses to a record without a step.
    broken = F.col("r").isNull() | F.col("r.step").isNull() | ~F.trim("line").endswith("}")
    first = parsed.agg(F.min(F.when(broken, F.col("row"))).alias("first_bad"))  # one row
    good = parsed.join(F.broadcast(first)).where("first_bad is null or row < first_bad")
    return good.groupBy("r.step").agg(F.max_by("r", "row").alias("r")).select("r.*")


def read_knob_rows(spark: SparkSession, path: str, knobs: Sequence[str]) -> DataFrame:
    """(step, knob, value) from binary rows of doubles [step, values...]; a half-written row is dropped, the last of a step counts."""
    width = 8 * (1 + len(knobs))
    names = list(knobs)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = list(struct.iter_unpack(f"<{1 + len(names)}d", content[: len(content) // width * width]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(r[0]) for r in rows], pa.int64()),
                        pa.array(range(len(rows)), pa.int64()),
                        pa.array([list(r[1:]) for r in rows], pa.list_(pa.float64())),
                    ],
                    ["step", "row", "v"],
                )

    content = spark.read.format("binaryFile").load(path).select("content")
    rows = content.mapInArrow(unpack, "step long, row long, v array<double>").groupBy("step").agg(F.max_by("v", "row").alias("v"))
    label = F.array(*map(F.lit, names))
    return rows.select("step", F.posexplode("v").alias("k", "value")).select("step", F.element_at(label, F.col("k") + 1).alias("knob"), "value")


def begin_attempt(spark: SparkSession, folder: str, name: str, knobs: Sequence[str], resume_step: int | None = None) -> int:
    """Number of a new attempt of a run whose steps are kept as a table; other knobs than before are an error.

    An attempt that goes on from ``resume_step`` outdates the steps from there on of all attempts before it. Nothing
    is cut from files: what counts is decided when the table is read.
    """
    try:
        before = spark.read.schema(ATTEMPTS).json(f"{folder}/attempts").orderBy(F.desc("attempt")).first()
    except AnalysisException:  # no attempt yet
        before = None
    if before is not None and before.knob_names != list(knobs):
        raise ValueError("the log has other knobs")
    attempt = 0 if before is None else before.attempt + 1
    row = [(attempt, name, time.time(), list(knobs), resume_step)]
    spark.createDataFrame(row, ATTEMPTS).coalesce(1).write.mode("append").json(f"{folder}/attempts")
    return attempt


def append_steps(steps: DataFrame, folder: str, attempt: int) -> None:
    """Add rows (step, ...) to an attempt's part of the table, from as many tasks as ``steps`` has."""
    steps.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt").parquet(f"{folder}/steps")


def current_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The steps that no later attempt outdates; of a repeated step the latest attempt counts."""
    later = W.orderBy(F.desc("attempt")).rowsBetween(W.unboundedPreceding, -1)  # a row per attempt
    limits = spark.read.schema(ATTEMPTS).json(f"{folder}/attempts").select("attempt", F.min("resume_step").over(later).alias("end"))
    steps = spark.read.parquet(f"{folder}/steps")
    held = steps.join(limits, "attempt").where("end is null or step < end")
    row = F.struct(*(c for c in steps.columns if c != "attempt"))
    return held.groupBy("step").agg(F.max_by(row, "attempt").alias("row")).select("row.*")


def _replace(path: Path, content: Mapping[str, Any]) -> None:
    part = path.with_suffix(".part")
    part.write_text(json.dumps(content, sort_keys=True, default=str))
    os.replace(part, path)


def save_checkpoint(path: str | Path, epoch: int, knobs: Mapping[str, float], state: Mapping[str, Sequence[float]]) -> None:
    """Knobs and optimiser vectors as JSON; a value that is not finite is an error."""
    values = [*knobs.values(), *(v for x in state.values() for v in x)]
    if not all(abs(v) < float("inf") for v in values):
        raise ValueError("a checkpoint holds finite values only")
    _replace(Path(path), {"epoch": epoch, "knobs": dict(knobs), "order": list(knobs), "state": {k: list(v) for k, v in state.items()}})


def load_checkpoint(path: str | Path, knobs: Sequence[str]) -> tuple[int, dict[str, float], dict[str, list[float]]]:
    """(epoch, knobs, state) in the order of ``knobs``: state of new knobs is 0, a saved knob not among them is an error."""
    saved = json.loads(Path(path).read_text())
    if unknown := set(saved["knobs"]) - set(knobs):
        raise ValueError(f"unknown knobs {sorted(unknown)}")
    order = saved["order"]
    state = {name: [dict(zip(order, v, strict=True)).get(k, 0.0) for k in knobs] for name, v in saved["state"].items()}
    return saved["epoch"], {k: saved["knobs"][k] for k in knobs if k in saved["knobs"]}, state
