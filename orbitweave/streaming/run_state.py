"""The progress of runs as keyed state: a map of steps per run, in which the last writer wins.

A step that is written again, or late, changes its own row and those after it; nothing
is rewritten but what changed. A run without news for a while is finished: a timer
gives its last row and clears its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROGRESS = "run_id string, step long, loss double, best double, best_step long, ema double, change double, stop boolean, finished boolean"
_NAMES = [c.split()[0] for c in PROGRESS.split(", ")]
_SUMMARY = "step long, best double, best_step long, ema double, last double, broken long"
_START = (-(1 << 62), float("inf"), -1, 0.0, float("nan"))
_NEVER = (1 << 63) - 1
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunProgress(StatefulProcessor):
    """Per run: best loss so far, moving average of losses, its change, and whether to stop.

    Input rows are (run_id, step, loss, written): of rows of one step the one with the
    greatest ``written`` counts, however often and in whatever order they come. A row
    without a step is a line that could not be read; the run's rows written after it are
    not taken. A NaN loss is a lost beam: its step is kept and adds nothing.
    """

    def __init__(self, alpha: float, stop_change: float, idle_ms: int) -> None:
        self.alpha, self.stop_change, self.idle_ms = alpha, stop_change, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "step long", "loss double, written long")
        self.summary = handle.getValueState("summary", _SUMMARY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        news = pd.concat(list(rows))
        *state, broken = self.summary.get() if self.summary.exists() else (*_START, _NEVER)
        bad = news["written"][news["step"].isna()]
        broken = min(broken, int(bad.min())) if len(bad) else broken
        news = news[news["step"].notna() & (news["written"] < broken)].sort_values("written", kind="stable").drop_duplicates("step", keep="last")
        changed: dict[int, float] = {}
        for step, loss, written in zip(news["step"].astype("int64").tolist(), news["loss"].astype("float64").tolist(), news["written"].tolist(), strict=True):
            known = self.steps.getValue((step,)) if self.steps.containsKey((step,)) else None
            if known is None or known[1] < written:
                self.steps.updateValue((step,), (loss, written))
                changed[step] = loss
        out: list[tuple] = []
        if changed:
            first = min(changed)
            if first > state[0]:
                todo, state = sorted(changed.items()), tuple(state)
            else:
                # A late step or a repeated one: the run is gone through again, and told from there on.
                todo, state = sorted((k[0], v[0]) for k, v in self.steps.iterator()), _START
            for step, loss in todo:
                state, row = self._advance(state, step, loss)
                if step >= first:
                    out.append((key[0], *row, False))
        self.summary.update((*state, broken))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, best, best_step, ema, last, _ = self.summary.get()
        self.steps.clear()
        self.summary.clear()
        row = (key[0], at, last, best, best_step, ema, 0.0, False, True)
        yield pd.DataFrame([row] if at >= 0 else [], columns=_NAMES)

    def close(self) -> None:
        """Nothing is held outside the state."""

    def _advance(self, state: tuple, step: int, loss: float) -> tuple[tuple, tuple]:
        _, best, best_step, ema, last = state
        if loss != loss:
            return (step, best, best_step, ema, last), (step, loss, best, best_step, ema, 0.0, False)
        if loss < best:
            best, best_step = loss, step
        before = ema
        ema = loss if ema == 0.0 else self.alpha * ema + (1 - self.alpha) * loss
        change = 0.0 if before == 0.0 or last != last else (ema - before) / before
        stop = last == last and abs(change) < self.stop_change
        return (step, best, best_step, ema, loss), (step, loss, best, best_step, ema, change, stop)


def run_progress(rows: DataFrame, alpha: float = 0.2, stop_change: float = 1e-6, idle_ms: int = 3_600_000) -> DataFrame:
    """The progress of every run of a stream (run_id, step, loss, written): rows that are new or changed, in update mode.

    The session needs ``spark.sql.streaming.stateStore.providerClass`` of RocksDB (``PROVIDER``).
    """
    news = rows.select(F.col("run_id").cast("string").alias("run_id"), "step", F.col("loss").cast("double").alias("loss"), "written")
    return news.groupBy("run_id").transformWithStateInPandas(
        RunProgress(alpha, stop_change, idle_ms), StructType.fromDDL(PROGRESS), "Update", "ProcessingTime"
    )


def keep_changes(progress: DataFrame, table: str, checkpoint: str):
    """A writer that adds every trigger's rows to a table; a trigger that is replayed takes the place of itself."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/trigger={number}")

    return progress.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(add)


def newest(spark: SparkSession, table: str) -> DataFrame:
    """The row that counts for each run and step, and one more for a finished run, from what ``keep_changes`` wrote."""
    rows = spark.read.schema(f"{PROGRESS}, trigger long").parquet(table)
    row = F.struct(*(c for c in rows.columns if c not in ("run_id", "step", "finished", "trigger")))
    return rows.groupBy("run_id", "step", "finished").agg(F.max_by(row, "trigger").alias("r")).select("run_id", "step", "r.*", "finished")
