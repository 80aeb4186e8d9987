"""Fits by epochs of batches, with every epoch's state a version of a table that can be gone back to."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.jobs.registry import query
from orbitweave.jobs.views import JAC_ALL, jacobians
from orbitweave.operators import packed_sums
from orbitweave.operators.solvers import Adam
from orbitweave.sources.shared_tables import Versions, new_path

STATE = "knob int, value double, mean double, square double, count long, loss double, validation double, lost boolean"


@dataclass
class Progress:
    """What an epoch left behind."""

    epoch: int
    loss: float
    validation: float | None
    values: np.ndarray
    lost: bool = False


@dataclass
class EpochFit:
    """Steps on batches in turn; a batch that loses its beam takes the whole epoch back, the optimiser with it.

    ``evaluate(values, batch)`` gives (loss, gradient), the loss NaN for a lost beam. The best
    epoch has the lowest validation loss, or training loss without one. The fit stops when the
    smoothed loss changes by less than ``stop_change``. With ``versions`` each epoch's state is written
    as the version after the one it started from: what is taken back is read from there, and so is what a
    later run goes on from.
    """

    evaluate: Callable[[np.ndarray, int], tuple[float, np.ndarray]]
    batches: Sequence[int]
    optimiser: Adam
    rate: Callable[[int], float] = lambda epoch: 1e-2
    validate: Callable[[np.ndarray], float | None] = lambda values: None
    smoothing: float = 0.2
    stop_change: float = 1e-9
    versions: Versions | None = None
    history: list[Progress] = field(default_factory=list)

    def run(self, start: np.ndarray | None, epochs: int, first: int = 0) -> Progress:
        """``epochs`` of them from ``start``, or, without it, from where epoch ``first`` - 1 was left."""
        if start is None:
            values = self._load(first)
        else:
            values = np.array(start, dtype=float)
            self._save(first, Progress(first - 1, float("nan"), None, values))
        average, best = 0.0, None
        for epoch in range(first, first + epochs):
            before, losses, lost = (values.copy(), self._optimiser()), [], False
            for batch in self.batches:
                loss, gradient = self.evaluate(values, batch)
                if np.isnan(loss):
                    lost = True
                    break
                losses.append(loss)
                values = self.optimiser.step(values, gradient, self.rate(epoch))
            if lost and self.versions:
                values = self._load(epoch)
            elif lost:
                values, (self.optimiser.mean, self.optimiser.square, self.optimiser.count) = before
            loss = float(np.mean(losses)) if losses else float("nan")
            done = Progress(epoch, loss, self.validate(values), values.copy(), lost)
            self.history.append(done)
            self._save(epoch + 1, done)
            if not lost and (best is None or _selected(done) < _selected(best)):
                best = done
            last, average = average, loss if average == 0 else self.smoothing * average + (1 - self.smoothing) * loss
            if not lost and last and abs(average - last) / abs(last) < self.stop_change:
                break
        return best or Progress(first, float("nan"), None, values, True)

    def _optimiser(self) -> tuple:
        mean, square = self.optimiser.mean, self.optimiser.square
        return None if mean is None else mean.copy(), None if square is None else square.copy(), self.optimiser.count

    def _save(self, version: int, progress: Progress) -> None:
        if self.versions:
            mean, square, count = self._optimiser()
            none = [None] * len(progress.values)
            rows = [
                (k, float(v), None if m is None else float(m), None if q is None else float(q), count, progress.loss, progress.validation, progress.lost)
                for k, (v, m, q) in enumerate(zip(progress.values, none if mean is None else mean, none if square is None else square, strict=True))
            ]
            self.versions.save(version, self.versions.spark.createDataFrame(rows, STATE).coalesce(1))

    def _load(self, version: int) -> np.ndarray:
        rows = self.versions.load(version).orderBy("knob").collect()  # a row per knob
        self.optimiser.count = rows[0]["count"]
        fresh = rows[0]["mean"] is None
        self.optimiser.mean = None if fresh else np.array([r["mean"] for r in rows])
        self.optimiser.square = None if fresh else np.array([r["square"] for r in rows])
        return np.array([r["value"] for r in rows])


def _selected(progress: Progress) -> float:
    return progress.loss if progress.validation is None else progress.validation


def linear_batches(base: DataFrame, knobs: int) -> Callable[[np.ndarray, int], tuple[float, np.ndarray]]:
    """Mean loss and gradient of a linear model over the readings of a batch (jac, target, weight, batch).

    One job for all epochs: a batch of a linear machine is known by its packed sums, of which the driver holds one
    matrix of knobs a batch. A batch without readings has loss 0.
    """
    vector = F.concat("jac", F.array("target"))
    rows = packed_sums.sums_by_key(base.where(F.col("weight") > 0), ["batch"], vector, knobs + 1, F.col("weight")).collect()  # a row per batch
    sums = {r["batch"]: (max(1, r["n"]), packed_sums.unpack(np.array([r["sums"]]), knobs + 1)[0]) for r in rows}

    def evaluate(values: np.ndarray, batch: int) -> tuple[float, np.ndarray]:
        n, whole = sums.get(batch, (1, np.zeros((knobs + 1, knobs + 1))))
        right = whole[:knobs, knobs]
        pull = whole[:knobs, :knobs] @ values
        return float(values @ pull - 2 * values @ right + whole[knobs, knobs]) / n, 2 * (pull - right) / n

    return evaluate


EPOCHS, RATE = 4, 0.5


def _epochs_sql() -> str:
    """Adam's steps on two batches, one after the other, over the batches' normal matrices."""
    parts = [f"""
WITH {JAC_ALL},
r AS (SELECT vec_id % 3 AS batch, j, target FROM jac WHERE w > 0),
x AS (SELECT batch, j, target, unnest(generate_series(1, len(j))) AS a FROM r),
c AS (SELECT batch, a, sum(j[a] * target) AS c FROM x GROUP BY ALL),
n AS (SELECT batch, a, b, sum(j[a] * j[b]) AS n FROM (SELECT batch, j, a, unnest(generate_series(1, len(j))) AS b FROM x) GROUP BY ALL),
t AS (SELECT batch, count(*) AS m, sum(target * target) AS yy FROM r GROUP BY batch),
s0 AS (SELECT DISTINCT a, CAST(0 AS DOUBLE) AS v, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS square FROM c)"""]

    def loss(name: str, state: str, batch: int) -> str:
        return f"""
{name} AS (SELECT (sum(s.v * p.pull) - 2 * sum(s.v * c.c) + any_value(t.yy)) / any_value(t.m) AS loss
  FROM {state} s JOIN c ON c.a = s.a AND c.batch = {batch} JOIN t ON t.batch = {batch}
  JOIN (SELECT n.a, sum(n.n * s.v) AS pull FROM n JOIN {state} s ON n.b = s.a WHERE n.batch = {batch} GROUP BY n.a) p ON p.a = s.a)"""

    for k in range(2 * EPOCHS):
        batch = k % 2
        parts.append(f"""
g{k} AS (SELECT n.a, 2 * (sum(n.n * s.v) - any_value(c.c)) / any_value(t.m) AS g
  FROM n JOIN s{k} s ON n.b = s.a JOIN c ON c.a = n.a AND c.batch = {batch} JOIN t ON t.batch = {batch} WHERE n.batch = {batch} GROUP BY n.a),
s{k + 1} AS (SELECT a, v - {RATE} * (mean / {1 - 0.9 ** (k + 1)!r}) / (sqrt(square / {1 - 0.999 ** (k + 1)!r}) + 1e-8) AS v, mean, square
  FROM (SELECT s.a, s.v, 0.9 * s.mean + {1 - 0.9!r} * g.g AS mean, 0.999 * s.square + {1 - 0.999!r} * g.g * g.g AS square FROM s{k} s JOIN g{k} g ON g.a = s.a))""")
        parts.append(loss(f"l{k}", f"s{k}", batch))
    for e in range(EPOCHS):
        parts.append(loss(f"h{e}", f"s{2 * e + 2}", 2))
    rows = " UNION ALL ".join(
        f"SELECT {e} AS epoch, a, v, (l{2 * e}.loss + l{2 * e + 1}.loss) / 2 AS loss, h{e}.loss AS validation FROM s{2 * e + 2}, l{2 * e}, l{2 * e + 1}, h{e}" for e in range(EPOCHS)
    )
    return ",".join(parts) + f""",
told AS ({rows})
SELECT CAST(epoch AS BIGINT) AS epoch, 'k' || (a - 1) AS knob, round(v, 6) AS value, round(loss, 6) AS loss, round(validation, 6) AS validation,
       validation = min(validation) OVER () AS best
FROM told
"""


@query(_epochs_sql())
def sgd_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All linear knobs fitted in epochs of two batches, a third of the readings held out for validation, every epoch a version."""
    base = jacobians(spark, sf_dir, None).withColumn("batch", (F.col("vec_id") % 3).cast("int"))
    knobs = base.select(F.max(F.size("jac"))).first()[0]
    evaluate = linear_batches(base, knobs)
    versions = Versions(spark, new_path(spark, "epochs"))
    fit = EpochFit(evaluate, [0, 1], Adam(), rate=lambda e: RATE, validate=lambda v: evaluate(v, 2)[0], stop_change=0.0, versions=versions)
    best = fit.run(np.zeros(knobs), epochs=EPOCHS)
    done = versions.history(EPOCHS).where("version > 0")
    return done.select(
        (F.col("version") - 1).cast("long").alias("epoch"), F.concat(F.lit("k"), F.col("knob").cast("string")).alias("knob"),
        F.round("value", 6).alias("value"), F.round("loss", 6).alias("loss"), F.round("validation", 6).alias("validation"),
        (F.col("version") - 1 == best.epoch).alias("best"),
    )
