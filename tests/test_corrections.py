"""Corrections of readings and fits by epochs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.jobs.epochs import EpochFit
from orbitweave.operators import corrections
from orbitweave.operators.solvers import Adam

INF, NAN = float("inf"), float("nan")


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


def test_cleaned_variances(spark):
    df = spark.createDataFrame([(4.0, 8.0)], "var_x double, var_y double")
    ranks = spark.createDataFrame([(2, None, 8)], "rank_x int, rank_y int, n_monitors int")
    assert [tuple(r) for r in corrections.scale_cleaned_variances(df, ranks).collect()] == [(1.0, 8.0)]
    assert [tuple(r) for r in corrections.scale_cleaned_variances(df, ranks.where("false")).collect()] == [(4.0, 8.0)]


def test_energy_offsets(spark):
    df = spark.createDataFrame([(1e-3, 1.0), (1e-3, None), (1e-3, 0.5)], "d double, b double")
    got = column(df.select(corrections.pt_from_deltap(F.col("d"), F.col("b")).alias("pt")), "pt")
    energy = lambda p: np.sqrt(p * p * 0.25 + 0.75)
    assert np.allclose(got, [1e-3, 1e-3, (energy(1.001) - 1) / 0.5])
    beta = df.select(corrections.beta_of(F.lit(2.0), F.lit(1.0)).alias("b"))
    assert np.allclose(column(beta, "b"), np.sqrt(0.75))


def test_noise_spares_readings_without_variance(spark):
    df = spark.range(2000).select(F.lit(1.0).alias("x"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(INF).alias("v"))
    noisy = corrections.add_noise(df, "x", "v", 3)
    assert noisy.where("v > 100 and x <> 1").count() == 0
    assert abs(np.std(column(noisy.where("v < 100"), "x")) - 2) < 0.2


def test_turns_counted_from_a_marker(spark):
    df = spark.createDataFrame([(0, 5, n, i) for i, n in enumerate(["B1", "KICK", "B2"])], "file_idx int, turn int, name string, point int")
    assert sorted((r.name, r.turn) for r in corrections.realign_turns(df, "KICK").collect()) == [("B1", 4), ("B2", 5), ("KICK", 5)]


def test_small_expressions(spark):
    df = spark.createDataFrame([(None, None, "s", "e", -1, ["absolute", "absolute"])], "c string, i string, s string, e string, d int, p array<string>")
    assert column(df.select(corrections.cycle_target(*(F.col(x) for x in "cised")).alias("t")), "t") == ["e"]
    assert column(df.select(corrections.dynamic_planes(F.col("p")).alias("t")), "t") == ["absolute"]
    with pytest.raises(Exception, match="mixed"):
        df.select(corrections.dynamic_planes(F.array(F.lit("dynamic"), F.lit("absolute")))).collect()
    assert np.allclose(column(df.select(corrections.corrected_kick(F.lit(2.0), F.lit(0.1), F.lit(None).cast("double")).alias("k")), "k"), 2.2)
    values = spark.createDataFrame([("a", 1.0), ("b", -3.0)], "knob string, value double")
    truth = spark.createDataFrame([("a", 2.0)], "knob string, value double")
    assert column(corrections.distance_to_truth(values, truth), "distance") == [1.0]
    assert column(corrections.distance_to_truth(values, truth.where("false")), "distance") == [-2.0]
    rows = spark.createDataFrame([("x", 3.0), ("x", NAN), ("x", 1.0), ("y", 0.0)], "k string, value double")
    assert sorted(column(corrections.unweighted_variance(rows, ["k"]), "variance")) == [1.0, 5.0, 5.0, 5.0]
    assert corrections.measured_or_absent(rows, "value", "error").where(F.isnan("error")).count() == 4


def test_epochs_pick_the_best_and_take_back_lost_beams():
    calls = []

    def evaluate(values, batch):
        calls.append(batch)
        return (float("nan") if len(calls) == 4 else float(values @ values)), 2 * values

    fit = EpochFit(evaluate, [0, 1], Adam(), rate=lambda e: 0.05)
    best = fit.run(np.array([1.0, -1.0]), epochs=6)
    assert fit.history[1].lost and np.array_equal(fit.history[1].values, fit.history[0].values)
    assert best.epoch == 5 and [p.lost for p in fit.history].count(True) == 1
    worse = EpochFit(lambda v, b: (float(v @ v), 2 * v), [0], Adam(), validate=lambda v: float(-abs(v[0])))
    assert worse.run(np.array([1.0]), epochs=4).epoch == 0
