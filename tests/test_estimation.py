"""Reductions, screening and solvers against direct formulas."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbitweave.jobs.fits import fit_linear, gauss_newton_sums
from orbitweave.operators import history, machine, orbit, reductions, screening, solvers

INF, NAN = float("inf"), float("nan")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is None, 0 if x is None else x) for x in r])


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(0)
    j, r = rng.normal(size=(50, 3)), rng.normal(size=50)
    w = np.where(np.arange(50) % 7 == 0, 0.0, rng.uniform(0.5, 2, 50))
    return j, r, w


def test_gauss_newton_sums(spark, numbers):
    j, r, w = numbers
    df = spark.createDataFrame(pa.table({"jac": list(j), "residual": r, "weight": w}))
    odd = spark.createDataFrame([([1.0, 1.0, 1.0], None, 1.0), ([1.0, 1.0, 1.0], NAN, 2.0)], df.schema)
    loss, gradient, normal = gauss_newton_sums(df.unionAll(odd).repartition(4), 3)
    assert np.isclose(loss, w @ (r * r))
    assert np.allclose(gradient, 2 * (j * w[:, None]).T @ r) and np.allclose(normal, (j * w[:, None]).T @ j)
    entries = {(e.a, e.b): e.value for e in reductions.normal_matrix(df, "jac").collect()}
    assert all(np.isclose(v, normal[a, b]) for (a, b), v in entries.items()) and len(entries) == 6
    got = dict(rows(reductions.gradient(df, "jac", F.col("residual")), "k", "grad"))
    assert np.allclose([got[k] for k in range(3)], gradient)


def test_shared_readings_add_before_squaring(spark):
    parts = spark.createDataFrame([(7, [1.0, 2.0], 0.1), (7, [3.0, -1.0], 0.1), (9, [1.0, 0.0], 0.2), (11, [5.0, 5.0], INF)], "reading_id long, g array<double>, variance double")
    merged = reductions.merge_readings(parts)
    assert rows(merged, "reading_id", "g") == [(7, [4.0, 1.0]), (9, [1.0, 0.0]), (11, [5.0, 5.0])]
    got = {(r.a, r.b): r.value for r in reductions.noise_matrix(merged).collect()}
    assert np.isclose(got[0, 0], 0.1 * 16 + 0.2) and np.isclose(got[1, 0], 0.4) and np.isclose(got[1, 1], 0.1)


def test_replies_with_lost_beams(spark):
    df = spark.createDataFrame([(1.0, 2.0), (NAN, 9.0), (None, 9.0), (3.0, 4.0)], "loss double, grad double")
    assert rows(reductions.reduce_replies(df, ["loss", "grad"]), "loss", "grad", "n_valid", "lost") == [(4.0, 6.0, 2, True)]
    with pytest.raises(Exception, match="a worker failed"):
        reductions.reduce_replies(spark.createDataFrame([(INF, 1.0)], df.schema), ["loss"]).collect()


def test_global_weights_and_normalisation(spark):
    df = spark.createDataFrame([(2.0,), (4.0,), (INF,)], "variance double")
    assert [r[0] for r in rows(reductions.with_global_weights(df), "weight")] == [0.0, 0.5, 1.0]
    assert [r[0] for r in rows(reductions.with_global_weights(df.where("variance > 100")), "weight")] == [0.0]
    zero = spark.createDataFrame([(0.0,)], "weight double")
    assert rows(reductions.normalisation(zero), "scale", "points") == [(1.0, 1)]


def test_gains(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("a", 1.0, 1.0, 1.0), ("b", 1.0, 0.0, 5.0)], "name string, weight double, m double, y double")
    assert rows(reductions.gains(df, ["name"], F.col("m"), F.col("y"), ridge=2.0, batches=2), "name", "gain") == [("a", 2.0 / 6.0), ("b", 0.0)]


def test_z_scores(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (0, 4.0), (0, NAN), (1, 5.0), (2, 3.0), (2, 3.0)], "w int, v double")
    got = rows(screening.with_z(df, "v", ["w"]), "w", "v", "z")
    assert [round(z, 6) for _, v, z in got if v == 4.0] == [round(2 / np.std([1, 1, 4]), 6)]
    assert all(z == 0 for _, v, z in got if v != 4.0)


def test_carry_over(spark):
    training = spark.createDataFrame(
        [(0, 0, ["B1"], False), (0, 0, ["B2"], True), (0, 1, ["B3"], True), (1, 2, ["B4"], False)], "file_idx int, range_id int, dropped array<string>, disabled boolean"
    )
    validation = spark.createDataFrame([(0, 0), (0, 1), (5, 2), (5, 9)], "file_idx int, range_id int")
    got = rows(screening.carry_over(training, validation, ["file_idx", "range_id"], ["range_id"]), "file_idx", "range_id", "dropped", "disabled", "matched")
    assert got == [(0, 0, ["B1"], False, "exact"), (0, 1, [], True, "exact"), (5, 2, ["B4"], False, "fallback"), (5, 9, [], False, "none")]


def test_orbits(spark):
    signal = spark.createDataFrame([("a", 3.0, 0.3), ("b", 1.0, 0.0)], "name string, x double, e double")
    reference = spark.createDataFrame([("a", 1.0, 0.4), ("b", 1.0, 1.0)], "name string, x double, e double")
    assert [(n, x, round(e, 9)) for n, x, e in rows(orbit.difference_orbit(signal, reference, "x", "e"), "name", "x", "e")] == [("a", 2.0, 0.5), ("b", 0.0, 1.0)]
    with pytest.raises(Exception, match="no reference for b"):
        orbit.difference_orbit(signal, reference.where("name = 'a'"), "x", "e").collect()
    phases = spark.createDataFrame([("t", 1, 0.9, 1.0), ("t", 2, 1.1, 3.0), ("t", 3, 0.6, 4.0)], "k string, s int, mu double, v double")
    assert [(round(a, 9), v) for a, v in rows(orbit.phase_advance(phases, ["k"], "s", "mu", "v"), "advance", "variance")] == [(0.2, 2.0), (0.5, 1.0)]


def test_machine_tables(spark):
    pairs = spark.createDataFrame([(1, 0.5), (1, 0.5)], "cell int, k double")
    assert rows(machine.collapse_pairs(pairs, "cell", "k"), "cell", "k") == [(1, 0.5)]
    with pytest.raises(Exception, match="members differ in 2"):
        machine.collapse_pairs(spark.createDataFrame([(2, 0.5), (2, 0.6)], pairs.schema), "cell", "k").collect()
    diagonal = spark.createDataFrame([("dk1l", 1.0), ("dk1l", 3.0), ("dk1l", -9.0), ("dx", 0.0)], "family string, value double")
    strengths = spark.createDataFrame([("dk1l", 0.5), ("dx", 2.0)], "family string, strength double")
    assert rows(machine.family_prior(diagonal, strengths), "family", "alpha") == [("dk1l", 1.0), ("dx", 0.0)]
    with pytest.raises(Exception, match="differ in dx"):
        machine.family_prior(diagonal, strengths.where("family = 'dk1l'")).collect()
    elements = spark.createDataFrame([("quad", "mq.1", {"k1": 0.1}), ("quad", "mq.2", {"k1": 0.0}), ("quad", "mb.1", {})], "kind string, name string, attributes map<string,double>")
    specs = spark.createDataFrame([("quad", "^mq", "k1", "k1"), ("quad", "^mb", "dx", None)], "kind string, pattern string, attribute string, nonzero_attr string")
    assert rows(machine.knob_specs(elements, specs), "name", "attribute") == [("mb.1", "dx"), ("mq.1", "k1")]


def test_histories(spark):
    df = spark.createDataFrame([(1, 0, 10.0), (1, 1, 8.0), (1, 2, 8.0), (1, 3, NAN), (2, 0, 0.0), (2, 1, 4.0)], "run_id int, step int, loss double")
    assert rows(history.best_steps(df), "run_id", "step", "loss") == [(1, 1, 8.0), (2, 0, 0.0)]
    ema = dict(rows(history.smoothed(df.where("step < 3")), "run_id", "ema"))
    assert np.isclose(ema[1], 0.2 * (0.2 * 10 + 0.8 * 8) + 0.8 * 8) and ema[2] == 4.0
    assert rows(history.relative_change(df.where("run_id = 2")), "step", "change") == [(0, None), (1, 0.0)]


# --- solvers ---------------------------------------------------------------------------------


def quadratic(a, b):
    return lambda x: solvers.Evaluation(float(0.5 * x @ a @ x - b @ x), a @ x - b, a)


def test_least_squares_in_one_undamped_step():
    a, b = np.array([[3.0, 1.0], [1.0, 2.0]]), np.array([1.0, -1.0])
    out = solvers.levenberg_marquardt(quadratic(a, b), np.zeros(2), damping=1e-15)
    assert np.allclose(out.values, np.linalg.solve(a, b)) and len(out.losses) <= 3
    assert out.reason in ("gradient_converged", "loss_converged", "no_progress", "damping_exhausted")


def test_rejected_steps_retry_from_the_best_point():
    calls = []

    def curved(x):
        calls.append(x.copy())
        return solvers.Evaluation(float(np.log1p(x[0] ** 2)), 2 * x / (1 + x[0] ** 2), np.array([[1e-4]]))

    out = solvers.levenberg_marquardt(curved, np.array([3.0]), steps=60, loss_limit=0.0)
    assert abs(out.values[0]) < 0.1 and len(calls) > len(out.losses) and all(b < a for a, b in zip(out.losses, out.losses[1:], strict=False))
    assert solvers.levenberg_marquardt(lambda x: None, np.zeros(1)).reason == "failed"


def test_cheap_trials_spare_full_evaluations():
    a, b = np.eye(2), np.ones(2)
    full, cheap = [], []
    f = quadratic(a, b)
    solvers.levenberg_marquardt(lambda x: full.append(1) or f(x), np.zeros(2), trial=lambda x: cheap.append(1) or f(x).loss)
    assert len(full) <= len(cheap) + 1


@pytest.mark.parametrize("optimiser", [solvers.Adam(rate=0.1), solvers.LimitedMemory()])
def test_optimisers_reach_a_minimum(optimiser):
    x, a = np.array([1.0, -0.5]), np.diag([1.0, 4.0])
    for _ in range(400):
        x = optimiser.step(x, a @ x)
    assert np.abs(x).max() < 1e-2


def test_gain_elimination_equals_the_full_system():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 7))
    whole = m.T @ m
    whole[4:, 4:] = np.diag(np.diag(whole[4:, 4:]) * 50)
    g = rng.normal(size=7)
    reduced = solvers.eliminate_gains(whole[:4, :4], whole[:4, 4:], np.diag(whole)[4:], g[:4], g[4:], ridge=0.5)
    system = whole + np.diag([0] * 4 + [0.5] * 3)
    want = -np.linalg.solve(system, g)
    step = -np.linalg.solve(reduced.hessian, reduced.gradient)
    assert np.allclose(step, want[:4]) and np.allclose(reduced.gains(step), want[4:])


def test_degenerate_directions_are_named():
    j = np.array([[1.0, 1.0, 0.0, 0.0], [2.0, 2.0, 1.0, 0.0], [0.0, 0.0, 3.0, 0.0]])
    report = solvers.degeneracy(j.T @ j, ["a", "b", "c", "dead"])
    assert report.rank == 2 and report.condition == INF and report.insensitive == ("dead",)
    assert any({n for n, _ in parts} == {"a", "b"} for _, parts in report.directions)
    assert solvers.constrained_least(np.diag([4.0, 9.0, 1.0]), ["a", "b", "c"], 2) == [("b", 3.0), ("a", 2.0)]
    assert solvers.expand({"b": 2.0}, ["a", "b"]).tolist() == [0.0, 2.0]
    with pytest.raises(ValueError, match="unknown"):
        solvers.expand({"c": 1.0}, ["a"])


def test_priors():
    with pytest.raises(ValueError, match="differ"):
        solvers.family_alphas(np.ones(2), ["a", "b"], {"a": 1.0})
    assert solvers.family_alphas(np.array([1.0, 3.0, -1.0]), ["a", "a", "b"], {"a": 2.0, "b": 1.0}).tolist() == [4.0, 4.0, 0.0]


# --- model ------------------------------------------------------------------------------------


def test_fit_recovers_known_errors(spark):
    """Two kicks from noisy readings of 400 turns, with absent readings and derivatives, and a knob that nothing shows."""
    rng = np.random.default_rng(7)
    jac = {f"m{k}": [float(np.cos(k)), float(np.sin(1.7 * k)), 0.0] for k in range(12)}
    truth = np.array([2e-4, -1e-4, 0.0])
    rows = [(n, float(np.dot(j, truth) + 1e-6 * rng.normal()), 1e12) for n, j in jac.items() for _ in range(400)]
    rows += [("m1", None, 1e12), ("m2", 5.0, 0.0), ("m3", 1.0, None), ("other", 9.0, 1.0), ("blank", 9.0, 1.0)]
    response = spark.createDataFrame([*jac.items(), ("blank", None)], "name string, jac array<double>")
    fit = fit_linear(spark.createDataFrame(rows, "name string, measured double, weight double"), response, ["a", "b", "dead"], prior=1.0)
    assert np.allclose(fit.outcome.values, truth, atol=5 * fit.sigma[0]) and fit.degeneracy.insensitive == ("dead",)
    assert fit.sigma[0] < 1e-7


def test_normal_matrix_counts_only_whole_readings(spark):
    rows = [(1.0, [1.0, 2.0]), (2.0, [0.5, -1.0]), (None, [9.0, 9.0]), (1.0, None), (1.0, [None, 1.0]), (0.0, [7.0, 7.0])]
    got = reductions.normal_matrix(spark.createDataFrame(rows, "weight double, jac array<double>"), "jac").collect()
    assert {(r.a, r.b): r.value for r in got} == {(0, 0): 1.5, (1, 0): 1.0, (1, 1): 6.0}
