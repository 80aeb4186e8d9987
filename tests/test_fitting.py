"""Packed sums, triangular factors, calibrated and momentum fits, sparse sums, rules and ids against plain numpy and Python."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orbitweave.functions import reading_ids
from orbitweave.jobs.calibrated import fit_calibrated
from orbitweave.jobs.epochs import EpochFit, linear_batches
from orbitweave.jobs.momenta import at_reference, fit_each
from orbitweave.operators import packed_sums, prepare, reductions, rules
from orbitweave.operators.solvers import Adam, degeneracy
from orbitweave.operators.tall_qr import degeneracy_of, tall_qr
from orbitweave.sources.optics_cache import OpticsCache
from orbitweave.sources.shared_tables import Versions
from orbitweave.sources.turn_tables import gather_turns, read_turn_table, shuffles, write_turn_table


def test_packed_sums_by_key_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 7 == 0 else f"k{i % 3}", int(i % 2), rng.normal(size=3).tolist(), float(rng.uniform(0.1, 2))) for i in range(400)]
    odd = [("k0", 0, [1.0, None, 2.0], 1.0), ("k0", 0, [1.0, 2.0], 1.0), ("k0", 0, None, 1.0), ("k0", 0, [1.0, 2.0, 3.0], None), ("lone", 0, [1.0, 2.0, 3.0], 0.0)]
    frame = spark.createDataFrame(rows + odd, "name string, part int, v array<double>, w double").repartition(5)
    got = packed_sums.sums_by_key(frame, ["name", "part"], F.col("v"), 3, F.col("w"))
    out = {(r.name, r.part): (r.n, packed_sums.unpack(np.array([r.sums]), 3)[0]) for r in got.select("name", "part", "n", "sums").collect()}
    want = {}
    for name, part, v, w in rows:
        n, m = want.get((name, part), (0, 0.0))
        want[name, part] = n + 1, m + w * np.outer(v, v)
    assert out.keys() == want.keys() and len(out) == 8
    for key, (n, m) in want.items():
        assert out[key][0] == n
        np.testing.assert_allclose(out[key][1], m, rtol=1e-12)
    assert packed_sums.sums_by_key(frame.where("false"), ["name"], F.col("v"), 3, F.col("w")).collect() == []


def jacobian_frame(spark, j, parts=40):
    rows = spark.createDataFrame([(row.tolist(), 1.0) for row in j], "jac array<double>, w double")
    return rows.repartition(parts)


def test_a_factor_tells_what_the_normal_matrix_cannot(spark):
    rng = np.random.default_rng(2)
    j = rng.normal(size=(500, 4))
    j = np.column_stack([j, j[:, 0] + 1e-10 * rng.normal(size=500), j[:, 2] - j[:, 3], np.zeros(500)])  # condition 1e10, one exact dependence, one dead
    names = [f"k{i}" for i in range(7)]
    frame = jacobian_frame(spark, j)
    odd = spark.createDataFrame([([1.0] * 6 + [None], 1.0), (None, 1.0), ([9.0] * 7, 0.0), ([9.0] * 7, float("nan")), ([9.0], 1.0)], frame.schema)
    r = tall_qr(frame.union(odd), F.col("jac"), 7, F.col("w"), fan=4)
    np.testing.assert_allclose(r.T @ r, j.T @ j, atol=1e-9)
    assert (np.diag(r) >= 0).all() and np.allclose(r, np.triu(r))
    told = degeneracy_of(r, names, rel_tol=1e-13)
    assert told.rank == 5 and told.insensitive == ("k6",)
    assert {n for _, direction in told.directions for n, _ in direction} >= {"k2", "k3", "k5"}
    # The near dependence is a direction of its own, 1e-10 of the largest; the normal matrix takes it for noise.
    assert 1e-11 < sorted(told.relative)[2] < 1e-9
    assert degeneracy(j.T @ j, names, rel_tol=1e-13).rank != 5 or degeneracy(j.T @ j, names, rel_tol=1e-17).rank > 5
    assert tall_qr(frame.where("false"), F.col("jac"), 7).tolist() == np.zeros((7, 7)).tolist()


def dense_calibrated(readings, names, k, ridge, alphas, steps):
    """Gauss-Newton steps for knobs and all gains in one dense system."""
    monitors = sorted(set(names))
    u, g = np.zeros(k), np.zeros(len(monitors))
    for _ in range(steps):
        normal, right = np.zeros((k + len(g),) * 2), np.zeros(k + len(g))
        for (m, j, y, w), name in zip(readings, names, strict=True):
            i = monitors.index(name)
            p = m + j @ u
            row = np.zeros(k + len(g))
            row[:k], row[k + i] = (1 + g[i]) * j, p
            normal += w * np.outer(row, row)
            right += w * row * ((1 + g[i]) * p - y)
        normal[range(k), range(k)] += alphas
        normal[range(k, k + len(g)), range(k, k + len(g))] += ridge
        right += np.concatenate([alphas * u, ridge * g])
        step = -np.linalg.solve(normal, right)
        u, g = u + step[:k], g + step[k:]
    return u, dict(zip(monitors, g, strict=True))


@pytest.mark.parametrize("strengths", [None, {"kick": 0.05, "tilt": 0.5}])
def test_a_calibrated_fit_equals_the_dense_system(spark, strengths):
    rng = np.random.default_rng(4)
    truth, names, readings = np.array([0.3, -0.2, 0.5]), [], []
    gain = {f"m{i}": rng.normal(scale=0.1) for i in range(12)}
    for _ in range(600):
        name = f"m{rng.integers(12)}"
        m, j, w = 2 + rng.normal(), rng.normal(size=3), float(rng.uniform(0.5, 2))
        readings.append((m, j, (1 + gain[name]) * (m + j @ truth) + rng.normal(scale=0.01), w))
        names.append(name)
    rows = [(n, float(m), j.tolist(), float(y), w) for n, (m, j, y, w) in zip(names, readings, strict=True)]
    rows += [("m0", 1.0, [1.0, 1.0, 1.0], float("nan"), 1.0), ("m0", 1.0, [1.0, 1.0, 1.0], 9.0, 0.0), ("m0", 1.0, [1.0, None, 1.0], 9.0, 1.0), ("m0", None, [1.0] * 3, 9.0, 1.0)]
    frame = spark.createDataFrame(rows, "name string, model double, jac array<double>, measured double, weight double").repartition(6)
    families = ["kick", "kick", "tilt"]
    fit = fit_calibrated(frame, "name", ["a", "b", "c"], ridge=0.3, strengths=strengths, families=families, steps=4, loss_limit=0.0)
    alphas = np.zeros(3)
    if strengths:
        diagonal = sum(w * j * j for _, j, _, w in readings)
        alphas = np.array([0.05 * np.median(diagonal[:2])] * 2 + [0.5 * diagonal[2]])
    u, g = dense_calibrated(readings, names, 3, 0.3, alphas, len(fit.losses) - 1)
    np.testing.assert_allclose(fit.values, u, rtol=1e-9, atol=1e-12)
    got = {r.name: r for r in fit.gains.collect()}
    np.testing.assert_allclose([got[n].gain for n in sorted(g)], [g[n] for n in sorted(g)], rtol=1e-8, atol=1e-11)
    assert list(fit.losses) == sorted(fit.losses, reverse=True) and all(0 < r.sigma < 1 for r in got.values())
    if not strengths:
        assert np.abs(fit.values - truth).max() < 0.05


def test_priors_need_every_family(spark):
    frame = spark.createDataFrame([("m", 1.0, [1.0], 1.5, 1.0)], "name string, model double, jac array<double>, measured double, weight double")
    with pytest.raises(ValueError, match="differ"):
        fit_calibrated(frame, "name", ["k.kick"], 1.0, {"tilt": 1.0})


def test_many_fits_and_their_reference(spark):
    rng = np.random.default_rng(6)
    rows = []
    for series in range(9):
        for momentum in (-0.002, 0.0, 0.004):
            for _ in range(20):
                j = rng.normal(size=2)
                rows.append((series, momentum, j.tolist(), float(j @ [series + 100 * momentum, -1.0]), 1.0))
    rows += [(20, 0.0, [1.0, 0.0], 2.0, 1.0), (20, 0.1, [1.0, 0.0], 4.0, 1.0)]  # the second knob is free
    frame = spark.createDataFrame(rows, "series int, momentum double, jac array<double>, r double, w double").repartition(4)
    fits = fit_each(frame, ["series", "momentum"], F.col("jac"), F.col("r"), F.col("w"), 2, 0.0)
    got = {r.series: r["values"] for r in at_reference(fits, "series", "momentum", 0.001).collect()}
    for series in range(9):
        np.testing.assert_allclose(got[series], [series + 0.1, -1.0], atol=1e-10)
    np.testing.assert_allclose(got[20], [2.02, 0.0], atol=1e-10)
    outside = {r.series: r["values"] for r in at_reference(fits, "series", "momentum", 7.0).collect()}
    np.testing.assert_allclose(outside[3], [3.4, -1.0], atol=1e-10)
    with pytest.raises(PySparkException, match="single momentum in series 1"):
        at_reference(fits.where("series = 1 and momentum = 0"), "series", "momentum", 0.0).collect()
    with pytest.raises(ValueError, match="negative"):
        fit_each(frame, ["series"], F.col("jac"), F.col("r"), F.col("w"), 2, -1.0)
    assert fits._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2  # of it one deals the test's rows


def test_thousands_of_knobs_in_sparse_sensitivities(spark):
    rng = np.random.default_rng(7)
    knobs, parts, dense = 5000, [], np.zeros((60, 5000))
    for reading in range(60):
        for _ in range(3):
            own = rng.choice(knobs, 6, replace=False)
            values = rng.normal(size=6)
            dense[reading, own] += values
            parts.append((reading, [(int(k), float(v)) for k, v in zip(own, values, strict=True)], 0.5))
    parts += [(70, [], 0.5), (71, None, 0.5)]
    frame = spark.createDataFrame(parts, "reading_id long, g array<struct<knob: long, value: double>>, variance double").repartition(4)
    merged = reductions.merge_readings(frame)
    assert {r.reading_id: r.g for r in merged.where("reading_id >= 70").collect()} == {70: [], 71: []}
    for held in (2, 64):
        blocks = reductions.outer_blocks(merged, "variance", block=200, held=held).collect()
        got = np.zeros((knobs, knobs))
        for r in blocks:
            assert r.a >= r.b
            got[r.a, r.b] = r.value
        np.testing.assert_allclose(got, np.tril(0.5 * dense.T @ dense), atol=1e-12)


def test_dense_and_sparse_merging_agree(spark):
    frame = spark.createDataFrame([(1, [1.0, None, 2.0], 0.5), (1, [1.0, 5.0, -1.0], None), (2, [0.0, 1.0, 0.0], float("inf"))], "reading_id long, g array<double>, variance double")
    pairs = frame.withColumn("g", F.transform("g", lambda v, k: F.struct(k.alias("knob"), v.alias("value"))))
    dense = {r.reading_id: (r.g, r.variance) for r in reductions.merge_readings(frame).collect()}
    assert dense == {1: ([2.0, 5.0, 1.0], 0.5), 2: ([0.0, 1.0, 0.0], float("inf"))}
    assert {r.reading_id: ([p.value for p in r.g], r.variance) for r in reductions.merge_readings(pairs).collect()} == dense


def test_reading_ids_keep_order_and_refuse_overflow(spark):
    rows = [(0, 0, 0, 0), (0, 0, 0, 7), (0, 0, 1, 0), (0, 1, 0, 0), (1, 0, 0, 0), (2**20 - 1, 2**24 - 1, 2**16 - 1, 7)]
    frame = spark.createDataFrame(rows, "file long, turn long, monitor long, plane long")
    packed = frame.select(reading_ids.pack(**{c: F.col(c) for c in frame.columns}).alias("id"))
    assert [tuple(r) for r in packed.orderBy("id").select(*reading_ids.unpack(F.col("id"))).collect()] == rows
    assert packed.agg(F.max("id")).first()[0] == 2**63 - 1
    assert spark.range(1).select(reading_ids.pack(file=F.lit(None), turn=F.lit(1), monitor=F.lit(1), plane=F.lit(1))).first()[0] is None
    for bad in ({"plane": 8}, {"turn": 2**24}, {"file": -1}):
        parts = {c: F.lit(bad.get(c, 0)) for c in frame.columns}
        with pytest.raises(PySparkException, match=f"{next(iter(bad))} does not fit"):
            spark.range(1).select(reading_ids.pack(**parts)).collect()


def test_rules_are_told_or_raised(spark):
    frame = spark.createDataFrame([(1, 5, "a"), (2, -1, None), (3, -7, "c"), (None, 0, "d")], "id int, n int, broken_rules string")
    both = {"negative": F.col("n") < 0, "no name": F.col("broken_rules").isNull(), "far": F.col("n") < -5}
    got = sorted(map(tuple, rules.violations(frame, ["id"], both).collect()))
    assert got == [(2, "negative"), (2, "no name"), (3, "far"), (3, "negative")]
    assert rules.checked(frame.where("n >= 0"), ["id"], both).columns == frame.columns
    assert rules.checked(frame.where("n >= 0"), ["id"], both).count() == 2
    with pytest.raises(PySparkException, match="id=3 breaks negative, far"):
        rules.checked(frame.where("id = 3"), ["id"], both).collect()


def test_versions_go_back(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    for k, x in ((0, 1.0), (1, 2.0), (2, 9.0), (1, 3.0)):
        versions.save(k, spark.createDataFrame([(x,)], "x double"))
    assert [versions.load(k).first().x for k in (0, 1)] == [1.0, 3.0]
    assert versions.history(1).count() == 2


def test_an_epoch_is_taken_back_from_its_version_with_the_optimiser(spark, tmp_path):
    calls = []

    def evaluate(values, batch):
        calls.append(batch)
        if len(calls) == 6:  # the second batch of the third epoch
            return float("nan"), values
        return float(values @ values), 2 * values

    def fitted(versions, epochs, start, first=0):
        fit = EpochFit(evaluate, [0, 1], Adam(), rate=lambda e: 0.05, stop_change=0.0, versions=versions)
        fit.run(start, epochs, first)
        return fit

    versions = Versions(spark, str(tmp_path / "v"))
    fit = fitted(versions, 5, np.array([1.0, -1.0]))
    assert [p.lost for p in fit.history] == [False, False, True, False, False]
    assert fit.history[2].values.tolist() == fit.history[1].values.tolist()
    # Without the lost epoch the same steps follow: neither values nor moments kept anything of it.
    calls[:] = [0] * 10
    plain = fitted(None, 4, np.array([1.0, -1.0]))
    assert [p.values.tolist() for p in plain.history] == [p.values.tolist() for k, p in enumerate(fit.history) if k != 2]
    told = {r.version: (r.value, r.lost) for r in versions.history(5).where("knob = 0").collect()}
    assert told[3] == (fit.history[2].values[0], True) and sorted(told) == [0, 1, 2, 3, 4, 5]
    # A run that goes on from a version takes the steps that were taken.
    again = fitted(versions, 2, None, first=3)
    assert [p.values.tolist() for p in again.history] == [p.values.tolist() for p in fit.history[3:]]


def test_batches_of_a_linear_machine(spark):
    rng = np.random.default_rng(9)
    rows = [(rng.normal(size=3).tolist(), float(rng.normal()), float(i % 4), i % 2) for i in range(80)]
    frame = spark.createDataFrame(rows, "jac array<double>, target double, weight double, batch int").repartition(3)
    evaluate = linear_batches(frame, 3)
    v = np.array([0.5, -1.0, 2.0])
    for batch in (0, 1):
        own = [(np.array(j), t, w) for j, t, w, b in rows if b == batch and w > 0]
        loss, gradient = evaluate(v, batch)
        np.testing.assert_allclose(loss, sum(w * (j @ v - t) ** 2 for j, t, w in own) / len(own))
        np.testing.assert_allclose(gradient, sum(2 * w * j * (j @ v - t) for j, t, w in own) / len(own))
    assert evaluate(v, 7) == (0.0, pytest.approx(np.zeros(3)))


def test_the_cache_computes_once_and_drops_the_least_recently_used(spark, tmp_path):
    asked = []

    def compute(missing):
        asked.append(sorted(r.key for r in missing.collect()))
        return missing.select("key", (F.length("key") + F.col("x")).cast("double").alias("beta")).withColumn("s", F.explode(F.array(F.lit(1), F.lit(2))))

    def cache(model="a"):
        return OpticsCache(spark, str(tmp_path), {"model": model}, "key", "key string, s int, beta double", compute)

    def request(*keys, of=None):
        rows = spark.createDataFrame([(k, 1) for k in keys], "key string, x int")
        return sorted((r.key, r.s, r.beta) for r in (of or cache()).get(rows).collect())

    assert request("a", "bb", "a", None) == [("a", 1, 2.0), ("a", 2, 2.0), ("bb", 1, 3.0), ("bb", 2, 3.0)]
    request("ccc", "bb")
    request("a", "bb", "ccc")
    request("a", of=cache("other"))
    assert asked == [["a", "bb"], ["ccc"], ["a"]]
    request("bb")
    request("ccc")
    assert cache().evict(2) == 1 and sorted(r.key for r in cache().keys().collect()) == ["bb", "ccc"]
    assert request("a") == [("a", 1, 2.0), ("a", 2, 2.0)] and asked[-1] == ["a"]
    assert cache().evict(5) == 0 and request() == []
    assert cache("empty").evict(1) == 0


def test_grids_and_gathers_on_turn_tables_need_no_shuffle(spark, tmp_path):
    rows = spark.range(4000).select(
        F.expr("id div 2000").cast("int").alias("file_idx"), F.expr("(id div 4) % 500").cast("int").alias("turn"), F.concat(F.lit("B"), (F.col("id") % 4).cast("string")).alias("name"),
        F.col("id").cast("double").alias("x"), F.lit(1.0).alias("var_x"),
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, frame in (("turns_a", rows), ("turns_b", rows.where("id % 3 = 0").drop("x", "var_x"))):
            write_turn_table(frame, name, buckets=6, path=str(tmp_path / name))
        table, asked = read_turn_table(spark, "turns_a"), read_turn_table(spark, "turns_b")
        grid = prepare.complete_grid(table, ["B0", "B1", "B5"], ["x"])
        assert shuffles(grid) == 0 and shuffles(prepare.complete_grid(rows, ["B0", "B1", "B5"], ["x"])) == 1
        assert sorted(grid.collect()) == sorted(prepare.complete_grid(rows, ["B0", "B1", "B5"], ["x"]).collect())
        gathered = gather_turns(asked, table)
        assert shuffles(gathered) == 0 and gathered.count() == asked.count() and gathered.where("x is null").isEmpty()
        assert shuffles(gather_turns(rows.drop("x", "var_x"), rows)) == 2
        assert gather_turns(asked.limit(1).withColumn("name", F.lit("B9")), table).first().x is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("turns_a", "turns_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
