"""Plans from one reading, tables of a machine, and sources given twice or half."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orbitweave.jobs import plans as plan_jobs
from orbitweave.operators import corrections, machine, plans
from orbitweave.sources import measurement_files, run_logs, text_tables

FOLDER = "/root/testdata/sf0.001"


def scans_of(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


@pytest.mark.parametrize("job", [plan_jobs.arc_plan, plan_jobs.kicker_plan])
def test_plans_read_the_measurements_once(spark, job, monkeypatch):
    read = []
    monkeypatch.setattr(plan_jobs, "measurements", lambda *a, f=plan_jobs.measurements: read.append(1) or f(*a))
    plan = job(spark, FOLDER)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert len(read) == 1 and "events.parquet" not in text and 0 < scans_of(plan) <= 8
    assert plan.count() > 0


def test_points_of_a_summary_equal_points_of_readings(spark):
    rows = spark.createDataFrame([(0, 0, t, n, None if (t + k) % 5 == 0 else 1.0) for t in range(9) for k, n in enumerate("abc") if (t, n) != (3, "b")] + [(1, 2, 7, "a", None)], "file_idx int, bunch int, turn int, name string, x double")
    want = plans.observed_points(rows, ["a", "b", "c", "d"], 60)
    got = plans.summary_points(plans.turn_summary(rows, "x"), ["a", "b", "c", "d"], 60)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_measurement_given_twice_is_refused(spark, tmp_path):
    path = str(tmp_path / "run")
    rows = spark.createDataFrame([("BPM.01", 0, 0, *[1.0] * 8)], measurement_files.SCHEMA)
    measurement_files.write_measurements(rows, path)
    assert measurement_files.read_measurements(spark, [path]).count() == 1
    inside = next(str(f) for f in (tmp_path / "run").iterdir() if f.suffix == ".parquet")
    for again in (path, f"file:{path}", str(tmp_path / "x" / ".." / "run"), inside):
        with pytest.raises(ValueError, match="twice"):
            measurement_files.read_measurements(spark, [path, again])


def test_knobs_are_written_and_read_back(spark, tmp_path):
    values = [("k.b", 1.5e-17), ("k.a", -2.0)]
    text_tables.write_knobs(spark.createDataFrame(values, "name string, value double").coalesce(1), str(tmp_path / "knobs"))
    file = next(f for f in (tmp_path / "knobs").iterdir() if f.suffix == ".txt")
    assert sorted((r.name, r.value) for r in text_tables.read_knobs(spark, str(file)).collect()) == sorted(values)


def test_error_tables_and_results(spark, tmp_path):
    (tmp_path / "b2.errors").write_text('* NAME K1L K2L\n$ %s %le %le\n "Q.1" 1e-4 0\n Q.2 -2e-4 0\n Q.2 3e-4 0\n')
    assert sorted(map(tuple, text_tables.read_error_strengths(spark, str(tmp_path / "b2.errors")).collect())) == [("Q.1", 1e-4), ("Q.2", 3e-4)]
    (tmp_path / "no.errors").write_text("* NAME K0L\n$ %s %le\n Q.1 1\n")
    with pytest.raises(ValueError, match="k1l"):
        text_tables.read_error_strengths(spark, str(tmp_path / "no.errors"))
    for name, text in (("a", json.dumps({"loss": 2.5, "values": {"k": 1.0}, "other": 1})), ("b", "{half")):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "result.json").write_text(text)
    got = {r.path.rsplit("/", 1)[1]: (r.loss, r["values"]) for r in run_logs.read_results(spark, [str(tmp_path / "runs")]).collect()}
    assert got == {"a": (2.5, {"k": 1.0}), "b": (None, None)}


def test_groups_signs_and_orders(spark):
    members = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3)], "cell string, member int")
    groups = spark.createDataFrame([("g", 0.5)], "cell string, strength double")
    assert sorted(map(tuple, machine.expand_groups(groups, members.where("cell = 'g'"), "cell", "strength").collect())) == [(1, 0.5), (2, 0.5)]
    with pytest.raises(PySparkException, match="no value for h"):
        machine.expand_groups(groups, members, "cell", "strength").collect()
    signs = spark.createDataFrame([("a", -1.0, True), ("a", 0.0, True), ("a", -1.0, False)], "g string, k double, split boolean")
    assert [r[0] for r in signs.select(machine.by_sign(F.col("g"), F.col("k"), F.col("split"))).collect()] == ["a_n", "a_p", "a"]
    names = spark.createDataFrame([("bpmA",), ("q1",), (None,)], "name string")
    assert [r.name for r in machine.drop_prefixes(names, "name", ["BPM"]).collect()] == ["q1", None]
    assert machine.drop_prefixes(names, "name", []).count() == 3
    assert [(r.name, r.place) for r in machine.in_given_order(names, "name", ["z", "q1", "q1"]).collect()] == [("q1", 1)]
    assert machine.in_given_order(names, "name", []).collect() == []


def test_unknown_names_and_missing_columns_are_errors(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, betx double")
    assert machine.all_or_raise(rows, rows, "name", "unknown").count() == 2
    with pytest.raises(PySparkException, match="unknown b"):
        machine.all_or_raise(rows, rows.where("name = 'a'"), "name", "unknown").collect()
    columns = {"beta": ("betx", "errbetx"), "phase": ("mux", "errmux"), "dx": ("dx", "errdx")}
    out = corrections.optics_measurement(rows, columns, ["beta"])
    assert out.columns == ["name", "betx", "errbetx"] and out.where(F.isnan("errbetx")).count() == 2
    with pytest.raises(ValueError, match=r"\['dx', 'mux'\]"):
        corrections.optics_measurement(rows, columns, ["beta", "phase", "dx"])
