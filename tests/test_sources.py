"""Files of measurements, machines and runs, and streams of steps."""

import json
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbitweave.operators.machine import corrector_changes
from orbitweave.sources import measurement_files, run_logs, text_tables


def test_measurements_keep_file_and_row(spark, tmp_path):
    for i, names in enumerate((["B2", "B1", "B2"], ["B1"])):
        pd.DataFrame(
            {"name": names, "turn": pd.array(range(len(names)), "int32"), "bunch_number": pd.array([0] * len(names), "int32")}
            | {c: [float("nan") if k == 0 else k * 1.0 for k in range(len(names))] for c in measurement_files.COLUMNS[3:]}
        ).to_parquet(tmp_path / f"m{i}.parquet")
    paths = [str(tmp_path / "m1.parquet"), str(tmp_path / "m0.parquet")]
    df = measurement_files.read_measurements(spark, paths, ["B2"])
    assert sorted((r.file_idx, r.row_index, r.x) for r in df.collect() if r.x is not None) == [(1, 2, 2.0)]
    assert sorted((r.file_idx, r.row_index) for r in df.collect()) == [(1, 0), (1, 2)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "name" in plan.split("PushedFilters")[1][:120]
    pd.DataFrame({"name": ["B1"]}).to_parquet(tmp_path / "bad.parquet")
    with pytest.raises(ValueError, match="lacks"):
        measurement_files.read_measurements(spark, [str(tmp_path / "bad.parquet")])


def test_text_tables(spark, tmp_path):
    (tmp_path / "noise.txt").write_text("BPM  H V\n bpm.1  0.5 1.0 \nBPM.2\t0 0\n\n")
    got = sorted(map(tuple, text_tables.read_noise_table(spark, str(tmp_path / "noise.txt")).collect()))
    assert got == [("BPM.1", 0.0005, 0.001), ("BPM.2", 0.0, 0.0)]
    (tmp_path / "knobs.txt").write_text("kq1\t1e-3\nkq2\t 2\nkq1\t5")
    assert sorted((r.name, r.value) for r in text_tables.read_knobs(spark, str(tmp_path / "knobs.txt")).collect()) == [("kq1", 5.0), ("kq2", 2.0)]
    (tmp_path / "t.tfs").write_text(
        '@ ENERGY %le 450.0\n@ TITLE %s "two words"\n* NAME KIND HKICK_OLD HKICK VKICK_OLD VKICK\n$ %s %s %le %le %le %le\n'
        '# note\n "C 1" tkicker 0 1e-6 0 0\n "C2" hkicker 1 1 0 5\n "C3" vkicker 0 0 1 2\n'
    )
    table, headers = text_tables.read_tfs(spark, str(tmp_path / "t.tfs"))
    assert headers == {"energy": "450.0", "title": "two words"} and table.dtypes[3] == ("hkick_old", "double")
    assert sorted(map(tuple, corrector_changes(table).collect())) == [("C 1.hkick", 1e-6), ("C3.vkick", 2.0)]
    (tmp_path / "bad.tfs").write_text("* A B\n$ %s\n x 1\n")
    with pytest.raises(ValueError, match="names and types"):
        text_tables.read_tfs(spark, str(tmp_path / "bad.tfs"))
    (tmp_path / "arcs.tsv").write_text("beam1\t0.5, 1.5\n")
    assert [tuple(r) for r in text_tables.read_arc_results(spark, str(tmp_path / "arcs.tsv")).orderBy("arc").collect()] == [(0, "beam1", 0, 0.5), (0, "beam1", 1, 1.5)]


def test_run_log_with_cut_tails(spark, tmp_path):
    folder = tmp_path / "runs" / "one"
    folder.mkdir(parents=True)
    steps = [(-1, 10.0), (0, 9.0), (1, 9.5), (2, 8.0)]
    (folder / "stage.json").write_text(json.dumps({"name": "fit", "started": 1.0, "knob_names": ["a", "b"], "metadata": {"seed": "1"}}))
    (folder / "history.jsonl").write_text("".join(json.dumps({"step": k, "loss": x, "new_best": x < 9.2}) + "\n" for k, x in steps))
    (folder / "knobs.f64").write_bytes(b"".join(struct.pack("<3d", k, k, 2 * k) for k, _ in steps))
    with (folder / "history.jsonl").open("a") as f:
        f.write('{"step": 3, "lo')
    with (folder / "knobs.f64").open("ab") as f:
        f.write(struct.pack("<3d", 2, 7, 8) + b"\0" * 11)
    history = sorted((r.step, r.loss) for r in run_logs.read_history(spark, str(folder / "history.jsonl")).collect())
    assert history == [(-1, 10.0), (0, 9.0), (1, 9.5), (2, 8.0)]
    knobs = {(r.step, r.knob): r.value for r in run_logs.read_knob_rows(spark, str(folder / "knobs.f64"), ["a", "b"]).collect()}
    assert knobs[2, "a"] == 7 and knobs[1, "b"] == 2 and len(knobs) == 8
    stages = run_logs.read_stages(spark, [str(tmp_path / "runs")])
    assert [(r.name, r.knob_names, r.metadata) for r in stages.collect()] == [("fit", ["a", "b"], {"seed": "1"})]
    here = stages.select("path")
    assert run_logs.unfinished(stages, here.where("false"), here, "fit").count() == 1
    assert run_logs.unfinished(stages, here, here, "fit").count() == 0


def test_a_run_resumes_without_cutting_files(spark, tmp_path):
    folder = str(tmp_path / "run")

    def add(attempt, rows):
        run_logs.append_steps(spark.createDataFrame(rows, "step long, loss double"), folder, attempt)

    first = run_logs.begin_attempt(spark, folder, "fit", ["a", "b"])
    add(first, [(0, 9.0), (1, 9.5)])
    add(first, [(2, 8.0), (3, 7.0)])
    second = run_logs.begin_attempt(spark, folder, "fit", ["a", "b"], resume_step=2)
    add(second, [(2, 6.0)])
    third = run_logs.begin_attempt(spark, folder, "fit", ["a", "b"], resume_step=1)
    assert (first, second, third) == (0, 1, 2)
    assert [tuple(r) for r in run_logs.current_steps(spark, folder).orderBy("step").collect()] == [(0, 9.0)]
    add(third, [(1, 5.0), (2, 4.0)])
    assert [tuple(r) for r in run_logs.current_steps(spark, folder).orderBy("step").collect()] == [(0, 9.0), (1, 5.0), (2, 4.0)]
    with pytest.raises(ValueError, match="other knobs"):
        run_logs.begin_attempt(spark, folder, "fit", ["a"], resume_step=1)


def test_a_bad_line_ends_the_history(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"step": 0, "loss": 1.0}\nnot json\n{"step": 1, "loss": 0.5}\n')
    assert [r.step for r in run_logs.read_history(spark, str(tmp_path / "h.jsonl")).collect()] == [0]


def test_files_keep_their_own_index(spark, tmp_path):
    names = ["run1", "run10", "run 1+a", "folder"]
    paths = [str(tmp_path / n) for n in names]
    for k, path in enumerate(paths):
        row = ("BPM.01", k, 0, *[float(k)] * 8)
        measurement_files.write_measurements(spark.createDataFrame([row] * 2, measurement_files.SCHEMA).coalesce(1), path)
    # One file by its own name, one by a relative way to its folder.
    inside = next(str(f) for f in (tmp_path / "run10").iterdir() if f.suffix == ".parquet")
    given = [paths[2], inside, paths[0], str(tmp_path / "run1" / ".." / "folder")]
    got = sorted((r.file_idx, r.turn) for r in measurement_files.read_measurements(spark, given).collect())
    assert got == [(0, 2), (0, 2), (1, 1), (1, 1), (2, 0), (2, 0), (3, 3), (3, 3)]


def test_checkpoints(tmp_path):
    path = tmp_path / "c.json"
    run_logs.save_checkpoint(path, 3, {"a": 1.0, "b": 2.0}, {"mean": [0.1, 0.2]})
    assert run_logs.load_checkpoint(path, ["b", "c", "a"]) == (3, {"b": 2.0, "a": 1.0}, {"mean": [0.2, 0.0, 0.1]})
    with pytest.raises(ValueError, match="unknown"):
        run_logs.load_checkpoint(path, ["a"])
    with pytest.raises(ValueError, match="finite"):
        run_logs.save_checkpoint(path, 0, {"a": float("nan")}, {})
