"""Files that grow, and the state of runs that are followed."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from orbitweave.streaming.growing_files import GrowingReader, follow_history, follow_knob_rows, read_growing
from orbitweave.streaming.run_state import PROVIDER, keep_changes, newest, run_progress


def pull(reader, start):
    """(end, records by file) of what came since ``start``."""
    end, out = reader.latestOffset(), {}
    for part in reader.partitions(start, end):
        for batch in reader.read(part):
            for path, position, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.setdefault(path.rsplit("/", 1)[1], []).append((position, record))
    return end, out


@pytest.mark.parametrize("width", [0, 24])
def test_every_record_comes_once_and_complete(tmp_path, width):
    rng = random.Random(width)
    kinds = [b"", b"a", b"two words", b"\xff\r", b"x" * 90_000]
    content = {n: b"".join(rng.choice(kinds) + b"\n" for _ in range(40)) for n in ("one.log", "two.log")}
    want = {}
    for name, text in content.items():
        text = text[: len(text) // width * width] if width else text
        records = [text[k : k + width] for k in range(0, len(text), width)] if width else text.split(b"\n")[:-1]
        starts = [sum(len(r) + (not width) for r in records[:k]) for k in range(len(records))]
        want[name] = list(zip(starts, records, strict=True))
    reader = GrowingReader({"path": str(tmp_path), "pattern": "*.log", "record_bytes": str(width), "split_bytes": "7000"})
    (tmp_path / ".hidden.log").write_bytes(b"no\n")
    (tmp_path / "other.txt").write_bytes(b"no\n")
    offset, got, at = reader.initialOffset(), {}, dict.fromkeys(content, 0)
    while any(at[n] < len(c) for n, c in content.items()):
        for name, text in content.items():
            step = rng.choice([0, 1, 5, 60_000, 200_000])
            with (tmp_path / name).open("ab") as file:
                file.write(text[at[name] : at[name] + step])
            at[name] += step
        if rng.random() < 0.3:  # a restart: nothing but the offset is left
            reader = GrowingReader({"path": str(tmp_path), "pattern": "*.log", "record_bytes": str(width), "split_bytes": "7000"})
        offset, news = pull(reader, offset)
        for name, records in news.items():
            got.setdefault(name, []).extend(records)
    assert got == want


def test_a_replayed_range_is_the_same_and_a_shorter_file_is_read_anew(tmp_path):
    file = tmp_path / "h"
    reader = GrowingReader({"path": str(tmp_path)})
    assert reader.latestOffset() == {}
    file.write_bytes(b"1\n2\nhalf")
    first, rows = pull(reader, {})
    assert rows == {"h": [(0, b"1"), (2, b"2")]} and pull(reader, first) == (first, {})
    file.write_bytes(b"1\n2\nhalf done\n")
    second, rows = pull(reader, first)
    assert rows == {"h": [(4, b"half done")]}
    again = [b.column("record").to_pylist() for p in reader.partitions(first, second) for b in reader.read(p)]
    assert again == [[b"half done"]]
    file.write_bytes(b"new\n")
    assert pull(reader, second)[1] == {"h": [(0, b"new")]}


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    yield spark
    spark.conf.set(name, before)


def log(folder, rows, tail=""):
    folder.mkdir(parents=True, exist_ok=True)
    with (folder / "history.jsonl").open("a") as file:
        file.write("".join(json.dumps({"step": s, "loss": x}) + "\n" for s, x in rows) + tail)


def plain_progress(steps, alpha=0.2, limit=1e-6):
    """{step: (loss, best, best_step, ema, change, stop)} of a run's steps in order."""
    out, best, best_step, ema, last = {}, float("inf"), -1, 0.0, None
    for step, loss in sorted(steps.items()):
        if loss < best:
            best, best_step = loss, step
        before, ema = ema, loss if ema == 0.0 else alpha * ema + (1 - alpha) * loss
        change = (ema - before) / before if before and last is not None else 0.0
        out[step] = (loss, best, best_step, ema, change, last is not None and abs(change) < limit)
        last = loss
    return out


def followed(spark, folder, table, checkpoint, **options):
    writer = keep_changes(run_progress(follow_history(spark, str(folder)), **options), table, checkpoint)
    query = writer.trigger(once=True).start()  # timers keep a query without a trigger busy
    assert query.awaitTermination(120) and query.exception() is None
    rows = newest(spark, table).collect()
    got = {}
    for r in rows:
        if not r.finished:
            got.setdefault(r.run_id.rsplit("/", 1)[1], {})[r.step] = (r.loss, r.best, r.best_step, r.ema, r.change, r.stop)
    return got, {r.run_id.rsplit("/", 1)[1]: (r.step, r.best) for r in rows if r.finished}


def test_runs_are_followed_through_restarts_late_steps_and_cut_tails(rocks, tmp_path):
    logs, table, checkpoint = tmp_path / "logs", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    log(logs / "a", [(0, 10.0), (1, 9.0), (2, 9.5)], tail='{"step": 3, "lo')
    log(logs / "b", [(0, 5.0)])
    want = {"a": {0: 10.0, 1: 9.0, 2: 9.5}, "b": {0: 5.0}}
    check = lambda got: assert_equal(got, {k: plain_progress(v) for k, v in want.items()})

    def assert_equal(got, expected):
        assert got == expected

    check(followed(rocks, logs, table, checkpoint)[0])
    # The cut line is completed, step 1 comes again with another loss, run b gets a step before its first.
    log(logs / "a", [], tail='ss": 8.0}\n')
    log(logs / "a", [(1, 7.0), (4, 7.5)])
    log(logs / "b", [(-3, 6.0), (1, 5.0)])
    want["a"] |= {3: 8.0, 1: 7.0, 4: 7.5}
    want["b"] |= {-3: 6.0, 1: 5.0}
    check(followed(rocks, logs, table, checkpoint)[0])
    # Nothing new: a restart repeats nothing. Then a line that cannot be read ends run b.
    triggers = rocks.read.parquet(table).select("trigger").distinct().count()
    check(followed(rocks, logs, table, checkpoint)[0])
    assert rocks.read.parquet(table).select("trigger").distinct().count() <= triggers + 1
    log(logs / "b", [], tail="no json\n")
    log(logs / "b", [(2, 1.0)])
    log(logs / "a", [(5, 7.4)])
    want["a"][5] = 7.4
    check(followed(rocks, logs, table, checkpoint)[0])


def test_a_replayed_trigger_takes_the_place_of_itself(rocks, tmp_path):
    rows = rocks.createDataFrame([("r", 0, 2.0, 2.0, 0, 2.0, 0.0, False, False)], "run_id string, step long, loss double, best double, best_step long, ema double, change double, stop boolean, finished boolean")
    table = str(tmp_path / "table")
    for trigger, loss in ((0, 1.0), (1, 3.0), (1, 4.0)):
        rows.withColumn("loss", F.lit(loss)).write.mode("overwrite").parquet(f"{table}/trigger={trigger}")
    assert [r.loss for r in newest(rocks, table).collect()] == [4.0]


def test_a_run_without_news_is_finished_and_its_state_goes(rocks, tmp_path):
    logs, table, checkpoint = tmp_path / "logs", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    log(logs / "a", [(0, 3.0), (1, 2.0)])
    followed(rocks, logs, table, checkpoint, idle_ms=1)
    log(logs / "b", [(0, 1.0)])
    got, finished = followed(rocks, logs, table, checkpoint, idle_ms=1)
    assert finished["a"] == (1, 2.0) and got["a"] == plain_progress({0: 3.0, 1: 2.0})
    # It goes on: a run that was finished starts afresh.
    log(logs / "a", [(2, 9.0)])
    got, _ = followed(rocks, logs, table, checkpoint, idle_ms=3_600_000)
    assert got["a"][2][:3] == (9.0, 9.0, 2)


def test_binary_rows_that_grow(spark, tmp_path):
    folder = tmp_path / "run"
    folder.mkdir()
    rows = [struct.pack("<3d", s, s + 0.5, -s) for s in range(5)]
    (folder / "knobs.f64").write_bytes(b"".join(rows[:3]) + rows[3][:10])
    source = follow_knob_rows(spark, str(tmp_path), ["k0", "k1"])
    got = []
    query = source.writeStream.foreachBatch(lambda b, n: got.extend((r.step, list(r.values)) for r in b.collect())).start()
    try:
        query.processAllAvailable()
        assert sorted(got) == [(s, [s + 0.5, -float(s)]) for s in range(3)]
        (folder / "knobs.f64").write_bytes(b"".join(rows))
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(got) == [(s, [s + 0.5, -float(s)]) for s in range(5)]


def test_lines_of_an_empty_folder(spark, tmp_path):
    query = read_growing(spark, str(tmp_path)).writeStream.format("memory").queryName("nothing").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("nothing").count() == 0
