"""Preparation and planning operators on small frames with known outcomes."""

import pytest
from pyspark.sql import functions as F

from orbitweave.functions.missing import weight
from orbitweave.functions.names import parse_selection, result_name
from orbitweave.functions.ring import distance, fractional, in_range
from orbitweave.functions.schedules import learning_rate
from orbitweave.operators import batches, prepare, ranges

INF, NAN = float("inf"), float("nan")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is None, 0 if x is None else x) for x in r])


def test_weights_of_every_kind_of_variance(spark):
    df = spark.createDataFrame([(1, 4.0), (2, INF), (3, NAN), (4, 0.0), (5, -1.0), (6, None)], "k int, v double")
    assert [r[1] for r in rows(df.select("k", weight(F.col("v")).alias("w")), "k", "w")] == [0.25, 0, 0, 0, 0, 0]


def test_ring_arithmetic(spark):
    df = spark.createDataFrame([(3, 1, 2), (0, 6, 1), (7, 6, 1), (4, 6, 1), (2, 2, 2)], "p int, s int, e int")
    out = rows(df.select("p", in_range(F.col("p"), F.col("s"), F.col("e")).alias("r"), distance(F.col("p"), F.col("s"), 8).alias("d")), "p", "r", "d")
    assert out == [(0, True, 2), (2, True, 0), (3, False, 2), (4, False, 6), (7, True, 1)]
    assert [r[0] for r in rows(spark.createDataFrame([(-0.25,), (1.25,), (0.0,)], "x double").select(fractional(F.col("x")).alias("f")), "f")] == [0.0, 0.25, 0.75]


def test_grid_fills_only_missing_coordinates(spark):
    df = spark.createDataFrame([(0, 1, "B1", 2.0, None), (0, 1, "B2", None, 5.0), (0, 2, "B1", NAN, 1.0)], "file_idx int, turn int, name string, x double, var_x double")
    got = rows(prepare.complete_grid(df, ["B1", "B2"], ["x"]), "turn", "name", "x", "var_x")
    assert got == [(1, "B1", 2.0, None), (1, "B2", 0.0, INF), (2, "B1", 0.0, INF), (2, "B2", 0.0, INF)]


def test_variances_by_name(spark):
    df = spark.createDataFrame([("b1",), ("B2",), ("b3",)], "name string")
    noise = spark.createDataFrame([("B1", 0.5), ("b2", 0.0), ("B3", 2.0)], "name string, std double")
    assert rows(prepare.assign_variances(df, noise, bad=["B3"]), "name", "variance") == [("B2", INF), ("b1", 0.25), ("b3", INF)]
    with pytest.raises(Exception, match="no noise for monitor B9"):
        prepare.assign_variances(spark.createDataFrame([("B9",)], "name string"), noise).collect()
    blank = prepare.blank_variances(df.withColumn("variance", F.lit(1.0)), ["^B1", "3$"])
    assert [r[0] for r in rows(blank.where(F.isnan("variance")), "name")] == ["b1", "b3"]


def test_updates_patch_in_any_case_and_last_wins(spark):
    df = spark.createDataFrame([("B1", 1, 1.0, 1.0), ("B1", 2, 1.0, 1.0)], "name string, turn int, px double, py double")
    new = spark.createDataFrame([("b1", 1, 5.0, 7.0, 0), ("b1", 1, 6.0, NAN, 1), ("B7", 1, 9.0, 9.0, 2)], "name string, turn int, px double, py double, o int")
    assert rows(prepare.merge_updates(df, new, ["px", "py"], "o"), "name", "turn", "px", "py") == [("B1", 1, 6.0, 1.0), ("B1", 2, 1.0, 1.0)]


@pytest.mark.parametrize(("x", "y", "plane"), [(1.0, 1e-15, "x"), (1e-15, 1.0, "y"), (1.0, 0.5, "xy"), (1.0, 0.1, "x"), (0.0, 0.0, "xy")])
def test_kick_planes(spark, x, y, plane):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0), (0, x, None, y, NAN)], "file_idx int, x double, px double, y double, py double")
    assert rows(prepare.kick_planes(df), "plane") == [(plane,)]


def test_trim_keeps_monitors_from_the_kicker_on(spark):
    df = spark.createDataFrame([(0, t, p) for t in (1, 2, 3) for p in (0, 1, 2)] + [(1, 1, 0)], "file_idx int, turn int, ring_pos int")
    kicks = spark.createDataFrame([(0, 2, 1)], "file_idx int, kick_turn int, kick_pos int")
    assert rows(prepare.trim_to_kick(df, kicks), "file_idx", "trimmed_turn", "ring_pos") == [(0, 1, 1), (0, 1, 2), (0, 2, 0), (0, 2, 1), (0, 2, 2), (1, 1, 0)]


def test_marker_order_starts_at_the_first_recorded(spark):
    seen = spark.createDataFrame([(0, n, i) for i, n in enumerate(["B3", "ACD", "B1", "B2", "B3"])], "file_idx int, name string, row_index int")
    ring = spark.createDataFrame([("B1", 0), ("B2", 1), ("B3", 2)], "name string, ring_pos int")
    assert rows(prepare.marker_order(seen, ring, 3), "col", "name") == [(0, "ACD"), (1, "B3"), (2, "B1"), (3, "B2")]


def test_rebase_closes_gaps_between_files(spark):
    df = spark.createDataFrame([(0, 5), (0, 7), (1, 100), (1, 101), (2, 1)], "file_idx int, turn int")
    assert [r[2] for r in rows(prepare.rebase_turns(df), "file_idx", "turn", "global_turn")] == [0, 2, 3, 4, 5]


def test_markers_are_appended_under_existing_columns(spark):
    df = spark.createDataFrame([("B1", 1.0, 2.0)], "name string, x double, y double")
    other = spark.createDataFrame([("acd_BEFORE", 5.0, 1), ("B9", 6.0, 1)], "name string, x double, z int")
    assert rows(prepare.append_markers(df, other), "name", "x", "y") == [("B1", 1.0, 2.0), ("acd_BEFORE", 5.0, None)]


def turns(spark, *sizes):
    return spark.createDataFrame([(f, 0, t) for f, n in enumerate(sizes) for t in range(n)], "file_idx int, bunch int, turn int")


def test_bunch_edges(spark):
    assert rows(batches.drop_bunch_edges(turns(spark, 5, 2, 3), 1), "file_idx", "turn") == [(0, 1), (0, 2), (0, 3), (2, 1)]
    assert rows(batches.first_bunch_turns(turns(spark, 5, 2)), "file_idx", "turn") == [(0, 0), (1, 0)]


@pytest.mark.parametrize(("n", "held", "train"), [(10, 2, 4), (1, 0, 1), (2, 0, 1), (5, 1, 2)])
def test_split_sizes_round_half_even(spark, n, held, train):
    got = [r.split for r in batches.split_turns(turns(spark, n), 0.25, 0.5).collect()]
    assert (got.count("validation"), got.count("training"), len(got)) == (held, train, n)


def test_apportionment(spark):
    sizes = spark.createDataFrame([(0, 10), (1, 4), (2, 1)], "file_idx int, n_turns int")
    assert rows(batches.apportion_batches(sizes, 6), "file_idx", "n_batches") == [(0, 5), (1, 1), (2, 0)]
    assert rows(batches.apportion_batches(sizes, 99), "file_idx", "n_batches") == [(0, 10), (1, 4), (2, 1)]


def test_even_batches(spark):
    got = [r.batch for r in batches.even_batches(turns(spark, 10), 4).orderBy("turn").collect()]
    assert [got.count(k) for k in (1, 2, 3, 4)] == [3, 3, 2, 2] and got == sorted(got)
    assert batches.trim_to_multiple(turns(spark, 10, 3), 4).count() == 8 + 3


def test_turn_offsets(spark):
    points = [(0, 1, p, c) for p, c in enumerate([1, 2, 0, 1])] + [(1, -1, p, c) for p, c in enumerate([1, 0, 2, 1])]
    got = ranges.turn_offsets(spark.createDataFrame(points, "range_id int, sdir int, point int, col int"))
    assert [r[2] for r in rows(got, "range_id", "point", "offset")] == [0, 0, 1, 1, 0, 0, -1, -1]


def test_gather_reads_over_the_seam(spark):
    names = ["B0", "B1", "B2"]
    grid = spark.createDataFrame([(0, t, n, t + 0.1 * (c + 1)) for t in (1, 2, 3) for c, n in enumerate(names)], "file_idx int, turn long, name string, x double")
    ring = spark.createDataFrame([(n, c, c) for c, n in enumerate(names)], "name string, ring_pos int, col int")
    spec = spark.createDataFrame([(0, "B0", "B2", 1), (1, "B2", "B1", -1)], "range_id int, start string, end string, sdir int")
    points = ranges.turn_offsets(ranges.range_points(spec, ring, 3).select("range_id", "sdir", "name", "col", "point"))
    starts = spark.createDataFrame([(0, 1, 0), (0, 2, 0), (0, 2, 1)], "file_idx int, turn long, range_id int")
    got = rows(ranges.gather(starts, points.select("range_id", "point", "name", "offset"), grid), "range_id", "start_turn", "point", "x")
    assert [round(r[3], 6) for r in got] == [1.1, 1.2, 1.3, 2.1, 2.2, 2.3, 2.2, 2.1, 1.3]


def test_ranges_and_rerouting(spark):
    names = spark.createDataFrame([(f"B{c}", c) for c in range(6)], "name string, ring_pos int")
    starts = spark.createDataFrame([("B0",), ("B1",)], "start string")
    ends = spark.createDataFrame([("B1",), ("B3",)], "end string")
    assert ranges.range_product(starts, ends).count() == 6
    assert rows(ranges.fixed_pairs(starts, ends, "B0", "B3"), "start", "end", "sdir") == [("B0", "B1", -1), ("B0", "B3", -1), ("B0", "B3", 1), ("B1", "B3", 1)]
    spec = spark.createDataFrame([("B1", "B4", 1), ("B4", "B1", 1), ("B5", "B2", 1)], "start string, end string, sdir int")
    assert rows(ranges.reroute(spec, names, "B2", "B3"), "start", "end", "sdir") == [("B4", "B1", 1), ("B5", "B2", 1)]


def test_names_and_selections(spark):
    df = spark.createDataFrame([("a.knl[3]",), ("a.ksl[1]",), ("a.k1",)], "k string")
    assert [r[0] for r in rows(df.select(result_name(F.col("k")).alias("r")), "r")] == ["a.dk0sl", "a.dk2l", "a.k1"]
    families = {"quad": {"k1", "tilt"}, "bend": {"k0"}}
    assert parse_selection("quad:k1 bend:k0 quad:tilt,k1 none", families) == {"quad": ["k1", "tilt"], "bend": ["k0"]}
    for bad in ("quad", "quad:k9", "sext:k2", "quad:"):
        with pytest.raises(ValueError):
            parse_selection(bad, families)


def test_schedule(spark):
    df = spark.createDataFrame([(0,), (2,), (6,), (99,)], "e int")
    got = [round(r[1], 9) for r in rows(df.select("e", learning_rate(F.col("e"), 2, 4, 0.1, 1.0, 0.01).alias("r")), "e", "r")]
    assert got == [0.1, 1.0, 0.01, 0.01]
