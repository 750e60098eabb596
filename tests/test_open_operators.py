"""Checks, sources and operators that look at what a dataset promises."""

import base64
import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fellgrid.functions import polygons as g
from fellgrid.functions.geo import Grid
from fellgrid.operators import bundle, checks, evaluation, network, raster, temporal
from fellgrid.plans import land
from fellgrid.sources import files, sinks, tables

GRID = Grid(700, 1300, 1000, 0, 0)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_months_of_both_catalogues(spark):
    name = "tasmax_hadukgrid_uk_1km_day_{0}01-{0}{1}.nc"
    old = spark.createDataFrame([("a/" + name.format("202002", "29"),), ("a/" + name.format("202001", "31"),), ("a/other.nc",)], "path string")
    new = spark.createDataFrame([("b/" + name.format("202003", "31"),)], "path string")
    got = tables.discover_months(old, new, first_year=2020)
    assert [(r["month"], r["status"]) for r in got.collect()] == [(1, "historical"), (2, "historical"), (3, "provisional")]
    with pytest.raises(ValueError):
        tables.discover_months(old, spark.createDataFrame([("b/" + name.format("202002", "29"),)], "path string"))
    cubes = [("p", 29, 1300, 700, "degC", 0.0, 0.0, 1000.0), ("q", 28, 1300, 700, "K", 0.0, 0.0, 1000.0), ("r", 29, 1300, 700, "mm", 0.0, 0.0, 1000.0), ("s", 29, 9, 700, "K", 0.0, 0.0, 1000.0), ("t", 29, 1300, 700, " Kelvin ", 5.0, 0.0, 1000.0)]
    c = spark.createDataFrame(cubes, "path string, t int, height int, width int, units string, west double, south double, step double")
    m = spark.createDataFrame([(x, 29) for x in "pqrst"], "path string, days int")
    assert rows(tables.cube_problems(c, m, GRID)) == [("q", "days"), ("r", "units"), ("s", "shape"), ("t", "grid")]


def test_current_year_and_tiles(spark):
    months = lambda *m: spark.createDataFrame([(2026, k) for k in m], "year int, month int")
    problems = lambda a, b: sorted(r["problem"] for r in checks.current_year_problems(a, b, 2026).collect())
    assert problems(months(1, 2), months(1, 2)) == [] and problems(months(1, 3), months(1, 3)) == ["months have a gap"]
    assert problems(months(1, 2), months(1)) == ["months differ"] and problems(months(1).limit(0), months(1)) == ["no months"]
    tiles = spark.createDataFrame([("a", 0.0, 0.0), ("b", 10000.0, 0.0), ("c", 10000.0, 0.0), ("d", 500.0, 0.0), ("e", 695000.0, 0.0)], "tile string, west double, south double")
    assert [r for r in rows(checks.tile_problems(tiles, GRID)) if r[1] != "overlap" or r[0] != "d"] == [("a", "overlap"), ("b", "overlap"), ("c", "overlap"), ("d", "alignment"), ("e", "bounds")]
    cells = spark.createDataFrame([("f", 1), ("f", 1), ("g", 1)], "path string, cell long")
    assert rows(checks.repeated_cells(cells)) == [("f", 1, 2)]
    assert checks.count_mismatch(cells, 5, "rows").first()["violations"] == 2


def test_display_ranges_and_levels(spark):
    data = [(0.0, 10.0, 0.1, 0.0), (10.0, 0.0, 0.1, 0.0), (0.0, 7000.0, 0.1, 0.0), (-5.0, 1.0, 0.1, 0.0), (0.0, 0.04, 0.1, 0.0), (None, None, 0.1, 0.0), (0.0, float("nan"), 0.1, 0.0)]
    d = spark.createDataFrame(data, "a double, z double, s double, o double")
    bad = checks.bad_display_range(F.col("a"), F.col("z"), F.col("s"), F.col("o"))
    assert [r[0] for r in d.select(bad).collect()] == [False, True, True, True, True, False, True]
    levels = [("a", 9, 0, 700, 1300, 1000.0), ("a", 9, 1, 350, 650, 2000.0), ("b", 9, 0, 700, 1300, 1000.0), ("b", 9, 1, 350, 651, 2000.0), ("c", 9, 0, 700, 1300, 1000.0)]
    df = spark.createDataFrame(levels, "metric string, nodata int, level int, width int, height int, cell_size_m double")
    assert rows(checks.geometry_problems(df, GRID)) == [("b", 1, "geometry"), ("c", None, "levels")]
    assert [r[0] for r in rows(checks.geometry_problems(df, Grid(1, 1300, 1000, 0, 0))) if r[2] == "grid"] == ["a", "b", "c"]


def test_cube_completeness_and_mask(spark):
    days = [(1, "2020-01-01", 1.0), (1, "2020-02-01", 1.0), (2, "2020-01-01", None), (3, "2020-01-02", 5.0)]
    cube = spark.createDataFrame(days, "cell int, day string, value double").withColumn("day", F.to_date("day"))
    mask = spark.createDataFrame([(1,), (2,), (4,)], "cell int")
    assert rows(temporal.absent_months(cube, mask)) == [(2, 2020, 2), (4, 2020, 1), (4, 2020, 2)]
    assert rows(temporal.land_mask(cube)) == [(1,)]
    assert {r["cell"] for r in temporal.prune(cube, spark.createDataFrame([(1,)], "cell int")).collect()} == {2, 3}
    with pytest.raises(ValueError):
        temporal.prune(cube, spark.createDataFrame([(9,)], "cell int"))


def test_views_and_grids(spark):
    views = spark.createDataFrame([(1, 51.4, 51.6, -0.3, 0.0), (2, 70.0, 71.0, 0.0, 1.0), (3, 49.0, 61.0, -9.0, 3.0)], "view_id int, south double, north double, west double, east double")
    envelope = {"south": 49.5, "north": 61.0, "west": -8.6, "east": 2.1}
    got = {r["view_id"]: tuple(r)[1:] for r in raster.view_windows(views, envelope, {"width": 700, "height": 1300, "cell_size_m": 1000.0}, GRID).collect()}
    assert set(got) == {1, 3} and got[3][0] == got[3][2] == 0 and 1240 < got[3][1] < 1300 and 690 < got[3][3] < 700
    r0, r1, c0, c1 = got[1]
    assert 165 < r0 < 170 and 188 < r1 < 194 and 515 < c0 < 520 and 537 < c1 < 543
    corners = {r["corner"]: (r["lat"], r["lon"]) for r in raster.grid_corners(spark, GRID).collect()}
    assert abs(corners[0][0] - 49.766) < 0.01 and abs(corners[0][1] + 7.557) < 0.01 and corners[2][0] > 61
    axis = lambda *v: spark.createDataFrame([(float(x),) for x in v], "value double")
    assert raster.grid_of_axes(axis(500, 1500, 2500), axis(-500, 500)) == Grid(3, 2, 1000.0, 0.0, -1000.0)
    with pytest.raises(ValueError):
        raster.grid_of_axes(axis(0, 1, 3), axis(0, 1))


def test_roads_and_matches(spark):
    links = spark.createDataFrame([("A Road", True, 1), ("A Road", None, 2), ("B Road", False, 3)], "function string, trunk boolean, n int")
    assert [r["n"] for r in network.non_trunk_a_roads(links).collect()] == [2]
    nodes = spark.createDataFrame([("a", 0.0, 0.0, 0), ("b", 1.0, 0.0, 1), ("c", 2.0, 0.0, 2), ("a", 9.0, 9.0, 3)], "node_id string, x double, y double, ordinal int")
    raw = spark.createDataFrame([("a", "b", "120", "A Road", "Single Carriageway"), ("b", "b", "5", "A Road", "x"), ("a", "z", "5", "A Road", "x")], "startNode string, endNode string, length string, function string, formOfWay string")
    used, edges, start = network.road_graph(nodes, raw)
    assert rows(used.select("node_id", "x")) == [("a", 0.0), ("b", 1.0)] and edges.count() == 1 and rows(start) == [("a", 0), ("b", 1)]
    matched = spark.createDataFrame([(1, 1000, 2.0, 1), (2, 500, 4.0, 2), (3, 500, 6.0, 1)], "edge_id int, length_m int, distance double, candidates long")
    got = evaluation.match_statistics(matched, spark.range(5)).first()
    assert (got["matched_edges"], got["matched_length_km"], got["median_match_distance_m"], got["trunk_edges"], got["candidate_speed_count"]) == (3, 2.0, 4.0, 5, {"1": 2, "2": 1})


def test_shortest_paths_both_ways(spark):
    rng = np.random.default_rng(5)
    pairs = {(int(a), int(b)): int(c) for a, b, c in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(1, 30, 150))}
    edges = spark.createDataFrame([(a, b, c) for (a, b), c in pairs.items()] + [(900, 901, 1)], "u long, v long, cost long")
    start = spark.createDataFrame([(0,), (7,)], "node long")
    away = {0: 0, 7: 0}
    for _ in range(100):
        for (a, b), c in pairs.items():
            for x, y in ((a, b), (b, a)):
                if x in away and away[x] + c < away.get(y, 10**9):
                    away[y] = away[x] + c
    for most in (10**6, 0):
        assert dict(rows(network.shortest_paths(edges, start, most_local=most))) == away


def test_bundles(spark, tmp_path):
    notes = spark.createDataFrame([(None, "a"), ("", "b"), ("x", "c"), ("y", "d")], "source_id string, action string")
    assert [r["action"] for r in bundle.pruning_notes(notes, "x").orderBy("action").collect()] == ["a", "b", "c"]
    metrics = spark.createDataFrame([("m2", "c1", "s", 1), ("m1", "c1", "s", 1), ("m0", "c0", "s", 5)], "id string, category_id string, source_id string, ordinal int")
    categories, sources = spark.createDataFrame([("c0", 2), ("c1", 1), ("c1", 1)], "id string, ordinal int"), spark.createDataFrame([("s", "t")], "id string, title string")
    assert [r["id"] for r in bundle.assemble(metrics, categories, sources).collect()] == ["m1", "m2", "m0"]
    for broken in ((metrics.union(metrics), categories, sources), (metrics, categories.filter("id = 'c1'"), sources), (metrics, categories, sources.limit(0)), (metrics, categories.union(spark.createDataFrame([("c0", 9)], "id string, ordinal int")), sources)):
        with pytest.raises(ValueError):
            bundle.assemble(*broken)
    raw = np.array([7, 65535, 3, 9], "<u2").tobytes()
    (tmp_path / "in").mkdir(), (tmp_path / "out").mkdir()
    (tmp_path / "in" / "m.bin").write_bytes(raw), (tmp_path / "out" / "old.bin").write_bytes(b"x")
    import hashlib

    expected = spark.createDataFrame([("m.bin", 8, hashlib.sha256(raw).hexdigest())], "name string, size int, sha256 string")
    assert rows(sinks.publish(spark, str(tmp_path / "in"), expected, str(tmp_path / "out"))) == [("old.bin",)]
    assert (tmp_path / "out" / "m.bin").read_bytes() == raw and not (tmp_path / "out" / "old.bin").exists()
    with pytest.raises(ValueError):
        sinks.publish(spark, str(tmp_path / "in"), expected.withColumn("size", F.lit(9)), str(tmp_path / "out"))
    held = spark.createDataFrame([("m", "gzip+uint16le", base64.b64encode(gzip.compress(raw)).decode(), 8)], "id string, blob_encoding string, blob_base64 string, raw_bytes int")
    assert rows(files.decode_payloads(held, [(0, 2, 2)])) == [("m", 0, 0, 0, 7), ("m", 0, 1, 0, 3), ("m", 0, 1, 1, 9)]
    with pytest.raises(Exception):
        files.decode_payloads(held.withColumn("raw_bytes", F.lit(6)), [(0, 2, 2)]).collect()


def test_discovery(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"sources": [{"name": "a", "file": "x/a.zip"}, {"name": "b", "file": "../b"}]}))
    found = tables.load_discovery(spark, str(tmp_path / "d.json"))
    assert tables.source_path(found, "a", "/data/") == "/data/x/a.zip"
    for name in ("b", "c"):
        with pytest.raises(ValueError):
            tables.source_path(found, name, "/data")


def test_ancient_woodland(spark):
    shape = lambda *b: bytearray(g.write_wkb(g.box(*b)))
    wales = spark.createDataFrame([(land.ANCIENT_WALES[0], shape(0, 0, 1, 1)), (land.DELETED_WALES[0], shape(0, 0, 1, 1))], "category_name string, geom binary")
    scotland = spark.createDataFrame([("1a", shape(2, 0, 3, 1)), ("3", shape(2, 0, 3, 1))], "ANTIQUITY_ string, geom binary")
    england = spark.createDataFrame([("ASNW", 10.5, 10.5, shape(10, 10, 11, 11))], "status string, x_coord double, y_coord double, geom binary")
    bounds = "geom binary, minx double, miny double, maxx double, maxy double"
    older = spark.createDataFrame([("PAWS", 1, shape(8, 10, 14, 11), 8.0, 10.0, 14.0, 11.0)], "status string, feature_id long, " + bounds)
    districts = spark.createDataFrame([(1, shape(9, 9, 12, 12), 9.0, 9.0, 12.0, 12.0), (2, shape(12, 9, 20, 12), 12.0, 9.0, 20.0, 12.0)], "area_id long, " + bounds)
    got = land.ancient_woodland(wales, scotland, england, older, districts, 4.0)
    # one square each, and the older feature outside the first district: 1 + 2 squares
    assert sum(g.area(g.read_wkb(bytes(r["geom"]))) for r in got.collect()) == pytest.approx(1 + 1 + 1 + 3)
    with pytest.raises(ValueError):
        land.ancient_woodland(wales, scotland, england.withColumn("x_coord", F.lit(500.0)), older, districts, 4.0)
    with pytest.raises(ValueError):
        land.ancient_woodland(wales.withColumn("category_name", F.lit("new")), scotland, england, older, districts, 4.0)


def test_streams_of_several_files_with_late_rows(spark, tmp_path):
    from fellgrid.streaming import runs

    import datetime as dt

    stamp = lambda s: dt.datetime.fromisoformat(s)
    parts = [
        [(1, "2019-12-30", 70.0), (1, "2019-12-31", 70.0), (2, "2020-01-05", 10.0)],
        [(1, "2020-01-01", 70.0), (1, "2020-01-03", 70.0), (1, "2020-01-04", 70.0)],
        [(1, "2020-01-02", 70.0), (2, "2020-01-06", 70.0), (1, "2019-12-30", 70.0)],  # a late day joins two runs
    ]
    folder = tmp_path / "days"
    for k, part in enumerate(parts):
        df = spark.createDataFrame([(c, stamp(d), v, "x") for c, d, v in part], "user_id long, ts timestamp, value double, event_type string").coalesce(1)
        df.write.mode("append").parquet(str(folder))
    assert rows(runs.longest_runs_stream(spark, str(folder), 60.0)) == [(1, 4), (2, 1)]


def test_valid_rings_stay_and_points_are_located():
    rng = np.random.default_rng(1)
    angle = np.sort(rng.uniform(0, 2 * np.pi, 40))
    star = [[np.c_[np.cos(angle), np.sin(angle)] * rng.uniform(0.5, 1.5, 40)[:, None]]]
    assert g.make_valid(star)[0][0] is star[0][0] or len(g.make_valid(star)[0][0]) == 40
    hole = [[*g.box(0, 0, 4, 4)[0], *g.box(1, 1, 2, 2)[0]]]
    assert g.area(g.make_valid(hole)) == 15 and len(g.make_valid(hole)[0]) == 2
    outside = [[*g.box(0, 0, 4, 4)[0], *g.box(3, 3, 6, 6)[0]]]
    assert g.area(g.make_valid(outside)) == pytest.approx(16 + 9 - 2)
    x, y = rng.uniform(-2, 2, 300), rng.uniform(-2, 2, 300)
    assert g.locate_all(x, y, star, most=500).tolist() == [g.locate(a, b, star) for a, b in zip(x, y)]
    boxes = [g.box(*b, b[0] + w, b[1] + h) for b, w, h in zip(rng.integers(0, 9, (30, 2)).astype(float), rng.integers(1, 5, 30), rng.integers(1, 5, 30))]
    covered = np.zeros((14, 14), bool)
    for b in boxes:
        x0, y0, x1, y1 = (int(v) for v in g.bounds(b))
        covered[x0:x1, y0:y1] = True
    assert g.union_area(boxes) == pytest.approx(covered.sum())
    assert g.union_area([hole, g.box(1, 1, 2, 2)]) == pytest.approx(16) and g.union_area([]) == 0.0
