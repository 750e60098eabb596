import datetime as dt
import heapq
import random

import pytest
from pyspark.sql import functions as F

from fellgrid.functions.geo import Grid
from fellgrid.operators import bundle, checks, evaluation, locations, network, points, raster, spatial, temporal


def cube(spark, rows):
    return spark.createDataFrame([(c, dt.date.fromisoformat(d), v) for c, d, v in rows], "cell int, day date, value double")


def test_runs_reset_at_year_gap_and_cold_day(spark):
    days = [(1, "2020-12-30", 30.0), (1, "2020-12-31", 30.0), (1, "2021-01-01", 30.0), (2, "2021-05-01", 26.0), (2, "2021-05-03", 26.0), (3, "2021-05-01", 25.0), (3, "2021-05-02", None)]
    assert {r["cell"]: r["longest"] for r in temporal.longest_run(cube(spark, days), 25).collect()} == {1: 2, 2: 1, 3: 0}


def test_expected_days_use_global_months(spark):
    rows = [(1, f"2020-01-{d:02d}", 30.0) for d in (1, 2)] + [(1, f"2021-01-{d:02d}", 30.0) for d in (1, 2, 3, 4)] + [(1, f"2021-02-{d:02d}", 30.0) for d in (1, 2, 3)] + [(2, "2021-02-01", 0.0)]
    assert {r["cell"]: r["days"] for r in temporal.expected_annual_days(cube(spark, rows), 25).collect()} == {1: 6.0, 2: 0.0}


def test_percentile_is_interpolated(spark):
    c = cube(spark, [(1, f"2020-06-{d:02d}", v) for d, v in zip((1, 2, 3, 4), (1.0, 2.0, 3.0, 10.0))])
    assert temporal.season_percentiles(c, [6, 7, 8], [0.95]).first()["p0"] == pytest.approx(8.95)


def test_complete_winters(spark):
    c = cube(spark, [(1, d, 1.0) for d in ("2019-12-05", "2020-01-05", "2020-02-05", "2020-12-05", "2021-02-05")])
    assert sorted((r["season"], r["y"], r["month"]) for r in temporal.complete_seasons(c, [12, 1, 2]).collect()) == [(2020, 2019, 12), (2020, 2020, 1), (2020, 2020, 2)]
    assert temporal.contiguous_months(c, 2020).first()["contiguous"] is False
    assert temporal.incomplete_cells(c).count() == 5


def test_pyramid(spark):
    rows = [(0, 0, 1), (0, 1, 2), (1, 0, 2)]
    got = raster.pyramid(spark.createDataFrame(rows, "row int, col int, encoded int"), 2, 2).filter("level = 1").first()
    assert got["encoded"] == 2
    column = raster.pyramid(spark.createDataFrame([(0, 0, 10), (1, 0, 20), (2, 0, 40)], "row int, col int, encoded int"), 1, 3)
    assert {(r["level"], r["row"]): r["encoded"] for r in column.collect()} == {(0, 0): 10, (0, 1): 20, (0, 2): 40, (1, 0): 15, (1, 1): 40, (2, 0): 28}


def test_levels_fit(spark):
    levels = raster.level_sizes(spark, Grid(900, 1450, 1000, 0, 0))
    assert levels.count() == 12 and checks.level_mismatches(levels).count() == 0


def test_greedy_dedup_is_not_transitive(spark):
    step = 20 / 110540
    rows = [("gp", "A", 54.0 + i * step, -1.0, f"n/{i}", "osm", 0) for i in range(3)]
    rows += [("gp", "b", 54.0, -1.0, "n/9", "osm", 0), ("gp", "a.", 54.0, -1.0, "n/8", "osm", -1), ("dentist", "A", 54.0, -1.0, "n/7", "osm", 0)]
    df = spark.createDataFrame(rows, "category string, name string, lat double, lon double, source_ref string, source_id string, source_rank int")
    assert sorted(r["source_ref"] for r in points.deduplicate(df).collect()) == ["n/2", "n/7", "n/8", "n/9"]


def test_greedy_dedup_matches_a_plain_pass(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["gp", "x"]), rng.choice(["One", "two"]), 54 + rng.random() * 0.004, -1 + rng.random() * 0.004, f"n/{i}", "osm", rng.randint(0, 2)) for i in range(400)]
    kept = []
    for r in sorted(rows, key=lambda r: (r[6], r[0], r[4])):
        import math

        near = [k for k in kept if k[0] == r[0] and k[1] == r[1] and abs(math.floor(k[2] / 0.0005) - math.floor(r[2] / 0.0005)) <= 1 and abs(math.floor(k[3] / 0.0005) - math.floor(r[3] / 0.0005)) <= 1]
        if not any(math.hypot((r[3] - k[3]) * 111320 * math.cos(math.radians((r[2] + k[2]) / 2)), (r[2] - k[2]) * 110540) <= 25 for k in near):
            kept.append(r)
    df = spark.createDataFrame(rows, "category string, name string, lat double, lon double, source_ref string, source_id string, source_rank int")
    assert sorted(r["source_ref"] for r in points.deduplicate(df).collect()) == sorted(k[4] for k in kept)


def test_cap_shows_all_or_none(spark):
    assert points.capped(spark.range(200)).count() == 200 and points.capped(spark.range(201)).count() == 0


def test_geocode(spark):
    records = spark.createDataFrame([("gp", "ab1 2cd"), ("gp", "zz"), ("dentist", None)], "category string, postcode string")
    codes = spark.createDataFrame([("AB1 2CD", 1.0, 1), ("AB12CD", 2.0, 2), ("Q", 3.0, 3)], "postcode string, lat double, line int")
    found, missing = points.geocode(records, codes)
    assert [r["lat"] for r in found.collect()] == [2.0]
    assert {(r["category"], r["missing"]) for r in missing.collect()} == {("gp", 1), ("dentist", 1)}


def test_band_match(spark):
    edges = spark.createDataFrame([(1, "A1", 0.0, 0.0), (2, "A2", 0.0, 0.0), (3, "A3", 0.0, 0.0), (4, "", 0.0, 0.0)], "edge_id int, road string, mx double, my double")
    lines = [(1, "A1", 30.0, 10), (2, "A1", 50.0, 24), (3, "A1", 70.0, 30), (4, "A2", 40.0, 100), (5, "A3", 40.0, 130), (6, "A2", 80.0, 101)]
    df = spark.createDataFrame([(i, r, m, float(y), float(y)) for i, r, m, y in lines], "line_id int, road string, mph double, ay double, by double").withColumn("ax", F.lit(-5.0)).withColumn("bx", F.lit(5.0))
    assert {r["edge_id"]: (r["mph"], r["candidates"]) for r in spatial.band_match(edges, df).collect()} == {1: (40.0, 2), 2: (40.0, 1)}


def test_nearest_widens_its_ring(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 100.0), (3, 5.0, 5.0)], "point_id int, x double, y double")
    n = spark.createDataFrame([(7, 0.3, 0.0), (8, -0.3, 0.0), (9, 90.0, 90.0)], "node_id int, nx double, ny double")
    assert {r["point_id"]: r["node_id"] for r in spatial.nearest(p, n, 0.1).collect()} == {1: 7, 2: 9, 3: 7}
    assert spatial.nearest(p.limit(0), n, 1.0).count() == 0


def test_overlap_areas(spark):
    b = spark.createDataFrame([(1, 0.25, 0.25, 0.75, 0.75), (2, 0.5, 0.5, 1.5, 1.0)], "box int, minx double, miny double, maxx double, maxy double")
    got = {(r["box"], r["cx"], r["cy"]): r["area"] for r in spatial.overlap_areas(b, 1.0).collect()}
    assert got == {(1, 0, 0): 0.25, (2, 0, 0): 0.25, (2, 1, 0): 0.25}
    with pytest.raises(Exception, match="more than once"):
        spatial.covered_share(spark.createDataFrame([(0, 0, 3.0)], "cx int, cy int, area double"), 1.0).collect()


def test_shortest_paths_match_a_heap(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60), rng.randint(1, 20)) for _ in range(120)] + [(200, 201, 1)]
    dist, heap, around = {0: 0}, [(0, 0)], {}
    for u, v, c in edges:
        around.setdefault(u, []).append((v, c))
        around.setdefault(v, []).append((u, c))
    while heap:
        d, u = heapq.heappop(heap)
        for v, c in around.get(u, []):
            if d + c < dist.get(v, 10**9):
                dist[v] = d + c
                heapq.heappush(heap, (d + c, v))
    got = network.shortest_paths(spark.createDataFrame(edges, "u long, v long, cost long"), spark.createDataFrame([(0,)], "node long"))
    assert {r["node"]: r["distance"] for r in got.collect()} == dist


def test_links(spark):
    nodes = network.first_nodes(spark.createDataFrame([("a", 1.0, 1.0, 0), ("a", 2.0, 2.0, 1), ("b", 1.0, 2.0, 2), ("c", None, None, 3)], "node_id string, x double, y double, ordinal int"))
    assert {(r["node_id"], r["x"]) for r in nodes.collect()} == {("a", 1.0), ("b", 1.0)}
    links = spark.createDataFrame([("a", "b", "0.4"), ("a", "a", "5"), ("a", "c", "5"), ("a", "b", "x")], "startNode string, endNode string, length string")
    assert [(r["u"], r["v"], r["length_m"]) for r in network.usable_links(links, nodes).collect()] == [("a", "b", 1)]


def test_costs_and_means(spark):
    base = spark.createDataFrame([(1, 7), (2, 9)], "edge_id int, cost int")
    seen = spark.createDataFrame([(1, 10), (1, 13)], "edge_id int, cost int")
    assert {r["edge_id"]: r["cost"] for r in network.observed_mean(base, seen).collect()} == {1: 12, 2: 9}
    ctx = network.context_table(spark.createDataFrame([("E", 40.0, 20.0, 50.0, 36.0, 1), ("E", 44.0, 22.0, 50.0, 39.6, 2), ("E", None, 1.0, 1.0, 1.0, 3)], "country string, all_day double, urban double, rural double, evening double, line int"))
    assert ctx.first()["peak_ratio"] == pytest.approx(0.9) and ctx.first()["urban_mph"] == 22.0


def test_sampling(spark):
    cells = spark.createDataFrame([(1, 10, 5.0), (2, 10, 30000.0), (3, 11, 1.0)], "cell int, node int, snap_m double")
    got = network.sample_minutes(cells, spark.createDataFrame([(10, 120)], "node int, distance long"))
    assert {r["cell"]: r["minutes"] for r in got.collect()} == {1: 2.0, 2: None, 3: None}


def test_error_metrics(spark):
    model = spark.createDataFrame([("", "a", "York", 70.0, 11.0), ("v", "b", "York", 50.0, 9.0), ("v", "q", "York", 1.0, 1.0)], "variant string, origin string, destination string, minutes double, distance_miles double")
    ref = spark.createDataFrame([("a", "York", 60.0, 10.0, 1), ("a", "York", 64.0, 10.0, 2), ("b", "York", 55.0, 10.0, 3), ("q", "York", None, 1.0, 4)], "origin string, destination string, google_minutes double, google_miles double, line int")
    rows = evaluation.compare(model, ref)
    assert {(r["variant"], r["error_min"]) for r in rows.collect()} == {("model", 6.0), ("v", -5.0)}
    all_ = evaluation.error_metrics(rows, ["variant"], [[], ["variant"]]).filter("grouping = 1").first()
    assert (all_["n"], all_["mae"], all_["bias"], all_["within_10"]) == (2, 5.5, 0.5, 2)


def test_bundle(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, v int")
    assert [r["id"] for r in bundle.conflicts(bundle.union_all(a, a.withColumn("v", F.lit(1))), "id").collect()] == ["y"]
    with pytest.raises(ValueError, match="twice: 1"):
        checks.require(checks.violations(bundle.repeated_ids(a.union(a.limit(1)), "id"), "twice"), checks.violations(a, "none", "v > 9"))
    assert checks.bad_palette(["#12345"]) and not checks.bad_palette(["#123456", "#abcdef"])


def test_locations(spark):
    text = '{"format": "saved-locations", "version": 1, "locations": [ {"id": "a", "name": " One ", "lat": 1, "lon": "2"}, {"id": "a", "name": "Two", "lat": null, "lon": "", "notes": "n "}]}'
    rows = locations.load(spark, text)
    assert [tuple(r) for r in rows.orderBy("position").collect()] == [(0, "a", "One", 1.0, 2.0, ""), (1, "location-1", "Two", 0.0, 0.0, "n ")]
    assert [r["id"] for r in locations.move(rows, 0, 1).orderBy("position").collect()] == ["location-1", "a"]
    assert [r["id"] for r in locations.move(rows, 0, -1).orderBy("position").collect()] == ["a", "location-1"]
    assert locations.load(spark, locations.export(rows).first()["json"]).count() == 2
    new = spark.createDataFrame([("b", "Three", 0.0, 0.0, ""), ("a", "Uno", 0.0, 0.0, "")], "id string, name string, lat double, lon double, notes string").withColumn("position", F.lit(None).cast("int"))
    assert {(r["id"], r["name"], r["position"]) for r in locations.upsert(rows, new).collect()} == {("a", "Uno", 0), ("location-1", "Two", 1), ("b", "Three", 2)}
    for bad in ('[{"name": ""}]', '[{"name": "x", "lat": 91}]', '{"format": "other"}'):
        with pytest.raises(ValueError):
            locations.load(spark, bad)


def test_points_in_boxes_tiles(spark):
    """Many points and boxes in few cells: every pair once for each pair of rows, equal rows, edges and nulls included, and no task that has most of them."""
    rng = random.Random(8)
    spot = lambda: rng.choice([rng.randrange(-12, 13) / 4, rng.uniform(-3, 3)])
    dots = [(k, spot(), spot()) for k in range(300)] + [(k, 0.25, 0.5) for k in range(300, 340)] + [(7, 0.25, 0.5)] * 3
    bounds = [(k, x := spot(), y := spot(), x + rng.randrange(1, 9) / 4, y + rng.randrange(1, 9) / 4) for k in range(120)] + [(120, -1.0, -1.0, 1.0, 1.0)] * 2
    p = spark.createDataFrame([*dots, (900, None, 0.0), (901, float("nan"), 0.0)], "point long, x double, y double")
    b = spark.createDataFrame(bounds, "box long, minx double, miny double, maxx double, maxy double")
    for border in (False, True):
        near = (lambda a, v, c: a <= v <= c) if border else (lambda a, v, c: a < v < c)
        want = sorted((i, n) for i, x, y in dots for n, lx, ly, hx, hy in bounds if near(lx, x, hx) and near(ly, y, hy))
        for size, most in ((2.0, 5), (0.7, 4), (2.0, 2048)):
            found = spatial.points_in_boxes(p, b, size, border=border, most=most)
            assert found.columns == ["point", "x", "y", "box", "minx", "miny", "maxx", "maxy"]
            assert sorted((r["point"], r["box"]) for r in found.collect()) == want
    one = spatial.points_in_boxes(spark.range(400).select("id", F.lit(0.5).alias("x"), F.lit(0.5).alias("y")), spark.range(400).select(F.col("id").alias("box"), F.lit(0.1).alias("minx"), F.lit(0.1).alias("miny"), F.lit(0.9).alias("maxx"), F.lit(0.9).alias("maxy")), 1.0, most=50)
    sizes = [r["count"] for r in one.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 160_000 and max(sizes) < 40_000
