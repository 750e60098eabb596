import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from fellgrid.functions import polygons as g
from fellgrid.functions.geo import Grid
from fellgrid.plans import climate, land, services, travel


def test_climate_metrics(spark):
    days = [(1, dt.date(2025, 12, 1) + dt.timedelta(i), 20.0 + i % 10) for i in range(300)]
    cube = spark.createDataFrame(days, "cell int, day date, value double")
    got = {(r["metric"], r["cell"]): r["value"] for r in climate.climate_metrics(cube, cube, 2026).collect()}
    now = [v for _, d, v in days if d.year == 2026]
    assert got["heat_2026_days_tmax_gt_25", 1] == sum(v > 25 for v in now)
    assert got["heat_longest_run_tmax_gt_25", 1] == 4 and got["cold_air_frost_days", 1] == 0
    winter = [v for _, d, v in days if d.month in (12, 1, 2)]
    assert got["cold_winter_tmin_p05", 1] == np.percentile(winter, 5)
    assert len(got) == 13


def test_travel_minutes(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0), (3, 2000.0, 0.0), (4, 90000.0, 0.0)], "node_id long, nx double, ny double")
    edges = spark.createDataFrame([(1, 1, 2, True, 1000, "A1", 500.0, 0.0), (2, 2, 3, False, 1000, "", 1500.0, 0.0)], "edge_id int, u long, v long, trunk boolean, length_m int, road string, mx double, my double")
    local = spark.createDataFrame([(1, 500, 600), (2, 120, 130)], "edge_id int, weekend int, peak int")
    lines = spark.createDataFrame([("x", "A1", 50.0, 0.0, 5.0, 900.0, 5.0)], "line_id string, road string, mph double, ax double, ay double, bx double, by double")
    slow = lines.withColumn("mph", F.lit(25.0))
    costs = travel.scenario_costs(local, edges, [lines, slow], "weekend")
    assert {r["edge_id"]: r["cost"] for r in costs.collect()} == {1: (45 + 89 + 1) // 2, 2: 120}
    cells = spark.createDataFrame([(7, 10.0, 10.0), (8, 2010.0, 0.0), (9, 90000.0, 5.0)], "point_id long, x double, y double")
    got = {r["cell"]: r["minutes"] for r in travel.travel_minutes(edges, costs, nodes, cells, (-5.0, 0.0)).collect()}
    assert got == {7: 0.0, 8: (67 + 120) / 60, 9: None}


def test_land(spark):
    grid = Grid(2, 2, 1000, 0, 0)
    pixels = spark.createDataFrame([(500.0, 500.0, 3.0), (600.0, 500.0, 9.0), (1500.0, 10.0, None)], "easting double, northing double, value double")
    assert {(r["cell"], r["relief"]) for r in land.relief(pixels, grid).collect()} == {(0, 6.0)}
    years = spark.createDataFrame([(0, 1, 2.0), (0, 2, 4.0), (1, 1, 2.0), (2, 1, 1.0), (2, 2, 1.0)], "cell int, year int, value double")
    mask = spark.createDataFrame([(0,), (1,)], "cell int")
    assert {(r["cell"], r["mean"]) for r in land.concentration(years, mask, 2).collect()} == {(0, 3.0)}
    wkb = [g.write_wkb(g.box(*b)) for b in ((0, 0, 1, 1), (0, 0, 1, 1), (1, 0, 3, 1))]
    woods = spark.createDataFrame([("Woodland", "Conifer", wkb[0]), ("Woodland", "Felled", wkb[1]), ("Woodland", "Odd", wkb[2])], "CATEGORY string, IFT_IOA string, geom binary")
    assert [r["share"] for r in land.woodland_cover(land.established_woodland(woods), 2.0).collect()] == [0.25]
    assert [r["IFT_IOA"] for r in land.unknown_classes(woods).collect()] == ["Odd"]
    assert {(r["cx"], r["share"]) for r in land.ancient_cover(woods, 2.0).collect()} == {(0, 0.5), (1, 0.25)}


def test_services(spark):
    osm = spark.createDataFrame([("pharmacy", "Boots", 54.0, -1.0, "n/1", "osm", 1)], "category string, name string, lat double, lon double, source_ref string, source_id string, source_rank int")
    records = spark.createDataFrame([("pharmacy", "c1", "BOOTS", "AB1", "x", 20), ("gp", "c2", "Dr", "ZZ", "x", 20), ("gp", "c3", "Dr", "AB1", "x", 20)], "category string, code string, name string, postcode string, source_id string, source_rank int")
    codes = spark.createDataFrame([("AB1", 54.0, -1.0, 0)], "postcode string, lat double, lon double, line int")
    kept, missing = services.services([osm], [records], codes)
    assert {r["source_ref"] for r in kept.collect()} == {"n/1", "c3"}
    assert [tuple(r) for r in missing.collect()] == [("gp", 1)]
    assert {(r["category"], r["n"]) for r in services.counts(kept).filter("n > 0").collect()} == {("pharmacy", 1), ("gp", 1)}
