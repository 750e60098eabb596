import math

import pytest
from pyspark.sql import functions as F

from fellgrid.functions import encode, geo, roads, rounding, text
from fellgrid.functions.geo import Grid


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'string' if isinstance(values[n], str) or values[n] is None else 'double' if isinstance(values[n], float) else 'long'}" for n in names)) if names else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_rounding_families(spark):
    assert [one(spark, rounding.half_up_floor(F.col("v")), v=v) for v in (2.5, -2.5, 0.49)] == [3, -2, 0]
    assert [one(spark, rounding.half_even(F.col("v")), v=v) for v in (2.5, 3.5, -2.5)] == [2, 4, -2]
    assert one(spark, rounding.mean_half_up(F.lit(23), F.lit(2))) == 12 and one(spark, rounding.mean_half_up(F.lit(10), F.lit(1))) == 10
    assert one(spark, rounding.parent_half_up(F.lit(5), F.lit(3))) == 2


def test_quantise(spark):
    q = encode.quantise(F.col("v"), 0.1, 0.0)
    assert [one(spark, q, v=v) for v in (0.25, 0.0, 6553.4)] == [3, 0, 65534]
    assert one(spark, q, v=float("nan")) is None and one(spark, q, v=float("inf")) is None
    with pytest.raises(Exception, match="out of range"):
        one(spark, q, v=7000.0)
    assert one(spark, encode.dequantise(F.lit(65535), 1.0, 0.0)) is None


def test_palette(spark):
    bin_ = encode.palette_bin(F.col("v"), F.lit(10.0), F.lit(20.0))
    assert [one(spark, bin_, v=v) for v in (9.0, 10.0, 15.0, 20.0, 30.0)] == [0, 0, 32, 63, 63]
    assert one(spark, encode.palette_bin(F.lit(5), F.lit(5), F.lit(5))) == 31
    assert one(spark, encode.palette_colour(["#000000", "#ffffff"], F.lit(63))) == "rgb(255 255 255)"
    assert one(spark, encode.legend_values(F.lit(0).cast("long"), F.lit(2).cast("long"))) == [0, 1, 2]
    assert one(spark, encode.legend_values(F.lit(0).cast("long"), F.lit(100).cast("long"))) == [0, 25, 50, 75, 100]
    r = one(spark, encode.stored_range(F.lit(90.0), F.lit(5.0), F.lit(0).cast("long"), F.lit(50).cast("long")))
    assert (r["min"], r["max"]) == (0, 50)


def test_text(spark):
    assert one(spark, text.compact_upper(F.col("v")), v=" ab 1\t2c ") == "AB12C"
    assert one(spark, text.clean_name(F.col("v"), F.lit("none")), v="  a \n b ") == "a b" and one(spark, text.clean_name(F.col("v"), F.lit("none")), v=None) == "none"
    assert one(spark, text.match_key(F.col("v"), F.lit("n/1")), v="Café No. 1") == "cafénо1".replace("о", "o")
    assert one(spark, text.match_key(F.col("v"), F.lit("n/1")), v="Unnamed shop") == "unnamedshop:n/1"
    assert [one(spark, text.human_bytes(F.col("v")), v=v) for v in (0, 1023, 1024, 5 * 1024**4)] == ["0.00 B", "1023.00 B", "1.00 KiB", "5.00 TiB"]
    assert one(spark, text.osm_url(F.col("v")), v="w/12") == "https://www.openstreetmap.org/way/12" and one(spark, text.osm_url(F.col("v")), v="x/1") is None
    assert one(spark, text.directions_url(F.lit("a b/é"), F.lit("York"))).startswith("https://www.google.com/maps/dir/a%20b%2F%C3%A9/York/")
    assert one(spark, text.year_list(F.col("v")), v="2022, 2024,") == [2022, 2024] and one(spark, text.year_list(F.col("v")), v="2022") == [2022]
    for wrong in ("2024, 2022", "2022,2022", "", "x"):
        with pytest.raises(Exception):
            one(spark, text.year_list(F.col("v")), v=wrong)
    assert one(spark, text.finite_number(F.col("v")), v="Infinity") is None and one(spark, text.finite_number(F.col("v")), v="1.5") == 1.5
    assert one(spark, text.header_place(F.array(F.lit("A"), F.lit("Urban roads (x)")), "urban")) == 1


def test_roads(spark):
    assert one(spark, roads.seconds_at(F.lit(1000), F.lit(60.0))) == 37
    assert one(spark, roads.seconds_at(F.lit(0), F.lit(60.0))) == 1
    with pytest.raises(Exception, match="invalid road speed"):
        one(spark, roads.seconds_at(F.lit(1), F.lit(0.0)))
    speed = lambda f, m: one(spark, roads.fallback_speed(F.lit(f), F.lit(m)))
    assert [speed("A Road", "Dual Carriageway"), speed("Motorway", "Dual Carriageway"), speed("A Road", "Roundabout"), speed("x", "y"), speed("Motorway", "Slip Road")] == [49.0, 60.0, 20.0, 24.0, 35.0]
    assert one(spark, roads.mixed_seconds(F.lit(1000), F.lit(0.5), F.lit(30.0), F.lit(60.0), F.lit(roads.ROUNDABOUT))) == round(1000 / 0.44704 / 20)


def test_national_grid(spark):
    # the published worked example, its point given on WGS84
    g = one(spark, geo.to_national_grid(F.col("lat"), F.col("lon")), lat=52.657977, lon=1.716038)
    assert abs(g["easting"] - 651409) < 2 and abs(g["northing"] - 313177) < 2
    back = one(spark, geo.from_national_grid(F.lit(g["easting"]), F.lit(g["northing"])))
    assert abs(back["lat"] - 52.657977) < 1e-7 and abs(back["lon"] - 1.716038) < 1e-7


def test_grid(spark):
    g = Grid(10, 20, 1000, 0, 0)
    assert (g.east, g.north) == (10000, 20000)
    assert one(spark, geo.cell_id(geo.cell_row(F.lit(1500.0), g), geo.cell_column(F.lit(9999.0), g), g)) == 19
    assert one(spark, geo.centre_easting(F.lit(3), g)) == 3500.0
    assert one(spark, geo.bucket_key(F.lit(54.0), F.lit(-1.1))) == "216:-5"
    p = one(spark, geo.world_pixel(F.lit(0.0), F.lit(0.0)))
    assert (p["x"], p["y"]) == (128.0, 128.0)
    assert math.isclose(one(spark, geo.segment_distance(*(F.lit(float(v)) for v in (0, 1, -1, 0, 1, 0)))), 1.0)
    assert math.isclose(one(spark, geo.segment_distance(*(F.lit(float(v)) for v in (3, 4, 0, 0, 0, 0)))), 5.0)
