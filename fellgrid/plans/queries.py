"""Registered queries: each operator on the driver's tables, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import encode, geo, roads, text
from ..functions.geo import Grid
from ..operators import bundle, checks, evaluation, network, points, raster, spatial, temporal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def read(s: SparkSession, d: str, table: str) -> DataFrame:
    return s.read.parquet(f"{d}/{table}.parquet")


# ---- daily cubes: events by user, orders by customer group ----


def events_cube(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events")
    return e.groupBy(F.col("user_id").alias("cell"), F.to_date("ts").alias("day")).agg(F.max("value").alias("value"))


def orders_cube(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders")
    return o.groupBy((F.col("o_custkey") % 50).alias("cell"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("value"))


EVENTS = "cube AS (SELECT user_id AS cell, CAST(ts AS DATE) AS day, max(value) AS value FROM events GROUP BY ALL)"
ORDERS = "cube AS (SELECT o_custkey % 50 AS cell, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS value FROM orders GROUP BY ALL)"
RUNS = """, hot AS (SELECT cell, year(day) AS y, day, row_number() OVER (PARTITION BY cell, year(day) ORDER BY day) AS k FROM cube WHERE value > {t}),
isl AS (SELECT cell, y, count(*) AS n FROM hot GROUP BY cell, y, day - CAST(k AS INTEGER)),
best AS (SELECT cell, max(n) AS longest FROM isl GROUP BY cell)
SELECT c.cell, CAST(coalesce(longest, 0) AS BIGINT) AS longest FROM (SELECT DISTINCT cell FROM cube) c LEFT JOIN best USING (cell)"""


@query(f"WITH {EVENTS} SELECT cell, CAST(count(*) FILTER (value > 60) AS BIGINT) AS days FROM cube GROUP BY cell")
def hot_days_count(s, d):
    return temporal.threshold_days(events_cube(s, d), 60)


@query(f"WITH {EVENTS} SELECT cell, CAST(count(*) FILTER (value < 20) AS BIGINT) AS days FROM cube GROUP BY cell")
def cold_days_count(s, d):
    return temporal.threshold_days(events_cube(s, d), 20, below=True)


@query(
    f"""WITH {ORDERS}, cov AS (SELECT month, count(*) AS years FROM (SELECT DISTINCT year(day) AS y, month(day) AS month FROM cube) GROUP BY month),
n AS (SELECT cell, month(day) AS month, count(*) FILTER (value > 200000) AS n FROM cube GROUP BY ALL)
SELECT cell, sum(CAST(n AS DOUBLE) / years) AS days FROM n JOIN cov USING (month) GROUP BY cell"""
)
def expected_annual_hot_days(s, d):
    return temporal.expected_annual_days(orders_cube(s, d), 200000)


@query(f"WITH {EVENTS}" + RUNS.format(t=60))
def longest_hot_run(s, d):
    return temporal.longest_run(events_cube(s, d), 60)


@query(f"WITH {ORDERS}" + RUNS.format(t=100000))
def longest_hot_run_years(s, d):
    return temporal.longest_run(orders_cube(s, d), 100000)


@query(f"WITH {ORDERS} SELECT cell, quantile_cont(value, CAST(0.95 AS DOUBLE)) AS p0, quantile_cont(value, CAST(0.99 AS DOUBLE)) AS p1 FROM cube WHERE month(day) IN (6, 7, 8) GROUP BY cell")
def season_percentiles(s, d):
    return temporal.season_percentiles(orders_cube(s, d), [6, 7, 8], [0.95, 0.99])


SEASONS = ", ym AS (SELECT DISTINCT year(day) AS y, month(day) AS month, year(day) + CASE WHEN month(day) = 12 THEN 1 ELSE 0 END AS season FROM cube WHERE month(day) IN (12, 1, 2)), whole AS (SELECT season FROM ym GROUP BY season HAVING count(DISTINCT month) = 3)"


@query(f"WITH {ORDERS}{SEASONS} SELECT season, y, month FROM ym WHERE season IN (SELECT season FROM whole)")
def complete_winters(s, d):
    return temporal.complete_seasons(orders_cube(s, d), [12, 1, 2])


@query(f"WITH {ORDERS}{SEASONS} SELECT cell, quantile_cont(value, CAST(0.05 AS DOUBLE)) AS p0 FROM cube JOIN ym ON year(day) = ym.y AND month(day) = ym.month WHERE season IN (SELECT season FROM whole) GROUP BY cell")
def complete_season_percentile(s, d):
    return temporal.complete_season_percentile(orders_cube(s, d), [12, 1, 2], 0.05)


@query(f"WITH {ORDERS} SELECT CAST(y.y AS INTEGER) AS y, CAST(m.m AS INTEGER) AS month FROM range(1995, 2003) y(y), range(1, 13) m(m) WHERE NOT EXISTS (SELECT 1 FROM cube WHERE year(day) = y.y AND month(day) = m.m)")
def season_completeness(s, d):
    return temporal.missing_months(orders_cube(s, d), 1995, 2002)


@query(f"WITH {ORDERS}, m AS (SELECT DISTINCT month(day) AS m FROM cube WHERE year(day) = 2001) SELECT max(m) AS latest, count(*) AS months, count(*) = max(m) AS contiguous FROM m")
def contiguous_months(s, d):
    return temporal.contiguous_months(orders_cube(s, d), 2001)


@query(f"WITH {ORDERS} SELECT month, count(*) AS years FROM (SELECT DISTINCT year(day) AS y, month(day) AS month FROM cube) GROUP BY month")
def coverage_by_calendar_month(s, d):
    return temporal.months_covered(orders_cube(s, d))


@query(f"WITH {ORDERS}, b AS (SELECT min(day) AS a, max(day) AS z FROM cube) SELECT printf('%d-%02d to %d-%02d', year(a), month(a), year(z), month(z)) AS label FROM b")
def coverage_label(s, d):
    b = temporal.coverage_bounds(orders_cube(s, d))
    return b.select(text.coverage_label(*(F.col(c) for c in ("first_year", "first_month", "last_year", "last_month"))).alias("label"))


@query(f"WITH {EVENTS} SELECT cell, year(day) AS y, month(day) AS month, count(value) AS days, max(day(last_day(day))) AS expected FROM cube GROUP BY ALL HAVING count(value) <> max(day(last_day(day)))")
def completeness_violations(s, d):
    return temporal.incomplete_cells(events_cube(s, d))


@query(f"WITH {EVENTS} SELECT cell, CAST(count(*) AS BIGINT) AS n FROM cube WHERE cell NOT IN (1, 2, 3, 5, 8) GROUP BY cell")
def exclude_cells(s, d):
    gone = s.sql("SELECT * FROM VALUES (1), (2), (3), (5), (8) AS t(cell)")
    return temporal.exclude_cells(events_cube(s, d), gone).groupBy("cell").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT v.cell FROM (VALUES (1), (2), (999999)) v(cell) WHERE v.cell NOT IN (SELECT cell FROM cube)")
def unknown_exclusions(s, d):
    return temporal.unknown_exclusions(events_cube(s, d), s.sql("SELECT * FROM VALUES (1), (2), (999999) AS t(cell)"))


CLIMATE = f"""WITH {ORDERS}, hi AS (SELECT cell, day, floor(value / 100) / 100 AS v FROM cube), lo AS (SELECT cell, day, floor(value / 100) / 100 - 10 AS v FROM cube),
ym AS (SELECT DISTINCT year(day) AS y, month(day) AS m FROM cube), cov AS (SELECT m, count(*) AS years FROM ym GROUP BY m),
winter AS (SELECT y, m FROM (SELECT y, m, count(*) OVER (PARTITION BY y + CASE WHEN m = 12 THEN 1 ELSE 0 END) AS n FROM ym WHERE m IN (12, 1, 2)) WHERE n = 3),
summer AS (SELECT y, m FROM (SELECT y, m, count(*) OVER (PARTITION BY y) AS n FROM ym WHERE m IN (6, 7, 8)) WHERE n = 3 AND y = 2000),
hot AS (SELECT cell, year(day) AS y, day, row_number() OVER (PARTITION BY cell, year(day) ORDER BY day) AS k FROM hi WHERE v > 25),
isl AS (SELECT cell, y, count(*) AS n FROM hot GROUP BY cell, y, day - CAST(k AS INTEGER)),
e AS (SELECT 'heat_days_tmax_gt_25' AS metric, cell, month(day) AS m, count(*) FILTER (v > 25) AS n FROM hi GROUP BY ALL
  UNION ALL SELECT 'heat_days_tmax_gt_28', cell, month(day), count(*) FILTER (v > 28) FROM hi GROUP BY ALL
  UNION ALL SELECT 'heat_days_tmax_gt_30', cell, month(day), count(*) FILTER (v > 30) FROM hi GROUP BY ALL
  UNION ALL SELECT 'heat_tropical_nights_tmin_gt_20', cell, month(day), count(*) FILTER (v > 20) FROM lo GROUP BY ALL
  UNION ALL SELECT 'cold_air_frost_days', cell, month(day), count(*) FILTER (v < 0) FROM lo GROUP BY ALL)
SELECT metric, cell, round(value, 6) AS value FROM (
SELECT metric, cell, sum(CAST(n AS DOUBLE) / years) AS value FROM e JOIN cov USING (m) GROUP BY metric, cell
UNION ALL SELECT 'heat_longest_run_tmax_gt_25', c.cell, CAST(coalesce(max(n), 0) AS DOUBLE) FROM (SELECT DISTINCT cell FROM hi) c LEFT JOIN isl USING (cell) GROUP BY c.cell
UNION ALL SELECT 'heat_2000_longest_run_tmax_gt_25', c.cell, CAST(coalesce(max(n), 0) AS DOUBLE) FROM (SELECT DISTINCT cell FROM hi WHERE year(day) = 2000) c LEFT JOIN isl ON isl.cell = c.cell AND y = 2000 GROUP BY c.cell
UNION ALL SELECT 'heat_summer_tmax_p95', cell, quantile_cont(v, CAST(0.95 AS DOUBLE)) FROM hi WHERE month(day) IN (6, 7, 8) GROUP BY cell
UNION ALL SELECT 'heat_summer_tmax_p99', cell, quantile_cont(v, CAST(0.99 AS DOUBLE)) FROM hi WHERE month(day) IN (6, 7, 8) GROUP BY cell
UNION ALL SELECT 'heat_2000_summer_tmax_p95', cell, quantile_cont(v, CAST(0.95 AS DOUBLE)) FROM hi JOIN summer ON year(day) = y AND month(day) = m GROUP BY cell
UNION ALL SELECT 'heat_2000_days_tmax_gt_25', cell, CAST(count(*) FILTER (v > 25) AS DOUBLE) FROM hi WHERE year(day) = 2000 GROUP BY cell
UNION ALL SELECT 'heat_2000_tropical_nights_tmin_gt_20', cell, CAST(count(*) FILTER (v > 20) AS DOUBLE) FROM lo WHERE year(day) = 2000 GROUP BY cell
UNION ALL SELECT 'cold_winter_tmin_p05', cell, quantile_cont(v, CAST(0.05 AS DOUBLE)) FROM lo JOIN winter ON year(day) = y AND month(day) = m GROUP BY cell)"""


@query(CLIMATE)
def climate_metrics(s, d):
    from .climate import climate_metrics as plan

    cube = orders_cube(s, d).withColumn("value", F.floor(F.col("value") / 100) / 100)
    return plan(cube, cube.withColumn("value", F.col("value") - 10), 2000).withColumn("value", F.round("value", 6))


# ---- rasters ----


@query("WITH v AS (SELECT l_partkey % 100 AS cell, year(l_shipdate) AS y, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL), n AS (SELECT count(DISTINCT y) AS n FROM v) SELECT cell, avg(value) AS mean FROM v GROUP BY cell HAVING count(value) = (SELECT n FROM n)")
def all_periods_mean(s, d):
    v = read(s, d, "lineitem").groupBy((F.col("l_partkey") % 100).alias("cell"), F.year("l_shipdate").alias("y")).agg(F.avg("l_extendedprice").alias("value"))
    return raster.all_periods_mean(v, v.select("y").distinct().count())


@query("SELECT CAST(floor(l_partkey / 20.0) AS BIGINT) AS tile_row, l_suppkey AS tile_col, max(l_extendedprice) - min(l_extendedprice) AS relief FROM lineitem GROUP BY ALL")
def block_relief(s, d):
    p = read(s, d, "lineitem").select(F.floor(F.col("l_partkey") / 20).alias("tile_row"), F.col("l_suppkey").alias("tile_col"), F.col("l_extendedprice").alias("value"))
    return raster.block_relief(p, "tile_row", "tile_col")


@query("SELECT p_partkey, CAST(floor(p_retailprice / CAST(0.1 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS encoded, floor(p_retailprice / CAST(0.1 AS DOUBLE) + CAST(0.5 AS DOUBLE)) * CAST(0.1 AS DOUBLE) AS decoded FROM part")
def quantise_roundtrip(s, d):
    p = read(s, d, "part").select("p_partkey", encode.quantise(F.col("p_retailprice"), 0.1, 0.0).alias("encoded"))
    return p.withColumn("decoded", encode.dequantise(F.col("encoded"), 0.1, 0.0))


@query("SELECT p_brand, min(e) AS encoded_min, max(e) AS encoded_max, count(e) AS valid_count FROM (SELECT p_brand, CAST(floor(p_retailprice + CAST(0.5 AS DOUBLE)) AS INTEGER) AS e FROM part) GROUP BY p_brand")
def encoded_summary(s, d):
    return raster.encoded_summary(read(s, d, "part").select("p_brand", encode.quantise(F.col("p_retailprice"), 1.0, 0.0).alias("encoded")), "p_brand")


@query("SELECT p_partkey, printf('%.1f', floor(p_retailprice * 2 + CAST(0.5 AS DOUBLE)) * CAST(0.5 AS DOUBLE)) || ' days' AS shown FROM part")
def show_value(s, d):
    return read(s, d, "part").select("p_partkey", encode.show_value(encode.quantise(F.col("p_retailprice"), 0.5, 0.0), 0.5, 0.0, 1, "days").alias("shown"))


GRID = Grid(width=64, height=64, cell_size_m=0.1, west=-3.2, south=-3.2)


def vectors_xy(s, d):
    return read(s, d, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))


XY = "xy AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
CELLS = ", g AS (SELECT vec_id, CAST(floor((y - CAST(-3.2 AS DOUBLE)) / CAST(0.1 AS DOUBLE)) AS BIGINT) AS r, CAST(floor((x - CAST(-3.2 AS DOUBLE)) / CAST(0.1 AS DOUBLE)) AS BIGINT) AS c FROM xy)"


@query(f'WITH {XY}{CELLS} SELECT vec_id, r AS "row", c AS col, r * 64 + c AS cell FROM g WHERE r BETWEEN 0 AND 63 AND c BETWEEN 0 AND 63')
def grid_index(s, d):
    p = vectors_xy(s, d).select("vec_id", geo.cell_row(F.col("y"), GRID).alias("row"), geo.cell_column(F.col("x"), GRID).alias("col"))
    return p.filter(geo.inside(F.col("row"), F.col("col"), GRID)).withColumn("cell", geo.cell_id(F.col("row"), F.col("col"), GRID))


@query("SELECT p_partkey AS cell, CAST(-32000 AS DOUBLE) + (p_partkey % 64 + CAST(0.5 AS DOUBLE)) * 1000 AS easting, CAST(-32000 AS DOUBLE) + (p_partkey // 64 + CAST(0.5 AS DOUBLE)) * 1000 AS northing FROM part")
def cell_centres(s, d):
    g = Grid(64, 64, 1000, -32000, -32000)
    return read(s, d, "part").select(F.col("p_partkey").alias("cell"), geo.centre_easting(F.col("p_partkey") % 64, g).alias("easting"), geo.centre_northing(F.floor(F.col("p_partkey") / 64), g).alias("northing"))


def part_raster(s, d):
    return read(s, d, "part").select(F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), F.floor("p_retailprice").alias("encoded"))


PART_RASTER = "l0 AS (SELECT CAST(floor(p_partkey / 50.0) AS BIGINT) AS r, p_partkey % 50 AS c, CAST(floor(p_retailprice) AS BIGINT) AS e FROM part)"


def _levels(n: int) -> str:
    return PART_RASTER + "".join(f", l{i} AS (SELECT r // 2 AS r, c // 2 AS c, CAST((2 * sum(e) + count(*)) // (2 * count(*)) AS BIGINT) AS e FROM l{i - 1} GROUP BY ALL)" for i in range(1, n + 1))


@query(f'WITH {_levels(6)} ' + " UNION ALL ".join(f'SELECT {i} AS level, r AS "row", c AS col, e AS encoded FROM l{i}' for i in range(7)))
def lod_pyramid(s, d):
    return raster.pyramid(part_raster(s, d), 50, 50)


@query(f'WITH {_levels(3)} SELECT 3 AS level, r AS "row", c AS col, e AS encoded FROM l3')
def lod_level_3(s, d):
    level = part_raster(s, d).select(F.lit(0).alias("level"), "row", "col", "encoded")
    for _ in range(3):
        level = raster.parent_level(level)
    return level


LOD_SIZES = "WITH RECURSIVE l(level, width, height, off) AS (SELECT 0, CAST(900 AS BIGINT), CAST(1450 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT level + 1, (width + 1) // 2, (height + 1) // 2, off + width * height FROM l WHERE width > 1 OR height > 1)"


@query(LOD_SIZES + " SELECT level, width, height, CAST(1000 * 2 ** level AS DOUBLE) AS cell_size_m, off AS value_offset, width * height AS value_count FROM l")
def lod_dimensions(s, d):
    return raster.level_sizes(s, Grid(900, 1450, 1000, 0, 0))


@query(LOD_SIZES + ", z AS (SELECT CAST(unnest(range(0, 15)) AS INTEGER) AS zoom) SELECT zoom, CAST(coalesce(min(level) FILTER (CAST(0.003 AS DOUBLE) * 2 ** zoom * 2 ** level >= 4), max(level)) AS INTEGER) AS level FROM z, l GROUP BY zoom")
def choose_lod(s, d):
    zooms = s.range(15).select(F.col("id").cast("int").alias("zoom"))
    return raster.choose_level(zooms, raster.level_sizes(s, Grid(900, 1450, 1000, 0, 0)), 0.003)


@query("SELECT p_partkey, CAST(least(63, floor(greatest(0, least(1, CAST(p_size - 10 AS DOUBLE) / 30)) * 64)) AS INTEGER) AS bin FROM part")
def palette_bins(s, d):
    return read(s, d, "part").select("p_partkey", encode.palette_bin(F.col("p_size"), F.lit(10.0), F.lit(40.0)).alias("bin"))


@query(
    """WITH b AS (SELECT unnest(range(0, 64)) AS bin), p AS (SELECT bin, CAST(bin AS DOUBLE) / 63 * 2 AS pos FROM b),
q AS (SELECT bin, pos, CAST(floor(pos) AS INTEGER) AS lo, least(2, CAST(floor(pos) AS INTEGER) + 1) AS hi FROM p)
SELECT CAST(bin AS INTEGER) AS bin, 'rgb(' || CAST(floor([0, 128, 255][lo+1] + ([0, 128, 255][hi+1] - [0, 128, 255][lo+1]) * (pos - lo) + CAST(0.5 AS DOUBLE)) AS BIGINT)
 || ' ' || CAST(floor([0, 255, 128][lo+1] + ([0, 255, 128][hi+1] - [0, 255, 128][lo+1]) * (pos - lo) + CAST(0.5 AS DOUBLE)) AS BIGINT)
 || ' ' || CAST(floor([255, 0, 0][lo+1] + ([255, 0, 0][hi+1] - [255, 0, 0][lo+1]) * (pos - lo) + CAST(0.5 AS DOUBLE)) AS BIGINT) || ')' AS colour FROM q"""
)
def palette_colours(s, d):
    return s.range(64).select(F.col("id").cast("int").alias("bin"), encode.palette_colour(["#0000ff", "#80ff00", "#ff8000"], F.col("id").cast("int")).alias("colour"))


@query("WITH b AS (SELECT unnest(range(0, 64)) AS bin) SELECT CAST(bin AS INTEGER) AS bin, printf('hsl(%.0f 78%% %.1f%%)', 220 - CAST(bin AS DOUBLE) / 63 * 220, 48 - 10 * (1 - CAST(bin AS DOUBLE) / 63) ** 2) AS colour FROM b")
def plain_colours(s, d):
    return s.range(64).select(F.col("id").cast("int").alias("bin"), encode.plain_colour(F.col("id").cast("int")).alias("colour"))


@query(
    """WITH p AS (SELECT p_brand, CAST(min(p_size) AS BIGINT) AS lo, CAST(max(p_size) AS BIGINT) AS hi FROM part GROUP BY p_brand),
v AS (SELECT p_brand, lo, hi, least(5, greatest(1, hi - lo + 1)) AS n FROM p)
SELECT p_brand, array_to_string(list_sort(list_distinct(list_transform(range(0, n), lambda i: CAST(floor(lo + CAST((hi - lo) * i AS DOUBLE) / greatest(1, n - 1) + CAST(0.5 AS DOUBLE)) AS BIGINT)))), ',') AS samples FROM v"""
)
def legend_samples(s, d):
    b = read(s, d, "part").groupBy("p_brand").agg(F.min("p_size").cast("long").alias("lo"), F.max("p_size").cast("long").alias("hi"))
    return b.select("p_brand", F.concat_ws(",", F.transform(F.array_sort(encode.legend_values(F.col("lo"), F.col("hi"))), lambda v: v.cast("long").cast("string"))).alias("samples"))


@query(
    """WITH b AS (SELECT p_brand, min(p_size) AS a, max(p_size) AS z FROM part GROUP BY p_brand)
SELECT p_brand, CASE WHEN a * 10 < z * 10 THEN CAST(a * 10 AS BIGINT) ELSE 7 END AS lo, CASE WHEN a * 10 < z * 10 THEN CAST(z * 10 AS BIGINT) ELSE 9 END AS hi FROM b"""
)
def display_ranges(s, d):
    b = read(s, d, "part").groupBy("p_brand").agg(F.min("p_size").cast("double").alias("a"), F.max("p_size").cast("double").alias("z"))
    r = encode.display_range(F.col("a"), F.col("z"), F.lit(0.1), F.lit(0.0), F.lit(7), F.lit(9))
    return b.select("p_brand", r.alias("r")).select("p_brand", F.col("r.min").alias("lo"), F.col("r.max").alias("hi"))


@query("SELECT p_partkey, CAST((p_size - 1) AS DOUBLE) / 49 * 100 AS percent FROM part")
def range_percent(s, d):
    return read(s, d, "part").select("p_partkey", encode.range_percent(F.col("p_size"), F.lit(1), F.lit(50)).alias("percent"))


@query(f'WITH {PART_RASTER} SELECT r AS "row", c AS col, e AS encoded FROM l0 WHERE r BETWEEN 5 AND 20 AND c BETWEEN 10 AND 30')
def viewport_cells(s, d):
    return raster.window_cells(part_raster(s, d), 5, 20, 10, 30)


@query("WITH x AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS x FROM part), g AS (SELECT x - lag(x) OVER (ORDER BY x) AS gap FROM x) SELECT median(gap) AS step, max(gap) - min(gap) <= CAST(1e-6 AS DOUBLE) * median(gap) AS regular FROM g WHERE gap IS NOT NULL AND gap <> 0")
def axis_step(s, d):
    return raster.axis_step(read(s, d, "part").select(F.col("p_size").cast("double").alias("x")), "x")


@query("SELECT p_partkey, least(90, (p_partkey // 40) * 4) * 61 + least(60, (p_partkey % 40) * 4) AS corner FROM part")
def corner_index(s, d):
    return read(s, d, "part").select("p_partkey", raster.corner_index(4, 60, 90, F.floor(F.col("p_partkey") / 40), F.col("p_partkey") % 40).alias("corner"))


@query("SELECT vec_id, 256 * (CAST(embedding[1] AS DOUBLE) + 180) / 360 AS x, 256 * (1 - asinh(tan(radians(CAST(embedding[2] AS DOUBLE) + 54))) / pi()) / 2 AS y FROM embeddings")
def web_mercator(s, d):
    p = vectors_xy(s, d).select("vec_id", geo.world_pixel(F.col("x"), F.col("y") + 54.0).alias("p"))
    return p.select("vec_id", "p.x", "p.y")


@query()
def national_grid_roundtrip(s, d):
    p = vectors_xy(s, d).select("vec_id", (F.col("y") * 0.5 + 54).alias("lat"), (F.col("x") * 0.5 - 2).alias("lon"))
    p = p.withColumn("g", geo.to_national_grid(F.col("lat"), F.col("lon"))).withColumn("back", geo.from_national_grid(F.col("g.easting"), F.col("g.northing")))
    return p.select("vec_id", F.round("g.easting", 1).alias("easting"), F.round("g.northing", 1).alias("northing"), (F.abs(F.col("back.lat") - F.col("lat")) + F.abs(F.col("back.lon") - F.col("lon")) < 1e-6).alias("same"))


# ---- points ----


def places(s, d):
    """Embeddings as places in a small area, so that some share a spot."""
    p = vectors_xy(s, d)
    return p.select(
        F.element_at(F.array(*(F.lit(c) for c in points.CATEGORIES[:4])), (F.col("vec_id") % 4 + 1).cast("int")).alias("category"),
        F.concat(F.lit("Shop "), F.col("label").cast("string")).alias("name"),
        (F.lit(54.0) + F.floor(F.col("x") * 20) * 0.0001).alias("lat"),
        (F.lit(-1.1) + F.floor(F.col("y") * 20) * 0.0001).alias("lon"),
        F.concat(F.lit("n/"), F.col("vec_id").cast("string")).alias("source_ref"),
        F.lit("osm").alias("source_id"),
        (F.col("vec_id") % 3).cast("int").alias("source_rank"),
    )


PLACES = f"{XY}, pl AS (SELECT vec_id, ['supermarket', 'convenience', 'post_office', 'pharmacy'][vec_id % 4 + 1] AS category, 'Shop ' || label AS name, CAST(54 AS DOUBLE) + floor(x * 20) * CAST(0.0001 AS DOUBLE) AS lat, CAST(-1.1 AS DOUBLE) + floor(y * 20) * CAST(0.0001 AS DOUBLE) AS lon, 'n/' || vec_id AS source_ref, CAST(vec_id % 3 AS INTEGER) AS source_rank FROM xy)"


@query(f"WITH {PLACES} SELECT category, name, lat, lon, source_ref FROM pl WHERE lat BETWEEN CAST(53.9995 AS DOUBLE) AND CAST(54.0005 AS DOUBLE) AND lon BETWEEN CAST(-1.1005 AS DOUBLE) AND CAST(-1.0995 AS DOUBLE)")
def viewport_points(s, d):
    return points.in_view(places(s, d), 53.9995, 54.0005, -1.1005, -1.0995).select("category", "name", "lat", "lon", "source_ref")


@query(f"WITH {PLACES}, v AS (SELECT category, name, lat, lon, source_ref FROM pl WHERE lat >= 54), n AS (SELECT count(*) AS n FROM v) SELECT v.* FROM v, n WHERE n <= 200")
def viewport_markers_capped(s, d):
    """A view with more places than it shows has none at all."""
    return points.capped(places(s, d).filter("lat >= 54").select("category", "name", "lat", "lon", "source_ref"))


@query(f"WITH {PLACES}, v AS (SELECT category, name, lat, lon, source_ref FROM pl WHERE lat >= CAST(54.00035 AS DOUBLE)) SELECT v.* FROM v WHERE (SELECT count(*) FROM v) <= 200")
def viewport_markers_few(s, d):
    """The view's northern edge, with few enough places to show."""
    return points.capped(points.in_view(places(s, d), 54.00035, 55.0, -90.0, 90.0).select("category", "name", "lat", "lon", "source_ref"))


@query(f"WITH {PLACES} SELECT CAST(floor(lat * 4) AS BIGINT) || ':' || CAST(floor(lon * 4) AS BIGINT) AS bucket, category, count(*) AS places, string_agg(source_ref, ',' ORDER BY lat, lon, source_ref) AS refs FROM pl GROUP BY ALL")
def bucketed_points(s, d):
    return points.bucketed(places(s, d)).select("bucket", "category", F.size("places").cast("long").alias("places"), F.concat_ws(",", F.transform("places", lambda p: p["source_ref"])).alias("refs"))


@query()
def greedy_dedup(s, d):
    return points.deduplicate(places(s, d)).select("category", "name", "lat", "lon", "source_ref")


@query(f"WITH {PLACES} SELECT vec_id, round(sqrt(((lon - CAST(-1.1 AS DOUBLE)) * 111320 * cos(radians((lat + 54) / 2))) ** 2 + ((lat - 54) * 110540) ** 2), 6) AS metres FROM (SELECT * FROM pl)")
def approximate_distance(s, d):
    p = places(s, d)
    m = geo.approximate_metres(F.col("lat"), F.col("lon"), F.lit(54.0), F.lit(-1.1))
    return p.select(F.substring("source_ref", 3, 20).cast("long").alias("vec_id"), F.round(m, 6).alias("metres"))


@query("SELECT c_custkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 20")
def postcode_lookup(s, d):
    n = read(s, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("postcode"), "n_name", "n_regionkey", F.lit(1).alias("line"))
    c = read(s, d, "customer").select("c_custkey", F.concat(F.lit(" "), F.col("c_nationkey").cast("string")).alias("postcode"), F.col("c_mktsegment").alias("category"))
    return points.geocode(c, n)[0].select("c_custkey", "n_name", "n_regionkey")


@query("SELECT c_mktsegment AS category, count(*) AS missing FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20) GROUP BY c_mktsegment")
def lookup_misses(s, d):
    n = read(s, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("postcode"), "n_name", F.lit(1).alias("line"))
    c = read(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("postcode"), F.col("c_mktsegment").alias("category"))
    return points.geocode(c, n)[1]


@query("SELECT s_suppkey, n_name, ['general', 'community', 'general', 'other', 'community'][n_regionkey + 1] AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def classified_lookup(s, d):
    kinds = text.literal_map({"0": "general", "1": "community", "2": "general", "3": "other", "4": "community"})
    n = read(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.element_at(kinds, F.col("n_regionkey").cast("string")).alias("kind"))
    return points.lookup(read(s, d, "supplier"), n, "s_nationkey", "inner").select("s_suppkey", "n_name", "kind")


@query("SELECT source, nation, count(*) AS n FROM (SELECT 'customer' AS source, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY ALL")
def union_sources_counts(s, d):
    c = read(s, d, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("nation"))
    u = bundle.union_all(c, read(s, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("nation")))
    return u.groupBy("source", "nation").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, tag AS category FROM (SELECT p_partkey, unnest([CASE WHEN p_size < 20 THEN 'small' END, CASE WHEN p_size BETWEEN 10 AND 40 THEN 'middle' END, CASE WHEN p_brand = 'Brand#1' THEN 'first' END]) AS tag FROM part) WHERE tag IS NOT NULL")
def multi_category_explode(s, d):
    p = read(s, d, "part").select("p_partkey", F.when(F.col("p_size") < 20, "small").alias("a"), F.when(F.col("p_size").between(10, 40), "middle").alias("b"), F.when(F.col("p_brand") == "Brand#1", "first").alias("c"))
    return points.explode_categories(p, [("a", "small"), ("b", "middle"), ("c", "first")]).select("p_partkey", "category")


@query("""WITH f AS (SELECT [' danger_area', 'range ', 'barracks', NULL][event_id % 4 + 1] AS military, CASE WHEN event_id % 3 = 0 THEN 'military' ELSE event_type END AS landuse FROM events)
SELECT CASE WHEN trim(military) IN ('danger_area', 'range') THEN 'dangerous' WHEN landuse = 'military' THEN 'unspecified' END AS category, count(*) AS n FROM f GROUP BY 1""")
def military_classes(s, d):
    kinds = F.array(F.lit(" danger_area"), F.lit("range "), F.lit("barracks"), F.lit(None))
    e = read(s, d, "events").select(F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("military"), F.when(F.col("event_id") % 3 == 0, "military").otherwise(F.col("event_type")).alias("landuse"))
    return e.groupBy(points.military_category(F.col("military"), F.col("landuse")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT 'add' AS change, vec_id FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 2 <> 0 UNION ALL SELECT 'remove', vec_id FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 3 <> 0")
def marker_changes(s, d):
    v = read(s, d, "embeddings").select("vec_id")
    return points.marker_changes(v.filter("vec_id % 2 = 0"), v.filter("vec_id % 3 = 0"), "vec_id")


# ---- text ----


@query("SELECT c_custkey, upper(replace(c_name, ' ', '')) AS compact, regexp_replace(lower(c_name), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM customer")
def normalised_names(s, d):
    return read(s, d, "customer").select("c_custkey", text.compact_upper(F.col("c_name")).alias("compact"), text.match_key(F.col("c_name"), F.lit("r")).alias("key"))


@query("SELECT doc_id, CASE WHEN length(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) = 0 THEN 'none' ELSE left(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 200) END AS name FROM documents")
def clean_names(s, d):
    return read(s, d, "documents").select("doc_id", text.clean_name(F.col("text"), F.lit("none")).alias("name"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.2f B', CAST(n_chars AS DOUBLE)) WHEN n_chars < 1048576 THEN printf('%.2f KiB', round_even(n_chars / CAST(1024 AS DOUBLE), 2)) ELSE printf('%.2f MiB', n_chars / CAST(1048576 AS DOUBLE)) END AS size FROM documents")
def human_sizes(s, d):
    return read(s, d, "documents").select("doc_id", text.human_bytes(F.col("n_chars")).alias("size"))


@query(r"""SELECT page_id, count(*) AS links, min(link) AS first FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']*)["'']', 1)) AS link FROM pages) GROUP BY page_id""")
def html_links(s, d):
    from ..sources.tables import page_links

    return page_links(read(s, d, "pages")).groupBy("page_id").agg(F.count("*").alias("links"), F.min("link").alias("first"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_props(s, d):
    return read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def file_hash(s, d):
    return read(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("SELECT CAST(v AS VARCHAR) AS variable, y AS year, CASE v WHEN 'no2' THEN printf('mapno2%d.csv', y) WHEN 'ozone_dgt120' THEN printf('mapdgt120%02d.csv', y % 100) ELSE printf('map%s%dg.csv', v, y) END AS file FROM (VALUES ('pm25'), ('pm10'), ('no2'), ('ozone_dgt120')) t(v), (SELECT CAST(unnest(range(2022, 2025)) AS INTEGER) AS y)")
def grid_file_names(s, d):
    v = s.sql("SELECT * FROM VALUES ('pm25'), ('pm10'), ('no2'), ('ozone_dgt120') AS t(variable)").crossJoin(s.range(2022, 2025).select(F.col("id").cast("int").alias("year")))
    return v.withColumn("file", text.grid_file_name(F.col("variable"), F.col("year")))


@query("SELECT r_regionkey, 'https://www.google.com/maps/dir/' || replace(r_name, ' ', '%20') || '/York%20station/data=!4m2!4m1!3e0' AS url FROM region")
def directions_urls(s, d):
    return read(s, d, "region").select("r_regionkey", text.directions_url(F.col("r_name"), F.lit("York station")).alias("url"))


@query("SELECT vec_id, 'https://www.openstreetmap.org/' || ['node', 'way', 'relation'][vec_id % 3 + 1] || '/' || vec_id AS url FROM embeddings")
def osm_links(s, d):
    kind = F.element_at(F.array(F.lit("node"), F.lit("way"), F.lit("relation")), (F.col("vec_id") % 3 + 1).cast("int"))
    return read(s, d, "embeddings").select("vec_id", text.osm_url(text.osm_reference(kind, F.col("vec_id"))).alias("url"))


@query("SELECT event_id, CASE WHEN isfinite(try_cast(props->>'$.k' AS DOUBLE)) THEN try_cast(props->>'$.k' AS DOUBLE) END AS v FROM events")
def finite_numbers(s, d):
    return read(s, d, "events").select("event_id", text.finite_number(F.get_json_object("props", "$.k")).alias("v"))


# ---- spatial ----

BOXES = "b AS (SELECT p_partkey AS box, CAST(p_partkey % 40 AS DOUBLE) / 10 - 2 AS minx, CAST(p_partkey % 31 AS DOUBLE) / 10 - 1.5 AS miny, CAST(p_partkey % 40 AS DOUBLE) / 10 - 2 + CAST(p_size AS DOUBLE) / 25 AS maxx, CAST(p_partkey % 31 AS DOUBLE) / 10 - 1.5 + CAST(p_size AS DOUBLE) / 50 AS maxy FROM part)"


def boxes(s, d):
    p = read(s, d, "part")
    x, y = (F.col("p_partkey") % 40).cast("double") / 10 - 2, (F.col("p_partkey") % 31).cast("double") / 10 - 1.5
    return p.select(F.col("p_partkey").alias("box"), x.alias("minx"), y.alias("miny"), (x + F.col("p_size").cast("double") / 25).alias("maxx"), (y + F.col("p_size").cast("double") / 50).alias("maxy"))


@query(f"WITH {XY}, {BOXES} SELECT vec_id, box FROM xy JOIN b ON x > minx AND x < maxx AND y > miny AND y < maxy")
def points_in_boxes(s, d):
    return spatial.points_in_boxes(vectors_xy(s, d), boxes(s, d), 0.5).select("vec_id", "box")


@query(f"WITH {XY}, {BOXES} SELECT vec_id, min(box) AS box FROM xy JOIN b ON x BETWEEN minx AND maxx AND y BETWEEN miny AND maxy GROUP BY vec_id")
def first_box(s, d):
    return spatial.first_hit(spatial.points_in_boxes(vectors_xy(s, d), boxes(s, d), 0.5, border=True), "vec_id", "box")


@query(f"WITH {XY}, {BOXES} SELECT label AS edge, count(DISTINCT vec_id % 3) AS score FROM xy JOIN b ON x > minx AND x < maxx AND y > miny AND y < maxy GROUP BY label")
def built_up_score(s, d):
    hits = spatial.points_in_boxes(vectors_xy(s, d), boxes(s, d), 0.5).select(F.col("label").alias("edge"), (F.col("vec_id") % 3).alias("sample"))
    return spatial.samples_hit(hits, "edge", "sample")


AREA = f"{BOXES}, c AS (SELECT box, minx, miny, maxx, maxy, unnest(range(CAST(floor(minx * 2) AS BIGINT), CAST(floor(maxx * 2) AS BIGINT) + 1)) AS cx FROM b), cc AS (SELECT *, unnest(range(CAST(floor(miny * 2) AS BIGINT), CAST(floor(maxy * 2) AS BIGINT) + 1)) AS cy FROM c), a AS (SELECT box, cx, cy, (least(maxx, (cx + 1) / 2.0::DOUBLE) - greatest(minx, cx / 2.0::DOUBLE)) * (least(maxy, (cy + 1) / 2.0::DOUBLE) - greatest(miny, cy / 2.0::DOUBLE)) AS area FROM cc)"


@query(f"WITH {AREA} SELECT box, cx, cy, round(area, 9) AS area FROM a WHERE area > CAST(1e-12 AS DOUBLE)")
def box_overlap_area(s, d):
    return spatial.overlap_areas(boxes(s, d), 0.5).filter("area > 1e-12").select("box", "cx", "cy", F.round("area", 9).alias("area"))


@query(f"WITH {AREA} SELECT cx, cy, count(*) AS boxes FROM cc GROUP BY cx, cy")
def range_overlap_cells(s, d):
    return spatial.covering_cells(boxes(s, d), 0.5).groupBy("cx", "cy").agg(F.count("*").alias("boxes"))


@query(f"WITH {XY}, q AS (SELECT * FROM xy WHERE vec_id % 5 = 0), n AS (SELECT * FROM xy WHERE vec_id % 5 <> 0), r AS (SELECT q.vec_id AS point_id, n.vec_id AS node_id, sqrt((q.x - n.x) ** 2 + (q.y - n.y) ** 2) AS dist FROM q, n), k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, node_id) AS k FROM r) SELECT point_id, node_id, round(dist, 9) AS distance FROM k WHERE k = 1")
def nearest_neighbour(s, d):
    v = vectors_xy(s, d)
    p = v.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "point_id")
    n = v.filter("vec_id % 5 <> 0").select(F.col("vec_id").alias("node_id"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return spatial.nearest(p, n, 0.05).select("point_id", "node_id", F.round("distance", 9).alias("distance"))


@query(
    f"""WITH {XY}, e AS (SELECT vec_id AS edge_id, label AS road, x * 100 AS mx, y * 100 AS my FROM xy WHERE vec_id % 2 = 0), l AS (SELECT vec_id AS line_id, label AS road, CAST(vec_id % 90 AS DOUBLE) AS mph, x * 100 AS ax, y * 100 AS ay FROM xy WHERE vec_id % 2 = 1),
m AS (SELECT edge_id, line_id, mph, sqrt((mx - ax) ** 2 + (my - ay) ** 2) AS dist FROM e JOIN l USING (road)),
w AS (SELECT *, min(dist) OVER (PARTITION BY edge_id) AS near, row_number() OVER (PARTITION BY edge_id ORDER BY dist, line_id) AS k FROM m),
u AS (SELECT edge_id, avg(mph) AS mph, count(*) AS candidates FROM w WHERE (dist <= 80 OR (near > 80 AND k = 1)) AND dist <= 120 AND dist <= near + 15 GROUP BY edge_id)
SELECT * FROM u WHERE mph BETWEEN 5 AND 85"""
)
def distance_band_match(s, d):
    v = vectors_xy(s, d)
    e = v.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("edge_id"), F.col("label").cast("string").alias("road"), (F.col("x") * 100).alias("mx"), (F.col("y") * 100).alias("my"))
    x, y = F.col("x") * 100, F.col("y") * 100
    n = v.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("line_id"), F.col("label").cast("string").alias("road"), (F.col("vec_id") % 90).cast("double").alias("mph"), x.alias("ax"), y.alias("ay"), x.alias("bx"), y.alias("by"))
    return spatial.band_match(e, n)


# ---- networks ----


def edges(s, d):
    return read(s, d, "lineitem").groupBy(F.col("l_partkey").alias("u"), (F.col("l_suppkey") + 1000000).alias("v")).agg(F.min("l_quantity").cast("long").alias("cost"))


EDGES = "e AS (SELECT l_partkey AS u, l_suppkey + 1000000 AS v, CAST(min(l_quantity) AS BIGINT) AS cost FROM lineitem GROUP BY ALL), arcs AS (SELECT u AS src, v AS dst, cost FROM e UNION ALL SELECT v, u, cost FROM e)"


@query(f"WITH RECURSIVE {EDGES}, p(node, distance) USING KEY (node) AS (SELECT 1::BIGINT, 0::BIGINT UNION (SELECT arcs.dst, min(p.distance + arcs.cost)::BIGINT FROM p JOIN arcs ON arcs.src = p.node LEFT JOIN recurring.p AS r ON r.node = arcs.dst WHERE r.distance IS NULL OR p.distance + arcs.cost < r.distance GROUP BY arcs.dst)) SELECT node, distance FROM p")
def shortest_paths(s, d):
    return network.shortest_paths(edges(s, d), s.sql("SELECT * FROM VALUES (1L) AS t(node)"))


@query(f"WITH {EDGES} SELECT src AS node, count(*) AS degree FROM arcs GROUP BY src")
def node_degree(s, d):
    return network.degrees(edges(s, d))


@query(f"WITH {EDGES}, g AS (SELECT src AS node, count(*) AS degree FROM arcs GROUP BY src) SELECT node, CAST(coalesce(sum(degree) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM g")
def adjacency_offsets(s, d):
    g = network.degrees(edges(s, d))
    return network.offsets(g, g.select("node"))


def as_links(s, d):
    functions = F.array(*(F.lit(k) for k in roads.FALLBACK_MPH))
    forms = F.array(F.lit("Single Carriageway"), F.lit("Dual Carriageway"), F.lit("Roundabout"), F.lit("Slip Road"))
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(functions, (F.col("l_partkey") % 9 + 1).cast("int")).alias("function"), F.element_at(forms, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("formOfWay"), F.greatest(F.lit(1), F.floor("l_extendedprice")).alias("length_m"))


LINKS = "k AS (SELECT l_orderkey, l_linenumber, l_partkey % 9 + 1 AS f, l_suppkey % 4 + 1 AS m, greatest(1, CAST(floor(l_extendedprice) AS BIGINT)) AS len FROM lineitem), sp AS (SELECT *, CAST([60, 44, 35, 30, 25, 16, 20, 16, 15][f] AS DOUBLE) AS mph FROM k), mp AS (SELECT *, CASE m WHEN 2 THEN CASE WHEN f = 1 THEN mph ELSE mph + 5 END WHEN 3 THEN least(mph, 20) WHEN 4 THEN least(mph, 35) ELSE mph END AS v FROM sp)"


@query(f"WITH {LINKS} SELECT l_orderkey, l_linenumber, [0, 1, 2, 4][m] AS flags, CAST(greatest(1, least(65534, round_even(len / (v * CAST(0.44704 AS DOUBLE)), 0))) AS INTEGER) AS base_cost FROM mp")
def speed_to_seconds(s, d):
    return network.link_costs(as_links(s, d)).select("l_orderkey", "l_linenumber", "flags", "base_cost")


@query("SELECT l_orderkey, l_linenumber, CAST(greatest(1, least(65534, round_even(CAST(l_extendedprice AS DOUBLE) / CAST(0.44704 AS DOUBLE) * (l_discount / 30 + (1 - l_discount) / 20), 0))) AS INTEGER) AS cost FROM lineitem")
def mixed_costs(s, d):
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", roads.mixed_seconds(F.col("l_extendedprice"), F.col("l_discount"), F.lit(30.0), F.lit(20.0), F.lit(0)).alias("cost"))


@query(
    """WITH sp AS (SELECT l_suppkey % 5 AS lad, l_partkey % 7 AS road, avg(l_quantity) AS mph FROM lineitem WHERE l_suppkey % 5 < 2 GROUP BY ALL HAVING avg(l_quantity) > 3),
l AS (SELECT l_orderkey, l_linenumber, ['E0', 'E1', 'S2', 'W3', 'X4'][l_suppkey % 5 + 1] AS lad, l_suppkey % 5 AS li, l_partkey % 7 AS road, CAST(floor(l_extendedprice) AS BIGINT) AS len, l_linenumber % 4 AS score FROM lineitem),
c AS (SELECT * FROM (VALUES ('E', 30, 45, 0.9), ('S', 28, 44, 0.93), ('W', 29, 43, 0.95)) t(country, u, r, k)),
m AS (SELECT l.*, sp.mph, CAST(u AS DOUBLE) AS u, CAST(r AS DOUBLE) AS r, CAST(k AS DOUBLE) AS k FROM l LEFT JOIN sp ON sp.lad = li AND sp.road = l.road LEFT JOIN c ON country = left(l.lad, 1))
SELECT CASE WHEN k IS NOT NULL AND mph IS NOT NULL THEN 'road' WHEN k IS NOT NULL THEN 'country' ELSE 'class' END AS level, count(*) AS n,
 CAST(sum(CASE WHEN k IS NOT NULL AND mph IS NOT NULL THEN greatest(1, least(65534, round_even(len / (mph * CAST(0.44704 AS DOUBLE)), 0))) WHEN k IS NOT NULL THEN greatest(1, least(65534, round_even(len / CAST(0.44704 AS DOUBLE) * ((score / CAST(3 AS DOUBLE)) / u + (1 - score / CAST(3 AS DOUBLE)) / r), 0))) ELSE 77 END) AS BIGINT) AS weekend FROM m GROUP BY 1"""
)
def three_level_fallback(s, d):
    li = read(s, d, "lineitem")
    lad = F.element_at(F.array(*(F.lit(x) for x in ("E0", "E1", "S2", "W3", "X4"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    road = (F.col("l_partkey") % 7).cast("string")
    speeds = li.filter("l_suppkey % 5 < 2").groupBy(lad.alias("lad"), road.alias("road")).agg(F.avg("l_quantity").alias("mph")).filter("mph > 3")
    links = li.select(F.struct("l_orderkey", "l_linenumber").alias("edge_id"), lad.alias("lad"), road.alias("road"), F.floor("l_extendedprice").alias("length_m"), (F.col("l_linenumber") % 4).alias("score"), F.lit(0).alias("flags"), F.lit(77).alias("base_cost"))
    contexts = s.sql("SELECT country, CAST(u AS DOUBLE) urban_mph, CAST(r AS DOUBLE) rural_mph, CAST(k AS DOUBLE) peak_ratio FROM VALUES ('E', 30, 45, 0.9), ('S', 28, 44, 0.93), ('W', 29, 43, 0.95) AS t(country, u, r, k)")
    return network.local_costs(links, speeds, contexts).groupBy("level").agg(F.count("*").alias("n"), F.sum("weekend").cast("long").alias("weekend"))


@query("WITH o AS (SELECT l_orderkey AS edge_id, CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'A') AS BIGINT) AS s, count(*) FILTER (l_returnflag = 'A') AS n FROM lineitem GROUP BY l_orderkey) SELECT edge_id, CASE WHEN n > 0 THEN (s + n // 2) // n ELSE 11 END AS cost FROM o")
def observed_mean_half_up(s, d):
    li = read(s, d, "lineitem")
    base = li.select(F.col("l_orderkey").alias("edge_id")).distinct().withColumn("cost", F.lit(11))
    return network.observed_mean(base, li.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("edge_id"), F.col("l_quantity").cast("long").alias("cost")))


@query("SELECT p_brand AS value, dense_rank() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY p_brand")
def first_seen_codes(s, d):
    return network.first_seen_codes(read(s, d, "part").withColumnRenamed("p_brand", "value"), "value", "p_partkey").withColumn("code", F.col("code").cast("long"))


# ---- evaluation ----

ERRORS = "r AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity - 25 AS error_min, l_discount * 100 AS distance_error_pct FROM lineitem)"


def errors(s, d):
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", (F.col("l_quantity") - 25).alias("error_min"), (F.col("l_discount") * 100).alias("distance_error_pct"))


@query(
    f"""WITH {ERRORS} SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS grouping, count(*) AS n, avg(error_min) AS bias, avg(abs(error_min)) AS mae, median(abs(error_min)) AS median_ae,
quantile_cont(abs(error_min), CAST(0.9 AS DOUBLE)) AS p90, quantile_cont(abs(error_min), CAST(0.95 AS DOUBLE)) AS p95, count(*) FILTER (abs(error_min) <= 10) AS within_10, count(*) FILTER (abs(error_min) <= 15) AS within_15, round(avg(distance_error_pct), 6) AS distance_mape
FROM r GROUP BY GROUPING SETS ((), (l_returnflag), (l_returnflag, l_linestatus))"""
)
def error_metrics_grouping_sets(s, d):
    out = evaluation.error_metrics(errors(s, d), ["l_returnflag", "l_linestatus"], [[], ["l_returnflag"], ["l_returnflag", "l_linestatus"]])
    return out.withColumn("distance_mape", F.round("distance_mape", 6))


@query(f"WITH {ERRORS}, k AS (SELECT l_returnflag, l_orderkey, l_linenumber, error_min, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(error_min) DESC, l_orderkey, l_linenumber) AS k FROM r) SELECT l_returnflag, l_orderkey, l_linenumber, error_min FROM k WHERE k <= 8")
def worst_errors_topk(s, d):
    return evaluation.worst(errors(s, d).select("l_returnflag", "l_orderkey", "l_linenumber", "error_min"), 8, "l_orderkey", "l_linenumber", by="l_returnflag")


@query(
    """WITH m AS (SELECT CASE WHEN trim(l_returnflag) <> 'N' THEN l_returnflag ELSE 'model' END AS variant, l_orderkey AS origin, l_linenumber AS destination, l_quantity AS minutes, l_extendedprice / 1000 AS miles FROM lineitem),
r AS (SELECT l_orderkey AS origin, l_linenumber % 4 AS destination, l_quantity + l_discount * 100 AS g, nullif(l_extendedprice / 1000 + l_tax, 0) AS gm, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 4 ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS k FROM lineitem WHERE l_linestatus = 'O' OR l_tax > 0)
SELECT variant, count(*) AS n, sum(round((minutes - g) * 100)) AS error_sum, round(avg(abs(miles - gm) / gm * 100), 6) AS distance_error FROM m JOIN (SELECT * FROM r WHERE k = 1) r USING (origin, destination) GROUP BY variant"""
)
def model_vs_reference(s, d):
    """Line items as modelled routes, and the last of those that share a destination as its reference."""
    li = read(s, d, "lineitem")
    model = li.select(F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.col("l_returnflag")).alias("variant"), F.col("l_orderkey").alias("origin"), F.col("l_linenumber").cast("long").alias("destination"), F.col("l_quantity").alias("minutes"), (F.col("l_extendedprice") / 1000).alias("distance_miles"))
    known = li.filter("l_linestatus = 'O' or l_tax > 0")
    reference = known.select(F.col("l_orderkey").alias("origin"), (F.col("l_linenumber") % 4).cast("long").alias("destination"), (F.col("l_quantity") + F.col("l_discount") * 100).alias("google_minutes"), F.nullif(F.col("l_extendedprice") / 1000 + F.col("l_tax"), F.lit(0.0)).alias("google_miles"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax").alias("line"))
    return evaluation.compare(model, reference).groupBy("variant").agg(F.count("*").alias("n"), F.sum(F.round(F.col("error_min") * 100)).alias("error_sum"), F.round(F.avg("distance_error_pct"), 6).alias("distance_error"))


@query("SELECT l_returnflag, count(l_quantity) AS n, sum(l_quantity) AS total, median(l_quantity) AS median, quantile_cont(l_quantity, CAST(0.95 AS DOUBLE)) AS p95, quantile_cont(l_quantity, CAST(0.99 AS DOUBLE)) AS p99, max(l_quantity) AS max FROM lineitem GROUP BY l_returnflag")
def snap_statistics(s, d):
    return evaluation.spread(read(s, d, "lineitem"), "l_quantity", "l_returnflag")


@query("SELECT r_name AS origin, t AS target FROM region, (VALUES ('York'), ('Cambridge')) v(t)")
def cross_targets(s, d):
    return network.cross_targets(read(s, d, "region").select(F.col("r_name").alias("origin")), s.sql("SELECT * FROM VALUES ('York'), ('Cambridge') AS t(target)"))


# ---- bundles and checks ----


@query("SELECT 'orders without a customer' AS check_id, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) UNION ALL SELECT 'repeated orders', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def referential_checks(s, d):
    o, c = read(s, d, "orders"), read(s, d, "customer").filter("c_custkey % 7 <> 0")
    return checks.combine(checks.violations(bundle.dangling(o, "o_custkey", c, "c_custkey"), "orders without a customer"), checks.violations(bundle.repeated_ids(o, "o_orderkey"), "repeated orders"))


@query("SELECT n_nationkey, 2 AS definitions FROM nation WHERE n_nationkey % 4 = 0")
def conflicting_definitions(s, d):
    n = read(s, d, "nation").select("n_nationkey", "n_name")
    other = n.withColumn("n_name", F.when(F.col("n_nationkey") % 4 == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    return bundle.conflicts(bundle.union_all(n, other), "n_nationkey")


@query("WITH c AS (SELECT p_brand AS category, min(p_size) AS category_order FROM part WHERE p_size < 3 GROUP BY p_brand) SELECT p_brand AS category, p_partkey AS metric_id, coalesce(category_order, 999) AS category_order, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS place FROM part LEFT JOIN c ON p_brand = category")
def category_ordering(s, d):
    p = read(s, d, "part")
    c = p.filter("p_size < 3").groupBy(F.col("p_brand").alias("category")).agg(F.min("p_size").alias("category_order"))
    m = p.select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("metric_id"), F.col("p_size").alias("ordinal"))
    return bundle.metric_order(m, c).withColumn("place", F.col("place").cast("long"))


@query("SELECT p_brand AS category, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_size, p_partkey) AS metrics FROM part GROUP BY p_brand")
def category_groups(s, d):
    p = read(s, d, "part").select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("metric_id"), F.col("p_size").alias("ordinal"))
    g = bundle.category_groups(p, p.select("category").distinct())
    return g.select("category", F.concat_ws(",", F.transform("metrics", lambda x: x.cast("string"))).alias("metrics"))


@query("SELECT DISTINCT event_type AS class, 'unknown' AS problem FROM events WHERE event_type NOT IN ('click', 'fly') UNION ALL SELECT v, 'missing' FROM (VALUES ('click'), ('fly')) t(v) WHERE v NOT IN (SELECT event_type FROM events)")
def set_class_check(s, d):
    return bundle.class_check(read(s, d, "events"), "event_type", ["click", "fly"])


@query("SELECT c_mktsegment AS source, count(*) AS files, sum(c_custkey) AS bytes FROM customer WHERE c_custkey % 3 <> 0 GROUP BY c_mktsegment")
def pending_files(s, d):
    c = read(s, d, "customer").select(F.col("c_mktsegment").alias("source"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("size"), F.col("c_custkey").alias("expected_size"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("expected_hash"))
    return bundle.pending_files(c)


@query("SELECT bool_or(p_size > 49) AS preview_partial_sources FROM part")
def any_partial(s, d):
    return bundle.any_partial(read(s, d, "part").select((F.col("p_size") > 49).alias("partial")))


@query("SELECT c_custkey AS position, CASE WHEN c_acctbal > 90 THEN 'lat' WHEN c_acctbal < -90 THEN 'lat' END AS problem FROM customer WHERE (c_acctbal > 90 OR c_acctbal < -90)")
def locations_validate(s, d):
    from ..operators import locations

    rows = read(s, d, "customer").select(F.col("c_custkey").alias("position"), F.col("c_name").alias("name"), F.lit("").alias("notes"), F.col("c_acctbal").cast("string").alias("lat"), F.lit("0").alias("lon"))
    return locations.problems(rows)


@query("WITH r AS (SELECT c_custkey AS position, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'id-' || c_nationkey END AS id FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS k FROM r) SELECT position, CASE WHEN id <> '' AND k = 1 THEN id ELSE 'location-' || position END AS id, NOT (id <> '' AND k = 1) AS generated FROM k")
def locations_ids(s, d):
    from ..operators import locations

    rows = read(s, d, "customer").select(F.col("c_custkey").alias("position"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("id-"), F.col("c_nationkey").cast("string"))).alias("id"))
    return locations.settle_ids(rows)


@query("SELECT r_name AS name, CASE r_regionkey WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE r_regionkey END AS position FROM region")
def reorder(s, d):
    from ..operators import locations

    return locations.move(read(s, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("position")), 2, -1)


@query("SELECT p_partkey FROM part WHERE NOT (p_size < p_retailprice / 40 AND round_even((p_size - 1) / CAST(0.5 AS DOUBLE), 0) >= 0 AND round_even((p_retailprice / 40 - 1) / CAST(0.5 AS DOUBLE), 0) < 65535 AND round_even((p_size - 1) / CAST(0.5 AS DOUBLE), 0) < round_even((p_retailprice / 40 - 1) / CAST(0.5 AS DOUBLE), 0))")
def bad_display_ranges(s, d):
    bad = checks.bad_display_range(F.col("p_size").cast("double"), F.col("p_retailprice") / 40, F.lit(0.5), F.lit(1.0))
    return read(s, d, "part").filter(bad).select("p_partkey")


@query(f"WITH {ORDERS}, ym AS (SELECT DISTINCT year(day) AS y, month(day) AS month FROM cube), own AS (SELECT DISTINCT cell, year(day) AS y, month(day) AS month FROM cube) SELECT c.cell, ym.y, ym.month FROM (SELECT DISTINCT cell FROM cube) c, ym WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.cell = c.cell AND own.y = ym.y AND own.month = ym.month)")
def absent_months(s, d):
    cube = orders_cube(s, d)
    return temporal.absent_months(cube, cube.select("cell"))


@query(f"WITH {EVENTS}, first AS (SELECT min(day) AS day FROM cube) SELECT DISTINCT cell FROM cube JOIN first USING (day) WHERE value IS NOT NULL")
def land_mask(s, d):
    return temporal.land_mask(events_cube(s, d))


@query("SELECT count(*) AS matched_edges, CAST(sum(p_size) AS DOUBLE) / 1000 AS matched_length_km, median(p_retailprice) AS median_match_distance_m, quantile_cont(p_retailprice, CAST(0.95 AS DOUBLE)) AS p95_match_distance_m, (SELECT count(*) FROM supplier) AS trunk_edges, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT CAST(p_size % 4 AS VARCHAR) AS k, count(*) AS n FROM part GROUP BY 1)) AS candidates FROM part")
def match_statistics(s, d):
    matched = read(s, d, "part").select(F.col("p_partkey").alias("edge_id"), F.col("p_size").alias("length_m"), F.col("p_retailprice").alias("distance"), (F.col("p_size") % 4).cast("long").alias("candidates"))
    out = evaluation.match_statistics(matched, read(s, d, "supplier"))
    held = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("candidate_speed_count")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return out.withColumn("candidates", held).drop("candidate_speed_count")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IS NULL OR n_regionkey = 2 OR n_nationkey % 7 = 0")
def pruning_notes(s, d):
    notes = read(s, d, "nation").withColumn("source_id", F.when(F.col("n_nationkey") % 7 != 0, F.col("n_regionkey").cast("string")))
    return bundle.pruning_notes(notes, "2").select("n_nationkey", "n_name")


@query("SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0)")
def stale_files(s, d):
    wanted = read(s, d, "orders").filter("o_custkey % 3 = 0").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("name"))
    return bundle.stale_files(read(s, d, "customer").select(F.col("c_name").alias("name")), wanted)


@query("SELECT p_brand AS category_id, p_partkey AS id, row_number() OVER (ORDER BY place, p_brand, p_size, p_partkey) AS k FROM part JOIN (SELECT p_brand, CAST(substr(p_brand, 7) AS INTEGER) % 5 AS place FROM (SELECT DISTINCT p_brand FROM part)) USING (p_brand)")
def assembled_metrics(s, d):
    p = read(s, d, "part")
    metrics = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category_id"), F.lit("parts").alias("source_id"), F.col("p_size").alias("ordinal"))
    categories = p.select(F.col("p_brand").alias("id"), (F.substring("p_brand", 7, 9).cast("int") % 5).alias("ordinal"))
    out = bundle.assemble(metrics, categories, s.sql("SELECT 'parts' AS id"))
    return out.withColumn("k", F.row_number().over(Window.orderBy(F.substring("category_id", 7, 9).cast("int") % 5, "category_id", "ordinal", "id")).cast("long")).select("category_id", "id", "k")


# ---- streams ----


@query(f"WITH {EVENTS}" + RUNS.format(t=60))
def streaming_run_state(s, d):
    from ..streaming.runs import longest_runs_stream

    return longest_runs_stream(s, f"{d}/events.parquet", 60)


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def streaming_daily_counts(s, d):
    from ..streaming.runs import daily_counts_stream

    return daily_counts_stream(s, f"{d}/events.parquet")


# ---- polygons: the boxes as WKB ----


def box_polygons(s, d):
    from ..functions import polygons as g
    from ..operators import geometry

    def run(frames):
        for f in frames:
            yield f[["box"]].assign(geom=[g.write_wkb(g.box(*r)) for r in zip(f["minx"], f["miny"], f["maxx"], f["maxy"])])

    # a table of few bytes is read in one part, but its shapes are work for all cores
    dealt = boxes(s, d).repartition(4 * s.sparkContext.defaultParallelism)
    return geometry.admit(dealt.mapInPandas(run, "box long, geom binary"))


@query(f"WITH {AREA} SELECT box, cx, cy, round(area, 9) AS area FROM a WHERE area > CAST(1e-12 AS DOUBLE)")
def polygon_cell_areas(s, d):
    from ..operators import geometry

    return geometry.cut_by_cells(box_polygons(s, d), 0.5).filter("area > 1e-12").select("box", "cx", "cy", F.round("area", 9).alias("area"))


@query()
def polygon_union_areas(s, d):
    from ..operators import geometry

    return geometry.union_by_cell(geometry.cut_by_cells(box_polygons(s, d), 0.5), 0.5).select("cx", "cy", "fragments", F.round("area", 9).alias("area"))


@query(f"WITH {XY}, {BOXES} SELECT vec_id AS point_id, box AS area_id FROM xy JOIN b ON x > minx AND x < maxx AND y > miny AND y < maxy")
def points_in_polygons(s, d):
    from ..operators import geometry

    p = vectors_xy(s, d).withColumnRenamed("vec_id", "point_id")
    return geometry.points_in_polygons(p, box_polygons(s, d).withColumnRenamed("box", "area_id"), 0.5)


# ---- lookups and payloads ----


@query(f'WITH {XY}{CELLS}, {PART_RASTER}, k AS (SELECT vec_id, r % 40 AS r, c % 50 AS c FROM g) SELECT vec_id, l0.e AS encoded, CAST(l0.e AS DOUBLE) * CAST(0.5 AS DOUBLE) AS value FROM k JOIN l0 ON k.r = l0.r AND k.c = l0.c')
def cell_lookup(s, d):
    """The value of the cell that a point lies in, always at the finest level."""
    p = vectors_xy(s, d).select("vec_id", (geo.cell_row(F.col("y"), GRID) % 40).alias("row"), (geo.cell_column(F.col("x"), GRID) % 50).alias("col"))
    return p.join(part_raster(s, d), ["row", "col"]).select("vec_id", "encoded", encode.dequantise(F.col("encoded"), 0.5, 0.0).alias("value"))


@query("SELECT * FROM (VALUES ('days_tmax_gt_25', 'heat_days_tmax_gt_25'), ('summer_tmax_p99', 'heat_summer_tmax_p99'), ('other', 'other')) t(old, metric_id)")
def legacy_metric_ids(s, d):
    old = s.sql("SELECT * FROM VALUES ('days_tmax_gt_25'), ('summer_tmax_p99'), ('other') AS t(old)")
    return old.select("old", F.coalesce(F.element_at(text.literal_map(text.LEGACY_METRICS), F.col("old")), F.col("old")).alias("metric_id"))


@query("SELECT c_mktsegment AS category, string_agg(c_name, ',' ORDER BY lower(c_name), CAST(c_custkey AS VARCHAR)) AS names FROM customer GROUP BY c_mktsegment")
def area_payload(s, d):
    from ..sources.sinks import area_payload as payload

    c = read(s, d, "customer")
    areas = c.select(F.col("c_mktsegment").alias("category"), F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("ref"), F.lit("").alias("geometry"))
    return payload(areas).select("category", F.concat_ws(",", F.transform("areas", lambda a: a["name"])).alias("names"))


@query(f"WITH {PLACES}, c AS (SELECT * FROM (VALUES ('supermarket', 0), ('convenience', 1), ('post_office', 2), ('pharmacy', 3), ('gp', 4), ('dentist', 5), ('hospital_general', 6), ('hospital_community', 7)) t(category, place)) SELECT c.category, CAST(c.place AS INTEGER) AS place, count(pl.category) AS n FROM c LEFT JOIN pl USING (category) GROUP BY ALL")
def service_counts(s, d):
    from .services import counts

    return counts(places(s, d)).select("category", "place", F.col("n").cast("long").alias("n"))


@query()
def service_payload(s, d):
    from ..sources.sinks import service_payload as payload

    return payload(places(s, d))


@query(f"WITH {PART_RASTER}, g AS (SELECT unnest(range(0, (SELECT (max(r) + 1) * 50 FROM l0))) AS i), x AS (SELECT i, coalesce(e, 65535) AS e FROM g LEFT JOIN l0 ON r = i // 50 AND c = i % 50) SELECT 'm' AS metric, sha256(unhex(string_agg(printf('%02x%02x', e % 256, e // 256), '' ORDER BY i))) AS sha256, CAST(count(*) * 2 AS BIGINT) AS raw_bytes FROM x")
def metric_blobs(s, d):
    """The whole raster as a packed blob; hash and size are taken from what the blob unpacks to."""
    import gzip
    import hashlib

    from ..sources.sinks import pack

    cells = part_raster(s, d)
    height = cells.agg(F.max("row")).first()[0]
    levels = cells.select(F.lit("m").alias("metric"), F.lit(0).alias("level"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("encoded").cast("int").alias("encoded"))

    def unpacked(frames):
        for f in frames:
            raw = [gzip.decompress(bytes(b)) for b in f["blob"]]
            yield f[["metric"]].assign(sha256=[hashlib.sha256(r).hexdigest() for r in raw], raw_bytes=[len(r) for r in raw], same=[hashlib.sha256(r).hexdigest() == h for r, h in zip(raw, f["sha256"])])

    found = pack(levels, [(0, 50, 0 if height is None else int(height) + 1)]).mapInPandas(unpacked, "metric string, sha256 string, raw_bytes long, same boolean")
    return found.filter("same").select("metric", "sha256", "raw_bytes")


TRAVEL = f"""{EDGES}, nodes AS (SELECT DISTINCT src AS node, CAST(src % 97 AS DOUBLE) * 500 AS nx, CAST(src % 89 AS DOUBLE) * 500 AS ny FROM arcs),
start AS (SELECT node FROM nodes ORDER BY (nx - 10000) ** 2 + (ny - 10000) ** 2, node LIMIT 1),
p(node, distance) USING KEY (node) AS (SELECT CAST(node AS BIGINT), 0::BIGINT FROM start UNION (SELECT arcs.dst, min(p.distance + arcs.cost)::BIGINT FROM p JOIN arcs ON arcs.src = p.node LEFT JOIN recurring.p AS r ON r.node = arcs.dst WHERE r.distance IS NULL OR p.distance + arcs.cost < r.distance GROUP BY arcs.dst)),
{XY}, cells AS (SELECT vec_id AS cell, x * 10000 + 20000 AS x, y * 10000 + 20000 AS y FROM xy),
spots AS (SELECT nx, ny, min(node) AS node FROM nodes GROUP BY nx, ny),
snap AS (SELECT cell, arg_min(node, (sqrt((x - nx) ** 2 + (y - ny) ** 2), node)) AS node, min(sqrt((x - nx) ** 2 + (y - ny) ** 2)) AS d FROM cells, spots GROUP BY cell)"""


@query(f"WITH RECURSIVE {TRAVEL} SELECT cell, CASE WHEN d <= 20000 THEN CAST(distance AS DOUBLE) / 60 END AS minutes FROM snap LEFT JOIN p USING (node)")
def travel_minutes(s, d):
    """Minutes from all vectors' places to a target over a network of parts and suppliers laid out in the plane."""
    from .travel import travel_minutes as plan

    e = edges(s, d).withColumn("edge_id", F.struct("u", "v"))
    nodes = network.degrees(e).select(F.col("node").alias("node_id"), (F.col("node") % 97 * 500.0).alias("nx"), (F.col("node") % 89 * 500.0).alias("ny"))
    cells = vectors_xy(s, d).select(F.col("vec_id").alias("point_id"), (F.col("x") * 10000 + 20000).alias("x"), (F.col("y") * 10000 + 20000).alias("y"))
    return plan(e.select("edge_id", "u", "v"), e.select("edge_id", "cost"), nodes, cells, (10000.0, 10000.0))
