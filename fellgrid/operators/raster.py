"""Rasters in long form: (row, col, value or encoded), absent or null for no data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.encode import quantise
from ..functions.geo import Grid, from_national_grid, to_national_grid
from ..functions.rounding import parent_half_up


def all_periods_mean(values: DataFrame, periods: int) -> DataFrame:
    """(cell, mean) of cells that have a finite value in every one of ``periods`` periods."""
    good = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    return values.groupBy("cell").agg(F.avg(good).alias("mean"), F.count(good).alias("n")).filter(F.col("n") == periods).select("cell", "mean")


def block_relief(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys..., relief): largest less smallest finite value of each block; null where a block has none."""
    good = F.when(~F.isnan("value"), F.col("value"))
    return pixels.groupBy(*keys).agg((F.max(good) - F.min(good)).alias("relief"))


def parent_level(level: DataFrame) -> DataFrame:
    """The next coarser level of (level, row, col, encoded): 2 x 2 means, ties up, no data ignored."""
    up = level.filter("encoded is not null").groupBy((F.col("level") + 1).cast("int").alias("level"), F.floor(F.col("row") / 2).cast("long").alias("row"), F.floor(F.col("col") / 2).cast("long").alias("col"))
    return up.agg(parent_half_up(F.sum("encoded"), F.count("*")).cast("long").alias("encoded"))


def pyramid(base: DataFrame, width: int, height: int) -> DataFrame:
    """All levels down to one cell of (row, col, encoded): means of means, level by level.

    Each level has a quarter of the rows of the one before, so all together cost a third more than the base.
    """
    level = base.select(F.lit(0).cast("int").alias("level"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("encoded").cast("long").alias("encoded"))
    out = level
    while width > 1 or height > 1:
        width, height = (width + 1) // 2, (height + 1) // 2
        level = parent_level(level)
        out = out.unionByName(level)
    return out


def level_sizes(spark: SparkSession, grid: Grid) -> DataFrame:
    """(level, width, height, cell_size_m, value_offset, value_count) of a grid's pyramid."""
    rows, width, height, level, at = [], grid.width, grid.height, 0, 0
    while True:
        rows.append((level, width, height, float(grid.cell_size_m * 2**level), at, width * height))
        at += width * height
        if width == height == 1:
            break
        width, height, level = (width + 1) // 2, (height + 1) // 2, level + 1
    return spark.createDataFrame(rows, "level int, width long, height long, cell_size_m double, value_offset long, value_count long")


def choose_level(zooms: DataFrame, levels: DataFrame, base_pixels: float, least: float = 4.0) -> DataFrame:
    """(zoom, level): the first level whose cells have ``least`` pixels at a zoom, else the last level."""
    wide = zooms.crossJoin(F.broadcast(levels.select("level")))  # a dozen levels
    big = F.lit(float(base_pixels)) * F.pow(F.lit(2.0), F.col("zoom")) * F.pow(F.lit(2.0), F.col("level")) >= F.lit(float(least))
    return wide.groupBy("zoom").agg(F.coalesce(F.min(F.when(big, F.col("level"))), F.max("level")).alias("level"))


def window_cells(cells: DataFrame, row_min: int, row_max: int, col_min: int, col_max: int) -> DataFrame:
    """Cells of a viewport, bounds included; a range filter that reaches the scan."""
    return cells.filter(F.col("row").between(row_min, row_max) & F.col("col").between(col_min, col_max) & F.col("encoded").isNotNull())


def encode_metric(values: DataFrame, scale: float, offset: float) -> DataFrame:
    """(row, col, encoded) without the cells that have no data."""
    return values.select("row", "col", quantise(F.col("value"), scale, offset).alias("encoded")).filter("encoded is not null")


def encoded_summary(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys..., encoded_min, encoded_max, valid_count)."""
    return cells.groupBy(*keys).agg(F.min("encoded").alias("encoded_min"), F.max("encoded").alias("encoded_max"), F.count("encoded").alias("valid_count"))


def axis_step(axis: DataFrame, column: str) -> DataFrame:
    """One row (step, regular): the median distance of an axis' different coordinates, and whether all equal it."""
    order = Window.orderBy(column)
    gaps = axis.select(column).distinct().select((F.col(column) - F.lag(column).over(order)).alias("gap")).filter("gap is not null and gap <> 0")
    return gaps.agg(F.median("gap").alias("step"), (F.max("gap") - F.min("gap") <= 1e-6 * F.median("gap")).alias("regular"))


def corner_index(level_step: int, width: int, height: int, row_edge: Column, col_edge: Column) -> Column:
    """Index of a level's corner among the base grid's corners."""
    row, col = F.least(F.lit(height), row_edge * level_step), F.least(F.lit(width), col_edge * level_step)
    return (row * (width + 1) + col).cast("long")


def view_windows(views: DataFrame, envelope: dict[str, float], level: dict, grid: Grid, margin: int = 1) -> DataFrame:
    """(view_id, row_min, row_max, col_min, col_max) of views (view_id, south, north, west, east) in degrees, clamped to a level's cells.

    A view is cut to the grid's ``envelope``; eight places on its edge are projected, and their bounds widened by ``margin`` cells.
    ``level``: width, height, cell_size_m.  Views beyond the envelope or the level have no row.
    """
    lit = lambda k: F.lit(float(envelope[k]))
    cut = views.select("view_id", F.greatest("south", lit("south")).alias("s"), F.least("north", lit("north")).alias("n"), F.greatest("west", lit("west")).alias("w"), F.least("east", lit("east")).alias("e")).filter("s <= n and w <= e")
    half = lambda a, b: (F.col(a) + F.col(b)) / 2
    lats, lons = [F.col("s"), half("s", "n"), F.col("n")], [F.col("w"), half("w", "e"), F.col("e")]
    places = F.array(*(to_national_grid(lat, lon) for i, lat in enumerate(lats) for j, lon in enumerate(lons) if (i, j) != (1, 1)))
    size = float(level["cell_size_m"])
    xs, ys = F.transform("p", lambda p: p["easting"]), F.transform("p", lambda p: p["northing"])
    at = lambda v, base: F.floor((v - float(base)) / size).cast("long")
    raw = cut.withColumn("p", places).select("view_id", at(F.array_min(ys), grid.south).alias("r0"), at(F.array_max(ys), grid.south).alias("r1"), at(F.array_min(xs), grid.west).alias("c0"), at(F.array_max(xs), grid.west).alias("c1"))
    seen = raw.filter((F.col("c1") >= 0) & (F.col("r1") >= 0) & (F.col("c0") < level["width"]) & (F.col("r0") < level["height"]))
    low, high = lambda c: F.greatest(F.lit(0), F.col(c) - margin), lambda c, n: F.least(F.lit(n - 1), F.col(c) + margin)
    return seen.select("view_id", low("r0").alias("row_min"), high("r1", level["height"]).alias("row_max"), low("c0").alias("col_min"), high("c1", level["width"]).alias("col_max"))


def grid_corners(spark: SparkSession, grid: Grid) -> DataFrame:
    """(corner, lat, lon): south-west, south-east, north-east and north-west in degrees, to seven places."""
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(((grid.west, grid.south), (grid.east, grid.south), (grid.east, grid.north), (grid.west, grid.north)))]
    places = spark.createDataFrame(rows, "corner int, x double, y double").withColumn("p", from_national_grid(F.col("x"), F.col("y")))
    return places.select("corner", F.round("p.lat", 7).alias("lat"), F.round("p.lon", 7).alias("lon"))


def grid_of_axes(x: DataFrame, y: DataFrame, column: str = "value") -> Grid:
    """The grid whose cells' centres are the coordinates of two axes; an error unless both rise in the same equal steps."""
    ends = [(axis_step(a, column).first(), a.agg(F.min(column).alias("a"), F.countDistinct(column).alias("n")).first()) for a in (x, y)]
    (sx, ex), (sy, ey) = ends
    if not (sx["regular"] and sy["regular"]) or abs(sx["step"] - sy["step"]) > 1e-6 * sx["step"]:
        raise ValueError("the axes are no regular grid")
    step = float(sx["step"])
    return Grid(width=int(ex["n"]), height=int(ey["n"]), cell_size_m=step, west=float(ex["a"]) - step / 2, south=float(ey["a"]) - step / 2)
