"""Integrity checks: each gives (check_id, violations); one call raises for all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a grid's description needs, and what two grids must share.
GRID_KEYS = ["crs", "width", "height", "cell_size_m", "west", "south", "east", "north", "row_order", "column_order"]


def violations(rows: DataFrame, check_id: str, bad: Column | str | None = None) -> DataFrame:
    """One row: the number of rows that break a rule (all rows if no rule is given)."""
    rows = rows if bad is None else rows.filter(bad)
    return rows.agg(F.count("*").alias("violations")).select(F.lit(check_id).alias("check_id"), "violations")


def combine(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(*checks: DataFrame) -> None:
    """Raise with all checks that have violations."""
    broken = combine(*checks).filter("violations > 0").collect()  # a row a check
    if broken:
        raise ValueError("; ".join(f"{r['check_id']}: {r['violations']}" for r in broken))


def grid_differences(left: dict, right: dict) -> list[str]:
    """Keys on which two grids differ."""
    return [k for k in GRID_KEYS if left.get(k) != right.get(k)]


def missing_grid_keys(grid: dict) -> list[str]:
    return [k for k in GRID_KEYS[:8] if grid.get(k) is None]


def bad_palette(palette: list[str]) -> bool:
    """Whether a palette has fewer than two stops or one that isn't #RRGGBB."""
    import re

    return len(palette) < 2 or not all(re.fullmatch(r"#[0-9a-fA-F]{6}", s) for s in palette)


def off_centre(cells: DataFrame, slack: float = 0.01) -> Column:
    """Whether a source point isn't its cell's centre (columns x, y, cx, cy)."""
    return (F.abs(F.col("x") - F.col("cx")) > slack) | (F.abs(F.col("y") - F.col("cy")) > slack)


def bare_name(name: Column) -> Column:
    """Whether a blob's file name is a name alone, without folders."""
    return (name != "") & ~name.rlike(r"[/\\]") & ~name.isin(".", "..")


def level_mismatches(levels: DataFrame) -> DataFrame:
    """Levels whose size isn't half (rounded up) of the one before, or whose values don't follow those before."""
    before = levels.select((F.col("level") + 1).alias("level"), F.col("width").alias("w"), F.col("height").alias("h"), (F.col("value_offset") + F.col("value_count")).alias("at"))
    return levels.join(before, "level").filter((F.col("width") != F.ceil(F.col("w") / 2)) | (F.col("height") != F.ceil(F.col("h") / 2)) | (F.col("value_offset") != F.col("at")))


def bad_display_range(low: Column, high: Column, scale: Column, offset: Column, nodata: int = 65535) -> Column:
    """Whether a display range is not finite, not rising, or doesn't fit the encoding (rounded half to even); none is fine."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    a, z = F.rint((low - offset) / scale), F.rint((high - offset) / scale)
    good = finite(low) & finite(high) & (low < high) & (a >= 0) & (z < nodata) & (a < z)
    return ~(F.coalesce(good, F.lit(False)) | (low.isNull() & high.isNull()))


def current_year_problems(highs: DataFrame, lows: DataFrame, year: int) -> DataFrame:
    """(problem) of two lists of months (year, month): none at all, months that only one has, months missing from January on."""
    of = lambda df, side: df.filter(F.col("year") == year).select("month").distinct().withColumn(side, F.lit(True))
    both = of(highs, "a").join(of(lows, "b"), "month", "full")
    seen = both.agg(F.count("a").alias("highs"), F.count("b").alias("lows"), F.count(F.when(F.col("a") & F.col("b"), 1)).alias("shared"), F.max("month").alias("latest"))
    found = F.array(
        F.when((F.col("highs") == 0) | (F.col("lows") == 0), F.lit("no months")),
        F.when((F.col("highs") > 0) & (F.col("lows") > 0) & ((F.col("highs") != F.col("shared")) | (F.col("lows") != F.col("shared"))), F.lit("months differ")),
        F.when((F.col("highs") > 0) & (F.col("highs") != F.col("latest")), F.lit("months have a gap")),
    )
    return seen.select(F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))


def tile_problems(tiles: DataFrame, grid, side: int = 10) -> DataFrame:
    """(tile, problem) of tiles (tile, west, south): origins off the grid's lines, tiles that reach beyond it, and two tiles at one place."""
    size = float(grid.cell_size_m)
    col, row = (F.col("west") - float(grid.west)) / size, (F.col("south") - float(grid.south)) / size
    off = (col != F.rint(col)) | (row != F.rint(row)) | (F.col("west") % size != 0) | (F.col("south") % size != 0)
    beyond = (col < 0) | (row < 0) | (col + side > grid.width) | (row + side > grid.height)
    placed = tiles.select("tile", F.when(off, "alignment").when(beyond, "bounds").alias("problem"), F.floor(col).alias("col"), F.floor(row).alias("row"))
    shared = placed.groupBy("col", "row").agg(F.count("*").alias("n")).filter("n > 1").select("col", "row")
    return placed.filter("problem is not null").select("tile", "problem").unionByName(placed.join(shared, ["col", "row"], "left_semi").select("tile", F.lit("overlap").alias("problem")))


def repeated_cells(cells: DataFrame) -> DataFrame:
    """(path, cell, n) of cells that a file holds more than once."""
    return cells.groupBy("path", "cell").agg(F.count("*").alias("n")).filter("n > 1")


def geometry_problems(levels: DataFrame, grid) -> DataFrame:
    """(metric, level, problem) of levels (metric, nodata, level, width, height, cell_size_m): other than the first metric's, or than the grid at level 0."""
    first = levels.agg(F.min("metric").alias("metric"))
    common = levels.join(F.broadcast(first), "metric", "left_semi").select("level", F.struct("nodata", "width", "height", "cell_size_m").alias("common"))
    met = levels.join(common, "level", "full")
    base = (F.col("level") == 0) & ((F.col("width") != grid.width) | (F.col("height") != grid.height) | (F.col("cell_size_m") != float(grid.cell_size_m)))
    problem = F.when(F.col("common").isNull() | ~F.struct("nodata", "width", "height", "cell_size_m").eqNullSafe(F.col("common")), "geometry").when(base, "grid")
    counts = levels.groupBy("metric").agg(F.count("*").alias("n")).crossJoin(F.broadcast(common.agg(F.count("*").alias("all"))))  # one row
    lacking = counts.filter(F.col("n") != F.col("all")).select("metric", F.lit(None).cast("int").alias("level"), F.lit("levels").alias("problem"))
    return met.filter("metric is not null").select("metric", F.col("level").cast("int").alias("level"), problem.alias("problem")).filter("problem is not null").unionByName(lacking)


def count_mismatch(rows: DataFrame, expected: int, check_id: str) -> DataFrame:
    """One row (check_id, violations): by how much the number of rows differs from the expected one."""
    return rows.agg(F.abs(F.count("*") - F.lit(expected)).alias("violations")).select(F.lit(check_id).alias("check_id"), "violations")
