"""Concentrations, relief and woodland cover as metrics by grid cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Grid, cell_column, cell_id, cell_row
from ..operators import checks, geometry, raster

#: Woodland classes that count, and all that may occur.
ESTABLISHED = ["Broadleaved", "Conifer", "Coppice", "Coppice with standards", "Mixed mainly broadleaved", "Mixed mainly conifer"]
EXCLUDED = ["Assumed woodland", "Failed", "Felled", "Ground prep", "Low density", "Shrub", "Windblow", "Young trees"]
ANCIENT_WALES = ["Ancient Semi Natural Woodland", "Restored Ancient Woodland Site", "Plantation on Ancient Woodland Site", "Ancient Woodland Site of Unknown Category"]
DELETED_WALES = ["Plantation on Ancient Woodland Site Deleted", "Ancient Semi Natural Woodland Deleted"]
ANCIENT_SCOTLAND = ["1a", "2a"]
ANCIENT_ENGLAND_REVISED = ["ASNW", "ARW", "AWPP", "IAWPP"]
ANCIENT_ENGLAND_LEGACY = ["ASNW", "PAWS", "AWP"]


def concentration(years: DataFrame, mask: DataFrame, n_years: int) -> DataFrame:
    """(cell, mean) over years (cell, year, value) of the mask's cells that have every year."""
    return raster.all_periods_mean(years.join(mask, "cell", "left_semi"), n_years)


def relief(pixels: DataFrame, grid: Grid, mask: DataFrame | None = None) -> DataFrame:
    """(cell, relief) of posts (easting, northing, value)."""
    cell = cell_id(cell_row(F.col("northing"), grid), cell_column(F.col("easting"), grid), grid)
    out = raster.block_relief(pixels.select(cell.alias("cell"), "value"), "cell").filter("relief is not null")
    return out if mask is None else out.join(mask, "cell", "left_semi")


def established_woodland(features: DataFrame) -> DataFrame:
    """Features (CATEGORY, IFT_IOA, geom) of the classes that count."""
    return features.filter((F.col("CATEGORY") == "Woodland") & F.col("IFT_IOA").isin(*ESTABLISHED))


def unknown_classes(features: DataFrame) -> DataFrame:
    """Woodland classes that are neither counted nor excluded; there should be none."""
    return features.filter("CATEGORY = 'Woodland'").select("IFT_IOA").distinct().filter(~F.col("IFT_IOA").isin(*ESTABLISHED, *EXCLUDED))


def woodland_cover(features: DataFrame, size: float, mask: DataFrame | None = None) -> DataFrame:
    """(cx, cy, share) of cells, from polygons that don't overlap; an error where they cover more than a cell."""
    from ..operators.spatial import covered_share

    return covered_share(geometry.cut_by_cells(geometry.admit(features.select("geom")), size, mask), size * size)


def ancient_cover(features: DataFrame, size: float, mask: DataFrame | None = None) -> DataFrame:
    """(cx, cy, share) of cells, from polygons that may overlap."""
    parts = geometry.cut_by_cells(geometry.admit(features.select("geom")), size, mask)
    return geometry.union_by_cell(parts, size).select("cx", "cy", (F.col("area") / (size * size)).alias("share"))


def ancient_woodland(wales: DataFrame, scotland: DataFrame, england: DataFrame, older: DataFrame, districts: DataFrame, size: float) -> DataFrame:
    """(geom) of the ancient woodland of three countries.

    ``wales`` (category_name, geom) and ``scotland`` (ANTIQUITY_, geom) count by class; of ``england`` (status, x_coord, y_coord, geom) all
    classes count, and of the ``older`` inventory (status, geom, feature_id, bounds) what lies outside the districts
    (area_id, geom, bounds) that any feature of the newer one lies in.  Unknown classes, and newer features that no district takes in, are errors.
    """
    known = {"category_name": ANCIENT_WALES + DELETED_WALES, "status": ANCIENT_ENGLAND_REVISED}
    checks.require(
        checks.violations(wales, "unknown Welsh classes", ~F.col("category_name").isin(*known["category_name"])),
        checks.violations(england, "unknown English classes", ~F.col("status").isin(*known["status"])),
        checks.violations(older, "unknown older English classes", ~F.col("status").isin(*ANCIENT_ENGLAND_LEGACY)),
    )
    spots = england.select(F.xxhash64("x_coord", "y_coord").alias("point_id"), F.col("x_coord").cast("double").alias("x"), F.col("y_coord").cast("double").alias("y")).distinct()
    placed = geometry.assign_points(spots.filter("x is not null and y is not null"), districts, size)
    checks.require(checks.violations(unassigned(spots, placed), "features in no district"))
    done = districts.join(placed.select("area_id").distinct(), "area_id", "left_semi")
    rest = geometry.left_over(older, done, size)
    parts = [wales.filter(F.col("category_name").isin(*ANCIENT_WALES)), scotland.filter(F.col("ANTIQUITY_").isin(*ANCIENT_SCOTLAND)), england, rest]
    out = parts[0].select("geom")
    for p in parts[1:]:
        out = out.unionByName(p.select("geom"))
    return out


def unassigned(points: DataFrame, placed: DataFrame) -> DataFrame:
    """Points (point_id, ...) that no area has taken; there should be none."""
    return points.join(placed.select("point_id"), "point_id", "left_anti")
