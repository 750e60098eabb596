"""Points of interest: lookups, de-duplication, buckets and viewports."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import bucket_key
from ..functions.rounding import half_even
from ..functions.text import compact_upper, match_key
from ..shared import table

#: Categories in order, and the OSM tags that stand for them.
CATEGORIES = ["supermarket", "convenience", "post_office", "pharmacy", "gp", "dentist", "hospital_general", "hospital_community"]
CATEGORY_LABELS = ["Supermarkets", "Convenience / village shops", "Post offices", "Pharmacies", "GPs", "NHS dentists", "General hospitals", "Community hospitals"]
OSM_TAGS = [("shop", "supermarket"), ("shop", "convenience"), ("amenity", "post_office"), ("amenity", "pharmacy")]
UNNAMED = {"supermarket": "Unnamed supermarket", "convenience": "Unnamed convenience shop", "post_office": "Unnamed post office", "pharmacy": "Unnamed pharmacy"}
SOURCES = ["osm", "nhs-ods-gp", "nhs-ods-dental", "phs-gp", "phs-dental", "nhs-eric", "phs-hospital-codes", "os-code-point-open"]
HOSPITAL_TYPES = {"General acute hospital": "hospital_general", "Mixed service hospital": "hospital_general", "Community hospital (with inpatient beds)": "hospital_community"}
HOSPITAL_GROUPS = {"A1": "hospital_general", "A2": "hospital_general", "A3": "hospital_general", "J26": "hospital_community"}
DANGEROUS = ("danger_area", "range")
#: A kept place hides others of its name within so many metres; degrees of the cells that are searched around it.
SAME_PLACE_M, CELL_DEGREES = 25.0, 0.0005


def explode_categories(features: DataFrame, tags: list[tuple[str, str]] = OSM_TAGS) -> DataFrame:
    """A row for each category that a feature's tags stand for; features without one go."""
    marks = F.array(*(F.when(F.col(k) == v, F.lit(v)) for k, v in tags))
    return features.withColumn("category", F.explode(F.filter(marks, lambda x: x.isNotNull())))


def military_category(military, landuse):
    """dangerous before unspecified; null for other features."""
    return F.when(F.trim(military).isin(*DANGEROUS), "dangerous").when(landuse == "military", "unspecified")


def latest_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last by ``order``."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")


def geocode(records: DataFrame, postcodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with the postcode's columns, (category, missing) counts of those without a match).

    Only postcodes that records name are read on; the last of repeated ones wins (column ``line``).
    """
    wanted = records.withColumn("_pc", compact_upper(F.col("postcode")))
    known = postcodes.withColumn("_pc", compact_upper(F.col("postcode"))).drop("postcode")
    known = latest_by_key(known.join(wanted.select("_pc").distinct(), "_pc", "left_semi"), "_pc", "line").drop("line")
    found = wanted.join(known.withColumn("_found", F.lit(True)), "_pc", "left").withColumn("_hit", F.coalesce("_found", F.lit(False))).drop("_found")
    return found.filter("_hit").drop("_pc", "_hit"), found.filter("not _hit").groupBy("category").agg(F.count("*").alias("missing"))


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Rows with the columns of a table that has one row a key."""
    return rows.join(table, key, how)


def deduplicate(pois: DataFrame) -> DataFrame:
    """The places kept of (category, name, lat, lon, source_rank, source_ref), in order of rank, category, reference.

    A place goes if one that was kept before it, of its category and name key, stands within 25 m in one of the
    3 x 3 cells around it.  That depends on order, so each group runs in turn.  Groups are first split at gaps between
    cells, along latitude and longitude in turn, into clusters that can't affect one another; a frequent name is no large group then.
    Places without a name are known by their reference; those without a position are kept as they are.
    """
    key = F.coalesce(match_key(F.col("name"), F.col("source_ref")), F.concat(F.lit("ref:"), F.coalesce("source_ref", F.lit(""))))
    placeless = F.col("lat").isNull() | F.col("lon").isNull() | F.isnan("lat") | F.isnan("lon")
    lost = pois.filter(placeless)
    keyed = pois.filter(~placeless).withColumn("_key", F.concat_ws("\x1f", key, F.col("category").isNull().cast("string"))).withColumn("_y", F.floor(F.col("lat") / CELL_DEGREES)).withColumn("_x", F.floor(F.col("lon") / CELL_DEGREES))
    keyed = keyed.withColumn("_cat", F.coalesce("category", F.lit("")))
    # alone in its 3 x 3 block: kept as it is
    counted = keyed.groupBy("_cat", "_key", "_y", "_x").agg(F.count("*").alias("n"))
    around = counted.select("_cat", "_key", F.explode(F.sequence(F.col("_y") - 1, F.col("_y") + 1)).alias("_y"), "_x", "n").select("_cat", "_key", "_y", F.explode(F.sequence(F.col("_x") - 1, F.col("_x") + 1)).alias("_x"), "n")
    crowd = around.groupBy("_cat", "_key", "_y", "_x").agg(F.sum("n").alias("_n"))
    placed = keyed.join(crowd, ["_cat", "_key", "_y", "_x"])
    schema = pois.schema

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["source_rank", "category", "source_ref"], kind="stable")
        kept: dict[tuple[int, int], list[tuple[float, float]]] = {}
        out = []
        for i, (y, x, lat, lon) in enumerate(zip(group["_y"], group["_x"], group["lat"], group["lon"])):
            near = (p for dy in (-1, 0, 1) for dx in (-1, 0, 1) for p in kept.get((y + dy, x + dx), ()))
            if not any(math.hypot((lon - b) * 111320.0 * math.cos(math.radians((lat + a) / 2)), (lat - a) * 110540.0) <= SAME_PLACE_M for a, b in near):
                kept.setdefault((y, x), []).append((lat, lon))
                out.append(i)
        return group.iloc[out][schema.names]

    # clusters of cells far enough apart that no chain crosses: cut at gaps along one axis, each part along the other, and once more
    cells = table(placed.filter("_n > 1").select("_cat", "_key", "_y", "_x").distinct(), "cells")
    group = ["_cat", "_key"]
    for n, axis in enumerate(("_y", "_x", "_y")):
        order = Window.partitionBy(*group).orderBy(axis)
        lines = cells.select(*group, axis).distinct().withColumn("_new", F.coalesce((F.col(axis) - F.lag(axis).over(order) > 1).cast("int"), F.lit(1)))
        cells = table(cells.join(lines.withColumn(f"_s{n}", F.sum("_new").over(order)).drop("_new"), [*group, axis]), "cells")
        group = [*group, f"_s{n}"]
    crowded = placed.filter("_n > 1").join(cells, ["_cat", "_key", "_y", "_x"])
    return placed.filter("_n = 1").select(schema.names).unionByName(crowded.groupBy(*group).applyInPandas(keep, schema)).unionByName(lost)


def bucketed(pois: DataFrame, per_degree: int = 4) -> DataFrame:
    """(bucket, category, places): places of each bucket and category in order of position, category, reference."""
    place = F.struct("lat", "lon", "category", "source_ref", F.struct(F.concat_ws(":", "category", "source_id", "source_ref").alias("id"), half_even(F.col("lat") * 100000.0).alias("lat_e5"), half_even(F.col("lon") * 100000.0).alias("lon_e5"), "name", "source_id", "source_ref").alias("place"))
    return pois.groupBy(bucket_key(F.col("lat"), F.col("lon"), per_degree).alias("bucket"), "category").agg(F.transform(F.sort_array(F.collect_list(place)), lambda p: p["place"]).alias("places"))


def in_view(points: DataFrame, south: float, north: float, west: float, east: float, per_degree: int = 4) -> DataFrame:
    """Points of a viewport, bounds included; whole buckets are passed over first."""
    y, x = F.floor(F.col("lat") * per_degree), F.floor(F.col("lon") * per_degree)
    buckets = y.between(math.floor(south * per_degree), math.floor(north * per_degree)) & x.between(math.floor(west * per_degree), math.floor(east * per_degree))
    return points.filter(buckets & F.col("lat").between(south, north) & F.col("lon").between(west, east))


def capped(points: DataFrame, most: int = 200) -> DataFrame:
    """All points if there are at most ``most``, else none: a view with too many shows none."""
    seen = points.limit(most + 1).agg((F.count("*") <= most).alias("_fits"))  # one row
    return points.crossJoin(F.broadcast(seen)).filter("_fits").drop("_fits")


def marker_changes(shown: DataFrame, visible: DataFrame, key: str) -> DataFrame:
    """(key, change): markers to remove and to add."""
    gone = shown.select(key).join(visible.select(key), key, "left_anti").withColumn("change", F.lit("remove"))
    new = visible.select(key).join(shown.select(key), key, "left_anti").withColumn("change", F.lit("add"))
    return gone.unionByName(new)


def unmatched(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return rows.join(table, key, "left_anti")

