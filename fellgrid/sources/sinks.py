"""Writers: encoded pyramids, packed blobs, bucketed payloads and manifests."""

from __future__ import annotations

import gzip
import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import Grid
from ..operators.checks import bad_palette, missing_grid_keys
from ..operators.points import bucketed


def write_pyramid(levels: DataFrame, path: str) -> None:
    """(metric, level, row, col, encoded) as Parquet, a folder a metric and level."""
    levels.repartition("metric", "level").sortWithinPartitions("metric", "level", "row", "col").write.mode("overwrite").partitionBy("metric", "level").parquet(path)


def pack(levels: DataFrame, sizes: list[tuple[int, int, int]]) -> DataFrame:
    """(metric, blob, sha256, raw_bytes): each metric's levels as one gzip blob of little-endian 16-bit values, 65535 without data.

    ``sizes``: level, width, height.  A blob is one metric's whole pyramid, so its size is that of the grid, not of the table.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for level, width, height in sizes:
            rows = group[group["level"] == level]
            full = np.full((height, width), 65535, "<u2")
            full[rows["row"], rows["col"]] = rows["encoded"]
            parts.append(full.tobytes())
        raw = b"".join(parts)
        return pd.DataFrame({"metric": [group["metric"].iloc[0]], "blob": [gzip.compress(raw, 9, mtime=0)], "sha256": [hashlib.sha256(raw).hexdigest()], "raw_bytes": [len(raw)]})

    return levels.select("metric", "level", "row", "col", "encoded").groupBy("metric").applyInPandas(run, "metric string, blob binary, sha256 string, raw_bytes long")


def service_payload(pois: DataFrame) -> DataFrame:
    """(bucket, json): each bucket's categories with their places, in key order when written sorted."""
    groups = bucketed(pois).groupBy("bucket").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "places")))).alias("categories"))
    return groups.select("bucket", F.to_json("categories").alias("json"))


def write_lines(rows: DataFrame, path: str) -> None:
    """(json) as gzip text."""
    rows.select("json").write.mode("overwrite").option("compression", "gzip").text(path)


def area_payload(areas: DataFrame) -> DataFrame:
    """(category, areas): polygons of each category by lower-cased name, then reference."""
    item = F.struct(F.lower("name").alias("k"), "ref", F.struct("name", "ref", "geometry").alias("x"))
    return areas.filter("category is not null").groupBy("category").agg(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["x"]).alias("areas"))


def manifest(grid: Grid, metrics: list[dict], categories: list[dict], *, version: int = 3) -> str:
    """A dataset's description; an error for grids, palettes and references that don't hold."""
    described = {"crs": grid.crs, "width": grid.width, "height": grid.height, "cell_size_m": grid.cell_size_m, "west": grid.west, "south": grid.south, "east": grid.east, "north": grid.north}
    if missing_grid_keys(described):
        raise ValueError("incomplete grid")
    known = {c["id"] for c in categories}
    for m in metrics:
        if m["category"] not in known:
            raise ValueError(f"metric {m['id']} has no category")
        if m.get("palette") and bad_palette(m["palette"]):
            raise ValueError(f"metric {m['id']} has a bad palette")
    if len({m["id"] for m in metrics}) != len(metrics):
        raise ValueError("repeated metric ids")
    return json.dumps({"format_version": version, "grid": described, "categories": categories, "metrics": metrics}, ensure_ascii=False, sort_keys=True)


def load_manifest(spark: SparkSession, path: str, version: int = 3) -> dict:
    """A description read through Spark, wherever it lies; an error for other versions."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    out = json.loads(text)
    if out.get("format_version") != version:
        raise ValueError(f"format version {out.get('format_version')}; expected {version}")
    return out


def verify_blobs(blobs: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, problem) of blobs whose size or hash isn't the expected (name, size, sha256) one, or that are missing."""
    seen = blobs.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.length("content").alias("n"), F.sha2("content", 256).alias("h"))
    met = expected.join(seen, "name", "left")
    problem = F.when(F.col("path").isNull(), "missing").when(F.col("n") != F.col("size"), "size").when(F.col("h") != F.col("sha256"), "hash")
    return met.select(F.coalesce("path", "name").alias("path"), problem.alias("problem")).filter("problem is not null")


def publish(spark: SparkSession, folder: str, expected: DataFrame, target: str) -> DataFrame:
    """Copy a bundle's files (name, size, sha256) to ``target`` once all are sound, and delete what else lies there; returns (name) of those deleted.

    Files are copied by the file system's own copy on the driver, one for each name in the manifest.
    """
    from ..operators.bundle import stale_files
    from ..operators.checks import bare_name, require, violations

    blobs = spark.read.format("binaryFile").load(folder)
    require(violations(expected, "names with folders", ~bare_name(F.col("name"))), violations(verify_blobs(blobs, expected), "blobs that are missing or altered"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    system = at(target).getFileSystem(conf)
    system.mkdirs(at(target))
    for name in [r["name"] for r in expected.select("name").distinct().collect()]:  # a manifest's files
        jvm.org.apache.hadoop.fs.FileUtil.copy(at(folder).getFileSystem(conf), at(folder, name), system, at(target, name), False, True, conf)
    there = spark.createDataFrame([(s.getPath().getName(),) for s in system.listStatus(at(target))], "name string")
    gone = [r["name"] for r in stale_files(there, expected).collect()]
    for name in gone:
        system.delete(at(target, name), False)
    return spark.createDataFrame([(n,) for n in gone], "name string")
