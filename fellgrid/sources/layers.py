"""Vector layers: GeoPackage tables and polygon shapefiles, as they are or in zip archives, as rows with WKB."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions import polygons as g
from .files import dbf_rows, parse_files

#: Sizes of a GeoPackage blob's envelope by its kind.
ENVELOPE_BYTES = (0, 32, 48, 48, 64)


def members(data: bytes, suffix: str, name: str | None = None) -> list[tuple[str, bytes]]:
    """(name, bytes) of an archive's files with a suffix, those called ``name`` alone if given; a file that is no archive stands for itself."""
    if not zipfile.is_zipfile(io.BytesIO(data)):
        return [("", data)]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        held = [x for x in z.namelist() if x.lower().endswith(suffix) and (name is None or x.rsplit("/", 1)[-1] == name)]
        return [(x, z.read(x)) for x in held]


def geopackage_wkb(blob: bytes | None) -> bytes | None:
    """The WKB inside a GeoPackage geometry; null for none or an empty one."""
    if not blob:
        return None
    if blob[:2] != b"GP":
        raise ValueError("no GeoPackage geometry")
    flags = blob[3]
    return None if flags >> 4 & 1 else blob[8 + ENVELOPE_BYTES[flags >> 1 & 7] :]


def geopackage_rows(data: bytes, layer: str, wanted: list[str], crs: int | None = None) -> Iterator[tuple]:
    """(wanted columns as text, WKB) of a layer; an error if it isn't there, lacks a column or has another reference system than ``crs``."""
    with sqlite3.connect(":memory:") as db:
        db.deserialize(data)
        found = db.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
        if found is None:
            raise ValueError(f"no layer {layer!r}")
        if crs is not None and found[1] != crs:
            raise ValueError(f"layer {layer!r} is in system {found[1]}")
        there = {r[1] for r in db.execute(f'PRAGMA table_info("{layer}")')}
        if lacking := set(wanted) - there:
            raise ValueError(f"layer {layer!r} lacks {sorted(lacking)}")
        columns = ", ".join(f'CAST("{w}" AS TEXT)' for w in wanted) + ", " if wanted else ""
        for *values, blob in db.execute(f'SELECT {columns}"{found[0]}" FROM "{layer}"'):
            yield (*values, geopackage_wkb(blob))


def shape_polygons(data: bytes) -> Iterator[bytes | None]:
    """WKB of each record of a polygon shapefile, null shapes as null: clockwise rings begin polygons, the others are holes of the polygon that they lie in."""
    at = 100
    while at < len(data):
        size = 2 * int.from_bytes(data[at + 4 : at + 8], "big")
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        if len(body) < size:
            raise ValueError("the file ends inside a record")
        kind = int.from_bytes(body[:4], "little")
        if kind == 0:
            yield None
            continue
        if kind not in (5, 15, 25):
            raise ValueError(f"a shape of kind {kind} among polygons")
        parts, points = np.frombuffer(body, "<i4", 2, 36).tolist()
        starts = [*np.frombuffer(body, "<i4", parts, 44).tolist(), points]
        xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
        rings = [xy[a : b - 1] for a, b in zip(starts, starts[1:]) if b - a > 3]
        x = [(r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]) for r in rings]
        outer = [float(a @ np.roll(b, -1) - b @ np.roll(a, -1)) <= 0 for a, b in x]
        shape: g.Shape = [[r] for r, o in zip(rings, outer) if o]
        for ring in (r for r, o in zip(rings, outer) if not o):
            home = next((p for p in shape if g.locate(*ring.mean(0), [[p[0]]]) >= 0), None)
            if home is None:
                shape.append([ring])  # a ring the wrong way round
            else:
                home.append(ring)
        yield g.write_wkb(shape)


def read_geopackage(spark: SparkSession, path: str, layer: str, wanted: list[str], *, name: str | None = None, crs: int | None = None) -> DataFrame:
    """(path, wanted columns, geom) of a layer of GeoPackages, or of those (called ``name``) in archives; a task holds one file, of 2 GB at most."""

    def parse(data: bytes, _: str) -> Iterator[tuple]:
        return (row for _, raw in members(data, ".gpkg", name) for row in geopackage_rows(raw, layer, wanted, crs))

    return parse_files(spark, path, parse, ", ".join([*(f"{w} string" for w in wanted), "geom binary"]))


def read_shapefile_polygons(spark: SparkSession, path: str, wanted: list[str], *, name: str | None = None) -> DataFrame:
    """(path, wanted columns, geom) of polygon shapefiles in archives, each with its table of the same name; records that the table has deleted are left out."""

    def parse(data: bytes, _: str) -> Iterator[tuple]:
        tables = {n[:-4].lower(): raw for n, raw in members(data, ".dbf")}
        for n, raw in members(data, ".shp", name):
            shapes = list(shape_polygons(raw))
            for number, *values in dbf_rows(tables[n[:-4].lower()], wanted):
                yield (*values, shapes[number])

    return parse_files(spark, path, parse, ", ".join([*(f"{w} string" for w in wanted), "geom binary"]))
