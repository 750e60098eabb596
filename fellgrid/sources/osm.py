"""OpenStreetMap extracts (PBF): nodes, ways and areas whose tags pass a test.

A file is a row of compressed blocks; a block is read in arrays (all numbers of a packed field at once), and only objects that
pass the test leave it.  A task holds one file, of 2 GB at most; cut larger extracts up first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import polygons as g
from .files import parse_files

Tags = dict[str, set[str] | None]


def varints(data: bytes) -> np.ndarray:
    """All variable-length numbers of a packed field."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.r_[0, last[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & np.uint8(127)).astype(np.uint64) << (7 * place).astype(np.uint64), first).view(np.int64)


def signed(values: np.ndarray) -> np.ndarray:
    """Zigzag numbers as signed ones."""
    return (values.view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(values & 1)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields; lengths, texts and messages as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        elif key & 7 == 2:
            size = number()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def blocks(data: bytes) -> Iterator[bytes]:
    """The unpacked data blocks of a file."""
    at = 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        head = dict(fields(data[at + 4 : at + 4 + size]))
        at += 4 + size
        blob = dict(fields(data[at : at + head[3]]))
        if at + head[3] > len(data):
            raise ValueError("the file ends inside a block")
        at += head[3]
        if head[1] == b"OSMData":
            yield blob[1] if 1 in blob else zlib.decompress(blob[3])


def passes(tags: dict[str, str], wanted: Tags) -> bool:
    """Whether any wanted key has one of its values (any value if none are listed)."""
    return any(k in tags and (v is None or tags[k] in v) for k, v in wanted.items())


def osm_objects(data: bytes, wanted: Tags, kinds: str = "nw") -> Iterator[tuple]:
    """(kind, id, lat, lon, tags, refs): nodes with a place and ways with their nodes, of those whose tags pass."""
    for block in blocks(data):
        strings: list[str] = []
        groups, scale = [], {17: 100, 19: 0, 20: 0}
        for k, v in fields(block):
            if k == 1:
                strings = [s.decode("utf-8", "replace") for n, s in fields(v) if n == 1]
            elif k == 2:
                groups.append(v)
            elif k in scale:
                scale[k] = v
        place = lambda raw, offset: 1e-9 * (scale[offset] + scale[17] * raw)  # noqa: E731, B023
        text = lambda numbers: [strings[i] for i in numbers]  # noqa: E731, B023
        for group in groups:
            for k, v in fields(group):
                if k == 2 and "n" in kinds:
                    held = dict(fields(v))
                    ids, lat, lon = (np.cumsum(signed(varints(held.get(f, b"")))) for f in (1, 8, 9))
                    pairs = varints(held.get(10, b""))
                    ends = np.flatnonzero(pairs == 0) if len(pairs) else np.zeros(len(ids), np.int64)
                    # a zero ends each node's keys and values; only nodes that have some are looked at
                    starts = np.r_[0, ends[:-1] + 1]
                    for i in np.flatnonzero(ends > starts).tolist():
                        words = text(pairs[starts[i] : ends[i]].tolist())
                        tags = dict(zip(words[::2], words[1::2]))
                        if passes(tags, wanted):
                            yield "n", int(ids[i]), float(place(lat[i], 19)), float(place(lon[i], 20)), tags, None
                elif (k == 1 and "n" in kinds) or (k == 3 and "w" in kinds):
                    held = dict(fields(v))
                    tags = dict(zip(text(varints(held.get(2, b"")).tolist()), text(varints(held.get(3, b"")).tolist())))
                    if passes(tags, wanted):
                        if k == 3:
                            yield "w", held[1], None, None, tags, np.cumsum(signed(varints(held.get(8, b"")))).tolist()
                        else:
                            one = {f: int(signed(np.array([held[f]], np.uint64).view(np.int64))[0]) for f in (1, 8, 9)}
                            yield "n", one[1], place(one[8], 19), place(one[9], 20), tags, None


def osm_places(data: bytes) -> Iterator[tuple]:
    """(id, lat, lon) of all nodes, for the ways that go through them."""
    for block in blocks(data):
        held = list(fields(block))
        scale = {17: 100, 19: 0, 20: 0} | {k: v for k, v in held if k in (17, 19, 20)}
        for k, group in held:
            if k == 2:
                for n, v in fields(group):
                    if n == 2:
                        parts = dict(fields(v))
                        ids, lat, lon = (np.cumsum(signed(varints(parts.get(f, b"")))) for f in (1, 8, 9))
                        yield from zip(ids.tolist(), (1e-9 * (scale[19] + scale[17] * lat)).tolist(), (1e-9 * (scale[20] + scale[17] * lon)).tolist())


def read_osm(spark: SparkSession, path: str, wanted: Tags, kinds: str = "nw") -> DataFrame:
    """(kind, id, lat, lon, tags, refs) of the nodes and ways whose tags pass; the test runs while blocks are read."""
    return parse_files(spark, path, lambda data, _: osm_objects(data, wanted, kinds), "kind string, id long, lat double, lon double, tags map<string,string>, refs array<long>").drop("path")


def read_osm_areas(spark: SparkSession, path: str, wanted: Tags) -> DataFrame:
    """(id, tags, geom) of closed ways whose tags pass, as polygons in degrees; ways of fewer than three places, or with places that the file lacks, are left out."""
    ways = read_osm(spark, path, wanted, "w").filter((F.size("refs") > 3) & (F.element_at("refs", 1) == F.element_at("refs", -1)))
    corners = ways.select("id", F.posexplode("refs").alias("k", "node"))
    needed = corners.select("node").distinct()
    places = parse_files(spark, path, lambda data, _: osm_places(data), "node long, lat double, lon double").drop("path").join(needed, "node", "left_semi").dropDuplicates(["node"])
    rings = corners.join(places, "node").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "lon", "lat"))), lambda c: F.array(c["lon"], c["lat"])).alias("ring"))
    whole = ways.join(rings, "id").filter(F.size("ring") == F.size("refs")).select("id", "tags", "ring")

    def run(frames):
        for f in frames:
            yield f[["id", "tags"]].assign(geom=[g.write_wkb([[np.array([list(p) for p in r[:-1]])]]) for r in f["ring"]])

    return whole.mapInPandas(run, "id long, tags map<string,string>, geom binary")
