import gzip
import io
import struct
import zipfile

import numpy as np
import pytest

from fellgrid.functions.geo import Grid
from fellgrid.sources import files, sinks, tables


def dbf(fields, rows):
    head = b"".join(n.encode().ljust(11, b"\0") + b"C\0\0\0\0" + bytes([k]) + b"\0" * 15 for n, k in fields)
    size = 32 + len(head) + 1
    body = b"".join((b"*" if gone else b" ") + b"".join(v.encode("latin1").ljust(k) for v, (_, k) in zip(r, fields)) for gone, r in rows)
    return struct.pack("<B3xIHH20x", 3, len(rows), size, 1 + sum(k for _, k in fields)) + head + b"\r" + body


def test_dbf_and_shape_points(spark, tmp_path):
    (tmp_path / "n.dbf").write_bytes(dbf([("id", 4), ("name", 6)], [(False, ("a", "é")), (True, ("b", "x")), (False, ("c", "y z"))]))
    got = files.read_dbf(spark, str(tmp_path / "n.dbf"), ["name", "id"]).orderBy("record").collect()
    assert [(r["record"], r["name"], r["id"]) for r in got] == [(0, "é", "a"), (2, "y z", "c")]
    with pytest.raises(ValueError):
        list(files.dbf_rows((tmp_path / "n.dbf").read_bytes(), ["none"]))
    shp = b"\0" * 100
    for n, content in enumerate([struct.pack("<Idd", 1, 1.5, 2.5), struct.pack("<I", 0)], 1):
        shp += struct.pack(">II", n, len(content) // 2) + content
    assert list(files.shape_points(shp)) == [(0, 1.5, 2.5), (1, None, None)]
    with pytest.raises(ValueError):
        list(files.shape_points(shp + b"\0" * 3))


def test_tiles(spark, tmp_path):
    text = "ncols 2\nnrows 2\nxllcorner 100\nyllcorner 200\ncellsize 50\nnodata_value -9\n1 2\n3 -9\n"
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("t.asc", text)
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a/t.zip", inner.getvalue())
    (tmp_path / "all.zip").write_bytes(outer.getvalue())
    got = files.read_tiles(spark, str(tmp_path / "all.zip"), size=2)
    assert {(r["easting"], r["northing"], r["value"]) for r in got.collect()} == {(125.0, 275.0, 1.0), (175.0, 275.0, 2.0), (125.0, 225.0, 3.0)}
    assert files.tile_overlaps(got).count() == 0


def test_sheets(spark, tmp_path):
    ods = (
        '<d xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0">'
        '<table:table table:name="S"><table:table-row table:number-rows-repeated="2"><table:table-cell office:value-type="float" office:value="1.5"/><table:table-cell table:number-columns-repeated="2"><text:p>a</text:p></table:table-cell>'
        '<table:table-cell table:number-columns-repeated="900"/></table:table-row></table:table></d>'
    )
    with zipfile.ZipFile(tmp_path / "s.ods", "w") as z:
        z.writestr("content.xml", ods)
    assert [(r["line"], r["cells"]) for r in files.read_sheet(spark, str(tmp_path / "s.ods"), "S").orderBy("line").collect()] == [(0, ["1.5", "a", "a"]), (1, ["1.5", "a", "a"])]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>x</t><t>y</t></si></sst>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/a.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/worksheets/a.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row><c r="B2" t="inlineStr"><is><t>q</t></is></c></row></sheetData></worksheet>')
    assert [r["cells"] for r in files.read_sheet(spark, str(tmp_path / "s.xlsx"), "S").orderBy("line").collect()] == [["xy", "", "2"], ["", "q"]]
    assert files.column_number("AB12") == 27


def test_blobs_round_trip(spark, tmp_path):
    rows = [("m", 0, 0, 0, 5), ("m", 0, 1, 1, 7), ("m", 1, 0, 0, 6)]
    packed = sinks.pack(spark.createDataFrame(rows, "metric string, level int, row int, col int, encoded int"), [(0, 2, 2), (1, 1, 1)]).first()
    assert gzip.decompress(packed["blob"]) == np.array([5, 65535, 65535, 7, 6], "<u2").tobytes()
    (tmp_path / "m.gz").write_bytes(packed["blob"])
    got = files.read_blobs(spark, str(tmp_path / "m.gz"), [(0, 2, 2), (1, 1, 1)])
    assert {(r["level"], r["row"], r["col"], r["encoded"]) for r in got.collect()} == {r[1:] for r in rows}
    blobs = spark.read.format("binaryFile").load(str(tmp_path / "m.gz"))
    expected = spark.createDataFrame([("m.gz", len(packed["blob"]), "0"), ("n.gz", 1, "0")], "name string, size long, sha256 string")
    assert {r["problem"] for r in sinks.verify_blobs(blobs, expected).collect()} == {"hash", "missing"}


def test_source_months(spark):
    names = ["tasmax_hadukgrid_uk_1km_day_20200201-20200229.nc", "tasmax_hadukgrid_uk_1km_day_20210201-20210228.nc", "tasmin_hadukgrid_uk_1km_day_20210201-20210227.nc", "other.nc", "tasmax_hadukgrid_uk_1km_day_20209901-20200229.nc"]
    got = tables.source_months(spark.createDataFrame([(f"/a/{n}",) for n in names], "path string"))
    assert sorted((r["variable"], r["year"], r["month"], r["days"]) for r in got.collect()) == [("tasmax", 2020, 2, 29), ("tasmax", 2021, 2, 28)]
    assert tables.source_months(got.select("path"), 2021).count() == 1
    assert tables.repeated_months(got.union(got.limit(1))).count() == 1


def test_concentrations(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Note,x\nunits,y\nGridCode,X,Y,no2\n1,500,1500,3.5\n2,1500,500,MISSING\n")
    got = tables.read_concentrations(spark, str(tmp_path / "a.csv"), Grid(5, 5, 1000, 0, 0))
    assert {(r["cell"], r["value"]) for r in got.collect()} == {(5, 3.5), (1, None)}
    (tmp_path / "b.csv").write_text("gridcode,x,y,v\n1,501,1500,3.5\n")
    with pytest.raises(Exception, match="no cell"):
        tables.read_concentrations(spark, str(tmp_path / "b.csv"), Grid(5, 5, 1000, 0, 0)).collect()


def test_places(spark, tmp_path):
    line = '{"geometry": {"type": "Point", "coordinates": [%s, 54.0]}, "properties": {"osm_ref": "n/1", "name": " ", "brand": "B  x", "shop": "%s", "amenity": "pharmacy"}}\n'
    (tmp_path / "a.json").write_text(line % (-1, "convenience") + line % (-1, "other"))
    got = tables.read_osm_places(spark, str(tmp_path / "a.json"), 1)
    assert sorted((r["category"], r["name"]) for r in got.collect()) == [("convenience", "B x"), ("pharmacy", "B x"), ("pharmacy", "B x")]
    (tmp_path / "b.json").write_text(line % (9, "convenience"))
    with pytest.raises(Exception, match="invalid place"):
        tables.read_osm_places(spark, str(tmp_path / "b.json"), 1).collect()


def test_practices(spark, tmp_path):
    row = lambda code, status, role, n=27: ",".join({0: code, 1: f"P {code}", 9: "AB1", 12: status, 25: role}.get(i, "") or '""' for i in range(n))
    (tmp_path / "p.csv").write_text("\n".join([row("a", "ACTIVE", "RO76"), row("b", "CLOSED", "RO76"), row("c", "ACTIVE", "RO80"), row("d", "ACTIVE", "RO76", 28)]))
    assert [r["code"] for r in tables.read_nhs_practices(spark, str(tmp_path / "p.csv"), "gp").collect()] == ["a"]
    assert [r["code"] for r in tables.read_nhs_practices(spark, str(tmp_path / "p.csv"), "dentist").orderBy("code").collect()] == ["a", "c"]


def test_observed_links(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"features": [{"attributes": {"roadnumber": "a 1", "averagespeedmph": 50, "linkid": "L"}, "geometry": {"paths": [[[0, 0], [1, 0], [1, 2]], [[5, 5]]]}}, {"attributes": {"roadnumber": "A2", "averagespeedmph": 1, "linkid": "M"}, "geometry": {"paths": [[[0, 0], [1, 1]]]}}]}')
    got = tables.read_observed_links(spark, str(tmp_path / "l.json")).collect()
    assert {(r["line_id"], r["road"], r["mph"], r["ax"], r["ay"], r["bx"], r["by"]) for r in got} == {("L/0", "A1", 50.0, 0.0, 0.0, 1.0, 0.0), ("L/0", "A1", 50.0, 1.0, 0.0, 1.0, 2.0)}


def test_road_speeds_and_hospitals(spark):
    sheet = spark.createDataFrame([(3, ["ONS Area Code 1", "Road Name", "2023", "2024"]), (4, ["E1", "a 1", "9", "30"]), (5, ["E1", "A1", "9", "31.5"]), (6, ["E2", "A1", "9", "2"]), (7, ["E3"])], "line int, cells array<string>")
    assert [tuple(r) for r in tables.road_speed_rows(sheet).collect()] == [("E1", "A1", 31.5)]
    codes = spark.createDataFrame([("H1 ", "", "AB"), ("H2", "Two", "CD")], "HospitalCode string, HospitalName string, Postcode string")
    profile = spark.createDataFrame([(0, "H1", "TOTAL", "A1"), (1, "H1", "TOTAL", "J26"), (2, "H2", "OTHER", "A1")], "line int, hospital_code string, specialty string, hospital_group string")
    assert [(r["code"], r["category"], r["name"]) for r in tables.scottish_hospitals(codes, profile).collect()] == [("H1", "hospital_community", "NHS hospital")]


def test_links_and_postcodes(spark, tmp_path):
    pages = spark.createDataFrame([(1, '<a HREF=\'x/a.csv\'>a</a><a href="http://h/b.zip">')], "page_id int, html string")
    assert [r["link"] for r in tables.page_links(pages, r"\.csv$", "http://base/").collect()] == ["http://base/x/a.csv"]
    (tmp_path / "c.csv").write_text('"AB1 2CD",10,459611,451704\n"X",10,,\n')
    got = tables.read_postcodes(spark, str(tmp_path / "c.csv")).collect()
    assert len(got) == 1 and abs(got[0]["lat"] - 53.958) < 1e-3 and abs(got[0]["lon"] + 1.093) < 1e-3


def test_payloads(spark):
    pois = spark.createDataFrame([("gp", "b", 54.0, -1.1, "n/2", "osm", 0), ("gp", "a", 54.0, -1.1, "n/1", "osm", 0)], "category string, name string, lat double, lon double, source_ref string, source_id string, source_rank int")
    row = sinks.service_payload(pois).first()
    assert row["bucket"] == "216:-5" and row["json"].index('"name":"a"') < row["json"].index('"name":"b"')
    areas = spark.createDataFrame([("dangerous", "b", "w/2", "g"), ("dangerous", "A", "w/1", "g"), (None, "x", "w/3", "g")], "category string, name string, ref string, geometry string")
    assert [x["name"] for x in sinks.area_payload(areas).first()["areas"]] == ["A", "b"]


def test_manifest(spark, tmp_path):
    text = sinks.manifest(Grid(2, 2, 1000, 0, 0), [{"id": "m", "category": "c", "palette": ["#000000", "#ffffff"]}], [{"id": "c"}])
    (tmp_path / "m.json").write_text(text)
    assert sinks.load_manifest(spark, str(tmp_path / "m.json"))["grid"]["east"] == 2000
    with pytest.raises(ValueError):
        sinks.load_manifest(spark, str(tmp_path / "m.json"), 4)
    with pytest.raises(ValueError):
        sinks.manifest(Grid(2, 2, 1000, 0, 0), [{"id": "m", "category": "q"}], [{"id": "c"}])


def test_daily_cubes_need_their_library():
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="h5py"):
            list(files.cube_rows(b"", "tasmax"))


def test_vector_layers(spark, tmp_path):
    import sqlite3

    import numpy as np

    from fellgrid.functions import polygons as g
    from fellgrid.sources import layers

    holed = [[g.box(0, 0, 4, 4)[0][0], g.box(1, 1, 2, 2)[0][0]]]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INTEGER)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('woods', 'geom', 27700)")
    db.execute("CREATE TABLE woods (fid INTEGER PRIMARY KEY, kind TEXT, geom BLOB)")
    head = lambda flags, envelope: b"GP\0" + bytes([flags]) + struct.pack("<i", 27700) + envelope
    db.executemany("INSERT INTO woods (kind, geom) VALUES (?, ?)", [("a", head(1, b"") + g.write_wkb(holed)), ("b", head(3, b"\0" * 32) + g.write_wkb(g.box(0, 0, 1, 1))), ("c", head(0x11, b"")), ("d", None)])
    db.commit()
    (tmp_path / "w.gpkg").write_bytes(db.serialize())
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("in/w.gpkg", db.serialize())
    for file in ("w.gpkg", "w.zip"):
        got = layers.read_geopackage(spark, str(tmp_path / file), "woods", ["fid", "kind"], crs=27700).orderBy("fid").collect()
        assert [(r["fid"], r["kind"], None if r["geom"] is None else g.area(g.read_wkb(bytes(r["geom"])))) for r in got] == [("1", "a", 15), ("2", "b", 1), ("3", "c", None), ("4", "d", None)]
    for options in ({"layer": "none", "wanted": []}, {"layer": "woods", "wanted": ["x"]}, {"layer": "woods", "wanted": [], "crs": 4326}):
        with pytest.raises(ValueError):
            list(layers.geopackage_rows(db.serialize(), **options))

    def record(n, rings):
        closed = [np.vstack([r, r[:1]]) for r in rings]
        starts = np.cumsum([0, *(len(r) for r in closed)])
        body = struct.pack("<I4d2i", 5, 0, 0, 9, 9, len(closed), int(starts[-1])) + starts[:-1].astype("<i4").tobytes() + np.vstack(closed).astype("<f8").tobytes()
        return struct.pack(">II", n, len(body) // 2) + body

    outer, hole, other = holed[0][0][::-1], holed[0][1], g.box(10, 0, 11, 1)[0][0][::-1]
    shp = b"\0" * 100 + record(1, [outer, hole, other]) + struct.pack(">III", 2, 2, 0) + record(3, [other])
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("s.shp", shp)
        z.writestr("s.dbf", dbf([("name", 3)], [(False, ("x",)), (False, ("y",)), (True, ("z",))]))
    got = layers.read_shapefile_polygons(spark, str(tmp_path / "s.zip"), ["name"]).collect()
    assert [(r["name"], None if r["geom"] is None else g.area(g.read_wkb(bytes(r["geom"])))) for r in got] == [("x", 16), ("y", None)]
    with pytest.raises(ValueError):
        list(layers.shape_polygons(shp[:-4]))


def test_osm_extract(spark, tmp_path):
    import zlib

    from fellgrid.functions import polygons as g
    from fellgrid.sources import osm

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    zig = lambda n: varint((n << 1) ^ (n >> 63) if n >= 0 else ((-n) << 1) - 1)
    part = lambda k, body: varint(k << 3 | 2) + varint(len(body)) + body
    deltas = lambda xs: b"".join(zig(b - a) for a, b in zip([0, *xs], xs))
    strings = ["", "shop", "supermarket", "landuse", "military", "name", "Mühle"]
    nodes = [(10, 540_000_000, -10_000_000), (11, 540_000_000, 10_000_000), (7, 540_010_000, 10_000_000), (300, 540_010_000, -10_000_000)]
    pairs = [1, 2, 5, 6, 0, 0, 5, 6, 0, 0]
    dense = part(1, deltas([n[0] for n in nodes])) + part(8, deltas([n[1] for n in nodes])) + part(9, deltas([n[2] for n in nodes])) + part(10, b"".join(map(varint, pairs)))
    way = lambda i, keys, vals, refs: part(3, varint(1 << 3) + varint(i) + part(2, bytes(keys)) + part(3, bytes(vals)) + part(8, deltas(refs)))
    group = way(5, [3], [4], [10, 11, 7, 300, 10]) + way(6, [3], [4], [10, 11]) + way(8, [5], [6], [10, 11, 7, 10]) + way(9, [3], [4], [10, 11, 999, 10])
    block = part(1, b"".join(part(1, s.encode()) for s in strings)) + part(2, part(2, dense)) + part(2, group)
    file = b""
    for kind, raw in ((b"OSMHeader", b"x"), (b"OSMData", block)):
        blob = varint(2 << 3) + varint(len(raw)) + part(3, zlib.compress(raw))
        head = part(1, kind) + varint(3 << 3) + varint(len(blob))
        file += struct.pack(">I", len(head)) + head + blob
    (tmp_path / "x.pbf").write_bytes(file)
    got = osm.read_osm(spark, str(tmp_path / "x.pbf"), {"shop": {"supermarket", "convenience"}, "landuse": {"military"}}).orderBy("id").collect()
    assert [(r["kind"], r["id"]) for r in got] == [("w", 5), ("w", 6), ("w", 9), ("n", 10)]
    assert got[3]["tags"] == {"shop": "supermarket", "name": "Mühle"} and (round(got[3]["lat"], 7), round(got[3]["lon"], 7)) == (54.0, -1.0)
    assert got[0]["refs"] == [10, 11, 7, 300, 10] and osm.read_osm(spark, str(tmp_path / "x.pbf"), {"name": None}, "w").count() == 1
    areas = osm.read_osm_areas(spark, str(tmp_path / "x.pbf"), {"landuse": {"military"}}).collect()
    assert [r["id"] for r in areas] == [5] and abs(g.area(g.read_wkb(bytes(areas[0]["geom"]))) - 0.002) < 1e-9
    with pytest.raises(ValueError):
        list(osm.blocks(file[:-2]))
