"""Text sources: file catalogues, concentration tables, places, postcodes, observed links, geometry lists, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import Grid, cell_column, cell_id, cell_row, centre_easting, centre_northing, from_national_grid, inside
from ..functions.text import finite_number, first_name, header_place, literal_map
from ..operators.checks import require, violations
from ..operators.points import HOSPITAL_GROUPS, HOSPITAL_TYPES, UNNAMED, explode_categories

#: The name of a daily cube's file; where a header may stand; the bounds of places.
CUBE_NAME = r"^(tasmax|tasmin)_hadukgrid_uk_1km_day_(\d{8})-(\d{8})\.nc$"
HEADER_LINES = 32
TEMPERATURE_UNITS = ["degc", "degree_celsius", "degrees_celsius", "c", "°c", "celsius", "k", "kelvin"]
BOUNDS = {"west": -10.0, "east": 4.0, "south": 49.0, "north": 62.0}


def source_months(files: DataFrame, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """(path, variable, year, month, days) of the cube files that span a whole month, from (path); others go."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    part = lambda i: F.regexp_extract(name, CUBE_NAME, i)
    start, end = F.try_to_date(part(2), "yyyyMMdd"), F.try_to_date(part(3), "yyyyMMdd")
    named = files.select("path", part(1).alias("variable"), start.alias("a"), end.alias("z")).filter("variable <> '' and day(a) = 1 and z = last_day(a)")
    months = named.select("path", "variable", F.year("a").alias("year"), F.month("a").alias("month"), F.day("z").alias("days"))
    if first_year is not None:
        months = months.filter(F.col("year") >= first_year)
    return months if last_year is None else months.filter(F.col("year") <= last_year)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size) of the files under a path; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("length").alias("size"))


def discover_months(historical: DataFrame, provisional: DataFrame | None = None, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """(path, variable, year, month, days, status) of the cube files of both catalogues (path) in order; two files for one month are an error."""
    found = source_months(historical, first_year, last_year).withColumn("status", F.lit("historical"))
    if provisional is not None:
        found = found.unionByName(source_months(provisional, first_year, last_year).withColumn("status", F.lit("provisional")))
    require(violations(repeated_months(found), "months with more than one file"))
    return found.orderBy("variable", "year", "month")


def cube_problems(cubes: DataFrame, months: DataFrame, grid: Grid) -> DataFrame:
    """(path, problem) of cubes (path, t, height, width, units, west, south, step) that don't fit their month's days, the grid or a temperature's units."""
    units = F.trim(F.lower(F.coalesce("units", F.lit(""))))
    spot = (F.col("west") != float(grid.west)) | (F.col("south") != float(grid.south)) | (F.col("step") != float(grid.cell_size_m))
    problem = F.when((F.col("height") != grid.height) | (F.col("width") != grid.width), "shape").when(F.col("t") != F.col("days"), "days").when(~units.isin(*TEMPERATURE_UNITS), "units").when(spot, "grid")
    return cubes.join(months.select("path", "days"), "path").select("path", problem.alias("problem")).filter("problem is not null")


def load_discovery(spark: SparkSession, path: str) -> dict:
    """The description of downloaded sources (JSON), read through Spark, wherever it lies."""
    import json

    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def source_path(discovery: dict, name: str, root: str) -> str:
    """Where a described source's file lies below ``root``; an error if it isn't described or its name leaves the folder."""
    described = {s.get("name"): s for s in discovery.get("sources", [])}
    file = described.get(name, {}).get("file")
    if not file or file.startswith("/") or ".." in file.split("/"):
        raise ValueError(f"no file for source {name!r}")
    return f"{root.rstrip('/')}/{file}"


def repeated_months(months: DataFrame) -> DataFrame:
    return months.groupBy("variable", "year", "month").agg(F.count("*").alias("n")).filter("n > 1")


def header_line(lines: list[str], first: list[str]) -> int:
    """Number of the line, among the first 32, whose cells begin with the given names, whatever their case."""
    for n, line in enumerate(lines[:HEADER_LINES]):
        cells = [c.strip().lower() for c in line.lstrip("﻿").split(",")]
        if len(cells) > len(first) and cells[: len(first)] == first:
            return n
    raise ValueError("no header found")


def read_concentrations(spark: SparkSession, path: str, grid: Grid) -> DataFrame:
    """(x, y, value, row, col, cell) of a gridcode, x, y, value table below a preamble; MISSING is null.

    Coordinates that aren't numbers, lie outside the grid or off a cell's centre are an error.
    """
    head = [r[0] for r in spark.read.text(path).limit(HEADER_LINES).collect()]
    header = head[header_line(head, ["gridcode", "x", "y"])]
    lines = spark.read.text(path).filter((F.col("value") != header) & F.col("value").rlike(r"^\s*[^,]*,\s*[-+\d.]")).select(F.split("value", ",").alias("c"))
    number = lambda i: finite_number(F.trim(F.get("c", F.lit(i))))
    rows = lines.select(number(1).alias("x"), number(2).alias("y"), number(3).alias("value"))
    rows = rows.withColumn("row", cell_row(F.col("y"), grid)).withColumn("col", cell_column(F.col("x"), grid))
    off = (F.abs(F.col("x") - centre_easting(F.col("col"), grid)) > 0.01) | (F.abs(F.col("y") - centre_northing(F.col("row"), grid)) > 0.01)
    bad = F.col("x").isNull() | F.col("y").isNull() | ~inside(F.col("row"), F.col("col"), grid) | off
    cell = F.when(bad, F.raise_error(F.lit("coordinates that are no cell of the grid"))).otherwise(cell_id(F.col("row"), F.col("col"), grid))
    return rows.withColumn("cell", cell)


_FEATURE = "geometry struct<type: string, coordinates: array<double>>, properties struct<osm_ref: string, name: string, amenity: string, shop: string, brand: string, operator: string>"


def read_osm_places(spark: SparkSession, path: str, rank: int) -> DataFrame:
    """Places of GeoJSON lines, one a category; an error for features that are no points, have no reference or lie outside the bounds."""
    raw = spark.read.schema(_FEATURE).json(path).select(F.get("geometry.coordinates", F.lit(0)).alias("lon"), F.get("geometry.coordinates", F.lit(1)).alias("lat"), F.col("geometry.type").alias("kind"), "properties.*")
    good = (F.col("kind") == "Point") & F.col("lon").between(BOUNDS["west"], BOUNDS["east"]) & F.col("lat").between(BOUNDS["south"], BOUNDS["north"]) & (F.coalesce("osm_ref", F.lit("")) != "")
    checked = raw.withColumn("osm_ref", F.when(F.coalesce(good, F.lit(False)), F.col("osm_ref")).otherwise(F.raise_error(F.lit("invalid place"))))
    name = F.coalesce(first_name(F.col("name"), F.col("brand"), F.col("operator")), F.element_at(literal_map(UNNAMED), F.col("category")))
    return explode_categories(checked).select("category", "lat", "lon", name.alias("name"), F.lit("osm").alias("source_id"), F.col("osm_ref").alias("source_ref"), F.lit(rank).alias("source_rank"))


def _records(df: DataFrame, category: Column, code: str, name: Column, postcode: str, source: str, rank: int) -> DataFrame:
    return df.select(category.alias("category"), F.col(code).alias("code"), name.alias("name"), F.col(postcode).alias("postcode"), F.lit(source).alias("source_id"), F.lit(rank).alias("source_rank"))


def read_nhs_practices(spark: SparkSession, path: str, category: str) -> DataFrame:
    """Active practices of a headerless table of 27 columns; of GPs those with the prescribing role RO76 alone."""
    rows = spark.read.text(path).select(F.from_csv(F.regexp_replace("value", "^﻿", ""), F.lit(", ".join(f"c{i} string" for i in range(28)))).alias("r"), F.col("value")).select("r.*", "value")
    fields = F.size(F.split(F.regexp_replace("value", r'"[^"]*"', "q"), ",", -1))
    rows = rows.filter((fields == 27) & (F.col("c12") == "ACTIVE"))
    if category == "gp":
        rows = rows.filter("c25 = 'RO76'")
    return _records(rows, F.lit(category), "c0", F.col("c1"), "c9", "nhs-ods-gp" if category == "gp" else "nhs-ods-dental", 10)


def read_with_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)


def read_scottish_gps(spark: SparkSession, path: str) -> DataFrame:
    return _records(read_with_header(spark, path), F.lit("gp"), "PracticeCode", F.col("GPPracticeName"), "Postcode", "phs-gp", 20)


def read_scottish_dentists(spark: SparkSession, path: str) -> DataFrame:
    name = F.coalesce(F.when(F.col("address1") != "", F.col("address1")), F.lit("NHS dental practice"))
    return _records(read_with_header(spark, path), F.lit("dentist"), "Dental_Practice_Code", name, "pc7", "phs-dental", 20)


def read_hospital_sites(spark: SparkSession, path: str) -> DataFrame:
    rows = read_with_header(spark, path).withColumn("_c", F.element_at(literal_map(HOSPITAL_TYPES), F.coalesce("Site Type", F.lit("")))).filter("_c is not null")
    return _records(rows, F.col("_c"), "Site Code", F.col("Site Name"), "Post Code", "nhs-eric", 10)


def scottish_hospitals(codes: DataFrame, profile: DataFrame) -> DataFrame:
    """Hospitals (HospitalCode, HospitalName, Postcode) with the class that their TOTAL row of the profile (line, hospital_code, specialty, hospital_group) has; the last wins."""
    kinds = profile.filter("trim(specialty) = 'TOTAL'").select("line", F.trim("hospital_code").alias("code"), F.element_at(literal_map(HOSPITAL_GROUPS), F.trim("hospital_group")).alias("category")).filter("code <> '' and category is not null")
    last = kinds.groupBy("code").agg(F.max_by("category", "line").alias("category"))
    met = codes.withColumn("code", F.trim("HospitalCode")).join(last, "code")
    return _records(met, F.col("category"), "code", F.coalesce(F.when(F.col("HospitalName") != "", F.col("HospitalName")), F.lit("NHS hospital")), "Postcode", "phs-hospital-codes", 10)


def read_postcodes(spark: SparkSession, path: str) -> DataFrame:
    """(postcode, lat, lon, line) of headerless postcode, _, easting, northing tables; rows without numbers go."""
    rows = spark.read.csv(path, schema="postcode string, quality string, e string, n string", mode="PERMISSIVE")
    rows = rows.select("postcode", finite_number(F.col("e")).alias("e"), finite_number(F.col("n")).alias("n"), F.monotonically_increasing_id().alias("line")).filter("e is not null and n is not null")
    return rows.withColumn("p", from_national_grid(F.col("e"), F.col("n"))).select("postcode", "p.lat", "p.lon", "line")


_LINKS = "features array<struct<attributes: struct<roadnumber: string, averagespeedmph: double, linkid: string>, geometry: struct<paths: array<array<array<double>>>>>>"


def read_observed_links(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, road, mph, ax, ay, bx, by): the segments of observed links; paths of one point and speeds up to 1 mph go."""
    features = spark.read.schema(_LINKS).option("multiLine", "true").json(path).select(F.explode("features").alias("f"))
    road = F.regexp_replace(F.upper(F.coalesce("f.attributes.roadnumber", F.lit(""))), r"\s+", "")
    paths = features.select(road.alias("road"), F.col("f.attributes.averagespeedmph").alias("mph"), F.col("f.attributes.linkid").alias("link"), F.posexplode("f.geometry.paths").alias("k", "path"))
    good = paths.filter((F.col("mph") > 1) & ~F.isnan("mph") & (F.col("road") != "") & (F.size("path") >= 2)).withColumn("line_id", F.concat_ws("/", "link", "k"))
    cut = good.select("line_id", "road", "mph", F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("a"), F.get("path", i + 1).alias("b")))).alias("s"))
    return cut.select("line_id", "road", "mph", *(F.get(f"s.{p}", F.lit(i)).alias(f"{p}{c}") for p in "ab" for i, c in enumerate("xy")))


def road_speed_rows(sheet: DataFrame) -> DataFrame:
    """(lad, road, mph) of a sheet (line, cells) with its header on line 3: the last column that has a header, above 3 mph; the last of repeated rows."""
    header = sheet.filter("line = 3").select("cells")
    h = header.select(header_place(F.col("cells"), "ONS Area Code").alias("a"), header_place(F.col("cells"), "Road Name").alias("r"), (F.size("cells") - 1).alias("v"))
    met = sheet.filter("line > 3").crossJoin(F.broadcast(h))  # one row
    cell = lambda c: F.trim(F.coalesce(F.get("cells", F.col(c)), F.lit("")))
    rows = met.select("line", cell("a").alias("lad"), F.regexp_replace(F.upper(cell("r")), r"\s+", "").alias("road"), finite_number(F.get("cells", F.col("v"))).alias("mph")).filter("lad <> '' and road <> '' and mph > 3")
    return rows.groupBy("lad", "road").agg(F.max_by("mph", "line").alias("mph"))


def page_links(pages: DataFrame, pattern: str = ".*", base: str | None = None) -> DataFrame:
    """(page_id, link) of the href attributes of pages (page_id, html) that match a pattern."""
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']([^"']*)["']"""), F.lit(1))).alias("link"))
    found = links.filter(F.col("link").rlike(pattern))
    return found if base is None else found.withColumn("link", F.when(F.col("link").rlike(r"^[a-z]+://"), F.col("link")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace("link", "^/+", ""))))


def expected_but_absent(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.join(found, key, "left_anti")

