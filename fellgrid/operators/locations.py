"""Saved locations: import, export and edits of an ordered list (id, name, lat, lon, notes, position)."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Limits and the format of exports.
MOST, NAME_LENGTH, NOTES_LENGTH, ID_LENGTH = 1000, 200, 20_000, 200
FORMAT, VERSION = "saved-locations", 1

#: A string, whole (or up to the end of the text), or a white space character that JSON doesn't know.
_PIECE = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[^\S \t\r\n]|\ufeff', re.DOTALL)


def repair_json(text: str) -> tuple[str, int]:
    """(text with unusual white space outside strings as plain spaces, how many there were)."""
    odd = [m for m in _PIECE.finditer(text) if not m[0].startswith('"')]
    places = [-1, *(m.start() for m in odd), len(text)]
    return " ".join(text[a + 1 : b] for a, b in zip(places, places[1:])), len(odd)


def parse_json(text: str) -> tuple[object, int]:
    """(value, repaired characters); repair is tried only where the text doesn't parse as it is."""
    try:
        return json.loads(text), 0
    except ValueError:
        fixed, count = repair_json(text)
        if not count:
            raise
        return json.loads(fixed), count


def items_of(value: object, form: str = FORMAT) -> list:
    """The rows of an import: a bare list or a versioned document."""
    if isinstance(value, list):
        items = value
    elif isinstance(value, dict) and value.get("format") == form and value.get("version") == VERSION and isinstance(value.get("locations"), list):
        items = value["locations"]
    else:
        raise ValueError(f"expected {form} version {VERSION} or a list")
    if len(items) > MOST:
        raise ValueError(f"at most {MOST} locations can be imported")
    return items


def problems(rows: DataFrame) -> DataFrame:
    """(position, problem) of rows that can't be imported; lat and lon null or blank count as 0."""
    number = lambda c: F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(0.0)).otherwise(F.col(c).try_cast("double"))
    lat, lon, name = number("lat"), number("lon"), F.trim(F.coalesce("name", F.lit("")))
    bad = F.when(name == "", "name").when(F.length(name) > NAME_LENGTH, "name length").when(F.length("notes") > NOTES_LENGTH, "notes length")
    bad = bad.when(lat.isNull() | F.isnan(lat) | ~lat.between(-90, 90), "lat").when(lon.isNull() | F.isnan(lon) | ~lon.between(-180, 180), "lon")
    return rows.select("position", bad.alias("problem")).filter("problem is not null")


def settle_ids(rows: DataFrame, prefix: str = "location-") -> DataFrame:
    """Rows whose id is kept if it isn't blank, too long or used before in order of position; else made from the position."""
    tidy = F.trim(F.coalesce("id", F.lit("")))
    seen = F.row_number().over(Window.partitionBy(tidy).orderBy("position"))
    good = (tidy != "") & (F.length(tidy) <= ID_LENGTH) & (seen == 1)
    return rows.withColumn("generated", ~good).withColumn("id", F.when(good, tidy).otherwise(F.concat(F.lit(prefix), F.col("position").cast("string"))))


def load(spark: SparkSession, text: str, form: str = FORMAT) -> DataFrame:
    """An import as rows in order; a ValueError names the first row that is wrong."""
    items = items_of(parse_json(text)[0], form)
    if not all(isinstance(i, dict) for i in items):
        raise ValueError("a location is not an object")
    text_of = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    rows = [(k, *(text_of(i.get(c)) for c in ("id", "name", "lat", "lon")), i.get("notes") or "") for k, i in enumerate(items)]
    df = spark.createDataFrame(rows, "position int, id string, name string, lat string, lon string, notes string")
    first = problems(df).orderBy("position").first()
    if first:
        raise ValueError(f"location {first['position'] + 1}: {first['problem']}")
    zero = lambda c: F.coalesce(F.when(F.trim(c) == "", F.lit(0.0)).otherwise(F.col(c).try_cast("double")), F.lit(0.0))
    return settle_ids(df).select("position", "id", F.trim("name").alias("name"), zero("lat").alias("lat"), zero("lon").alias("lon"), "notes")


def export(rows: DataFrame, form: str = FORMAT) -> DataFrame:
    """One row (json): the versioned document, rows in order."""
    one = F.struct("position", F.struct("id", "name", "lat", "lon", "notes").alias("x"))
    listed = rows.agg(F.transform(F.sort_array(F.collect_list(one)), lambda s: s["x"]).alias("locations"))  # at most MOST rows
    return listed.select(F.to_json(F.struct(F.lit(form).alias("format"), F.lit(VERSION).alias("version"), "locations")).alias("json"))


def upsert(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows with changed ones in place of those with their id, and new ones at the end."""
    kept = rows.join(changed.select("id"), "id", "left_anti")
    placed = changed.drop("position").join(rows.select("id", "position"), "id", "left")
    last = rows.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("last"))
    new = placed.crossJoin(F.broadcast(last)).withColumn("position", F.coalesce("position", F.col("last") + F.row_number().over(Window.orderBy(F.col("position").isNotNull(), "id")))).drop("last")
    return kept.unionByName(new.select(kept.columns))


def delete(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_anti")


def move(rows: DataFrame, position: int, delta: int) -> DataFrame:
    """Rows with two neighbours' positions exchanged; as they are if there is no such neighbour."""
    other = position + delta
    both = rows.filter(F.col("position").isin(position, other)).agg(F.count("*").alias("_n"))
    swapped = F.when(F.col("position") == position, other).when(F.col("position") == other, position).otherwise(F.col("position"))
    return rows.crossJoin(F.broadcast(both)).withColumn("position", F.when(F.col("_n") == 2, swapped).otherwise(F.col("position")).cast("int")).drop("_n")
