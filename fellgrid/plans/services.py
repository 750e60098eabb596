"""Services: sources geocoded, put together, de-duplicated and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bundle, points


def services(osm: list[DataFrame], records: list[DataFrame], postcodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places kept, (category, missing) of records without a position).

    ``osm``: frames of category, lat, lon, name, source_id, source_ref, source_rank; ``records``: category, code, name,
    postcode, source_id, source_rank; ``postcodes``: postcode, lat, lon, line.
    """
    found, missing = points.geocode(bundle.union_all(*records), postcodes)
    placed = found.select("category", "lat", "lon", "name", "source_id", F.col("code").alias("source_ref"), "source_rank")
    return points.deduplicate(bundle.union_all(*osm, placed).select("category", "name", "lat", "lon", "source_ref", "source_id", "source_rank")), missing


def counts(places: DataFrame) -> DataFrame:
    """(category, n) in category order, 0 for categories without places."""
    order = places.sparkSession.createDataFrame([(c, i, label) for i, (c, label) in enumerate(zip(points.CATEGORIES, points.CATEGORY_LABELS))], "category string, place int, label string")
    n = places.groupBy("category").agg(F.count("*").alias("n"))
    return order.join(n, "category", "left").select("category", "place", "label", F.coalesce("n", F.lit(0)).alias("n"))
