"""Error metrics of modelled against reference routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def compare(model: DataFrame, reference: DataFrame) -> DataFrame:
    """Routes of both, with error_min and distance_error_pct; the last reference of a pair that has both values wins.

    ``model``: variant, origin, destination, minutes, distance_miles; ``reference``: origin, destination, google_minutes, google_miles, line and more.
    """
    whole = reference.filter("google_minutes is not null and google_miles is not null")
    last = Window.partitionBy("origin", "destination").orderBy(F.desc("line"))
    latest = whole.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k", "line")
    met = model.withColumn("variant", F.when(F.trim("variant") != "", F.col("variant")).otherwise("model")).join(latest, ["origin", "destination"])
    return met.withColumn("error_min", F.col("minutes") - F.col("google_minutes")).withColumn("distance_error_pct", F.abs(F.col("distance_miles") - F.col("google_miles")) / F.col("google_miles") * 100.0)


def error_columns(error: Column, distance: Column) -> list[Column]:
    size = F.abs(error)
    return [
        F.count("*").alias("n"),
        F.avg(error).alias("bias"),
        F.avg(size).alias("mae"),
        F.median(size).alias("median_ae"),
        F.percentile(size, F.lit(0.9)).alias("p90"),
        F.percentile(size, F.lit(0.95)).alias("p95"),
        F.count_if(size <= 10).alias("within_10"),
        F.count_if(size <= 15).alias("within_15"),
        F.avg(distance).alias("distance_mape"),
    ]


def error_metrics(rows: DataFrame, keys: list[str], sets: list[list[str]], error: str = "error_min", distance: str = "distance_error_pct") -> DataFrame:
    """Error metrics for each grouping set over ``keys``; ``grouping`` says which keys a row leaves out."""
    out = rows.groupingSets([[F.col(k) for k in s] for s in sets], *keys)
    return out.agg(F.grouping_id().cast("long").alias("grouping"), *error_columns(F.col(error), F.col(distance)))


def worst(rows: DataFrame, n: int, *ties: str, by: str | None = None, error: str = "error_min") -> DataFrame:
    """The ``n`` rows with the largest absolute errors, for each value of ``by`` if given; a report, so the limit is the feature."""
    order = [F.desc(F.abs(F.col(error))), *ties]
    if by is None:
        return rows.orderBy(*order).limit(n)
    rank = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(rank)).filter(F.col("_k") <= n).drop("_k")


def spread(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """count, sum, median, p95, p99 and max of a column."""
    v = F.col(value)
    aggregates = [F.count(v).alias("n"), F.sum(v).alias("total"), F.median(v).alias("median"), F.percentile(v, F.lit(0.95)).alias("p95"), F.percentile(v, F.lit(0.99)).alias("p99"), F.max(v).alias("max")]
    return rows.groupBy(*keys).agg(*aggregates)


def match_statistics(matched: DataFrame, trunk: DataFrame) -> DataFrame:
    """One row on matches (edge_id, length_m, distance, candidates) of trunk links (edge_id): counts, length, distances, and how many links have how many candidates."""
    of_match = matched.agg(F.count("*").alias("matched_edges"), (F.coalesce(F.sum("length_m"), F.lit(0)) / 1000.0).alias("matched_length_km"), F.median("distance").alias("median_match_distance_m"), F.percentile("distance", F.lit(0.95)).alias("p95_match_distance_m"))
    counts = matched.groupBy("candidates").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("candidates").cast("string"), "n")))).alias("candidate_speed_count"))
    return of_match.crossJoin(F.broadcast(trunk.agg(F.count("*").alias("trunk_edges")))).crossJoin(F.broadcast(counts))  # one row each
