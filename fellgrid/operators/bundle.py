"""Bundles of metrics: union, conflicts, order, references and manifests; and file catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import checks

#: What a published source shows.
PUBLIC_KEYS = ["id", "provider", "distributor", "dataset", "release", "extract_date", "homepage_url", "licence_name", "licence_url", "attribution"]


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def conflicts(rows: DataFrame, key: str) -> DataFrame:
    """(key, definitions) of keys that are defined in more than one way."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.countDistinct(F.struct(*rest)).alias("definitions")).filter("definitions > 1")


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(rows: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """Rows that refer to nothing."""
    return rows.join(table.select(F.col(table_key).alias(key)).distinct(), key, "left_anti")


def metric_order(metrics: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, metric_id, category_order, place): metrics numbered from 0 inside their category, categories without an order last (999)."""
    ranked = metrics.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("ordinal", "metric_id")) - 1)
    return ranked.join(categories, "category", "left").select("category", "metric_id", F.coalesce("category_order", F.lit(999)).alias("category_order"), "place")


def category_groups(metrics: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, metrics): each category's metrics in order; empty categories go."""
    return metrics.join(categories, "category").groupBy("category").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "metric_id"))), lambda s: s["metric_id"]).alias("metrics"))


def class_check(rows: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """(class, problem): observed classes that are not expected and expected ones that are not observed."""
    want = rows.sparkSession.createDataFrame([(e,) for e in expected], "class string")
    seen = rows.select(F.col(column).alias("class")).distinct()
    unknown = seen.join(want, "class", "left_anti").withColumn("problem", F.lit("unknown"))
    return unknown.unionByName(want.join(seen, "class", "left_anti").withColumn("problem", F.lit("missing")))


def public_json(sources: DataFrame) -> DataFrame:
    """(id, json) with the listed keys that aren't null."""
    keys = [k for k in PUBLIC_KEYS if k in sources.columns]
    return sources.select("id", F.to_json(F.struct(*keys)).alias("json"))


def pending_files(files: DataFrame) -> DataFrame:
    """(source, files, bytes) of the files whose size or hash isn't what the catalogue says."""
    todo = files.filter(~F.coalesce((F.col("size") == F.col("expected_size")) & (F.col("hash").isNull() | F.col("expected_hash").isNull() | (F.col("hash") == F.col("expected_hash"))), F.lit(False)))
    return todo.groupBy("source").agg(F.count("*").alias("files"), F.sum("expected_size").alias("bytes"))


def any_partial(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.coalesce(F.bool_or("partial"), F.lit(False)).alias("preview_partial_sources"))


def pruning_notes(notes: DataFrame, source_id: str) -> DataFrame:
    """Notes (source_id, action) that hold for a source: its own and those without one."""
    return notes.filter(F.col("source_id").isNull() | (F.col("source_id") == "") | (F.col("source_id") == source_id))


def stale_files(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files (name, ...) that a bundle doesn't name any more."""
    return found.join(wanted.select("name").distinct(), "name", "left_anti")


def assemble(metrics: DataFrame, categories: DataFrame, sources: DataFrame) -> DataFrame:
    """The metrics of several datasets as one bundle, in order of category, place and id.

    ``metrics``: id, category_id, source_id, ordinal and more; ``categories``: id, ordinal and more; ``sources``: id and more.  Definitions that contradict
    one another, repeated metrics and references to nothing are an error that names all of them.
    """
    checks.require(
        checks.violations(conflicts(categories, "id"), "categories defined in two ways"),
        checks.violations(conflicts(sources, "id"), "sources defined in two ways"),
        checks.violations(repeated_ids(metrics, "id"), "repeated metrics"),
        checks.violations(dangling(metrics, "category_id", categories, "id"), "metrics without a category"),
        checks.violations(dangling(metrics, "source_id", sources, "id"), "metrics without a source"),
    )
    places = categories.select(F.col("id").alias("category_id"), F.col("ordinal").alias("_place")).distinct()
    return metrics.join(places, "category_id").orderBy("_place", "category_id", "ordinal", "id").drop("_place")
