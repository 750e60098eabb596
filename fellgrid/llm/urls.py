"""URL filters as a sort-merge range join, in DataFrame operations only.

A host's canonical key is its labels in reverse, each closed by a dot (``blog.example.net`` -> ``net.example.blog.``),
so the hosts under a rule's host are the keys from the rule's key up to its key plus a character above all
others: an interval.  Intervals of one label count are disjoint and those of different counts nest, so the
stack of active rules of a sorted sweep is one register for each label count: the last rule host of that
count that the sweep has passed.  A register is active while the row's key starts with the register's key.

The sweep runs in ``parts`` independent, equally large parts: urls are dealt by a hash of their row, not of
their host, so a host with a third of all urls is spread over all parts; each part gets all rule hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), *LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", parts: int | None = None) -> DataFrame:
    """The rows of ``pages`` plus host, path, rule and verdict.

    ``rules`` has host, path, verdict (block or allow).  A rule fits its host and all subdomains where the
    path starts with the rule's; the longest (host plus path; ties: block, then the smaller text) wins.  Urls
    that are null or have no ``://`` have empty host and path and fit no rule, nor does an empty rule host.
    Repeated rules count once.  No rules, or no pages, are fine.  Input columns with one of the four new
    names are replaced; repeated rows stay repeated.
    """
    spark = pages.sparkSession
    if parts is None:
        parts = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    clean = rules.select(F.translate(F.coalesce("host", F.lit("")), *LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> ''").distinct()
    held = (
        clean.withColumn("key", host_key(F.col("host")))
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct((-F.length(F.concat("host", "path"))).alias("minus"), (F.col("verdict") != "block").alias("soft"), F.concat("host", "path").alias("rule"), "path", "verdict"))).alias("paths"))
        .withColumn("level", F.size(F.split("key", r"\.")) - 1)
    )
    levels = [r[0] for r in held.select("level").distinct().orderBy("level").collect()]  # DNS allows 127 labels
    body = pages.drop("host", "path", "rule", "verdict")
    rows = body.select(F.struct(*(F.col(f"`{c}`") for c in body.columns)).alias("row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rows = rows.select("row", "host", "path", host_key(F.col("host")).alias("key"), F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"))
    marks = held.select("key", "level", "paths", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n in levels:
        both = both.withColumn(f"r{n}", F.last(F.when((F.col("kind") == 0) & (F.col("level") == n), F.struct("key", "paths")), ignorenulls=True).over(sweep))
    active = [F.when(F.col("key").startswith(F.col(f"r{n}.key")), F.filter(f"r{n}.paths", lambda r: F.col("path").startswith(r["path"]))) for n in levels]
    none = "array<struct<minus:int,soft:boolean,rule:string,path:string,verdict:string>>"
    fits = F.sort_array(F.flatten(F.array(*(F.coalesce(a, F.array().cast(none)) for a in active)))) if levels else F.array().cast(none)
    best = both.filter("kind = 1").select("row", "host", "path", F.get(fits, F.lit(0)).alias("best"))
    return best.select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
