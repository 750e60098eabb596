"""Mixing sources to target weights, in DataFrame operations only.

Token totals per source give each source a target, the target gives a repetition rate, and a document is
taken ``floor(rate)`` times plus once more with a probability equal to the fraction of the rate.  The extra copies are
drawn systematically: a source's documents are dealt by a hash into strata of about ``stratum`` rows, each stratum is ordered by size, then hash, and
with a start that a hash of source and stratum gives in [0, 1), the k-th document gets its copy if floor(start + k fraction)
exceeds floor(start + (k - 1) fraction).  So each document has its copy with that very probability, while neighbours in size
make up for each other and a stratum's words are off its share by less than one document's.

Targets share ``share`` of all tokens in proportion to the weights; none goes above
``cap`` times its source's tokens, and what a capped source leaves is shared again among the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, unused


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_unit(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on nothing but the key and the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, source_rows, target) from (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn.  Capped sources are found without
    iterating: in order of cap over weight, a source is capped as long as what is left for it and all later
    ones, at its weight, reaches its cap.  The windows run over one row a source in one task, which does for
    some ten million sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    weighed = totals.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(by_name) - 1) % len(weights))).withColumn(
        "cap", F.col("source_size") * F.lit(float(cap))
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = weighed.withColumn("pool", F.sum("source_size").over(everything) * F.lit(float(share))).select(
        "*",
        (F.col("pool") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("money"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("claims"),
    )
    capped = left.withColumn("capped", F.col("cap") * F.col("claims") <= F.col("money") * F.col("weight"))
    free = ~F.col("capped")
    rest = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    claim = F.sum(F.when(free, F.col("weight")).otherwise(0.0)).over(everything)
    return capped.select("source", "source_size", "source_rows", F.when(F.col("capped"), F.col("cap")).otherwise((F.col("pool") - rest) * F.col("weight") / claim).alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix:",
    stratum: int = 100_000,
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """The rows of ``docs`` plus size, source_size, target and copies (how often the mix takes the row).

    A null or empty text has size 0; null is a source like any other and comes last.  Rows without a key are known by their
    texts; rows with the same key or text are drawn one by one, in the order of their texts.  Reruns and other
    partitionings draw the same.  A source without words gets target 0 and its rows 0 copies.  An empty table
    gives an empty result.  Columns of the input that have one of the four new names are replaced; all others stay.
    """
    body = docs.drop("size", "source_size", "target", "copies")
    name, rows, order, tie, part, place = (unused(body.columns, x) for x in ("_source", "_rows", "_order", "_tie", "_part", "_place"))
    sized = body.withColumn("size", word_count(F.col(text)))
    named = lambda c: F.struct(c.isNull().alias("none"), F.coalesce(c.cast("string"), F.lit("")).alias("name"))
    goals = source_targets(sized.select(F.col(source).cast("string").alias("source"), "size"), weights, share, cap)
    goals = goals.select(named(F.col("source")).alias(name), "source_size", F.col("source_rows").alias(rows), "target")
    # all that is drawn from is made before the join, which needn't carry the text for it
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    known = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), words))
    marked = sized.withColumn(name, named(F.col(source))).withColumn(order, F.md5(F.concat(F.lit(seed), known))).withColumn(tie, F.md5(words))
    unit = F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    # sources are few unless there is one a web domain; beyond a checked number they meet in a join that can be split
    few = body.select(source).distinct().limit(100_001).count() <= 100_000
    dealt = marked.join(F.broadcast(goals) if few else goals, name).withColumn(part, F.floor(unit * F.ceil(F.col(rows) / F.lit(float(stratum)))))
    dealt = dealt.repartition(name, part)  # by stratum; rows dealt by source alone would do for the window, but leave a hot source in one task
    dealt = dealt.withColumn(place, F.row_number().over(Window.partitionBy(name, part).orderBy("size", order, tie)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    start = seeded_unit(F.concat_ws(":", F.lit("start"), F.col(f"{name}.none").cast("string"), F.col(f"{name}.name"), F.col(part).cast("string")), seed)
    drawn = F.floor(start + F.col(place) * (rate - whole)) - F.floor(start + (F.col(place) - 1) * (rate - whole))
    return dealt.withColumn("copies", (whole + drawn).cast("long")).drop(name, rows, order, tie, part, place)
