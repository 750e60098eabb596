"""Longest runs with state per cell, and windowed daily counts with a watermark, over files that keep arriving."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import work_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet files at a path (a folder or one file), with the schema that they have now."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def run_state(days: DataFrame, threshold: float) -> DataFrame:
    """(cell, longest) whenever a cell's state changes, from a stream of (cell, day, value).

    The state is the cell's runs as intervals of days, so days may come in any order and more than once; a day that
    closes the gap between two runs makes them one.  A run ends with its year.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last = (list(x) for x in state.get) if state.exists else ([], [])
        hot: set = set()
        for b in batches:
            hot.update(pd.to_datetime(b.loc[b["value"] > threshold, "day"]).dt.date)
        runs = sorted([*zip(first, last), *((d.toordinal(), d.toordinal()) for d in hot)])
        merged: list[list[int]] = []
        for a, z in runs:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            elif merged and a == merged[-1][1] + 1 and dt.date.fromordinal(a).timetuple().tm_yday > 1:
                merged[-1][1] = z
            else:
                merged.append([a, z])
        state.update(([a for a, _ in merged], [z for _, z in merged]))
        yield pd.DataFrame({"cell": [key[0]], "longest": [max((z - a + 1 for a, z in merged), default=0)]})

    return days.groupBy("cell").applyInPandasWithState(update, "cell long, longest long", "first array<int>, last array<int>", "update", GroupStateTimeout.NoTimeout)


def longest_runs_stream(spark: SparkSession, path: str, threshold: float) -> DataFrame:
    """(cell, longest) after all files at ``path`` have gone through the stream once."""
    days = arriving(spark, path).select(F.col("user_id").alias("cell"), F.to_date("ts").alias("day"), "value")
    out = _folder(spark, "runs")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = run_state(days, threshold).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", _folder(spark, "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    seen = spark.read.parquet(f"{out}/*")
    return seen.groupBy("cell").agg(F.max_by("longest", "batch").alias("longest"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, event_type, n) of a stream of events (ts, event_type); events later than ``late`` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def daily_counts_stream(spark: SparkSession, path: str) -> DataFrame:
    """Daily counts after all files at ``path`` have gone through the stream once."""
    name = "daily_" + uuid.uuid4().hex
    out = _folder(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = daily_counts(arriving(spark, path)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", _folder(spark, "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    seen = spark.read.parquet(f"{out}/*")
    return seen.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n")).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")
