"""Daily cubes: threshold counts, expected annual days, runs, seasonal percentiles and completeness.

A cube is long: one row a cell and day (cell, day, value), null for no data.  One shuffle by cell serves all
aggregates; months are counted on the map side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import checks


def hot(value: Column, threshold: float, below: bool = False) -> Column:
    """Strictly above (or below) a threshold; false for no data."""
    v = F.lit(float(threshold))
    return F.coalesce(value < v if below else value > v, F.lit(False))


def threshold_days(cube: DataFrame, threshold: float, below: bool = False) -> DataFrame:
    """(cell, days): days beyond a threshold, 0 for cells that have none."""
    return cube.groupBy("cell").agg(F.count_if(hot(F.col("value"), threshold, below)).alias("days"))


def months_covered(cube: DataFrame) -> DataFrame:
    """(month, years): in how many years the cube has each calendar month, over all cells."""
    seen = cube.select(F.year("day").alias("y"), F.month("day").alias("month")).distinct()
    return seen.groupBy("month").agg(F.count("*").alias("years"))


def expected_annual_days(cube: DataFrame, threshold: float, below: bool = False) -> DataFrame:
    """(cell, days): sum over calendar months of the mean number of days beyond a threshold.

    The mean of a month is over the years that the cube has it for, not over those of the cell.
    """
    counts = cube.groupBy("cell", F.month("day").alias("month")).agg(F.count_if(hot(F.col("value"), threshold, below)).alias("n"))
    # at most twelve rows
    means = counts.join(F.broadcast(months_covered(cube)), "month").select("cell", (F.col("n") / F.col("years")).alias("mean"))
    return means.groupBy("cell").agg(F.sum("mean").alias("days"))


def longest_run(cube: DataFrame, threshold: float, below: bool = False) -> DataFrame:
    """(cell, longest): longest run of successive days beyond a threshold within a year; 0 if there is none.

    A day that is missing, has no data or isn't beyond the threshold ends a run, and so does a new year.
    """
    days = cube.filter(hot(F.col("value"), threshold, below)).select("cell", F.year("day").alias("y"), "day")
    order = Window.partitionBy("cell", "y").orderBy("day")
    runs = days.withColumn("island", F.date_sub("day", F.row_number().over(order))).groupBy("cell", "y", "island").agg(F.count("*").alias("n"))
    best = runs.groupBy("cell").agg(F.max("n").alias("longest"))
    return cube.select("cell").distinct().join(best, "cell", "left").select("cell", F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))


def season_percentiles(cube: DataFrame, months: list[int], fractions: list[float]) -> DataFrame:
    """(cell, p0, p1, ...): exact percentiles, linearly interpolated, of the days in given months."""
    ps = cube.filter(F.month("day").isin(*months) & F.col("value").isNotNull()).groupBy("cell").agg(F.percentile("value", [float(f) for f in fractions]).alias("p"))
    return ps.select("cell", *(F.get("p", F.lit(i)).alias(f"p{i}") for i in range(len(fractions))))


def complete_seasons(cube: DataFrame, months: list[int]) -> DataFrame:
    """(season, y, month): the months of seasons of which the cube has every month.

    Months are in season order; once they wrap past December the season belongs to the later year.
    """
    wrap = [i for i in range(1, len(months)) if months[i] < months[i - 1]]
    early = months[: wrap[0]] if wrap else []
    seen = cube.select(F.year("day").alias("y"), F.month("day").alias("month")).distinct().filter(F.col("month").isin(*months))
    named = seen.withColumn("season", F.col("y") + F.col("month").isin(*early).cast("int") if early else F.col("y"))
    whole = named.groupBy("season").agg(F.countDistinct("month").alias("n")).filter(F.col("n") == len(months))
    return named.join(whole.select("season"), "season", "left_semi").select("season", "y", "month")


def complete_season_percentile(cube: DataFrame, months: list[int], fraction: float) -> DataFrame:
    """(cell, p0): percentile over days of complete seasons only."""
    days = cube.withColumn("y", F.year("day")).withColumn("month", F.month("day")).join(F.broadcast(complete_seasons(cube, months).select("y", "month")), ["y", "month"], "left_semi")
    return days.filter("value is not null").groupBy("cell").agg(F.percentile("value", F.lit(float(fraction))).alias("p0"))


def missing_months(cube: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """(y, month) that the cube should have and doesn't."""
    spark = cube.sparkSession
    expected = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y")).crossJoin(spark.range(1, 13).select(F.col("id").cast("int").alias("month")))
    return expected.join(cube.select(F.year("day").alias("y"), F.month("day").alias("month")).distinct(), ["y", "month"], "left_anti")


def contiguous_months(cube: DataFrame, year: int) -> DataFrame:
    """One row (latest, months, contiguous): whether a year's months run from January on without a gap."""
    seen = cube.filter(F.year("day") == year).select(F.month("day").alias("m")).distinct()
    return seen.agg(F.max("m").alias("latest"), F.count("*").alias("months"), (F.count("*") == F.max("m")).alias("contiguous"))


def incomplete_cells(cube: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(cell, y, month, days, expected): months in which a cell lacks days, though it has some; ``mask`` (cell) names cells that count.

    Months of which a cell has no row at all are in ``absent_months``.
    """
    if mask is not None:
        cube = cube.join(mask, "cell", "left_semi")
    months = cube.groupBy("cell", F.year("day").alias("y"), F.month("day").alias("month")).agg(F.count(F.when(F.col("value").isNotNull(), F.lit(1))).alias("days"), F.max(F.day(F.last_day("day"))).alias("expected"))
    return months.filter("days <> expected")


def coverage_bounds(cube: DataFrame) -> DataFrame:
    """One row: first and last year and month."""
    ym = F.struct(F.year("day").alias("y"), F.month("day").alias("m"))
    return cube.agg(F.min(ym).alias("a"), F.max(ym).alias("z")).select(F.col("a.y").alias("first_year"), F.col("a.m").alias("first_month"), F.col("z.y").alias("last_year"), F.col("z.m").alias("last_month"))


def exclude_cells(cube: DataFrame, cells: DataFrame) -> DataFrame:
    """The cube without listed cells."""
    return cube.join(cells.select("cell").distinct(), "cell", "left_anti")


def unknown_exclusions(cube: DataFrame, cells: DataFrame) -> DataFrame:
    """Listed cells that the cube doesn't have; pruning calls for none."""
    return cells.select("cell").distinct().join(cube.select("cell").distinct(), "cell", "left_anti")


def absent_months(cube: DataFrame, mask: DataFrame) -> DataFrame:
    """(cell, y, month) of the mask's cells for months that the cube has, of which a cell has no row.  A cell meets the list of all months, at most twelve a year."""
    seen = cube.select("cell", F.struct(F.year("day").alias("y"), F.month("day").alias("month")).alias("ym")).distinct()
    every = seen.agg(F.collect_set("ym").alias("every"))  # one row
    of_cell = mask.select("cell").distinct().join(seen.groupBy("cell").agg(F.collect_set("ym").alias("own")), "cell", "left")
    lacking = of_cell.crossJoin(F.broadcast(every)).select("cell", F.explode(F.array_except("every", F.coalesce("own", F.array_except("every", "every")))).alias("ym"))
    return lacking.select("cell", "ym.y", "ym.month")


def prune(cube: DataFrame, cells: DataFrame) -> DataFrame:
    """The cube without listed cells; an error if it doesn't have one of them."""
    checks.require(checks.violations(unknown_exclusions(cube, cells), "listed cells that the cube lacks"))
    return exclude_cells(cube, cells)


def land_mask(cube: DataFrame) -> DataFrame:
    """(cell) of the cells that have a value on the cube's first day."""
    first = cube.agg(F.min("day").alias("day"))
    return cube.join(F.broadcast(first), "day", "left_semi").filter(F.col("value").isNotNull() & ~F.isnan("value")).select("cell").distinct()
