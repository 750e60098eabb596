"""The four rounding families that coexist in the data model; each has one name here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up_floor(x: Column) -> Column:
    """floor(x + 0.5): quantisation, and display ranges (also what browsers' rounding does)."""
    return F.floor(x + F.lit(0.5)).cast("long")


def half_even(x: Column) -> Column:
    """To the nearest integer, ties to even: travel seconds and fixed-point coordinates."""
    return F.bround(x, 0).cast("long")


def mean_half_up(total: Column, n: Column) -> Column:
    """Integer mean of non-negative integers, ties up: (total + n div 2) div n."""
    return F.floor((total + F.floor(n / 2)) / n).cast("long")


def parent_half_up(total: Column, n: Column) -> Column:
    """(2 total + n) div (2 n): the mean of up to four children of a raster cell, ties up."""
    return F.floor((total * 2 + n) / (n * 2)).cast("long")
