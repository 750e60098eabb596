"""Quantised metrics: values as unsigned 16-bit integers, their palette bins and display ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import half_up_floor

#: Fixed values of the encoded format.
NODATA = 65535
LARGEST = 65534
PALETTE_BINS = 64


def quantise(value: Column, scale: float, offset: float) -> Column:
    """Encoded value; null for null, NaN and infinite values, an error outside 0..65534."""
    real = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    code = half_up_floor((value - F.lit(float(offset))) / F.lit(float(scale)))
    sound = F.when((code < 0) | (code > LARGEST), F.raise_error(F.concat(F.lit("encoded value out of range: "), code.cast("string")))).otherwise(code)
    return F.when(real, sound).cast("int")


def dequantise(encoded: Column, scale: float | Column, offset: float | Column) -> Column:
    return F.when(encoded != NODATA, encoded * (scale if isinstance(scale, Column) else F.lit(float(scale))) + (offset if isinstance(offset, Column) else F.lit(float(offset))))


def show_value(encoded: Column, scale: float, offset: float, decimals: int, units: str = "") -> Column:
    """The value with fixed decimals and its units."""
    return F.trim(F.concat(F.format_string(f"%.{decimals}f", dequantise(encoded, scale, offset)), F.lit(" " + units)))


def palette_bin(value: Column, low: Column, high: Column) -> Column:
    """0..63; the middle bin if the range is a point; values outside the range go to its ends."""
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return F.when(low == high, F.lit((PALETTE_BINS - 1) // 2)).otherwise(F.least(F.lit(PALETTE_BINS - 1), F.floor(ratio * PALETTE_BINS))).cast("int")


def palette_colour(stops: list[str], number: Column) -> Column:
    """CSS colour of a bin: ``stops`` (#RRGGBB, two at least) interpolated over all bins."""
    rgb = [[int(s[i : i + 2], 16) for i in (1, 3, 5)] for s in stops]
    place = number / F.lit(float(PALETTE_BINS - 1)) * F.lit(len(stops) - 1)
    low = F.floor(place).cast("int")
    high = F.least(F.lit(len(stops) - 1), low + 1)
    channel = [F.array(*(F.lit(c[k]) for c in rgb)) for k in range(3)]
    parts = [half_up_floor(F.get(a, low) + (F.get(a, high) - F.get(a, low)) * (place - low)).cast("string") for a in channel]
    return F.concat(F.lit("rgb("), F.concat_ws(" ", *parts), F.lit(")"))


def plain_colour(number: Column, reverse: bool = False) -> Column:
    """CSS colour of a bin for metrics without a palette: a hue ramp."""
    raw = number / F.lit(float(PALETTE_BINS - 1))
    ratio = F.lit(1.0) - raw if reverse else raw
    light = F.lit(48.0) - F.lit(10.0) * F.pow(F.lit(1.0) - ratio, F.lit(2.0))
    return F.format_string("hsl(%.0f 78%% %.1f%%)", F.lit(220.0) - ratio * F.lit(220.0), light)


def display_range(low: Column, high: Column, scale: Column, offset: Column, encoded_min: Column, encoded_max: Column) -> Column:
    """(min, max) encoded: the configured range where it is ordered and can be encoded, else the observed one."""
    a, b = half_up_floor((low - offset) / scale), half_up_floor((high - offset) / scale)
    good = low.isNotNull() & high.isNotNull() & (a >= 0) & (b < NODATA) & (a < b)
    return F.struct(F.when(good, a).otherwise(encoded_min).cast("long").alias("min"), F.when(good, b).otherwise(encoded_max).cast("long").alias("max"))


def stored_range(low: Column, high: Column, full_low: Column, full_high: Column) -> Column:
    """A saved range clamped to the full one; the full one where it is missing, reversed or shrunk to a point."""
    a = F.greatest(full_low, F.least(full_high, half_up_floor(low)))
    b = F.greatest(full_low, F.least(full_high, half_up_floor(high)))
    bad = low.isNull() | high.isNull() | (a > b) | ((full_low < full_high) & (a == b))
    return F.struct(F.when(bad, full_low).otherwise(a).alias("min"), F.when(bad, full_high).otherwise(b).alias("max"))


def legend_values(low: Column, high: Column) -> Column:
    """Up to five different encoded values evenly over a range."""
    steps = F.least(F.lit(5), F.greatest(F.lit(1), high - low + 1)).cast("int")
    at = lambda i: half_up_floor(low + (high - low) * i / F.greatest(F.lit(1), steps - 1))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), steps - 1), at))


def range_percent(encoded: Column, low: Column, high: Column) -> Column:
    """Place of a value in a range in percent; 50 in a point."""
    return F.when(high <= low, F.lit(50.0)).otherwise((encoded - low) / (high - low) * 100.0)
