"""Text normalisation, keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metric names of earlier bundles.
LEGACY_METRICS = {
    "days_tmax_gt_25": "heat_days_tmax_gt_25",
    "days_tmax_gt_28": "heat_days_tmax_gt_28",
    "days_tmax_gt_30": "heat_days_tmax_gt_30",
    "summer_tmax_p95": "heat_summer_tmax_p95",
    "summer_tmax_p99": "heat_summer_tmax_p99",
    "longest_run_tmax_gt_25": "heat_longest_run_tmax_gt_25",
    "tropical_nights_tmin_gt_20": "heat_tropical_nights_tmin_gt_20",
}


def literal_map(values: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def compact_upper(x: Column) -> Column:
    """Upper case without white space: postcodes and road numbers; null becomes empty."""
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), r"\s+", "")


def clean_name(x: Column, fallback: Column) -> Column:
    """White space collapsed, 200 characters at most, ``fallback`` for null and blank."""
    tidy = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    return F.when(tidy == "", fallback).otherwise(F.substring(tidy, 1, 200))


def match_key(name: Column, ref: Column) -> Column:
    """Letters and digits only, lower case; places without a name never match one another."""
    key = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")
    return F.when(key.startswith("unnamed"), F.concat(key, F.lit(":"), ref)).otherwise(key)


def first_name(*names: Column) -> Column:
    """The first of several names that isn't blank; null if all are."""
    return F.coalesce(*(F.when(F.trim(n) != "", clean_name(n, F.lit(""))) for n in names))


def human_bytes(n: Column) -> Column:
    """A size with a binary unit and two decimals, ties to even; "unknown" for null."""
    out = F.format_string("%.2f TiB", F.bround(n / F.lit(1024.0**4), 2))
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB"), (0, "B")):
        out = F.when(n < F.lit(1024.0 ** (power + 1)), F.format_string(f"%.2f {unit}", F.bround(n / F.lit(1024.0**power), 2))).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def coverage_label(first_year: Column, first_month: Column, last_year: Column, last_month: Column) -> Column:
    """What a run of months covers: a year, whole years, or from month to month."""
    whole = (first_month == 1) & (last_month == 12)
    span = F.format_string("%d-%02d to %d-%02d", first_year, first_month, last_year, last_month)
    return (
        F.when(first_year.isNull(), F.lit("No observations"))
        .when(whole & (first_year == last_year), first_year.cast("string"))
        .when(whole, F.concat(first_year.cast("string"), F.lit("–"), last_year.cast("string")))
        .otherwise(span)
    )


def finite_number(x: Column) -> Column:
    """A double from text; null if it is no number or not finite."""
    v = F.expr("try_cast(NULL AS DOUBLE)") if x is None else x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def list_items(x: Column) -> Column:
    """Trimmed, non-empty items of a comma-separated text."""
    return F.filter(F.transform(F.split(x, ","), lambda i: F.trim(i)), lambda i: i != "")


def year_list(x: Column) -> Column:
    """The years of a comma-separated text; an error unless there is one at least and each is later than the one before."""
    years = F.transform(list_items(x), lambda i: i.cast("int"))
    rising = (F.size(years) > 0) & F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(years) - 1)), lambda k: F.coalesce(F.get(years, k) > F.get(years, k - 1), F.size(years) == 1))
    return F.when(rising, years).otherwise(F.raise_error(F.concat(F.lit("years must be listed once, in order: "), F.coalesce(x, F.lit("")))))


def osm_reference(kind: Column, number: Column) -> Column:
    """n/, w/ or r/ and the number."""
    return F.concat(F.substring(kind, 1, 1), F.lit("/"), number.cast("string"))


def osm_url(ref: Column) -> Column:
    """Address of an object from its reference; null for other references."""
    kind = F.when(ref.startswith("n/"), "node").when(ref.startswith("w/"), "way").when(ref.startswith("r/"), "relation")
    number = F.regexp_extract(ref, r"^[nwr]/(\d+)$", 1)
    return F.when(number != "", F.concat(F.lit("https://www.openstreetmap.org/"), kind, F.lit("/"), number))


def percent_encoded(x: Column) -> Column:
    """Percent-encoding of everything but letters, digits and -._~ (spaces as %20)."""
    coded = F.url_encode(x)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return coded


def directions_url(origin: Column, destination: Column) -> Column:
    """Address of driving directions between two places."""
    return F.concat(F.lit("https://www.google.com/maps/dir/"), percent_encoded(origin), F.lit("/"), percent_encoded(destination), F.lit("/data=!4m2!4m1!3e0"))


def grid_file_name(variable: Column, year: Column) -> Column:
    """Name of the yearly concentration file of a variable; null for unknown ones."""
    return (
        F.when(variable.isin("pm25", "pm10"), F.format_string("map%s%dg.csv", variable, year))
        .when(variable == "no2", F.format_string("mapno2%d.csv", year))
        .when(variable == "ozone_dgt120", F.format_string("mapdgt120%02d.csv", year % 100))
    )


def html_safe_json(x: Column) -> Column:
    """JSON that can stand inside a script element."""
    return F.replace(x, F.lit("<"), F.lit("\\u003c"))


def header_place(headers: Column, prefix: str) -> Column:
    """Place (from 0) of the first header that begins with a prefix, whatever the case; null if none."""
    hits = F.filter(F.transform(headers, lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda s: F.lower(F.coalesce(s["h"], F.lit(""))).startswith(prefix.lower()))
    return F.get(hits, F.lit(0))["i"]
