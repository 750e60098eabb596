"""Road speeds and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import half_even
from .text import literal_map

#: Fallback speeds in mph by road function, and bits of the form flags.
FALLBACK_MPH = {
    "Motorway": 60.0,
    "A Road": 44.0,
    "B Road": 35.0,
    "Minor Road": 30.0,
    "Local Road": 25.0,
    "Restricted Local Access Road": 16.0,
    "Secondary Access Road": 20.0,
    "Local Access Road": 16.0,
    "Guided Busway": 15.0,
}
OTHER_MPH = 24.0
DUAL, ROUNDABOUT, SLIP = 1, 2, 4
DUAL_FORMS = ("Dual Carriageway", "Collapsed Dual Carriageway")
METRES_PER_SECOND = 0.44704


def _bounded(seconds: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(65534), half_even(seconds))).cast("int")


def seconds_at(length_m: Column, mph: Column) -> Column:
    """Whole seconds, ties to even, 1..65534; an error for speeds that are not above 0."""
    bad = mph.isNull() | F.isnan(mph) | (mph <= 0) | (mph == float("inf"))
    return F.when(bad, F.raise_error(F.lit("invalid road speed"))).otherwise(_bounded(length_m / (mph * METRES_PER_SECOND)))


def form_flags(form: Column) -> Column:
    return F.when(form.isin(*DUAL_FORMS), DUAL).when(form == "Roundabout", ROUNDABOUT).when(form == "Slip Road", SLIP).otherwise(0)


def fallback_speed(function: Column, form: Column) -> Column:
    """Speed by class: more on dual carriageways other than motorways, capped on roundabouts and slip roads."""
    mph = F.coalesce(F.element_at(literal_map(FALLBACK_MPH), function), F.lit(OTHER_MPH))
    mph = F.when((function != "Motorway") & form.isin(*DUAL_FORMS), mph + 5.0).otherwise(mph)
    return F.when(form == "Roundabout", F.least(mph, F.lit(20.0))).when(form == "Slip Road", F.least(mph, F.lit(35.0))).otherwise(mph)


def mixed_seconds(length_m: Column, urban: Column, urban_mph: Column, rural_mph: Column, flags: Column) -> Column:
    """Seconds over a link of which a share is urban, each part at its own speed and capped by form."""
    cap = F.when(flags.bitwiseAND(SLIP) != 0, F.lit(35.0)).otherwise(F.lit(1e9))
    cap = F.least(cap, F.when(flags.bitwiseAND(ROUNDABOUT) != 0, F.lit(20.0)).otherwise(F.lit(1e9)))
    u, r = F.least(urban_mph, cap), F.least(rural_mph, cap)
    return _bounded(length_m / METRES_PER_SECOND * (urban / u + (1.0 - urban) / r))
