"""Closed-form calculators as column expressions: doses, growth scores, bands, ages, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milligrams a kilogram (least, most), hours between doses, caps in mg (single, a day, a kilogram and day), floors (months, kg).
DOSES = {
    "paracetamol": {"low": 10.0, "high": 15.0, "hours": 4, "single": 1000.0, "day": 4000.0, "day_kg": 60.0, "months": 0, "kg": 0.0},
    "ibuprofen": {"low": 5.0, "high": 10.0, "hours": 6, "single": 400.0, "day": 1200.0, "day_kg": 30.0, "months": 3, "kg": 5.0},
}
# Upper bounds and labels of z-scores.
CUTS = [(-3.0, "severe_low"), (-2.0, "low"), (2.0, "usual"), (3.0, "high")]
# Days in a month on average, z of the bands drawn.
MONTH_DAYS = 30.4375
BAND_Z = [-1.88079, -1.03643, 0.0, 1.03643, 1.88079]


def tenth_down(x: Column) -> Column:
    return F.floor(x * 10) / 10


def dose(weight: Column, months: Column, drug: str, mg_per_ml: float) -> Column:
    """struct(outcome, mg_low, mg_high, ml, doses): what a weight and an age (null: unknown) lead to.

    Weights outside 1 to 120 kg are refused; infants under three months and those below the drug's floors are
    referred; an unknown age is taken as old enough from 10 kg on.
    """
    d = DOSES[drug]
    young = months < 3
    below = (months < d["months"]) | (weight < d["kg"])
    unsure = months.isNull() & (weight < 10)
    high = F.least(weight * d["high"], F.lit(d["single"]))
    low = F.least(weight * d["low"], high)
    day = F.least(weight * d["day_kg"], F.lit(d["day"]))
    times = F.greatest(F.least(F.floor(day / high), F.lit(24 // d["hours"])), F.lit(1)).cast("long")
    outcome = F.when(weight.isNull() | (weight < 1) | (weight > 120), "refused").when(F.coalesce(young, F.lit(False)), "refer").when(F.coalesce(below, F.lit(False)), "too_small").when(unsure, "ask_age").otherwise("ok")
    ok = outcome == "ok"
    return F.struct(outcome.alias("outcome"), F.when(ok, F.bround(low, 1)).alias("mg_low"), F.when(ok, F.bround(high, 1)).alias("mg_high"), F.when(ok, tenth_down(high / mg_per_ml)).alias("ml"), F.when(ok, times).alias("doses"))


def lms_z(x: Column, l: Column, m: Column, s: Column) -> Column:  # noqa: E741
    """Z-score by the LMS method (Cole, Green 1992)."""
    return F.when(F.abs(l) < 1e-9, F.log(x / m) / s).otherwise((F.pow(x / m, l) - 1) / (l * s))


def lms_value(z: Column, l: Column, m: Column, s: Column) -> Column:  # noqa: E741
    """The measurement at a z-score."""
    return F.when(F.abs(l) < 1e-9, m * F.exp(s * z)).otherwise(m * F.pow(1 + l * s * z, 1 / l))


def percentile(z: Column) -> Column:
    """Normal distribution in percent, by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return 50 * (1 + F.signum(z) * erf)


def cut_label(z: Column) -> Column:
    """The first label whose bound is above z."""
    out = F.when(z.isNull(), F.lit(None).cast("string"))
    for bound, label in CUTS:
        out = out.when(z < bound, label)
    return out.otherwise("very_high")


def strength(text: Column) -> Column:
    """Milligrams a millilitre from ``100 mg/5 ml``, ``10mg/ml``."""
    mg = F.regexp_extract(text, r"(?i)([0-9]+(?:\.[0-9]+)?) ?mg ?/ ?([0-9]*) ?ml", 1)
    ml = F.regexp_extract(text, r"(?i)([0-9]+(?:\.[0-9]+)?) ?mg ?/ ?([0-9]*) ?ml", 2)
    return F.when(mg != "", mg.cast("double") / F.coalesce(F.nullif(ml, F.lit("")), F.lit("1")).cast("double"))


def age_months(text: Column) -> Column:
    """Months from phrases such as ``3 weeks``, ``18 months``, ``2 years``; null without one."""
    number = lambda unit: F.nullif(F.regexp_extract(text, rf"(?i)([0-9]+) ?{unit}", 1), F.lit("")).cast("double")
    return F.coalesce(number("years?") * 12, number("months?"), number("weeks?") * 7 / MONTH_DAYS, number("days?") / MONTH_DAYS)


def celsius(f: Column) -> Column:
    """Fahrenheit to Celsius within what a body can have, else null."""
    c = (f - 32) * 5 / 9
    return F.when((c >= 30) & (c <= 45), F.round(c, 1))
