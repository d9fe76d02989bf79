"""Season curves as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Season presets (name: height, rate and day of the rise, rate and day of the fall, day between them).
PRESETS = {
    "maize": (0.85, 0.12, 150.0, 0.10, 270.0, 215.0),
    "winter wheat": (0.72, 0.09, 60.0, 0.12, 175.0, 135.0),
    "soybean": (0.78, 0.11, 165.0, 0.11, 280.0, 225.0),
    "sugar beet": (0.85, 0.07, 120.0, 0.06, 300.0, 215.0),
    "grass": (0.65, 0.15, 80.0, 0.03, 330.0, 205.0),
    "default": (0.78, 0.117, 104.0, 0.078, 221.0, 198.0),
}
#: Days of the year after which a season repeats, days over which rise gives way to fall, least and greatest value.
YEAR, BLEND, LEAST = 365.0, 2.5, 1e-9
#: Apostrophes that a crop's name may hold, and its letters with accents.
APOSTROPHES = "'`\u00b4\u2018\u2019\u2032\u0091\u0092\u0093\u0094"
ACCENTS, PLAIN = "\u00e0\u00e2\u00e9\u00e8\u00ea\u00eb\u00ee\u00ef\u00f4\u00fb\u00f9\u00e7", "aaeeeeiiouuc"


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def double_logistic(t: Column, high: Column | float, rise: Column | float, up: Column | float, fall: Column | float, down: Column | float, between: Column | float) -> Column:
    """Growth that rises around day up and falls around day down; the season before and the one after reach into the year."""
    high, rise, up, fall, down, between = (v if isinstance(v, Column) else F.lit(float(v)) for v in (high, rise, up, fall, down, between))

    def season(day: Column) -> Column:
        late = sigmoid((day - between) / BLEND)
        return (1 - late) * (high * sigmoid(rise * (day - up))) + late * (high - high * sigmoid(fall * (day - down)))

    whole = season(t) + season(t - YEAR) + season(t + YEAR)
    return F.least(F.lit(1 - LEAST), F.greatest(F.lit(LEAST), whole))


def growth(t: Column, curve: Column, high: Column, start: Column, end: Column) -> Column:
    """A curve inside its period; under a hundredth of its height, and outside, 0."""
    return F.when((t < start) | (t > end) | (curve < 0.01 * high), 0.0).otherwise(curve)


def transition_width(k: Column) -> Column:
    """Days from 10 % to 90 % of a rise of steepness k."""
    return math.log(81) / F.when(k != 0, k)


def beta_schedule(t: Column, days: int, a: float, b: float, magnitude: float) -> Column:
    """Variance over the season in the shape of a beta density, its greatest value being magnitude."""
    x = t / float(days)
    mode = (a - 1) / (a + b - 2)
    peak = mode ** (a - 1) * (1 - mode) ** (b - 1)
    return magnitude * F.pow(x, a - 1) * F.pow(1 - x, b - 1) / peak


def day_index(date: Column, base_year: Column) -> Column:
    """Days from 1 January of a base year, which is day 1, across years."""
    return F.datediff(date, F.make_date(base_year, F.lit(1), F.lit(1))) + 1


def crop_key(name: Column) -> Column:
    """A crop's name in lower case without apostrophes, known accents and punctuation; anything else is a space."""
    plain = F.translate(F.regexp_replace(F.lower(name), f"[{APOSTROPHES}]", ""), ACCENTS, PLAIN)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))
