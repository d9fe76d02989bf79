"""Scalar rules that every operator shares."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0; plain division would raise."""
    return a / F.when(b != 0, b)


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def finite(x: Column) -> Column:
    """x, null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def nan_to_zero(x: Column) -> Column:
    """x, 0 where it is null or NaN."""
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def probit(p: float) -> float:
    """The inverse of the normal distribution function."""
    return NormalDist().inv_cdf(p)


def smallest_plot_side(res: Column, sigma: Column, purity: float) -> Column:
    """Side of a square plot that leaves one pixel of a purity, which falls to its root in each direction."""
    return res + 2 * probit(purity**0.5) * sigma


def pixel_key(lng: Column, lat: Column) -> Column:
    """A pixel's key from its place to six digits: points become underscores and minus signs an m."""
    return F.translate(F.concat(F.lit("p_"), F.format_string("%.6f", lng), F.lit("_"), F.format_string("%.6f", lat)), ".-", "_m")


def pixel_number(col: Column, row: Column) -> Column:
    """A cell's number of 32 bits from its column and row."""
    return F.pmod(col * F.lit(65536) + F.pmod(row, F.lit(65536)), F.lit(4294967296))


#: CE90 over the standard deviation of a geolocation error, and full width at half maximum over it.
CE90_SIGMA, FWHM_SIGMA = 2.146, 2.3548


def blur_budget(ce90: Column, optics: Column, res: Column) -> Column:
    """Blur of a sensor: of its geolocation, of its pixel's box (listed, not added), both of optics and geolocation, and its width."""
    geo = ce90 / CE90_SIGMA
    both = F.hypot(optics, geo)
    return F.struct(geo.alias("geo"), (res / 12**0.5).alias("box"), both.alias("effective"), (FWHM_SIGMA * both).alias("fwhm"))


def asset_key(assets: Column, wanted: Column, default: str = "B04") -> Column:
    """The wanted key of a map of assets where it is there, else the default."""
    return F.when(F.map_contains_key(assets, wanted), wanted).otherwise(F.lit(default))

