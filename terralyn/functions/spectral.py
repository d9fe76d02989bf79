"""Vegetation indices; a missing band, NaN or the raster's 0 is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(dn: Column) -> Column:
    """A raster value; 0 and NaN mean no data."""
    return F.when((dn != 0) & ~F.isnan(dn), dn)


def _ratio(a: Column, b: Column) -> Column:
    """a / b with a denominator of 0 taken as 1."""
    return a / F.when(b == 0, F.lit(1.0)).otherwise(b)


def index_value(kind: str, red: Column, nir: Column, green: Column | None = None, blue: Column | None = None, scale: float = 10000.0) -> Column:
    """ndvi, evi, gndvi or savi; evi without blue and gndvi without green fall back to ndvi."""
    ndvi = _ratio(nir - red, nir + red)
    if kind == "ndvi":
        return ndvi
    if kind == "evi":
        return ndvi if blue is None else F.coalesce(2.5 * _ratio(nir - red, nir + 6.0 * red - 7.5 * blue + scale), ndvi)
    if kind == "gndvi":
        return ndvi if green is None else F.coalesce(_ratio(nir - green, nir + green), ndvi)
    if kind == "savi":
        return 1.5 * _ratio(nir - red, nir + red + 0.5)
    raise ValueError(f"no such index: {kind}")
