"""Components of pixels' series: a common axis of dates, gaps filled, axes fitted on some zones and others placed on them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralyn.operators.matrix import pca
from terralyn.operators.series import date_axis, gap_fill
from terralyn.sources.scratch import cut

#: Pixels that a fit needs, dates of an axis, observations of a pixel and share of the axis that they span, components.
LEAST_PIXELS, LEAST_DATES, LEAST_SEEN, SPAN, COMPONENTS = 10, 3, 3, 0.5, 3


class Components(NamedTuple):
    """scores: (pixel_id, zone, scores) of the placed pixels; shares: (component, explained, cumulative)."""

    scores: DataFrame
    shares: DataFrame
    fitted: int
    placed: int
    dropped: int
    dates: int
    filled: float  # share of cells that were filled in


def pixel_components(pixels: DataFrame, fit: list[str], place: list[str], start=None, end=None, whiten: bool = False) -> Components:
    """Components of pixels (pixel_id, zone, date, value) of some zones, and the pixels of other zones on the same axes.

    The axis holds the dates that enough pixels observe, within start and end. A pixel without enough observations, or
    whose observations span too little of the axis, is left out. Errors say what a fit lacks.
    """
    own = cut(pixels.where(F.col("zone").isin(sorted({*fit, *place})) & F.col("value").isNotNull() & ~F.isnan("value")).select("pixel_id", "zone", F.to_date("date").alias("date"), "value"))
    zones = own.groupBy("pixel_id").agg(F.min("zone").alias("zone"))
    counts = {r["zone"]: r["count"] for r in zones.groupBy("zone").count().collect()}  # a row for each zone
    n_fit, n_place = (sum(counts.get(z, 0) for z in set(names)) for names in (fit, place))
    if n_fit < LEAST_PIXELS:
        raise ValueError(f"only {n_fit} pixels in the fitted zones: add zones or fields")
    if not n_place:
        raise ValueError("no pixels in the placed zones")
    curves = own.select(F.col("pixel_id").alias("field_key"), "date", "value")
    axis = date_axis(curves).select("date")
    axis = axis.where(F.col("date") >= F.lit(start)) if start is not None else axis
    axis = cut(axis.where(F.col("date") <= F.lit(end)) if end is not None else axis)
    n_dates = axis.count()
    if n_dates < LEAST_DATES:
        raise ValueError(f"only {n_dates} dates {'in the window' if start is not None or end is not None else 'on the axis'}: at least {LEAST_DATES} are needed")
    seen = curves.join(F.broadcast(axis), "date", "left_semi")
    filled = gap_fill(seen, axis, LEAST_SEEN, SPAN)
    rows = filled.groupBy(F.col("field_key").alias("pixel_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "value"))), lambda s: s["value"]).alias("v"))
    rows = cut(rows.join(zones, "pixel_id").select(F.col("pixel_id").alias("id"), "zone", "v"))
    inner, outer = rows.where(F.col("zone").isin(fit)), rows.where(F.col("zone").isin(place))
    fitted, placed = inner.count(), outer.count()
    if fitted < LEAST_PIXELS:
        raise ValueError(f"only {fitted} fitted pixels span enough of the period")
    if not placed:
        raise ValueError("no placed pixel spans enough of the period")
    known = seen.join(rows.select(F.col("id").alias("field_key")), "field_key", "left_semi").select("field_key", "date").distinct().count()
    scores, shares = pca(inner, outer, min(COMPONENTS, n_dates), whiten)
    return Components(scores.select(F.col("id").alias("pixel_id"), "zone", "scores"), shares, fitted, placed, n_place - placed, n_dates, 1 - known / (rows.count() * n_dates))
