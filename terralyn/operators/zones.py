"""Zones of pixels: interior, or edge next to another species, the same species, or nothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralyn.operators import kinds
from terralyn.operators.spatial import cells

BOX = list(kinds.BOX)


def _apart(areas):
    """Squared distances to boxes; 0 inside."""
    lo_x, lo_y, hi_x, hi_y = (areas.field(c).to_numpy(zero_copy_only=False) for c in BOX)

    def squared(x, y, at):
        dx = np.maximum(0.0, np.maximum(lo_x[at] - x, x - hi_x[at]))
        dy = np.maximum(0.0, np.maximum(lo_y[at] - y, y - hi_y[at]))
        return dx * dx + dy * dy

    return squared


def _zoned(pixels: DataFrame, fields: DataFrame, near: DataFrame, buffer: float, gap: float, size: float) -> DataFrame:
    """Pixels (px, py and further columns) with each field that holds them, edge_dist and zone; they meet by cell and species."""
    wide = fields.withColumn("_gx", F.explode(cells(F.col("minx"), F.col("maxx"), size))).withColumn("_gy", F.explode(cells(F.col("miny"), F.col("maxy"), size)))
    own = pixels.join(kinds.by_kind(near), ["px", "py"]).withColumns({"_x": F.floor(F.col("px") / size), "_y": F.floor(F.col("py") / size)})
    met = own.join(wide, (F.col("_x") == F.col("_gx")) & (F.col("_y") == F.col("_gy")) & F.col("_lbl").eqNullSafe(F.col("crp_lbl")))
    inside = met.where("px between minx and maxx and py between miny and maxy")
    edge = F.least(F.col("px") - F.col("minx"), F.col("maxx") - F.col("px"), F.col("py") - F.col("miny"), F.col("maxy") - F.col("py"))
    seen = (edge + gap) * (edge + gap)
    zone = F.when(edge >= buffer, "interior").when(F.col("other") <= seen, "edge_other").when(kinds.same_kind(F.col("id")) <= seen, "edge_same").otherwise("edge_isolated")
    return inside.withColumns({"edge_dist": edge, "zone": zone})


def classify(pixels: DataFrame, fields: DataFrame, buffer: float, gap: float, size: float) -> DataFrame:
    """pixel_id, field_id, crp_lbl, edge_dist, zone of every pixel in a field.

    fields are boxes (id, crp_lbl, minx, miny, maxx, maxy). A pixel at least buffer inside is interior. Another one looks
    as far as its own distance to the edge plus gap: a field of another species within that makes it edge_other, else
    one of the same species edge_same, else it is edge_isolated. A pixel in several fields has a row for each. What is
    around a place is found once, whatever number of pixels and fields is there.
    """
    near = kinds.nearest_kinds(pixels, fields, BOX, buffer + gap, size, _apart)
    return _zoned(pixels, fields, near, buffer, gap, size).select("pixel_id", F.col("id").alias("field_id"), "crp_lbl", "edge_dist", "zone")


def zone_counts(classified: DataFrame) -> DataFrame:
    """field_id and its pixels in each zone."""
    from terralyn.operators.series import ZONES

    return classified.groupBy("field_id").pivot("zone", ZONES).agg(F.count("pixel_id")).fillna(0)


def count_zones(pixels: DataFrame, fields: DataFrame, buffer: float, gap: float, size: float) -> DataFrame:
    """zone_counts of classify(...), without a row for each pixel in a field.

    Pixels of one place share their zone in a field, and so do fields of one box and species: places meet boxes, and
    every field takes the counts of its box.
    """
    from terralyn.operators.series import ZONES

    key = [*BOX, "crp_lbl"]
    near = kinds.nearest_kinds(pixels, fields, BOX, buffer + gap, size, _apart)
    places, boxes = pixels.groupBy("px", "py").agg(F.count("pixel_id").alias("_n")), fields.groupBy(*key).agg(F.min("id").alias("id"))
    counts = _zoned(places, boxes, near, buffer, gap, size).groupBy(*key).agg(*[F.coalesce(F.sum(F.when(F.col("zone") == z, F.col("_n"))), F.lit(0)).alias(z) for z in ZONES])
    own = fields.select("id", *[F.col(c).alias(f"_{c}") for c in key])
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) if c == "crp_lbl" else F.col(f"_{c}") == F.col(c) for c in key]
    return own.join(counts, [*same]).groupBy(F.col("id").alias("field_id")).agg(*[F.sum(z).alias(z) for z in ZONES])
