"""Fields from the rows of any query: the geometry column is found, rows are normalised, and errors say what is missing."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralyn.operators.relational import first_per_id, numbered
from terralyn.sources.geometry_text import geometry_column, rings
from terralyn.sources.scratch import cut


class Polygons(NamedTuple):
    """fields: pid, rings and the attributes; attributes: their names; skipped: rows without a polygon."""

    fields: DataFrame
    attributes: list[str]
    skipped: int


def load_polygons(rows: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None, key: str = "NewID") -> Polygons:
    """Polygons and multipolygons of rows with WKT or GeoJSON text, numbered from 0 in their order.

    Rows that share an id under key, such as a field in several pairs, are one field: the first stays. Rows without an
    id, or with an empty one, are all kept. keep filters the rows first.
    """
    own = cut(rows.withColumn("_at", F.monotonically_increasing_id()))
    if not own.limit(1).count():
        raise ValueError("the query returned no rows")
    if keep is not None:
        own = cut(own.transform(keep))
        if not own.limit(1).count():
            raise ValueError("no row is left by the filter: raise the neighbour distance or pick species that border each other")
    column = geometry_column(own.drop("_at"))
    if column is None:
        raise ValueError("no geometry column found: return a WKT column, such as ST_AsText(geometry) AS geometry_wkt")
    attributes = [c for c in own.columns if c not in (column, "_at")]
    read = cut(own.withColumn("_rings", rings(F.col(f"`{column}`"))))
    skipped = read.where("_rings is null").count()
    polygons = read.where("_rings is not null").select("_at", F.col("_rings").alias("rings"), *[F.col(f"`{c}`") for c in attributes])
    if not polygons.limit(1).count():
        raise ValueError("the query returned rows, but none with a polygon")
    if key in attributes:
        named = polygons.withColumn("_id", F.when(F.trim(F.col(f"`{key}`").cast("string")) != "", F.col(f"`{key}`").cast("string")))
        polygons = first_per_id(named, "_id", "_at").drop("_id")
    return Polygons(numbered(polygons, "_at", "pid").select(F.col("pid").cast("long").alias("pid"), "rings", *[F.col(f"`{c}`") for c in attributes]), attributes, skipped)
