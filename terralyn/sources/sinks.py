"""Sinks: profile and score tables as CSV, cells as GeoJSON lines, graphs as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, decimals: dict[str, int] | None = None) -> None:
    """CSV with a header; columns named in decimals get that many digits."""
    out = df.select(*[F.format_string(f"%.{decimals[c]}f", F.col(c)).alias(c) if decimals and c in decimals else F.col(c) for c in df.columns])
    out.write.option("header", True).csv(path)


def cell_feature(col: Column, row: Column, east: Column, north: Column, res: Column) -> Column:
    """A grid cell as the JSON text of a GeoJSON feature, its ring closed."""
    corner = lambda x, y: F.array(east + x * res, north + y * res)
    ring = F.array(*[corner(x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(col.alias("col"), row.alias("row")).alias("properties"), geometry.alias("geometry")))


def relabelled_graph(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) with the linked ids numbered from 0 in order of the id."""
    from terralyn.operators.relational import numbered

    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    number = numbered(nodes, "id", "k")
    own = edges.join(number.select(F.col("id").alias("src"), F.col("k").alias("a")), "src").join(number.select(F.col("id").alias("dst"), F.col("k").alias("b")), "dst")
    return own.select("a", "b")
