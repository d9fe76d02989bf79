"""Geometries from text: WKT and GeoJSON as arrays of rings, in built-in functions; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of a geometry column, in order.
GEOMETRY_NAMES = ["geometry_wkt", "wkt", "geometry", "geom", "shape", "the_geom"]
RINGS = "array<array<struct<x:double,y:double>>>"


def rings_of_wkt(text: Column) -> Column:
    """Rings of POLYGON or MULTIPOLYGON text, with or without an SRID; null for anything else."""
    plain = F.trim(F.regexp_replace(text, r"^\s*SRID=\d+;", ""))
    parts = F.regexp_extract_all(plain, F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda p: F.filter(F.split(F.trim(p), r"\s+"), lambda w: w != "")
    ring = lambda r: F.transform(F.split(r, ","), lambda p: F.struct(F.get(point(p), F.lit(0)).try_cast("double").alias("x"), F.get(point(p), F.lit(1)).try_cast("double").alias("y")))
    whole = lambda rings: ~F.exists(rings, lambda r: F.exists(r, lambda p: p["x"].isNull() | p["y"].isNull()))
    found = F.transform(F.array(F.transform(parts, ring)), lambda rings: F.when((F.size(rings) > 0) & whole(rings), rings))[0]  # bound, so evaluated once
    return F.when(plain.rlike(r"(?i)^(MULTI)?POLYGON\s*\("), found)


def rings_of_geojson(text: Column) -> Column:
    """Rings of Polygon or MultiPolygon geometries given as JSON text."""
    kind = F.get_json_object(text, "$.type")
    pairs = lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    one = F.from_json(text, "coordinates array<array<array<double>>>")["coordinates"]
    many = F.from_json(text, "coordinates array<array<array<array<double>>>>")["coordinates"]
    return F.when(kind == "Polygon", pairs(one)).when(kind == "MultiPolygon", pairs(F.flatten(many)))


def rings(text: Column) -> Column:
    return F.coalesce(rings_of_wkt(text), rings_of_geojson(text))


def geometry_column(df: DataFrame) -> str | None:
    """The column of a known name that reads as geometry, of any type, in the first row, else the first column that does."""
    names = {c.lower(): c for c in df.columns}
    texts = [c for c, kind in df.dtypes if kind == "string"]
    order = [names[n] for n in GEOMETRY_NAMES if n in names and names[n] in texts]
    order += [c for c in texts if c not in order]
    json = lambda c: F.get_json_object(c, "$.type").isNotNull() & F.get_json_object(c, "$.coordinates").isNotNull()
    first = df.select(*[(rings(F.col(f"`{c}`")).isNotNull() | json(F.col(f"`{c}`"))).alias(f"_{k}") for k, c in enumerate(order)]).limit(1).collect()
    return next((c for k, c in enumerate(order) if first and first[0][k]), None)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of FeatureCollection files: rings, type, crs (named or EPSG:4326) and properties as text by name; other geometry types have null rings."""
    schema = "features array<struct<geometry string, properties map<string,string>>>, crs struct<properties:struct<name:string>>"
    files = spark.read.schema(schema).option("multiLine", True).json(path)
    features = files.select(F.coalesce("crs.properties.name", F.lit("EPSG:4326")).alias("crs"), F.posexplode("features").alias("pos", "f"))
    return features.select("pos", rings_of_geojson(F.col("f.geometry")).alias("rings"), F.get_json_object("f.geometry", "$.type").alias("type"), "crs", F.col("f.properties").alias("props"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of KML files: name, description, the rings of all polygons (each outer one before its holes) and extended data by name."""
    line = "struct<LinearRing:struct<coordinates:string>>"
    polygon = f"array<struct<outerBoundaryIs:{line},innerBoundaryIs:array<{line}>>>"
    schema = f"name string, description string, Polygon {polygon}, MultiGeometry struct<Polygon:{polygon}>, ExtendedData struct<Data:array<struct<_name:string,value:string>>>"
    marks = spark.read.format("xml").schema(schema).option("rowTag", "Placemark").load(path)
    number = lambda t, k: F.get(F.split(t, ","), F.lit(k)).try_cast("double")
    point = lambda t: F.struct(number(t, 0).alias("x"), number(t, 1).alias("y"))
    ring = lambda b: F.transform(F.filter(F.split(F.trim(b["LinearRing"]["coordinates"]), r"\s+"), lambda t: t != ""), point)
    polygons = F.filter(F.concat(F.coalesce("Polygon", F.array().cast(polygon)), F.coalesce("MultiGeometry.Polygon", F.array().cast(polygon))), lambda p: p["outerBoundaryIs"].isNotNull())
    rings = F.flatten(F.transform(polygons, lambda p: F.concat(F.array(ring(p["outerBoundaryIs"])), F.transform(F.coalesce(p["innerBoundaryIs"], F.array().cast(f"array<{line}>")), ring))))
    props = F.map_from_entries(F.transform("ExtendedData.Data", lambda d: F.struct(d["_name"], d["value"])))
    return marks.select("name", "description", F.when(F.size(rings) > 0, rings).alias("rings"), props.alias("props"))
