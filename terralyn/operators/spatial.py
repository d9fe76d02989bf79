"""Spatial joins as equi-joins on grid cells; exact distances decide after that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a place that one row lists, on average at most.
MEMBERS = 256


def cells(low: Column, high: Column, size: float) -> Column:
    """Numbers of the cells that an interval touches."""
    return F.sequence(F.floor(low / size), F.floor(high / size))


def near_pairs(a: DataFrame, b: DataFrame, reach: float, condition: Column | None = None, spread: bool = False) -> DataFrame:
    """Pairs of points of a and b at most reach apart, once each, with their distance.

    a and b have id, x, y and further columns, named with the prefixes a_ and b_ in the result. Each point of b goes to
    its cell; each point of a to the cells around it, so a pair meets in exactly one cell. spread: cells are dealt to all
    tasks, for few rows that grow after the join; Spark would join small tables in one.
    """
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns])
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    left = left.withColumn("_gx", F.explode(cells(F.col("a_x") - reach, F.col("a_x") + reach, reach))).withColumn("_gy", F.explode(cells(F.col("a_y") - reach, F.col("a_y") + reach, reach)))
    right = right.withColumns({"_gx": F.floor(F.col("b_x") / reach), "_gy": F.floor(F.col("b_y") / reach)})
    if spread:
        parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = left.repartition(parts, "_gx", "_gy"), right.repartition(parts, "_gx", "_gy").hint("merge")
    met = left.join(right, ["_gx", "_gy"])
    squared = (F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2
    met = met.where((squared <= reach * reach) & (condition if condition is not None else F.lit(True)))
    return met.withColumn("distance", F.sqrt(squared)).drop("_gx", "_gy")


def kinds(fields: DataFrame) -> DataFrame:
    """One field (id, x, y, crp_lbl) for each place and known species, the one of the smallest id: the others there have the same neighbours."""
    return fields.where("x is not null and y is not null and crp_lbl is not null").groupBy("x", "y", "crp_lbl").agg(F.min("id").alias("id"))


def _crowds(fields: DataFrame) -> DataFrame:
    """x, y and at most about MEMBERS fields of a place in a list; a place of more has several rows."""
    own = fields.where("x is not null and y is not null")
    slices = own.groupBy("x", "y").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("_slices")).where("_slices > 1")
    nth = F.pmod(F.xxhash64("id"), F.coalesce("_slices", F.lit(1))).alias("_nth")
    one = F.struct(*[c for c in fields.columns if c not in ("x", "y")])
    return own.join(slices, ["x", "y"], "left").groupBy("x", "y", nth).agg(F.collect_list(one).alias("of")).drop("_nth")


def _of_places(fields: DataFrame, reach: float, digits: int | None) -> DataFrame:
    """Pairs of fields of different species, the smaller id first: places meet once either way round, with lists of their fields, and pairs of fields are never shuffled."""
    places = _crowds(fields)
    near = near_pairs(places, places, reach, (F.col("a_x") < F.col("b_x")) | ((F.col("a_x") == F.col("b_x")) & (F.col("a_y") <= F.col("b_y"))), spread=True)
    near = near.withColumn("distance", F.round("distance", digits)) if digits is not None else near
    met = near.withColumn("_p", F.explode("a_of")).withColumn("_q", F.explode("b_of"))
    p, q = F.col("_p"), F.col("_q")
    once = (p["id"] < q["id"]) | ((p["id"] > q["id"]) & ((F.col("a_x") != F.col("b_x")) | (F.col("a_y") != F.col("b_y"))))
    met = met.where((p["crp_lbl"] != q["crp_lbl"]) & once)
    first = p["id"] < q["id"]
    of = lambda n, one, c: F.col(f"{n}_{c}") if c in ("x", "y") else one[c]
    named = [F.when(first, of(n, one, c)).otherwise(of(m, other, c)).alias(f"{n}_{c}") for n, one, m, other in (("a", p, "b", q), ("b", q, "a", p)) for c in fields.columns]
    return met.select(*named, "distance")


def neighbour_pairs(fields: DataFrame, reach: float, limit: int | None = None, digits: int | None = None) -> DataFrame:
    """Fields of different species at most reach apart, the smaller id first; with a limit the nearest ones. digits: of distances, rounded for each pair of places."""
    pairs = _of_places(fields, reach, digits)
    return pairs.orderBy("distance", "a_id", "b_id").limit(limit) if limit else pairs


def neighbour_fields(fields: DataFrame, targets: DataFrame, reach: float) -> DataFrame:
    """Every field at most reach from a target, targets included, once each."""
    found = near_pairs(targets.select("x", "y").distinct(), fields.select("x", "y").distinct(), reach)
    return fields.join(found.select(F.col("b_x").alias("x"), F.col("b_y").alias("y")).distinct(), ["x", "y"], "left_semi").select(*fields.columns).distinct()


def pairs_long(pairs: DataFrame) -> DataFrame:
    """Two rows for each pair, one for each role, from a single scan."""
    side = lambda me, other, role: F.struct(F.lit(role).alias("role_in_pair"), F.col(f"{me}_id").alias("id"), F.col(f"{me}_crp_lbl").alias("crp_lbl"), F.col(f"{other}_id").alias("neighbor_id"), F.col(f"{other}_crp_lbl").alias("neighbor_crp_lbl"))
    pair_id = F.concat_ws("-", F.col("a_id").cast("string"), F.col("b_id").cast("string"))
    return pairs.select(pair_id.alias("pair_id"), "distance", F.explode(F.array(side("a", "b", "species_1"), side("b", "a", "species_2"))).alias("_s")).select("pair_id", "_s.*", "distance")


def overlapping_boxes(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes (minx, miny, maxx, maxy) that share area, with that area; a and b carry an id. A pair counts in the lowest cell that both touch."""
    box = ["minx", "miny", "maxx", "maxy"]

    def spread(df: DataFrame, name: str) -> DataFrame:
        own = df.select(F.col("id").alias(f"{name}_id"), *[F.col(c).alias(f"{name}_{c}") for c in box])
        return own.withColumn("_gx", F.explode(cells(F.col(f"{name}_minx"), F.col(f"{name}_maxx"), size))).withColumn("_gy", F.explode(cells(F.col(f"{name}_miny"), F.col(f"{name}_maxy"), size)))

    wide = F.least("a_maxx", "b_maxx") - F.greatest("a_minx", "b_minx")
    high = F.least("a_maxy", "b_maxy") - F.greatest("a_miny", "b_miny")
    lowest = (F.floor(F.greatest("a_minx", "b_minx") / size) == F.col("_gx")) & (F.floor(F.greatest("a_miny", "b_miny") / size) == F.col("_gy"))
    met = spread(a, "a").join(spread(b, "b"), ["_gx", "_gy"]).where((wide > 0) & (high > 0) & lowest)
    return met.select("a_id", "b_id", (wide * high).alias("area"))


def points_in_squares(points: DataFrame, squares: DataFrame, size: float) -> DataFrame:
    """Points (pixel_id, px, py) inside boxes (id, minx, miny, maxx, maxy), with the distance to the box's edge."""
    spread = squares.withColumn("_gx", F.explode(cells(F.col("minx"), F.col("maxx"), size))).withColumn("_gy", F.explode(cells(F.col("miny"), F.col("maxy"), size)))
    own = points.withColumns({"_gx": F.floor(F.col("px") / size), "_gy": F.floor(F.col("py") / size)})
    met = own.join(spread, ["_gx", "_gy"]).where("px >= minx and px <= maxx and py >= miny and py <= maxy")
    edge = F.least(F.col("px") - F.col("minx"), F.col("maxx") - F.col("px"), F.col("py") - F.col("miny"), F.col("maxy") - F.col("py"))
    return met.withColumn("edge_dist", edge).drop("_gx", "_gy")
