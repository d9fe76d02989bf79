"""Boundary pixels by their place among blobs of pure pixels in a plane of two components, and the bridge between species."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralyn.operators import stats
from terralyn.operators.cluster import kmeans
from terralyn.operators.matrix import principal_axes, project, squared_distance

#: Members of a blob, pure rows and species of a bridge model, clusters of a species, components; share of a default threshold.
LEAST_MEMBERS, LEAST_ROWS, LEAST_SPECIES, CLUSTERS, COMPONENTS, SHARE = 4, 20, 2, 4, 3, 0.6


def circles(placed: DataFrame) -> DataFrame:
    """cluster, cx, cy, r of the blobs of rows (x, y, cluster): two deviations along the widest axis; -1 is noise, few members no blob."""
    own = placed.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_samp("x").alias("a"), F.var_samp("y").alias("d"), F.covar_samp("x", "y").alias("b")).where(F.col("n") >= LEAST_MEMBERS)
    widest = (F.col("a") + F.col("d")) / 2 + F.hypot((F.col("a") - F.col("d")) / 2, F.col("b"))
    return own.select("cluster", "cx", "cy", (2 * F.sqrt(F.greatest(F.lit(1e-9), widest))).alias("r"))


def held_circles(found: DataFrame, most: int = 100) -> DataFrame:
    """One row with all circles and the links between their centres; an error where there are too many to meet every row."""
    if found.limit(most + 1).count() > most:
        raise ValueError("too many blobs to meet every row")
    held = found.agg(F.array_sort(F.collect_list(F.struct("cluster", "cx", "cy", "r"))).alias("blobs"), F.avg("r").alias("corridor"))
    link = lambda a, b: F.struct(a["cx"].alias("x"), a["cy"].alias("y"), (b["cx"] - a["cx"]).alias("dx"), (b["cy"] - a["cy"]).alias("dy"))
    links = F.flatten(F.transform("blobs", lambda a, i: F.transform(F.slice("blobs", i + 2, F.size("blobs")), lambda b: link(a, b))))
    return held.select("blobs", links.alias("links"), "corridor")


def _perpendicular(x: Column, y: Column, s: Column) -> Column:
    """Distance to a link where the foot lies on it, else null."""
    length = s["dx"] * s["dx"] + s["dy"] * s["dy"]
    length = F.when(length == 0, 1e-9).otherwise(length)
    foot = F.transform(F.array(((x - s["x"]) * s["dx"] + (y - s["y"]) * s["dy"]) / length), lambda t: F.when(t.between(0, 1), F.hypot(x - s["x"] - t * s["dx"], y - s["y"] - t * s["dy"])))
    return foot[0]


def boundary_gaps(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (id, x, y) with gap, the distance to the nearest circle's edge (negative inside), corridor, that to the nearest
    link which the row projects onto, null where there is none, and flagged: outside all circles and within a mean radius of a link.

    The circles come in one row for all, so rows are not shuffled.
    """
    own = rows.crossJoin(F.broadcast(held_circles(found).withColumnRenamed("corridor", "_most")))
    x, y = F.col("x"), F.col("y")
    gap = F.array_min(F.transform("blobs", lambda b: F.hypot(x - b["cx"], y - b["cy"]) - b["r"]))
    corridor = F.array_min(F.transform("links", lambda s: _perpendicular(x, y, s)))
    out = own.withColumns({"gap": gap, "corridor": corridor}).where("gap is not null")
    return out.withColumn("flagged", F.coalesce((F.col("gap") > 0) & (F.col("corridor") <= F.col("_most")), F.lit(False))).drop("blobs", "links", "_most")


def default_threshold(scores: DataFrame, column: str = "distance") -> DataFrame:
    """One row, threshold: the score at place floor(SHARE n) of the order."""
    return stats.floor_percentile(scores.withColumn("_all", F.lit(1)), ["_all"], column, SHARE).select(F.col("percentile").alias("threshold"))


def bridge_model(pure: DataFrame, clusters: int = CLUSTERS, most: int = 10_000) -> tuple | None:
    """Mean, axes and one row of pure clusters (species, c) in component space, of complete interior rows (id, species, v).

    None with fewer than LEAST_ROWS rows, LEAST_SPECIES species or two dates, as the bridge is between species.
    """
    own = pure.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))).select("id", F.coalesce(F.col("species").cast("string"), F.lit("unknown")).alias("species"), F.col("v").cast("array<double>").alias("v"))
    facts = own.agg(F.count("*").alias("n"), F.countDistinct("species").alias("species"), F.max(F.size("v")).alias("width")).first()
    if facts["n"] < LEAST_ROWS or facts["species"] < LEAST_SPECIES or facts["width"] < 2:
        return None
    mean, axes, _ = principal_axes(own, min(COMPONENTS, facts["width"]))
    placed = project(own, mean, axes).select("id", "species", F.col("scores").alias("v"))
    members = placed.join(kmeans(placed, "species", clusters, rounds=20, restarts=1, most=most).withColumnRenamed("species", "_s").select("id", "cluster"), "id")
    centres = members.groupBy("species", "cluster").agg(*[F.avg(F.col("v")[i]).alias(f"_{i}") for i in range(len(axes))])
    held = centres.agg(F.array_sort(F.collect_list(F.struct("species", "cluster", F.array(*[F.col(f"_{i}") for i in range(len(axes))]).alias("c")))).alias("pure"))
    return mean, axes, held


def bridge(cells: DataFrame, model: tuple, vector: str = "values") -> DataFrame:
    """Cells with bridge: 1 midway on the line between the nearest pure cluster and the nearest one of another species, 0 at
    either end and towards 0 off the line."""
    mean, axes, held = model
    own = project(cells, mean, axes, vector).crossJoin(F.broadcast(held))
    far = lambda m: F.struct(squared_distance(F.col("scores"), m["c"]).alias("d"), m["species"].alias("species"), m["cluster"].alias("cluster"), m["c"].alias("c"))
    own = own.withColumn("_a", F.array_min(F.transform("pure", far)))
    own = own.withColumn("_b", F.array_min(F.transform(F.filter("pure", lambda m: m["species"] != F.col("_a.species")), far)))
    length = squared_distance(F.col("_a.c"), F.col("_b.c"))
    way = F.aggregate(F.zip_with(F.zip_with("scores", "_a.c", lambda p, a: p - a), F.zip_with("_b.c", "_a.c", lambda b, a: b - a), lambda p, d: p * d), F.lit(0.0), lambda s, v: s + v)
    own = own.withColumn("_l", length).withColumn("_t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), way / F.when(F.col("_l") > 0, F.col("_l")))))
    foot = F.zip_with("_a.c", "_b.c", lambda a, b: a + F.col("_t") * (b - a))
    off = F.sqrt(squared_distance(F.col("scores"), foot))
    score = (1 - F.abs(2 * F.col("_t") - 1)) * F.sqrt("_l") / (F.sqrt("_l") + 2 * off)
    return own.withColumn("bridge", F.coalesce(score, F.lit(0.0))).drop("scores", "pure", "_a", "_b", "_l", "_t")
