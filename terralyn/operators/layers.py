"""Imported layers: a status for every feature, what a layer is measured in, its signature, and grids for features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralyn.functions import geometry, labels
from terralyn.operators import stats
from terralyn.operators.spatial import cells
from terralyn.sources.scratch import cut

#: Plots of a layer at most, size of a plot that tells degrees from metres, span of an assumed layer of degrees.
MOST_PLOTS, SPLIT, MOST_SPAN = 5000, 0.1, 60.0
STATUSES = ["ok", "none", "other", "invalid", "empty"]
#: Rows of a plan whose digests are joined at a time.
CHUNK = 4096


def statuses(features: DataFrame) -> DataFrame:
    """Features (id, kind, polygons array<array<ring>>, outlines first) with rings, status, dropped and diagonal.

    rings are the clean ones; status is none without a geometry, other for no polygon, invalid with a missing or infinite
    coordinate, empty without a clean outline, else ok. A hole goes with its outline; a geometry of nothing counts as one
    dropped ring. diagonal is that of the first clean outline's box, as it came.
    """
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    points = F.flatten(F.flatten(F.col("polygons")))
    own = features.withColumn("_bad", F.coalesce(F.exists(points, lambda p: bad(p["x"]) | bad(p["y"])), F.lit(False)))
    clean = F.transform("polygons", lambda p: F.transform(p, lambda r: F.struct(r.alias("raw"), geometry.clean_ring(r).alias("ring"))))
    own = own.withColumn("_c", F.when(F.col("kind").isin("Polygon", "MultiPolygon") & ~F.col("_bad"), clean))
    kept = F.flatten(F.transform(F.filter("_c", lambda p: (F.size(p) > 0) & p[0]["ring"].isNotNull()), lambda p: F.filter(p, lambda r: r["ring"].isNotNull())))
    total = F.aggregate("_c", F.lit(0), lambda s, p: s + F.greatest(F.size(p), F.lit(1)))
    outline = F.filter("_c", lambda p: (F.size(p) > 0) & p[0]["ring"].isNotNull())
    own = own.withColumns({"rings": F.transform(kept, lambda r: r["ring"]), "_n": F.size(kept), "_total": total, "_box": geometry.envelope(F.get(outline, F.lit(0))[0]["raw"])})
    status = F.when(F.col("kind").isNull(), "none").when(~F.col("kind").isin("Polygon", "MultiPolygon"), "other").when(F.col("_bad"), "invalid").when(F.coalesce("_n", F.lit(0)) == 0, "empty").otherwise("ok")
    dropped = F.when(F.col("_c").isNotNull(), F.when((F.col("_total") == 0) & (F.coalesce("_n", F.lit(0)) == 0), 1).otherwise(F.col("_total") - F.coalesce("_n", F.lit(0)))).otherwise(0)
    diagonal = F.hypot(F.col("_box.maxx") - F.col("_box.minx"), F.col("_box.maxy") - F.col("_box.miny"))
    return own.withColumns({"status": status, "dropped": dropped, "diagonal": F.when(status == "ok", diagonal)}).drop("_bad", "_c", "_n", "_total", "_box")


def layer_facts(checked: DataFrame) -> DataFrame:
    """One row of a layer's statuses: features of each status, dropped rings, median diagonal, and unit.

    The unit is degrees where all clean coordinates lie on the globe, within a span of MOST_SPAN, and the median plot is
    at most SPLIT wide, else metres; null without a plot.
    """
    boxes = cut(checked.select("status", "dropped", "diagonal", F.when(F.col("status") == "ok", geometry.envelope(F.flatten("rings"))).alias("_b")))
    own = boxes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.sum("dropped").alias("dropped"), F.min("_b.minx").alias("x0"), F.max("_b.maxx").alias("x1"), F.min("_b.miny").alias("y0"), F.max("_b.maxy").alias("y1"))
    middle = stats.floor_percentile(boxes.withColumn("_all", F.lit(1)), ["_all"], "diagonal", 0.5).agg(F.max("percentile").alias("median"))
    globe = (F.col("x0") >= -180) & (F.col("x1") <= 180) & (F.col("y0") >= -90) & (F.col("y1") <= 90) & (F.col("x1") - F.col("x0") <= MOST_SPAN) & (F.col("y1") - F.col("y0") <= MOST_SPAN)
    unit = F.when(F.col("ok") > 0, F.when(globe & (F.col("median") <= SPLIT), "degrees").otherwise("metres"))
    return own.crossJoin(F.broadcast(middle)).select(*STATUSES, "dropped", "median", unit.alias("unit"))


def checked_layer(features: DataFrame, most: int = MOST_PLOTS) -> tuple[DataFrame, list[str]]:
    """The usable plots (id, rings, further columns) and what to warn of; an error where there is none or there are too many."""
    checked = statuses(features)
    facts = layer_facts(checked).first()
    said = {"none": "without geometry", "other": "not a polygon", "invalid": "with invalid coordinates", "empty": "empty or degenerate"}
    warnings = [f"{facts[s]} {text}" for s, text in said.items() if facts[s]] + ([f"{facts['dropped']} rings dropped"] if facts["dropped"] else [])
    if not facts["ok"]:
        raise ValueError("no usable plot polygons" + (f" ({'; '.join(warnings)})" if warnings else ""))
    if facts["ok"] > most:
        raise ValueError(f"{facts['ok']} plots; at most {most} can be imported")
    return checked.where("status = 'ok'").drop("kind", "polygons", "status", "dropped", "diagonal"), warnings


def plan_signatures(rows: DataFrame, plan: str, position: str, tokens: Column) -> DataFrame:
    """plan, signature: a fingerprint of all rows of each plan in the order of position, however they are partitioned.

    Rows are digested by themselves, digests in chunks of CHUNK positions, and chunks by plan, so no task holds a plan's rows.
    """
    own = rows.select(plan, F.col(position).alias("_at"), labels.signature(tokens).alias("_d"))
    whole = lambda: labels.signature(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_d"))), lambda s: F.concat_ws(":", s["_at"].cast("string"), s["_d"])))
    chunks = own.groupBy(plan, F.floor(F.col("_at") / CHUNK).alias("_c")).agg(whole().alias("_d")).withColumnRenamed("_c", "_at")
    return chunks.groupBy(plan).agg(whole().alias("signature"))


def grids_for(features: DataFrame, grids: DataFrame, size: float, most: int = 10_000) -> DataFrame:
    """id, layer, grid: for every feature's box and every layer all analysis grids that meet the box, else the layer's preview.

    grids: (layer, grid, preview, minx, miny, maxx, maxy). Boxes meet over cells of a size; a feature that no analysis grid of
    a layer meets takes the preview, which comes from one checked row with the layers. A layer without either gives no row.
    Grids of one layer and box are met as one and told apart last; a grid has one box.
    """
    layers = grids.groupBy("layer").agg(F.min(F.when(F.col("preview"), F.col("grid"))).alias("grid"))
    if layers.limit(most + 1).count() > most:
        raise ValueError("too many layers to meet every feature")
    over = lambda df: df.withColumn("_gx", F.explode(cells(F.col("minx"), F.col("maxx"), size))).withColumn("_gy", F.explode(cells(F.col("miny"), F.col("maxy"), size)))
    box = ["minx", "miny", "maxx", "maxy"]
    kind = F.struct("layer", *box).alias("_kind")
    asked = over(features.select("id", *box)).select("id", "_gx", "_gy", F.struct(*box).alias("a"))
    held = over(grids.where("not preview").select("layer", *box).distinct()).select(kind, "_gx", "_gy", F.struct(*box).alias("b"))
    meet = (F.col("a.minx") <= F.col("b.maxx")) & (F.col("b.minx") <= F.col("a.maxx")) & (F.col("a.miny") <= F.col("b.maxy")) & (F.col("b.miny") <= F.col("a.maxy"))
    hits = asked.join(held, ["_gx", "_gy"]).where(meet).select("id", F.col("_kind.layer").alias("layer"), "_kind").distinct()
    every = features.select("id").crossJoin(F.broadcast(layers.agg(F.collect_list(F.struct("layer", "grid")).alias("_l")))).select("id", F.explode("_l").alias("_l")).select("id", "_l.layer", F.col("_l.grid").alias("_preview"))
    placed = cut(every.join(hits, ["id", "layer"], "left"))
    held = placed.where("_kind is not null").join(grids.where("not preview").select(kind, "grid").distinct(), "_kind").select("id", "layer", F.coalesce("grid", "_preview").alias("grid"))
    return held.unionByName(placed.where("_kind is null").select("id", "layer", F.col("_preview").alias("grid"))).where("grid is not null")
