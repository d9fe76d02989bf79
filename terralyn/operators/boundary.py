"""Boundaries from imagery: gradients of a raster in long form, distances to pure species, and how well they tell edges.

A raster has rows (row, col, date, value); a cell is usable when it has a value on every date of the raster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralyn.operators import blocks, stats
from terralyn.operators.matrix import minus
from terralyn.operators.relational import numbered
from terralyn.sources.scratch import cut

#: Rows of a grid at most, and room under it.
STRIDE = 1 << 20
#: Rows that meet a slice of reference vectors at a time; bounds a Python worker's memory.
ROWS = 256
#: Pairs of pixels that one step compares.
PAIRS = 1 << 20
#: Sobel's weights across and down by offset.
ACROSS = {(dy, dx): dx * (2 if dy == 0 else 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
DOWN = {(dy, dx): dy * (2 if dx == 0 else 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}


def usable(raster: DataFrame) -> DataFrame:
    """row, col, values: the cells that have a finite value on every date, their values in order of date."""
    good = raster.where(F.col("value").isNotNull() & ~F.isnan("value"))
    dates = raster.agg(F.countDistinct("date").alias("_dates"))
    cells = good.groupBy("row", "col").agg(F.countDistinct("date").alias("_n"), F.array_sort(F.collect_list(F.struct("date", "value"))).alias("_v"))
    return cells.crossJoin(F.broadcast(dates)).where("_n = _dates").select("row", "col", F.transform("_v", lambda s: s["value"]).alias("values"))


def gradient(cells: DataFrame) -> DataFrame:
    """row, col, gradient: the root of the squared Sobel responses of all dates; only cells whose eight neighbours are usable.

    Every cell is sent to the nine cells that it helps, so one aggregate replaces nine self-joins.
    """
    parts = [F.struct((F.col("row") - dy).alias("row"), (F.col("col") - dx).alias("col"), F.lit(float(ACROSS[dy, dx])).alias("x"), F.lit(float(DOWN[dy, dx])).alias("y")) for dy, dx in ACROSS]
    sent = cells.select("values", F.explode(F.array(*parts)).alias("to")).select("to.*", F.posexplode("values").alias("t", "v"))
    sums = sent.groupBy("row", "col", "t").agg(F.sum(F.col("v") * F.col("x")).alias("gx"), F.sum(F.col("v") * F.col("y")).alias("gy"), F.count("*").alias("n")).where("n = 9")
    return sums.groupBy("row", "col").agg(F.sqrt(F.sum(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("gradient"))


def impurity(cells: DataFrame, pure: DataFrame) -> DataFrame:
    """row, col, impurity: the distance to the nearest of at most 10,000 mean curves (mean array<double>), held in one row."""
    if pure.limit(10_001).count() > 10_000:
        raise ValueError("too many mean curves to meet every cell")
    means = pure.agg(F.collect_list("mean").alias("_means"))
    apart = lambda m: F.aggregate(F.zip_with("values", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return cells.crossJoin(F.broadcast(means)).select("row", "col", F.sqrt(F.array_min(F.transform("_means", apart))).alias("impurity"))


def scaled(scores: DataFrame, column: str) -> DataFrame:
    """A score over its 98th percentile, from 0 to 1; unchanged where that is not positive."""
    top = stats.floor_percentile(scores.where(F.col(column).isNotNull()).withColumn("_all", F.lit(1)), ["_all"], column, 0.98)
    own = scores.crossJoin(F.broadcast(top.select(F.col("percentile").alias("_top"))))
    share = F.col(column) / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)
    return own.withColumn(column, F.when(F.col(column).isNotNull(), F.least(F.lit(1.0), share))).drop("_top")


def prediction(raster: DataFrame, inside: DataFrame, truth: DataFrame, pure: DataFrame) -> DataFrame:
    """row, col, label and the scaled scores gradient and impurity of the usable cells inside a field.

    inside, truth: row, col of cells in fields and of boundary cells; pure: mean curves of species.
    """
    cells = usable(raster)
    own = cells.join(inside.select("row", "col").distinct(), ["row", "col"], "left_semi")
    label = truth.select("row", "col").distinct().withColumn("_true", F.lit(1))
    out = own.join(label, ["row", "col"], "left").select("row", "col", F.coalesce("_true", F.lit(0)).alias("label"))
    out = out.join(gradient(cells), ["row", "col"], "left").join(impurity(own, pure), ["row", "col"], "left")
    return scaled(scaled(out, "gradient"), "impurity")


def stacked(cells: DataFrame) -> DataFrame:
    """Grids (grid, row, col) as one raster, one under the other with room between, so that no cell has a neighbour in another grid."""
    return cells.withColumn("row", F.col("grid") * STRIDE + F.col("row")).drop("grid")


def predictions(raster: DataFrame, inside: DataFrame, edges: DataFrame, outlines: DataFrame, pure: DataFrame | None = None, model: tuple | None = None) -> DataFrame:
    """grid, row, col, label and the scores of the usable cells of several grids inside fields; a score's scale is that of all grids.

    raster: (grid, row, col, date, value). Boundary cells are the cells of edge pixels between species, or outlines where
    there are none. impurity needs mean curves, bridge a model of blobs.bridge_model; without them they are null.
    """
    from terralyn.operators.blobs import bridge

    truth = edges if edges.limit(1).count() else outlines
    cells = cut(usable(stacked(raster)))
    own = cells.join(stacked(inside).select("row", "col").distinct(), ["row", "col"], "left_semi")
    label = stacked(truth).select("row", "col").distinct().withColumn("_true", F.lit(1))
    out = own.join(label, ["row", "col"], "left").select("row", "col", F.coalesce("_true", F.lit(0)).alias("label")).join(gradient(cells), ["row", "col"], "left")
    scores = {"impurity": impurity(own, pure) if pure is not None else None, "bridge": bridge(own, model).select("row", "col", "bridge") if model is not None else None}
    for name, score in scores.items():
        out = out.join(score, ["row", "col"], "left") if score is not None else out.withColumn(name, F.lit(None).cast("double"))
    out = cut(out)
    for name in ("gradient", "impurity", "bridge"):
        if scores.get(name, 0) is not None:
            out = scaled(out, name)
    return out.select(F.floor(F.col("row") / STRIDE).alias("grid"), (F.col("row") % STRIDE).alias("row"), "col", "label", "gradient", "impurity", "bridge")


def nearest_noise(pixels: DataFrame, reach: float) -> DataFrame:
    """id and nearest: each pixel's nearest other pixel (id, x, y) in the cells around it; the smaller id on ties.

    Pixels at one place are one place; a search is needed only for places of a single pixel.
    """
    own = pixels.select("id", "x", "y").where("x is not null and y is not null")
    places = own.groupBy("x", "y").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    shared = own.join(places.where("lo <> hi"), ["x", "y"])
    second = shared.where("id <> lo").groupBy("x", "y").agg(F.min("id").alias("next"))
    together = shared.where("id <> lo").select("id", F.col("lo").alias("nearest"))
    together = together.unionByName(places.join(second, ["x", "y"]).select(F.col("lo").alias("id"), F.col("next").alias("nearest"))).withColumn("distance", F.lit(0.0))
    held = places.withColumns({"_gx": F.floor(F.col("x") / reach), "_gy": F.floor(F.col("y") / reach)})
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    asked = held.where("lo = hi").select(F.col("lo").alias("id"), "x", "y", near("_gx").alias("_gx"), "_gy").select("id", "x", "y", "_gx", near("_gy").alias("_gy"))

    def judge(others, own):
        others = others.take(pc.sort_indices(others.field("id")))  # of equal distances the first is taken
        values = lambda rows: [rows.field(c).to_numpy(zero_copy_only=False) for c in ("id", "x", "y")]
        (a, ax, ay), (b, bx, by) = values(others), values(own)
        step = max(1, PAIRS // max(1, len(a)))
        for at in range(0, len(b), step):
            to = slice(at, at + step)
            squared = np.where(a[None] != b[to, None], (bx[to, None] - ax[None]) ** 2 + (by[to, None] - ay[None]) ** 2, np.inf)
            squared[np.isnan(squared)] = np.inf
            k = squared.argmin(axis=1)
            d = squared[np.arange(len(k)), k]
            use = np.isfinite(d)
            yield pa.RecordBatch.from_arrays([own.field("id").slice(at, len(k)).filter(pa.array(use)), pa.array(d[use]), others.field("id").take(pa.array(k[use]))], ["id", "d", "nearest"])

    kind = pixels.schema["id"].dataType.simpleString()
    met = blocks.met(held.select(F.col("lo").alias("id"), "x", "y", "_gx", "_gy"), asked, ["_gx", "_gy"], judge, f"id {kind}, d double, nearest {kind}")
    found = met.groupBy("id").agg(F.min(F.struct("d", "nearest")).alias("_b"))
    return found.select("id", "_b.nearest", F.sqrt("_b.d").alias("distance")).unionByName(together)


def noise_differences(pixels: DataFrame, reach: float) -> DataFrame:
    """v: each pixel (id, x, y, v) less its nearest one within the cells around it; where no pixel has one, less the pixel before it by id."""
    own = pixels.select("id", "v")
    near = cut(nearest_noise(pixels, reach).select("id", "nearest"))
    if not near.limit(1).count():
        ranks = numbered(pixels.select("id", "v"), "id", "_n")
        near = ranks.select("id", F.col("_n").alias("_k")).join(ranks.select((F.col("_n") + 1).alias("_k"), F.col("id").alias("nearest")), "_k").select("id", "nearest")
    other = own.select(F.col("id").alias("nearest"), F.col("v").alias("_v"))
    return near.join(own, "id").join(other, "nearest").select(minus(F.col("v"), F.col("_v")).alias("v"))


def mean_nearest(rows: DataFrame, reference: DataFrame, k: int = 4) -> DataFrame:
    """id and the mean distance to the k nearest of the reference vectors (one column, v); null without vectors of that length.

    Slices of the reference, equal vectors counted, meet all rows by matrix products; each passes on a row's k nearest. What
    a product cannot tell apart is measured by differences.
    """
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    asked = rows.select("id", F.col("v").cast("array<double>").alias("v"))
    held = reference.select(F.col("v").cast("array<double>").alias("v")).where(whole).groupBy("v").agg(F.count("*").alias("n"))
    held = held.select(F.size("v").alias("_width"), "v", "n").where("_width > 0")
    own = asked.where(whole).distinct().select(F.size("v").alias("_width"), F.col("id"), F.xxhash64("v").alias("h"), "v")
    kind = rows.schema["id"].dataType.simpleString()

    def near(a, b):
        ref, n = blocks.matrix_of(a.field("v")), a.field("n").to_numpy()
        for at in range(0, len(b), ROWS):
            part = b.slice(at, ROWS)
            x = blocks.matrix_of(part.field("v"))
            middle = ref.mean(axis=0)  # about the middle, so that large coordinates cancel
            y, z = x - middle, ref - middle
            xx, zz = (y * y).sum(axis=1), (z * z).sum(axis=1)
            far = xx[:, None] - 2 * y @ z.T + zz[None, :]
            far = np.where(np.isnan(far), np.inf, far)
            most = min(k, len(ref))
            least = np.partition(far, most - 1, axis=1)[:, most - 1] + 1e-12 * (xx + zz.max())
            row, col = np.nonzero((far <= least[:, None]) | ~np.isfinite(least)[:, None])
            exact = np.empty(len(row))
            for j in range(0, len(row), 1 << 16):
                way = x[row[j : j + (1 << 16)]] - ref[col[j : j + (1 << 16)]]
                exact[j : j + (1 << 16)] = np.sqrt((way * way).sum(axis=1))
            order = np.lexsort((exact, row))
            row, col, exact = row[order], col[order], exact[order]
            starts = np.searchsorted(row, np.arange(len(x)))
            use = np.arange(len(row)) - starts[row] < k
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[use], minlength=len(x)))]).astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array(exact[use]), pa.array(n[col[use]])], ["d", "n"])
            yield pa.RecordBatch.from_arrays([part.field("id"), part.field("h"), pa.ListArray.from_arrays(pa.array(ends), found)], ["id", "h", "near"])

    found = blocks.met(held, own, ["_width"], near, f"id {kind}, h long, near array<struct<d: double, n: long>>")
    best = found.groupBy("id", "h").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("_d"))
    copies = F.flatten(F.transform("_d", lambda s: F.array_repeat(s["d"], F.least(s["n"], F.lit(k)).cast("int"))))
    mean = F.transform(F.array(F.slice(copies, 1, k)), lambda d: F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d))[0]
    return asked.select("id", F.xxhash64("v").alias("h")).join(best.select("id", "h", mean.alias("distance")), ["id", "h"], "left").select("id", "distance")
