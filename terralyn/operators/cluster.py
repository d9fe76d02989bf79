"""Clusters of growth curves and of points, as iterated aggregates; no task sees a whole species."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from terralyn.operators.blocks import met
from terralyn.operators.graph import components
from terralyn.operators.stats import floor_percentile
from terralyn.sources.scratch import cut


#: Rows of sums that the driver adds up at most.
SENT = 1 << 15
Means = dict[object, np.ndarray]  # of each group: restarts x clusters x width; NaN where a cluster is not yet there


def _matrices(group: str, batches):
    """(group, places in the batch, batch, matrix of v) of the rows of each group in each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("v")
        values = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        names = batch.column(group).to_pylist()
        places: dict[object, list[int]] = {}
        for k, name in enumerate(names):
            places.setdefault(name, []).append(k)
        for name, own in places.items():
            yield name, np.array(own), batch, values[own]


def _squared(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Squared distances, rows x restarts x clusters; infinite to clusters that are not there."""
    restarts, k, width = means.shape
    flat = means.reshape(-1, width)
    there = ~np.isnan(flat[:, 0])
    out = np.full((len(x), restarts * k), np.inf)
    middle = x.mean(axis=0)  # about the rows' middle, so that large coordinates cancel
    y, m = x - middle, flat[there] - middle
    out[:, there] = np.maximum(0.0, (y * y).sum(axis=1)[:, None] - 2 * y @ m.T + (m * m).sum(axis=1)[None, :])
    return out.reshape(len(x), restarts, k)


def _drawn(rows: DataFrame, group: str, means: Means, n: int, restarts: int) -> DataFrame:
    """group, restart and the vector that each restart draws as its nth mean, in proportion to squared distances.

    A draw is the least of -log(u) / d2, with u from a hash of id, restart and n, which favours rows as the distances do
    and is the same in every run; each task passes on one row for each group and restart.
    """
    kind, own_type = rows.schema[group].dataType.simpleString(), to_arrow_type(rows.schema[group].dataType)

    def run(batches):
        best: dict[tuple, tuple] = {}
        for name, own, batch, x in _matrices(group, batches):
            far = _squared(x, means[name]).min(axis=2) if name in means else np.ones((len(x), restarts))
            hashes = batch.column("hash").to_numpy()[own].view(np.uint64)
            for r in range(restarts):
                u = (_mixed(hashes + np.uint64(((r * 1_000_003 + n + 1) * _GOLDEN) % (1 << 64))) >> np.uint64(11)).astype(float)
                with np.errstate(divide="ignore"):
                    score = np.where(far[:, r] > 0, -np.log((u + 1) / (2.0**53 + 1)) / far[:, r], np.inf)
                k = int(score.argmin())
                if np.isfinite(score[k]) and ((name, r) not in best or (score[k], hashes[k]) < best[name, r][:2]):
                    best[name, r] = score[k], hashes[k], x[k].tolist()
        if best:
            columns = [pa.array([g for g, _ in best], own_type), pa.array([r for _, r in best], pa.int32()), pa.array([float(b[0]) for b in best.values()]), pa.array([b[2] for b in best.values()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [group, "restart", "score", "v"])

    found = rows.mapInArrow(run, f"`{group}` {kind}, restart int, score double, v array<double>")
    return found.groupBy(group, "restart").agg(F.min(F.struct("score", "v"))["v"].alias("v"))


_GOLDEN = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _summed(rows: DataFrame, group: str, means: Means, parts: int) -> dict[tuple, list]:
    """(group, restart, cluster): members, sum of squared distances and of vectors.

    Each task adds up its own rows. What tasks have is added by the driver where that is SENT rows at most, else by a shuffle first.
    """
    kind, own_type = rows.schema[group].dataType.simpleString(), to_arrow_type(rows.schema[group].dataType)
    schema = f"`{group}` {kind}, restart int, cluster int, n double, d double, s array<double>"

    def send(sums):
        if sums:
            keys, values = zip(*sums.items(), strict=True)
            columns = [pa.array([k[0] for k in keys], own_type), *[pa.array([k[j] for k in keys], pa.int32()) for j in (1, 2)], *[pa.array([float(v[j]) for v in values]) for j in (0, 1)], pa.array([v[2].tolist() for v in values], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [group, "restart", "cluster", "n", "d", "s"])

    def run(batches):
        sums: dict[tuple, list] = {}
        for name, _, _, x in _matrices(group, batches):
            if name not in means:
                continue
            far = _squared(x, means[name])
            near = far.argmin(axis=2)
            for r in range(far.shape[1]):
                if np.isinf(far[0, r]).all():
                    continue
                member = np.zeros((far.shape[2], len(x)))
                member[near[:, r], np.arange(len(x))] = 1.0
                least, total = member * far[:, r].min(axis=1), member @ x
                for c in np.unique(near[:, r]).tolist():
                    own = sums.setdefault((name, r, c), [0.0, 0.0, np.zeros(x.shape[1])])
                    own[0], own[1], own[2] = own[0] + member[c].sum(), own[1] + least[c].sum(), own[2] + total[c]
        yield from send(sums)

    def add(batches):
        sums: dict[tuple, list] = {}
        for batch in batches:
            for g, r, c, n, d, v in zip(*(batch.column(k).to_pylist() for k in (group, "restart", "cluster", "n", "d", "s")), strict=True):
                own = sums.setdefault((g, r, c), [0.0, 0.0, np.zeros(len(v))])
                own[0], own[1], own[2] = own[0] + n, own[1] + d, own[2] + np.array(v)
        yield from send(sums)

    sums = rows.mapInArrow(run, schema)
    rows_sent = parts * sum(m.shape[0] * m.shape[1] for m in means.values())
    out: dict[tuple, list] = {}
    for g, r, c, n, d, v in (sums if rows_sent <= SENT else sums.repartition(group, "restart", "cluster").mapInArrow(add, schema)).collect():
        own = out.setdefault((g, r, c), [0.0, 0.0, np.zeros(len(v))])
        own[0], own[1], own[2] = own[0] + n, own[1] + d, own[2] + np.array(v)
    return out


def kmeans(rows: DataFrame, group: str, k: int, rounds: int = 100, restarts: int = 8, most: int = 20_000) -> DataFrame:
    """group, id, cluster of rows (group, id, v), renumbered by size from 0: of several restarts the one of the least inertia.

    Rows without a vector are left out; a group of fewer different rows than k has as many clusters as those; a cluster
    that loses its rows keeps its mean. Each pass reads the rows once and adds up their sums by matrix products; only
    means, at most `most` of them, come to the driver and go to the tasks. A restart whose means rest is left out of later passes.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = cut(rows.where("v is not null").select(group, "id", F.col("v").cast("array<double>").alias("v"), F.xxhash64("id").alias("hash")).repartition(parts, "id"))
    limit = most // (restarts * k)
    if own.select(group).distinct().limit(limit + 1).count() > limit:
        raise ValueError("too many groups, restarts and clusters to meet every row")
    means: Means = {}
    for n in range(k):
        for name, r, v in _drawn(own, group, means, n, restarts).collect():
            means.setdefault(name, np.full((restarts, k, len(v)), np.nan))[r, n] = v
    rests: set[tuple] = set()
    for _ in range(rounds):
        moving = {g: m.copy() for g, m in means.items()}
        for g, r in rests:
            moving[g][r] = np.nan
        moving = {g: m for g, m in moving.items() if not np.isnan(m[:, 0, 0]).all()}
        if not moving:
            break
        new = {g: m.copy() for g, m in moving.items()}
        for (g, r, c), (n, _, v) in _summed(own, group, moving, parts).items():
            new[g][r, c] = v / n
        for g in moving:
            way = np.nanmax(np.nan_to_num(((new[g] - moving[g]) ** 2).sum(axis=2)), axis=1)
            for r in range(restarts):
                if not np.isnan(moving[g][r, 0, 0]):
                    means[g][r] = new[g][r]
                    if way[r] <= 1e-18:
                        rests.add((g, r))
    else:
        warnings.warn(f"means still moved after {rounds} rounds", stacklevel=2)
    inertia: dict[object, np.ndarray] = {g: np.full(restarts, np.inf) for g in means}
    for (g, r, _), (_, d, _) in _summed(own, group, means, parts).items():
        inertia[g][r] = d if np.isinf(inertia[g][r]) else inertia[g][r] + d
    best = {g: m[[int(np.round(inertia[g], 9).argmin())]] for g, m in means.items()}
    kind, id_kind = (own.schema[c].dataType.simpleString() for c in (group, "id"))

    def place(batches):
        for name, at, batch, x in _matrices(group, batches):
            near = _squared(x, best[name])[:, 0].argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(group).take(pa.array(at)), batch.column("id").take(pa.array(at)), pa.array(near.astype(np.int32))], [group, "id", "cluster"])

    placed = cut(own.mapInArrow(place, f"`{group}` {kind}, id {id_kind}, cluster int"))
    sizes = placed.groupBy(group, "cluster").agg(F.count("*").alias("_n"))
    rank = sizes.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_n"), "cluster")) - 1)
    return placed.join(F.broadcast(rank), [group, "cluster"]).select(group, "id", F.col("_rank").cast("int").alias("cluster"))


def _nearest_of(want: int, size: float):
    """A body for blocks.met: of each place (x, y) its nearest of the places (x, y, n) within size, the (d, m) of want points at least.

    Its own place is one of them, with a point fewer; matrices stay at about a million numbers.
    """

    def near(a: pa.StructArray, b: pa.StructArray):
        (x, y), (u, v, n) = ([s.field(c).to_numpy(zero_copy_only=False) for c in names] for s, names in ((a, "xy"), (b, "xyn")))
        step = max(1, (1 << 20) // len(b))
        for lo in range(0, len(x), step):
            px, py = x[lo : lo + step, None], y[lo : lo + step, None]
            far = (px - u) ** 2 + (py - v) ** 2
            best = np.argpartition(far, want, axis=1)[:, : want + 1] if len(b) > want + 1 else np.broadcast_to(np.arange(len(b)), far.shape)
            d = np.sqrt(np.take_along_axis(far, best, axis=1))
            m = n[best] - ((u[best] == px) & (v[best] == py))
            kept = (d <= size) & (m > 0)
            ends = np.concatenate([[0], kept.sum(axis=1).cumsum()]).astype(np.int32)
            by = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(d[kept]), pa.array(m[kept])], ["d", "m"]))
            yield pa.RecordBatch.from_arrays([pa.array(px[:, 0]), pa.array(py[:, 0]), by], ["x", "y", "by"])

    return near


def nearest_distance(points: DataFrame, k: int = 4, crowd: int = 16) -> DataFrame:
    """id and the exact distance of each point (id, x, y) to its kth nearest other one, or to the farthest where there are fewer.

    Points at one place are one place with a count; a place of over k points is settled by that. Cells start so small that
    no cell holds over crowd * k places; a place is settled when k others lie within one cell's size, else it asks again
    at twice the size, so a crowd is settled while cells are small and only lone places go on to large ones. Null where a
    point has no other. What is not finite is told by counts: NaN, which comes after all else, or infinite.
    """
    places = cut(points.groupBy("x", "y").agg(F.count("*").alias("n")).where("x is not null and y is not null"))
    side = lambda c: F.when(~F.isnan(c), F.when(F.abs(c) == math.inf, F.signum(c)).otherwise(0.0))
    sides = {(r.x, r.y): r.n for r in places.groupBy(side("x").alias("x"), side("y").alias("y")).agg(F.sum("n").alias("n")).collect()}  # 16 at most
    if not sides:
        return points.select("id", F.lit(None).cast("double").alias("distance"))
    want = min(k, sum(sides.values()) - 1)
    places = places.where((side("x") == 0) & (side("y") == 0))
    box = places.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("places")).first()
    done, open_ = places.where(F.col("n") > want).select("x", "y", F.lit(0.0).alias("d")), places.where(F.col("n") <= want)
    if sides.get((0, 0), 0) > want:
        span = max(box["hix"] - box["lox"], box["hiy"] - box["loy"]) or 1.0
        cell = lambda c, size: F.floor(F.col(c) / size)
        size = span * 2.0 ** -max(0, math.floor(math.log2(box["places"] / (crowd * k)) / 2))  # larger ones hold more on average
        while places.groupBy(cell("x", size), cell("y", size)).count().where(F.col("count") > crowd * k).limit(1).count() and size > span * 2.0**-50:
            size /= 2
        while open_.limit(1).count():
            own = [cell(c, size).alias(f"_g{c}") for c in "xy"]
            asked = open_.select(*own, "x", "y")
            beside = [F.explode(F.sequence(F.col(f"_g{c}") - 1, F.col(f"_g{c}") + 1)).alias(f"_h{c}") for c in "xy"]
            cells = asked.select("_gx", "_gy").distinct().select("*", beside[0]).select("*", beside[1])
            held = places.select(*[cell(c, size).alias(f"_h{c}") for c in "xy"], "x", "y", "n").join(cells, ["_hx", "_hy"]).select("_gx", "_gy", "x", "y", "n")
            near = met(asked, held, ["_gx", "_gy"], _nearest_of(want, size), "x double, y double, by array<struct<d: double, m: long>>")
            found = near.groupBy("x", "y").agg(F.array_sort(F.flatten(F.collect_list("by"))).alias("by"))
            run = F.aggregate("by", F.struct(F.lit(0).cast("long").alias("t"), F.lit(None).cast("double").alias("d")), lambda s, v: F.struct((s["t"] + v["m"]).alias("t"), F.when(s["t"] >= want, s["d"]).otherwise(v["d"]).alias("d")))
            found = cut(found.select("x", "y", run.alias("run")).select("x", "y", F.when(F.col("run.t") >= want, F.col("run.d")).alias("d")))
            done = done.unionByName(found.where("d is not null"))
            open_ = found.where("d is null").select("x", "y")
            if size > 2 * span:
                break
            size *= 2
    sx, sy = side("x"), side("y")
    unknown = F.lit(0)  # points at no known distance of an infinite one, itself included
    known = {own: n for own, n in sides.items() if None not in own}
    for (x, y), n in known.items():
        unknown += F.when((sx != 0) & (sx == x) | (sy != 0) & (sy == y), n).otherwise(0)
    there = F.when(sx.isNotNull() & sy.isNotNull(), sum(known.values()) - F.when((sx == 0) & (sy == 0), 1).otherwise(unknown))
    far = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.when(there >= want, math.inf).otherwise(math.nan))
    return points.join(done, ["x", "y"], "left").select("id", F.when(F.lit(want > 0), F.coalesce("d", far)).alias("distance"))


def density_reach(points: DataFrame, k: int = 4, share: float = 0.75) -> DataFrame:
    """One row, eps: the upper quartile of all distances to the kth nearest, 1 where that is not positive."""
    return floor_percentile(nearest_distance(points, k).withColumn("_all", F.lit(1)), ["_all"], "distance", share).select(F.col("percentile").alias("eps"))


def dbscan(points: DataFrame, eps: float | None = None, least: int = 4) -> DataFrame:
    """id, cluster (the smallest core id of its cluster, -1 for noise) of points (id, x, y); without eps that of density_reach.

    A point with least points within eps, itself included, is a core; cores within eps are one cluster, and another
    point joins the cluster of its smallest core neighbour. Points at one place share all that, so a place with a count
    stands for them.
    """
    from terralyn.operators.spatial import near_pairs

    if eps is None:
        eps = (density_reach(points, least).first() or [1.0])[0]
    places = cut(points.where("x is not null and y is not null").groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    near = cut(near_pairs(places.select("id", "x", "y"), places, eps).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "b_n"))
    cores = near.groupBy("a").agg(F.sum("b_n").alias("_n")).where(F.col("_n") >= least).select(F.col("a").alias("id"))
    inner = near.join(cores.select(F.col("id").alias("a")), "a", "left_semi").join(cores.select(F.col("id").alias("b")), "b", "left_semi")
    labels = cores.join(components(inner.where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst"))), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    border = near.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min(F.struct("b", "cluster")).alias("_b"))
    known = places.select("id", "x", "y").join(labels, "id", "left").join(border, "id", "left").select("x", "y", F.coalesce("cluster", F.col("_b.cluster")).alias("cluster"))
    return points.select("id", "x", "y").join(known, ["x", "y"], "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
