"""Vector operators on array columns: unmixing, nearest centroids, covariance and principal components.

A matrix has rows (id, v array<double>) of one width, which is small; the number of rows is not bounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def mean_vectors(rows: DataFrame, groups: list[str], vector: str = "v") -> DataFrame:
    """groups, mean array<double>, n."""
    long = rows.select(*groups, F.posexplode(vector).alias("_i", "_x"))
    sums = long.groupBy(*groups, "_i").agg(F.avg("_x").alias("_m"), F.count("_x").alias("_n"))
    out = sums.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_l"), F.max("_n").alias("n"))
    return out.select(*groups, F.transform("_l", lambda s: s["_m"]).alias("mean"), "n")


def mix_fraction(p: Column, a: Column, b: Column) -> Column:
    """Fraction of a in p = f a + (1 - f) b, clamped to 0..1; equal ends give one half."""
    apart = squared_distance(a, b)
    raw = dot(minus(p, b), minus(a, b)) / F.when(apart > 0, apart)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(0.5))


def mix_residual(p: Column, a: Column, b: Column, f: Column) -> Column:
    """Distance of p from its mix, relative to the distance of a and b. f is a column, so lambdas do not compute it anew."""
    apart = squared_distance(a, b)
    mixed = F.transform(F.arrays_zip(p.alias("p"), a.alias("a"), b.alias("b")), lambda s: s["p"] - f * s["a"] - (1 - f) * s["b"])
    return F.sqrt(F.coalesce(dot(mixed, mixed) / F.when(apart > 0, apart), F.lit(0.0)))


def unmix(pixels: DataFrame, means: DataFrame, most: int = 10_000) -> DataFrame:
    """id, class, partner, fraction, residual: each pixel as a mix of its own class and the best other one, the smaller on ties.

    means has a row for each class (class, mean); more than most classes are refused. They come as one row for all, so
    pixels are not shuffled; pixels of an unknown class, or without another one, are left out.
    """
    own = pixels.select("id", "class", "v").crossJoin(F.broadcast(_held(means, most)))
    own = own.withColumn("_own", F.get(F.filter("_means", lambda m: m["class"] == F.col("class")), F.lit(0))["mean"])
    best = F.array_min(F.transform(F.filter("_means", lambda m: m["class"] != F.col("class")), lambda m: _mixed(F.col("v"), F.col("_own"), m)))
    return own.where("_own is not null").withColumn("_b", best).where("_b is not null").select("id", "class", "_b.partner", "_b.fraction", "_b.residual")


def _mixed(v: Column, own: Column, m: Column) -> Column:
    """(residual, partner, fraction) of a pixel between its own mean and another class; the fraction is computed once."""
    f = mix_fraction(v, own, m["mean"])
    return F.transform(F.array(f), lambda f: F.struct(mix_residual(v, own, m["mean"], f).alias("residual"), m["class"].alias("partner"), f.alias("fraction")))[0]


def nearest_means(pixels: DataFrame, means: DataFrame, most: int = 10_000) -> DataFrame:
    """id, nearest class and distance, nearest other class than that one and distance; the smaller class on ties."""
    apart = lambda m: F.struct(F.sqrt(squared_distance(F.col("v"), m["mean"])).alias("d"), m["class"].alias("c"))
    near = pixels.select("id", "v").crossJoin(F.broadcast(_held(means, most))).select("id", F.slice(F.array_sort(F.transform("_means", apart)), 1, 2).alias("_l"))
    first, second = F.get("_l", F.lit(0)), F.get("_l", F.lit(1))
    return near.select("id", first["c"].alias("nearest"), first["d"].alias("distance"), second["c"].alias("second"), second["d"].alias("second_distance"))


def _held(means: DataFrame, most: int) -> DataFrame:
    """At most so many (class, mean) as one array in one row, so that a row meets them without a shuffle."""
    if means.limit(most + 1).count() > most:
        raise ValueError("too many classes to meet every pixel")
    return means.agg(F.array_sort(F.collect_list(F.struct("class", "mean"))).alias("_means"))


def unmix_edges(pixels: DataFrame, least: int = 4, most: int = 10_000) -> DataFrame:
    """id, own, partner, fraction_a, residual of pixels (id, field_key, crp_lbl, zone, v) at the edge to another species.

    A pixel is a mix of its own pure curve, the mean of its field's interior where that has at least so many pixels and
    else of its species', and of the species whose mean leaves the smallest residual. The fraction is that of the
    species with the most interior pixels; a pixel of which that is neither side, or without a pure curve, has none.
    """
    pure = pixels.where((F.col("zone") == "interior") & F.col("v").isNotNull())
    fields = mean_vectors(pure, ["field_key"]).where(F.col("n") >= least).select("field_key", F.col("mean").alias("_field"))
    species = mean_vectors(pure, ["crp_lbl"]).select(F.col("crp_lbl").alias("class"), "mean")
    seen = pure.groupBy("crp_lbl").agg(F.count("*").alias("_n"), F.min("id").alias("_first"))
    axis = seen.agg(F.max(F.struct("_n", (-F.col("_first")).alias("f"), F.col("crp_lbl"))).alias("_m")).select(F.col("_m.crp_lbl").alias("_a"))
    edge = pixels.where("zone = 'edge_other'").join(fields, "field_key", "left").crossJoin(F.broadcast(_held(species, most))).crossJoin(F.broadcast(axis))
    own = F.get(F.filter("_means", lambda m: m["class"] == F.col("crp_lbl")), F.lit(0))["mean"]
    edge = edge.select("id", "crp_lbl", "v", "_a", "_means", F.coalesce("_field", own).alias("_own"))
    best = F.array_min(F.transform(F.filter("_means", lambda m: m["class"] != F.col("crp_lbl")), lambda m: _mixed(F.col("v"), F.col("_own"), m)))
    edge = edge.select("id", "crp_lbl", "_a", F.when(F.col("v").isNotNull() & F.col("_own").isNotNull(), best).alias("_b"))
    share = F.when(F.col("crp_lbl") == F.col("_a"), F.col("_b.fraction")).when(F.col("_b.partner") == F.col("_a"), 1 - F.col("_b.fraction"))
    return edge.select("id", F.col("crp_lbl").alias("own"), "_b.partner", share.alias("fraction_a"), "_b.residual")


def unmix_summary(mixed: DataFrame) -> DataFrame:
    """One row: pixels with a fraction, pixels without, and the mean fraction."""
    return mixed.agg(F.count("fraction_a").alias("n"), F.count(F.when(F.col("fraction_a").isNull(), 1)).alias("skipped"), F.coalesce(F.avg("fraction_a"), F.lit(0.0)).alias("mean_fraction_a"))


def gram(rows: DataFrame, vector: str = "v") -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and the sums of products, added up in tasks; the driver gets width x width numbers."""

    def add(parts):
        n, s, g = 0, None, None
        for part in parts:
            x = np.stack(part[vector].to_numpy()).astype(float) if len(part) else np.zeros((0, 0))
            if len(x):
                n, s, g = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    sums = rows.select(vector).where(F.col(vector).isNotNull()).mapInPandas(add, "n long, s array<double>, g array<double>")
    long = sums.select("n", F.posexplode(F.concat("s", "g")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
    if not long:
        return 0, np.zeros(0), np.zeros((0, 0))
    x = np.array([r["x"] for r in long])
    width = int((np.sqrt(1 + 4 * len(x)) - 1) / 2)
    return long[0]["n"], x[:width], x[width:].reshape(width, width)


def covariance(rows: DataFrame, vector: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance."""
    n, s, g = gram(rows, vector)
    if n < 2:
        raise ValueError("a covariance needs two rows")
    # sums of products about the mean: large means would otherwise cancel the digits of small variances
    mean = s / n
    _, rest, g = gram(rows.select(minus(F.col(vector), F.array(*map(F.lit, mean.tolist()))).alias(vector)), vector)
    return mean, (g - np.outer(rest, rest) / n) / (n - 1)


def principal_axes(rows: DataFrame, k: int, vector: str = "v") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, axes (k x width, the largest loading positive) and the variance along every axis."""
    mean, cov = covariance(rows, vector)
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, ::-1].T[:k]
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return mean, axes * np.where(signs == 0, 1, signs)[:, None], np.maximum(values[::-1], 0)


def project(rows: DataFrame, mean: np.ndarray, axes: np.ndarray, vector: str = "v") -> DataFrame:
    """Adds scores array<double>: the centred rows on each axis, in built-in functions."""
    centre = F.array(*map(F.lit, mean.tolist()))
    scores = [dot(minus(F.col(vector), centre), F.array(*map(F.lit, a.tolist()))) for a in axes]
    return rows.withColumn("scores", F.array(*scores))


def pca(fit: DataFrame, place: DataFrame, k: int = 3, whiten: bool = False) -> tuple[DataFrame, DataFrame]:
    """Scores of place on the axes of fit, and a table (component, explained, cumulative) of variance shares."""
    mean, axes, variance = principal_axes(fit, k)
    if whiten:
        axes = axes / np.where(variance[: len(axes)] > 0, np.sqrt(variance[: len(axes)]), 1)[:, None]
    share = variance / (variance.sum() or 1)
    table = [(i + 1, float(share[i]), float(share[: i + 1].sum())) for i in range(len(axes))]
    return project(place, mean, axes), fit.sparkSession.createDataFrame(table, "component int, explained double, cumulative double")


def random_axes(width: int, k: int, seed: int = 13) -> np.ndarray:
    """Unit Gaussian directions."""
    x = np.random.default_rng(seed).normal(size=(k, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def independent_axes(rows: DataFrame, k: int = 3, rounds: int = 200, tolerance: float = 1e-7, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and unmixing axes of symmetric FastICA with tanh; each round is one distributed sum over the whitened rows."""
    mean, axes, variance = principal_axes(rows, k)
    white = axes / np.where(variance[: len(axes)] > 0, np.sqrt(variance[: len(axes)]), 1)[:, None]
    scores = project(rows, mean, white).select(F.col("scores").alias("z"))
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(white), len(white))))[0]
    for _ in range(rounds):

        def add(parts, w=w):
            for part in parts:
                if len(part):
                    z = np.stack(part["z"].to_numpy())
                    t = np.tanh(z @ w.T)
                    yield pd.DataFrame({"n": [len(z)], "s": [np.concatenate([(t.T @ z).ravel(), (1 - t * t).sum(0)]).tolist()]})

        got = scores.mapInPandas(add, "n long, s array<double>").select("n", F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
        x, n, m = np.array([r["x"] for r in got]), got[0]["n"], len(w)
        new = x[: m * m].reshape(m, m) / n - (x[m * m :] / n)[:, None] * w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        done = np.max(np.abs(np.abs((new * w).sum(1)) - 1)) < tolerance
        w = new
        if done:
            break
    return mean, w @ white


def noise_fraction_axes(signal: DataFrame, noise: DataFrame, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and axes that order the rows by signal to noise; noise holds differences of neighbouring rows."""
    mean, cov = covariance(signal)
    _, noisy = covariance(noise)
    values, vectors = np.linalg.eigh(noisy / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-12))
    _, turn = np.linalg.eigh(root.T @ cov @ root)
    return mean, (root @ turn[:, ::-1]).T[:k]
