"""Hulls, widths, overlaps, nearest distances, blobs and bridges against brute force, and their odd inputs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralyn.functions import geometry
from terralyn.operators import blobs, blocks, boundary, cluster, hulls, rings


def test_hulls_leave_out_collinear_and_repeated_points(spark):
    rng = np.random.default_rng(1)
    groups = {"square": [(x, y) for x in range(5) for y in range(5)] * 3, "line": [(k, 2 * k) for k in range(9)], "point": [(3, 3)] * 4, "two": [(0, 0), (1, 1)], "cloud": rng.normal(size=(500, 2)).tolist(), "grid": rng.integers(0, 6, (300, 2)).tolist()}
    rows = [(g, float(x), float(y)) for g, own in groups.items() for x, y in own] + [("none", None, 1.0), ("none", float("nan"), 1.0)]
    got = {r.g: r for r in hulls.hulls(spark.createDataFrame(rows, "g string, x double, y double").repartition(7), "g").collect()}
    assert set(got) == set(groups)
    assert {(p.x, p.y) for p in got["square"].hull} == {(0, 0), (4, 0), (4, 4), (0, 4)} and (got["square"].width, got["square"].area) == (4, 16)
    assert [got[g].width for g in ("line", "point", "two")] == [0, 0, 0] and len(got["line"].hull) == 2
    for name in ("cloud", "grid"):
        points, own = np.array(groups[name], float), np.array([(p.x, p.y) for p in got[name].hull])
        edges = np.roll(own, -1, axis=0) - own
        depth = edges[:, None, 0] * (points[None, :, 1] - own[:, None, 1]) - edges[:, None, 1] * (points[None, :, 0] - own[:, None, 0])
        assert (depth >= -1e-9).all() and ((np.abs(depth) < 1e-12).sum(axis=1) >= 2).all()
        turn = edges[:, 0] * np.roll(edges, -1, axis=0)[:, 1] - edges[:, 1] * np.roll(edges, -1, axis=0)[:, 0]
        assert (turn > 0).all()
        least = min(np.ptp(points @ np.array([-math.sin(a), math.cos(a)])) for a in np.arctan2(edges[:, 1], edges[:, 0]))
        assert got[name].width == pytest.approx(least)


def test_shared_area_of_concave_rings_with_holes(spark):
    """Against the share of a fine grid of points that lie in both."""
    rng = np.random.default_rng(5)

    def star(cx, cy, n):
        reach = rng.uniform(1, 4, n)
        return [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k, r in enumerate(reach)]

    fields = [(k, [star(*rng.uniform(0, 6, 2), 9)]) for k in range(12)]
    fields.append((100, [[(0, 0), (8, 0), (8, 8), (0, 8)], [(2, 2), (2, 6), (6, 6), (6, 2)]]))  # a square with a hole
    fields.append((101, [[(3, 3), (3, 5), (5, 5), (5, 3)]]))  # inside the hole, clockwise
    rows = [(k, "s", [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in own]) for k, own in fields]
    df = spark.createDataFrame(rows, "id long, crp_lbl string, ring array<array<struct<x: double, y: double>>>")
    got = {(r.a_id, r.b_id): r.area for r in rings.overlapping_rings(df, df, 3.0).where("a_id < b_id").collect()}
    step = 0.02
    x, y = (g.ravel() for g in np.meshgrid(np.arange(-5, 13, step), np.arange(-5, 13, step)))

    def inside(own):
        out = np.zeros(len(x), bool)
        for ring in own:
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                if ay != by:
                    out ^= ((ay > y) != (by > y)) & (x < ax + (bx - ax) * (y - ay) / (by - ay))
        return out

    held = {k: inside(own) for k, own in fields}
    for a, b in itertools.combinations(held, 2):
        assert got.get((a, b), 0.0) == pytest.approx((held[a] & held[b]).sum() * step * step, abs=0.15)
    assert (100, 101) not in got


def test_distances_of_fields_with_holes_and_in_metres(spark):
    square = lambda x, y, s: [{"x": x, "y": y}, {"x": x + s, "y": y}, {"x": x + s, "y": y + s}, {"x": x, "y": y + s}]
    rows = [(1, "a", [square(0.0, 0.0, 10.0), square(2.0, 2.0, 6.0)]), (2, "b", [square(4.0, 4.0, 2.0)]), (3, "c", [square(9.0, 9.0, 4.0)]), (4, "d", [square(30.0, 0.0, 1.0), square(12.0, 4.0, 1.0)])]
    df = spark.createDataFrame(rows, "id long, crp_lbl string, ring array<array<struct<x: double, y: double>>>")
    got = {(r.a_id, r.b_id): r.distance for r in rings.neighbour_rings(df, 5.0, 4.0).collect()}
    assert got[1, 2] == pytest.approx(2.0) and got[1, 3] == 0 and got[1, 4] == pytest.approx(2.0) and (2, 4) not in got
    degrees = lambda x, y: [[{"x": x, "y": y}, {"x": x + 1e-4, "y": y}, {"x": x + 1e-4, "y": y + 1e-4}]]
    for lat in (0.0, 50.0, -65.0):
        df = spark.createDataFrame([(1, "a", degrees(3.0, lat)), (2, "b", degrees(3.0 + 4e-4, lat))], "id long, crp_lbl string, ring array<array<struct<x: double, y: double>>>")
        gap = 3e-4 * geometry.METRES_X * math.cos(math.radians(lat + 5e-5))
        assert rings.neighbour_rings(df, gap + 0.5, 1e-3, metric=True).first().distance == pytest.approx(gap, rel=1e-4)
        assert not rings.neighbour_rings(df, gap - 0.5, 1e-3, metric=True).count()


@pytest.mark.parametrize("k", [1, 4, 900])
def test_nearest_distances_in_crowds(spark, k):
    """A dense crowd, repeated places, lone points far away."""
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal(0, 1e-3, (400, 2)), rng.uniform(-50, 50, (100, 2)), np.repeat([[7.0, 7.0]], 30, axis=0), [[900.0, -900.0]]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, y double")
    got = {r.id: r.distance for r in cluster.nearest_distance(df, k, crowd=4).collect()}
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    want = np.sort(apart, axis=1)[:, min(k, len(points) - 1) - 1]
    assert len(got) == len(points) and np.allclose([got[i] for i in range(len(points))], want)


def test_nearest_distances_of_few_points(spark):
    assert cluster.nearest_distance(spark.createDataFrame([], "id long, x double, y double")).collect() == []
    assert [r.distance for r in cluster.nearest_distance(spark.createDataFrame([(1, 2.0, 3.0)], "id long, x double, y double")).collect()] == [None]
    assert cluster.density_reach(spark.createDataFrame([(1, 2.0, 3.0), (2, 2.0, 3.0)], "id long, x double, y double")).first().eps == 1.0


def test_nearest_distances_settle_full_places_unasked(spark, monkeypatch):
    """Each place holds over k points, which says 0; these asked nine cells of places as pairs before."""
    monkeypatch.setattr(cluster, "met", None)
    df = spark.range(20_000).select("id", (F.col("id") % 1000).cast("double").alias("x"), (F.col("id") % 500).cast("double").alias("y"))
    assert tuple(cluster.nearest_distance(df, 4).agg(F.count("distance"), F.max("distance")).first()) == (20_000, 0.0)
    assert cluster.density_reach(df).first().eps == 1.0


def test_nearest_distances_judge_a_cell_in_bulk(spark, monkeypatch):
    """All places in one cell, in slices and in batches whose nearest are put together; met did not take part before."""
    calls, own = [], cluster.met
    monkeypatch.setattr(cluster, "met", lambda *args: calls.append(1) or own(*args))
    monkeypatch.setattr(blocks, "CROWD", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        points = np.random.default_rng(3).integers(0, 60, (2500, 2)).astype(float)
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(points.tolist())], "id long, x double, y double")
        got = {r.id: r.distance for r in cluster.nearest_distance(df, 4, crowd=10_000).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    assert [got[i] for i in range(2500)] == np.sort(apart, axis=1)[:, 3].tolist() and len(calls) == 1


def test_nearest_distances_of_odd_coordinates(spark):
    """As SQL orders them, infinite ones before NaN; rows without coordinates were lost where none had any."""
    frame = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "id long, p struct<x: double, y: double>").select("id", "p.x", "p.y")
    near = lambda df, k: [repr(r.distance) for r in cluster.nearest_distance(df, k).orderBy("id").collect()]
    assert near(frame((None, 1.0), (2.0, None)), 4) == ["None", "None"]
    odd = frame((0.0, 0.0), (3.0, 4.0), (0.0, 1.0), (math.nan, 0.0), (math.inf, 0.0), (None, 0.0), (math.inf, 1.0), (0.0, -math.inf))
    assert near(odd, 2) == ["5.0", "5.0", repr(math.sqrt(18)), "nan", "inf", "None", "inf", "inf"]
    assert near(odd, 5) == ["inf", "inf", "inf", "nan", "nan", "None", "nan", "inf"]


def test_blobs_of_few_members_and_of_noise(spark):
    rows = [(k, 0.0 + k % 3, 1.0 * (k % 2), 0) for k in range(12)] + [(20 + k, 50.0 + k, 50.0, 1) for k in range(3)] + [(30, 9.0, 9.0, -1)]
    df = spark.createDataFrame(rows, "id long, x double, y double, cluster int")
    found = blobs.circles(df)
    assert [r.cluster for r in found.collect()] == [0]
    got = {r.id: r for r in blobs.boundary_gaps(df, found).collect()}
    assert len(got) == len(rows) and got[0].gap < 0 and got[30].gap > 0 and got[30].corridor is None and not got[30].flagged
    assert blobs.boundary_gaps(df, found.where("false")).collect() == []


def test_bridge_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    ends = {"a": np.array([0.0, 0, 0, 0]), "b": np.array([4.0, 1, 0, 2]), "c": np.array([0.0, 5, 5, 0])}
    pure = [(i, s, (ends[s] + rng.normal(0, 0.05, 4)).tolist()) for i, s in enumerate(rng.choice(list(ends), 90))]
    df = spark.createDataFrame([*pure, (1000, "a", [1.0, None, 1.0, 1.0]), (1001, "b", None)], "id long, species string, v array<double>")
    model = blobs.bridge_model(df, clusters=1)
    cells = [(k, 0, (rng.random() * ends["a"] + (1 - rng.random()) * ends[rng.choice(["b", "c"])] + rng.normal(0, 0.2, 4)).tolist()) for k in range(60)]
    got = {r.row: r.bridge for r in blobs.bridge(spark.createDataFrame(cells, "row long, col long, values array<double>"), model).collect()}
    x = np.array([v for _, _, v in pure])
    middle = x.mean(axis=0)
    axes = np.linalg.svd(x - middle)[2][:3]
    centres = {s: ((np.array([v for _, t, v in pure if t == s]) - middle) @ axes.T).mean(axis=0) for s in ends}
    for k, _, v in cells:
        p = (np.array(v) - middle) @ axes.T
        a, b = sorted(centres.values(), key=lambda c: ((p - c) ** 2).sum())[:2]
        t = np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
        length = np.linalg.norm(b - a)
        assert got[k] == pytest.approx((1 - abs(2 * t - 1)) * length / (length + 2 * np.linalg.norm(p - a - t * (b - a))), abs=1e-6)
    assert blobs.bridge_model(df.limit(10)) is None and blobs.bridge_model(df.where("species = 'a'")) is None


def test_grids_do_not_touch_and_truth_falls_back_to_outlines(spark):
    raster = spark.createDataFrame([(g, r, c, d, float(r * (g + 1) + c)) for g in range(2) for r in range(4) for c in range(4) for d in range(2)], "grid long, row long, col long, date long, value double")
    cells = raster.select("grid", "row", "col").distinct()
    out = boundary.predictions(raster, cells, cells.where("false"), cells.where("row = 0")).collect()
    assert len(out) == 32 and {r.label for r in out if r.row == 0} == {1} and all(r.impurity is None and r.bridge is None for r in out)
    assert {(r.grid, r.row, r.col) for r in out if r.gradient is not None} == {(g, r, c) for g in range(2) for r in (1, 2) for c in (1, 2)}


def test_noise_is_that_of_neighbours_in_space(spark):
    from terralyn.operators import matrix

    rng = np.random.default_rng(3)
    rows = [(k, float(k % 20), float(k // 20), rng.normal(size=3).tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, y double, v array<double>")
    got = sorted(tuple(r.v) for r in boundary.noise_differences(df, 3.0).collect())
    at = np.array([r[1:3] for r in rows])
    apart = ((at[:, None] - at[None]) ** 2).sum(axis=2) + np.where(np.eye(len(at)) > 0, np.inf, 0)
    want = sorted(tuple(np.array(rows[k][3]) - np.array(rows[int(n)][3])) for k, n in enumerate(apart.argmin(axis=1)))
    assert np.allclose(got, want)
    alone = spark.createDataFrame([(k, k * 1e6, 0.0, [float(k * k), 1.0]) for k in range(5)], "id long, x double, y double, v array<double>")
    assert sorted(r.v[0] for r in boundary.noise_differences(alone, 3.0).collect()) == [1, 3, 5, 7]
    mean, axes = matrix.noise_fraction_axes(df.select("v"), boundary.noise_differences(df, 3.0), 2)
    assert axes.shape == (2, 3) and np.isfinite(axes).all()


def test_principal_axes_equal_a_decomposition(spark):
    from terralyn.operators import matrix

    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 5
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    mean, axes, variance = matrix.principal_axes(df, 3)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(variance, s**2 / 299)
    assert np.allclose(np.abs((axes * vt[:3]).sum(axis=1)), 1)
    scores, shares = matrix.pca(df, df, 3)
    assert np.allclose([r.explained for r in shares.orderBy("component").collect()], (s**2 / (s**2).sum())[:3])
    white = np.array([r.scores for r in matrix.pca(df, df, 3, whiten=True)[0].orderBy("id").collect()])
    assert np.allclose(np.cov(white.T), np.eye(3), atol=1e-6)


def test_season_fits_meet_their_calendar(spark):
    from terralyn.operators import phenology

    calendar = spark.createDataFrame([("maize", "04-15", "10-15", "07-10", "08-20")], "calendar_key string, green_start string, green_end string, peak_start string, peak_end string")
    rows = [("Maize", 0, 120.0, 280.0, 205.0), ("Maize", 1, 120.0, 280.0, 150.0), ("Maize", 2, 330.0, 430.0, 380.0), ("other", 0, 1.0, 50.0, 20.0), ("Maize", 3, None, None, None)]
    fits = spark.createDataFrame(rows, "species string, cluster int, sos double, eos double, between double")
    got = {(r.species, r.cluster): r.in_calendar for r in phenology.calendar_fits(fits, calendar, 2023).collect()}
    assert got == {("Maize", 0): True, ("Maize", 1): False, ("Maize", 2): False, ("other", 0): True, ("Maize", 3): None}
