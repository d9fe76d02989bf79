"""Joins judged by NumPy against brute force, with crowds dealt into slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralyn.operators import blocks, boundary, catalogue, cluster, rings


def test_mean_nearest_takes_any_number_of_references(spark):
    """10,001 references were an error; copies count each, and a row's own vector is at distance 0."""
    rng = np.random.default_rng(2)
    ref = np.concatenate([rng.normal(size=(10_500, 3)) * 2, np.full((6, 3), 50.0), np.full((2, 3), 90.0)]) + 1000
    ask = np.concatenate([rng.normal(size=(20, 3)) + 1000, ref[:5], [[1050.0, 1050, 1050.5], [1090.0, 1090, 1090]]])
    frame = lambda v, kind: spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], f"id long, v array<{kind}>")
    rows = frame(ask, "double").unionByName(spark.createDataFrame([(99, None)], "id long, v array<double>"))
    got = {r.id: r.distance for r in boundary.mean_nearest(rows, frame(ref, "double").select("v"), 4).collect()}
    far = np.sort(np.sqrt(((ask[:, None] - ref[None]) ** 2).sum(axis=2)), axis=1)[:, :4].mean(axis=1)
    assert got.pop(99) is None and got == pytest.approx(dict(enumerate(far)), abs=1e-9)
    assert [r.distance for r in boundary.mean_nearest(rows.limit(1), rows.where("false").select("v")).collect()] == [None]


def test_slices_of_a_crowd_meet_all(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CROWD", 7)
    rng = np.random.default_rng(4)
    ref = rng.normal(size=(100, 2))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(ref)], "id long, v array<double>")
    got = {r.id: r.distance for r in boundary.mean_nearest(df, df.select(F.col("v")), 3).collect()}
    far = np.sort(np.sqrt(((ref[:, None] - ref[None]) ** 2).sum(axis=2)), axis=1)[:, :3].mean(axis=1)
    assert got == pytest.approx(dict(enumerate(far)), abs=1e-12)


def test_ring_pairs_judge_a_crowd_in_bulk(spark):
    """2,000 fields on one spot, 999,000 pairs of different species; one by one in expressions these took minutes."""
    rows = [(k, "ab"[k % 2], [{"x": x + k % 7 * 0.01, "y": y} for x, y in ((0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0))]) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, crp_lbl string, ring array<struct<x: double, y: double>>")
    got = rings.neighbour_rings(df, 1.0, 4.0, keep=["id"]).agg(F.count("*").alias("n"), F.max("distance").alias("d"), F.min(F.col("b_id") - F.col("a_id")).alias("least")).first()
    assert tuple(got) == (1_000_000, 0.0, 1)
    assert rings.overlapping_rings(df.limit(200), df.limit(200), 4.0, ordered=True).count() == 199 * 100


def test_a_crowd_at_one_place_is_one_place(spark):
    """20,000 points at one place were 400 million pairs."""
    far = spark.createDataFrame([(90_000, 5.0, 5.0), (90_001, 5.5, 5.0), (90_002, 90.0, 90.0)], "id long, x double, y double")
    df = spark.range(20_000).select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).unionByName(far)
    near = {r.id: (r.nearest, r.distance) for r in boundary.nearest_noise(df, 10.0).where("id < 3 or id > 19998").collect()}
    assert near == {0: (1, 0.0), 1: (0, 0.0), 2: (0, 0.0), 19_999: (0, 0.0), 90_000: (90_001, 0.5), 90_001: (90_000, 0.5)}
    got = {r.cluster: r.n for r in cluster.dbscan(df, 1.0, 4).groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 20_000, -1: 3}


def test_pixels_of_a_crowd_of_fields(spark):
    """3,000 pixels in 300 equal fields: each pair once, the smallest id first, and each pixel once."""
    ring = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))]
    fields = spark.createDataFrame([(k, "a", ring) for k in range(300)], "id long, crp_lbl string, ring array<struct<x: double, y: double>>")
    pixels = spark.range(3000).select(F.col("id").alias("pixel_id"), (F.col("id") % 7 + 0.5).alias("px"), F.lit(1.25).alias("py"))
    placed = rings.points_in_rings(pixels, fields, 2.0, keep=["id", "crp_lbl"])
    n = sum(k % 7 < 4 for k in range(3000))
    assert tuple(placed.agg(F.count("*"), F.countDistinct("pixel_id", "id"), F.min("edge_dist"), F.max("edge_dist")).first()) == (300 * n, 300 * n, 0.5, 1.25)
    assert tuple(rings.first_field(placed).agg(F.count("*"), F.max("id")).first()) == (n, 0)
    assert rings.inside_any(pixels, fields, 2.0).count() == n


def test_coverage_of_equal_boxes_and_tiles(spark):
    """20,000 equal boxes under 5,000 equal tiles were 1.6 billion pairs."""
    box = ["minx", "miny", "maxx", "maxy"]
    boxes = spark.range(20_000).select("id", *[F.lit(v).alias(c) for c, v in zip(box, (0.0, 0.0, 8.0, 8.0), strict=True)])
    boxes = boxes.unionByName(spark.createDataFrame([(-1, 40.0, 40.0, 48.0, 48.0)], "id long, minx double, miny double, maxx double, maxy double"))
    tiles = spark.range(5000).select(*[F.lit(v).alias(c) for c, v in zip(box, (0.0, 0.0, 4.0, 9.0), strict=True)])
    got = catalogue.sampled_coverage(boxes, tiles, 4).groupBy("coverage").agg(F.count("*").alias("n")).collect()
    assert {r.coverage: r.n for r in got} == {0.5: 20_000, 0.0: 1}
