"""Crowds of fields at one place are met as one: pairs, groups, grids and areas."""

import random

from pyspark.sql import functions as F

from terralyn.functions import geometry
from terralyn.operators import boundary, graph, layers, phenology, spatial
from terralyn.plans import layer_queries
from terralyn.sources import polygons


def _crowd(spark, n):
    return spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("crp_lbl"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_crowd(spark):
    far = spark.createDataFrame([(-1, "a", 3.0, 1.0), (-2, None, 1.0, 1.0), (-3, "a", 9.0, 9.0)], "id long, crp_lbl string, x double, y double")
    pairs = spatial.neighbour_pairs(_crowd(spark, 400).unionByName(far), 2.0)
    assert pairs.agg(F.count("*"), F.count_if(F.expr("a_id < b_id")), F.countDistinct("a_id", "b_id"), F.sum("distance")).first()[:] == (40_200, 40_200, 40_200, 400.0)
    assert "struct(id" in _plan(pairs) or "AS _p" in _plan(pairs)  # places meet, then their fields


def test_groups_and_neighbours_of_a_crowd(spark):
    """40,000 fields at one place were 800 million pairs."""
    far = spark.createDataFrame([(90_000, "a", 2.0, 1.0), (90_001, "a", 9.0, 9.0), (90_002, "a", 20.0, 9.0), (90_003, "a", 20.0, 9.0)], "id long, crp_lbl string, x double, y double")
    fields = _crowd(spark, 40_000).unionByName(far)
    assert sorted((r.component, r.n) for r in graph.near_groups(fields, 2.0).collect()) == [(0, 40_001), (90_002, 2)]
    assert spatial.neighbour_fields(fields, fields.where("crp_lbl = 'b'"), 2.0).count() == 40_001
    found = graph.neighbour_components(fields, 2.0)
    assert found.groupBy("component").count().collect()[0][:] == (0, 40_001)
    own = spatial.kinds(fields)
    assert own.count() == 5
    links = spatial.neighbour_pairs(own, 2.0).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
    assert graph.spans(own, links, ["a", "b"]).first().spans and [r.crp_lbl for r in graph.valid_additions(own, links, ["a"]).collect()] == ["b"]


def test_box_pairs_come_once_without_an_aggregate(spark):
    box = lambda *rows: spark.createDataFrame(rows, "id long, minx double, miny double, maxx double, maxy double")
    got = spatial.overlapping_boxes(box((1, 0.0, 0.0, 9.0, 9.0), (2, -5.0, -5.0, -1.0, -1.0)), box((7, 1.0, 1.0, 8.0, 12.0), (8, 9.0, 0.0, 10.0, 1.0), (9, -9.0, -9.0, 9.0, 9.0)), 2.0)
    assert sorted(r[:] for r in got.collect()) == [(1, 7, 56.0), (1, 9, 81.0), (2, 9, 16.0)]
    assert "Aggregate" not in _plan(got)


def test_grids_of_one_box_are_met_once(spark):
    """Each feature and each grid met in every cell, and 600,000 rows were sorted out by an aggregate."""
    box = [F.lit(v).alias(c) for c, v in zip(("minx", "miny", "maxx", "maxy"), (0, 0, 7, 7), strict=True)]
    grids = spark.range(300).select(F.lit("l").alias("layer"), "id", (F.col("id") < 0).alias("preview"), *box).withColumnRenamed("id", "grid")
    got = layers.grids_for(spark.range(2000).select("id", *box), grids, 2.0)
    assert "keys=[id" not in _plan(got)
    assert got.agg(F.count("*"), F.countDistinct("id", "grid")).first()[:] == (600_000, 600_000)


def test_clean_rings_bind_their_steps(spark):
    """The expression of a clean ring held its steps many times over, each evaluated anew."""
    rings = spark.createDataFrame([([{"x": x, "y": y} for x, y in ((0.0, 0.0), (0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0))],)], "ring array<struct<x: double, y: double>>")
    clean = rings.select(geometry.clean_ring(F.col("ring")).alias("ring"))
    assert [(p.x, p.y) for p in clean.first().ring] == [(0, 0), (2, 0), (2, 2), (0, 0)]
    assert clean._jdf.queryExecution().optimizedPlan().toString().count("filter(") == 1


def test_calendars_meet_windows_without_a_row_for_each_year(spark):
    windows = spark.createDataFrame([(1, "maize", "2020-05-01", "2020-06-01"), (1, "maize", "2020-05-01", "2020-06-01"), (2, "rye", "2020-01-01", "2020-02-01")], "id long, crop_key string, s string, e string")
    windows = windows.select("id", "crop_key", F.to_date("s").alias("start"), F.to_date("e").alias("end"))
    calendar = spark.createDataFrame([("maize", "04-15", "10-15")], "calendar_key string, green_start string, green_end string")
    got = phenology.matches_calendar(windows, calendar)
    assert sorted((r.id, r.overlap, r.fits) for r in got.collect()) == [(1, 32, True), (2, None, True)]
    assert "Generate" not in _plan(got)


def test_nearest_noise_sorts_no_pairs(spark):
    """Pairs of pixels went through a sort for the aggregate, and were spilled."""
    df = spark.range(3000).select("id", (F.col("id") % 60).cast("double").alias("x"), F.floor(F.col("id") / 60).cast("double").alias("y"))
    got = boundary.nearest_noise(df, 60.0)
    assert "MapInArrow" in _plan(got)
    assert {r.id: (r.nearest, r.distance) for r in got.where("id in (0, 61, 2999)").collect()} == {0: (1, 1.0), 61: (1, 1.0), 2999: (2939, 1.0)}


def test_polygons_are_not_read_by_one_task(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(layer_queries.polygons, "load_polygons", lambda rows: seen.append(_plan(rows)) or polygons.Polygons(rows.selectExpr("1L pid", "NewID", "crp_lbl", "field", "array(array(named_struct('x', 1D))) rings"), [], 0))
    layer_queries.loaded_polygons(spark, sf)
    assert "Coalesce" not in seen[0] and "rangepartitioning(field" in seen[0]


def test_pairs_of_fields_are_never_shuffled(spark, monkeypatch):
    """Pairs of places and fields were, some 130 million rows at 6 GB; places of any number of fields meet in lists of a bounded size."""
    monkeypatch.setattr(spatial, "MEMBERS", 5)
    rng = random.Random(8)
    rows = [(k, None if k % 19 == 18 else rng.choice("abc"), float(rng.randrange(6)), float(rng.randrange(6))) for k in range(300)]
    pairs = spatial.neighbour_pairs(spark.createDataFrame(rows, "id long, crp_lbl string, x double, y double"), 1.5, digits=3)
    top = pairs._jdf.queryExecution().executedPlan().toString().split("Join")[0]
    assert top.count("Generate explode") == 2 and "Exchange" not in top
    want = [(a, b, p, q, round(((x - u) ** 2 + (y - v) ** 2) ** 0.5, 3)) for a, p, x, y in rows for b, q, u, v in rows if a < b and p and q and p != q and (x - u) ** 2 + (y - v) ** 2 <= 2.25]
    assert sorted((r.a_id, r.b_id, r.a_crp_lbl, r.b_crp_lbl, r.distance) for r in pairs.collect()) == sorted(want)
