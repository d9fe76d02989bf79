"""Zones of pixels among crowds of fields, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from terralyn.operators import rings, zones

BOXES = "id long, crp_lbl string, minx double, miny double, maxx double, maxy double"


def _zone(buffer, edge, other, same):
    return "interior" if edge >= buffer else "edge_other" if other else "edge_same" if same else "edge_isolated"


def _fields(seed, n):
    rng = np.random.default_rng(seed)
    corner = rng.integers(0, 60, (n, 2)).astype(float)
    return [(k, [None, "a", "b", "c"][int(rng.integers(4))], *c, *(c + rng.integers(3, 9))) for k, c in enumerate(corner.tolist())], rng


def test_zones_equal_brute_force(spark):
    fields, rng = _fields(3, 60)
    pixels = [(k, *map(float, p)) for k, p in enumerate(rng.integers(0, 64, (300, 2)).tolist())]
    want = {}
    for k, x, y in pixels:
        for f in fields:
            edge = min(x - f[2], f[4] - x, y - f[3], f[5] - y)
            if edge >= 0:
                near = [g for g in fields if g[0] != f[0] and g[1] and max(0, g[2] - x, x - g[4]) ** 2 + max(0, g[3] - y, y - g[5]) ** 2 <= (edge + 3) ** 2]
                want[k, f[0]] = (f[1], edge, _zone(2, edge, f[1] and any(g[1] != f[1] for g in near), f[1] and any(g[1] == f[1] for g in near)))
    frames = spark.createDataFrame(pixels, "pixel_id long, px double, py double"), spark.createDataFrame([(f[0], f[1], *map(float, f[2:])) for f in fields], BOXES)
    got = {(r.pixel_id, r.field_id): (r.crp_lbl, r.edge_dist, r.zone) for r in zones.classify(*frames, 2.0, 3.0, 5.0).collect()}
    assert got == want and len({w[2] for w in want.values()}) == 4
    key = lambda df: sorted(map(repr, df.select("field_id", "interior", "edge_other", "edge_same", "edge_isolated").collect()))
    assert key(zones.count_zones(*frames, 2.0, 3.0, 5.0)) == key(zones.zone_counts(zones.classify(*frames, 2.0, 3.0, 5.0)))


def test_zones_of_a_crowd_of_fields(spark):
    """4,000 fields of one box and 400 pixels were 6.4 billion pairs."""
    fields = spark.range(4000).select("id", F.when(F.col("id") > 0, "a").otherwise("b").alias("crp_lbl"), *[F.lit(v).alias(c) for c, v in zip(("minx", "miny", "maxx", "maxy"), (0.0, 0.0, 8.0, 8.0), strict=True)])
    pixels = spark.range(400).select(F.col("id").alias("pixel_id"), (F.col("id") % 8).cast("double").alias("px"), F.lit(4.0).alias("py"))
    got = {r.zone: r.n for r in zones.classify(pixels, fields, 3.0, 1.0, 20.0).groupBy("zone").agg(F.count("*").alias("n")).collect()}
    assert got == {"interior": 3 * 50 * 4000, "edge_other": 5 * 50 * 4000}
    assert zones.count_zones(pixels, fields, 3.0, 1.0, 20.0).agg(F.sum("interior"), F.sum("edge_other"), F.count("*")).first()[:] == (600_000, 1_000_000, 4000)


def _square(f):
    return [{"x": x, "y": y} for x, y in ((f[2], f[3]), (f[4], f[3]), (f[4], f[5]), (f[2], f[5]))]


def test_ring_zones_and_gaps_equal_brute_force(spark):
    fields, rng = _fields(5, 50)
    pixels = [(k, *(p + 0.37)) for k, p in enumerate(rng.uniform(-2, 66, (200, 2)).round(1))]
    zones_, gaps = {}, {}
    for k, x, y in pixels:
        apart = {f[0]: np.hypot(max(0, f[2] - x, x - f[4]), max(0, f[3] - y, y - f[5])) for f in fields}
        own = fields[k % 50]
        for f in fields:
            edge = min(x - f[2], f[4] - x, y - f[3], f[5] - y)
            if edge > 0:
                near = [g[1] for g in fields if g[0] != f[0] and g[1] and apart[g[0]] <= edge + 3]
                zones_[k, f[0]] = _zone(2, edge, f[1] and any(g != f[1] for g in near), f[1] and any(g == f[1] for g in near))
        near = [g for g in fields if g[0] != own[0] and apart[g[0]] <= 4]
        kinds_ = {g[1] != own[1] for g in near if g[1] and own[1]}
        if kinds_ and all(apart[g[0]] > 0 for g in near):
            gaps[k, own[0]] = "edge_other" if True in kinds_ else "edge_same"
    frame = spark.createDataFrame([(f[0], f[1], _square([float(v) if j > 1 else v for j, v in enumerate(f)])) for f in fields], "id long, crp_lbl string, ring array<struct<x: double, y: double>>")
    asked = spark.createDataFrame([(k, float(x), float(y), k % 50, fields[k % 50][1]) for k, x, y in pixels], "pixel_id long, px double, py double, field_id long, crp_lbl string")
    got = {(r.pixel_id, r.field_id): r.zone for r in rings.classify_rings(asked.select("pixel_id", "px", "py"), frame, 2.0, 3.0, 5.0).collect()}
    assert got == zones_ and len(set(got.values())) == 4
    assert {(r.pixel_id, r.field_id): r.zone for r in rings.classify_gaps(asked, frame, 4.0, 5.0).collect()} == gaps and gaps


def test_rings_of_a_crowd_of_fields(spark):
    """1,500 fields of one outline and 400 pixels in each were 900 million pairs of sides and pixels four times over."""
    ring = _square((0, "", 0.0, 0.0, 8.0, 8.0))
    fields = spark.range(1500).select("id", F.when(F.col("id") > 0, "a").otherwise("b").alias("crp_lbl"), F.array(*[F.struct(F.lit(p["x"]).alias("x"), F.lit(p["y"]).alias("y")) for p in ring]).alias("ring"))
    pixels = spark.range(400).select(F.col("id").alias("pixel_id"), (F.col("id") % 8 + 0.5).alias("px"), F.lit(4.0).alias("py"))
    got = {r.zone: r.n for r in rings.classify_rings(pixels, fields, 3.0, 1.0, 20.0).groupBy("zone").agg(F.count("*").alias("n")).collect()}
    assert got == {"interior": 2 * 50 * 1500, "edge_other": 6 * 50 * 1500}
    gaps = pixels.withColumns({"px": F.lit(10.0), "field_id": F.lit(0).cast("long"), "crp_lbl": F.lit("b")})
    assert rings.classify_gaps(gaps, fields, 4.0, 20.0).where("zone = 'edge_other'").count() == 400
