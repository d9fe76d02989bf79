"""Queries over field outlines and rasters: customers as diamond-shaped fields, parts as pixels, line items as a raster."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralyn.functions import geometry
from terralyn.operators import boundary, graph, matrix, rings, stats
from terralyn.plans.derive import POINTS, points
from terralyn.sources.tables import table

REACH, SIZE, GRID = 6.0, 24.0, 20


def _fields(spark, sf_dir):
    """Diamonds of half widths 3 to 5 and half heights 3 to 4 around the points."""
    a, b = (F.col("id") % 3 + 3).cast("double"), (F.col("id") % 2 + 3).cast("double")
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    zero = F.lit(0.0)
    return points(spark, sf_dir).select("id", "crp_lbl", F.array(corner(-a, zero), corner(zero, -b), corner(a, zero), corner(zero, b)).alias("ring"))


def _pixels(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("pixel_id"), ((k * 7919) % 1000 + 0.3719).alias("px"), ((k * 6101) % 997 + 0.4137).alias("py"))


def ring_pairs(spark, sf_dir):
    out = rings.neighbours_of_alike(_fields(spark, sf_dir), REACH, SIZE, 8)
    return out.select("a_id", "b_id", "a_crp_lbl", "b_crp_lbl", "distance")


def ring_neighbours(spark, sf_dir):
    fields = _fields(spark, sf_dir)
    return rings.rings_around(fields, fields.where("crp_lbl = 'BUILDING'"), REACH, SIZE).select("id", "crp_lbl")


def ring_components(spark, sf_dir):
    return graph.components(rings.linked_rings(_fields(spark, sf_dir), REACH, SIZE, mixed=True))


def pixels_in_rings(spark, sf_dir):
    out = rings.points_in_rings(_pixels(spark, sf_dir), _fields(spark, sf_dir), SIZE, keep=["id", "crp_lbl"])
    return rings.first_field(out).select("pixel_id", "id", "crp_lbl", F.round("edge_dist", 8).alias("edge_dist"))


def raster_fill(spark, sf_dir):
    return rings.inside_any(_pixels(spark, sf_dir), _fields(spark, sf_dir), SIZE).select("pixel_id")


def ring_zones(spark, sf_dir):
    fields = _fields(spark, sf_dir).withColumn("crp_lbl", F.when(F.col("id") % 11 != 0, F.col("crp_lbl")))
    out = rings.classify_rings(_pixels(spark, sf_dir), fields, 1.5, 4.0, SIZE)
    return out.withColumn("edge_dist", F.round("edge_dist", 8))


def gap_pixels(spark, sf_dir):
    fields = _fields(spark, sf_dir)
    own = _pixels(spark, sf_dir).withColumn("field_id", F.col("pixel_id") % 150 + 1).join(fields.select(F.col("id").alias("field_id"), "crp_lbl"), "field_id")
    return rings.classify_gaps(own, fields, 4.0, SIZE)


def outline_cells(spark, sf_dir):
    return rings.outline_cells(_fields(spark, sf_dir), 2.0)


def cell_overlaps(spark, sf_dir):
    """The area that each field shares with the unit cells of its middle row; equal fields are measured once."""
    own = points(spark, sf_dir).select("id", "x", "y").join(_fields(spark, sf_dir).select("id", "ring"), "id")
    k = F.explode(F.sequence(F.lit(-5), F.lit(4))).alias("k")
    cells = own.select("x", "y", "ring").distinct().select(k, "x", "y", "ring")
    area = geometry.overlap_area(F.col("ring"), F.col("x") + F.col("k"), F.col("y"), F.col("x") + F.col("k") + 1, F.col("y") + 1)
    return own.join(cells.select("x", "y", "ring", "k", F.round(area, 8).alias("area")), ["x", "y", "ring"]).select("id", "k", "area")


def trial_angle(spark, sf_dir):
    """The length-weighted mean direction of outlines, over quarter turns, by species."""
    side = _fields(spark, sf_dir).select("crp_lbl", F.explode(geometry.segments(F.col("ring"))).alias("s"))
    dx, dy = F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y")
    return stats.quarter_turn_mean(side.select("crp_lbl", F.hypot(dx, dy).alias("length"), F.atan2(dy, dx).alias("angle")), ["crp_lbl"]).withColumn("angle", F.round("angle", 6))


def utm_round_trip(spark, sf_dir):
    """Projected and back again."""
    own = points(spark, sf_dir).select("id", (F.col("x") * 0.36 - 180).alias("lng"), (F.col("y") * 0.16 - 80).alias("lat"))
    zone = geometry.utm_zone(F.col("lng"))
    utm = own.select("id", zone.alias("zone"), (F.col("lat") < 0).alias("south"), geometry.to_utm(F.col("lng"), F.col("lat"), zone).alias("u"))
    back = geometry.from_utm(F.col("u.easting"), F.col("u.northing"), F.col("zone"), F.col("south"))
    return utm.select("id", F.round(back["lng"], 6).alias("lng"), F.round(back["lat"], 6).alias("lat"))


def nearest_turns(spark, sf_dir):
    own = points(spark, sf_dir).withColumn("d", F.col("x") - 500.5)
    return own.select("id", F.round(geometry.nearest_turn(F.col("d")), 8).alias("turn"), geometry.is_aligned(F.col("d"), 5.0).alias("aligned"))


def nearest_noise(spark, sf_dir):
    return boundary.nearest_noise(points(spark, sf_dir), 20.0).withColumn("distance", F.round("distance", 8))


def mean_nearest(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return boundary.mean_nearest(rows, rows.where("label = 0").select("v"), 4).withColumn("distance", F.round("distance", 8))


def _raster(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_suppkey") % GRID).alias("row"), (F.col("l_partkey") % GRID).alias("col"), (F.col("l_orderkey") % 3).alias("date")).agg((F.avg("l_extendedprice") / 100000).alias("value"))


def boundary_gradient(spark, sf_dir):
    return boundary.gradient(boundary.usable(_raster(spark, sf_dir))).withColumn("gradient", F.round("gradient", 8))


def _prediction(spark, sf_dir):
    raster = _raster(spark, sf_dir)
    pure = matrix.mean_vectors(boundary.usable(raster).select((F.col("row") % 3).alias("class"), F.col("values").alias("v")), ["class"])
    cells = raster.select("row", "col").distinct()
    return boundary.prediction(raster, cells.where("(row + col) % 5 <> 0"), cells.where("row % 7 = 0"), pure)


def boundary_prediction(spark, sf_dir):
    return _prediction(spark, sf_dir).withColumns({c: F.round(c, 7) for c in ("gradient", "impurity")})


def boundary_auc(spark, sf_dir):
    """How well impurity tells boundary cells, with a tie in order of row and column."""
    out = stats.rank_auc(_prediction(spark, sf_dir).withColumn("tie", F.col("row") * GRID + F.col("col")), "impurity", "label", "tie")
    return out.withColumns({c: F.round(c, 6) for c in out.columns})


QUERIES = {f.__name__: f for f in (ring_pairs, ring_neighbours, ring_components, pixels_in_rings, raster_fill, ring_zones, gap_pixels, outline_cells, cell_overlaps, trial_angle, utm_round_trip, nearest_turns, nearest_noise, mean_nearest, boundary_gradient, boundary_prediction, boundary_auc)}

_APART = """sqrt(pow(px - x1 - t * (x2 - x1), 2) + pow(py - y1 - t * (y2 - y1), 2))"""


def _to_sides(rows: str) -> str:
    """Rows with px, py and the side x1, y1, x2, y2, and the distance d."""
    return f"SELECT *, {_APART} AS d FROM (SELECT *, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM ({rows}))"


_FIELDS = f"""
{POINTS},
f AS (SELECT *, CAST(id % 3 + 3 AS DOUBLE) AS a, CAST(id % 2 + 3 AS DOUBLE) AS b FROM points),
corner AS (SELECT id, k, x + CASE k WHEN 0 THEN -a WHEN 2 THEN a ELSE 0 END AS vx, y + CASE k WHEN 1 THEN -b WHEN 3 THEN b ELSE 0 END AS vy FROM f, range(4) r(k)),
side AS (SELECT c.id, c.vx AS x1, c.vy AS y1, d.vx AS x2, d.vy AS y2 FROM corner c JOIN corner d ON d.id = c.id AND d.k = (c.k + 1) % 4),
px AS (SELECT p_partkey AS pixel_id, (p_partkey * 7919) % 1000 + 0.3719::DOUBLE AS px, (p_partkey * 6101) % 997 + 0.4137::DOUBLE AS py FROM part),
hit AS (SELECT pixel_id, px, py, id, crp_lbl FROM px JOIN f ON abs(px - x) * b + abs(py - y) * a < a * b),
placed AS (SELECT pixel_id, id, any_value(crp_lbl) AS crp_lbl, min(d) AS edge_dist FROM ({_to_sides("SELECT h.*, x1, y1, x2, y2 FROM hit h JOIN side USING (id)")}) GROUP BY 1, 2)
"""
_RINGS = f"""
{_FIELDS},
cand AS (SELECT p.id AS a_id, q.id AS b_id, p.crp_lbl AS a_crp_lbl, q.crp_lbl AS b_crp_lbl FROM f p JOIN f q ON p.id <> q.id AND abs(p.x - q.x) <= 20 AND abs(p.y - q.y) <= 20),
near AS (SELECT a_id, b_id, min(d) AS d FROM ({_to_sides("SELECT a_id, b_id, vx AS px, vy AS py, x1, y1, x2, y2 FROM cand JOIN corner c ON c.id = a_id JOIN side s ON s.id = b_id")}) GROUP BY 1, 2),
met AS (SELECT a_id, b_id, bool_or(abs(vx - x) * b + abs(vy - y) * a < a * b) AS inside FROM cand JOIN corner c ON c.id = a_id JOIN f ON f.id = b_id GROUP BY 1, 2),
crossed AS (SELECT a_id, b_id, bool_or(((s.x2 - s.x1) * (t.y1 - s.y1) - (s.y2 - s.y1) * (t.x1 - s.x1)) * ((s.x2 - s.x1) * (t.y2 - s.y1) - (s.y2 - s.y1) * (t.x2 - s.x1)) < 0
    AND ((t.x2 - t.x1) * (s.y1 - t.y1) - (t.y2 - t.y1) * (s.x1 - t.x1)) * ((t.x2 - t.x1) * (s.y2 - t.y1) - (t.y2 - t.y1) * (s.x2 - t.x1)) < 0) AS crossing
  FROM cand JOIN side s ON s.id = a_id JOIN side t ON t.id = b_id GROUP BY 1, 2),
apart AS (SELECT c.*, CASE WHEN m.inside OR w.inside OR crossing THEN 0 ELSE least(n.d, o.d) END AS distance FROM cand c JOIN near n USING (a_id, b_id) JOIN near o ON o.a_id = c.b_id AND o.b_id = c.a_id
  JOIN met m ON m.a_id = c.a_id AND m.b_id = c.b_id JOIN met w ON w.a_id = c.b_id AND w.b_id = c.a_id JOIN crossed x ON x.a_id = c.a_id AND x.b_id = c.b_id),
pairs AS (SELECT * FROM apart WHERE distance <= 6 AND a_crp_lbl <> b_crp_lbl)
"""
_RASTER = """
raster AS (SELECT l_suppkey % 20 AS row, l_partkey % 20 AS col, l_orderkey % 3 AS date, avg(l_extendedprice) / 100000 AS value FROM lineitem GROUP BY 1, 2, 3),
cells AS (SELECT row, col FROM raster GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT date) FROM raster)),
good AS (SELECT raster.* FROM raster JOIN cells USING (row, col)),
w AS (SELECT dy, dx, dx * CASE dy WHEN 0 THEN 2 ELSE 1 END AS wx, dy * CASE dx WHEN 0 THEN 2 ELSE 1 END AS wy FROM range(-1, 2) a(dy), range(-1, 2) b(dx)),
g AS (SELECT row - dy AS row, col - dx AS col, date, sum(value * wx) AS gx, sum(value * wy) AS gy FROM good, w GROUP BY 1, 2, 3 HAVING count(*) = 9),
grad AS (SELECT row, col, sqrt(sum(gx * gx + gy * gy)) AS gradient FROM g GROUP BY 1, 2)
"""
_PREDICTED = f"""
{_RASTER},
pure AS (SELECT row % 3 AS class, date, avg(value) AS m FROM good GROUP BY 1, 2),
imp AS (SELECT row, col, min(d) AS impurity FROM (SELECT row, col, class, sqrt(sum((value - m) * (value - m))) AS d FROM good JOIN pure USING (date) GROUP BY 1, 2, 3) GROUP BY 1, 2),
own AS (SELECT row, col, CASE WHEN row % 7 = 0 THEN 1 ELSE 0 END AS label, gradient, impurity FROM cells LEFT JOIN grad USING (row, col) LEFT JOIN imp USING (row, col) WHERE (row + col) % 5 <> 0),
r AS (SELECT *, row_number() OVER (ORDER BY gradient NULLS LAST) AS ng, count(gradient) OVER () AS cg, row_number() OVER (ORDER BY impurity NULLS LAST) AS ni, count(impurity) OVER () AS ci FROM own),
tops AS (SELECT max(gradient) FILTER (ng = floor(cg * 0.98) + 1) AS tg, max(impurity) FILTER (ni = floor(ci * 0.98) + 1) AS ti FROM r),
pred AS (SELECT row, col, label, CASE WHEN gradient IS NOT NULL THEN least(1.0, gradient / CASE WHEN tg > 0 THEN tg ELSE 1 END) END AS gradient, least(1.0, impurity / CASE WHEN ti > 0 THEN ti ELSE 1 END) AS impurity FROM own, tops)
"""

ORACLE_SQL = {
    "ring_pairs": f"WITH {_RINGS} SELECT a_id, b_id, a_crp_lbl, b_crp_lbl, round(distance, 8) AS distance FROM pairs WHERE a_id < b_id",
    "ring_neighbours": f"WITH {_RINGS} SELECT id, crp_lbl FROM f WHERE crp_lbl = 'BUILDING' OR id IN (SELECT b_id FROM apart WHERE distance <= 6 AND a_crp_lbl = 'BUILDING')",
    "ring_components": f"""
WITH RECURSIVE {_RINGS}, t AS (SELECT DISTINCT a_id AS id, a_id AS seen FROM pairs UNION SELECT t.id, b_id FROM t JOIN pairs ON a_id = t.seen)
SELECT id, min(seen) AS component FROM t GROUP BY 1
""",
    "pixels_in_rings": f"WITH {_FIELDS} SELECT pixel_id, id, crp_lbl, round(edge_dist, 8) AS edge_dist FROM placed WHERE (pixel_id, id) IN (SELECT (pixel_id, min(id)) FROM placed GROUP BY pixel_id)",
    "raster_fill": f"WITH {_FIELDS} SELECT DISTINCT pixel_id FROM placed",
    "ring_zones": f"""
WITH {_FIELDS}, l AS (SELECT id, CASE WHEN id % 11 <> 0 THEN crp_lbl END AS lbl FROM f),
p AS (SELECT placed.pixel_id, placed.id AS field_id, lbl AS crp_lbl, edge_dist, px, py FROM placed JOIN px USING (pixel_id) JOIN l ON l.id = placed.id),
o AS (SELECT p.*, l.lbl, f.id AS oid, abs(px - x) * b + abs(py - y) * a < a * b AS inside FROM p JOIN f ON f.id <> field_id AND abs(px - x) <= 12 AND abs(py - y) <= 12 JOIN l ON l.id = f.id WHERE edge_dist < 1.5),
d AS (SELECT pixel_id, field_id, oid, any_value(crp_lbl) AS own, any_value(lbl) AS lbl, any_value(edge_dist) AS edge_dist, CASE WHEN any_value(inside) THEN 0 ELSE min(d) END AS apart
  FROM ({_to_sides("SELECT o.*, x1, y1, x2, y2 FROM o JOIN side ON side.id = oid")}) GROUP BY 1, 2, 3),
k AS (SELECT pixel_id, field_id, bool_or(lbl <> own) AS other, bool_or(lbl = own) AS same FROM d WHERE apart <= edge_dist + 4 GROUP BY 1, 2)
SELECT pixel_id, field_id, crp_lbl, round(edge_dist, 8) AS edge_dist, CASE WHEN edge_dist >= 1.5 THEN 'interior' WHEN other THEN 'edge_other' WHEN same THEN 'edge_same' ELSE 'edge_isolated' END AS zone FROM p LEFT JOIN k USING (pixel_id, field_id)
""",
    "gap_pixels": f"""
WITH {_FIELDS}, p AS (SELECT pixel_id, px, py, pixel_id % 150 + 1 AS field_id, crp_lbl FROM px JOIN f ON f.id = pixel_id % 150 + 1),
o AS (SELECT p.*, f.crp_lbl AS lbl, f.id AS oid, abs(px - x) * b + abs(py - y) * a < a * b AS inside FROM p JOIN f ON f.id <> field_id AND abs(px - x) <= 12 AND abs(py - y) <= 12),
d AS (SELECT pixel_id, field_id, oid, any_value(crp_lbl) AS own, any_value(lbl) AS lbl, any_value(inside) AS inside, min(d) AS apart FROM ({_to_sides("SELECT o.*, x1, y1, x2, y2 FROM o JOIN side ON side.id = oid")}) GROUP BY 1, 2, 3),
k AS (SELECT pixel_id, field_id, bool_or(inside) AS inside, bool_or(apart <= 4 AND lbl <> own) AS other, bool_or(apart <= 4 AND lbl = own) AS same FROM d GROUP BY 1, 2)
SELECT pixel_id, field_id, CASE WHEN other THEN 'edge_other' ELSE 'edge_same' END AS zone FROM k WHERE NOT inside AND (other OR same)
""",
    "outline_cells": f"""
WITH {_FIELDS}, n AS (SELECT *, CAST(greatest(1, ceil(greatest(abs(x2 - x1), abs(y2 - y1)) / 2.0)) AS BIGINT) AS n FROM side),
k AS (SELECT *, unnest(range(0, n + 1)) / CAST(n AS DOUBLE) AS t FROM n),
c AS (SELECT CAST(floor((y1 + t * (y2 - y1)) / 2.0) AS BIGINT) AS row, CAST(floor((x1 + t * (x2 - x1)) / 2.0) AS BIGINT) AS col FROM k)
SELECT DISTINCT row + dy AS row, col + dx AS col FROM c, (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) d(dy, dx)
""",
    # the height of a diamond over its middle row falls linearly to 0 at its side corners; cells are one high
    "cell_overlaps": f"""
WITH {_FIELDS}, q AS (SELECT id, a, b, CAST(k AS INTEGER) AS k, least(abs(k), abs(k + 1)) AS lo, greatest(abs(k), abs(k + 1)) AS hi FROM f, range(-5, 5) r(k)),
e AS (SELECT *, least(lo, a) AS l, least(hi, a) AS h, greatest(least(a * (1 - 1 / b), hi), lo) AS c FROM q)
SELECT id, k, round(CASE WHEN lo >= a THEN 0 ELSE (c - lo) + CASE WHEN h > c THEN b * ((h - c) - (h * h - c * c) / (2 * a)) ELSE 0 END END, 8) AS area FROM e
""",
    "trial_angle": f"""
WITH {_FIELDS}, s AS (SELECT crp_lbl, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS l, atan2(y2 - y1, x2 - x1) AS g FROM side JOIN f USING (id)),
m AS (SELECT crp_lbl, degrees(atan2(sum(l * sin(4 * g)), sum(l * cos(4 * g)))) / 4 AS d FROM s GROUP BY 1)
SELECT crp_lbl, round(d - 90 * floor(d / 90), 6) AS angle FROM m
""",
    "utm_round_trip": f"WITH {POINTS} SELECT id, round(x * 0.36 - 180, 6) AS lng, round(y * 0.16 - 80, 6) AS lat FROM points",
    "nearest_turns": f"WITH {POINTS}, d AS (SELECT id, 45 - (45 - (x - 500.5) - 90 * floor((45 - (x - 500.5)) / 90)) AS turn FROM points) SELECT id, round(turn, 8) AS turn, abs(turn) <= 5 AS aligned FROM d",
    "nearest_noise": f"""
WITH {POINTS}, d AS (SELECT p.id, q.id AS nearest, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d FROM points p JOIN points q ON p.id <> q.id AND abs(floor(p.x / 20) - floor(q.x / 20)) <= 1 AND abs(floor(p.y / 20) - floor(q.y / 20)) <= 1)
SELECT id, nearest, round(d, 8) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nearest) AS n FROM d) WHERE n = 1
""",
    "mean_nearest": """
WITH x AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings),
d AS (SELECT x.id, y.id AS ref, sqrt(sum((x.v - y.v) * (x.v - y.v))) AS d FROM x JOIN x y ON y.i = x.i AND y.label = 0 GROUP BY 1, 2)
SELECT id, round(avg(d), 8) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS n FROM d) WHERE n <= 4 GROUP BY 1
""",
    "boundary_gradient": f"WITH {_RASTER} SELECT row, col, round(gradient, 8) AS gradient FROM grad",
    "boundary_prediction": f"WITH {_PREDICTED} SELECT row, col, label, round(gradient, 7) AS gradient, round(impurity, 7) AS impurity FROM pred",
    "boundary_auc": f"""
WITH {_PREDICTED}, k AS (SELECT *, row_number() OVER (ORDER BY impurity, row * 20 + col) AS k FROM pred),
s AS (SELECT CAST(sum(CASE label WHEN 1 THEN k ELSE 0 END) AS DOUBLE) AS rs, CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n, avg(impurity) FILTER (label = 1) AS mp, avg(impurity) FILTER (label = 0) AS mn FROM k)
SELECT round((rs - p * (p + 1) / 2) / nullif(p * (n - p), 0), 6) AS auc, round(mp, 6) AS mean_positive, round(mn, 6) AS mean_negative FROM s
""",
}
