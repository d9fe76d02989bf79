"""Queries over concave fields with holes and parts, hulls, blobs of pixels and bridges between species."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralyn.operators import blobs, boundary, cluster, graph, hulls, matrix, rings, stats
from terralyn.plans.derive import POINTS, points
from terralyn.plans.ring_queries import GRID, _raster
from terralyn.sources.scratch import cut
from terralyn.sources.tables import table

#: Corners of a field around its middle: an outline with a notch, anticlockwise, a hole that runs clockwise, and a second part.
OUTLINE = [(-4.0, -4.0), (4.0, -4.0), (4.0, 3.0), (1.0, 3.0), (0.0, -1.0), (-1.0, 3.0), (-4.0, 3.0)]
HOLE = [(-3.0, -3.0), (-3.0, -2.0), (3.0, -2.0), (3.0, -3.0)]
PART = [(5.0, -4.0), (6.5, -4.0), (6.0, 2.0)]
REACH, METRES, SIZE, DEGREES = 3.0, 90.0, 16.0, 5e-4


def _parts(spark, sf_dir, scale: float = 1.0):
    """Fields of three rings; the scale of a field's own size alternates."""
    own = points(spark, sf_dir).withColumns({"k": 1 + F.col("id") % 3 / 4, "x": F.col("x") + F.col("id") * 37 % 101 / 1009, "y": F.col("y") + F.col("id") * 53 % 103 / 1013})
    corner = lambda p: F.struct(((F.col("x") + F.col("k") * p[0]) * scale).alias("x"), ((F.col("y") + F.col("k") * p[1]) * scale).alias("y"))
    return own.select("id", "crp_lbl", F.array(*[F.array(*map(corner, ring)) for ring in (OUTLINE, HOLE, PART)]).alias("ring"))


def part_pairs(spark, sf_dir):
    """Fields with a notch, a hole and a second part, outline to outline."""
    out = rings.neighbour_rings(_parts(spark, sf_dir), REACH, SIZE, keep=["id"])
    return out.select("a_id", "b_id", F.round("distance", 8).alias("distance"))


def part_pairs_metres(spark, sf_dir):
    """The same as degrees, within metres."""
    out = rings.neighbour_rings(_parts(spark, sf_dir, DEGREES), METRES, SIZE * DEGREES, metric=True, keep=["id"])
    return out.select("a_id", "b_id", F.round("distance", 5).alias("distance"))


def part_components(spark, sf_dir):
    return graph.components(rings.linked_rings(_parts(spark, sf_dir), 0.5, SIZE))


def pixels_in_parts(spark, sf_dir):
    k = F.col("p_partkey")
    pixels = table(spark, sf_dir, "part").select(k.alias("pixel_id"), ((k * 7919) % 1000 + 0.3719).alias("px"), ((k * 6101) % 997 + 0.4137).alias("py"))
    return rings.points_in_rings(pixels, _parts(spark, sf_dir), SIZE, keep=["id"]).select("pixel_id", "id", F.round("edge_dist", 8).alias("edge_dist"))


def field_overlaps(spark, sf_dir):
    """Pairs of fields that share area, with that area."""
    own = _parts(spark, sf_dir)
    out = rings.overlapping_rings(own, own, SIZE, ordered=True)
    return out.select("a_id", "b_id", F.round("area", 6).alias("area"))


def field_overlap_hectares(spark, sf_dir):
    own = _parts(spark, sf_dir, DEGREES)
    return rings.overlapping_rings(own, own, SIZE * DEGREES, metric=True, ordered=True).select("a_id", "b_id", F.round("hectares", 5).alias("hectares"))


def _places(spark, sf_dir):
    """Customers by nation, in hundredths."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), ((k * 7919) % 1009 / 8).alias("x"), ((k * 104729) % 1013 / 8).alias("y"))


def hull_widths(spark, sf_dir):
    out = hulls.hulls(_places(spark, sf_dir), "nation")
    return out.select("nation", F.size("hull").alias("corners"), F.round("width", 8).alias("width"), F.round("area", 6).alias("area"))


def hull_corners(spark, sf_dir):
    return hulls.hulls(_places(spark, sf_dir), "nation").select("nation", F.explode("hull").alias("p")).select("nation", "p.x", "p.y")


def _plane(spark, sf_dir):
    """Embeddings in the plane of their first two numbers; every seventh is noise."""
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), v[0].cast("double").alias("x"), v[1].cast("double").alias("y"), F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label")).alias("cluster"))


def blob_gaps(spark, sf_dir):
    own = _plane(spark, sf_dir)
    out = blobs.boundary_gaps(own, blobs.circles(own))
    return out.select("id", F.round("gap", 7).alias("gap"), F.round("corridor", 7).alias("corridor"), "flagged")


def blob_circles(spark, sf_dir):
    return blobs.circles(_plane(spark, sf_dir)).select("cluster", *[F.round(c, 8).alias(c) for c in ("cx", "cy", "r")])


def nearest_distances(spark, sf_dir):
    return cluster.nearest_distance(points(spark, sf_dir), 4).withColumn("distance", F.round("distance", 8))


def density_reach(spark, sf_dir):
    return cluster.density_reach(points(spark, sf_dir)).withColumn("eps", F.round("eps", 8))


def density_clusters_auto(spark, sf_dir):
    """Density clusters within the reach that the points themselves suggest."""
    return cluster.dbscan(points(spark, sf_dir))


def default_threshold(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    scores = boundary.mean_nearest(rows.where("label <> 0"), rows.where("label = 0").select("v"), 4)
    return blobs.default_threshold(scores).withColumn("threshold", F.round("threshold", 8))


def _bridge(spark, sf_dir):
    cells = boundary.usable(_raster(spark, sf_dir))
    pure = cells.where("(row + col) % 4 <> 0").select((F.col("row") * GRID + F.col("col")).alias("id"), F.concat(F.lit("s"), F.col("row") % 3).alias("species"), F.col("values").alias("v"))
    return blobs.bridge(cells, blobs.bridge_model(pure, clusters=1))


def boundary_scores(spark, sf_dir):
    """Gradient, impurity and bridge of three grids at once, each on one scale for all; truth from the cells of edge pixels."""
    raster = _raster(spark, sf_dir)
    grids = raster.withColumn("grid", F.explode(F.array(*map(F.lit, range(3))))).withColumn("value", F.col("value") * (1 + F.col("grid") * F.col("row") / 50))
    cells = grids.select("grid", "row", "col").distinct()
    flat = cut(boundary.usable(boundary.stacked(grids)))
    pure = flat.where("(row + col) % 4 <> 0").select((F.col("row") * GRID + F.col("col")).alias("id"), F.concat(F.lit("s"), F.col("row") % 3).alias("species"), F.col("values").alias("v"))
    means = matrix.mean_vectors(pure.select(F.col("species").alias("class"), "v"), ["class"])
    edges = cells.where("row % 7 = 0")
    out = boundary.predictions(grids, cells.where("(row + col) % 5 <> 0"), edges, cells.where("col = 0"), means, blobs.bridge_model(pure, clusters=1))
    return out.withColumns({c: F.round(c, 7) for c in ("gradient", "impurity", "bridge")})


def boundary_scores_check(spark, sf_dir):
    """What SQL can say of boundary_scores: the two scores that need no components."""
    return boundary_scores(spark, sf_dir).select("grid", "row", "col", "label", "gradient", "impurity")


def bridge_scores(spark, sf_dir):
    """Cells between species in component space, one pure cluster a species."""
    return _bridge(spark, sf_dir).select("row", "col", F.round("bridge", 6).alias("bridge"))


def bridge_auc(spark, sf_dir):
    rows = _bridge(spark, sf_dir).select("bridge", (F.col("row") % 7 == 0).cast("int").alias("label"), (F.col("row") * GRID + F.col("col")).alias("tie")).withColumn("bridge", F.round("bridge", 9))
    out = stats.rank_auc(rows, "bridge", "label", "tie")
    return out.withColumns({c: F.round(c, 6) for c in out.columns})


QUERIES = {f.__name__: f for f in (part_pairs, part_pairs_metres, part_components, pixels_in_parts, field_overlaps, field_overlap_hectares, hull_widths, hull_corners, blob_gaps, blob_circles, nearest_distances, density_reach, density_clusters_auto, default_threshold, boundary_scores, boundary_scores_check, bridge_scores, bridge_auc)}

_RINGS = [OUTLINE, HOLE, PART]
_CORNERS = ", ".join(f"({r}, {k}, {len(ring)}, {x}, {y})" for r, ring in enumerate(_RINGS) for k, (x, y) in enumerate(ring))


def _sides(scale: float = 1.0) -> str:
    """f: middles and boxes; side: every side of every ring."""
    return f"""
{POINTS},
f AS (SELECT id, crp_lbl, x + id * 37 % 101 / 1009.0::DOUBLE AS x, y + id * 53 % 103 / 1013.0::DOUBLE AS y, 1 + id % 3 / 4.0::DOUBLE AS k FROM points),
o(r, n, m, ox, oy) AS (VALUES {_CORNERS}),
corner AS (SELECT id, r, n, m, (x + k * ox::DOUBLE) * {scale} AS vx, (y + k * oy::DOUBLE) * {scale} AS vy FROM f, o),
side AS (SELECT c.id, c.vx AS x1, c.vy AS y1, d.vx AS x2, d.vy AS y2 FROM corner c JOIN corner d ON d.id = c.id AND d.r = c.r AND d.n = (c.n + 1) % c.m),
box AS (SELECT id, min(vx) AS minx, max(vx) AS maxx, min(vy) AS miny, max(vy) AS maxy FROM corner GROUP BY 1)
"""


def _apart(scale: float, by: str, kx: str, ky: str) -> str:
    """apart: the squared distance of near pairs of fields, 0 where they share area."""
    t = "greatest(0, least(1, ((px - x1) * (x2 - x1) * kx * kx + (py - y1) * (y2 - y1) * ky * ky) / (pow((x2 - x1) * kx, 2) + pow((y2 - y1) * ky, 2))))"
    return f"""{_sides(scale)},
cand AS (SELECT p.id AS a, q.id AS b, {kx} AS kx, {ky} AS ky FROM box p JOIN box q ON p.id <> q.id AND p.minx - {by} <= q.maxx AND q.minx <= p.maxx + {by} AND p.miny - {by} <= q.maxy AND q.miny <= p.maxy + {by}),
near AS (SELECT a, b, min(pow((px - x1 - t * (x2 - x1)) * kx, 2) + pow((py - y1 - t * (y2 - y1)) * ky, 2)) AS d FROM (
  SELECT *, {t} AS t FROM (SELECT a, b, kx, ky, vx AS px, vy AS py, x1, y1, x2, y2 FROM cand JOIN corner c ON c.id = a JOIN side s ON s.id = b)) GROUP BY 1, 2),
hit AS (SELECT a, b, r, n, count(*) FILTER ((y1 > vy) <> (y2 > vy) AND vx < x1 + (x2 - x1) * (vy - y1) / (y2 - y1)) % 2 = 1 AS h FROM cand JOIN corner c ON c.id = a JOIN side s ON s.id = b GROUP BY 1, 2, 3, 4),
met AS (SELECT a, b, bool_or(h) AS inside FROM hit GROUP BY 1, 2),
crossed AS (SELECT a, b, bool_or(((s.x2 - s.x1) * (t.y1 - s.y1) - (s.y2 - s.y1) * (t.x1 - s.x1)) * ((s.x2 - s.x1) * (t.y2 - s.y1) - (s.y2 - s.y1) * (t.x2 - s.x1)) < 0
    AND ((t.x2 - t.x1) * (s.y1 - t.y1) - (t.y2 - t.y1) * (s.x1 - t.x1)) * ((t.x2 - t.x1) * (s.y2 - t.y1) - (t.y2 - t.y1) * (s.x2 - t.x1)) < 0) AS crossing
  FROM cand JOIN side s ON s.id = a JOIN side t ON t.id = b GROUP BY 1, 2),
apart AS (SELECT c.a, c.b, CASE WHEN m.inside OR w.inside OR crossing THEN 0 ELSE sqrt(least(n.d, o.d)) END AS distance FROM cand c JOIN near n USING (a, b) JOIN near o ON o.a = c.b AND o.b = c.a
  JOIN met m ON m.a = c.a AND m.b = c.b JOIN met w ON w.a = c.b AND w.b = c.a JOIN crossed x ON x.a = c.a AND x.b = c.b)
"""


def _shared(scale: float) -> str:
    """shared: the signed area that lies under a side of each of two fields, over all pairs of sides."""
    return f"""{_sides(scale)},
cand AS (SELECT p.id AS a, q.id AS b, least(p.miny, q.miny) AS base, (least(p.miny, q.miny) + greatest(p.maxy, q.maxy)) / 2 AS lat FROM box p JOIN box q ON p.id < q.id AND p.minx < q.maxx AND q.minx < p.maxx AND p.miny < q.maxy AND q.miny < p.maxy),
st AS (SELECT a, b, lat, base, s.x1 AS ax1, s.y1 - base AS ay1, s.x2 AS ax2, s.y2 - base AS ay2, t.x1 AS bx1, t.y1 - base AS by1, t.x2 AS bx2, t.y2 - base AS by2 FROM cand JOIN side s ON s.id = a JOIN side t ON t.id = b WHERE s.x1 <> s.x2 AND t.x1 <> t.x2),
sp AS (SELECT *, greatest(least(ax1, ax2), least(bx1, bx2)) AS lo, least(greatest(ax1, ax2), greatest(bx1, bx2)) AS hi FROM st),
he AS (SELECT *, ay1 + (ay2 - ay1) * (lo - ax1) / (ax2 - ax1) AS a0, ay1 + (ay2 - ay1) * (hi - ax1) / (ax2 - ax1) AS a1, by1 + (by2 - by1) * (lo - bx1) / (bx2 - bx1) AS b0, by1 + (by2 - by1) * (hi - bx1) / (bx2 - bx1) AS b1 FROM sp WHERE hi > lo),
shared AS (SELECT a, b, any_value(lat) AS lat, sum(sign(ax2 - ax1) * sign(bx2 - bx1) * CASE WHEN (a0 - b0) * (a1 - b1) < 0
   THEN (least(a0, b0) + a0 + (a0 - b0) / (a0 - b0 - a1 + b1) * (a1 - a0)) / 2 * (hi - lo) * (a0 - b0) / (a0 - b0 - a1 + b1) + (least(a1, b1) + a0 + (a0 - b0) / (a0 - b0 - a1 + b1) * (a1 - a0)) / 2 * (hi - lo) * (1 - (a0 - b0) / (a0 - b0 - a1 + b1))
   ELSE (least(a0, b0) + least(a1, b1)) / 2 * (hi - lo) END) AS area FROM he GROUP BY 1, 2),
own AS (SELECT id, abs(sum((x2 - x1) * (y1 + y2)) / 2) AS area FROM side GROUP BY 1),
pairs AS (SELECT shared.* FROM shared JOIN own x ON x.id = a JOIN own y ON y.id = b WHERE shared.area > 1e-9 * least(x.area, y.area))
"""


_HULL = """
p AS (SELECT DISTINCT c_nationkey AS nation, (c_custkey * 7919) % 1009 / 8.0::DOUBLE AS x, (c_custkey * 104729) % 1013 / 8.0::DOUBLE AS y FROM customer),
e AS (SELECT a.nation, a.x AS ax, a.y AS ay, b.x AS zx, b.y AS zy FROM p a JOIN p b ON a.nation = b.nation AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.nation = a.nation AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
     OR ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND NOT (c.x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) AND c.y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y))))))
"""
_BLOB = """
x AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS cluster FROM embeddings),
m AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS a, var_samp(y) AS d, covar_samp(x, y) AS b FROM x WHERE cluster >= 0 GROUP BY 1 HAVING count(*) >= 4),
c AS (SELECT cluster, cx, cy, 2 * sqrt(greatest(1e-9, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b))) AS r FROM m)
"""
_NEAREST = f"""
{POINTS},
d AS (SELECT p.id, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d FROM points p JOIN points q ON p.id <> q.id),
k AS (SELECT id, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS n, count(*) OVER (PARTITION BY id) AS c FROM d) WHERE n = least(4, c)),
e AS (SELECT d AS eps FROM (SELECT d, row_number() OVER (ORDER BY d) AS n, count(*) OVER () AS c FROM k) WHERE n = floor(c * 0.75) + 1)
"""

ORACLE_SQL = {
    "part_pairs": f"WITH {_apart(1.0, '3', '1', '1')} SELECT a AS a_id, b AS b_id, round(distance, 8) AS distance FROM apart JOIN f p ON p.id = a JOIN f q ON q.id = b WHERE a < b AND distance <= 3 AND p.crp_lbl <> q.crp_lbl",
    "part_pairs_metres": f"WITH {_apart(DEGREES, '0.004', '111320 * cos(radians((least(p.miny, q.miny) + greatest(p.maxy, q.maxy)) / 2))', '110540')} SELECT a AS a_id, b AS b_id, round(distance, 5) AS distance FROM apart JOIN f p ON p.id = a JOIN f q ON q.id = b WHERE a < b AND distance <= 90 AND p.crp_lbl <> q.crp_lbl",
    "part_components": f"""
WITH RECURSIVE {_apart(1.0, '1', '1', '1')}, pairs AS (SELECT a, b FROM apart WHERE distance <= 0.5), t AS (SELECT DISTINCT a AS id, a AS seen FROM pairs UNION SELECT t.id, b FROM t JOIN pairs ON a = t.seen)
SELECT id, min(seen) AS component FROM t GROUP BY 1
""",
    "pixels_in_parts": f"""
WITH {_sides()}, px AS (SELECT p_partkey AS pixel_id, (p_partkey * 7919) % 1000 + 0.3719::DOUBLE AS px, (p_partkey * 6101) % 997 + 0.4137::DOUBLE AS py FROM part),
h AS (SELECT pixel_id, id, px, py FROM px JOIN box ON px BETWEEN minx AND maxx AND py BETWEEN miny AND maxy),
s AS (SELECT *, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM h JOIN side USING (id))
SELECT pixel_id, id, round(min(sqrt(pow(px - x1 - t * (x2 - x1), 2) + pow(py - y1 - t * (y2 - y1), 2))), 8) AS edge_dist FROM s GROUP BY 1, 2
HAVING count(*) FILTER ((y1 > py) <> (y2 > py) AND px < x1 + (x2 - x1) * (py - y1) / (y2 - y1)) % 2 = 1
""",
    "field_overlaps": f"WITH {_shared(1.0)} SELECT a AS a_id, b AS b_id, round(area, 6) AS area FROM pairs",
    "field_overlap_hectares": f"WITH {_shared(DEGREES)} SELECT a AS a_id, b AS b_id, round(area * 111320 * cos(radians(lat)) * 110540 / 10000, 5) AS hectares FROM pairs",
    "hull_widths": f"""
WITH {_HULL}, w AS (SELECT e.nation, ax, ay, max(((zx - ax) * (c.y - ay) - (zy - ay) * (c.x - ax)) / sqrt(pow(zx - ax, 2) + pow(zy - ay, 2))) AS w FROM e JOIN p c ON c.nation = e.nation GROUP BY e.nation, ax, ay, zx, zy)
SELECT nation, CAST(n AS INTEGER) AS corners, round(w, 8) AS width, round(a, 6) AS area FROM (SELECT nation, min(w) AS w FROM w GROUP BY 1) JOIN (SELECT nation, count(*) AS n, sum(ax * zy - zx * ay) / 2 AS a FROM e GROUP BY 1) USING (nation)
""",
    "hull_corners": f"WITH {_HULL} SELECT nation, ax AS x, ay AS y FROM e",
    "blob_circles": f"WITH {_BLOB} SELECT cluster, round(cx, 8) AS cx, round(cy, 8) AS cy, round(r, 8) AS r FROM c",
    "blob_gaps": f"""
WITH {_BLOB}, g AS (SELECT id, min(sqrt(pow(x - cx, 2) + pow(y - cy, 2)) - r) AS gap FROM x, c GROUP BY 1),
l AS (SELECT a.cx AS lx, a.cy AS ly, b.cx - a.cx AS dx, b.cy - a.cy AS dy FROM c a JOIN c b ON a.cluster < b.cluster),
t AS (SELECT id, x, y, l.*, ((x - lx) * dx + (y - ly) * dy) / (dx * dx + dy * dy) AS t FROM x, l),
p AS (SELECT id, min(sqrt(pow(x - lx - t * dx, 2) + pow(y - ly - t * dy, 2))) AS corridor FROM t WHERE t BETWEEN 0 AND 1 GROUP BY 1)
SELECT id, round(gap, 7) AS gap, round(corridor, 7) AS corridor, gap > 0 AND coalesce(corridor <= (SELECT avg(r) FROM c), false) AS flagged FROM g LEFT JOIN p USING (id)
""",
    "nearest_distances": f"WITH {_NEAREST} SELECT id, round(d, 8) AS distance FROM k",
    "density_reach": f"WITH {_NEAREST} SELECT round(eps, 8) AS eps FROM e",
    "density_clusters_auto": f"""
WITH RECURSIVE {_NEAREST}, n AS (SELECT p.id AS a, q.id AS b FROM points p JOIN points q ON sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= (SELECT eps FROM e)),
core AS (SELECT a AS id FROM n GROUP BY 1 HAVING count(*) >= 4),
l AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
t AS (SELECT id, id AS seen FROM core UNION SELECT t.id, l.b FROM t JOIN l ON l.a = t.seen),
c AS (SELECT id, min(seen) AS cluster FROM t GROUP BY 1),
b AS (SELECT a AS id, arg_min(c.cluster, b) AS cluster FROM n JOIN c ON c.id = n.b GROUP BY 1)
SELECT id, coalesce(c.cluster, b.cluster, -1) AS cluster FROM points LEFT JOIN c USING (id) LEFT JOIN b USING (id)
""",
    "boundary_scores_check": f"""
WITH raster AS (SELECT grid, row, col, date, value * (1 + grid * row / 50.0::DOUBLE) AS value FROM (SELECT l_suppkey % 20 AS row, l_partkey % 20 AS col, l_orderkey % 3 AS date, avg(l_extendedprice) / 100000 AS value FROM lineitem GROUP BY 1, 2, 3), range(3) g(grid)),
cells AS (SELECT grid, row, col FROM raster GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(DISTINCT date) FROM raster)),
good AS (SELECT raster.* FROM raster JOIN cells USING (grid, row, col)),
w AS (SELECT dy, dx, dx * CASE dy WHEN 0 THEN 2 ELSE 1 END AS wx, dy * CASE dx WHEN 0 THEN 2 ELSE 1 END AS wy FROM range(-1, 2) a(dy), range(-1, 2) b(dx)),
g AS (SELECT grid, row - dy AS row, col - dx AS col, date, sum(value * wx) AS gx, sum(value * wy) AS gy FROM good, w GROUP BY 1, 2, 3, 4 HAVING count(*) = 9),
grad AS (SELECT grid, row, col, sqrt(sum(gx * gx + gy * gy)) AS gradient FROM g GROUP BY 1, 2, 3),
pure AS (SELECT (grid * 1048576 + row) % 3 AS class, date, avg(value) AS m FROM good WHERE (grid * 1048576 + row + col) % 4 <> 0 GROUP BY 1, 2),
imp AS (SELECT grid, row, col, min(d) AS impurity FROM (SELECT grid, row, col, class, sqrt(sum((value - m) * (value - m))) AS d FROM good JOIN pure USING (date) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
own AS (SELECT grid, row, col, CASE WHEN row % 7 = 0 THEN 1 ELSE 0 END AS label, gradient, impurity FROM cells LEFT JOIN grad USING (grid, row, col) LEFT JOIN imp USING (grid, row, col) WHERE (row + col) % 5 <> 0),
r AS (SELECT *, row_number() OVER (ORDER BY gradient NULLS LAST) AS ng, count(gradient) OVER () AS cg, row_number() OVER (ORDER BY impurity NULLS LAST) AS ni, count(impurity) OVER () AS ci FROM own),
tops AS (SELECT max(gradient) FILTER (ng = floor(cg * 0.98) + 1) AS tg, max(impurity) FILTER (ni = floor(ci * 0.98) + 1) AS ti FROM r)
SELECT grid, row, col, label, round(CASE WHEN gradient IS NOT NULL THEN least(1.0, gradient / CASE WHEN tg > 0 THEN tg ELSE 1 END) END, 7) AS gradient, round(least(1.0, impurity / CASE WHEN ti > 0 THEN ti ELSE 1 END), 7) AS impurity FROM own, tops
""",
    "default_threshold": """
WITH x AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings),
d AS (SELECT x.id, y.id AS ref, sqrt(sum((x.v - y.v) * (x.v - y.v))) AS d FROM x JOIN x y ON y.i = x.i AND y.label = 0 WHERE x.label <> 0 GROUP BY 1, 2),
s AS (SELECT id, avg(d) AS s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS n FROM d) WHERE n <= 4 GROUP BY 1)
SELECT round(s, 8) AS threshold FROM (SELECT s, row_number() OVER (ORDER BY s) AS n, count(*) OVER () AS c FROM s) WHERE n = floor(c * 0.6) + 1
""",
}
