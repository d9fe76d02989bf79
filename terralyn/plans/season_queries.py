"""Queries of the phenology, clustering, zone and text-geometry slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralyn.functions import curves as shapes
from terralyn.functions import geometry
from terralyn.operators import cluster, graph, phenology, spatial, zones
from terralyn.plans.derive import PAIRS, POINTS, REACH, points, season_sql
from terralyn.sources import geometry_text, sinks
from terralyn.sources.tables import table


def _curves(spark, sf_dir):
    """Order priorities as species: a maize season sampled on order days, with a price's small noise."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("species"), (F.col("o_custkey") % 4).alias("cluster"), (F.floor(F.dayofyear("o_orderdate") / 10) * 10 + 5).alias("day"), "o_totalprice")
    t = F.col("day").cast("double")
    value = shapes.double_logistic(t, *shapes.PRESETS["maize"]) + (F.floor("o_totalprice") % 100) / 5000.0
    return o.withColumn("value", value).groupBy("species", "cluster", "day").agg(F.avg("value").alias("value"))


def _sparse(spark, sf_dir):
    """Customers as curves: their orders' days, with prices as values; every other customer is never bare for long."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).cast("string").alias("species"), F.col("o_custkey").alias("cluster"), F.dayofyear("o_orderdate").alias("day"), "o_totalprice")
    value = (F.floor("o_totalprice") % 90) / 100.0
    return o.groupBy("species", "cluster", "day").agg(F.max(F.when(F.col("cluster") % 2 == 0, value).otherwise(0.28 + value / 2)).alias("value"))


def season_fit(spark, sf_dir):
    out = phenology.fit_seasons(_curves(spark, sf_dir))
    return out.select("species", "cluster", "n", "dof", "poor_fit", "confidence", *[F.round(c, 3).alias(c) for c in ("r2", "sos", "eos")])


def season_windows(spark, sf_dir):
    return phenology.season_windows(_sparse(spark, sf_dir))


def growing_season(spark, sf_dir):
    """The pooled season of each species, from the windows of its clusters that a fit may have moved."""
    sizes = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("species"), (F.col("o_custkey") % 4).alias("cluster")).agg(F.count("*").alias("size"))
    out = phenology.pooled_seasons(phenology.growing_seasons(_curves(spark, sf_dir).join(sizes, ["species", "cluster"])))
    return out.withColumns({c: F.round(c, 2) for c in ("start_day", "end_day")})


def picked_seasons(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("species"), (F.col("o_custkey") % 9).alias("cluster"))
    sizes = rows.groupBy("species", "cluster").agg(F.count("*").alias("size"))
    picks = sizes.select("species", "cluster", (F.lit(90) + F.col("cluster") * 7 % 40).alias("start"), (F.lit(120) + F.col("cluster") * 31 % 200).alias("end")).where("cluster % 4 <> 3")
    return phenology.picked_seasons(picks, sizes)


def period_fits(spark, sf_dir):
    curves = _curves(spark, sf_dir)
    periods = curves.groupBy("species", "cluster").agg((F.min("day") + 60).alias("start"), (F.max("day") - 40).alias("end"))
    out = phenology.fit_periods(curves, periods)
    return out.select("species", "cluster", "n", "dof", "note", "confidence", *[F.round(c, 3).alias(c) for c in ("r2", "sos", "eos", "up_gap", "down_gap")])


def growth_signal(spark, sf_dir):
    own = _curves(spark, sf_dir).withColumns({"start": F.lit(100), "end": F.lit(320)})
    return phenology.growth_signal(own, "start", "end").select("species", "cluster", "day", F.round("growth", 8).alias("growth"))


def coarse_windows(spark, sf_dir):
    return phenology.coarse_window(_curves(spark, sf_dir))


def hidden_transitions(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("field_key"), F.dayofyear("o_orderdate").alias("day")).distinct()
    targets = own.select("field_key").distinct().withColumn("target", F.lit(150))
    return phenology.bracket_gap(own, targets, ["field_key"])


def calendar_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey is not null")
    start = F.to_date("o_orderdate")
    key = F.element_at(F.array(*map(F.lit, ("maize", "winter wheat", "grass", "unknown"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    windows = o.select(F.col("o_orderkey").alias("id"), key.alias("crop_key"), start.alias("start"), F.date_add(start, (F.col("o_custkey") % 90 + 20).cast("int")).alias("end"))
    calendar = spark.createDataFrame([("maize", "04-15", "10-15"), ("winter wheat", "10-01", "07-31"), ("grass", "none", "none")], "calendar_key string, green_start string, green_end string")
    return phenology.matches_calendar(windows, calendar).select("id", "crop_key", "overlap", "fits")


def calendar_peaks(spark, sf_dir):
    """Windows with a peak against calendars that say when a crop peaks."""
    o = table(spark, sf_dir, "orders").where("o_orderkey is not null")
    start = F.to_date("o_orderdate")
    key = F.element_at(F.array(*map(F.lit, ("maize", "winter wheat", "grass", "unknown"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    peak = F.when(F.col("o_orderkey") % 5 != 0, F.date_add(start, (F.col("o_custkey") % 45).cast("int")))
    windows = o.select(F.col("o_orderkey").alias("id"), key.alias("crop_key"), start.alias("start"), F.date_add(start, (F.col("o_custkey") % 90 + 20).cast("int")).alias("end"), peak.alias("peak"))
    calendar = spark.createDataFrame([("maize", "04-15", "10-15", "07-10", "08-20"), ("winter wheat", "10-01", "07-31", "05-10", "06-15"), ("grass", "none", "none", None, None)], "calendar_key string, green_start string, green_end string, peak_start string, peak_end string")
    return phenology.matches_calendar(windows, calendar).select("id", "crop_key", "overlap", "fits")


def carried_marks(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("species"), F.col("c_custkey").alias("field_key"))
    before = c.withColumn("cluster", F.col("field_key") % 4)
    after = c.where("field_key % 13 <> 0").withColumn("cluster", F.when(F.col("field_key") % 40 < 3, 9).otherwise((F.col("field_key") + 1) % 4))
    return phenology.carried_marks(before, after).withColumn("jaccard", F.round("jaccard", 8))


def kmeans_scenarios(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("species"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return cluster.kmeans(rows, "species", 3)


def density_clusters(spark, sf_dir):
    return cluster.dbscan(points(spark, sf_dir), 24.0, 4)


def _boxes(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return points(spark, sf_dir).select("id", "crp_lbl", (x - 8).alias("minx"), (y - 8).alias("miny"), (x + 8).alias("maxx"), (y + 8).alias("maxy"))


def _pixels(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("pixel_id"), ((k * 7919) % 1000).cast("double").alias("px"), ((k * 6101) % 997).cast("double").alias("py"))


def pixel_zones(spark, sf_dir):
    return zones.classify(_pixels(spark, sf_dir), _boxes(spark, sf_dir), 5.0, 6.0, 20.0)


def zone_counts(spark, sf_dir):
    return zones.count_zones(_pixels(spark, sf_dir), _boxes(spark, sf_dir), 5.0, 6.0, 20.0)


def wkt_fields(spark, sf_dir):
    c = lambda dx, dy: F.concat((F.col("x") + dx).cast("string"), F.lit(" "), (F.col("y") + dy).cast("string"))
    ring = F.concat_ws(", ", c(0, 0), c(6, 0), c(6, 5), c(0, 5), c(0, 0))
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("SRID=4326;POLYGON (("), ring, F.lit("))"))).when(F.col("id") % 3 == 1, F.concat(F.lit("MULTIPOLYGON ((("), ring, F.lit(")))"))).otherwise(F.lit("POINT (1 2)"))
    own = points(spark, sf_dir).select("id", geometry_text.rings(text).alias("rings"))
    return own.select("id", F.coalesce(F.size("rings"), F.lit(0)).alias("n_rings"), geometry.signed_area(F.slice(F.col("rings")[0], 1, 4)).alias("area"))


def cell_features(spark, sf_dir):
    own = points(spark, sf_dir)
    text = sinks.cell_feature(F.col("id"), F.col("id") % 7, F.col("x"), F.col("y"), F.lit(10.0))
    return own.select("id", F.get_json_object(text, "$.geometry.coordinates[0][2][0]").cast("double").alias("far_x"), F.get_json_object(text, "$.properties.row").cast("long").alias("row"))


def species_graph(spark, sf_dir):
    edges = spatial.neighbour_pairs(points(spark, sf_dir), REACH).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
    return sinks.relabelled_graph(edges).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


def field_groups(spark, sf_dir):
    """Components of at least two fields, whatever their species, with their size."""
    return graph.near_groups(points(spark, sf_dir), REACH)


QUERIES = {f.__name__: f for f in (season_fit, season_windows, growing_season, picked_seasons, period_fits, growth_signal, coarse_windows, hidden_transitions, calendar_match, calendar_peaks, carried_marks, kmeans_scenarios, density_clusters, pixel_zones, zone_counts, wkt_fields, cell_features, species_graph, field_groups)}

_CURVES = f"""
c0 AS (SELECT o_orderpriority AS species, o_custkey % 4 AS cluster, CAST(floor(dayofyear(o_orderdate) / 10.0) * 10 + 5 AS BIGINT) AS day, o_totalprice FROM orders),
c AS (SELECT species, cluster, day, avg({season_sql("day", (0.85, 0.12, 150.0, 0.10, 270.0, 215.0))} + (CAST(floor(o_totalprice) AS BIGINT) % 100) / 5000.0) AS value FROM c0 GROUP BY 1, 2, 3)
"""
_ZONES = f"""
{POINTS},
px AS (SELECT p_partkey AS pixel_id, CAST((p_partkey * 7919) % 1000 AS DOUBLE) AS px, CAST((p_partkey * 6101) % 997 AS DOUBLE) AS py FROM part),
ins AS (SELECT pixel_id, px, py, id AS field_id, crp_lbl, least(px - x + 8, x + 8 - px, py - y + 8, y + 8 - py) AS edge_dist FROM px JOIN points ON abs(px - x) <= 8 AND abs(py - y) <= 8),
met AS (SELECT pixel_id, field_id, max(CASE WHEN p.crp_lbl <> i.crp_lbl THEN 1 ELSE 0 END) AS other FROM ins i JOIN points p
  ON p.id <> field_id AND greatest(0, abs(px - p.x) - 8) ** 2 + greatest(0, abs(py - p.y) - 8) ** 2 <= (edge_dist + 6) ** 2 GROUP BY 1, 2),
z AS (SELECT pixel_id, field_id, crp_lbl, edge_dist, CASE WHEN edge_dist >= 5 THEN 'interior' WHEN other = 1 THEN 'edge_other' WHEN other = 0 THEN 'edge_same' ELSE 'edge_isolated' END AS zone
  FROM ins LEFT JOIN met USING (pixel_id, field_id))
"""

ORACLE_SQL = {
    # the walk, step by step
    "season_windows": """
WITH RECURSIVE o AS (SELECT CAST(o_custkey % 5 AS VARCHAR) AS species, o_custkey AS cluster, CAST(dayofyear(o_orderdate) AS INTEGER) AS day, (CAST(floor(o_totalprice) AS BIGINT) % 90) / 100.0::DOUBLE AS v FROM orders),
c AS (SELECT species, cluster, day, max(CASE WHEN cluster % 2 = 0 THEN v ELSE 0.28 + v / 2 END) AS value FROM o GROUP BY 1, 2, 3),
l AS (SELECT species, cluster, list(day ORDER BY day) AS d, list(CAST(value AS DOUBLE) ORDER BY day) AS v FROM c GROUP BY 1, 2 HAVING count(*) >= 3),
f AS (SELECT *, len(v) AS n, list_position(v, list_max(v)) AS top, list_min(v) + 0.2 * (list_max(v) - list_min(v)) AS foot, list_min(v) + 0.6 * (list_max(v) - list_min(v)) AS low,
  len(list_filter(range(2, len(v) + 1), lambda i: v[i] < 0.3 AND v[i - 1] < 0.3)) > 0 AS bare FROM l),
w AS (
  SELECT cluster, 1 AS step, top AS place, false AS done FROM f UNION ALL SELECT cluster, -1, top, false FROM f
  UNION ALL
  SELECT w.cluster, w.step,
    CASE WHEN bare THEN CASE WHEN stop THEN place ELSE place + w.step END WHEN v[place + w.step] >= 0.3 THEN place + w.step WHEN place + 2 * w.step BETWEEN 1 AND n AND v[place + 2 * w.step] >= 0.3 THEN place + 2 * w.step ELSE place END,
    CASE WHEN bare THEN stop ELSE NOT (coalesce(v[place + w.step] >= 0.3, false) OR (place + 2 * w.step BETWEEN 1 AND n AND v[place + 2 * w.step] >= 0.3)) END
  FROM (SELECT w.*, f.* EXCLUDE (cluster), v[place + w.step] <= foot OR (v[place] < low AND v[place + w.step] > v[place] + 0.03) AS stop FROM w JOIN f USING (cluster) WHERE NOT done AND place + w.step BETWEEN 1 AND n) w
),
e AS (SELECT cluster, max(place) FILTER (step = 1) AS e, min(place) FILTER (step = -1) AS s FROM w GROUP BY 1),
x AS (SELECT f.*, CASE WHEN bare AND s > 1 AND v[s - 1] < v[s] THEN s - 1 ELSE s END AS s, CASE WHEN bare AND e < n AND v[e + 1] < v[e] THEN e + 1 ELSE e END AS e FROM f JOIN e USING (cluster))
SELECT species, cluster, d[s] AS start_day, d[top] AS peak_day, d[e] AS end_day FROM x
""",
    "picked_seasons": """
WITH z AS (SELECT o_orderpriority AS species, o_custkey % 9 AS cluster, count(*) AS size FROM orders GROUP BY 1, 2),
p AS (SELECT *, CAST(90 + cluster * 7 % 40 AS DOUBLE) AS s, CAST(120 + cluster * 31 % 200 AS DOUBLE) AS e FROM z WHERE cluster % 4 <> 3 AND 120 + cluster * 31 % 200 > 90 + cluster * 7 % 40),
v AS (SELECT species, 's' AS what, s AS v, sum(size) AS w FROM p GROUP BY 1, 2, 3 UNION ALL SELECT species, 'e', e, sum(size) FROM p GROUP BY 1, 2, 3),
r AS (SELECT *, sum(w) OVER (PARTITION BY species, what ORDER BY v) AS run, sum(w) OVER (PARTITION BY species, what) / 2.0 AS half, lead(v) OVER (PARTITION BY species, what ORDER BY v) AS nxt FROM v),
m AS (SELECT species, what, CASE WHEN run = half THEN (v + coalesce(nxt, v)) / 2 ELSE v END AS m FROM r WHERE run >= half AND run - w < half)
SELECT a.species, a.m AS start_day, b.m AS end_day, CAST((SELECT sum(size) FROM p WHERE p.species = a.species) AS BIGINT) AS fields FROM m a JOIN m b ON a.species = b.species AND a.what = 's' AND b.what = 'e'
""",
    "growth_signal": f"""
WITH {_CURVES},
s AS (SELECT species, cluster, b, max(day) FILTER (day <= b) AS d1, arg_max(value, day) FILTER (day <= b) AS v1, min(day) FILTER (day >= b) AS d2, arg_min(value, day) FILTER (day >= b) AS v2 FROM c, (VALUES (100), (320)) t(b) GROUP BY 1, 2, 3),
v AS (SELECT species, cluster, b, coalesce(v1 + (v2 - v1) * (b - d1) / nullif(d2 - d1, 0), v1, v2) AS v FROM s),
e AS (SELECT x.species, x.cluster, x.v AS v0, y.v AS v1 FROM v x JOIN v y ON x.species = y.species AND x.cluster = y.cluster AND x.b = 100 AND y.b = 320)
SELECT c.species, c.cluster, c.day, round(CASE WHEN day BETWEEN 100 AND 320 THEN greatest(0, value - (v0 + (v1 - v0) * (day - 100) / 220)) ELSE 0 END, 8) AS growth
FROM c JOIN e ON e.species = c.species AND e.cluster = c.cluster
""",
    "coarse_windows": f"""
WITH {_CURVES}, p AS (SELECT species, cluster, first(day ORDER BY value DESC, day) AS peak_day, min(value) + 0.2 * (max(value) - min(value)) AS foot FROM c GROUP BY 1, 2)
SELECT c.species, c.cluster, peak_day, coalesce(max(day) FILTER (value <= foot AND day < peak_day), min(day)) AS start_day, coalesce(min(day) FILTER (value <= foot AND day > peak_day), max(day)) AS end_day
FROM c JOIN p ON p.species = c.species AND p.cluster = c.cluster GROUP BY 1, 2, 3
""",
    "hidden_transitions": """
WITH d AS (SELECT DISTINCT o_custkey AS field_key, CAST(dayofyear(o_orderdate) AS INTEGER) AS day FROM orders)
SELECT field_key, 150 AS target, min(day) FILTER (day >= 150) - max(day) FILTER (day <= 150) AS gap,
  coalesce(min(day) FILTER (day >= 150) - max(day) FILTER (day <= 150) >= 15, true) AS hidden FROM d GROUP BY 1
""",
    "calendar_match": """
WITH w AS (SELECT o_orderkey AS id, ['maize', 'winter wheat', 'grass', 'unknown'][o_custkey % 4 + 1] AS crop_key, CAST(o_orderdate AS DATE) AS s, CAST(CAST(o_orderdate AS DATE) + CAST(o_custkey % 90 + 20 AS INTEGER) AS DATE) AS e FROM orders),
y AS (SELECT *, year(s) + k AS y FROM w, (VALUES (-1), (0), (1)) t(k)),
g AS (SELECT *, CASE crop_key WHEN 'maize' THEN make_date(y, 4, 15) WHEN 'winter wheat' THEN make_date(y, 10, 1) END AS a, CASE crop_key WHEN 'maize' THEN make_date(y, 10, 15) WHEN 'winter wheat' THEN make_date(y + 1, 7, 31) END AS b FROM y),
o AS (SELECT id, crop_key, s, e, max(CASE WHEN a IS NOT NULL THEN greatest(0, date_diff('day', greatest(s, a), least(e, b)) + 1) END) AS overlap FROM g GROUP BY 1, 2, 3, 4)
SELECT id, crop_key, CAST(overlap AS INTEGER) AS overlap, coalesce(overlap >= 0.5 * least(CASE crop_key WHEN 'maize' THEN 184 WHEN 'winter wheat' THEN 304 END, date_diff('day', s, e) + 1), true) AS fits FROM o
""",
    "calendar_peaks": """
WITH w AS (SELECT o_orderkey AS id, ['maize', 'winter wheat', 'grass', 'unknown'][o_custkey % 4 + 1] AS crop_key, CAST(o_orderdate AS DATE) AS s, CAST(CAST(o_orderdate AS DATE) + CAST(o_custkey % 90 + 20 AS INTEGER) AS DATE) AS e,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + CAST(o_custkey % 45 AS INTEGER) AS DATE) END AS p FROM orders),
y AS (SELECT *, year(s) + k AS y FROM w, (VALUES (-1), (0), (1)) t(k)),
g AS (SELECT *, CASE crop_key WHEN 'maize' THEN make_date(y, 4, 15) WHEN 'winter wheat' THEN make_date(y, 10, 1) END AS a, CASE crop_key WHEN 'maize' THEN make_date(y, 10, 15) WHEN 'winter wheat' THEN make_date(y + 1, 7, 31) END AS b,
  CASE crop_key WHEN 'maize' THEN make_date(y, 7, 10) WHEN 'winter wheat' THEN make_date(y, 5, 10) END AS pa, CASE crop_key WHEN 'maize' THEN make_date(y, 8, 20) WHEN 'winter wheat' THEN make_date(y, 6, 15) END AS pb FROM y),
o AS (SELECT id, crop_key, s, e, max(CASE WHEN a IS NOT NULL THEN greatest(0, date_diff('day', greatest(s, a), least(e, b)) + 1) END) AS overlap, bool_or(date_diff('day', pa, p) >= -21 AND date_diff('day', pb, p) <= 21) AS peaked FROM g GROUP BY 1, 2, 3, 4)
SELECT id, crop_key, CAST(overlap AS INTEGER) AS overlap, coalesce(overlap >= 0.5 * least(CASE crop_key WHEN 'maize' THEN 184 WHEN 'winter wheat' THEN 304 END, date_diff('day', s, e) + 1), true) AND coalesce(peaked, true) AS fits FROM o
""",
    "carried_marks": """
WITH b AS (SELECT c_mktsegment AS species, c_custkey AS f, c_custkey % 4 AS old FROM customer),
a AS (SELECT c_mktsegment AS species, c_custkey AS f, CASE WHEN c_custkey % 40 < 3 THEN 9 ELSE (c_custkey + 1) % 4 END AS new FROM customer WHERE c_custkey % 13 <> 0),
n AS (SELECT b.species, old, new, count(*) AS n FROM b JOIN a USING (species, f) GROUP BY 1, 2, 3),
j AS (SELECT n.*, n / CAST((SELECT count(*) FROM b WHERE b.species = n.species AND b.old = n.old) + (SELECT count(*) FROM a WHERE a.species = n.species AND a.new = n.new) - n AS DOUBLE) AS jaccard FROM n)
SELECT species, old, new, round(jaccard, 8) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY species, old ORDER BY jaccard DESC, new) AS k FROM j) WHERE k = 1 AND jaccard >= 0.5
""",
    "density_clusters": f"""
WITH RECURSIVE {POINTS},
near AS (SELECT a.id AS a, b.id AS b FROM points a JOIN points b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 576),
core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 4),
e AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
t AS (SELECT a AS id, a AS seen FROM e UNION SELECT t.id, e.b FROM t JOIN e ON e.a = t.seen),
l AS (SELECT id, min(seen) AS cluster FROM t GROUP BY 1),
bo AS (SELECT a AS id, arg_min(cluster, b) AS cluster FROM near JOIN l ON l.id = near.b GROUP BY 1)
SELECT p.id, coalesce(l.cluster, bo.cluster, -1) AS cluster FROM points p LEFT JOIN l USING (id) LEFT JOIN bo ON bo.id = p.id
""",
    "pixel_zones": f"WITH {_ZONES} SELECT * FROM z",
    "zone_counts": f"""
WITH {_ZONES} SELECT field_id, count(*) FILTER (zone = 'interior') AS interior, count(*) FILTER (zone = 'edge_other') AS edge_other, count(*) FILTER (zone = 'edge_same') AS edge_same, count(*) FILTER (zone = 'edge_isolated') AS edge_isolated FROM z GROUP BY 1
""",
    "wkt_fields": f"WITH {POINTS} SELECT id, CASE WHEN id % 3 < 2 THEN 1 ELSE 0 END AS n_rings, CASE WHEN id % 3 < 2 THEN CAST(30.0 AS DOUBLE) END AS area FROM points",
    "cell_features": f"WITH {POINTS} SELECT id, x + 10 AS far_x, id % 7 AS row FROM points",
    "species_graph": f"""
WITH {PAIRS}, n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT a_id AS id FROM pairs UNION SELECT b_id FROM pairs))
SELECT x.k AS a, y.k AS b FROM pairs JOIN n x ON x.id = a_id JOIN n y ON y.id = b_id
""",
    "field_groups": f"""
WITH RECURSIVE {POINTS},
e AS (SELECT a.id AS a, b.id AS b FROM points a JOIN points b ON a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 144),
t AS (SELECT DISTINCT a AS id, a AS seen FROM e UNION SELECT t.id, e.b FROM t JOIN e ON e.a = t.seen)
SELECT component, count(*) AS n FROM (SELECT id, min(seen) AS component FROM t GROUP BY 1) GROUP BY 1
""",
}
