"""Queries of imported layers, label texts, signatures, grids for features, late dates and fitted chart rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralyn.functions import labels
from terralyn.operators import components, layers, phenology, replay
from terralyn.plans.derive import OBS, POINTS, observations, points
from terralyn.plans.season_queries import _curves
from terralyn.sources import polygons
from terralyn.sources.scratch import shared_folder
from terralyn.sources.tables import table

DEGREES = 1e-3


def _features(spark, sf_dir):
    """Customers as features of all kinds: without geometry, points, missing corners, degenerate outlines and holes."""
    k, s = F.col("id") % 9, (2 + F.col("id") % 5) * DEGREES
    corner = lambda dx, dy: F.struct((F.col("x") * DEGREES + dx).alias("x"), (F.col("y") * DEGREES + dy).alias("y"))
    square = F.array(corner(0, 0), corner(s, 0), corner(s, s), corner(0, s), corner(0, 0))
    flat = F.array(corner(0, 0), corner(s, 0), corner(0, 0), corner(s, 0))
    broken = F.array(corner(0, 0), F.struct(F.lit(None).cast("double").alias("x"), F.lit(0.0).alias("y")), corner(s, s))
    hole = F.array(corner(s / 4, s / 4), corner(s / 2, s / 4), corner(s / 2, s / 2))
    nothing = F.array().cast("array<array<array<struct<x:double,y:double>>>>")
    shapes = F.when(k <= 1, F.lit(None).cast("array<array<array<struct<x:double,y:double>>>>")).when(k == 2, F.array(F.array(broken))).when(k == 3, F.array(F.array(flat, hole))).when(k == 4, F.array(F.array(square, flat), F.array(flat, hole))).when(k == 5, nothing).otherwise(F.array(F.array(square, hole)))
    kind = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "Point").when(k == 4, "MultiPolygon").otherwise("Polygon")
    return points(spark, sf_dir).select("id", kind.alias("kind"), shapes.alias("polygons"))


def layer_statuses(spark, sf_dir):
    return layers.statuses(_features(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"), F.sum("dropped").alias("dropped"), F.sum(F.coalesce(F.size("rings"), F.lit(0))).alias("rings"))


def layer_facts(spark, sf_dir):
    return layers.layer_facts(layers.statuses(_features(spark, sf_dir))).withColumn("median", F.round("median", 9))


def plan_signatures(spark, sf_dir):
    """One signature for each nation's customers, of their names and balances in the order of their keys."""
    own = table(spark, sf_dir, "customer")
    tokens = F.array(labels.text_token(F.col("c_mktsegment")), labels.number_token(F.col("c_custkey") / 4))
    return layers.plan_signatures(own, "c_nationkey", "c_custkey", tokens).withColumnRenamed("c_nationkey", "nation")


def _boxes(spark, sf_dir):
    return points(spark, sf_dir).select("id", F.col("x").alias("minx"), F.col("y").alias("miny"), (F.col("x") + F.col("id") % 40).alias("maxx"), (F.col("y") + F.col("id") % 30).alias("maxy"))


def feature_grids(spark, sf_dir):
    """Suppliers as analysis grids of five layers, each with a preview."""
    k = F.col("s_suppkey")
    x, y = (k * 7919) % 1000, (k * 6101) % 1000
    grids = table(spark, sf_dir, "supplier").where("s_suppkey > 0").select((k % 5).alias("layer"), k.alias("grid"), (k <= 5).alias("preview"), x.alias("minx"), y.alias("miny"), (x + 60).alias("maxx"), (y + 45).alias("maxy"))
    return layers.grids_for(_boxes(spark, sf_dir), grids, 64.0)


def number_texts(spark, sf_dir):
    """Ids far beyond a double's digits, padded prices and long fractions."""
    k = F.col("p_partkey")
    big = F.concat(F.lit("00900719925474"), F.lpad(k.cast("string"), 7, "0"), F.when(k % 2 == 0, ".000").otherwise(""))
    price = F.concat(F.when(k % 3 == 0, "-").otherwise(" +"), F.lpad((k % 977).cast("string"), 6, "0"), F.lit("."), F.rpad((k % 89).cast("string"), 6, "0"), F.lit(" "))
    odd = F.when(k % 4 == 0, "***").when(k % 4 == 1, "  ").when(k % 4 == 2, "-0.000").otherwise("n/a")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.explode(F.array(big, price, odd)).alias("raw"))
    return rows.select("id", "raw", labels.tidy_number(F.col("raw")).alias("text"))


def variety_labels(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.lit("sy-"), F.lower("p_brand"), F.lit("_"), k.cast("string"))
    value = F.when(k % 5 == 0, F.concat(F.lit("http://Species_name/"), F.translate("p_brand", "#", "_"), F.lit("/BREEDER"))).when(k % 5 == 1, F.concat(F.lit("https://seeds.example.com/list/"), k.cast("string"), F.lit("-"), F.regexp_replace(name, "#", "-"), F.lit(".html?x=1"))).when(k % 5 == 2, F.concat(F.lit("  "), F.col("p_name"), F.lit("__x "))).when(k % 5 == 3, "").otherwise(F.concat(F.lit("https://user@seeds.example.com:80/Caf%C3%A9_"), k.cast("string"), F.lit("/")))
    return table(spark, sf_dir, "part").select(k.alias("id"), labels.variety_label(value).alias("label"), labels.word_rank(F.concat(F.lit("Variété "), F.col("p_type")), ["brass", "variete", "tin"]).alias("rank"))


def late_dates(spark, sf_dir):
    """Field means of a series to which dates came late, some again with other values, and from which some were withdrawn."""
    own = observations(spark, sf_dir).select("pixel_id", "field_key", F.concat(F.lit("s"), F.col("field_key") % 3).alias("species"), "zone", "date", "value")
    day = F.dayofmonth("date")
    series = replay.Replay(spark, shared_folder(spark, "series"), "scenes", "date", {"means": replay.Stage(("scenes",), replay.means)})
    series.replay(own.where(day % 5 != 0))
    series.replay(own.where(day % 5 == 0).withColumn("value", F.col("value") * 2))
    series.replay(own.where(day % 10 == 0), own.where(day == 7).select("date"))
    return series.tables()["means"].select("field_key", "species", "date", F.round("mean", 8).alias("mean"), "n")


def fitted_rows(spark, sf_dir):
    """What a chart draws of every curve: observed means and accepted fits over them."""
    curves = _curves(spark, sf_dir)
    periods = curves.groupBy("species", "cluster").agg((F.min("day") + 60).alias("start"), (F.max("day") - 40).alias("end"))
    axis = spark.range(1, 366, 5).select(F.col("id").alias("day")).union(curves.select("day")).distinct()
    out = phenology.fitted_rows(axis, curves, periods, phenology.fit_periods(curves, periods))
    return out.select("species", "cluster", "day", F.round("observed", 6).alias("observed"), F.round("fitted", 2).alias("fitted"))


def loaded_polygons(spark, sf_dir):
    """Fields in long form, one row a pair, with WKT, GeoJSON or nothing as geometry, as distinct numbered polygons."""
    x, y, k = F.col("x").cast("string"), F.col("y").cast("string"), F.col("id")
    far = (F.col("x") + 5).cast("string")
    wkt = F.concat(F.when(k % 2 == 0, "SRID=4326;").otherwise(" "), F.lit("POLYGON (("), x, F.lit(" "), y, F.lit(", "), far, F.lit(" "), y, F.lit(", "), far, F.lit(" 999, "), x, F.lit(" "), y, F.lit("))"))
    json = F.concat(F.lit('{"type":"Polygon","coordinates":[[['), x, F.lit(","), y, F.lit("],["), far, F.lit(","), y, F.lit("],["), far, F.lit(",999],["), x, F.lit(","), y, F.lit("]]]}"))
    shape = F.when(k % 7 == 6, F.concat(F.lit("POINT ("), x, F.lit(" "), y, F.lit(")"))).when(k % 7 == 5, json).otherwise(wkt)
    rows = points(spark, sf_dir).where("id is not null").select(F.explode(F.sequence(F.lit(0), k % 3)).alias("pair"), F.when(k % 4 != 0, F.floor(k / 2)).alias("NewID"), "crp_lbl", F.col("id").alias("field"), shape.alias("geometry_wkt"))
    found = polygons.load_polygons(rows.orderBy("field", "pair"))
    return found.fields.select("pid", "NewID", "crp_lbl", "field", F.size(F.col("rings")[0]).alias("corners"), F.col("rings")[0][1]["x"].alias("x"), F.lit(found.skipped).cast("long").alias("skipped"))


def pixel_components(spark, sf_dir):
    """What a fit on interior pixels says of itself, users as pixels."""
    own = observations(spark, sf_dir)
    pixels = own.groupBy(F.col("field_key").alias("pixel_id"), "date").agg(F.avg("value").alias("value")).withColumn("zone", F.when(F.col("pixel_id") % 3 == 0, "edge_other").otherwise("interior"))
    out = components.pixel_components(pixels, ["interior"], ["interior", "edge_other"])
    facts = out.scores.agg(F.count("*").alias("placed"), F.countDistinct("zone").alias("zones"))
    return facts.select("placed", "zones", *[F.lit(v).alias(n) for n, v in (("fitted", out.fitted), ("dropped", out.dropped), ("dates", out.dates), ("filled", round(out.filled, 6)))])


QUERIES = {f.__name__: f for f in (layer_statuses, layer_facts, plan_signatures, feature_grids, number_texts, variety_labels, late_dates, fitted_rows, loaded_polygons, pixel_components)}

_LAYER = f"""
{POINTS},
f AS (SELECT id, x * 0.001 AS x, y * 0.001 AS y, (2 + id % 5) * 0.001 AS s, CASE id % 9 WHEN 0 THEN 'none' WHEN 1 THEN 'other' WHEN 2 THEN 'invalid' WHEN 3 THEN 'empty' WHEN 5 THEN 'empty' ELSE 'ok' END AS status,
  CASE id % 9 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 1 ELSE 0 END AS dropped, CASE WHEN id % 9 = 4 THEN 1 WHEN id % 9 > 5 THEN 2 ELSE 0 END AS rings FROM points)
"""

ORACLE_SQL = {
    "layer_statuses": f"WITH {_LAYER} SELECT status, count(*) AS n, CAST(sum(dropped) AS BIGINT) AS dropped, CAST(sum(rings) AS BIGINT) AS rings FROM f GROUP BY 1",
    "layer_facts": f"""
WITH {_LAYER}, m AS (SELECT d FROM (SELECT sqrt(2 * s * s) AS d, row_number() OVER (ORDER BY s) AS n, count(*) OVER () AS c FROM f WHERE status = 'ok') WHERE n = floor(c * 0.5) + 1)
SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'none') AS none, count(*) FILTER (status = 'other') AS other, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'empty') AS empty,
  CAST(sum(dropped) AS BIGINT) AS dropped, round(any_value(m.d), 9) AS median, 'degrees' AS unit FROM f, m
""",
    "plan_signatures": """
WITH r AS (SELECT c_nationkey AS nation, c_custkey AS k, md5('2|s' || length(c_mktsegment) || ':' || c_mktsegment || '|n' || (c_custkey / 4.0::DOUBLE)) AS d FROM customer),
c AS (SELECT nation, CAST(k // 4096 AS BIGINT) AS k, md5(count(*) || '|' || string_agg(k || ':' || d, '|' ORDER BY k)) AS d FROM r GROUP BY nation, r.k // 4096)
SELECT nation, md5(count(*) || '|' || string_agg(k || ':' || d, '|' ORDER BY k)) AS signature FROM c GROUP BY 1
""",
    "feature_grids": f"""
WITH {POINTS}, a AS (SELECT id, x AS minx, y AS miny, x + id % 40 AS maxx, y + id % 30 AS maxy FROM points),
g AS (SELECT s_suppkey % 5 AS layer, s_suppkey AS grid, (s_suppkey * 7919) % 1000 AS minx, (s_suppkey * 6101) % 1000 AS miny FROM supplier WHERE s_suppkey > 0),
h AS (SELECT a.id, layer, grid FROM a JOIN g ON grid > 5 AND a.minx <= g.minx + 60 AND g.minx <= a.maxx AND a.miny <= g.miny + 45 AND g.miny <= a.maxy)
SELECT id, layer, grid FROM h
UNION ALL SELECT id, layer, grid FROM a, g WHERE grid <= 5 AND NOT EXISTS (SELECT 1 FROM h WHERE h.id = a.id AND h.layer = g.layer)
""",
    "number_texts": """
WITH r AS (SELECT p_partkey AS k FROM part), t AS (
  SELECT k AS id, '00900719925474' || lpad(k::VARCHAR, 7, '0') || CASE WHEN k % 2 = 0 THEN '.000' ELSE '' END AS raw, '900719925474' || lpad(k::VARCHAR, 7, '0') AS text FROM r
  UNION ALL SELECT k, CASE WHEN k % 3 = 0 THEN '-' ELSE ' +' END || lpad((k % 977)::VARCHAR, 6, '0') || '.' || rpad((k % 89)::VARCHAR, 6, '0') || ' ',
    CASE WHEN k % 3 = 0 AND (k % 977 > 0 OR k % 89 > 0) THEN '-' ELSE '' END || (k % 977) || CASE WHEN k % 89 = 0 THEN '' ELSE '.' || rtrim((k % 89)::VARCHAR, '0') END FROM r
  UNION ALL SELECT k, CASE k % 4 WHEN 0 THEN '***' WHEN 1 THEN '  ' WHEN 2 THEN '-0.000' ELSE 'n/a' END, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '0' ELSE 'n/a' END FROM r)
SELECT * FROM t
""",
    "variety_labels": """
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN replace(replace(p_brand, '#', ' '), '_', ' ') WHEN 1 THEN 'SY Brand ' || split_part(p_brand, '#', 2) || ' ' || p_partkey
  WHEN 2 THEN trim(regexp_replace(replace(p_name, '_', ' '), '\\s+', ' ', 'g')) || ' x' WHEN 3 THEN '(no variety)' ELSE 'Café ' || p_partkey END AS label,
  CASE WHEN list_contains(string_split(lower(p_type), ' '), 'brass') THEN 0 ELSE 1 END AS rank FROM part
""",
    "loaded_polygons": f"""
WITH {POINTS}, r AS (SELECT CASE WHEN id % 4 <> 0 THEN id // 2 END AS "NewID", crp_lbl, id AS field, x, unnest(range(0, id % 3 + 1)) AS pair, id % 7 = 6 AS bare FROM points),
n AS (SELECT *, row_number() OVER (PARTITION BY "NewID" ORDER BY field, pair) AS k FROM r WHERE NOT bare)
SELECT row_number() OVER (ORDER BY field, pair) - 1 AS pid, "NewID", crp_lbl, field, CAST(4 AS INTEGER) AS corners, CAST(x + 5 AS DOUBLE) AS x, (SELECT count(*) FROM r WHERE bare) AS skipped FROM n WHERE "NewID" IS NULL OR k = 1
""",
    "pixel_components": f"""
WITH {OBS}, c AS (SELECT field_key, date, avg(value) AS value FROM obs WHERE value IS NOT NULL GROUP BY 1, 2),
axis AS (SELECT date FROM c GROUP BY 1 HAVING count(*) >= greatest(5, 0.02 * (SELECT count(DISTINCT field_key) FROM c))),
s AS (SELECT c.* FROM c JOIN axis USING (date)),
good AS (SELECT field_key, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 3 AND date_diff('day', min(date), max(date)) >= 0.5 * (SELECT date_diff('day', min(date), max(date)) FROM axis))
SELECT count(*) AS placed, count(DISTINCT field_key % 3 = 0) AS zones, CAST(count(*) FILTER (field_key % 3 <> 0) AS INTEGER) AS fitted, CAST((SELECT count(DISTINCT field_key) FROM c) - count(*) AS INTEGER) AS dropped,
  CAST((SELECT count(*) FROM axis) AS INTEGER) AS dates, round(1 - sum(n) / (count(*) * (SELECT count(*) FROM axis))::DOUBLE, 6) AS filled FROM good
""",
    "late_dates": f"""
WITH {OBS}, o AS (SELECT field_key, 's' || field_key % 3 AS species, date, zone, CASE WHEN day(date) % 5 = 0 AND day(date) % 10 <> 0 THEN value * 2 ELSE value END AS value FROM obs WHERE day(date) <> 7)
SELECT field_key, species, date, round(avg(value), 8) AS mean, count(*) AS n FROM o WHERE zone = 'interior' AND value IS NOT NULL GROUP BY 1, 2, 3
""",
}
