"""Queries of the relational, spatial and graph slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralyn.operators import graph, relational, spatial
from terralyn.plans.derive import PAIRS, POINTS, REACH, points
from terralyn.sources.scratch import cut
from terralyn.sources.tables import table


def species_list(spark, sf_dir):
    return relational.species_list(table(spark, sf_dir, "part").select(F.col("p_brand").alias("crp_lbl")))


def field_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("NewID"), F.col("o_orderkey").alias("pos"))
    out = relational.first_per_id(rows, "NewID", "pos")
    return out.select("NewID", "pos", relational.field_key(F.col("NewID"), F.col("pos")).alias("field_key"))


def numbered_fields(spark, sf_dir):
    return relational.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.col("pid").cast("long").alias("pid"))


def merge_new(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("NewID"), F.col("o_orderkey").alias("pos"))
    return relational.merge_new(orders.where("pos % 3 = 0"), orders.where("pos % 3 <> 0"), "NewID")


def not_in_series(spark, sf_dir):
    dates = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderpriority")
    return relational.not_in_series(dates.select("date").distinct(), dates.where("o_orderpriority = '1-URGENT'"))


def species_of_attributes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    attributes = F.map_from_entries(F.filter(F.array(
        F.when(F.col("p_partkey") % 3 == 0, F.struct(F.lit("crop").alias("key"), F.col("p_brand").alias("value"))),
        F.when(F.col("p_partkey") % 2 == 0, F.struct(F.lit("veg_kind").alias("key"), F.col("p_type").alias("value"))),
        F.struct(F.lit("name").alias("key"), F.col("p_name").alias("value")),
    ), lambda x: x.isNotNull()))
    return part.select("p_partkey", relational.extract_species(attributes).alias("species"))


def polygon_labels(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    label = relational.polygon_label(F.when(k % 2 == 0, F.col("p_brand")), k, F.when(k % 3 == 0, F.col("p_name")), F.lit(1), (k % 4).cast("int"), k)
    return part.select("p_partkey", label.alias("label"))


def evenly_spaced(spark, sf_dir):
    return relational.evenly_spaced(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 25)


def evenly_indexed(spark, sf_dir):
    return relational.evenly_indexed(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 600)


def hash_keep(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(relational.hash_keep(F.col("o_orderkey"), 0.1)).select("o_orderkey")


def ranked_clusters(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("species"), (F.col("l_partkey") % 11).alias("cluster")).agg(F.count("*").alias("size"))
    return relational.ranked_clusters(sizes)


def clean_values(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    odd = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    return relational.clean_values(li.select("l_orderkey", "l_linenumber", odd.alias("q"), F.to_date("l_shipdate").alias("d")))


def sql_script(spark, sf_dir):
    script = "CREATE OR REPLACE TEMP VIEW big_orders AS SELECT o_custkey, o_totalprice FROM orders_in WHERE o_totalprice > 1000; SELECT o_custkey, count(*) AS n, 'a;b' AS tag FROM big_orders GROUP BY o_custkey"
    return relational.run_script(spark, script, {"orders_in": table(spark, sf_dir, "orders")})


def neighbour_pairs(spark, sf_dir):
    out = spatial.neighbour_pairs(points(spark, sf_dir), REACH, digits=8)
    return out.select("a_id", "b_id", "a_crp_lbl", "b_crp_lbl", "distance")


def nearest_pairs(spark, sf_dir):
    out = spatial.neighbour_pairs(points(spark, sf_dir), REACH, 100)
    return out.select("a_id", "b_id", F.round("distance", 8).alias("distance"))


def neighbour_fields(spark, sf_dir):
    fields = points(spark, sf_dir)
    return spatial.neighbour_fields(fields, fields.where("crp_lbl = 'BUILDING'"), REACH).select("id", "crp_lbl")


def pairs_long(spark, sf_dir):
    return spatial.pairs_long(spatial.neighbour_pairs(points(spark, sf_dir), REACH, digits=8))


def overlapping_boxes(spark, sf_dir):
    fields = points(spark, sf_dir)
    box = lambda half: fields.select("id", (F.col("x") - half).alias("minx"), (F.col("y") - half).alias("miny"), (F.col("x") + half).alias("maxx"), (F.col("y") + half).alias("maxy"), "crp_lbl")
    return spatial.overlapping_boxes(box(4.0).where("crp_lbl = 'BUILDING'"), box(6.0).where("crp_lbl = 'MACHINERY'"), 16.0)


def points_in_fields(spark, sf_dir):
    fields = points(spark, sf_dir)
    squares = fields.select("id", (F.col("x") - 4).alias("minx"), (F.col("y") - 4).alias("miny"), (F.col("x") + 4).alias("maxx"), (F.col("y") + 4).alias("maxy"))
    k = F.col("s_suppkey")
    pixels = table(spark, sf_dir, "supplier").select(k.alias("pixel_id"), ((k * 7919) % 1000).cast("double").alias("px"), ((k * 6101) % 997).cast("double").alias("py"))
    return spatial.points_in_squares(pixels, squares, 8.0).select("pixel_id", "id", "edge_dist")


def _kinds(spark, sf_dir):
    """One field for each place and species, and the links of these: what they span, all fields span."""
    own = cut(spatial.kinds(points(spark, sf_dir)))
    return own, spatial.neighbour_pairs(own, REACH).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))


def adjacency_components(spark, sf_dir):
    return graph.neighbour_components(points(spark, sf_dir), REACH)


def spanning_components(spark, sf_dir):
    fields = points(spark, sf_dir)
    return graph.labelled_spanning(fields, graph.neighbour_components(fields, REACH), ["BUILDING", "MACHINERY", "FURNITURE"])


def set_spans(spark, sf_dir):
    return graph.spans(*_kinds(spark, sf_dir), ["BUILDING", "MACHINERY", "FURNITURE"])


def valid_additions(spark, sf_dir):
    return graph.valid_additions(*_kinds(spark, sf_dir), ["BUILDING", "MACHINERY"])


QUERIES = {f.__name__: f for f in (species_list, field_dedup, numbered_fields, merge_new, not_in_series, species_of_attributes, polygon_labels, evenly_spaced, evenly_indexed, hash_keep, ranked_clusters, clean_values, sql_script, neighbour_pairs, nearest_pairs, neighbour_fields, pairs_long, overlapping_boxes, points_in_fields, adjacency_components, spanning_components, set_spans, valid_additions)}

_REACHED = f"""
RECURSIVE {PAIRS},
e AS (SELECT a_id AS src, b_id AS dst FROM pairs UNION ALL SELECT b_id, a_id FROM pairs),
t AS (SELECT DISTINCT src AS id, src AS seen FROM e UNION SELECT t.id, e.dst FROM t JOIN e ON e.src = t.seen),
comp AS (SELECT id, min(seen) AS component FROM t GROUP BY 1)
"""


def _spanning_within(species: str, name: str) -> str:
    return f"""
{name}e AS (SELECT a_id AS src, b_id AS dst FROM pairs WHERE a_crp_lbl IN ({species}) AND b_crp_lbl IN ({species})
  UNION ALL SELECT b_id, a_id FROM pairs WHERE a_crp_lbl IN ({species}) AND b_crp_lbl IN ({species})),
{name}t AS (SELECT DISTINCT src AS id, src AS seen FROM {name}e UNION SELECT t.id, e.dst FROM {name}t t JOIN {name}e e ON e.src = t.seen),
{name}c AS (SELECT t.id, min(seen) AS component FROM {name}t t GROUP BY 1),
{name}n AS (SELECT coalesce(max(n), 0) AS n FROM (SELECT component, count(DISTINCT crp_lbl) AS n FROM {name}c JOIN points USING (id) GROUP BY 1))
"""


ORACLE_SQL = {
    "species_list": "SELECT DISTINCT p_brand AS crp_lbl FROM part WHERE p_brand IS NOT NULL",
    "field_dedup": """
WITH r AS (SELECT CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS NewID, o_orderkey AS pos FROM orders)
SELECT NewID, pos, coalesce(CAST(NewID AS VARCHAR), 'pid:' || pos) AS field_key FROM (
  SELECT *, row_number() OVER (PARTITION BY NewID, CASE WHEN NewID IS NULL THEN pos END ORDER BY pos) AS nth FROM r)
WHERE nth = 1
""",
    "numbered_fields": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pid FROM orders",
    "merge_new": """
WITH o AS (SELECT o_custkey AS NewID, o_orderkey AS pos FROM orders)
SELECT * FROM o WHERE pos % 3 = 0 UNION ALL
SELECT * FROM o WHERE pos % 3 <> 0 AND NewID NOT IN (SELECT NewID FROM o WHERE pos % 3 = 0)
""",
    "not_in_series": """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders
WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT')
""",
    "species_of_attributes": """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 2 = 0 THEN p_type END AS species FROM part
""",
    "polygon_labels": """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' · ' || p_partkey || CASE WHEN p_partkey % 4 > 1 THEN ' (1/' || (p_partkey % 4) || ')' ELSE '' END
  WHEN p_partkey % 3 = 0 THEN p_name ELSE 'Polygon ' || p_partkey END AS label FROM part
""",
    "evenly_spaced": """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM r WHERE k IN (SELECT CAST(floor(i * (SELECT count(*) - 1 FROM orders) / 24.0 + 0.5) AS BIGINT) FROM range(25) g(i))
""",
    "evenly_indexed": """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders)
SELECT o_orderkey FROM r WHERE k IN (SELECT CAST(i * (SELECT count(*) FROM orders) // 600 AS BIGINT) FROM range(600) g(i))
""",
    "hash_keep": "SELECT o_orderkey FROM orders WHERE ((o_orderkey + 1) * 2654435761) % 4294967296 < 0.1 * 4294967296.0",
    "ranked_clusters": """
WITH s AS (SELECT l_returnflag AS species, l_partkey % 11 AS cluster, count(*) AS size FROM lineitem GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY species ORDER BY size DESC, cluster) - 1 AS INTEGER) AS rank FROM s
""",
    "clean_values": """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 2 THEN l_quantity END AS q, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d FROM lineitem
""",
    "sql_script": "SELECT o_custkey, count(*) AS n, 'a;b' AS tag FROM orders WHERE o_totalprice > 1000 GROUP BY 1",
    "neighbour_pairs": f"WITH {PAIRS} SELECT a_id, b_id, a_crp_lbl, b_crp_lbl, round(distance, 8) AS distance FROM pairs",
    "nearest_pairs": f"WITH {PAIRS} SELECT a_id, b_id, round(distance, 8) AS distance FROM (SELECT * FROM pairs ORDER BY distance, a_id, b_id LIMIT 100)",
    "neighbour_fields": f"""
WITH {POINTS}
SELECT DISTINCT b.id, b.crp_lbl FROM points a JOIN points b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 144 WHERE a.crp_lbl = 'BUILDING'
""",
    "pairs_long": f"""
WITH {PAIRS}
SELECT a_id || '-' || b_id AS pair_id, 'species_1' AS role_in_pair, a_id AS id, a_crp_lbl AS crp_lbl, b_id AS neighbor_id, b_crp_lbl AS neighbor_crp_lbl, round(distance, 8) AS distance FROM pairs
UNION ALL SELECT a_id || '-' || b_id, 'species_2', b_id, b_crp_lbl, a_id, a_crp_lbl, round(distance, 8) FROM pairs
""",
    "overlapping_boxes": f"""
WITH {POINTS}
SELECT a.id AS a_id, b.id AS b_id,
       (least(a.x + 4, b.x + 6) - greatest(a.x - 4, b.x - 6)) * (least(a.y + 4, b.y + 6) - greatest(a.y - 4, b.y - 6)) AS area
FROM points a JOIN points b ON abs(a.x - b.x) < 10 AND abs(a.y - b.y) < 10 WHERE a.crp_lbl = 'BUILDING' AND b.crp_lbl = 'MACHINERY'
""",
    "points_in_fields": f"""
WITH {POINTS},
px AS (SELECT s_suppkey AS pixel_id, CAST((s_suppkey * 7919) % 1000 AS DOUBLE) AS px, CAST((s_suppkey * 6101) % 997 AS DOUBLE) AS py FROM supplier)
SELECT pixel_id, id, least(px - (x - 4), x + 4 - px, py - (y - 4), y + 4 - py) AS edge_dist FROM px JOIN points ON abs(px - x) <= 4 AND abs(py - y) <= 4
""",
    "adjacency_components": f"WITH {_REACHED} SELECT id, component FROM comp",
    "spanning_components": f"""
WITH {_REACHED}
SELECT id, crp_lbl, component FROM comp JOIN points USING (id) WHERE component IN (
  SELECT component FROM comp JOIN points USING (id) WHERE crp_lbl IN ('BUILDING', 'MACHINERY', 'FURNITURE') GROUP BY 1 HAVING count(DISTINCT crp_lbl) = 3)
""",
    "set_spans": f"WITH RECURSIVE {PAIRS}, {_spanning_within(repr('BUILDING') + ',' + repr('MACHINERY') + ',' + repr('FURNITURE'), 'z')}, k AS (SELECT count(DISTINCT s) AS k FROM (SELECT a_crp_lbl AS s FROM pairs UNION ALL SELECT b_crp_lbl FROM pairs) WHERE s IN ('BUILDING', 'MACHINERY', 'FURNITURE')) SELECT k < 3 OR n >= 3 AS spans FROM zn, k",
    "valid_additions": "WITH RECURSIVE " + PAIRS + ", " + ", ".join(_spanning_within(f"'BUILDING','MACHINERY','{s}'", s[:2].lower()) for s in ("FURNITURE", "HOUSEHOLD", "AUTOMOBILE")) + " " + " UNION ALL ".join(f"SELECT '{s}' AS crp_lbl FROM {s[:2].lower()}n WHERE n = 3" for s in ("FURNITURE", "HOUSEHOLD", "AUTOMOBILE")),
}
