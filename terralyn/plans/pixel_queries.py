"""Queries of scopes, samples, columns and mixes of pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralyn.functions import numeric
from terralyn.operators import matrix, relational, series
from terralyn.plans.derive import CURVES, OBS, POINTS, observations, points
from terralyn.sources.tables import table


def scoped_pixels(spark, sf_dir):
    obs = observations(spark, sf_dir)
    members = obs.select("field_key").distinct().where("field_key % 3 <> 1")
    out = relational.scoped(obs, members, None, ["interior", "edge_other"], "2024-01-05", "2024-01-20")
    return out.groupBy("field_key", "zone").agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"))


def bordering_fields(spark, sf_dir):
    inside, rest = relational.bordering(points(spark, sf_dir), ["BUILDING", "MACHINERY"])
    return inside.withColumn("shown", F.lit(True)).unionByName(rest.withColumn("shown", F.lit(False))).select("id", "crp_lbl", "shown")


def pixel_scenarios(spark, sf_dir):
    obs = observations(spark, sf_dir)
    sizes = obs.groupBy((F.col("field_key") % 7).alias("cluster")).agg(F.count("*").alias("size")).withColumn("species", F.lit("all"))
    ranks = relational.ranked_clusters(sizes).select("cluster", "rank")
    fields = obs.select("field_key").distinct().withColumn("cluster", F.col("field_key") % 7).join(ranks, "cluster").select("field_key", F.col("rank").alias("cluster"))
    return relational.with_scenarios(obs, fields, 4).groupBy("cluster").agg(F.count("*").alias("n"))


def sampled_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return relational.sampled_with(rows, "o_orderkey", 300, F.col("o_orderkey") % 4999 == 7)


def name_columns(spark, sf_dir):
    shapes = relational.column_shapes(table(spark, sf_dir, "part"), ["p_brand", "p_name", "p_partkey", "p_size", "p_type"])
    return relational.name_column(shapes).withColumn("kind", F.lit("name")).unionByName(relational.variety_column(shapes, ["variety", "brand"]).withColumn("kind", F.lit("variety")))


def column_shapes(spark, sf_dir):
    return relational.column_shapes(table(spark, sf_dir, "part"), ["p_brand", "p_name", "p_partkey", "p_size", "p_type"])


def pixel_keys(spark, sf_dir):
    own = points(spark, sf_dir)
    key = numeric.pixel_key(F.col("x") * 0.361 - 180, F.col("y") * 0.173 - 80)
    return own.select("id", key.alias("key"), numeric.pixel_number(F.col("x").cast("long") - 500, F.col("y").cast("long") - 400).alias("number"))


def blur_budgets(spark, sf_dir):
    own = table(spark, sf_dir, "part").select("p_partkey", numeric.blur_budget(F.col("p_size").cast("double"), F.col("p_retailprice") / 1000, F.lit(10.0)).alias("b"))
    return own.select("p_partkey", *[F.round(F.col(f"b.{c}"), 8).alias(c) for c in ("geo", "box", "effective", "fwhm")])


def asset_keys(spark, sf_dir):
    k = F.col("p_partkey")
    assets = F.map_from_arrays(F.array(F.concat(F.lit("B0"), (k % 4).cast("string")), F.lit("SCL")), F.array(F.lit("a"), F.lit("b")))
    return table(spark, sf_dir, "part").select("p_partkey", numeric.asset_key(assets, F.concat(F.lit("B0"), (k % 3).cast("string"))).alias("key"))


def _mixed(spark, sf_dir):
    k = F.col("vec_id")
    zone = F.when(k % 5 == 0, "edge_other").when(k % 5 == 1, "edge_same").otherwise("interior")
    rows = table(spark, sf_dir, "embeddings").select(k.alias("id"), (k % 90).alias("field_key"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("crp_lbl"), zone.alias("zone"), F.col("embedding").cast("array<double>").alias("v"))
    return matrix.unmix_edges(rows)


def unmixed_edges(spark, sf_dir):
    return _mixed(spark, sf_dir).withColumns({c: F.round(c, 8) for c in ("fraction_a", "residual")})


def unmix_summary(spark, sf_dir):
    return matrix.unmix_summary(_mixed(spark, sf_dir)).withColumn("mean_fraction_a", F.round("mean_fraction_a", 8))


def pca_of_curves(spark, sf_dir):
    """Fields on a common axis without gaps: how many, how many are left out, and the shares of three components."""
    curves = series.field_curves(observations(spark, sf_dir))
    filled = series.gap_fill(curves, curves.select("date").distinct())
    rows = filled.groupBy(F.col("field_key").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "value"))), lambda s: s["value"]).alias("v"))
    _, cov = matrix.covariance(rows)
    counts = curves.agg(F.countDistinct("field_key").alias("n_all")).crossJoin(rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("n_dates")))
    return counts.select("n", (F.col("n_all") - F.col("n")).alias("dropped"), "n_dates", F.lit(round(float(cov.trace()), 4)).alias("variance"))


QUERIES = {f.__name__: f for f in (scoped_pixels, bordering_fields, pixel_scenarios, sampled_lines, name_columns, column_shapes, pixel_keys, blur_budgets, asset_keys, unmixed_edges, unmix_summary, pca_of_curves)}

_MIXED = """
x AS (SELECT vec_id AS id, vec_id % 90 AS fk, 's' || vec_id % 3 AS sp, CASE WHEN vec_id % 5 = 0 THEN 'edge_other' WHEN vec_id % 5 = 1 THEN 'edge_same' ELSE 'interior' END AS zone,
  unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings),
fm AS (SELECT fk, i, avg(v) AS m FROM x WHERE zone = 'interior' GROUP BY 1, 2 HAVING count(*) >= 4),
sm AS (SELECT sp, i, avg(v) AS m FROM x WHERE zone = 'interior' GROUP BY 1, 2),
a AS (SELECT sp FROM (SELECT sp, count(*) AS n, min(id) AS f FROM x WHERE zone = 'interior' AND i = 0 GROUP BY 1) ORDER BY n DESC, f LIMIT 1),
o AS (SELECT x.id, x.sp, x.i, x.v, coalesce(fm.m, sm.m) AS own FROM x LEFT JOIN fm ON fm.fk = x.fk AND fm.i = x.i LEFT JOIN sm ON sm.sp = x.sp AND sm.i = x.i WHERE zone = 'edge_other'),
f AS (SELECT id, o.sp, p.sp AS partner, greatest(0, least(1, sum((v - p.m) * (own - p.m)) / sum((own - p.m) * (own - p.m)))) AS f, sum((own - p.m) * (own - p.m)) AS apart FROM o JOIN sm p ON p.i = o.i AND p.sp <> o.sp GROUP BY 1, 2, 3),
e AS (SELECT f.id, f.sp, f.partner, f.f, sqrt(sum(pow(v - f.f * own - (1 - f.f) * p.m, 2)) / any_value(apart)) AS r FROM f JOIN o ON o.id = f.id JOIN sm p ON p.sp = f.partner AND p.i = o.i GROUP BY 1, 2, 3, 4),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, partner) AS n FROM e) WHERE n = 1),
mixed AS (SELECT id, b.sp AS own, partner, CASE WHEN b.sp = a.sp THEN f WHEN partner = a.sp THEN 1 - f END AS fraction_a, r AS residual FROM b, a)
"""
_SHAPES = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {k} AS place, count(*) AS rows, count(DISTINCT CAST({c} AS VARCHAR)) AS n_distinct, count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') AS n_empty FROM part" for k, c in enumerate(("p_brand", "p_name", "p_partkey", "p_size", "p_type")))

ORACLE_SQL = {
    "scoped_pixels": f"WITH {OBS} SELECT field_key, zone, count(*) AS n, round(avg(value), 8) AS mean FROM obs WHERE field_key % 3 <> 1 AND zone IN ('interior', 'edge_other') AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1, 2",
    "bordering_fields": f"WITH {POINTS} SELECT id, crp_lbl, crp_lbl IN ('BUILDING', 'MACHINERY') AS shown FROM points",
    "pixel_scenarios": f"""
WITH {OBS}, s AS (SELECT field_key % 7 AS c, count(*) AS n FROM obs GROUP BY 1), r AS (SELECT c, CAST(row_number() OVER (ORDER BY n DESC, c) - 1 AS INTEGER) AS k FROM s)
SELECT CASE WHEN k < 4 THEN k END AS cluster, count(*) AS n FROM obs JOIN r ON c = field_key % 7 GROUP BY 1
""",
    "sampled_lines": """
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS c FROM orders)
SELECT o_orderkey FROM n WHERE c <= 300 OR k IN (SELECT i * (SELECT max(c) FROM n) // 300 FROM range(300) r(i)) UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 4999 = 7
""",
    "column_shapes": _SHAPES,
    "name_columns": f"""
WITH s AS ({_SHAPES}),
w AS (SELECT *, list_filter(string_split_regex(lower("column"), '[^a-z0-9]+'), lambda x: x <> '') AS parts FROM s),
r AS (SELECT *, coalesce(list_position({relational.NAME_WORDS}, array_to_string(parts, '')), 99) AS whole,
  coalesce(list_min(list_transform(parts, lambda x: list_position({relational.NAME_WORDS}, x))), 99) AS part,
  list_min(list_transform(parts, lambda x: list_position(['variety', 'brand'], x))) AS variety,
  CASE WHEN n_distinct < 2 THEN 2 WHEN n_distinct = rows THEN 1 ELSE 0 END AS shape FROM w)
SELECT (SELECT "column" FROM r WHERE n_distinct = rows AND n_empty = 0 ORDER BY whole, part, place LIMIT 1) AS "column", 'name' AS kind
UNION ALL SELECT (SELECT "column" FROM r WHERE n_distinct <= 252 AND n_empty < rows AND (variety IS NOT NULL OR shape < 2)
  ORDER BY variety IS NULL, shape, CASE WHEN variety IS NULL THEN -n_distinct ELSE variety END, place LIMIT 1), 'variety'
""",
    "pixel_keys": f"""
WITH {POINTS} SELECT id, translate('p_' || printf('%.6f', x * 0.361 - 180) || '_' || printf('%.6f', y * 0.173 - 80), '.-', '_m') AS key,
  ((CAST(x AS BIGINT) - 500) * 65536 + ((CAST(y AS BIGINT) - 400) % 65536 + 65536) % 65536 + 4294967296) % 4294967296 AS number FROM points
""",
    "blur_budgets": """
WITH b AS (SELECT p_partkey, p_size / 2.146 AS geo, p_retailprice / 1000 AS o FROM part)
SELECT p_partkey, round(geo, 8) AS geo, round(10 / sqrt(12), 8) AS box, round(sqrt(o * o + geo * geo), 8) AS effective, round(2.3548 * sqrt(o * o + geo * geo), 8) AS fwhm FROM b
""",
    "asset_keys": "SELECT p_partkey, CASE WHEN p_partkey % 4 = p_partkey % 3 THEN 'B0' || p_partkey % 3 ELSE 'B04' END AS key FROM part",
    "unmixed_edges": f"WITH {_MIXED} SELECT id, own, partner, round(fraction_a, 8) AS fraction_a, round(residual, 8) AS residual FROM mixed",
    "unmix_summary": f"WITH {_MIXED} SELECT count(fraction_a) AS n, count(*) FILTER (fraction_a IS NULL) AS skipped, round(avg(fraction_a), 8) AS mean_fraction_a FROM mixed",
    "pca_of_curves": f"""
WITH {CURVES},
axis AS (SELECT DISTINCT date FROM curves),
good AS (SELECT field_key FROM curves GROUP BY 1 HAVING count(value) >= 3 AND date_diff('day', min(date), max(date)) >= 0.5 * (SELECT date_diff('day', min(date), max(date)) FROM axis)),
g AS (SELECT good.field_key, axis.date, c.value FROM good CROSS JOIN axis LEFT JOIN curves c ON c.field_key = good.field_key AND c.date = axis.date),
b AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER p AS d1, last_value(value IGNORE NULLS) OVER p AS v1,
  first_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER f AS d2, first_value(value IGNORE NULLS) OVER f AS v2
  FROM g WINDOW p AS (PARTITION BY field_key ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY field_key ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT field_key, date, coalesce(v1 + (v2 - v1) * date_diff('day', d1, date) / nullif(date_diff('day', d1, d2), 0), v1, v2) AS v FROM b)
SELECT count(DISTINCT field_key) AS n, (SELECT count(DISTINCT field_key) FROM curves) - count(DISTINCT field_key) AS dropped, CAST(count(DISTINCT date) AS INTEGER) AS n_dates,
  (SELECT round(sum(s), 4) FROM (SELECT var_samp(v) AS s FROM v GROUP BY date)) AS variance FROM v
""",
}
