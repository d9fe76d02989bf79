"""Queries of the statistics, matrix, function and catalogue slices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from terralyn.functions import curves, geometry, numeric, spectral
from terralyn.operators import boundary, catalogue, matrix, stats
from terralyn.plans.derive import OBS, POINTS, observations, points, season_sql
from terralyn.sources.tables import table


def _r(df, *names):
    return df.withColumns({n: F.round(n, 8) for n in names})


def spectral_index(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    nir, red, blue, green = (spectral.band(c) for c in (F.col("l_extendedprice"), F.col("l_quantity") * 100, F.col("l_tax") * 1000, F.col("l_discount") * 10000))
    kinds = {k: spectral.index_value(k, red, nir, green, blue).alias(k) for k in ("ndvi", "evi", "gndvi", "savi")}
    return _r(li.select("l_orderkey", "l_linenumber", *kinds.values()), *kinds)


def _marks(spark, sf_dir):
    """Orders as season marks: days since 1995 by priority, weighted by the customer's remainder."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("species"), F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("day"), (F.col("o_custkey") % 4).alias("weight"), (F.col("o_orderkey") % 3).alias("cluster"))


def weighted_median(spark, sf_dir):
    return stats.weighted_median(_marks(spark, sf_dir), ["species"], "day", "weight")


def shared_window(spark, sf_dir):
    marks = _marks(spark, sf_dir)
    start = stats.weighted_median(marks.where("cluster = 0"), ["species"], "day", "weight").withColumn("start", F.col("median") - 200)
    end = stats.weighted_median(marks.where("cluster = 1"), ["species"], "day", "weight").withColumn("end", F.col("median") + 200)
    return stats.shared_window(start.join(end, "species").select("species", "start", "end"), "start", "end")


def percentile98(spark, sf_dir):
    return stats.floor_percentile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.98)


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "n_chars", "toxic")


def rank_auc(spark, sf_dir):
    return _r(stats.rank_auc(_scored(spark, sf_dir), "n_chars", "toxic", "doc_id"), "auc", "mean_positive", "mean_negative")


def edge_precision(spark, sf_dir):
    return _r(stats.flag_precision(_scored(spark, sf_dir), "n_chars", "toxic", 2000), "precision")


def contrast_stretch(spark, sf_dir):
    limits = table(spark, sf_dir, "lineitem").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    out = table(spark, sf_dir, "lineitem").crossJoin(limits)
    return out.groupBy(stats.stretched(F.col("l_extendedprice"), F.col("lo"), F.col("hi")).alias("level")).agg(F.count("*").alias("n"))


def fraction_histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("f")), "f")


def category_counts(spark, sf_dir):
    return stats.categories(table(spark, sf_dir, "part"), "p_type")


def column_facts(spark, sf_dir):
    return stats.column_facts(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size", "p_name"])


def varieties(spark, sf_dir):
    return stats.first_seen(table(spark, sf_dir, "part"), "p_brand", "p_partkey")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("class"), F.col("embedding").cast("array<double>").alias("v"))


def endmembers(spark, sf_dir):
    means = matrix.mean_vectors(_vectors(spark, sf_dir), ["class"])
    return means.select("class", "n", F.posexplode("mean").alias("i", "m")).select("class", "n", "i", F.round("m", 8).alias("m"))


def unmix_fraction(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return _r(matrix.unmix(rows, matrix.mean_vectors(rows, ["class"])), "fraction", "residual")


def nearest_centroid(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return _r(matrix.nearest_means(rows, matrix.mean_vectors(rows, ["class"])), "distance", "second_distance")


def covariance_trace(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    _, cov = matrix.covariance(rows)
    return spark.createDataFrame([(round(float(np.trace(cov)), 6), round(float(cov[0, 1]), 8))], "trace double, c01 double")


def explained_cumulative(spark, sf_dir):
    """All components of the vectors: their share, and what only their own axes give: scores that share no variance.

    variance is that of all scores, which equals the vectors' in an orthonormal basis; mixed is the greatest correlation
    of a score with the one after it, 0 on principal axes alone; ordered tells that variances fall.
    """
    rows = _vectors(spark, sf_dir)
    scores, shares = matrix.pca(rows, rows, 64)
    own = scores.agg(*[F.var_samp(F.col("scores")[i]).alias(f"v{i}") for i in range(64)], *[F.abs(F.covar_samp(F.col("scores")[i], F.col("scores")[i + 1])).alias(f"c{i}") for i in range(63)])
    total = sum((F.col(f"v{i}") for i in range(1, 64)), F.col("v0"))
    mixed = F.greatest(*[F.col(f"c{i}") / F.sqrt(F.col(f"v{i}") * F.col(f"v{i + 1}")) for i in range(63)])
    falls = F.forall(F.array(*[F.col(f"v{i}") - F.col(f"v{i + 1}") for i in range(63)]), lambda d: d > -1e-9)
    facts = own.select(F.round(total, 6).alias("variance"), F.round(mixed, 5).alias("mixed"), falls.alias("ordered"))
    return shares.agg(F.round(F.max("cumulative"), 8).alias("cumulative"), F.count("*").alias("n")).crossJoin(facts)


def pca_project(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return matrix.pca(rows.where("class < 5"), rows, 3)[0].select("id", *[F.col("scores")[i].alias(f"pc{i + 1}") for i in range(3)])


def pca_whitened(spark, sf_dir):
    """Variances of whitened scores over the rows that fitted them, 1 each, and their covariances, 0 each."""
    rows = _vectors(spark, sf_dir)
    scores = matrix.pca(rows, rows, 3, whiten=True)[0]
    pairs = [F.round(F.abs(F.covar_samp(F.col("scores")[i], F.col("scores")[j])), 6).alias(f"cov{i + 1}{j + 1}") for i, j in ((0, 1), (0, 2), (1, 2))]
    return scores.agg(*[F.round(F.var_samp(F.col("scores")[i]), 6).alias(f"var{i + 1}") for i in range(3)], *pairs)


def ica_axes(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    mean, axes = matrix.independent_axes(rows, 3, rounds=20)
    return matrix.project(rows, mean, axes).select("id", *[F.col("scores")[i].alias(f"ic{i + 1}") for i in range(3)])


def mnf_axes(spark, sf_dir):
    """Noise from each vector's nearest neighbour in a plane of places."""
    rows = _vectors(spark, sf_dir)
    placed = rows.withColumns({"x": (F.col("id") * 7919 % 1000).cast("double"), "y": (F.col("id") * 6101 % 997).cast("double")})
    mean, axes = matrix.noise_fraction_axes(rows, boundary.noise_differences(placed, 60.0), 3)
    return matrix.project(rows, mean, axes).select("id", *[F.col("scores")[i].alias(f"mnf{i + 1}") for i in range(3)])


def _rings(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return points(spark, sf_dir).withColumn("ring", F.array(corner(-4, -4), corner(4, -4), corner(4, 4), corner(-4, 4)))


def ring_facts(spark, sf_dir):
    own = _rings(spark, sf_dir)
    inside = geometry.contains(F.col("x") + F.col("id") % 7, F.col("y"), F.col("ring"))
    edge = geometry.boundary_distance(F.col("x") + F.col("id") % 7, F.col("y"), F.col("ring"))
    box = geometry.envelope(F.col("ring"))
    return own.select("id", geometry.signed_area(F.col("ring")).alias("area"), box["minx"].alias("minx"), box["maxy"].alias("maxy"), inside.alias("inside"), F.round(edge, 8).alias("edge"), F.size(geometry.clean_ring(F.col("ring"))).alias("n_points"))


def utm_zones(spark, sf_dir):
    own = points(spark, sf_dir).select("id", (F.col("x") * 0.36 - 180).alias("lng"), (F.col("y") * 0.16 - 80).alias("lat"))
    return own.select("id", geometry.utm_zone(F.col("lng")).alias("zone"), geometry.utm_epsg(F.col("lng"), F.col("lat")).alias("epsg"))


def utm_points(spark, sf_dir):
    own = points(spark, sf_dir).select("id", (F.col("x") * 0.36 - 180).alias("lng"), (F.col("y") * 0.16 - 80).alias("lat"))
    utm = geometry.to_utm(F.col("lng"), F.col("lat"), geometry.utm_zone(F.col("lng")))
    return own.select("id", F.round(utm["easting"], 3).alias("easting"), F.round(utm["northing"], 3).alias("northing"))


def smallest_plots(spark, sf_dir):
    side = numeric.smallest_plot_side((F.col("p_size") % 10 + 1).cast("double"), F.col("p_size") / 10.0, 0.9)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(side, 4).alias("side"))


def season_curves(spark, sf_dir):
    t = F.dayofyear("date").cast("double") * 12
    own = observations(spark, sf_dir).select("field_key", "date").distinct()
    names = sorted(curves.PRESETS)
    every = F.array(*[F.struct(F.lit(n).alias("preset"), curves.double_logistic(t, *curves.PRESETS[n]).alias("curve"), F.lit(curves.PRESETS[n][0]).alias("high")) for n in names])
    own = own.select("field_key", "date", F.get(every, F.pmod("field_key", F.lit(len(names))).cast("int")).alias("s"))
    curve, high = F.col("s.curve"), F.col("s.high")
    return _r(own.select("field_key", "date", "s.preset", curve.alias("curve"), curves.growth(t, curve, high, F.lit(100.0), F.lit(300.0)).alias("growth"), curves.beta_schedule(t, 366, 3.0, 4.0, 0.02).alias("variance"), curves.day_index(F.col("date"), F.lit(2023)).alias("day")), "curve", "growth", "variance")


def crop_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", curves.crop_key(F.concat(F.lit("D"), F.get(F.array(*map(F.lit, "'\u2019\u2018\u0092\u00b4")), (F.col("p_partkey") % 5).cast("int")), F.lit("Hiver Été çà et là, Öland "), F.col("p_type"), F.lit(" (No. "), F.col("p_size").cast("string"), F.lit(")"))).alias("crop_key"))


def _scenes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), F.pmod(F.floor("o_totalprice"), F.lit(100)).cast("double").alias("cloud"), (32600 + F.col("o_custkey") % 3).alias("epsg"), ((F.col("o_orderkey") * 37) % 1000).cast("double").alias("ulx"), ((F.col("o_orderkey") * 53) % 1000).cast("double").alias("uly"))


def scenes_by_date(spark, sf_dir):
    return catalogue.by_date(_scenes(spark, sf_dir))


def scene_search(spark, sf_dir):
    found = catalogue.search(_scenes(spark, sf_dir), "1996-01-01", "1998-12-31", 40)
    return catalogue.chunk_of(found, "1996-01-01", "1998-12-31", 6).groupBy("chunk").agg(F.count("*").alias("n"), F.min("cloud").alias("least_cloud"))


def covered_scenes(spark, sf_dir):
    dates = catalogue.by_date(_scenes(spark, sf_dir)).withColumn("coverage", F.col("n_tiles") * 17 % 100 / 100.0)
    return catalogue.well_covered(dates, "coverage").select("date", "coverage")


def elected_zones(spark, sf_dir):
    return catalogue.elected_zone(_scenes(spark, sf_dir).select("date", "epsg", F.col("cloud").alias("area")))


def scene_clarity(spark, sf_dir):
    pixels = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 12).alias("scl"))
    return _r(catalogue.clarity(pixels, ["l_suppkey"]), "clear", "obscured", "unusable")


def tile_mosaic(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    tiles = li.select(F.col("l_suppkey").alias("scene"), (F.col("l_partkey") % 40).alias("row"), (F.col("l_orderkey") % 40).alias("col"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tile"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).otherwise(0.0).alias("dn"))
    return catalogue.mosaic(tiles)


def product_lattices(spark, sf_dir):
    return catalogue.lattices(_scenes(spark, sf_dir), 60.0)


def sampled_coverage(spark, sf_dir):
    own = points(spark, sf_dir)
    boxes = own.select("id", (F.col("x") - 20).alias("minx"), (F.col("y") - 20).alias("miny"), (F.col("x") + 20).alias("maxx"), (F.col("y") + 20).alias("maxy"))
    k = F.col("s_suppkey")
    tiles = table(spark, sf_dir, "supplier").select(((k * 7919) % 1000).cast("double").alias("minx"), ((k * 6101) % 997).cast("double").alias("miny"))
    tiles = tiles.withColumns({"maxx": F.col("minx") + 90, "maxy": F.col("miny") + 90})
    return _r(catalogue.sampled_coverage(boxes, tiles, 4), "coverage")


QUERIES = {f.__name__: f for f in (spectral_index, weighted_median, shared_window, percentile98, rank_auc, edge_precision, contrast_stretch, fraction_histogram, category_counts, column_facts, varieties, endmembers, unmix_fraction, nearest_centroid, covariance_trace, explained_cumulative, pca_project, pca_whitened, ica_axes, mnf_axes, ring_facts, utm_zones, utm_points, smallest_plots, season_curves, crop_keys, scenes_by_date, scene_search, covered_scenes, elected_zones, scene_clarity, tile_mosaic, product_lattices, sampled_coverage)}

_MARKS = "marks AS (SELECT o_orderpriority AS species, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day, o_custkey % 4 AS weight, o_orderkey % 3 AS cluster FROM orders)"


def _median(where: str, name: str) -> str:
    return f"""
{name}_s AS (SELECT species, day, sum(weight) AS w FROM marks WHERE weight > 0 {where} GROUP BY 1, 2),
{name}_r AS (SELECT *, sum(w) OVER (PARTITION BY species ORDER BY day) AS run, sum(w) OVER (PARTITION BY species) / 2.0 AS half,
  lead(day) OVER (PARTITION BY species ORDER BY day) AS nxt FROM {name}_s),
{name} AS (SELECT species, CASE WHEN run = half THEN (day + coalesce(nxt, day)) / 2.0 ELSE CAST(day AS DOUBLE) END AS median
  FROM {name}_r WHERE run >= half AND run - w < half)"""


_VECTORS = """
x AS (SELECT vec_id AS id, label AS class, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings),
m AS (SELECT class, i, avg(v) AS m FROM x GROUP BY 1, 2)
"""
_SCENES = "s AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) AS cloud, 32600 + o_custkey % 3 AS epsg, CAST((o_orderkey * 37) % 1000 AS DOUBLE) AS ulx, CAST((o_orderkey * 53) % 1000 AS DOUBLE) AS uly FROM orders)"

#: The presets in order of their names.
_SEASONS = {"default": (0.78, 0.117, 104.0, 0.078, 221.0, 198.0), "grass": (0.65, 0.15, 80.0, 0.03, 330.0, 205.0), "maize": (0.85, 0.12, 150.0, 0.10, 270.0, 215.0), "soybean": (0.78, 0.11, 165.0, 0.11, 280.0, 225.0), "sugar beet": (0.85, 0.07, 120.0, 0.06, 300.0, 215.0), "winter wheat": (0.72, 0.09, 60.0, 0.12, 175.0, 135.0)}
_pick = lambda of: "CASE field_key % 6 " + " ".join(f"WHEN {k} THEN {of(n)}" for k, n in enumerate(_SEASONS)) + " END"
_PRESETS = f"{_pick(lambda n: repr(n))} AS preset, {_pick(lambda n: season_sql('t', _SEASONS[n]))} AS c, {_pick(lambda n: _SEASONS[n][0])} AS high"

ORACLE_SQL = {
    "spectral_index": """
WITH b AS (SELECT l_orderkey, l_linenumber, nullif(l_extendedprice, 0) AS nir, nullif(l_quantity * 100, 0) AS red, nullif(l_tax * 1000, 0) AS blue, nullif(l_discount * 10000, 0) AS green FROM lineitem)
SELECT l_orderkey, l_linenumber, round((nir - red) / coalesce(nullif(nir + red, 0), CASE WHEN nir + red = 0 THEN 1 END), 8) AS ndvi,
  round(coalesce(2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 10000), (nir - red) / (nir + red)), 8) AS evi,
  round(coalesce((nir - green) / (nir + green), (nir - red) / (nir + red)), 8) AS gndvi,
  round(1.5 * (nir - red) / (nir + red + 0.5), 8) AS savi FROM b
""",
    "weighted_median": f"WITH {_MARKS}, {_median('', 'a')} SELECT species, median FROM a",
    "shared_window": f"""
WITH {_MARKS}, {_median('AND cluster = 0', 'a')}, {_median('AND cluster = 1', 'b')}
SELECT * FROM (SELECT max(a.median - 200) AS window_start, min(b.median + 200) AS window_end FROM a JOIN b USING (species)) WHERE window_start <= window_end
""",
    "percentile98": """
WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS n, count(*) OVER (PARTITION BY l_returnflag) AS c FROM lineitem)
SELECT l_returnflag, v AS percentile FROM r WHERE n = floor(c * 0.98) + 1
""",
    "rank_auc": """
WITH r AS (SELECT n_chars, toxic, row_number() OVER (ORDER BY n_chars, doc_id) AS k FROM labels JOIN documents USING (doc_id)),
s AS (SELECT CAST(sum(CASE WHEN toxic = 1 THEN k ELSE 0 END) AS DOUBLE) AS rs, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n,
  avg(n_chars) FILTER (toxic = 1) AS mp, avg(n_chars) FILTER (toxic <> 1) AS mn FROM r)
SELECT round((rs - p * (p + 1) / 2) / (p * (n - p)), 8) AS auc, round(mp, 8) AS mean_positive, round(mn, 8) AS mean_negative FROM s
""",
    "edge_precision": "SELECT count(*) AS n_flagged, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0 END), 8) AS precision FROM labels JOIN documents USING (doc_id) WHERE n_chars >= 2000",
    "contrast_stretch": """
WITH l AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT CAST(floor((l_extendedprice - lo) / (hi - lo) * 255 + 0.5) AS INTEGER) AS level, count(*) AS n FROM lineitem, l GROUP BY 1
""",
    "fraction_histogram": "SELECT CAST(least(9, floor(l_quantity / 50 * 10)) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1",
    "category_counts": "SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1",
    "column_facts": " UNION ALL ".join(f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n_distinct, count(*) FILTER (coalesce(trim(CAST({c} AS VARCHAR)), '') = '') AS n_empty FROM part" for c in ("p_brand", "p_type", "p_size", "p_name")).replace("AS column", 'AS "column"'),
    "varieties": "SELECT p_brand, min(p_partkey) AS first_position, count(*) AS n FROM part GROUP BY 1",
    "endmembers": f"WITH {_VECTORS} SELECT class, count(*) AS n, CAST(i AS INTEGER) AS i, round(avg(v), 8) AS m FROM x GROUP BY class, i",
    "unmix_fraction": f"""
WITH {_VECTORS},
d AS (SELECT a.class, b.class AS partner, sum((a.m - b.m) * (a.m - b.m)) AS apart FROM m a JOIN m b ON a.i = b.i AND a.class <> b.class GROUP BY 1, 2),
f AS (SELECT x.id, x.class, b.class AS partner, apart, greatest(0, least(1, sum((x.v - b.m) * (a.m - b.m)) / apart)) AS f
  FROM x JOIN m a ON a.class = x.class AND a.i = x.i JOIN m b ON b.class <> x.class AND b.i = x.i JOIN d ON d.class = x.class AND d.partner = b.class GROUP BY 1, 2, 3, 4),
e AS (SELECT f.id, f.class, f.partner, f.f, sqrt(sum((x.v - f.f * a.m - (1 - f.f) * b.m) ** 2) / any_value(apart)) AS r
  FROM f JOIN x ON x.id = f.id JOIN m a ON a.class = f.class AND a.i = x.i JOIN m b ON b.class = f.partner AND b.i = x.i GROUP BY 1, 2, 3, 4)
SELECT id, class, partner, round(f, 8) AS fraction, round(r, 8) AS residual FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, partner) AS n FROM e) WHERE n = 1
""",
    "nearest_centroid": f"""
WITH {_VECTORS}, d AS (SELECT x.id, m.class AS c, sqrt(sum((x.v - m.m) ** 2)) AS d FROM x JOIN m USING (i) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, c) AS n FROM d)
SELECT a.id, a.c AS nearest, round(a.d, 8) AS distance, b.c AS second, round(b.d, 8) AS second_distance FROM r a JOIN r b ON a.id = b.id AND a.n = 1 AND b.n = 2
""",
    "covariance_trace": """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings)
SELECT round((SELECT sum(s) FROM (SELECT var_samp(v) AS s FROM x GROUP BY i)), 6) AS trace,
       round((SELECT covar_samp(embedding[1]::DOUBLE, embedding[2]::DOUBLE) FROM embeddings), 8) AS c01
""",
    "explained_cumulative": """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings)
SELECT CAST(1.0 AS DOUBLE) AS cumulative, CAST(64 AS BIGINT) AS n, round(sum(s), 6) AS variance, CAST(0.0 AS DOUBLE) AS mixed, true AS ordered FROM (SELECT i, var_samp(v) AS s FROM x GROUP BY 1)
""",
    "pca_whitened": "SELECT CAST(1.0 AS DOUBLE) AS var1, CAST(1.0 AS DOUBLE) AS var2, CAST(1.0 AS DOUBLE) AS var3, CAST(0.0 AS DOUBLE) AS cov12, CAST(0.0 AS DOUBLE) AS cov13, CAST(0.0 AS DOUBLE) AS cov23",
    "ring_facts": f"""
WITH {POINTS}
SELECT id, CAST(64.0 AS DOUBLE) AS area, x - 4 AS minx, y + 4 AS maxy, id % 7 < 4 AS inside, CAST(abs(4 - id % 7) AS DOUBLE) AS edge, 5 AS n_points FROM points
""",
    "utm_zones": f"""
WITH {POINTS}, p AS (SELECT id, x * 0.36 - 180 AS lng, y * 0.16 - 80 AS lat FROM points)
SELECT id, CAST(floor((lng + 180) / 6) + 1 AS INTEGER) AS zone, CAST(CASE WHEN lat < 0 THEN 32700 ELSE 32600 END + floor((lng + 180) / 6) + 1 AS INTEGER) AS epsg FROM p
""",
    # 1.6322 is the point of the normal distribution below which lies the root of 0.9
    "smallest_plots": "SELECT p_partkey, round(p_size % 10 + 1 + 2 * CAST(1.6322187896168654 AS DOUBLE) * (p_size / 10), 4) AS side FROM part",
    "season_curves": f"""
WITH {OBS}, p AS (SELECT DISTINCT field_key, date, dayofyear(date) * 12.0 AS t FROM obs),
c AS (SELECT *, {_PRESETS} FROM p)
SELECT field_key, date, preset, round(c, 8) AS curve, round(CASE WHEN t < 100 OR t > 300 OR c < 0.01 * high THEN 0 ELSE c END, 8) AS growth,
       round(0.02 * pow(t / 366, 2) * pow(1 - t / 366, 3) / (pow(0.4, 2) * pow(0.6, 3)), 8) AS variance,
       CAST(date_diff('day', DATE '2023-01-01', date) + 1 AS INTEGER) AS day FROM c
""",
    "crop_keys": "SELECT p_partkey, trim(regexp_replace(lower('dhiver ete ca et la land ' || p_type || ' (No. ' || p_size || ')'), '[^a-z0-9]+', ' ', 'g')) AS crop_key FROM part",
    "scenes_by_date": f"WITH {_SCENES} SELECT date, first(id ORDER BY cloud, id) AS best_id, max(cloud) AS cloud, count(*) AS n_tiles FROM s GROUP BY 1",
    "scene_search": f"""
WITH {_SCENES} SELECT CAST(greatest(0, least(5, floor(date_diff('day', DATE '1996-01-01', date) * 6.0 / date_diff('day', DATE '1996-01-01', DATE '1998-12-31')))) AS INTEGER) AS chunk,
  count(*) AS n, min(cloud) AS least_cloud FROM s WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND cloud <= 40 GROUP BY 1
""",
    "covered_scenes": f"""
WITH {_SCENES}, d AS (SELECT date, (count(*) * 17 % 100) / 100.0 AS coverage FROM s GROUP BY 1)
SELECT date, CAST(coverage AS DOUBLE) AS coverage FROM d WHERE coverage >= CASE WHEN (SELECT max(coverage) FROM d) >= 0.98 THEN 0.98 ELSE 0.3 END
""",
    "elected_zones": f"""
WITH {_SCENES}, z AS (SELECT date, epsg, sum(cloud) AS area FROM s GROUP BY 1, 2)
SELECT date, epsg, area FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY area DESC, epsg) AS n FROM z) WHERE n = 1
""",
    "scene_clarity": """
WITH p AS (SELECT l_suppkey, l_partkey % 12 AS scl FROM lineitem),
c AS (SELECT l_suppkey, CAST(nullif(count(*) FILTER (scl <> 0), 0) AS DOUBLE) AS n, count(*) FILTER (scl IN (4, 5, 6)) AS a, count(*) FILTER (scl IN (3, 8, 9, 10)) AS b FROM p GROUP BY 1)
SELECT l_suppkey, round(a / n, 8) AS clear, round(b / n, 8) AS obscured, round((n - a - b) / n, 8) AS unusable FROM c
""",
    "tile_mosaic": """
SELECT l_suppkey AS scene, l_partkey % 40 AS row, l_orderkey % 40 AS col, max({'t': l_orderkey * 8 + l_linenumber, 'q': l_quantity}).q AS dn
FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_quantity <> 0 GROUP BY 1, 2, 3
""",
    "product_lattices": f"WITH {_SCENES} SELECT DISTINCT epsg, ulx % 60 AS phase_x, uly % 60 AS phase_y FROM s",
    "sampled_coverage": f"""
WITH {POINTS},
g AS (SELECT id, x - 20 + 40 * (k % 4 + 0.5) / 4 AS px, y - 20 + 40 * (k // 4 + 0.5) / 4 AS py FROM points, range(16) r(k)),
t AS (SELECT CAST((s_suppkey * 7919) % 1000 AS DOUBLE) AS x0, CAST((s_suppkey * 6101) % 997 AS DOUBLE) AS y0 FROM supplier)
SELECT id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM t WHERE px BETWEEN x0 AND x0 + 90 AND py BETWEEN y0 AND y0 + 90) THEN 1.0 ELSE 0 END), 8) AS coverage FROM g GROUP BY 1
""",
}
