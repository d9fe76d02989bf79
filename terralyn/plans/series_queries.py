"""Queries of the series slice over events as pixel observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralyn.operators import series
from terralyn.plans.derive import CURVES, OBS, observations
from terralyn.sources.tables import table


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.field_curves(observations(spark, sf_dir))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 8) for n in names})


def zone_means(spark, sf_dir):
    return _rounded(series.zone_means(observations(spark, sf_dir)), *series.ZONES)


def field_curves(spark, sf_dir):
    return _rounded(_curves(spark, sf_dir), "value")


def covered_dates(spark, sf_dir):
    return series.covered_dates(_curves(spark, sf_dir), 0.6)


def complete_fields(spark, sf_dir):
    return series.complete_fields(_curves(spark, sf_dir), 0.9, 3)


def date_axis(spark, sf_dir):
    return series.date_axis(observations(spark, sf_dir))


def centroid_support(spark, sf_dir):
    own = observations(spark, sf_dir).select(F.col("field_key").alias("cluster"), "date", "value")  # most fields lack some dates
    return _rounded(series.centroids(own, "cluster"), "mean")


def gap_fill(spark, sf_dir):
    curves = _curves(spark, sf_dir)
    return _rounded(series.gap_fill(curves, curves.select("date").distinct()), "value")


def asof_both_sides(spark, sf_dir):
    targets = spark.range(5).select(F.date_add(F.lit("2024-01-03").cast("date"), (F.col("id") * 6).cast("int")).alias("target"))
    return _rounded(series.value_at(_curves(spark, sf_dir), targets), "value")


def revisit_gap(spark, sf_dir):
    return series.revisit_gap(observations(spark, sf_dir))


def bare_runs(spark, sf_dir):
    return series.low_runs(_curves(spark, sf_dir), 60.0)


def pixel_summary(spark, sf_dir):
    return _rounded(series.pixel_values(observations(spark, sf_dir)), "mean", "amplitude")


def one_scene_per_date(spark, sf_dir):
    scenes = observations(spark, sf_dir).select("date", "pixel_id", (F.col("value") > 100).cast("int").alias("has_data"))
    return series.one_scene_per_date(scenes, "has_data", "pixel_id")


def chart_axis(spark, sf_dir):
    days = observations(spark, sf_dir).select("field_key", F.dayofyear("date").alias("day"))
    return series.chart_axis(days, 40, ["field_key"])


def timeline_position(spark, sf_dir):
    return _rounded(series.timeline_position(observations(spark, sf_dir)), "percent")


def nearest_observation(spark, sf_dir):
    return _rounded(series.nearest_observation(_curves(spark, sf_dir), F.lit("2024-01-15").cast("date"), 0.05), "value")


def long_form(spark, sf_dir):
    wide = _curves(spark, sf_dir).withColumn("name", F.concat(F.lit("NDVI__"), F.date_format("date", "yyyy-MM-dd"))).groupBy("field_key").pivot("name").agg(F.avg("value"))
    return _rounded(series.melt_dates(wide, ["field_key"]), "value")


def date_span_from_columns(spark, sf_dir):
    names = F.explode(F.array(F.lit("NewID"), F.concat(F.lit("NDVI__"), F.date_format("date", "yyyy-MM-dd")), F.lit("mean_all"))).alias("name")
    return series.date_span(observations(spark, sf_dir).select(names).distinct())


def kept_coverage(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("species"), (F.col("o_custkey") % 7).alias("_c")).agg(F.count("*").alias("size"))
    from terralyn.operators.relational import ranked_clusters

    ranked = ranked_clusters(sizes.withColumnRenamed("_c", "cluster")).select("species", F.col("rank").alias("cluster"), "size")
    return _rounded(series.coverage_of_kept(ranked, 4), "share")


QUERIES = {f.__name__: f for f in (zone_means, field_curves, covered_dates, complete_fields, date_axis, centroid_support, gap_fill, asof_both_sides, revisit_gap, bare_runs, pixel_summary, one_scene_per_date, chart_axis, timeline_position, nearest_observation, long_form, date_span_from_columns, kept_coverage)}

ORACLE_SQL = {
    "zone_means": f"""
WITH {OBS}
SELECT date, round(avg(value) FILTER (zone = 'interior'), 8) AS interior, round(avg(value) FILTER (zone = 'edge_other'), 8) AS edge_other,
       round(avg(value) FILTER (zone = 'edge_same'), 8) AS edge_same, round(avg(value) FILTER (zone = 'edge_isolated'), 8) AS edge_isolated
FROM obs GROUP BY 1
""",
    "field_curves": f"WITH {CURVES} SELECT field_key, date, round(value, 8) AS value FROM curves",
    "covered_dates": f"""
WITH {CURVES}
SELECT date, count(DISTINCT field_key) AS n_fields FROM curves GROUP BY 1
HAVING count(DISTINCT field_key) >= 0.6 * (SELECT count(DISTINCT field_key) FROM curves)
""",
    "complete_fields": f"""
WITH {CURVES},
d AS (SELECT date FROM curves GROUP BY 1 HAVING count(DISTINCT field_key) >= 0.9 * (SELECT count(DISTINCT field_key) FROM curves))
SELECT field_key, count(DISTINCT date) AS n_dates FROM curves WHERE date IN (SELECT date FROM d) GROUP BY 1
HAVING count(DISTINCT date) = (SELECT count(*) FROM d) AND (SELECT count(*) FROM d) >= 3
""",
    "date_axis": f"""
WITH {OBS}
SELECT date, count(DISTINCT field_key) AS n_pixels FROM obs GROUP BY 1
HAVING count(DISTINCT field_key) >= greatest(5.0, 0.02 * (SELECT count(DISTINCT field_key) FROM obs))
""",
    "centroid_support": f"""
WITH {OBS},
own AS (SELECT field_key AS cluster, date, value FROM obs),
spine AS (SELECT * FROM (SELECT DISTINCT cluster FROM own), (SELECT DISTINCT date FROM own))
SELECT s.cluster, s.date, round(avg(value), 8) AS mean, count(value) AS support
FROM spine s LEFT JOIN own o ON o.cluster = s.cluster AND o.date = s.date GROUP BY 1, 2
""",
    "gap_fill": f"""
WITH {CURVES},
axis AS (SELECT DISTINCT date FROM curves),
good AS (
  SELECT field_key FROM curves GROUP BY 1
  HAVING count(value) >= 3 AND date_diff('day', min(date), max(date)) >= 0.5 * (SELECT date_diff('day', min(date), max(date)) FROM axis)),
g AS (SELECT good.field_key, axis.date, c.value FROM good CROSS JOIN axis LEFT JOIN curves c ON c.field_key = good.field_key AND c.date = axis.date),
b AS (
  SELECT *, last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER p AS d1, last_value(value IGNORE NULLS) OVER p AS v1,
         first_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER f AS d2, first_value(value IGNORE NULLS) OVER f AS v2
  FROM g WINDOW p AS (PARTITION BY field_key ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                f AS (PARTITION BY field_key ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT field_key, date, round(coalesce(v1 + (v2 - v1) * date_diff('day', d1, date) / nullif(date_diff('day', d1, d2), 0), v1, v2), 8) AS value,
       value IS NULL AS filled
FROM b
""",
    "asof_both_sides": f"""
WITH {CURVES},
t AS (SELECT CAST(DATE '2024-01-03' + CAST(6 * i AS INTEGER) AS DATE) AS target FROM range(5) r(i)),
s AS (
  SELECT field_key, target, max(date) FILTER (date <= target) AS d1, arg_max(value, date) FILTER (date <= target) AS v1,
         min(date) FILTER (date >= target) AS d2, arg_min(value, date) FILTER (date >= target) AS v2
  FROM curves, t GROUP BY 1, 2)
SELECT field_key, target, round(coalesce(v1 + (v2 - v1) * date_diff('day', d1, target) / nullif(date_diff('day', d1, d2), 0), v1, v2), 8) AS value FROM s
""",
    "revisit_gap": f"""
WITH {OBS},
g AS (SELECT field_key, date_diff('day', lag(date) OVER (PARTITION BY field_key ORDER BY date), date) AS gap FROM (SELECT DISTINCT field_key, date FROM obs)),
l AS (SELECT field_key, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps FROM g GROUP BY 1)
SELECT field_key, CAST(coalesce(gaps[len(gaps) // 2 + 1], 10) AS INTEGER) AS gap_days FROM l
""",
    "bare_runs": f"""
WITH {CURVES}
SELECT field_key, date FROM (SELECT *, lag(value) OVER (PARTITION BY field_key ORDER BY date) AS was FROM curves) WHERE value < 60 AND was < 60
""",
    "pixel_summary": f"WITH {OBS} SELECT field_key, round(avg(value), 8) AS mean, round(max(value) - min(value), 8) AS amplitude FROM obs GROUP BY 1",
    "one_scene_per_date": f"""
WITH {OBS}
SELECT date, pixel_id, has_data FROM (
  SELECT date, pixel_id, CAST(value > 100 AS INTEGER) AS has_data,
         row_number() OVER (PARTITION BY date ORDER BY CAST(value > 100 AS INTEGER) DESC, pixel_id) AS nth FROM obs)
WHERE nth = 1
""",
    "chart_axis": f"""
WITH {OBS},
d AS (SELECT DISTINCT field_key, CAST(dayofyear(date) AS BIGINT) AS day FROM obs),
e AS (SELECT field_key, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1)
SELECT field_key, day FROM d UNION SELECT field_key, CAST(floor(lo + i * (hi - lo) / 39.0 + 0.5) AS BIGINT) FROM e, range(40) r(i)
""",
    "timeline_position": f"""
WITH {OBS}, d AS (SELECT DISTINCT date FROM obs), e AS (SELECT min(date) AS lo, max(date) AS hi FROM d)
SELECT date, round(coalesce(date_diff('day', lo, date) * 100.0 / nullif(date_diff('day', lo, hi), 0), 0), 8) AS percent FROM d, e
""",
    "nearest_observation": f"""
WITH {CURVES},
r AS (
  SELECT *, abs(date_diff('day', DATE '2024-01-15', date)) AS apart,
         row_number() OVER (PARTITION BY field_key ORDER BY abs(date_diff('day', DATE '2024-01-15', date)), date) AS nth,
         date_diff('day', min(date) OVER (PARTITION BY field_key), max(date) OVER (PARTITION BY field_key)) AS span
  FROM curves)
SELECT field_key, date, round(value, 8) AS value FROM r WHERE nth = 1 AND apart <= 0.05 * span
""",
    "long_form": f"""
WITH {CURVES}
SELECT field_key, 'NDVI' AS metric, date, round(value, 8) AS value FROM curves
""",
    "date_span_from_columns": "SELECT CAST(min(ts) AS DATE) AS first_date, CAST(max(ts) AS DATE) AS last_date FROM events",
    "kept_coverage": """
WITH s AS (SELECT o_orderpriority AS species, o_custkey % 7 AS c, count(*) AS size FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY size DESC, c) - 1 AS rank FROM s)
SELECT species, round(CAST(sum(CASE WHEN rank < 4 THEN size ELSE 0 END) AS DOUBLE) / CAST(sum(size) AS DOUBLE), 8) AS share FROM r GROUP BY 1
""",
}
