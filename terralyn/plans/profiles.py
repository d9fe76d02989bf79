"""Queries of slice 0: boundary profiles over line items as signed-distance observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralyn.operators import profile
from terralyn.sources.tables import table

WIDTH, BUFFER = 5.0, 10.0


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as a pixel: quantity less 25 is its signed distance, the discount its value, the return flag its class."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("crp_lbl"), (F.col("l_quantity") - 25).alias("edge_dist_m"), F.col("l_discount").alias("value"))


def boundary_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.boundary_profile(_observations(spark, sf_dir), "edge_dist_m", "value", WIDTH, ["crp_lbl"])
    return out.select("crp_lbl", "distance_m", *[F.round(c, 8).alias(c) for c in ("mean", "se", "ci95")], "n")


def edge_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.edge_influence(_observations(spark, sf_dir), "edge_dist_m", "value", WIDTH, BUFFER, ["crp_lbl"])
    return out.select("crp_lbl", *[F.round(c, 8).alias(c) for c in ("interior", "edge", "mei", "dei")])


_PROFILE = """
obs AS (SELECT l_returnflag AS crp_lbl, l_quantity - 25 AS d, l_discount AS v FROM lineitem),
prof AS (
  SELECT crp_lbl, (floor(d / 5.0) + 0.5) * 5.0 AS distance_m, avg(v) AS mean,
         coalesce(stddev_samp(v), 0) / sqrt(count(v)) AS se, count(v) AS n
  FROM obs GROUP BY 1, 2)
"""

QUERIES = {"boundary_profile": boundary_profile, "edge_influence": edge_influence}
ORACLE_SQL = {
    "boundary_profile": f"""
WITH {_PROFILE}
SELECT crp_lbl, distance_m, round(mean, 8) AS mean, round(se, 8) AS se, round(se * 1.96, 8) AS ci95, n FROM prof
""",
    "edge_influence": f"""
WITH {_PROFILE},
inter AS (
  SELECT crp_lbl, avg(v) AS interior, coalesce(stddev_samp(v), 0) / sqrt(count(v)) * 1.96 AS ci
  FROM obs WHERE d >= 10 GROUP BY 1),
run AS (
  SELECT p.*, i.interior,
         sum(CASE WHEN abs(p.mean - i.interior) > p.se * 1.96 + i.ci THEN 0 ELSE 1 END)
           OVER (PARTITION BY p.crp_lbl ORDER BY distance_m) AS same
  FROM prof p JOIN inter i USING (crp_lbl) WHERE distance_m > 0),
agg AS (
  SELECT crp_lbl, min(interior) AS interior, arg_min(mean, distance_m) AS edge,
         coalesce(max(CASE WHEN same = 0 THEN distance_m END), 0) AS dei
  FROM run GROUP BY 1)
SELECT crp_lbl, round(interior, 8) AS interior, round(edge, 8) AS edge,
       round(CASE WHEN abs(edge + interior) > 1e-6 THEN (edge - interior) / (edge + interior) END, 8) AS mei,
       round(dei, 8) AS dei
FROM agg
""",
}
