"""Inputs derived from the driver's tables, by expressions that any SQL engine evaluates alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralyn.sources.tables import table

REACH = 12.0


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pixel observations: the user is the field, the event type its zone."""
    kind = F.col("event_type")
    zone = F.when(kind.isin("click", "error"), "interior").when(kind == "view", "edge_other").when(kind == "purchase", "edge_same").otherwise("edge_isolated")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pixel_id"), F.col("user_id").alias("field_key"), F.to_date("ts").alias("date"), zone.alias("zone"), kind.alias("event_type"), "value")


OBS = """
obs AS (
  SELECT event_id AS pixel_id, user_id AS field_key, CAST(ts AS DATE) AS date,
         CASE WHEN event_type IN ('click', 'error') THEN 'interior' WHEN event_type = 'view' THEN 'edge_other'
              WHEN event_type = 'purchase' THEN 'edge_same' ELSE 'edge_isolated' END AS zone, event_type, value
  FROM events)
"""

CURVES = f"""{OBS},
daily AS (
  SELECT field_key, date, avg(value) FILTER (zone = 'interior') AS vi, avg(value) FILTER (zone <> 'interior') AS ve,
         count(*) FILTER (zone = 'interior') AS n
  FROM obs GROUP BY 1, 2),
curves AS (
  SELECT field_key, date, value FROM (
    SELECT field_key, date, CASE WHEN sum(n) OVER (PARTITION BY field_key) > 0 THEN vi ELSE ve END AS value FROM daily)
  WHERE value IS NOT NULL)
"""


def season_sql(t: str, p: tuple[float, ...]) -> str:
    """A season preset at day t."""
    high, rise, up, fall, down, between = p
    late = lambda d: f"(1 / (1 + exp(-(({d}) - {between}) / 2.5)))"
    one = lambda d: f"((1 - {late(d)}) * {high} / (1 + exp(-{rise} * (({d}) - {up}))) + {late(d)} * ({high} - {high} / (1 + exp(-{fall} * (({d}) - {down})))))"
    return f"least(1 - 1e-9, greatest(1e-9, {one(t)} + {one(f'({t}) - 365')} + {one(f'({t}) + 365')}))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as fields at whole coordinates; the market segment is the species."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_mktsegment").alias("crp_lbl"), ((k * k * 31 + k * 17) % 1000).cast("double").alias("x"), ((k * k * 13 + k * 101) % 997).cast("double").alias("y"))


POINTS = """
points AS (
  SELECT c_custkey AS id, c_mktsegment AS crp_lbl, CAST((c_custkey * c_custkey * 31 + c_custkey * 17) % 1000 AS DOUBLE) AS x,
         CAST((c_custkey * c_custkey * 13 + c_custkey * 101) % 997 AS DOUBLE) AS y FROM customer)
"""

PAIRS = f"""{POINTS},
pairs AS (
  SELECT a.id AS a_id, a.crp_lbl AS a_crp_lbl, b.id AS b_id, b.crp_lbl AS b_crp_lbl,
         sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance
  FROM points a JOIN points b ON a.id < b.id AND a.crp_lbl <> b.crp_lbl
   AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 144)
"""
