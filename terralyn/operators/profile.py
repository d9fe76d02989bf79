"""Boundary profiles: measurements binned by signed distance to the field edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terralyn.functions.numeric import divide


def bin_center(distance: Column, width: float) -> Column:
    return (F.floor(distance / width) + 0.5) * width


def boundary_profile(obs: DataFrame, distance: str, value: str, width: float, groups: list[str]) -> DataFrame:
    """groups, distance_m (bin centre), mean, se, ci95, n; a bin of one value has a standard error of 0."""
    seen = obs.where(F.col(value).isNotNull() & ~F.isnan(value) & F.col(distance).isNotNull())
    binned = seen.groupBy(*groups, bin_center(F.col(distance), width).alias("distance_m")).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_sd"), F.count(value).alias("n")
    )
    se = F.col("_sd") / F.sqrt("n")
    return binned.select(*groups, "distance_m", "mean", se.alias("se"), (se * 1.96).alias("ci95"), "n")


def edge_influence(obs: DataFrame, distance: str, value: str, width: float, buffer: float, groups: list[str]) -> DataFrame:
    """For each group: interior level, edge level, magnitude (mei) and depth (dei) of edge influence.

    mei = (E - L) / (E + L), null where the sum is all but 0. dei is the last of the leading bins whose mean differs
    from L by more than both intervals together; 0 where the first bin does not differ.
    """
    profile = boundary_profile(obs, distance, value, width, groups).where("distance_m > 0")
    seen = obs.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(distance) >= buffer))
    interior = seen.groupBy(*groups).agg(F.avg(value).alias("interior"), (F.coalesce(F.stddev_samp(value), F.lit(0.0)) / F.sqrt(F.count(value)) * 1.96).alias("_ci"))
    along = Window.partitionBy(*groups).orderBy("distance_m")
    same = F.when(F.abs(F.col("mean") - F.col("interior")) > F.col("ci95") + F.col("_ci"), 0).otherwise(1)
    run = profile.join(interior, groups).withColumn("_same", F.sum(same).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy(*groups).agg(F.first("interior").alias("interior"), F.min_by("mean", "distance_m").alias("edge"), F.coalesce(F.max(F.when(F.col("_same") == 0, F.col("distance_m"))), F.lit(0.0)).alias("dei"))
    total = F.col("edge") + F.col("interior")
    mei = F.when(F.abs(total) > 1e-6, divide(F.col("edge") - F.col("interior"), total))
    return out.withColumn("mei", mei)
