"""Weighted medians, index-floor percentiles, rank statistics, contrast stretch and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terralyn.sources.scratch import cut


def running_sums(rows: DataFrame, groups: list[str], value: str, weight: str) -> DataFrame:
    """Adds _run, the weight of a group's rows up to this one in order of value, and _total, the group's weight.

    rows has one row for each value of a group. Ranges of (groups, value) are summed apart and then each starts from
    what the ranges before it hold, so no task sees all values of a group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(rows.repartitionByRange(parts, *groups, value).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = spread.groupBy(*groups, "_part").agg(F.sum(weight).alias("_sum"))
    own = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_sum").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*groups, "_part", before.alias("_before"), F.sum("_sum").over(own).alias("_total"))
    inside = F.sum(weight).over(Window.partitionBy(*groups, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return spread.withColumn("_inside", inside).join(starts, [*groups, "_part"]).withColumn("_run", F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


def weighted_median(rows: DataFrame, groups: list[str], value: str, weight: str) -> DataFrame:
    """groups and median: the value where half of the weight is reached; two values that share the half are averaged.

    Zero, null and NaN weights do not vote.
    """
    seen = rows.where((F.col(weight) > 0) & ~F.isnan(F.col(weight).cast("double")) & F.col(value).isNotNull())
    sums = seen.groupBy(*groups, value).agg(F.sum(weight).alias("_w"))
    at = running_sums(sums, groups, value, "_w").withColumn("_half", F.col("_total") / 2)
    low = F.min(F.when(F.col("_run") >= F.col("_half"), F.struct(F.col(value).alias("v"), (F.col("_run") == F.col("_half")).alias("even"))))
    high = F.min(F.when(F.col("_run") > F.col("_half"), F.col(value)))
    hit = at.groupBy(*groups).agg(low.alias("_low"), high.alias("_high"))
    return hit.select(*groups, F.when(F.col("_low.even"), (F.col("_low.v") + F.coalesce("_high", "_low.v")) / 2).otherwise(F.col("_low.v").cast("double")).alias("median"))


def shared_window(medians: DataFrame, start: str, end: str) -> DataFrame:
    """Latest start to earliest end over all species; no row where that is empty."""
    out = medians.agg(F.max(start).alias("window_start"), F.min(end).alias("window_end"))
    return out.where("window_start <= window_end")


def floor_percentile(rows: DataFrame, groups: list[str], value: str, share: float) -> DataFrame:
    """The value at place floor(n share) of the order; 1 where that is not positive. Places come from counts of distinct values."""
    sums = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    at = running_sums(sums, groups, value, "_n")
    hit = at.groupBy(*groups).agg(F.min(F.when(F.col("_run") > F.floor(F.col("_total") * share), F.col(value))).alias("percentile"))
    return hit.withColumn("percentile", F.when(F.col("percentile") > 0, F.col("percentile")).otherwise(F.lit(1.0)))


def quarter_turn_mean(sides: DataFrame, groups: list[str]) -> DataFrame:
    """groups and angle, 0 to 90 degrees: the mean direction of sides (length, angle in radians), quarter turns being alike."""
    total = lambda f: F.sum(F.col("length") * f(4 * F.col("angle")))
    return sides.groupBy(*groups).agg(F.pmod(F.degrees(F.atan2(total(F.sin), total(F.cos))) / 4, F.lit(90.0)).alias("angle"))


def rank_auc(rows: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """auc, mean of the positive and of the negative class; ordinal ranks, ties in order of another column.

    Rank sums of ranges of the order add up: a range's ranks follow from the rows counted before it.
    """
    spread = rows.select(F.col(score).alias("_s"), F.col(label).alias("_l"), F.col(tie).alias("_t")).repartitionByRange("_s", "_t").sortWithinPartitions("_s", "_t").withColumn("_part", F.spark_partition_id())
    local = spread.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy("_s", "_t")))
    parts = local.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(F.when(F.col("_l") == 1, F.col("_r"))).alias("_rs"), F.count(F.when(F.col("_l") == 1, 1)).alias("_p"), F.sum(F.when(F.col("_l") == 1, F.col("_s"))).alias("_sp"), F.sum(F.when(F.col("_l") != 1, F.col("_s"))).alias("_sn"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = parts.withColumn("_b", before).agg(F.sum(F.coalesce("_rs", F.lit(0)) + F.col("_b") * F.col("_p")).cast("double").alias("rs"), F.sum("_p").cast("double").alias("p"), F.sum("_n").cast("double").alias("n"), F.sum("_sp").alias("sp"), F.sum("_sn").alias("sn"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return total.select(((F.col("rs") - p * (p + 1) / 2) / F.when(p * q > 0, p * q)).alias("auc"), (F.col("sp") / F.when(p > 0, p)).alias("mean_positive"), (F.col("sn") / F.when(q > 0, q)).alias("mean_negative"))


def flag_precision(rows: DataFrame, score: str, label: str, limit: float) -> DataFrame:
    """Rows flagged by a score of at least limit, and the share of them that carry the label."""
    flagged = rows.where(F.col(score) >= limit)
    return flagged.agg(F.count("*").alias("n_flagged"), F.avg((F.col(label) == 1).cast("double")).alias("precision"))


def stretched(value: Column, low: Column, high: Column) -> Column:
    """A value on the scale 0 to 255 between two limits; NaN and null are 0."""
    width = F.when(high > low, high - low)
    part = F.coalesce((value - low) / width, F.lit(0.0))
    return F.when(F.isnan(value), 0).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)) * 255 + 0.5)).cast("int")


def histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """bin and n of values from 0 to 1, the last bin closed."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor(F.col(value) * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def categories(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))


def column_facts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_distinct, n_empty for each column, from one pass."""
    facts = rows.agg(*[f for c in columns for f in (F.countDistinct(c).alias(f"{c}__d"), F.count(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", 1)).alias(f"{c}__e"))])
    return facts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__d").alias("n_distinct"), F.col(f"{c}__e").alias("n_empty")) for c in columns])).alias("_c")).select("_c.*")


def first_seen(rows: DataFrame, key: str, position: str) -> DataFrame:
    """key, first_position, n: varieties in order of appearance with their plots."""
    return rows.groupBy(key).agg(F.min(position).alias("first_position"), F.count("*").alias("n"))
