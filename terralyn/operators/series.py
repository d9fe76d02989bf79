"""Time series of fields and pixels: means by zone and date, shared date axes, gap filling and as-of lookups.

Observations are rows (field_key, date, zone, value); a missing observation is a missing row or a null, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ZONES = ["interior", "edge_other", "edge_same", "edge_isolated"]


def zone_means(obs: DataFrame) -> DataFrame:
    """date and the mean of each zone, null where a zone has no value on that date."""
    return obs.groupBy("date").pivot("zone", ZONES).agg(F.avg("value"))


def field_curves(obs: DataFrame) -> DataFrame:
    """field_key, date, value: the mean of a field's interior pixels, or of its edge where it has no interior at all."""
    inner = F.col("zone") == "interior"
    daily = obs.groupBy("field_key", "date").agg(F.avg(F.when(inner, F.col("value"))).alias("_in"), F.avg(F.when(~inner, F.col("value"))).alias("_edge"), F.count(F.when(inner, 1)).alias("_n"))
    has = F.sum("_n").over(Window.partitionBy("field_key")) > 0
    return daily.select("field_key", "date", F.when(has, F.col("_in")).otherwise(F.col("_edge")).alias("value")).where("value is not null")


def covered_dates(curves: DataFrame, share: float = 0.8) -> DataFrame:
    """Dates that at least a share of all fields have."""
    fields = curves.select(F.countDistinct("field_key").alias("_fields"))
    seen = curves.groupBy("date").agg(F.countDistinct("field_key").alias("n_fields"))
    return seen.crossJoin(fields).where(F.col("n_fields") >= share * F.col("_fields")).select("date", "n_fields")


def complete_fields(curves: DataFrame, share: float = 0.8, least: int = 3) -> DataFrame:
    """Fields with a value on every covered date; none where fewer than least dates are covered."""
    dates = covered_dates(curves, share)
    need = dates.select(F.count("*").alias("_need"))
    own = curves.join(dates, "date", "left_semi").groupBy("field_key").agg(F.countDistinct("date").alias("n_dates"))
    return own.crossJoin(need).where((F.col("n_dates") == F.col("_need")) & (F.col("_need") >= least)).select("field_key", "n_dates")


def date_axis(obs: DataFrame, least: int = 5, share: float = 0.02) -> DataFrame:
    """Dates that at least max(least, share of all pixels) observe."""
    pixels = obs.select((F.countDistinct("field_key") * share).alias("_share"))
    seen = obs.groupBy("date").agg(F.countDistinct("field_key").alias("n_pixels"))
    return seen.crossJoin(pixels).where(F.col("n_pixels") >= F.greatest(F.lit(float(least)), "_share")).select("date", "n_pixels")


def centroids(curves: DataFrame, group: str) -> DataFrame:
    """group, date, mean and support on every date of the axis: a date without members has support 0 and no mean."""
    spine = curves.select(group).distinct().crossJoin(curves.select("date").distinct())
    seen = curves.groupBy(group, "date").agg(F.avg("value").alias("mean"), F.count("value").alias("support"))
    return spine.join(seen, [group, "date"], "left").select(group, "date", "mean", F.coalesce("support", F.lit(0)).alias("support"))


def gap_fill(curves: DataFrame, axis: DataFrame, least: int = 3, span: float = 0.5) -> DataFrame:
    """Each field on every date of the axis: inner gaps linear in time, ends held flat.

    Fields with fewer than least observations, or that span less than the given part of the axis, are left out.
    """
    whole = axis.select(F.datediff(F.max("date"), F.min("date")).alias("_whole"))
    own = curves.groupBy("field_key").agg(F.count("value").alias("_n"), F.datediff(F.max("date"), F.min("date")).alias("_span"))
    good = own.crossJoin(whole).where((F.col("_n") >= least) & (F.col("_span") >= span * F.col("_whole"))).select("field_key")
    grid = good.crossJoin(axis.select("date").distinct()).join(curves.select("field_key", "date", "value"), ["field_key", "date"], "left")
    order = Window.partitionBy("field_key").orderBy("date")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("value").isNotNull(), F.struct("date", "value"))
    both = grid.withColumns({"_a": F.last(at, ignorenulls=True).over(before), "_b": F.first(at, ignorenulls=True).over(after)})
    return both.select("field_key", "date", between(F.col("date"), F.col("_a"), F.col("_b")).alias("value"), F.col("value").isNull().alias("filled"))


def between(date: Column, a: Column, b: Column) -> Column:
    """The value at a date on the line from a to b, structs of date and value; the other's value where one is null."""
    width = F.datediff(b["date"], a["date"])
    line = a["value"] + (b["value"] - a["value"]) * F.datediff(date, a["date"]) / F.when(width != 0, width)
    return F.coalesce(line, a["value"], b["value"])


def value_at(curves: DataFrame, targets: DataFrame) -> DataFrame:
    """field_key, target, value: each field's interpolated value at each target date, clamped at its ends.

    Targets (one column, target) stand among a field's observations in order of date and take the nearest one on
    either side, so the work is the curves and the result, whatever the number of targets. Repeated targets count once.
    """
    seen = curves.where("value is not null").groupBy("field_key", "date").agg(F.avg("value").alias("value"))
    seen = seen.select("field_key", "date", F.struct("date", "value").alias("_at"), F.lit(False).alias("_asked"))
    asked = seen.select("field_key").distinct().crossJoin(targets.select(F.col("target").alias("date")).dropna().distinct())
    both = seen.unionByName(asked.select("field_key", "date", F.lit(None).cast(seen.schema["_at"].dataType).alias("_at"), F.lit(True).alias("_asked")))
    order = Window.partitionBy("field_key").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("field_key").orderBy("date").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    sides = both.withColumns({"_a": F.last("_at", ignorenulls=True).over(order), "_b": F.first("_at", ignorenulls=True).over(after)}).where("_asked")
    return sides.select("field_key", F.col("date").alias("target"), between(F.col("date"), F.col("_a"), F.col("_b")).alias("value"))


def revisit_gap(obs: DataFrame, default: int = 10) -> DataFrame:
    """field_key and the upper median of the days between successive dates."""
    dates = obs.select("field_key", "date").distinct()
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("field_key").orderBy("date")))
    gaps = dates.withColumn("_gap", gap).groupBy("field_key").agg(F.sort_array(F.collect_list("_gap")).alias("_gaps"))
    n = F.size("_gaps")
    return gaps.select("field_key", F.coalesce(F.get("_gaps", F.floor(n / 2).cast("int")), F.lit(default)).alias("gap_days"))


def low_runs(curves: DataFrame, limit: float) -> DataFrame:
    """Dates on which a field's value and the one before it both lie under a limit."""
    before = F.lag("value").over(Window.partitionBy("field_key").orderBy("date"))
    return curves.withColumn("_before", before).where((F.col("value") < limit) & (F.col("_before") < limit)).select("field_key", "date")


def pixel_values(obs: DataFrame) -> DataFrame:
    """field_key, mean and amplitude of its values."""
    return obs.groupBy("field_key").agg(F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("amplitude"))


def one_scene_per_date(scenes: DataFrame, has_data: str, position: str) -> DataFrame:
    """The first scene of each date, or the first that has data where an earlier one has none."""
    order = Window.partitionBy("date").orderBy(F.col(has_data).desc(), position)
    return scenes.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def chart_axis(days: DataFrame, dense: int, keys: list[str]) -> DataFrame:
    """Of each group, the observed days and dense evenly spaced ones between first and last, each once."""
    ends = days.groupBy(*keys).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    spaced = ends.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(dense - 1)), lambda i: F.floor(F.col("lo") + i * (F.col("hi") - F.col("lo")) / (dense - 1) + 0.5))).alias("day"))
    return days.select(*keys, F.col("day").cast("long").alias("day")).unionByName(spaced.select(*keys, F.col("day").cast("long"))).where("day is not null").distinct()


def timeline_position(scenes: DataFrame) -> DataFrame:
    """Each distinct date's place between the first and the last, in percent; 0 where there is one date only."""
    dates = scenes.select("date").distinct()
    ends = dates.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    width = F.datediff("_hi", "_lo")
    return dates.crossJoin(ends).select("date", F.coalesce(F.datediff("date", "_lo") * 100.0 / F.when(width != 0, width), F.lit(0.0)).alias("percent"))


def nearest_observation(curves: DataFrame, target: Column, share: float = 0.02) -> DataFrame:
    """field_key and its observation nearest to a date, if within a share of its span; the earlier one of two."""
    apart = F.abs(F.datediff("date", target))
    best = curves.groupBy("field_key").agg(F.min(F.struct(apart.alias("apart"), "date", "value")).alias("_b"), F.datediff(F.max("date"), F.min("date")).alias("_span"))
    return best.where(F.col("_b.apart") <= share * F.col("_span")).select("field_key", "_b.date", "_b.value")


def melt_dates(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Columns named <metric>__<YYYY-MM-DD> as rows (ids, metric, date, value); empty cells are left out."""
    names = [c for c in wide.columns if "__" in c]
    long = wide.unpivot(ids, names, "_name", "value").where("value is not null")
    part = F.split("_name", "__")
    return long.select(*ids, part[0].alias("metric"), F.to_date(part[1]).alias("date"), "value")


def date_span(names: DataFrame) -> DataFrame:
    """First and last date among column names (one column, name) that end in one."""
    dates = names.select(F.to_date(F.nullif(F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})$", 1), F.lit(""))).alias("date"))
    return dates.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def coverage_of_kept(sizes: DataFrame, top: int) -> DataFrame:
    """Per species: the share of its fields in its first top clusters (clusters are ranked by size from 0)."""
    return sizes.groupBy("species").agg((F.sum(F.when(F.col("cluster") < top, F.col("size")).otherwise(0)) / F.sum("size")).alias("share"))
