"""Row-level operators on fields: species, labels, first-per-key dedup, merging, deterministic samples and top lists."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terralyn.sources.scratch import cut

#: Attribute names that hold a species, in order, and parts of names that may.
SPECIES_KEYS = ["crp_lbl", "species", "crop", "Species", "Crop", "CROP", "label"]
SPECIES_PARTS = ["species", "crop", "plant", "veg", "class", "type", "label"]


def species_list(fields: DataFrame, column: str = "crp_lbl") -> DataFrame:
    return fields.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def field_key(new_id: Column, position: Column) -> Column:
    return F.coalesce(new_id.cast("string"), F.concat(F.lit("pid:"), position.cast("string")))


def first_per_id(rows: DataFrame, new_id: str, position: str) -> DataFrame:
    """The first row of each id; rows without one all stay.

    Rows without an id get a partition key of their own position, so they do not meet in one task.
    """
    order = Window.partitionBy(new_id, F.when(F.col(new_id).isNull(), F.col(position))).orderBy(position)
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def numbered(rows: DataFrame, position: str, name: str = "pid") -> DataFrame:
    """Numbers rows from 0 in the order of a column.

    Ranges of the order are numbered in parallel, each from the rows counted before it; no task sees all rows. The ranges
    are written once, with the number of the range in each row, so the counts and the numbering see the same ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(rows.repartitionByRange(parts, position).withColumn("_part", F.spark_partition_id()), "ranges")
    local = spread.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(position)))
    sizes = local.groupBy("_part").agg(F.count("*").alias("_size"))
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return local.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_in") - 1).drop("_part", "_in", "_start")


def merge_new(existing: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """The existing rows and those added ones whose key is not among them."""
    return existing.unionByName(added.join(existing.select(key), key, "left_anti").select(*existing.columns))


def not_in_series(candidates: DataFrame, series: DataFrame) -> DataFrame:
    return candidates.join(series.select("date").distinct(), "date", "left_anti")


def extract_species(attributes: Column) -> Column:
    """From a map of attributes: the first known key with a value, else the first key that looks like one."""
    exact = [F.nullif(F.trim(attributes[k]), F.lit("")) for k in SPECIES_KEYS]
    like = F.map_filter(attributes, lambda k, v: F.lower(k).rlike("|".join(SPECIES_PARTS)) & (F.trim(v) != ""))
    return F.coalesce(*exact, F.get(F.map_values(like), F.lit(0)))


def polygon_label(species: Column, new_id: Column, name: Column, part: Column, parts: Column, number: Column) -> Column:
    """species and id, with the part where there are several; else the name; else the number."""
    suffix = F.when(parts > 1, F.concat(F.lit(" ("), part.cast("string"), F.lit("/"), parts.cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return F.coalesce(F.concat(species, F.lit(" · "), new_id.cast("string"), suffix), F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("Polygon "), number.cast("string")))


def evenly_spaced(rows: DataFrame, position: str, n: int) -> DataFrame:
    """n rows at round(i (len - 1) / (n - 1)) of the order; all of them where there are no more, the first where n is 1."""
    own = numbered(rows, position, "_at")
    size = own.agg(F.count("*").alias("_len"))
    step = F.lit(0.0) if n == 1 else (F.col("_len") - 1) / F.lit(float(n - 1))
    picks = size.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.col("_len") <= n, i.cast("long")).otherwise(F.floor(i * step + 0.5)))).alias("_at")).distinct()
    return own.join(F.broadcast(picks), "_at", "left_semi").drop("_at")


def evenly_indexed(rows: DataFrame, position: str, cap: int) -> DataFrame:
    """At most cap rows, at floor(i n / cap) of the order."""
    own = numbered(rows, position, "_at")
    size = own.agg(F.count("*").alias("_len"))
    hit = F.floor(F.ceil(F.col("_at") * cap / F.col("_len")) * F.col("_len") / cap)
    return own.crossJoin(F.broadcast(size)).where((F.col("_len") <= cap) | ((hit == F.col("_at")) & (F.ceil(F.col("_at") * cap / F.col("_len")) < cap))).drop("_at", "_len")


def hash_keep(k: Column, share: float) -> Column:
    """Whether a row of number k is in a share chosen by multiplicative hashing modulo 2 ** 32."""
    return F.pmod((k + 1) * F.lit(2654435761), F.lit(4294967296)) < share * 4294967296.0


def ranked_clusters(sizes: DataFrame) -> DataFrame:
    """species, cluster, size, rank: clusters renumbered from 0 by size, ties by their old number."""
    order = Window.partitionBy("species").orderBy(F.desc("size"), "cluster")
    return sizes.withColumn("rank", F.row_number().over(order) - 1)


def clean_values(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null; columns that JSON has no type for as text."""
    plain = {"tinyint", "smallint", "int", "bigint", "string", "boolean"}
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif kind not in plain:
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def run_script(spark, sql: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Runs the statements of a script in order and returns the last one's rows; an empty script is an error.

    The views are there for the script alone.
    """
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    out = None
    try:
        for statement in re.findall(r"(?:'(?:[^']|'')*'|[^;'])+", sql):
            if statement.strip():
                out = spark.sql(statement)
    finally:
        for name in views or {}:
            spark.catalog.dropTempView(name)
    if out is None:
        raise ValueError("the script has no statement")
    return out


def load_fields(rows: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Applies a filter of the caller's to fields with a geometry; plain errors say what is missing."""
    if "geometry" not in rows.columns:
        raise ValueError("no geometry column")
    out = rows.where("geometry is not null")
    return out.transform(keep) if keep else out


def check_request(species: list[str], distance: float, most: int, ids: list[str] = ()) -> None:
    """Refuses a neighbour request that cannot be answered: plain errors say why."""
    if len(set(species)) < 2:
        raise ValueError("choose at least two species")
    if not distance > 0 or distance == float("inf"):
        raise ValueError("the distance must be a positive number")
    if int(most) != most or most < 1:
        raise ValueError("the number of pairs must be a whole number of at least 1")
    if bad := [i for i in ids if not re.fullmatch(r"-?\d+", str(i))]:
        raise ValueError(f"not an id: {bad[0]}")


def bordering(fields: DataFrame, species: list[str], column: str = "crp_lbl") -> tuple[DataFrame, DataFrame]:
    """The fields of some species, and the others, which can be put back by a union; fields of no species are others."""
    chosen = F.coalesce(F.col(column).isin(species), F.lit(False))
    return fields.where(chosen), fields.where(~chosen)


def scoped(pixels: DataFrame, members: DataFrame | None = None, fields: list | None = None, zones: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Pixels (field_key, zone, date) of a scenario's members (field_key), of some fields and zones, from start to end; None is no limit."""
    out = pixels
    if members is not None:
        out = out.join(members.select("field_key").distinct(), "field_key", "left_semi")
    for column, values in (("field_key", fields), ("zone", zones)):
        if values is not None:
            out = out.where(F.col(column).isin(list(values)))
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    return out if end is None else out.where(F.col("date") <= F.lit(end).cast("date"))


def with_scenarios(pixels: DataFrame, clusters: DataFrame, kept: int) -> DataFrame:
    """Pixels with the cluster of their field (field_key, cluster, ranked by size from 0), null beyond the kept ones."""
    return pixels.join(clusters.where(F.col("cluster") < kept).select("field_key", "cluster"), "field_key", "left")


def sampled_with(rows: DataFrame, position: str, cap: int, selected: Column) -> DataFrame:
    """At most cap evenly placed rows, and the selected ones in any case."""
    return evenly_indexed(rows, position, cap).unionByName(rows.where(selected)).distinct()


#: Words of a column that names plots, in order.
NAME_WORDS = ["name", "nom", "plot", "parcel", "parcelle", "plotid", "id", "code", "label"]


def column_shapes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, place, rows, n_distinct, n_empty of some columns as text, in one pass."""
    text = lambda c: F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    facts = rows.agg(F.count("*").alias("rows"), *[F.countDistinct(text(c)).alias(f"_d{k}") for k, c in enumerate(columns)], *[F.count(F.when(text(c) == "", 1)).alias(f"_e{k}") for k, c in enumerate(columns)])
    return facts.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("place"), F.col(f"_d{k}").alias("n_distinct"), F.col(f"_e{k}").alias("n_empty")) for k, c in enumerate(columns)])).alias("s")).select("s.column", "s.place", "rows", "s.n_distinct", "s.n_empty")


def _word_ranks(shapes: DataFrame, words: list[str]) -> DataFrame:
    """Adds, for each column, the place of the first word that its name is (whole) and that is among its name's parts (part)."""
    parts = F.filter(F.split(F.lower("column"), "[^a-z0-9]+"), lambda w: w != "")
    said = shapes.select("place", F.explode(F.concat(F.transform(parts, lambda w: F.struct(w.alias("word"), F.lit(False).alias("all"))), F.array(F.struct(F.array_join(parts, "").alias("word"), F.lit(True).alias("all"))))).alias("s")).select("place", "s.word", "s.all")
    known = shapes.sparkSession.createDataFrame(list(enumerate(words)), "rank int, word string")
    ranks = said.join(F.broadcast(known), "word").groupBy("place").agg(F.min(F.when(F.col("all"), F.col("rank"))).alias("whole"), F.min(F.when(~F.col("all"), F.col("rank"))).alias("part"))
    return shapes.join(ranks, "place", "left")


def _first(shapes: DataFrame, *order: Column) -> DataFrame:
    """The column that comes first by an order, then by place; one null row where there is none."""
    return shapes.agg(F.min_by("column", F.struct(*order, F.col("place"))).alias("column"))


def name_column(shapes: DataFrame) -> DataFrame:
    """The column that names each row: full and without repeats, one that is or holds a name word first."""
    late = F.lit(len(NAME_WORDS))
    keys = _word_ranks(shapes.where("n_distinct = rows and n_empty = 0"), NAME_WORDS)
    return _first(keys, F.coalesce("whole", late), F.coalesce("part", late))


def variety_column(shapes: DataFrame, words: list[str], most: int = 252) -> DataFrame:
    """The column that tells varieties: named by a word (in order), else the most varied one that repeats, else the most varied.

    Of named columns, those that repeat come before those that do not, and these before constant ones.
    """
    ranked = _word_ranks(shapes.where((F.col("n_distinct") <= most) & (F.col("n_empty") < F.col("rows"))), words)
    varied, repeats = F.col("n_distinct") >= 2, F.col("n_distinct") < F.col("rows")
    told = ranked.where(F.col("part").isNotNull() | varied)
    shape = (~varied).cast("int") * 2 + (varied & ~repeats).cast("int")
    unnamed = F.col("part").isNull()
    return _first(told, unnamed, shape, F.when(unnamed, -F.col("n_distinct")).otherwise(F.col("part")))
