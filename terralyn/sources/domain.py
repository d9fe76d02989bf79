"""Readers of the domain's JSON files: species graphs and crop calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralyn.functions.curves import crop_key


def read_species_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Fields (id, crp_lbl) and edges (src, dst) of a graph file; its fields are numbered from 0, its edges a flat list of pairs."""
    graph = spark.read.schema("distanceDeg double, species array<string>, fieldSpecies array<int>, edges array<long>").option("multiLine", True).json(path)
    fields = graph.select("species", F.posexplode("fieldSpecies").alias("id", "_s")).select(F.col("id").cast("long"), F.get("species", F.col("_s")).alias("crp_lbl"))
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("edges") / 2).cast("int")), lambda k: F.struct(F.get("edges", 2 * k - 2).alias("src"), F.get("edges", 2 * k - 1).alias("dst")))
    edges = graph.where("size(edges) > 1").select(F.explode(pairs).alias("e")).select("e.*")
    return fields, edges


def read_calendars(spark: SparkSession, path: str) -> DataFrame:
    """calendar_key, crop, regime, green_start, green_end, peak_start, peak_end of a file that maps crops to calendars."""
    kind = "struct<regime:string,greenStart:string,greenEnd:string,peakStart:string,peakEnd:string>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias("crop", "c"))
    names = (("regime", "regime"), ("greenStart", "green_start"), ("greenEnd", "green_end"), ("peakStart", "peak_start"), ("peakEnd", "peak_end"))
    return rows.select(crop_key(F.col("crop")).alias("calendar_key"), "crop", *[F.col(f"c.{a}").alias(b) for a, b in names])


def write_species_graph(fields: DataFrame, edges: DataFrame, distance: float, path: str) -> None:
    """A graph file of edges (src, dst) between fields (id, crp_lbl), which are numbered in order of id; one row of arrays, as the format asks."""
    from terralyn.operators.relational import numbered

    linked = fields.join(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")
    number = numbered(linked, "id", "k")
    own = edges.join(number.select(F.col("id").alias("src"), F.col("k").alias("a")), "src").join(number.select(F.col("id").alias("dst"), F.col("k").alias("b")), "dst")
    pairs = own.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("a", "b"))), lambda e: F.array(e["a"], e["b"]))).alias("edges"))
    names = number.agg(F.array_sort(F.collect_set("crp_lbl")).alias("species"), F.array_sort(F.collect_list(F.struct("k", "crp_lbl"))).alias("_f"))
    whole = names.crossJoin(pairs).select(F.lit(float(distance)).alias("distanceDeg"), "species", F.transform("_f", lambda f: F.array_position("species", f["crp_lbl"]) - 1).alias("fieldSpecies"), "edges")
    whole.coalesce(1).write.json(path)
