"""Late and withdrawn acquisitions: derived tables are computed anew in the order in which they depend on each other, and
come into force together or not at all.

Tables of a version lie in a folder of their own. A version is current once its row is in the log, which is appended last
and as one file, so a stage that fails, or a driver that is lost, leaves the version before it as it was. Tables that do
not depend on what has changed are carried over by their place. A batch that the log already has is not applied again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from graphlib import TopologicalSorter
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralyn.operators.cluster import kmeans
from terralyn.operators.phenology import carried_marks

#: Tables by name.
Tables = dict[str, DataFrame]


class Stage(NamedTuple):
    """A derived table: what it is computed from, and how, from the new tables and those of the version before."""

    inputs: tuple[str, ...]
    run: Callable[[Tables, Tables], DataFrame]


class StaleReplay(Exception):
    """Another replay has been committed since this one began."""


class Replay:
    """Versions of a source table and of all that stages derive from it, under one folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, source: str, key: str, stages: dict[str, Stage]):
        self.spark, self.folder, self.source, self.key, self.stages = spark, folder.rstrip("/"), source, key, stages
        unknown = {i for s in stages.values() for i in s.inputs} - {source, *stages}
        if unknown:
            raise ValueError(f"no table named {', '.join(sorted(unknown))}")
        self.order = [n for n in TopologicalSorter({n: set(s.inputs) for n, s in stages.items()}).static_order() if n in stages]

    def log(self) -> list:
        """(version, batch, tables) of every committed version, in order; empty before the first."""
        schema = "version long, batch long, tables map<string, string>"
        self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.folder}/log")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/log").orderBy("version").collect()

    def tables(self) -> Tables:
        """The tables of the current version."""
        log = self.log()
        return {n: self.spark.read.parquet(p) for n, p in log[-1]["tables"].items()} if log else {}

    def replay(self, added: DataFrame | None = None, withdrawn: DataFrame | None = None, batch: int | None = None) -> int:
        """Commits a version with rows added and keys withdrawn (one column, the key); returns its number.

        Rows of a key that is there already replace the old ones. Without any change the current version stays.
        """
        log = self.log()
        version = log[-1]["version"] if log else 0
        if batch is not None and any(r["batch"] == batch for r in log):
            return version
        before = {n: self.spark.read.parquet(p) for n, p in log[-1]["tables"].items()} if log else {}
        gone = [d.select(self.key).distinct() for d in (added, withdrawn) if d is not None and d.limit(1).count()]
        if not gone and log:
            return version
        place = f"{self.folder}/v{version + 1}-{uuid.uuid4().hex}"
        paths = dict(log[-1]["tables"]) if log else {}
        changed = before.get(self.source)
        for keys in gone:
            changed = changed.join(keys, self.key, "left_anti") if changed is not None else None
        if added is not None:
            changed = added if changed is None else changed.select(*added.columns).unionByName(added)
        if changed is None:
            raise ValueError("nothing to begin with")
        fresh = self._staged(place, self.source, changed, paths)
        now, moved = before | {self.source: fresh}, {self.source}
        for name in self.order:
            stage = self.stages[name]
            if moved & set(stage.inputs) or name not in paths:
                now[name] = self._staged(place, name, stage.run(now, before), paths)
                moved.add(name)
        after = self.log()
        if (after[-1]["version"] if after else 0) != version:
            raise StaleReplay(f"version {after[-1]['version']} has been committed since version {version} was read")
        row = self.spark.createDataFrame([(version + 1, batch, paths)], "version long, batch long, tables map<string, string>")
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        return version + 1

    def _staged(self, place: str, name: str, df: DataFrame, paths: dict[str, str]) -> DataFrame:
        paths[name] = f"{place}/{name}"
        df.write.parquet(paths[name])
        return self.spark.read.parquet(paths[name])


def means(tables: Tables, before: Tables) -> DataFrame:
    """field_key, species, date, mean, n of the interior pixels of scenes (pixel_id, field_key, species, zone, date, value)."""
    own = tables["scenes"].where("zone = 'interior' and value is not null")
    return own.groupBy("field_key", "species", "date").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def clusters(k: int) -> Callable[[Tables, Tables], DataFrame]:
    """species, field_key, cluster of the fields that have a mean on every date of the series."""

    def run(tables: Tables, before: Tables) -> DataFrame:
        dates = tables["means"].agg(F.countDistinct("date").alias("_dates"))
        curves = tables["means"].groupBy("species", "field_key").agg(F.array_sort(F.collect_list(F.struct("date", "mean"))).alias("_c"))
        whole = curves.crossJoin(F.broadcast(dates)).where(F.size("_c") == F.col("_dates"))
        rows = whole.select("species", F.col("field_key").alias("id"), F.transform("_c", lambda s: s["mean"]).alias("v"))
        return kmeans(rows, "species", k).withColumnRenamed("id", "field_key")

    return run


def marks(first: DataFrame) -> Callable[[Tables, Tables], DataFrame]:
    """species, cluster, start, end: a user's marks, carried to the clusters that hold most of the same fields; others are dropped."""

    def run(tables: Tables, before: Tables) -> DataFrame:
        if "marks" not in before:
            return first.select("species", "cluster", "start", "end")
        followed = carried_marks(before["clusters"], tables["clusters"]).select("species", F.col("old").alias("cluster"), "new")
        return before["marks"].join(followed, ["species", "cluster"]).select("species", F.col("new").alias("cluster"), "start", "end")

    return run


def series_stages(k: int, first_marks: DataFrame) -> dict[str, Stage]:
    """What a series of scenes is taken to: field means, clusters of fields, and marks of their seasons."""
    return {"means": Stage(("scenes",), means), "clusters": Stage(("means",), clusters(k)), "marks": Stage(("clusters",), marks(first_marks))}
