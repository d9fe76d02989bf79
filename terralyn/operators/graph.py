"""Field adjacency graphs: connected components and the components that span a set of species."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralyn.operators.spatial import kinds, near_pairs, neighbour_pairs
from terralyn.sources.scratch import cut, drop

#: Links that a task joins at a time; bounds a Python worker's memory.
CHUNK = 1 << 20


def stars(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id, id) for every id of some links that is not the smallest of those it reaches over them."""
    ids, ends = np.unique(np.concatenate([low, high]), return_inverse=True)
    a, b = ends[: len(low)], ends[len(low) :]
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while not (root == (up := root[root])).all():
            root = up
        if (root[a] == root[b]).all():
            own = np.flatnonzero(root != np.arange(len(ids)))
            return ids[root[own]], ids[own]


def _read(batches):
    """As _joined; stars leave out links of an id with itself, so those pass as they are."""
    alone = []

    def seen():
        for batch in batches:
            low, high = (batch.column(c).to_numpy() for c in ("low", "high"))
            alone.append(np.unique(low[low == high]))
            yield batch

    for out in _joined(seen()):
        yield out
        ids = pa.array(np.unique(np.concatenate(alone)) if alone else np.zeros(0, np.int64))
        alone.clear()
        yield pa.RecordBatch.from_arrays([ids, ids], ["low", "high"])


def _joined(batches):
    """Links (low, high) as the stars of the links of a chunk; a chunk ends where high changes."""
    held = [np.zeros(0, np.int64)] * 2
    for batch in batches:
        held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("low", "high"), strict=True)]
        if len(held[0]) >= CHUNK:
            low, high = stars(*held)
            last = high == held[1][-1]
            yield pa.RecordBatch.from_arrays([pa.array(low[~last]), pa.array(high[~last])], ["low", "high"])
            held = [low[last], high[last]]
    low, high = stars(*held)
    yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["low", "high"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): every id of edges (src, dst) with the smallest id that it reaches.

    Each task joins the links that it holds and passes on a star for each of its groups, so a giant component or a hub
    costs a row for each id and task. If CHUNK rows at most are left, one task joins them. Otherwise rounds deal the
    links by their greater end, join again, and let every id follow its smaller one; their number grows with the
    logarithm of the longest path. A link with itself names its id.
    """
    least, most = F.least("src", "dst").cast("long"), F.greatest("src", "dst").cast("long")
    read = cut(edges.select("src", "dst").dropna().select(least.alias("low"), most.alias("high")).mapInArrow(_read, "low long, high long"), "graph")  # edges are evaluated once
    links, loops = read.where("low < high"), read.where("low = high").select(F.col("low").alias("id"))
    alone = cut(loops.distinct(), "graph") if loops.limit(1).count() else None
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if links.count() <= CHUNK:
        few = cut(links.coalesce(1).mapInArrow(_joined, "low long, high long"), "graph")
        drop(links)
        return _labels(few, alone)
    while True:
        own = cut(links.repartition(parts, "high").sortWithinPartitions("high").mapInArrow(_joined, "low long, high long"), "graph")
        drop(links)
        up = own.groupBy(F.col("high").alias("low")).agg(F.min("low").alias("_up"), F.count("*").alias("_n"))
        links = cut(own.join(up.hint("merge"), "low", "left").select(F.coalesce("_up", "low").alias("low"), "high", (F.col("_up").isNotNull() | (F.col("_n") > 1)).alias("_moved")), "graph")
        moving = links.where("_moved").limit(1).count() or up.where("_n > 1").limit(1).count()
        drop(own)
        if not moving:
            break
    return _labels(links, alone)


def _labels(links: DataFrame, alone: DataFrame | None) -> DataFrame:
    labels = links.select(F.col("high").alias("id"), F.col("low").alias("component"))
    roots = links.select(F.col("low").alias("id")).distinct().withColumn("component", F.col("id"))
    known = labels.unionByName(roots)
    if alone is None:
        return known
    return known.unionByName(alone.join(known, "id", "left_anti").withColumn("component", F.col("id")))


def near_groups(fields: DataFrame, reach: float) -> DataFrame:
    """component and n of the groups of at least two fields (id, x, y) that links of at most reach join; a place stands for its fields."""
    places = cut(fields.where("id is not null").groupBy("x", "y").agg(F.min("id").alias("id"), F.countDistinct("id").alias("n")))
    near = near_pairs(places.select("id", "x", "y"), places.select("id", "x", "y"), reach, F.col("a_id") < F.col("b_id"))
    crowds = places.where("n > 1 and x is not null and y is not null").select(F.col("id").alias("src"), F.col("id").alias("dst"))
    labels = components(near.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst")).unionByName(crowds))
    return labels.join(places.select("id", "n"), "id").groupBy("component").agg(F.sum("n").alias("n"))


def neighbour_components(fields: DataFrame, reach: float) -> DataFrame:
    """components of neighbour_pairs: fields of one place and species share their neighbours, so one stands for them."""
    own = cut(kinds(fields))
    labels = components(neighbour_pairs(own, reach).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst")))
    found = own.join(labels, "id").select("x", "y", "crp_lbl", "component")
    return fields.select("id", "x", "y", "crp_lbl").join(found, ["x", "y", "crp_lbl"]).groupBy("id").agg(F.min("component").alias("component"))


def spanning(fields: DataFrame, edges: DataFrame, species: list[str]) -> DataFrame:
    """Fields (id, crp_lbl) of components that hold every one of some species; all linked fields for two or fewer."""
    return labelled_spanning(fields, components(edges), species)


def labelled_spanning(fields: DataFrame, labels: DataFrame, species: list[str]) -> DataFrame:
    """spanning for known components (id, component): fields of those that hold every one of some species."""
    labels = labels.join(fields.select("id", "crp_lbl"), "id")
    if len(species) <= 2:
        return labels.select("id", "crp_lbl", "component")
    held = labels.where(F.col("crp_lbl").isin(species)).groupBy("component").agg(F.countDistinct("crp_lbl").alias("_n"))
    return labels.join(held.where(F.col("_n") == len(set(species))), "component", "left_semi").select("id", "crp_lbl", "component")


def spans(fields: DataFrame, edges: DataFrame, species: list[str]) -> DataFrame:
    """One row: whether one component of the fields of these species holds all of them.

    It holds for fewer than two species, and where one of them is the species of no linked field: what the graph does
    not know is not called broken.
    """
    wanted = sorted(set(species))
    if len(wanted) < 2:
        return fields.sparkSession.range(1).select(F.lit(True).alias("spans"))
    linked = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    known = fields.join(linked, "id", "left_semi").where(F.col("crp_lbl").isin(wanted)).agg(F.countDistinct("crp_lbl").alias("_known"))
    own = fields.where(F.col("crp_lbl").isin(wanted)).select("id", "crp_lbl")
    inner = edges.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(own.select(F.col("id").alias("dst")), "dst", "left_semi")
    held = components(inner.select("src", "dst")).join(own, "id").groupBy("component").agg(F.countDistinct("crp_lbl").alias("_n"))
    best = held.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_best"))
    return best.crossJoin(known).select(((F.col("_known") < len(wanted)) | (F.col("_best") == len(wanted))).alias("spans"))


def valid_additions(fields: DataFrame, edges: DataFrame, base: list[str]) -> DataFrame:
    """Species that, added to a base, leave a component of base and addition that holds them all.

    One component run serves all candidates: its nodes are (candidate, field) pairs, numbered.
    """
    from terralyn.operators.relational import numbered

    others = fields.where(~F.col("crp_lbl").isin(base))
    pairs = fields.where(F.col("crp_lbl").isin(base)).select("id", "crp_lbl").crossJoin(others.select(F.col("crp_lbl").alias("candidate")).distinct())
    pairs = pairs.unionByName(others.select("id", "crp_lbl", F.col("crp_lbl").alias("candidate")))
    own = cut(numbered(pairs.withColumn("_at", F.struct("candidate", "id")), "_at", "node").drop("_at"))
    half = edges.join(own.select(F.col("id").alias("src"), F.col("node").alias("_s"), "candidate"), "src").join(own.select(F.col("id").alias("dst"), F.col("node").alias("_d"), "candidate"), ["dst", "candidate"])
    labels = components(half.select(F.col("_s").alias("src"), F.col("_d").alias("dst")))
    held = labels.join(own, labels["id"] == own["node"]).groupBy("candidate", "component").agg(F.countDistinct("crp_lbl").alias("_n"))
    return held.where(F.col("_n") == len(set(base)) + 1).select(F.col("candidate").alias("crp_lbl")).distinct()
