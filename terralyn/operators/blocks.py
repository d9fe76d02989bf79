"""Joins whose pairs are judged by NumPy: rows of equal keys meet in one task, in pieces of a bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the left side that a task holds for a key at most, on average; a key of more is dealt into slices.
CROWD = 4096

Body = Callable[[pa.StructArray, pa.StructArray], Iterator[pa.RecordBatch]]


def met(a: DataFrame, b: DataFrame, keys: list[str], body: Body, schema: str) -> DataFrame:
    """What body yields of the rows of a and b (without their keys, which are longs) that have equal keys.

    A key's rows of a are held in slices of about CROWD, told apart by a hash of the whole row; its rows of b go to each
    slice and stream by it, so a task holds one slice and one batch whatever a key holds.
    """
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = {"_a": [c for c in a.columns if c not in keys], "_b": [c for c in b.columns if c not in keys]}
    crowds = a.groupBy(*keys).agg(F.ceil(F.count("*") / CROWD).cast("int").alias("_slices")).where("_slices > 1")
    sides = {}
    for name, df in (("_a", a), ("_b", b)):
        own = df.select(*keys, F.struct(*names[name]).alias(name)).join(F.broadcast(crowds), keys, "left")  # a row for CROWD rows of a at most
        most = F.coalesce("_slices", F.lit(1))
        nth = F.pmod(F.xxhash64(name), most).cast("int") if name == "_a" else F.explode(F.sequence(F.lit(0), most - 1))
        sides[name] = own.select(*keys, nth.alias("_nth"), F.lit(name == "_b").alias("_late"), name)
    kind = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    left = sides["_a"].select("*", kind(sides["_b"], "_b"))
    right = sides["_b"].select(*keys, "_nth", "_late", kind(sides["_a"], "_a"), "_b")
    dealt = left.unionByName(right).repartition(parts, *keys, "_nth").sortWithinPartitions(*keys, "_nth", "_late")

    def run(batches):
        tag, held, whole = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*keys, "_nth", "_late")], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, [len(at)]]).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                own = tuple(at[lo, :-1].tolist())
                if own != tag:
                    tag, held, whole = own, [], None
                if not at[lo, -1]:
                    held.append(batch.column("_a").slice(lo, hi - lo))
                elif held:
                    whole = pa.concat_arrays(held) if whole is None else whole
                    yield from body(whole, batch.column("_b").slice(lo, hi - lo))

    return dealt.mapInArrow(run, schema)


def matrix_of(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
