"""Convex hulls of points and their least widths, by hulls of hulls."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of n x 2 points, anticlockwise from the lowest left one; without collinear or repeated points."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    sides = []
    for order in (points, points[::-1]):
        side: list[np.ndarray] = []
        for p in order:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        sides += side[:-1]
    return np.array(sides)


def width(corners: np.ndarray) -> float:
    """The least distance between two parallel lines that hold a hull: one lies along a side. 0 without area.

    The corner farthest from a side only moves on from side to side, so all are found in one walk around.
    """
    n = len(corners)
    if n < 3:
        return 0.0
    least, far = np.inf, 1
    for k in range(n):
        a, side = corners[k], corners[(k + 1) % n] - corners[k]
        height = lambda j: side[0] * (corners[j % n][1] - a[1]) - side[1] * (corners[j % n][0] - a[0])  # noqa: B023, E731
        while height(far + 1) > height(far):
            far += 1
        least = min(least, height(far) / np.hypot(*side))
    return float(least)


def hulls(points: DataFrame, group: str) -> DataFrame:
    """group, hull array<struct<x, y>>, width, area of points (group, x, y); points without a place are left out.

    Every task passes on the hull of what it holds of each group; partial hulls meet in parts by their direction, then all.
    """
    kind, own_type = points.schema[group].dataType.simpleString(), to_arrow_type(points.schema[group].dataType)
    schema = f"`{group}` {kind}, x double, y double, part int"

    def thin(batches):
        held: dict[object, np.ndarray] = {}
        for batch in batches:
            names = batch.column(group).to_pylist()
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1) if len(names) else np.zeros((0, 2))
            places: dict[object, list[int]] = {}
            for k, name in enumerate(names):
                places.setdefault(name, []).append(k)
            for name, own in places.items():
                held[name] = hull(np.concatenate([held.get(name, np.zeros((0, 2))), at[own]]))
        for name, own in held.items():
            part = ((np.arctan2(*(own - own.mean(axis=0)).T) + np.pi) * 8 / np.pi).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), own_type), pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(part)], [group, "x", "y", "part"])

    def whole(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = hull(np.stack([table.column(c).to_numpy() for c in ("x", "y")], axis=1))
        turn = np.roll(own, -1, axis=0)
        area = float((own[:, 0] * turn[:, 1] - turn[:, 0] * own[:, 1]).sum() / 2) if len(own) > 2 else 0.0
        corners = pa.array([[{"x": float(x), "y": float(y)} for x, y in own]], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        return pa.table({group: pa.array([key[0].as_py()], own_type), "hull": corners, "width": [width(own)], "area": [area]})

    own = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select(group, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    parts = own.mapInArrow(thin, schema).repartition(group, "part").mapInArrow(thin, schema)
    return parts.select(group, "x", "y").groupBy(group).applyInArrow(whole, f"`{group}` {kind}, hull array<struct<x:double,y:double>>, width double, area double")
