"""Links between outlines that join what all pairs join, against brute force, and components that read their edges once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terralyn.functions import outlines
from terralyn.operators import blocks, graph, rings

SCHEMA = "id long, crp_lbl string, ring array<array<struct<x: double, y: double>>>"


def _fields(n: int, wide: float, seed: int = 3):
    """Concave fields with a second part, spread over a square; some without a species or an id."""
    rng = np.random.default_rng(seed)
    shape = [[(0, 0), (3, 0), (3, 3), (1.5, 0.5), (0, 3)], [(4, 0), (5, 0), (4.5, 1)]]
    rows = []
    for k, (x, y) in enumerate(rng.uniform(0, wide, (n, 2))):
        grow = rng.uniform(0.2, 0.7)
        ring = [[{"x": float(x + grow * a), "y": float(y + grow * b)} for a, b in part] for part in shape]
        rows.append((None if k % 41 == 40 else k, None if k % 23 == 22 else "abc"[k % 3], ring))
    return rows


@pytest.mark.parametrize("mixed", [False, True])
@pytest.mark.parametrize("wide", [15.0, 60.0])
def test_links_join_what_all_pairs_join(spark, monkeypatch, mixed, wide):
    monkeypatch.setattr(blocks, "CROWD", 50)
    df = spark.createDataFrame(_fields(400, wide), SCHEMA)
    pairs = rings.ring_pairs(df, df, 0.4, 4.0, ordered=True, mixed=mixed, keep=["id"])
    want = sorted(map(tuple, graph.components(pairs.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))).collect()))
    got = sorted(map(tuple, graph.components(rings.linked_rings(df, 0.4, 4.0, mixed)).collect()))
    assert got == want and len(want) > 100
    assert len({c for _, c in want}) > 10 or wide == 15.0


def test_a_crowd_is_joined_by_few_measures(monkeypatch):
    """2,000 fields on one spot: all 1,999,000 pairs were measured for their components."""
    measured = []
    real = outlines.within_reach
    monkeypatch.setattr(outlines, "within_reach", lambda a, b, first, second, reach: (measured.append(len(first)), real(a, b, first, second, reach))[1])
    rows = []
    for k, (x, y) in enumerate(np.random.default_rng(5).uniform(0, 2, (2000, 2))):
        sides = [c for p, q in (((0, 0), (4, 0)), ((4, 0), (4, 4)), ((4, 4), (0, 4)), ((0, 4), (0, 0))) for c in (x + p[0], y + p[1], q[0] - p[0], q[1] - p[1])]
        rows.append({"id": k, "crp_lbl": "ab"[k % 2], "_sides": list(map(float, sides)), "_minx": x, "_miny": y, "_maxx": x + 4, "_maxy": y + 4})
    links = rings._Links(pa.array(rows), pa.array(rows), 0.5, True)
    links.neighbours()
    links.rest(rings.LEADERS)
    links.rest()
    assert len(set(links.root.tolist())) == 1 and sum(measured) < 100_000


def test_components_evaluate_their_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 7), (3, 3), (8, 9), (None, 5), (6, None)], "src long, dst long").coalesce(1).mapInArrow(count, "src long, dst long")
    assert sorted(map(tuple, graph.components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 8), (9, 8)]
    assert seen.value == 7


def test_sides_on_one_line_far_apart_do_not_cross():
    """By rounding, sides on one line passed through each other: distance 0 for 342 of 24,673,871 pairs within metres that are farther apart, and for pairs in the plane."""
    from terralyn.plans.overlay_queries import DEGREES, HOLE, OUTLINE, PART

    def sides(k, scale):
        x, y, grow = (k * k * 31 + k * 17) % 1000 + k * 37 % 101 / 1009, (k * k * 13 + k * 101) % 997 + k * 53 % 103 / 1013, 1 + k % 3 / 4
        own = [[((x + grow * p) * scale, (y + grow * q) * scale) for p, q in ring] for ring in (OUTLINE, HOLE, PART)]
        return np.array([[(*p, q[0] - p[0], q[1] - p[1]) for ring in own for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]])

    at = np.zeros(1, int)
    for a, b, apart in ((5284, 244_450, 0.84824083), (70_089, 275_471, 1.4950446)):  # as by their SQL
        assert np.sqrt(outlines.squared_apart(sides(a, 1.0), sides(b, 1.0), at, at)) == pytest.approx(apart, abs=1e-8)
    assert outlines.squared_apart(sides(17_412, DEGREES), sides(125_150, DEGREES), at, at, 111_320 * 0.97, 110_540.0) > 90.0**2


def test_equal_rings_are_measured_once(spark, monkeypatch):
    """Each pair of fields was measured, 900 x 900 of 30 rings here, and came through Python row by row."""
    monkeypatch.setattr(rings, "ALIKE", 7)
    shapes = _fields(30, 6.0)
    df = spark.createDataFrame([(None if k % 50 == 49 else k, None if k % 31 == 30 else "abc"[k % 7 % 3], shapes[k % 30][2]) for k in range(900)], SCHEMA)
    want = rings.neighbour_rings(df, 0.7, 4.0, keep=["id", "crp_lbl"]).select("a_id", "b_id", "a_crp_lbl", "b_crp_lbl", F.round("distance", 6).alias("distance"))
    got = rings.neighbours_of_alike(df, 0.7, 4.0, 6).select(want.columns)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > 10_000
    top = got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert top.count("Generate explode") == 2
