"""Imported layers, label texts, signatures, grids and chart rows on odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralyn.functions import labels
from terralyn.operators import layers, phenology, season_fit

FEATURES = "id long, kind string, polygons array<array<array<struct<x: double, y: double>>>>"


def texts(spark, column, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v string").select("k", column(F.col("v")).alias("o")).orderBy("k")
    return [r.o for r in rows.collect()]


def test_number_texts_are_exact(spark):
    given = ["1.000000", "-0.50", "123456789012345678", "  007 ", "***", "", "+3.", ".5", "-0", "0.30000000000000004", "12345678901234567.0", "1e3", "abc", "-.0", "1.2.3", "NaN"]
    assert texts(spark, labels.tidy_number, given) == ["1", "-0.5", "123456789012345678", "7", "", "", "3", "0.5", "0", "0.3", "12345678901234567", "1000", "abc", "0", "1.2.3", "NaN"]


def test_variety_labels(spark):
    given = ["", "http://Species_name/NAME/BREEDER", "https://a.example/x/1012345-sy-example", "https://a.example/x/SY-Example.html", "https://a.example", "plain__text  here", "https://a.example/kws%20big_one/", "http://ns", "https://a.example/42", "https://a.example/a%zz", "https://a.example/one+two"]
    assert texts(spark, labels.variety_label, given) == ["(no variety)", "NAME", "SY Example", "SY-Example", "a.example", "plain text here", "KWS Big One", "ns", "42", "A%zz", "One+two"]


def test_folded_accents_and_word_ranks(spark):
    assert texts(spark, labels.folded, ["Variété ÀÇŠž", "ét́", "plain"]) == ["variete acsz", "et", "plain"]
    assert texts(spark, lambda c: labels.word_rank(c, ["nom", "variete"]), ["Ma Variété", "le_nom variété", "other"]) == [1, 0, None]


def test_signatures_tell_every_bit_and_every_order(spark):
    def sign(rows, parts):
        df = spark.createDataFrame(rows, "plan string, at long, x double, s string").repartition(parts)
        out = layers.plan_signatures(df, "plan", "at", F.array(labels.number_token(F.col("x")), labels.text_token(F.col("s"))))
        return {r.plan: r.signature for r in out.collect()}

    rng = random.Random(3)
    plan = [("p", k, rng.random(), "ab"[: k % 3]) for k in range(9000)]
    first = sign(plan, 1)
    shuffled = rng.sample(plan, len(plan))
    assert sign(shuffled, 7) == first and len(first["p"]) == 32
    changes = [(5, "x", float(np.nextafter(plan[5][2], 2))), (5, "x", -plan[5][2]), (5, "s", "b"), (8999, "x", None)]
    got = {sign([(p, k, (value if k == at and name == "x" else x), (value if k == at and name == "s" else s)) for p, k, x, s in plan], 3)["p"] for at, name, value in changes}
    swapped = [(p, {3: 4, 4: 3}.get(k, k), x, s) for p, k, x, s in plan]
    assert len(got | {first["p"], sign(swapped, 2)["p"]}) == 6
    zero = sign([("a", 0, 0.0, ""), ("b", 0, -0.0, ""), ("c", 0, None, ""), ("d", 0, 0.0, None)], 2)
    assert len(set(zero.values())) == 4


def square(x, y, s):
    return [{"x": x, "y": y}, {"x": x + s, "y": y}, {"x": x + s, "y": y + s}, {"x": x, "y": y + s}]


def test_layers_are_checked(spark):
    flat = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 0.0}]
    rows = [(1, None, None), (2, "Point", None), (3, "Polygon", [[square(0.0, float("inf"), 1.0)]]), (4, "Polygon", [[flat, square(0.0, 0.0, 1.0)]]), (5, "MultiPolygon", []), (6, "Polygon", [[square(3.0, 50.0, 0.001), flat]]), (7, "MultiPolygon", [[square(3.0, 50.1, 0.002)], [square(3.1, 50.0, 0.001)], [flat]]), (8, "Polygon", None)]
    df = spark.createDataFrame(rows, FEATURES)
    got = {r.id: r for r in layers.statuses(df).collect()}
    assert [got[k].status for k in range(1, 9)] == ["none", "other", "invalid", "empty", "empty", "ok", "ok", "empty"]
    assert [got[k].dropped for k in (3, 4, 5, 6, 7)] == [0, 2, 1, 1, 1] and [len(got[k].rings) for k in (6, 7)] == [1, 2]
    facts = layers.layer_facts(layers.statuses(df)).first()
    assert facts.unit == "degrees" and facts.median == pytest.approx(0.002 * 2**0.5) and facts.ok == 2
    plots, warnings = layers.checked_layer(df)
    assert plots.columns == ["id", "rings"] and plots.count() == 2 and "1 not a polygon" in warnings
    with pytest.raises(ValueError, match="2 plots; at most 1"):
        layers.checked_layer(df, 1)
    with pytest.raises(ValueError, match="no usable plot polygons .*1 without geometry"):
        layers.checked_layer(df.where("id = 1"))
    metres = spark.createDataFrame([(1, "Polygon", [[square(500_000.0, 5_000_000.0, 12.0)]])], FEATURES)
    assert layers.layer_facts(layers.statuses(metres)).first().unit == "metres"
    assert layers.layer_facts(layers.statuses(df.where("false"))).first().unit is None


def test_grids_fall_back_to_the_preview(spark):
    grids = spark.createDataFrame([("d1", "a", False, 0, 0, 10, 10), ("d1", "b", False, 10, 0, 20, 10), ("d1", "p", True, 0, 0, 1, 1), ("d2", "q", True, 0, 0, 1, 1), ("d3", "c", False, 0, 0, 5, 5)], "layer string, grid string, preview boolean, minx int, miny int, maxx int, maxy int")
    boxes = spark.createDataFrame([(1, 9, 9, 12, 12), (2, 50, 50, 60, 60), (3, 20, 10, 21, 11)], "id int, minx int, miny int, maxx int, maxy int")
    got = sorted((r.id, r.layer, r.grid) for r in layers.grids_for(boxes, grids, 4.0).collect())
    assert got == [(1, "d1", "a"), (1, "d1", "b"), (1, "d2", "q"), (2, "d1", "p"), (2, "d2", "q"), (3, "d1", "b"), (3, "d2", "q")]
    plan = layers.grids_for(boxes, grids, 4.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_chart_rows_draw_accepted_fits_over_their_data(spark):
    p = np.array([0.8, 0.12, 150.0, 0.10, 270.0, 215.0])
    days = np.arange(5, 366, 10)
    good = [("s", 0, int(d), float(0.1 + v)) for d, v in zip(days, season_fit.season_curve(days, p), strict=True)]
    rng = np.random.default_rng(1)
    bad = [("s", 1, int(d), float(rng.random())) for d in days]
    curves = spark.createDataFrame(good + bad, "species string, cluster long, day long, value double")
    periods = spark.createDataFrame([("s", 0, 65, 345), ("s", 1, 65, 345)], "species string, cluster long, start long, end long")
    fits = phenology.fit_periods(curves, periods)
    axis = spark.range(1, 366).select(F.col("id").alias("day"))
    got = phenology.fitted_rows(axis, curves, periods, fits).collect()
    assert len(got) == 2 * 365 and sum(r.observed is not None for r in got) == 2 * len(days)
    own = {r.day: r for r in got if r.cluster == 0}
    assert all((own[d].fitted is not None) == (65 <= d <= 345) for d in own)
    assert max(abs(own[d].fitted - own[d].observed) for d in range(165, 256, 10)) < 0.05
    assert all(r.fitted is None for r in got if r.cluster == 1)
