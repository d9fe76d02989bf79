"""The polygon loader and components of pixels: whole results and plain errors."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralyn.operators import components
from terralyn.sources import polygons

SQUARE = "POLYGON ((0 0, 1 0, 1 1, 0 0))"


def test_polygons_are_loaded_once_a_field(spark):
    rows = [("1", SQUARE, "first"), ("1", SQUARE, "second"), ("", SQUARE, "a"), ("", SQUARE, "b"), (None, SQUARE, "c"), ("2", "POINT (1 2)", "d"), ("3", None, "e"), ("4", '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}', "f")]
    got = polygons.load_polygons(spark.createDataFrame(rows, "NewID string, shape string, name string").coalesce(1))
    fields = got.fields.orderBy("pid").collect()
    assert [r.name for r in fields] == ["first", "a", "b", "c", "f"] and [r.pid for r in fields] == [0, 1, 2, 3, 4]
    assert got.skipped == 2 and got.attributes == ["NewID", "name"] and len(fields[4].rings) == 2


def test_polygon_errors_say_what_is_missing(spark):
    df = spark.createDataFrame([("x", SQUARE)], "name string, geom string")
    with pytest.raises(ValueError, match="returned no rows"):
        polygons.load_polygons(df.where("false"))
    with pytest.raises(ValueError, match="no row is left"):
        polygons.load_polygons(df, lambda d: d.where("name = 'y'"))
    with pytest.raises(ValueError, match="no geometry column"):
        polygons.load_polygons(df.select("name"))
    with pytest.raises(ValueError, match="none with a polygon"):
        polygons.load_polygons(spark.createDataFrame([("x", '{"type":"Point","coordinates":[1,2]}')], "name string, geom string"))


def pixels(spark, n=24, days=(0, 30, 60, 90), seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(3, len(days)))
    rows = [(k, ("interior", "edge_other", "edge_same")[k % 3], datetime.date(2024, 3, 1) + datetime.timedelta(days=d), float(rng.normal() * base[0][i] + 5 + base[1][i])) for k in range(n) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "pixel_id long, zone string, date date, value double")


def test_components_of_zones(spark):
    df = pixels(spark, 60)
    gaps = df.where("not (pixel_id = 3 and date > '2024-03-01') and not (pixel_id = 6 and date = '2024-03-31')")
    out = components.pixel_components(gaps, ["interior"], ["interior", "edge_other"])
    assert (out.fitted, out.placed, out.dropped, out.dates) == (19, 39, 1, 4) and out.filled == pytest.approx(1 / (39 * 4))
    assert {r.zone for r in out.scores.collect()} == {"interior", "edge_other"} and out.shares.count() == 3
    window = components.pixel_components(df, ["interior"], ["edge_same"], start=datetime.date(2024, 3, 15))
    assert window.dates == 3 and window.placed == 20


def test_components_say_what_a_fit_lacks(spark):
    df = pixels(spark, 24)
    with pytest.raises(ValueError, match="only 8 pixels in the fitted zones"):
        components.pixel_components(df, ["interior"], ["interior"])
    with pytest.raises(ValueError, match="no pixels in the placed zones"):
        components.pixel_components(df, ["interior", "edge_other"], ["edge_isolated"])
    with pytest.raises(ValueError, match="only 2 dates in the window"):
        components.pixel_components(df, ["interior", "edge_other"], ["edge_same"], end=datetime.date(2024, 4, 1))
    with pytest.raises(ValueError, match="only 1 fitted pixels span"):
        components.pixel_components(df.where("pixel_id % 3 = 2 or pixel_id = 0 or date < '2024-03-10'"), ["interior", "edge_other"], ["edge_same"])
