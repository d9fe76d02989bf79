"""Golden values and edge rules of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralyn.functions import curves, geometry, numeric, spectral
from terralyn.operators import cluster, graph, matrix, phenology, season_fit, relational, series, stats
from terralyn.sources import domain, geometry_text, sinks
from terralyn.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_weighted_median_averages_exact_halves(spark):
    rows = [(1, 60, 30.0), (1, 90, 30.0), (2, 60, 30.0), (2, 90, 31.0), (3, 5, 0.0), (3, 100, 7.0)]
    got = stats.weighted_median(spark.createDataFrame(rows, "g int, v int, w double"), ["g"], "v", "w")
    assert dict(map(tuple, got.collect())) == {1: 75.0, 2: 90.0, 3: 100.0}


def test_day_axis_crosses_years(spark):
    days = spark.sql("select explode(sequence(date'2020-01-01', date'2029-12-31')) d").select(curves.day_index(F.col("d"), F.lit(2020)).alias("k"))
    assert sorted(r.k for r in days.collect()) == list(range(1, 3654))


def test_index_of_missing_bands_is_null(spark):
    zero, x = spectral.band(F.lit(0.0)), F.lit(0.5)
    assert one(spark, spectral.index_value("ndvi", zero, x)) is None
    assert one(spark, spectral.index_value("evi", F.lit(0.2), x, blue=spectral.band(F.lit(0.0)))) == pytest.approx(0.3 / 0.7)
    with pytest.raises(ValueError):
        spectral.index_value("none", x, x)


def test_closed_forms(spark):
    assert numeric.probit(0.975) == pytest.approx(1.959964, abs=1e-6)
    got = [one(spark, numeric.smallest_plot_side(F.lit(r), F.lit(s), 0.9)) for r, s in ((1.6, 0.97), (2.0, 2.23), (3.0, 4.24), (10.0, 6.82))]
    assert got == pytest.approx([4.8, 9.3, 16.8, 32.2], abs=0.1)


def test_utm_of_known_points(spark):
    def utm(lng, lat):
        return one(spark, geometry.to_utm(F.lit(lng), F.lit(lat), geometry.utm_zone(F.lit(lng))))

    assert tuple(utm(3.0, 0.0)) == pytest.approx((500000.0, 0.0), abs=1e-3)
    east, north = utm(4.7, 50.6)
    assert 600_000 < east < 640_000 and 5_600_000 < north < 5_610_000
    a, b = utm(4.7, 50.6), utm(4.7, 50.601)
    assert math.hypot(b[0] - a[0], b[1] - a[1]) == pytest.approx(111.26 * 0.9998, abs=0.2)


def test_text_geometries(spark):
    texts = ["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "srid", "SRID=4326;MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}', "POLYGON ((a b, 1 1, 2 2, a b))", None, '{"type":"Point","coordinates":[1,2]}']
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, wkt string").select("k", F.size(geometry_text.rings(F.col("wkt"))).alias("n"))
    assert {r.k: r.n for r in got.collect()} == {0: 2, 1: None, 2: 1, 3: 1, 4: None, 5: None, 6: None} or {r.k: max(r.n or 0, 0) for r in got.collect()} == {0: 2, 1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}
    df = spark.createDataFrame([("x", texts[0], "POINT (1 1)")], "name string, Geom string, wkt string")
    assert geometry_text.geometry_column(df) == "Geom" and geometry_text.geometry_column(df.select("name")) is None


def test_geojson_and_kml_files(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"crop":"maize"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[0,0]}}]}')
    rows = geometry_text.read_geojson(spark, str(tmp_path / "a.geojson")).orderBy("pos").collect()
    assert rows[0].props == {"crop": "maize"} and len(rows[0].rings[0]) == 4 and rows[1].rings is None and rows[1].type == "Point"
    (tmp_path / "a.kml").write_text("<kml><Document><Placemark><name>p1</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,0 1,0,0 1,1,0 0,0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark><Placemark><name>p2</name></Placemark></Document></kml>")
    rows = {r.name: r.rings for r in geometry_text.read_kml(spark, str(tmp_path / "a.kml")).collect()}
    assert len(rows["p1"][0]) == 4 and rows["p2"] is None
    box = lambda a, b: f"<LinearRing><coordinates>{a},{a} {b},{a} {b},{b} {a},{a}</coordinates></LinearRing>"
    polygon = lambda a: f"<Polygon><outerBoundaryIs>{box(a, a + 9)}</outerBoundaryIs><innerBoundaryIs>{box(a + 1, a + 2)}</innerBoundaryIs></Polygon>"
    (tmp_path / "b.kml").write_text(f"<kml><Placemark><name>m</name><ExtendedData><Data name='crop'><value>maize</value></Data></ExtendedData><MultiGeometry>{polygon(0)}{polygon(20)}</MultiGeometry></Placemark></kml>")
    row = geometry_text.read_kml(spark, str(tmp_path / "b.kml")).first()
    assert [r[0].x for r in row.rings] == [0, 1, 20, 21] and row.props == {"crop": "maize"}


def test_graph_and_calendar_files(spark, tmp_path):
    fields = spark.createDataFrame([(10, "maize"), (20, "wheat"), (30, "maize"), (40, "beet")], "id long, crp_lbl string")
    edges = spark.createDataFrame([(10, 20), (20, 30)], "src long, dst long")
    domain.write_species_graph(fields, edges, 0.001, str(tmp_path / "graph"))
    got, pairs = domain.read_species_graph(spark, str(tmp_path / "graph"))
    assert {(r.id, r.crp_lbl) for r in got.collect()} == {(0, "maize"), (1, "wheat"), (2, "maize")} and {tuple(r) for r in pairs.collect()} == {(0, 1), (1, 2)}
    (tmp_path / "calendar.json").write_text('{"Froment d\u2019hiver": {"regime": "annual", "greenStart": "10-15", "greenEnd": "07-20"}, "Prairie": {"greenStart": "none", "greenEnd": "none"}}')
    rows = {r.calendar_key: (r.regime, r.green_start, r.peak_start) for r in domain.read_calendars(spark, str(tmp_path / "calendar.json")).collect()}
    assert rows == {"froment dhiver": ("annual", "10-15", None), "prairie": (None, "none", None)}


def test_requests_that_cannot_be_answered():
    relational.check_request(["a", "b"], 0.5, 10, ["1", "-2"])
    for bad in ((["a", "a"], 1, 1), (["a", "b"], 0, 1), (["a", "b"], float("nan"), 1), (["a", "b"], 1, 0), (["a", "b"], 1, 1.5), (["a", "b"], 1, 1, ["1; drop"])):
        with pytest.raises(ValueError):
            relational.check_request(*bad)


def test_covariance_keeps_the_digits_of_small_variances(spark):
    rows = spark.createDataFrame([(k, [1e9 + k % 7, -1e9 + k % 5]) for k in range(700)], "id long, v array<double>")
    _, cov = matrix.covariance(rows)
    x = np.array([[k % 7, k % 5] for k in range(700)], float)
    assert np.allclose(cov, np.cov(x.T), atol=1e-6)


def test_noise_axes_put_signal_first(spark):
    rng = np.random.default_rng(4)
    signal = rng.normal(size=(500, 1)) @ np.array([[1.0, 2.0, -1.0]])
    x = signal + rng.normal(size=(500, 3)) * np.array([0.1, 5.0, 0.1])
    frame = lambda a: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(a)], "id long, v array<double>")
    noise = rng.normal(size=(500, 3)) * np.array([0.1, 5.0, 0.1]) * np.sqrt(2)
    mean, axes = matrix.noise_fraction_axes(frame(x), frame(noise), 1)
    assert abs(np.corrcoef((x - mean) @ axes[0], signal[:, 0])[0, 1]) > 0.99


def test_kmeans_keeps_the_best_restart(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.4, (30, 2)) for c in ((0, 0), (5, 0), (0, 5), (9, 9))])
    got = cluster.kmeans(spark.createDataFrame([("s", k, v.tolist()) for k, v in enumerate(x)], "g string, id long, v array<double>"), "g", 4)
    label = np.array([r.cluster for r in sorted(got.collect(), key=lambda r: r.id)])
    assert all(len(set(label[k : k + 30])) == 1 for k in range(0, 120, 30)) and len(set(label)) == 4


def test_grid_north_and_projected_boxes(spark):
    assert one(spark, geometry.grid_convergence(F.lit(3.0), F.lit(50.0))) == pytest.approx(0, abs=1e-6)
    # one degree east of a zone's middle, grid north lies clockwise by about sin(latitude) degrees
    assert one(spark, geometry.grid_convergence(F.lit(4.0), F.lit(50.0))) == pytest.approx(math.degrees(math.atan(math.tan(math.radians(1)) * math.sin(math.radians(50)))), abs=3e-3)
    box = one(spark, geometry.utm_envelope(F.lit(2.9), F.lit(50.0), F.lit(3.1), F.lit(50.1)))
    assert box.minx == pytest.approx(1_000_000 - box.maxx, abs=1e-3) and 11_000 < box.maxy - box.miny < 11_200


def test_curve_fit_recovers_its_own_equation():
    t = np.arange(5, 366, 10.0)
    for name in ("maize", "soybean", "default"):
        p = np.array(curves.PRESETS[name])
        fit = season_fit.fit_curve(t, season_fit.season_curve(t, p), (p[2] - 40, p[5], p[4] + 40))
        assert fit["r2"] > 0.995 and not fit["poor_fit"] and fit["sos"] < p[2] < p[4] < fit["eos"] and fit["confidence"] == "high"
        half = season_fit.season_curve(np.array([fit["sos"], fit["eos"]]), np.array([fit[k] for k in season_fit.PARAMETERS]))
        top = season_fit.season_curve(np.arange(0, 366, 0.25), np.array([fit[k] for k in season_fit.PARAMETERS])).max()
        assert np.allclose(half, season_fit.FOOT * top, atol=1e-3)
    assert season_fit.fit_curve(t[:5], t[:5])["poor_fit"] and season_fit.fit_curve(t, np.full(len(t), 0.3))["poor_fit"]


def test_curve_slopes_equal_finite_differences():
    t, rng = np.arange(0, 366, 5.0), np.random.default_rng(8)
    low, high = np.array([0.2, 0.03, 20, 0.03, 40, 0.1]), np.array([0.8, 0.4, 200, 1.2, 150, 0.9])
    box = low + (high - low) * rng.random((20, 6))
    value, slope = season_fit.season_curves(t, season_fit._named(box), True)
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-6
        near = [season_fit.season_curves(t, season_fit._named(box + s * step)) for s in (1, -1)]
        free = (value > 1e-3) & (value < 0.99)
        assert np.allclose(((near[0] - near[1]) / 2e-6)[free], slope[..., k][free], atol=1e-5)


def test_curve_search_of_noisy_data_is_no_worse_than_the_truth():
    rng = np.random.default_rng(2)
    for seed in range(12):
        t = np.sort(rng.choice(np.arange(0, 366, 5.0), 25, replace=False))
        p = np.array([0.8, 0.05 + 0.02 * (seed % 5), 120, 0.05 + 0.1 * (seed % 4), 230 + seed, 180.0])
        y = season_fit.season_curve(t, p) + rng.normal(0, 0.03, len(t))
        fit = season_fit.fit_curve(t, y)
        assert fit["rmse"] <= np.sqrt(((season_fit.season_curve(t, p) - y) ** 2).mean()) + 1e-9


def test_season_columns_equal_arrays(spark):
    t = np.arange(-100.0, 500, 7)
    for p in curves.PRESETS.values():
        got = spark.createDataFrame([(float(x),) for x in t], "t double").orderBy("t").select(curves.double_logistic(F.col("t"), *p).alias("v"))
        assert np.allclose([r.v for r in got.collect()], season_fit.season_curve(t, np.array(p)))


#: The days and values of a summer crop, a spring crop and one that is cut several times.
DAYS = [55, 65, 90, 115, 150, 165, 200, 250, 355]
SUMMER = [0.20, 0.20, 0.21, 0.22, 0.18, 0.24, 0.72, 0.76, 0.31]
SPRING = [0.30, 0.35, 0.55, 0.75, 0.88, 0.85, 0.45, 0.20, 0.16]
CUT = [0.30, 0.35, 0.55, 0.70, 0.50, 0.72, 0.55, 0.68, 0.30]


def test_windows_and_fits_of_known_curves(spark):
    rows = [(name, 0, 10, d, v) for name, values in (("summer", SUMMER), ("spring", SPRING), ("cut", CUT), ("flat", [0.3] * 9)) for d, v in zip(DAYS, values, strict=True)]
    own = spark.createDataFrame(rows, "species string, cluster long, size long, day int, value double")
    windows = {r.species: (r.start_day, r.peak_day, r.end_day) for r in phenology.season_windows(own).collect()}
    assert windows["summer"] == (165, 250, 355) and windows["spring"] == (55, 150, 250) and windows["cut"] == (55, 165, 355)
    fits = {r.species: r for r in phenology.growing_seasons(own).collect()}
    assert set(fits) == {"summer", "spring", "cut"} and fits["cut"].poor_fit and not fits["cut"].moved and fits["spring"].r2 > 0.9
    periods = spark.createDataFrame([("spring", 0, 60, 300), ("summer", 0, 160, 260)], "species string, cluster long, start int, end int")
    got = {r.species: r for r in phenology.fit_periods(own, periods).collect()}
    assert got["summer"].note == "3 of 6 images needed" and got["summer"].dof == -3 and got["spring"].n == 7 and got["spring"].dof == 1 and got["spring"].confidence == "low"
    assert got["spring"].up_gap is None or got["spring"].up_gap >= 15


def test_pca_recovers_a_plane_and_ica_separates(spark):
    rng = np.random.default_rng(0)
    source = rng.uniform(-1, 1, (600, 2))
    x = source @ np.array([[2.0, 1.0, 0.5, 0.0], [0.3, -1.0, 0.2, 1.0]])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    scores, shares = matrix.pca(rows, rows, 3)
    assert shares.orderBy("component").collect()[1].cumulative == pytest.approx(1.0)
    assert scores.agg(F.avg(F.col("scores")[0])).first()[0] == pytest.approx(0, abs=1e-9)
    mean, axes = matrix.independent_axes(rows, 2, rounds=60)
    mixed = np.abs(np.corrcoef(((x - mean) @ axes.T).T, source.T)[:2, 2:])
    assert mixed.max(axis=1).min() > 0.98


def test_kmeans_finds_far_groups(spark):
    rng = np.random.default_rng(1)
    rows = [("s", k, (np.array([10.0 * (k % 3 > 0), 10.0 * (k % 3 > 1)]) + rng.normal(0, 0.3, 2)).tolist()) for k in range(90)]
    got = {r.id: r.cluster for r in cluster.kmeans(spark.createDataFrame(rows, "g string, id long, v array<double>"), "g", 3, rounds=5).collect()}
    assert len({(k % 3, c) for k, c in got.items()}) == 3


def test_numbering_and_samples(spark):
    rows = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert sorted((r.k, r.pid) for r in relational.numbered(rows, "k").collect()) == [(k, k) for k in range(1000)]
    assert sorted(r.k for r in relational.evenly_spaced(rows, "k", 1).collect()) == [0]
    assert sorted(r.k for r in relational.evenly_indexed(rows, "k", 3).collect()) == [0, 333, 666]


def test_sparse_date_keeps_its_support(spark):
    rows = [("a", f"2021-01-{d:02d}", 0.5 if k == 0 else 0.6) for d in (1, 2) for k in range(2)] + [("b", "2021-01-03", 0.1)]
    own = spark.createDataFrame(rows, "g string, date string, value double")
    got = {(r.g, r.date): (r["mean"], r.support) for r in series.centroids(own, "g").collect()}
    assert got["a", "2021-01-01"] == (pytest.approx(0.55), 2) and got["a", "2021-01-03"] == (None, 0)


def test_scripts_and_sinks(spark, tmp_path):
    assert relational.run_script(spark, "select 1 as a; select 'x;y' as b").first()["b"] == "x;y"
    with pytest.raises(ValueError):
        relational.run_script(spark, " ; ")
    sinks.write_csv(spark.createDataFrame([("a", 1 / 3)], "g string, v double"), str(tmp_path / "c"), {"v": 4})
    assert "g,v\na,0.3333\n" in {part.read_text() for part in (tmp_path / "c").glob("part-*")}


def test_stream_of_daily_means(spark, sf, tmp_path):
    source = tmp_path / "events"
    spark.read.parquet(f"{sf}/events.parquet").repartition(2).write.parquet(str(source))
    out = windows.daily_means(windows.event_stream(spark, str(source)))
    query = out.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    assert query.awaitTermination(120)
    assert spark.table("daily").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_spatial_joins_are_equi_joins(spark, sf):
    from terralyn.plans.field_queries import neighbour_pairs

    plan = neighbour_pairs(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_components_of_chains_stars_and_loops(spark, monkeypatch):
    import random

    order = list(range(1000))
    random.Random(2).shuffle(order)
    edges = list(zip(order, order[1:], strict=False)) + [(5000, 5000 + k) for k in range(1, 400)] + [(9000, 9000), (7001, 7000), (7000, 7001)]
    want = {**dict.fromkeys(range(1000), 0), **dict.fromkeys(range(5000, 5400), 5000), 9000: 9000, 7000: 7000, 7001: 7000}
    for chunk in (graph.CHUNK, 7):
        monkeypatch.setattr(graph, "CHUNK", chunk)
        rows = graph.components(spark.createDataFrame(edges, "src long, dst long").repartition(5)).collect()
        assert len(rows) == len(want) and {r.id: r.component for r in rows} == want
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_spans_and_additions(spark):
    fields = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a"), (5, "d")], "id long, crp_lbl string")
    edges = spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long")
    spans = lambda *names: graph.spans(fields, edges, list(names)).first()["spans"]
    assert spans("a", "b") and spans("a", "c") and not spans("a", "b", "c") and not spans("b", "c")
    assert spans("a") and spans() and spans("b", "unknown") and spans("b", "d")  # d has no edges
    assert {r.crp_lbl for r in graph.valid_additions(fields, edges, ["a"]).collect()} == {"b", "c"}


def test_any_number_of_targets_and_calendars(spark):
    """Beyond the sizes at which rows were once dropped."""
    curves = spark.createDataFrame([(1, 0, 0.0), (1, 20_000, 20_000.0)], "field_key int, k int, value double").select("field_key", F.date_add(F.lit("1980-01-01"), F.col("k")).alias("date"), "value")
    targets = spark.range(12_000).select(F.date_add(F.lit("1980-01-01"), F.col("id").cast("int")).alias("target"))
    got = series.value_at(curves, targets).agg(F.count("*"), F.sum("value")).first()
    assert got[0] == 12_000 and got[1] == pytest.approx(12_000 * 11_999 / 2)
    calendar = spark.range(100_500).select(F.format_string("crop %06d", "id").alias("calendar_key"), F.lit("04-01").alias("green_start"), F.lit("09-30").alias("green_end"))
    windows = calendar.select(F.col("calendar_key").alias("crop_key"), F.lit("2021-10-15").cast("date").alias("start"), F.lit("2021-12-15").cast("date").alias("end"))
    assert phenology.matches_calendar(windows, calendar).where("fits").count() == 0
