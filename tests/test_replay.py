"""Late and withdrawn acquisitions: replays equal full runs, and failures leave what was there."""

import datetime

import pytest
from pyspark.sql import functions as F

from terralyn.operators import replay
from terralyn.streaming import windows

SCENES = "pixel_id long, field_key long, species string, zone string, date date, value double"


def scenes(spark, days, shift=0.0):
    rows = [(f * 10 + p, f, "ab"[f % 2], "interior" if p else "edge", datetime.date(2024, 1, 1) + datetime.timedelta(days=d), float((f % 4) * 10 + d % 3 + p / 10 + shift)) for f in range(16) for p in range(3) for d in days]
    return spark.createDataFrame(rows, SCENES)


def series(spark, folder):
    first = spark.createDataFrame([("a", 0, 10, 90), ("b", 1, 20, 80), ("b", 7, 1, 2)], "species string, cluster int, start int, end int")
    return replay.Replay(spark, str(folder), "scenes", "date", replay.series_stages(2, first))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_late_date_equals_a_full_run_and_marks_follow(spark, tmp_path):
    own, full = series(spark, tmp_path / "own"), series(spark, tmp_path / "full")
    assert own.replay(scenes(spark, [0, 10, 30])) == 1
    before = {r.field_key: r.cluster for r in own.tables()["clusters"].collect()}
    assert own.replay(scenes(spark, [20])) == 2
    full.replay(scenes(spark, [0, 10, 20, 30]))
    for name in ("means", "clusters"):
        assert rows(own.tables()[name]) == rows(full.tables()[name])
    after = {r.field_key: r.cluster for r in own.tables()["clusters"].collect()}
    kept = {(r.species, r.cluster) for r in own.tables()["marks"].collect()}
    assert kept == {(s, after[min(f for f, c in before.items() if c == k and "ab"[f % 2] == s)]) for s, k in (("a", 0), ("b", 1))}


def test_withdrawn_and_corrected_dates(spark, tmp_path):
    own, full = series(spark, tmp_path / "own"), series(spark, tmp_path / "full")
    own.replay(scenes(spark, [0, 10, 20]))
    own.replay(added=scenes(spark, [10], shift=0.5), withdrawn=spark.createDataFrame([(datetime.date(2024, 1, 21),)], "date date"))
    full.replay(scenes(spark, [0]).unionByName(scenes(spark, [10], shift=0.5)))
    assert rows(own.tables()["means"]) == rows(full.tables()["means"])
    assert own.replay() == 2 and own.replay(scenes(spark, [])) == 2


def test_a_failing_stage_leaves_the_old_tables(spark, tmp_path):
    own = series(spark, tmp_path)
    own.replay(scenes(spark, [0, 10]))
    before = {n: rows(t) for n, t in own.tables().items()}

    def fails(tables, old):
        return tables["clusters"].withColumn("cluster", F.raise_error(F.lit("no clusters today")).cast("int"))

    broken = replay.Replay(spark, str(tmp_path), "scenes", "date", own.stages | {"marks": replay.Stage(("clusters",), fails)})
    with pytest.raises(Exception, match="no clusters today"):
        broken.replay(scenes(spark, [20]))
    assert {n: rows(t) for n, t in own.tables().items()} == before and len(own.log()) == 1
    assert own.replay(scenes(spark, [20])) == 2


def test_tables_that_do_not_depend_on_a_change_stay(spark, tmp_path):
    stages = {"means": replay.Stage(("scenes",), replay.means), "fixed": replay.Stage((), lambda new, old: spark.range(3))}
    own = replay.Replay(spark, str(tmp_path), "scenes", "date", stages)
    own.replay(scenes(spark, [0]))
    own.replay(scenes(spark, [10]))
    first, second = own.log()
    assert first.tables["fixed"] == second.tables["fixed"] and first.tables["means"] != second.tables["means"]
    with pytest.raises(ValueError, match="no table named other"):
        replay.Replay(spark, str(tmp_path), "scenes", "date", {"x": replay.Stage(("other",), replay.means)})


def test_a_stale_replay_is_refused(spark, tmp_path):
    own = series(spark, tmp_path)
    own.replay(scenes(spark, [0, 10]))

    def meanwhile(tables, old):
        series(spark, tmp_path).replay(scenes(spark, [20]))
        return replay.means(tables, old)

    slow = replay.Replay(spark, str(tmp_path), "scenes", "date", {"means": replay.Stage(("scenes",), meanwhile)})
    with pytest.raises(replay.StaleReplay):
        slow.replay(scenes(spark, [30]))
    assert len(own.log()) == 2


def test_a_stream_of_acquisitions_is_replayed_once(spark, tmp_path):
    folder, own = str(tmp_path / "in"), series(spark, tmp_path / "own")
    scenes(spark, [0, 10]).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(SCENES).parquet(folder)
    windows.follow(stream(), own, str(tmp_path / "check")).awaitTermination()
    scenes(spark, [5]).coalesce(1).write.mode("append").parquet(folder)
    windows.follow(stream(), own, str(tmp_path / "check")).awaitTermination()
    assert len(own.log()) == 2 and own.replay(scenes(spark, [99]), batch=1) == 2
    assert own.tables()["means"].select("date").distinct().count() == 3
