"""Runs that go on after they were cut off, and rasters that come back after they were pruned."""

import datetime

import pytest
from pyspark.sql import functions as F

from landshift.operators import reproduction
from landshift.plans import run as runs
from landshift.sources import exports, shared

DAY = lambda n: datetime.datetime(2026, 1, 1) + datetime.timedelta(days=n)


@pytest.fixture()
def given(spark, tmp_path):
    scenes = [(i, 1, "HLSL30", None, DAY(i * 5), f"s{i}") for i in range(8)] + [(90 + i, 1, "S1GRD", "ASCENDING", DAY(20 + i * 5), f"r{i}") for i in range(3)]
    pixels = []
    for i, *_ in scenes:
        for r in range(10):
            for c in range(10):
                burnt = 2 <= r < 6 and 3 <= c < 7
                pixels.append((i, r, c, 0.1, 0.2 if burnt and i >= 6 else 0.6, 0.5 if burnt and i >= 6 else 0.2, 0, None) if i < 90 else (i, r, c, None, None, None, None, -14.0 if burnt and i == 92 else -9.0))
    spark.createDataFrame(scenes, "id long, aoi_id long, sensor string, orbit_direction string, acquired_at timestamp, source_scene_id string").write.parquet(f"{tmp_path}/scenes")
    spark.createDataFrame(pixels, "observation_id long, row long, col long, red double, nir double, swir2 double, fmask int, vv double").write.parquet(f"{tmp_path}/pixels")
    df = spark.read.parquet(f"{tmp_path}/scenes")
    return runs.Inputs(df, df.where("id < 5"), spark.read.parquet(f"{tmp_path}/pixels"))


def _run(given, folder, p=runs.Parameters()):
    return runs.run(given, DAY(25), DAY(60), F.lit(DAY(36)), p, folder)


def _tables(out):
    return {name: sorted(map(str, df.collect())) for name, df in vars(out).items()}


def test_a_run_goes_on_where_it_was_cut_off(spark, given, tmp_path, monkeypatch):
    made = []
    resumed = shared.resumed
    monkeypatch.setattr(shared, "resumed", lambda make, path, session: resumed(lambda: made.append(path.rsplit("/", 1)[1]) or make(), path, session))
    folder, whole = str(tmp_path / "kept"), _tables(_run(given, str(tmp_path / "whole")))
    every, made[:] = list(made), []
    resolved = runs.tracking.resolved
    monkeypatch.setattr(runs.tracking, "resolved", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        _run(given, folder)
    before, made[:] = list(made), []
    assert "run-links" in before and "run-events" not in before
    monkeypatch.setattr(runs.tracking, "resolved", resolved)
    assert _tables(_run(given, folder)) == whole
    assert sorted(before + made) == sorted(every) and not set(before) & set(made)
    made[:] = []
    assert _tables(_run(given, folder)) == whole and made == []
    # Another parameter is another run, and so are other files.
    assert _tables(_run(given, folder, runs.Parameters(threshold=-2.0))) != whole and sorted(made) == sorted(every)
    made[:] = []
    given.pixels.limit(5).write.mode("append").parquet(f"{tmp_path}/pixels")
    spark.catalog.refreshByPath(f"{tmp_path}/pixels")
    given.pixels = spark.read.parquet(f"{tmp_path}/pixels")
    _run(given, folder)
    assert sorted(made) == sorted(every)


def test_a_stage_that_never_ended_is_made_again(spark, tmp_path):
    stages = shared.Stages(spark, str(tmp_path), {}, "p")
    spark.range(3).write.parquet(f"{stages.folder}/one")
    (tmp_path / stages.folder.rsplit("/", 1)[1] / "one" / "_SUCCESS").unlink()
    assert stages.table(spark.range(7), "one").count() == 7 and stages.table(lambda: 1 / 0, "one").count() == 7
    assert shared.Stages(spark, str(tmp_path), {}, "q").folder != stages.folder != shared.Stages(spark, str(tmp_path), {}, "p", "2").folder


def test_pruned_rasters_come_back_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "rasters")
    pixels = spark.createDataFrame([(i, k, None if (i, k) == (4, 2) else (i * 7 % 5 + k) / 3) for i in range(1, 9) for k in range(4)], "observation_id long, pixel long, nbr double")
    date = {3: "2026-01-03", 4: "2026-01-04", 5: "2026-01-05", 6: "2026-01-05", 7: "2026-01-07", 8: "2026-01-08"}
    rows = [(i, i, "1-a", "delta_nbr", d, f"p{i}", f"p{i}", 2 if i == 8 else 1) for i, d in date.items()]
    schema = "id long, observation_id long, aoi string, product string, date string, path string, derived_path string, lineage_id long"
    rasters = spark.createDataFrame(rows, schema)
    sources = spark.createDataFrame([(i, j) for i in date if i != 7 for j in (i, i - 1, i - 2)], "change_raster_id long, observation_id long")
    lineages = spark.createDataFrame([(1, "v1"), (2, "v0")], "id long, script string")
    again = lambda table=rasters, force=False: {r.id: (r.problem, r.written) for r in reproduction.reproduced(table, sources, lineages, pixels, "nbr", path, "v1", force).collect()}
    held = lambda: sorted(map(str, spark.read.schema("scene_id long, pixel long, delta_nbr double, aoi string, product string, date string").parquet(path).collect()))
    fine = (None, True)
    assert again() == {3: fine, 4: fine, 5: fine, 6: fine, 7: ("no recorded baseline", False), 8: ("another script version", False)}
    first = held()
    assert len(first) == 16
    assert len(exports.pruned(spark, path, "2026-01-05")) == 2 and len(held()) == 8
    assert again() == {3: fine, 4: fine, 7: ("no recorded baseline", False), 8: ("another script version", False)}
    assert held() == first
    # Nothing is gone that can be made: nothing is written. Forced, the other script's raster comes as well.
    assert set(again().values()) == {("no recorded baseline", False), ("another script version", False)} and held() == first
    assert again(force=True)[8] == fine and len(held()) == 20
    # A day comes back whole or not at all, and only to the path on record.
    exports.pruned(spark, path, "2026-01-06")
    moved = rasters.withColumn("derived_path", F.when(F.col("id") == 5, "elsewhere").otherwise(F.col("derived_path")))
    got = again(moved)
    assert got[5] == ("another path", False) and got[6] == ("another raster of its day cannot be made", False) and got[3] == fine
    assert {r.date for r in spark.read.parquet(path).select(F.col("date").cast("string").alias("date")).distinct().collect()} == {"2026-01-03", "2026-01-04", "2026-01-08"}
