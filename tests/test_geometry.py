import dataclasses
import datetime

import pytest
from pyspark.sql import functions as F

from landshift.functions import geometry
from landshift.plans import run as runs


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_cell_areas(spark):
    whole = _one(spark, geometry.cell_area_m2(F.lit(-90.0), F.lit(90.0), F.lit(360.0)))[0]
    assert whole == pytest.approx(510065621724088.0, rel=1e-9)  # the ellipsoid
    block = _one(spark, 25 * geometry.cell_area_m2(F.lit(0.8985), F.lit(0.8988), F.lit(0.0003)))[0]
    assert block == pytest.approx(27500, rel=0.2)


def test_projection(spark):
    at = _one(spark, geometry.utm_to_lon_lat(F.lit(500000.0), F.lit(0.0), F.lit(33), F.lit(True)), geometry.utm_to_lon_lat(F.lit(448251.795), F.lit(5411932.678), F.lit(31), F.lit(True)))
    assert (at[0].lon, at[0].lat) == (pytest.approx(15.0), pytest.approx(0.0, abs=1e-9))
    assert (at[1].lon, at[1].lat) == (pytest.approx(2.2945, abs=1e-5), pytest.approx(48.8582, abs=1e-5))
    side = [_one(spark, geometry.utm_to_lon_lat(F.lit(500000.0 + x), F.lit(9000000.0 + y), F.lit(57), F.lit(False)))[0] for x, y in ((0, 0), (150, 0), (150, 150), (0, 150), (0, 0))]
    area = _one(spark, geometry.polygon_area_m2(F.lit(str([[[p.lon, p.lat] for p in side]]))))[0]
    assert area == pytest.approx(22500, rel=0.05)


SQUARE = "[[[0,0],[2,0],[2,2],[0,2],[0,0]],[[0.5,0.5],[1,0.5],[1,1],[0.5,1],[0.5,0.5]]]"


def test_polygons(spark):
    rows = [(1.5, 1.5, SQUARE, True), (0.75, 0.75, SQUARE, False), (3.0, 1.0, SQUARE, False), (2.0, 1.0, SQUARE, True), (1.0, 1.0, None, False)]
    got = spark.createDataFrame(rows, "x double, y double, shape string, want boolean").select(geometry.point_in_polygon("x", "y", "shape").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    shapes = [(SQUARE, None), ("[]", "empty"), ("[[[0,0],[1,0],[1,1]]]", "ring not closed"), ("[[[0,0],[1,1],[1,0],[0,1],[0,0]]]", "crosses itself"), ("[[[0,0],[200,0],[1,1],[0,0]]]", "out of range"), ("{", "not coordinates"), (f"[{SQUARE}]", None)]
    df = spark.createDataFrame([(s,) for s, _ in shapes], "shape string").coalesce(1)
    assert [r[0] for r in df.select(geometry.polygon_problem("shape")).collect()] == [p for _, p in shapes]


def test_a_whole_run(spark):
    day = lambda n: datetime.datetime(2026, 1, 1) + datetime.timedelta(days=n)
    scenes, pixels = [], []
    for i in range(8):
        scenes.append((i, 1, "HLSL30" if i % 2 else "HLSS30", day(i * 5)))
        for r in range(12):
            for c in range(12):
                burnt = i >= 6 and 3 <= r < 7 and 3 <= c < 7
                cloud = 2 if i == 5 and r < 2 else 0
                pixels.append((i, r, c, 0.1, 0.2 if burnt else 0.6, 0.5 if burnt else 0.2, cloud))
    for i in range(3):
        scenes.append((90 + i, 1, "S1GRD", day(20 + i * 5)))
        pixels += [(90 + i, r, c, None, None, None, None, -14.0 if i == 2 and 3 <= r < 7 and 3 <= c < 7 else -9.0) for r in range(12) for c in range(12)]
    pixels = [x if len(x) == 8 else (*x, None) for x in pixels]
    listing = [(i, a, s, "ASCENDING" if s == "S1GRD" else None, t, f"s{i}") for i, a, s, t in scenes]
    df = spark.createDataFrame(listing, "id long, aoi_id long, sensor string, orbit_direction string, acquired_at timestamp, source_scene_id string")
    p = spark.createDataFrame(pixels, "observation_id long, row long, col long, red double, nir double, swir2 double, fmask int, vv double")
    given = runs.Inputs(df, df.where("id < 5 OR id = 90"), p, failed=df.where("id = 5").select(df.id.alias("observation_id")), features=spark.createDataFrame([(1, "road", 0, 0, 3, 9), (2, "mill", 50, 50, 60, 60)], "id long, kind string, x0 long, y0 long, x1 long, y1 long"))
    out = runs.run(given, day(25), day(60), F.lit(day(36)))
    got = out.summary.first().asDict()
    assert got == {
        "observations_discovered": 5, "observations_recorded": 5, "observations_skipped": 0, "index_rasters": 4, "index_rasters_reused": 0, "change_rasters": 4, "change_rasters_reused": 0, "radar_change_rasters": 2,
        "radar_change_rasters_reused": 0, "candidates": 2, "radar_candidates": 1, "events_created": 2, "event_observations": 3, "export_failures": 1, "events_resolved": 0, "confidence_assessments": 2, "context_relations": 4,
    }
    event = out.events.where("methodology_id = 1").first()
    assert (event.status, event.members, event.x0, event.x1, event.agreement, event.state, event.missing) == ("ongoing", 2, 3, 7, 1.0, "persistent", "")
    assert {r.area_m2 for r in out.candidates.collect()} == {14400.0}
    assert sorted(tuple(r) for r in out.markers.collect()) == [(6, 1), (7, 1), (91, 2), (92, 2)]
    again = runs.run(dataclasses.replace(given, known=df, stored=out.rasters.select("observation_id", "product"), history=out.assessments.select(F.col("event_id").alias("id"), "event_id", F.lit("v3").alias("rule_version"), "level", "score")), day(25), day(60), F.lit(day(36)))
    second = again.summary.first().asDict()
    assert (second["observations_recorded"], second["index_rasters_reused"], second["change_rasters_reused"], second["radar_change_rasters_reused"], second["confidence_assessments"]) == (0, 4, 4, 2, 0)
