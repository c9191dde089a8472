"""Scenes with numbers of more than 23 bits: a 60-fold copy of the tables has nine million."""

import datetime

import pytest
from pyspark.sql import functions as F

from landshift.operators import components, tracking

SCENES = (5, (1 << 23) - 1, 1 << 23, (1 << 23) + 1, 54_000_000)


def _patches(spark, tile):
    shape = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 0), (5, 5), (6, 6), (6, 5)]  # two patches, cut by small tiles
    cells = spark.createDataFrame([(s, r, c) for s in SCENES for r, c in shape], "scene long, row long, col long")
    return components.patches(cells, tile)


@pytest.mark.parametrize("tile", [2, 512])
def test_patches_of_far_scenes(spark, tile):
    got = {}
    for r in _patches(spark, tile).collect():
        got.setdefault(r.patch, set()).add((r.scene, r.row, r.col))
    want = [{(s, r, c) for r, c in part} for s in SCENES for part in ([(0, 0), (0, 1), (1, 1), (2, 1), (2, 0)], [(5, 5), (6, 6), (6, 5)])]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert all(p == s << 40 | min((r, c) for _, r, c in v)[0] << 20 | min((r, c) for _, r, c in v)[1] for p, v in got.items() for s, _, _ in [min(v)] if s < 1 << 23)


def test_scenes_of_one_time_are_tracked_in_their_order(spark):
    marked = _patches(spark, 512)
    at = F.lit(datetime.datetime(2026, 1, 1)).cast("timestamp_ntz")
    one = F.lit(1).cast("long")
    candidates = marked.select(F.col("patch").alias("id"), one.alias("aoi_id"), one.alias("methodology_id"), F.col("scene").alias("change_raster_id"), at.alias("detected_at")).distinct()
    runs = marked.select(F.col("patch").alias("candidate_id"), "row", F.col("col").alias("c0"), (F.col("col") + 1).alias("c1"))
    got = tracking.tracked(candidates, runs, ("change_raster_id",)).collect()
    assert len(got) == 2 * len(SCENES) and {r.event_id for r in got} == {5 << 40, 5 << 40 | 5 << 20 | 5}


def test_rasters_too_large_for_a_far_scene_are_an_error(spark):
    big = spark.createDataFrame([(1 << 23, 0, 70_000)], "scene long, row long, col long")
    with pytest.raises(Exception, match="65,535 cells a side"):
        big.select(components.cell_id(F.col("scene"), F.col("row"), F.col("col"))).collect()
