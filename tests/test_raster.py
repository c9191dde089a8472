import numpy as np
import pytest
from pyspark.sql import functions as F

from landshift.operators import baseline, components, raster


@pytest.mark.parametrize("value,clear", [(0, True), (32, True), (64, True), (128, True), (2, False), (8, False), (16, False), (192, False), (34, False)])
def test_clear(spark, value, clear):
    assert spark.range(1).select(raster.clear(F.lit(value))).first()[0] is clear


def test_masked_pixels_have_no_index_and_zero_sums_neither(spark):
    df = spark.createDataFrame([("HLSL30", 2.0, 1.0, 1.0, 0), ("HLSL30", 2.0, 1.0, 1.0, 2), ("HLSL30", 0.0, 0.0, 1.0, 0), ("S1GRD", 2.0, 1.0, 1.0, 0)], "sensor string, B5 double, B7 double, B4 double, fmask int")
    rows = raster.indices(raster.masked(raster.named_bands(df.withColumns({"B8A": F.col("B5"), "B12": F.col("B7")})), raster.clear(F.col("fmask")), "red", "nir", "swir2")).select("nbr").collect()
    assert [r.nbr for r in rows] == [pytest.approx(1 / 3), None, None, None]


def test_nan_is_masked(spark):
    assert spark.range(1).select(raster.finite(F.lit(float("nan")))).first()[0] is None


def _grid(spark, grid):
    cells = [(0, r, c, float(grid[r][c])) for r in range(len(grid)) for c in range(len(grid[0])) if not np.isnan(grid[r][c])]
    return spark.createDataFrame(cells, "scene long, row long, col long, delta double")


def _patches(spark, grid, least=0.0, tile=4):
    return components.patch_table(raster.hits(_grid(spark, grid), "delta"), "delta", 900.0, least, tile).collect()


def test_one_block(spark):
    g = np.zeros((20, 20))
    g[5:10, 5:10] = -0.5
    (p,) = _patches(spark, g)
    assert (p.cells, p.delta_mean, p.delta_min, p.area_m2) == (25, -0.5, -0.5, 22500.0)


def test_least_area(spark):
    g = np.zeros((20, 20))
    g[1, 1] = -0.5
    g[8:14, 8:14] = -0.5
    assert [p.cells for p in _patches(spark, g, 4500.0)] == [36]


def test_corners_do_not_join_and_gaps_are_not_counted(spark):
    g = np.zeros((20, 20))
    g[2:5, 2:5] = g[5:8, 5:8] = -0.5
    assert sorted(p.cells for p in _patches(spark, g)) == [9, 9]
    g = np.full((20, 20), -0.5)
    g[:, 10:] = np.nan
    assert [p.cells for p in _patches(spark, g)] == [200]


@pytest.mark.parametrize("tile", [3, 7, 512])
def test_patches_as_by_flood_fill(spark, tile):
    rng = np.random.default_rng(tile)
    g = np.where(rng.random((30, 30)) < 0.55, -0.5, 0.0)
    seen, sizes = set(), []
    for at in zip(*np.nonzero(g < 0)):
        todo, n = [at], 0
        while todo:
            r, c = todo.pop()
            if (r, c) in seen or not (0 <= r < 30 and 0 <= c < 30) or g[r, c] >= 0:
                continue
            seen.add((r, c))
            n += 1
            todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
        if n:
            sizes.append(n)
    assert sorted(p.cells for p in _patches(spark, g, tile=tile)) == sorted(sizes)


def test_baseline_counts_scenes_and_leaves_equal_times_out(spark):
    scenes = spark.createDataFrame([(i, 1, f"2026-01-{d:02d}") for i, d in ((1, 1), (2, 2), (3, 2), (4, 3))], "id long, aoi_id long, at string").withColumn("acquired_at", F.to_timestamp("at"))
    got = {(r.scene_id, r.baseline_id) for r in baseline.trailing(scenes, 2).collect()}
    assert got == {(2, 1), (3, 1), (4, 3), (4, 2)}
    pixels = spark.createDataFrame([(1, 0, 0.5), (2, 0, None), (3, 0, 0.7), (4, 0, 0.2), (1, 1, 0.4), (4, 1, 0.1)], "observation_id long, pixel long, nbr double")
    rows = {(r.scene_id, r.pixel): r.delta_nbr for r in baseline.deltas(scenes, pixels, "nbr", n=2).collect()}
    assert rows[(4, 0)] == pytest.approx(0.2 - 0.7) and (4, 1) not in rows  # pixel 1 was last seen before the baseline


def test_valid_fraction_and_cover(spark):
    assert spark.range(1).select(raster.pixel_fraction(F.lit(25), F.lit(22500.0)), raster.pixel_fraction(F.lit(30), F.lit(22500.0)), raster.pixel_fraction(F.lit(None).cast("int"), F.lit(1.0)), raster.pixel_fraction(F.lit(3), F.lit(0.0))).first()[:] == (1.0, 1.0, None, None)
    with pytest.raises(ValueError):
        raster.forest("x")
