"""Change against a baseline of trailing scenes.

The newest ``n`` earlier scenes of an area are chosen first, as scenes; pixels are reduced over them after.
Scenes of an area (and orbit) are numbered in time; a scene's baseline are the n numbers before the first scene
of its own instant, so the join is by number and gives n rows per scene, however many scenes an area has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASELINE = 5


def trailing(scenes: DataFrame, n: int = BASELINE, same: tuple[str, ...] = ("aoi_id",)) -> DataFrame:
    """(scene_id, baseline_id, place): the n newest scenes strictly before each; place 1 is the newest."""
    line = Window.partitionBy(*same).orderBy("acquired_at", "id")
    numbered = scenes.select("id", "acquired_at", *same, F.row_number().over(line).alias("number"))
    numbered = numbered.withColumn("before", F.min("number").over(Window.partitionBy(*same, "acquired_at")) - 1)
    wanted = numbered.select(F.col("id").alias("scene_id"), *same, "before", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("place"))
    wanted = wanted.select("scene_id", *same, (F.col("before") - F.col("place") + 1).alias("number"), F.col("place").cast("long").alias("place")).where("number > 0")
    prior = numbered.select(F.col("id").alias("baseline_id"), *same, "number")
    return wanted.join(prior, [*same, "number"]).select("scene_id", "baseline_id", "place")


def _middle(values: Column) -> Column:
    """The median of a few numbers, the mean of the middle two if they are even; null of none."""
    ordered, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(ordered, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def medians(pairs: DataFrame, pixels: DataFrame, *values: str) -> DataFrame:
    """Median of each value over the baseline scenes, per scene and pixel; masked pixels are left out."""
    rows = pairs.join(pixels, pairs.baseline_id == pixels.observation_id)
    listed = rows.groupBy("scene_id", "pixel").agg(*[F.collect_list(v).alias(v) for v in values])
    return listed.select("scene_id", "pixel", *[_middle(F.col(v)).alias(f"base_{v}") for v in values])


def deltas(scenes: DataFrame, pixels: DataFrame, *values: str, n: int = BASELINE, same: tuple[str, ...] = ("aoi_id",)) -> DataFrame:
    """(scene_id, pixel, delta_<value>…): current less baseline median; null where either is masked."""
    base = medians(trailing(scenes, n, same), pixels, *values)
    now = pixels.withColumnRenamed("observation_id", "scene_id")
    return now.join(base, ["scene_id", "pixel"]).select("scene_id", "pixel", *[(F.col(v) - F.col(f"base_{v}")).alias(f"delta_{v}") for v in values])


def rebuilt(rasters: DataFrame, sources: DataFrame, pixels: DataFrame, *values: str) -> DataFrame:
    """Deltas of ``rasters`` (id, observation_id) against the baseline that was recorded for each, not today's.

    sources: (change_raster_id, observation_id) as recorded, the raster's own scene among them. A raster without
    a recorded baseline has no rows.
    """
    own = rasters.select(F.col("id").alias("change_raster_id"), F.col("observation_id").alias("scene_id"))
    pairs = sources.join(own, "change_raster_id").where("observation_id != scene_id").select("scene_id", F.col("observation_id").alias("baseline_id"))
    now = pixels.withColumnRenamed("observation_id", "scene_id").join(own.select("scene_id"), "scene_id", "left_semi")
    return now.join(medians(pairs, pixels, *values), ["scene_id", "pixel"]).select("scene_id", "pixel", *[(F.col(v) - F.col(f"base_{v}")).alias(f"delta_{v}") for v in values])
