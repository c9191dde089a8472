"""Pruned rasters made again from what was recorded, and written back where they belong.

Only partitions that are gone are written, and only those against whose making nothing stands: the script that made
them is the one at hand (or that is forced), their baseline is recorded, and the path that follows from the scene is the
one on record. A partition that is still there is never touched, so running this again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.operators.baseline import rebuilt
from landshift.operators.catalog import reproducible
from landshift.sources.exports import write_rasters
from landshift.sources.shared import folders, written

_PLACE = ("aoi", "product", "date")


def _present(rasters: DataFrame, path: str) -> DataFrame:
    """(aoi, product, date) of the partitions on disk; names of folders only."""
    spark = rasters.sparkSession
    found = [tuple(part.split("=", 1)[1] for part in f.rsplit("/", 3)[1:]) for f in folders(spark, f"{path}/aoi=*/product=*/date=*")]
    return spark.createDataFrame(found, "aoi string, product string, date string")


def reproduced(rasters: DataFrame, sources: DataFrame, lineages: DataFrame, pixels: DataFrame, value: str, path: str, script: str, force: bool = False) -> DataFrame:
    """Write the rasters that are gone and can be made again; (id, path, problem, written) of all that are gone.

    rasters: (id, observation_id, aoi, product, date, path, derived_path, lineage_id). sources: (change_raster_id,
    observation_id) as recorded, the own scene among them. lineages: (id, script). pixels: (observation_id, pixel, value) of
    the indices. Rows of a partition are the scene, pixel and delta."""
    place = rasters.select("id", "observation_id", *[F.col(c).cast("string").alias(c) for c in _PLACE])
    gone = place.join(_present(rasters, path), list(_PLACE), "left_anti")
    priors = sources.join(place.select(F.col("id").alias("change_raster_id"), F.col("observation_id").alias("own")), "change_raster_id").where("observation_id != own")
    told = reproducible(rasters, priors, lineages, script, force).join(gone.select("id"), "id", "left_semi")
    # A partition holds all scenes of its day: it comes back whole or not at all.
    barred = gone.join(told.where("problem IS NOT NULL").select("id"), "id", "left_semi").select(*_PLACE).distinct()
    fit = gone.join(barred, list(_PLACE), "left_anti")
    report = told.join(fit.select("id", F.lit(True).alias("fits")), "id", "left")
    late = F.when(F.col("problem").isNull() & F.col("fits").isNull(), "another raster of its day cannot be made")
    # What the report says is what was so before the partitions were written.
    report = written(report.select("id", "path", F.coalesce("problem", late).alias("problem"), F.col("fits").isNotNull().alias("written")), "reproduced")
    fit = written(fit, "reproducible")
    deltas = rebuilt(fit.select("id", "observation_id"), sources, pixels, value)
    rows = deltas.join(fit.select(F.col("observation_id").alias("scene_id"), *_PLACE), "scene_id")
    if not fit.isEmpty():
        write_rasters(rows.select("scene_id", "pixel", f"delta_{value}", *_PLACE), path)
    return report
