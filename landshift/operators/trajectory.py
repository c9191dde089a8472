"""What the index did around an event: a series per date, its reference, and a classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the rule.
COVERAGE, RECOVERED, PERSISTENT, RECENT = 0.3, 0.8, 0.3, 3


def footprint_samples(events: DataFrame, observations: DataFrame, pixels: DataFrame, cells: DataFrame, value: str = "nbr") -> DataFrame:
    """(event_id, date, mean, valid, total) per event and day: an area's scenes of a day are summed pixel by pixel before
    they meet the footprints' cells, so what is joined grows with days and pixels, not with looks times events."""
    looks = observations.select(F.col("id").alias("observation_id"), F.col("aoi_id").alias("o_aoi"), F.date_format("acquired_at", "yyyy-MM-dd").alias("date"))
    days = pixels.join(looks, "observation_id").groupBy("o_aoi", "date", "pixel").agg(F.sum(value).alias("weighted"), F.count(value).alias("valid"), F.count("*").alias("total"))
    area = events.select(F.col("id").alias("event_id"), "aoi_id").join(cells, "event_id")
    rows = days.join(area, (F.col("aoi_id") == F.col("o_aoi")) & (days.pixel == area.cell))
    summed = rows.groupBy("event_id", "date").agg(F.sum("weighted").alias("weighted"), F.sum("valid").alias("valid"), F.sum("total").alias("total"))
    return summed.select("event_id", "date", F.try_divide("weighted", "valid").alias("mean"), "valid", "total")


def series(samples: DataFrame) -> DataFrame:
    """(event_id, date, mean, fraction): scenes of a day weighted by their pixels; poorly covered days go."""
    days = samples.groupBy("event_id", "date").agg(F.sum(F.col("mean") * F.col("valid")).alias("weighted"), F.sum("valid").alias("valid"), F.sum("total").alias("total"))
    days = days.where((F.col("total") > 0) & (F.col("valid") / F.col("total") >= COVERAGE))
    out = days.select("event_id", "date", (F.col("weighted") / F.col("valid")).alias("mean"), (F.col("valid") / F.col("total")).alias("fraction"))
    return out.where(F.col("mean").isNotNull() & ~F.isnan("mean") & (F.abs("mean") < float("inf")))


def classified(events: DataFrame, points: DataFrame) -> DataFrame:
    """One row per event: reference (mean before), detection, recent (mean of the last dates after), state."""
    detected = events.select(F.col("id").alias("event_id"), F.date_format("first_detected_at", "yyyy-MM-dd").alias("detected"))
    rows = detected.join(points, "event_id", "left")
    date = F.col("date")
    after = F.sort_array(F.collect_list(F.when(date > F.col("detected"), F.struct("date", "mean"))), asc=False)
    found = rows.groupBy("event_id").agg(F.avg(F.when(date < F.col("detected"), F.col("mean"))).alias("reference"), F.max(F.when(date == F.col("detected"), F.col("mean"))).alias("detection"), F.slice(after, 1, RECENT).alias("last"))
    size = F.size("last")
    recent = F.when(size > 0, F.aggregate("last", F.lit(0.0), lambda s, p: s + p["mean"]) / size)
    span = F.col("reference") - F.col("detection")
    ratio = F.when(span > 0, (F.col("recent") - F.col("detection")) / span)
    state = F.when(ratio >= RECOVERED, "transient").when(ratio <= PERSISTENT, "persistent").when(ratio.isNotNull(), "recovering").otherwise("insufficient-data")
    return found.withColumn("recent", recent).drop("last").withColumn("state", state)
