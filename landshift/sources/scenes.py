"""Scene listings: discovery of optical and radar scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landshift.functions.text import from_epoch_ms, last_segment, number_or_null
from landshift.operators.catalog import inserted

LISTING = "id string, properties map<string,string>, polarisations array<string>"


def in_window(at: Column, since, until) -> Column:
    """since <= at < until"""
    return (at >= F.lit(since)) & (at < F.lit(until))


def optical(listing: DataFrame) -> DataFrame:
    """(source_scene_id, acquired_at, cloud_cover) of a listing; a scene without a time is an error."""
    p = lambda k: F.try_element_at("properties", F.lit(k))
    ms = p("system:time_start").cast("long")
    at = F.coalesce(from_epoch_ms(ms), F.raise_error(F.concat(F.lit("scene without a time: "), F.coalesce("id", F.lit("?")))).cast("timestamp"))
    return listing.select(F.coalesce(p("system:index"), last_segment(F.col("id"))).alias("source_scene_id"), at.alias("acquired_at"), number_or_null(p("CLOUD_COVERAGE")).alias("cloud_cover"))


def eligible_radar(listing: DataFrame) -> DataFrame:
    """Radar scenes in interferometric wide mode with VV."""
    return listing.where((F.try_element_at("properties", F.lit("instrumentMode")) == "IW") & F.coalesce(F.array_contains("polarisations", "VV"), F.lit(False)))


def by_id(scenes: DataFrame, *names: str) -> DataFrame:
    """The scenes of these names; the names reach the scan."""
    return scenes.where(F.col("source_scene_id").isin(*names))


def discovered(existing: DataFrame, scenes: DataFrame, listing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New rows to record, and one row of counts: discovered (in the listing, eligible or not), recorded, skipped."""
    new = inserted(existing, scenes, "aoi_id", "source_scene_id")
    counts = (scenes if listing is None else listing).agg(F.count("*").alias("discovered")).crossJoin(new.agg(F.count("*").alias("recorded")))
    return new, counts.withColumn("skipped", F.col("discovered") - F.col("recorded"))
