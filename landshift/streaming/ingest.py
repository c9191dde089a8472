"""Scenes as a stream: each is recorded once, and lifecycle is re-derived per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from landshift.operators.catalog import inserted
from landshift.sources.shared import folders


def recorded_once(scenes: DataFrame, late: str = "30 days") -> DataFrame:
    """A stream without repeats of (aoi_id, source_scene_id) within the lateness; state is dropped after it."""
    return scenes.withWatermark("acquired_at", late).dropDuplicatesWithinWatermark(["aoi_id", "source_scene_id"])


def into_catalog(scenes: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append new scenes to the catalog at ``path`` exactly once: a batch is its own partition, so a repeated
    batch replaces itself, and scenes recorded by earlier batches are left out whatever their age."""

    def record(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = batch.dropDuplicates(["aoi_id", "source_scene_id"])
        if folders(spark, f"{path}/batch=*"):
            known = spark.read.parquet(path).where(f"batch < {number}").drop("batch")
            kept = inserted(known, batch, "aoi_id", "source_scene_id")
        kept.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if then:
            then(spark.read.parquet(path), number)

    return scenes.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
