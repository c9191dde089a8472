"""Raster tables on disk: one partition per area, product and date."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.sources.shared import _delete, folders

MARGIN_DAYS = 14


def write_rasters(pixels: DataFrame, path: str) -> None:
    """Pixels (aoi, product, date, …); only the partitions in hand are replaced."""
    rows = pixels.repartition("aoi", "product", "date")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("aoi", "product", "date").parquet(path)


def read_window(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], **only: str) -> DataFrame:
    """Pixels of a window [from, to) of chosen partitions: partitions are pruned, bounds are pushed to the scan."""
    df = spark.read.parquet(path)
    for name, value in only.items():
        df = df.where(F.col(name) == value)
    return df.where((F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1]))


def kept_days(asked: int, window: int) -> tuple[int, bool]:
    """Days to keep, at least the window and a margin, and whether that raised them."""
    return max(asked, window + MARGIN_DAYS), asked < window + MARGIN_DAYS


def prune_report(listing: DataFrame, cutoff) -> DataFrame:
    """One row over files (path, bytes): pruned, pruned_bytes, kept, unrecognized; dates come from the path."""
    day = F.try_to_date(F.regexp_extract("path", r"([^/]+)/[^/]+\.tif$", 1), "yyyy-MM-dd")
    old = day < F.lit(cutoff)
    rows = listing.where(F.col("path").rlike(r"^[^/]+/[^/]+/[^/]+/[^/]+\.tif$"))
    return rows.agg(F.count_if(old).alias("pruned"), F.coalesce(F.sum(F.when(old, F.col("bytes"))), F.lit(0)).alias("pruned_bytes"), F.count_if(~old).alias("kept"), F.count_if(day.isNull()).alias("unrecognized"))


def pruned(spark: SparkSession, path: str, before) -> list[str]:
    """Drop the partitions of ``write_rasters`` that are older than a date; those without a date stay. Returns what went.

    Only names of partitions pass through the driver, never rows."""
    gone = []
    for folder in folders(spark, f"{path}/aoi=*/product=*/date=*"):
        day = folder.rsplit("date=", 1)[1]
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", day) and day < str(before):
            _delete(spark, folder)
            gone.append(folder)
    return gone


def missing_report(cataloged: DataFrame, listing: DataFrame, warn_at: float = 0.5) -> DataFrame:
    """One row: cataloged paths, those without a file, their share, and whether that is a wholesale miss."""
    gone = cataloged.join(listing.select("path").distinct(), "path", "left_anti").agg(F.count("*").alias("missing"))
    all_ = cataloged.agg(F.count("*").alias("cataloged"))
    ratio = F.when(F.col("cataloged") > 0, F.col("missing") / F.col("cataloged")).otherwise(F.lit(0.0))
    return all_.crossJoin(gone).select("cataloged", "missing", ratio.alias("ratio"), ((F.col("cataloged") > 0) & (ratio >= warn_at)).alias("warn"))
