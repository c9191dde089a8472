"""Pixel DataFrames: masks, indices, differences and statistics, all column expressions.

A masked pixel has null values; null passes through every expression, and aggregates leave it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bands by sensor.
BANDS = {"HLSL30": {"red": "B4", "nir": "B5", "swir2": "B7"}, "HLSS30": {"red": "B4", "nir": "B8A", "swir2": "B12"}}
THRESHOLD, VV_THRESHOLD, MIN_AREA_M2, SCALE_M = -0.25, -3.0, 4500.0, 30.0


def clear(fmask: Column) -> Column:
    """No cloud (bit 1), shadow (3) or snow (4), and no high aerosol (bits 6-7); water (5) is kept."""
    return (fmask.bitwiseAND(2 + 8 + 16) == 0) & (F.shiftright(fmask, 6).bitwiseAND(3) != 3)


def masked(df: DataFrame, mask: Column, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(mask, F.col(c)) for c in columns})


def finite(x: Column) -> Column:
    """NaN is masked, never a value."""
    return F.when(~F.isnan(x), x)


def difference_ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), null where the sum is 0."""
    return F.try_divide(a - b, a + b)


def named_bands(df: DataFrame, sensor: str = "sensor") -> DataFrame:
    """red, nir, swir2 from the columns that each sensor calls them by; null for others."""
    pick = lambda band: F.coalesce(*[F.when(F.col(sensor) == s, F.col(b[band])) for s, b in BANDS.items()])
    return df.withColumns({band: pick(band) for band in ("red", "nir", "swir2")})


def indices(df: DataFrame) -> DataFrame:
    """nbr and ndvi in one pass over masked bands."""
    return df.withColumns({"nbr": difference_ratio(F.col("nir"), F.col("swir2")), "ndvi": difference_ratio(F.col("nir"), F.col("red"))})


def long_indices(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.expr("stack(2, 'NBR', nbr, 'NDVI', ndvi) AS (index_type, value)"))


def valid_fraction(df: DataFrame, mask: Column, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.avg(mask.cast("double")), F.lit(0.0)).alias("valid_pixel_fraction"))


def forest(kind: str, canopy_percent: float = 30.0) -> Column:
    """Forest by tree cover and loss year, by land cover class 10, or no mask at all."""
    if kind == "hansen":
        return (F.col("treecover2000") >= canopy_percent) & (F.coalesce(F.col("lossyear"), F.lit(0)) == 0)
    if kind == "worldcover":
        return F.col("landcover") == 10
    if kind == "none":
        return F.lit(True)
    raise ValueError(f"unknown forest mask {kind!r}")


def forest_of(source: Column, canopy_percent: Column) -> Column:
    """``forest`` for a mask that each row names; an unknown one is an error."""
    tree = (F.col("treecover2000") >= canopy_percent) & (F.coalesce(F.col("lossyear"), F.lit(0)) == 0)
    wrong = F.raise_error(F.concat(F.lit("unknown forest mask "), source)).cast("boolean")
    return F.when(source == "hansen", tree).when(source == "worldcover", forest("worldcover")).when(source.isNull() | (source == "none"), F.lit(True)).otherwise(wrong)


def hits(df: DataFrame, value: str, threshold: float = THRESHOLD) -> DataFrame:
    return df.where(F.col(value) < threshold)


def zonal(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, least and number of unmasked values per zone."""
    return df.groupBy(*keys).agg(F.avg(value).alias("delta_mean"), F.min(value).alias("delta_min"), F.count(value).alias("valid_pixels"))


def pixel_fraction(valid_pixels: Column, area_m2: Column, scale_m: float = SCALE_M) -> Column:
    """Share of a footprint that its pixels cover, at most 1; null without area or count."""
    return F.when(valid_pixels.isNotNull() & (area_m2 > 0), F.least(F.lit(1.0), valid_pixels * scale_m * scale_m / area_m2))


def aligned(pixels: DataFrame, mask: DataFrame, factor: int, keep: str = "keep") -> DataFrame:
    """``pixels`` under a mask whose cells are ``factor`` pixels wide: an equi-join on computed cells."""
    cells = mask.where(keep).select(F.col("row").alias("m_row"), F.col("col").alias("m_col"))
    return pixels.join(cells, (F.floor(F.col("row") / factor) == F.col("m_row")) & (F.floor(F.col("col") / factor) == F.col("m_col")), "left_semi")
