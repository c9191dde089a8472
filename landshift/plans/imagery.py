"""Queries over scenes and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.functions import text as fn
from landshift.operators import baseline, catalog, components, raster
from landshift.plans.bindings import Domain, oracle
from landshift.sources import exports, scenes

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


def masked_pixels(d: Domain) -> DataFrame:
    """Pixels of optical scenes with indices; cloudy ones masked."""
    rows = d.raw_pixel.join(d.optical.select(F.col("id").alias("observation_id"), "sensor"), "observation_id")
    rows = rows.select("*", F.col("b_nir").alias("B5"), F.col("b_nir").alias("B8A"), F.col("b_swir2").alias("B7"), F.col("b_swir2").alias("B12"), F.col("b_red").alias("B4"))
    return raster.indices(raster.masked(raster.named_bands(rows), raster.clear(F.col("fmask")), "red", "nir", "swir2"))


_PIX = """
    pix AS (SELECT observation_id, pixel, CASE WHEN ok AND nir + swir2 <> 0 THEN (nir - swir2) / (nir + swir2) END AS nbr, CASE WHEN ok AND nir + red <> 0 THEN (nir - red) / (nir + red) END AS ndvi
            FROM (SELECT observation_id, pixel, b_nir AS nir, b_swir2 AS swir2, b_red AS red, (fmask & 2) = 0 AND (fmask & 8) = 0 AND (fmask & 16) = 0 AND ((fmask >> 6) & 3) <> 3 AS ok
                  FROM raw_pixel JOIN optical ON id = observation_id) q)"""
_TRAIL = """
    trail AS (SELECT a.id AS scene_id, b.id AS baseline_id, row_number() OVER (PARTITION BY a.id ORDER BY b.acquired_at DESC, b.id DESC) AS place
              FROM optical a JOIN optical b ON a.aoi_id = b.aoi_id AND b.acquired_at < a.acquired_at QUALIFY place <= 5)"""
_DELTA = f"""{_PIX}, {_TRAIL},
    base AS (SELECT scene_id, pixel, median(nbr) AS nbr, median(ndvi) AS ndvi FROM trail JOIN pix ON observation_id = baseline_id GROUP BY scene_id, pixel),
    delta AS (SELECT scene_id, p.pixel, p.nbr - b.nbr AS delta_nbr, p.ndvi - b.ndvi AS delta_ndvi FROM pix p JOIN base b ON b.scene_id = p.observation_id AND b.pixel = p.pixel)"""


def _deltas(d: Domain) -> DataFrame:
    return baseline.deltas(d.optical, masked_pixels(d).select("observation_id", "pixel", "nbr", "ndvi"), "nbr", "ndvi")


@query(f"WITH {_DELTA} SELECT scene_id, pixel, round(delta_nbr, 6) AS delta FROM delta WHERE delta_nbr < -0.25")
def change_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: masked index, trailing baseline of scenes, difference, threshold."""
    return raster.hits(_deltas(Domain(spark, sf_dir)), "delta_nbr").select("scene_id", "pixel", F.round("delta_nbr", 6).alias("delta"))


@query(f"WITH {_DELTA} SELECT scene_id, pixel, round(delta_nbr, 6) AS delta_nbr, round(delta_ndvi, 6) AS delta_ndvi FROM delta")
def delta_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(Domain(spark, sf_dir)).select("scene_id", "pixel", F.round("delta_nbr", 6).alias("delta_nbr"), F.round("delta_ndvi", 6).alias("delta_ndvi"))


@query(f"WITH {_TRAIL} SELECT scene_id, baseline_id, place FROM trail")
def baseline_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.trailing(Domain(spark, sf_dir).optical)


@query("""
    WITH trail AS (SELECT a.id AS scene_id, b.id AS baseline_id, row_number() OVER (PARTITION BY a.id ORDER BY b.acquired_at DESC, b.id DESC) AS place
                   FROM radar a JOIN radar b ON a.aoi_id = b.aoi_id AND a.orbit_direction = b.orbit_direction AND b.acquired_at < a.acquired_at QUALIFY place <= 5),
         base AS (SELECT scene_id, pixel, median(vv) AS vv FROM trail JOIN raw_pixel ON observation_id = baseline_id GROUP BY scene_id, pixel)
    SELECT scene_id, p.pixel, round(p.vv - b.vv, 6) + 0.0E0 AS delta_vv_db FROM raw_pixel p JOIN base b ON b.scene_id = p.observation_id AND b.pixel = p.pixel""")
def radar_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    out = baseline.deltas(d.radar, d.raw_pixel.select("observation_id", "pixel", "vv"), "vv", same=("aoi_id", "orbit_direction"))
    return out.select("scene_id", "pixel", (F.round("delta_vv", 6) + 0.0).alias("delta_vv_db"))


@query("""
    SELECT id, source_scene_id, acquired_at FROM observation JOIN aoi ON aoi.id = aoi_id
    WHERE acquired_at >= TIMESTAMP '1997-01-01' AND acquired_at < TIMESTAMP '1998-01-01' AND name LIKE '%1%'""".replace("SELECT id,", "SELECT observation.id AS id,"))
def scene_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of some areas in a half-open window; the bounds reach the scan."""
    import datetime

    d = Domain(spark, sf_dir)
    rows = d.observation.where(scenes.in_window(F.col("acquired_at"), datetime.datetime(1997, 1, 1), datetime.datetime(1998, 1, 1)))
    return rows.join(d.aoi.where(F.col("name").like("%1%")).select(F.col("id").alias("a")), F.col("aoi_id") == F.col("a")).select("id", "source_scene_id", "acquired_at")


@query("""
    WITH seen AS (SELECT * FROM optical UNION ALL SELECT * FROM optical WHERE id % 9 = 0), known AS (SELECT aoi_id, source_scene_id FROM optical WHERE id % 3 = 0)
    SELECT (SELECT count(*) FROM seen) AS discovered, count(*) AS recorded, (SELECT count(*) FROM seen) - count(*) AS skipped
    FROM (SELECT DISTINCT aoi_id, source_scene_id FROM seen) s WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.aoi_id = s.aoi_id AND k.source_scene_id = s.source_scene_id)""")
def optical_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings that overlap, against what the catalog knows."""
    optical = Domain(spark, sf_dir).optical
    seen = optical.unionByName(optical.where("id % 9 = 0"))
    return scenes.discovered(optical.where("id % 3 = 0"), seen)[1]


@query("""
    SELECT id, source_scene_id, orbit_direction, CASE WHEN id % 2 = 0 THEN 'IW' ELSE 'EW' END AS mode FROM radar WHERE id % 2 = 0 AND id % 3 > 0 AND id % 11 > 0""")
def radar_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible radar scenes that the catalog does not know."""
    radar = Domain(spark, sf_dir).radar
    mode = F.when(F.col("id") % 2 == 0, "IW").otherwise("EW")
    listing = radar.withColumn("properties", F.create_map(F.lit("instrumentMode"), mode)).withColumn("polarisations", F.when(F.col("id") % 3 > 0, F.array(F.lit("VV"), F.lit("VH"))).otherwise(F.array(F.lit("HH"))))
    new = catalog.inserted(radar.where("id % 11 = 0"), scenes.eligible_radar(listing), "aoi_id", "source_scene_id")
    return new.select("id", "source_scene_id", "orbit_direction", F.col("properties")["instrumentMode"].alias("mode"))


@query("""
    SELECT observation_id, count(*) AS pixels, count(CASE WHEN (fmask & 2) = 0 AND (fmask & 8) = 0 AND (fmask & 16) = 0 AND ((fmask >> 6) & 3) <> 3 THEN 1 END) AS clear_pixels,
           count(CASE WHEN (fmask & 32) <> 0 AND (fmask & 26) = 0 AND ((fmask >> 6) & 3) <> 3 THEN 1 END) AS clear_water FROM raw_pixel GROUP BY observation_id""")
def clear_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = raster.clear(F.col("fmask"))
    return Domain(spark, sf_dir).raw_pixel.groupBy("observation_id").agg(F.count("*").alias("pixels"), F.count_if(ok).alias("clear_pixels"), F.count_if(ok & (F.col("fmask").bitwiseAND(32) != 0)).alias("clear_water"))


@query(f"WITH {_PIX} SELECT observation_id, pixel, 'NBR' AS index_type, round(nbr, 6) AS value FROM pix UNION ALL SELECT observation_id, pixel, 'NDVI', round(ndvi, 6) FROM pix")
def index_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.long_indices(masked_pixels(Domain(spark, sf_dir)), "observation_id", "pixel")
    return out.withColumn("value", F.round("value", 6))


@query("SELECT o.id AS observation_id, round(coalesce(valid_pixel_fraction, 0), 6) AS valid_pixel_fraction FROM optical o LEFT JOIN quality_mask ON o.id = observation_id")
def valid_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of clear pixels per optical scene; 0 where it has none at all."""
    d = Domain(spark, sf_dir)
    rows = d.optical.select(F.col("id").alias("observation_id")).join(d.raw_pixel, "observation_id", "left")
    out = raster.valid_fraction(rows, F.when(F.col("fmask").isNotNull(), raster.clear(F.col("fmask"))), "observation_id")
    return out.withColumn("valid_pixel_fraction", F.round("valid_pixel_fraction", 6))


@query("""
    SELECT pixel, treecover2000 >= 30 AND coalesce(lossyear, 0) = 0 AS hansen, landcover = 10 AS worldcover, true AS none FROM forest_pixel""")
def forest_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Domain(spark, sf_dir).forest_pixel
    return rows.select("pixel", *[raster.forest(k).alias(k) for k in ("hansen", "worldcover", "none")])


@query("""
    WITH m AS (SELECT pixel % 12 AS m_row, (pixel - pixel % 12) / 12 % 12 AS m_col, bool_or(treecover2000 >= 30 AND coalesce(lossyear, 0) = 0) AS keep FROM forest_pixel GROUP BY 1, 2)
    SELECT scene, count(*) AS hits, round(avg(delta), 6) AS delta_mean FROM cell JOIN m ON m_row = (row - row % 2) / 2 AND m_col = (col - col % 2) / 2 AND keep WHERE delta < -0.2541 GROUP BY scene""".replace("(pixel - pixel % 12) / 12 % 12", "((pixel - pixel % 12) // 12) % 12"))
def hits_in_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold hits under a mask on a coarser grid, joined by computed cell."""
    d = Domain(spark, sf_dir)
    mask = d.forest_pixel.groupBy((F.col("pixel") % 12).alias("row"), (F.floor(F.col("pixel") / 12) % 12).alias("col")).agg(F.bool_or(raster.forest("hansen")).alias("keep"))
    hits = raster.hits(raster.aligned(d.cell, mask, 2), "delta", -0.2541)
    return hits.groupBy("scene").agg(F.count("*").alias("hits"), F.round(F.avg("delta"), 6).alias("delta_mean"))


@query("""
    WITH RECURSIVE hit AS MATERIALIZED (SELECT scene, row, col, delta, row * 1000 + col AS c FROM cell WHERE delta < -0.2541),
    edge AS MATERIALIZED (SELECT a.scene, a.c AS u, b.c AS v FROM hit a JOIN hit b ON a.scene = b.scene AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
    walk AS (SELECT scene, c, c AS seen FROM hit UNION SELECT w.scene, w.c, e.v FROM walk w JOIN edge e ON e.scene = w.scene AND e.u = w.seen),
    label AS (SELECT scene, c, min(seen) AS patch FROM walk GROUP BY scene, c)
    SELECT h.scene, count(*) AS cells, count(*) * 900.0 AS area_m2, round(avg(delta), 9) AS delta_mean, round(min(delta), 6) AS delta_min, min(row) AS row_from, max(row) AS row_to, min(col) AS col_from, max(col) AS col_to
    FROM hit h JOIN label l ON l.scene = h.scene AND l.c = h.c GROUP BY h.scene, patch HAVING count(*) * 900.0 >= 1800""".replace("900.0 AS", "900.0E0 AS"))
def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-connected patches of hits with their statistics; tiles are small here so that patches cross them."""
    hits = raster.hits(Domain(spark, sf_dir).cell, "delta", -0.2541)
    out = components.patch_table(hits, "delta", 900.0, 1800.0, tile=16)
    return out.select("scene", "cells", "area_m2", F.round("delta_mean", 9).alias("delta_mean"), F.round("delta_min", 6).alias("delta_min"), "row_from", "row_to", "col_from", "col_to")


@query("""
    SELECT i.observation_id, i.path, b.baseline_id, j.path AS baseline_path FROM index_raster i
    JOIN (SELECT a.id AS scene_id, o.id AS baseline_id, row_number() OVER (PARTITION BY a.id ORDER BY o.acquired_at DESC, o.id DESC) AS place
          FROM optical a JOIN optical o ON a.aoi_id = o.aoi_id AND o.acquired_at < a.acquired_at QUALIFY place <= 5) b ON b.scene_id = i.observation_id
    JOIN index_raster j ON j.observation_id = b.baseline_id AND j.index_type = i.index_type AND j.lineage_id = i.lineage_id WHERE i.index_type = 'NBR'""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters that a difference is made of: the current one and those of its baseline, of one lineage."""
    d = Domain(spark, sf_dir)
    now = d.index_raster.where("index_type = 'NBR'").select("observation_id", "path", "lineage_id")
    then = d.index_raster.where("index_type = 'NBR'").select(F.col("observation_id").alias("baseline_id"), F.col("path").alias("baseline_path"), F.col("lineage_id").alias("b_lineage"))
    pairs = baseline.trailing(d.optical)
    rows = now.join(pairs, now.observation_id == pairs.scene_id).join(then, "baseline_id").where("lineage_id = b_lineage")
    return rows.select("observation_id", "path", "baseline_id", "baseline_path")


@query("""
    SELECT c.id AS raster_id, CASE WHEN e.candidate_id IS NOT NULL THEN 'frozen' WHEN f.path IS NOT NULL THEN 'reused' ELSE 'computed' END AS action
    FROM change_raster c LEFT JOIN event_observation e ON e.candidate_id = c.id LEFT JOIN raster_file f ON f.path = c.path""")
def raster_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per change raster: frozen as evidence, reused as stored, or computed."""
    d = Domain(spark, sf_dir)
    wanted = d.change_raster.select(F.col("id").alias("raster_id"), "path")
    stored = wanted.join(d.raster_file.select("path"), "path", "left_semi")
    frozen = d.candidate.join(d.event_observation.select("candidate_id"), F.col("id") == F.col("candidate_id"), "left_semi").select(F.col("change_raster_id").alias("raster_id"))
    return catalog.plan_rasters(wanted.select("raster_id"), frozen, stored)


_PATHS = "(SELECT path FROM index_raster UNION ALL SELECT path FROM change_raster)"


@query(f"""
    WITH p AS {_PATHS}, f AS (SELECT 'all' AS files, path FROM raster_file UNION ALL SELECT 'since 1998', path FROM raster_file WHERE split_part(path, '/', 3) >= '1998'),
    m AS (SELECT files, count(*) FILTER (WHERE path NOT IN (SELECT path FROM f WHERE f.files = k.files)) AS n, count(*) AS cataloged FROM p, (SELECT DISTINCT files FROM f) k GROUP BY files)
    SELECT files, cataloged, n AS missing, n / cataloged AS ratio, n / cataloged >= 0.5 AS warn FROM m""")
def missing_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cataloged rasters without a file: with the files there are, and had all before 1998 been lost, which is a warning."""
    d = Domain(spark, sf_dir)
    cataloged = d.index_raster.select("path").unionByName(d.change_raster.select("path"))
    recent = d.raster_file.where(F.split_part("path", F.lit("/"), F.lit(3)) >= "1998")
    told = [exports.missing_report(cataloged, files).withColumn("files", F.lit(name)) for name, files in (("all", d.raster_file), ("since 1998", recent))]
    return told[0].unionByName(told[1])


@query("""
    SELECT count(CASE WHEN d < DATE '1998-01-01' THEN 1 END) AS pruned, CAST(coalesce(sum(CASE WHEN d < DATE '1998-01-01' THEN bytes END), 0) AS BIGINT) AS pruned_bytes,
           count(CASE WHEN d >= DATE '1998-01-01' THEN 1 END) AS kept, count(CASE WHEN d IS NULL THEN 1 END) AS unrecognized
    FROM (SELECT bytes, CASE WHEN bytes % 10 > 0 THEN CAST(split_part(path, '/', 3) AS DATE) END AS d FROM raster_file) q""")
def prune_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    files = Domain(spark, sf_dir).raster_file
    path = F.when(F.col("bytes") % 10 > 0, F.col("path")).otherwise(F.regexp_replace("path", r"/[0-9-]+/", "/undated/"))
    return exports.prune_report(files.select(path.alias("path"), "bytes"), datetime.date(1998, 1, 1))


@query("""
    SELECT o.id, concat(CAST(aoi_id AS VARCHAR), '-', trim(regexp_replace(lower(name), '[^a-z0-9._-]+', '-', 'g'), '-'), '/delta_nbr/', strftime(acquired_at, '%Y-%m-%d'), '/delta_nbr-', source_scene_id, '.tif') AS raster_key
    FROM observation o JOIN aoi a ON a.id = aoi_id""")
def raster_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    rows = d.observation.join(d.aoi.select(F.col("id").alias("a"), "name"), F.col("aoi_id") == F.col("a"))
    return rows.select("id", fn.raster_key(F.col("aoi_id"), F.col("name"), F.lit("delta_nbr"), F.col("acquired_at"), F.col("source_scene_id")).alias("raster_key"))


@query("""
    SELECT s.scene_id, coalesce(c.cells, s.cells) AS cells, c.cells IS NULL AS whole_area FROM
    (SELECT id AS scene_id, aoi_id, 64 AS cells FROM optical) s LEFT JOIN
    (SELECT o.id AS scene_id, count(DISTINCT pixel) AS cells FROM optical o JOIN raw_pixel p ON p.observation_id = o.id WHERE pixel < 1 + aoi_id % 8 GROUP BY o.id) c ON c.scene_id = s.scene_id""".replace("64 AS cells", "CAST(1 + aoi_id % 8 AS BIGINT) AS cells"))
def scene_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that scene and area share; where they share none, the whole area."""
    d = Domain(spark, sf_dir)
    area = d.aoi.select(F.col("id").alias("aoi_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") % 8)).alias("pixel"))
    shared = d.optical.select("id", "aoi_id").join(d.raw_pixel.select(F.col("observation_id").alias("id"), "pixel"), "id").join(area, ["aoi_id", "pixel"], "left_semi")
    got = shared.groupBy("id").agg(F.countDistinct("pixel").alias("n"))
    size = area.groupBy("aoi_id").agg(F.count("*").alias("all_cells"))
    rows = d.optical.join(got, "id", "left").join(size, "aoi_id")
    return rows.select(F.col("id").alias("scene_id"), F.coalesce("n", "all_cells").alias("cells"), F.col("n").isNull().alias("whole_area"))
