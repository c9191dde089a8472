"""Queries over provenance, extraction state, stored areas and layers, run logs and geometry."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landshift.functions import geometry, hashes
from landshift.functions import text as fn
from landshift.operators import baseline, catalog, raster, views
from landshift.plans.bindings import Domain, oracle
from landshift.plans.imagery import _DELTA, masked_pixels
from landshift.sources import geojson, overrides, scenes

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


def _in_use(d: Domain) -> DataFrame:
    """The two methodologies that candidates are made by; each has the lineage of its number."""
    return d.methodology.where("id <= 2").select(F.col("id").cast("long").alias("id"), F.col("id").cast("long").alias("lineage_id"), "name")


def _recorded(d: Domain, kept: str = "true") -> DataFrame:
    """(change_raster_id, observation_id): sources as they were recorded, when the newest of today's baseline was not there
    yet; of rasters that are not ``kept`` they were lost."""
    trail = baseline.trailing(d.optical).where("place > 1").select(F.col("scene_id").alias("observation_id"), "baseline_id")
    rasters = d.change_raster.select(F.col("id").alias("change_raster_id"), "observation_id")
    priors = rasters.where(kept).join(trail, "observation_id").select("change_raster_id", F.col("baseline_id").alias("observation_id"))
    return priors.unionByName(rasters)


_RECORDED = """
    source AS (SELECT c.id AS change_raster_id, t.baseline_id AS observation_id FROM change_raster c JOIN (
                   SELECT a.id AS scene_id, b.id AS baseline_id, row_number() OVER (PARTITION BY a.id ORDER BY b.acquired_at DESC, b.id DESC) AS place
                   FROM optical a JOIN optical b ON a.aoi_id = b.aoi_id AND b.acquired_at < a.acquired_at) t ON t.scene_id = c.observation_id WHERE t.place BETWEEN 2 AND 5
               UNION ALL SELECT id, observation_id FROM change_raster)"""
#: Where every 19th raster's sources were lost.
_LOST = _RECORDED.replace("BETWEEN 2 AND 5", "BETWEEN 2 AND 5 AND c.id % 19 > 0")


@query(f"""
    WITH {_DELTA}, {_RECORDED},
    old AS (SELECT c.observation_id AS scene_id, p.pixel, median(p.nbr) AS nbr FROM change_raster c JOIN source s ON s.change_raster_id = c.id AND s.observation_id <> c.observation_id JOIN pix p ON p.observation_id = s.observation_id GROUP BY 1, 2)
    SELECT scene_id, p.pixel, round(p.nbr - o.nbr, 6) AS delta_nbr FROM pix p JOIN old o ON o.scene_id = p.observation_id AND o.pixel = p.pixel""")
def rebuilt_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of recorded rasters, made again from the sources recorded for each."""
    d = Domain(spark, sf_dir)
    pixels = masked_pixels(d).select("observation_id", "pixel", "nbr")
    out = baseline.rebuilt(d.change_raster.select("id", "observation_id"), _recorded(d), pixels, "nbr")
    return out.select("scene_id", "pixel", F.round("delta_nbr", 6).alias("delta_nbr"))


@query(f"""
    WITH {_LOST}, base AS (SELECT DISTINCT change_raster_id FROM source s JOIN change_raster c ON c.id = s.change_raster_id WHERE s.observation_id <> c.observation_id),
    gone AS (SELECT c.id, c.path, c.lineage_id, concat(CAST(o.aoi_id AS VARCHAR), CASE WHEN c.id % 17 = 0 THEN '-renamed' ELSE '-area' END, '/delta_nbr/', strftime(o.acquired_at, '%Y-%m-%d'), '/', o.source_scene_id, '.tif') AS derived
             FROM change_raster c JOIN optical o ON o.id = c.observation_id WHERE c.path NOT IN (SELECT path FROM raster_file))
    SELECT g.id, g.path, CASE WHEN lineage_id = 2 THEN 'another script version' WHEN b.change_raster_id IS NULL THEN 'no recorded baseline' WHEN derived <> path THEN 'another path' END AS problem
    FROM gone g LEFT JOIN base b ON b.change_raster_id = g.id""")
def reproducible_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters whose files were pruned, and what stands against making each again."""
    d = Domain(spark, sf_dir)
    gone = d.change_raster.join(d.raster_file.select("path"), "path", "left_anti")
    place = F.when(F.col("id") % 17 == 0, "-renamed").otherwise("-area")
    looks = d.optical.select(F.col("id").alias("observation_id"), "aoi_id", "acquired_at", "source_scene_id")
    derived = F.concat(F.col("aoi_id").cast("string"), place, F.lit("/delta_nbr/"), fn.utc_date(F.col("acquired_at")), F.lit("/"), F.col("source_scene_id"), F.lit(".tif"))
    rows = gone.join(looks, "observation_id").select("id", "path", "lineage_id", derived.alias("derived_path"))
    priors = _recorded(d, "change_raster_id % 19 > 0").join(d.change_raster.select(F.col("id").alias("change_raster_id"), F.col("observation_id").alias("own")), "change_raster_id").where("observation_id != own")
    lineages = _in_use(d).select("id", F.when(F.col("id") == 1, "s1").otherwise("s0").alias("script"))
    return catalog.reproducible(rows, priors, lineages, "s1")


@query(f"WITH {_RECORDED} SELECT s.change_raster_id, i.path AS source_path, o.acquired_at FROM source s JOIN change_raster c ON c.id = s.change_raster_id AND s.observation_id <> c.observation_id JOIN index_raster i ON i.observation_id = s.observation_id AND i.index_type = 'NBR' JOIN optical o ON o.id = s.observation_id")
def recorded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded baseline sources of each change raster, without itself."""
    d = Domain(spark, sf_dir)
    own = d.change_raster.select(F.col("id").alias("change_raster_id"), F.col("observation_id").alias("own"))
    rows = _recorded(d).join(own, "change_raster_id").where("observation_id != own")
    rows = rows.join(d.index_raster.where("index_type = 'NBR'").select("observation_id", F.col("path").alias("source_path")), "observation_id")
    return rows.join(d.optical.select(F.col("id").alias("observation_id"), "acquired_at"), "observation_id").select("change_raster_id", "source_path", "acquired_at")


_STATE = """
    mark AS (SELECT change_raster_id, methodology_id FROM extraction UNION SELECT id, 1 FROM change_raster WHERE id % 5 = 0),
    cand AS (SELECT change_raster_id, methodology_id FROM candidate WHERE change_raster_id % 5 > 0 OR methodology_id <> 1 UNION ALL SELECT change_raster_id, 1 FROM candidate WHERE change_raster_id % 5 = 0 AND change_raster_id % 10 > 0 AND methodology_id = 1),
    state AS (SELECT c.id AS change_raster_id, m.id AS methodology_id, EXISTS (SELECT 1 FROM mark k WHERE k.change_raster_id = c.id AND k.methodology_id = m.id) AS extracted,
              (SELECT count(*) FROM cand k WHERE k.change_raster_id = c.id AND k.methodology_id = m.id) AS candidates FROM change_raster c, (SELECT CAST(1 AS BIGINT) AS id UNION ALL SELECT 2) m)"""


def _state(d: Domain) -> DataFrame:
    """After the first methodology was run again on some rasters; a raster may have no candidates and yet be done."""
    c = d.candidate.select("id", "change_raster_id", "methodology_id")
    again = d.change_raster.where("id % 5 = 0").select(F.col("id").alias("change_raster_id"), F.lit(1).cast("long").alias("methodology_id"))
    new = c.where("change_raster_id % 5 = 0 AND methodology_id = 1 AND change_raster_id % 10 > 0")
    scope = c.where("change_raster_id % 5 = 0 AND methodology_id = 1").select("change_raster_id", "methodology_id")
    after = catalog.replaced(c, new, scope, "change_raster_id", "methodology_id")
    return catalog.extraction_state(d.change_raster, _in_use(d), catalog.marked(d.extraction, again), after)


@query(f"WITH {_STATE} SELECT * FROM state")
def extraction_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(Domain(spark, sf_dir))


@query(f"""
    WITH {_STATE} SELECT s.change_raster_id, methodology_id, CASE WHEN extracted THEN 'counted' WHEN methodology_id = 1 AND EXISTS (SELECT 1 FROM raster_file f WHERE f.path = c.path) THEN 'local' WHEN c.id % 7 > 0 THEN 'rebuilt' ELSE 'refused' END AS way
    FROM state s JOIN change_raster c ON c.id = s.change_raster_id""")
def extraction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each raster's candidates are had under each methodology."""
    d = Domain(spark, sf_dir)
    rows = d.change_raster.select(F.col("id").alias("change_raster_id"), "path")
    stored = rows.join(d.raster_file.select("path"), "path", "left_semi")
    masks = _in_use(d).where("id = 1").select(F.col("id").alias("methodology_id"))
    return catalog.extraction_plan(_state(d), stored, masks, rows.where("change_raster_id % 7 > 0"))


@query("""
    SELECT e.id AS event_id, count(o.id) AS looks, coalesce(string_agg(CAST(o.id AS VARCHAR), ',' ORDER BY o.acquired_at, o.id), '') AS observation_ids
    FROM event e LEFT JOIN (SELECT o.id, o.aoi_id, o.acquired_at, i.lineage_id FROM index_raster i JOIN observation o ON o.id = i.observation_id WHERE i.index_type = 'NBR') o ON o.aoi_id = e.aoi_id AND o.lineage_id = e.methodology_id GROUP BY e.id""")
def lineage_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of an event's own lineage over its area, in order of time."""
    d = Domain(spark, sf_dir)
    out = views.lineage_looks(d.event, d.observation, d.index_raster, _in_use(d), as_text=True)
    return out.select("event_id", F.coalesce("looks", F.lit(0).cast("long")).alias("looks"), F.coalesce("ids", F.lit("")).alias("observation_ids"))


@query("SELECT name, max(id) AS id, arg_max(script, id) AS script, arg_max(detection, id) AS detection FROM methodology GROUP BY name")
def latest_methodologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest(Domain(spark, sf_dir).methodology, "name", F.col("id"), "id", "script", "detection")


@query("""
    SELECT regexp_replace(path, '-area/', '/') AS path, count(*) AS times FROM (SELECT path FROM index_raster UNION ALL SELECT path FROM index_raster WHERE id % 3 = 0 UNION ALL SELECT path FROM index_raster WHERE id % 5 = 0) p GROUP BY 1""")
def unique_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs written in several ways are one."""
    paths = Domain(spark, sf_dir).index_raster.select("id", F.regexp_replace("path", "-area/", "/").alias("path"))
    ways = paths.select("path").unionByName(paths.where("id % 3 = 0").select(F.concat(F.lit("./"), F.regexp_replace("path", "/", "//")).alias("path")))
    ways = ways.unionByName(paths.where("id % 5 = 0").select(F.concat(F.lit("old/../"), F.regexp_replace("path", "/", "/./")).alias("path")))
    return ways.groupBy(fn.canonical_path(F.col("path")).alias("path")).agg(F.count("*").alias("times"))


@query("""
    SELECT event_id AS id, concat('{"k":', k, CASE WHEN event_id % 2 = 0 THEN concat(',"scale":', CAST(user_id AS VARCHAR)) ELSE '' END, '}') AS raster_parameters,
           substr(sha256(concat('{"k":', k, CASE WHEN event_id % 2 = 0 THEN concat(',"scale":', CAST(user_id AS VARCHAR)) ELSE '' END, '}')), 1, 8) AS lineage
    FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1) AS k FROM events) q""")
def lineage_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameters that shape rasters, of all that a methodology has, and the hash that names their lineage."""
    k = F.get_json_object("props", "$.k").cast("long")
    every = F.create_map(F.lit("threshold"), F.lit(3).cast("long"), F.lit("scale"), F.col("user_id"), F.lit("k"), k)
    shaping = F.when(F.col("event_id") % 2 == 0, hashes.subset(every, ("k", "scale"))).otherwise(hashes.subset(every, ("k",)))
    rows = Domain(spark, sf_dir).table("events").select(F.col("event_id").alias("id"), hashes.canonical(shaping).alias("raster_parameters"))
    return rows.withColumn("lineage", hashes.short_hash(F.col("raster_parameters"), 8))


@query("""
    SELECT event_id AS id, concat('{"a":{"x":', CAST(user_id AS VARCHAR), ',"y":[1,2]},"b":"', event_type, '"}') AS canonical, event_id % 5 > 0 AS same, user_id % 2 = 0 AS same_as_even FROM events""")
def json_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects are equal in whatever order their keys stand, nested ones too; arrays only in the same order."""
    u, kind = F.col("user_id").cast("string"), F.col("event_type")
    one = F.concat(F.lit('{"b":"'), kind, F.lit('","a":{"y":[1,2],"x":'), u, F.lit("}}"))
    two = F.concat(F.lit('{ "a": {"x":'), u, F.when(F.col("event_id") % 5 > 0, ', "y": [1, 2]}, "b" : "').otherwise(', "y": [2, 1]}, "b" : "'), kind, F.lit('"}'))
    three = F.concat(F.lit('{"a":{"x":'), (F.col("user_id") - F.col("user_id") % 2).cast("string"), F.lit(',"y":[1,2]},"b":"'), kind, F.lit('"}'))
    return Domain(spark, sf_dir).table("events").select(F.col("event_id").alias("id"), hashes.canonical_json(one).alias("canonical"), hashes.same_json(one, two).alias("same"), hashes.same_json(one, three).alias("same_as_even"))


_MASKS = """
    chosen AS (SELECT id, coalesce(CASE WHEN id = 3 THEN 'worldcover' END, CASE id % 4 WHEN 0 THEN 'hansen' WHEN 1 THEN 'worldcover' END, 'none') AS mask, CASE WHEN id % 4 = 0 THEN 10 + id END AS canopy FROM methodology)"""


def _mask(d: Domain) -> DataFrame:
    """Per methodology its forest mask: an override, else what it records, else none."""
    recorded = F.when(F.col("id") % 4 == 0, "hansen").when(F.col("id") % 4 == 1, "worldcover")
    override = F.when(F.col("id") == 3, "worldcover")
    source = fn.resolved(("override", override), ("methodology", recorded), ("default", F.lit("none")))["value"]
    return d.methodology.select("id", source.alias("mask"), F.when(F.col("id") % 4 == 0, 10 + F.col("id")).alias("canopy"))


@query(f"""
    WITH {_MASKS} SELECT id, mask, CASE WHEN mask <> 'none' THEN concat('mask-', substr(sha256(CASE mask WHEN 'hansen' THEN concat('{{"canopy":', CAST(canopy AS VARCHAR), ',"source":"hansen"}}') ELSE '{{"source":"worldcover"}}' END), 1, 10), '.tif') END AS file FROM chosen""")
def mask_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask each methodology works under and the file that a hash of its settings names."""
    settings = F.to_json(F.struct(F.col("canopy"), F.col("mask").alias("source")))  # nulls are left out, keys stand in order
    name = F.when(F.col("mask") != "none", F.concat(F.lit("mask-"), hashes.short_hash(settings, 10), F.lit(".tif")))
    return _mask(Domain(spark, sf_dir)).select("id", "mask", name.alias("file"))


@query(f"""
    WITH {_MASKS} SELECT c.id, count(*) FILTER (WHERE CASE mask WHEN 'hansen' THEN treecover2000 >= canopy AND coalesce(lossyear, 0) = 0 WHEN 'worldcover' THEN landcover = 10 ELSE true END) AS pixels FROM chosen c, forest_pixel GROUP BY c.id""")
def masked_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels under each methodology's own mask."""
    d = Domain(spark, sf_dir)
    rows = d.forest_pixel.join(F.broadcast(_mask(d)))  # a registry of a few rows
    return rows.groupBy("id").agg(F.count_if(raster.forest_of(F.col("mask"), F.col("canopy"))).alias("pixels"))


@query("""
    SELECT observation_id * 3 AS id, observation_id, lineage_id, concat(path, CASE WHEN observation_id % 3 = 0 THEN '.new' ELSE '' END) AS path FROM change_raster WHERE true
    UNION ALL SELECT (observation_id + 1000000000) * 3, observation_id + 1000000000, lineage_id, path FROM change_raster WHERE observation_id % 6 = 0""")
def change_rasters_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = Domain(spark, sf_dir).change_raster.select((F.col("observation_id") * 3).alias("id"), "observation_id", "lineage_id", "path")
    change = old.where("observation_id % 3 = 0").withColumn("path", F.concat("path", F.lit(".new")))
    fresh = old.where("observation_id % 6 = 0").withColumns({"observation_id": F.col("observation_id") + 1000000000, "id": F.col("id") + 3000000000})
    return catalog.upserted(old, change.unionByName(fresh), "observation_id", "lineage_id")


@query("SELECT observation_id, CASE WHEN observation_id % 4 = 0 THEN 0.5E0 ELSE round(valid_pixel_fraction, 6) END AS valid_pixel_fraction FROM quality_mask UNION ALL SELECT -observation_id, 0.5E0 FROM quality_mask WHERE observation_id % 8 = 0")
def masks_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = Domain(spark, sf_dir).quality_mask.withColumn("valid_pixel_fraction", F.round("valid_pixel_fraction", 6))
    half = F.lit(0.5).alias("valid_pixel_fraction")
    new = old.where("observation_id % 4 = 0").select("observation_id", half).unionByName(old.where("observation_id % 8 = 0").select((-F.col("observation_id")).alias("observation_id"), half))
    return catalog.upserted(old, new, "observation_id")


@query(f"WITH {_RECORDED} SELECT * FROM source WHERE change_raster_id % 4 > 1 UNION ALL SELECT change_raster_id, observation_id + 1 FROM source WHERE change_raster_id % 4 = 1")
def sources_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded sources of rasters made again give way to the new ones."""
    old = _recorded(Domain(spark, sf_dir))
    scope = old.where("change_raster_id % 4 < 2")
    new = old.where("change_raster_id % 4 = 1").withColumn("observation_id", F.col("observation_id") + 1)
    return catalog.replaced(old, new, scope, "change_raster_id")


@query("SELECT id, layer_id, name FROM context_feature WHERE layer_id NOT IN (1, 3) UNION ALL SELECT id + 1000000, 1, concat(name, ' new') FROM context_feature WHERE layer_id = 1 AND id % 2 = 0")
def layer_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of two layers loaded again, one of them with nothing in it."""
    old = Domain(spark, sf_dir).context_feature.select("id", "layer_id", "name")
    scope = old.where("layer_id IN (1, 3)")
    new = scope.where("layer_id = 1 AND id % 2 = 0").withColumns({"id": F.col("id") + 1000000, "name": F.concat("name", F.lit(" new"))})
    return catalog.replaced(old, new, scope, "layer_id")


@query("SELECT id, aoi_id, status FROM event WHERE aoi_id % 5 > 0 UNION ALL SELECT id, aoi_id, 'again' FROM event WHERE aoi_id % 5 = 0 AND id % 2 = 0")
def view_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived view made again for some areas, whose old rows all go."""
    old = Domain(spark, sf_dir).event.select("id", "aoi_id", "status")
    scope = old.where("aoi_id % 5 = 0")
    return catalog.replaced(old, scope.where("id % 2 = 0").withColumn("status", F.lit("again")), scope, "aoi_id")


@query("SELECT event_id, count(*) AS opinions, arg_max(opinion, id) AS newest FROM (SELECT id, event_id, opinion FROM review UNION ALL SELECT 1000000000 + id, id, 'confirmed' FROM event WHERE id % 10 = 0) r GROUP BY event_id")
def reviews_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews are added, never changed; an event's opinion is its newest."""
    d = Domain(spark, sf_dir)
    new = d.event.where("id % 10 = 0").select((F.col("id") + 1000000000).alias("id"), F.col("id").alias("event_id"), F.lit("confirmed").alias("opinion"))
    every = d.review.select("id", "event_id", "opinion").unionByName(new)
    return every.groupBy("event_id").agg(F.count("*").alias("opinions"), F.max_by("opinion", "id").alias("newest"))


def _square(x, y, turned):
    """A unit square as GeoJSON coordinates, its ring begun at another corner and run the other way if ``turned``."""
    a, b, c, d = (F.concat(F.lit("["), (x + i).cast("string"), F.lit(","), (y + j).cast("string"), F.lit("]")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1)))
    ring = lambda *p: F.concat(F.lit("[[["), F.concat_ws(",", *p), F.lit("]]]"))
    return F.when(turned, ring(c, b, a, d, c)).otherwise(ring(a, b, c, d, a))


@query("""
    SELECT id, name, id % 4 = 1 AS differs FROM aoi WHERE id % 2 = 1
    UNION ALL SELECT 99 + row_number() OVER (ORDER BY name) AS id, name, false FROM aoi WHERE id % 2 = 0""")
def areas_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas loaded beside those there are: stored footprints win, whatever corner or turn a ring is told in."""
    rows = Domain(spark, sf_dir).aoi
    x = F.col("id")
    stored = rows.where("id % 2 = 1").select("id", "name", hashes.canonical_shape(_square(x, x, F.lit(False))).alias("geometry"))
    loaded = rows.select("name", hashes.canonical_shape(_square(x + F.when(x % 4 == 1, 5).otherwise(0), x, x % 3 == 0)).alias("geometry"))
    return catalog.areas_stored(stored, loaded, 100).select("id", "name", "differs")


@query("""
    WITH new AS (SELECT id + 1000000 AS id, aoi_id, started_at + INTERVAL 400 DAY AS started_at, 'running' AS status, 1 + id % 3 AS methodology_id, concat('g', CAST(id % 3 AS VARCHAR)) AS geometry_hash FROM run WHERE id % 10 = 0),
    every AS (SELECT * FROM run UNION ALL SELECT * FROM new),
    seen AS (SELECT *, lead(id) OVER w AS later, lag(methodology_id) OVER w AS m, lag(geometry_hash) OVER w AS g FROM every WINDOW w AS (PARTITION BY aoi_id ORDER BY started_at, id)),
    head AS (SELECT id, CASE WHEN id >= 1000000 AND id % 20 = 0 THEN 'failed' WHEN status = 'running' AND later IS NOT NULL THEN 'interrupted' ELSE status END AS status FROM seen),
    told AS (SELECT id, 1 AS n FROM seen WHERE id >= 1000000 AND m <> methodology_id UNION ALL SELECT id, 1 FROM seen WHERE id >= 1000000 AND g <> geometry_hash)
    SELECT h.id, h.status, (SELECT count(*) FROM told t WHERE t.id = h.id) AS warnings FROM head h""")
def run_log_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and warnings after runs began, of which some ended."""
    d = Domain(spark, sf_dir)
    runs = d.run
    new = runs.where("id % 10 = 0").select((F.col("id") + 1000000).alias("id"), "aoi_id", (F.col("started_at") + F.expr("INTERVAL 400 DAYS")).alias("started_at"), F.lit("running").alias("status"), (1 + F.col("id") % 3).alias("methodology_id"), F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("geometry_hash"))
    log = spark.createDataFrame([], "run_id long, stage string, outcome string, message string")
    headers, lines = catalog.run_started(runs, log, new)
    headers = catalog.run_finished(headers, new.where("id % 20 = 0").select("id", F.lit("failed").alias("status")))
    warnings = lines.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("warnings"))
    return headers.join(warnings, "id", "left").select("id", "status", F.coalesce("warnings", F.lit(0).cast("long")).alias("warnings"))


@query("""
    WITH ok AS (SELECT * FROM radar WHERE id % 2 = 0 AND id % 3 > 0), known AS (SELECT * FROM radar WHERE id % 11 = 0)
    SELECT (SELECT count(*) FROM radar) AS discovered, (SELECT count(*) FROM ok WHERE id % 11 > 0) AS recorded, (SELECT count(*) FROM radar) - (SELECT count(*) FROM ok WHERE id % 11 > 0) AS skipped""")
def radar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radar scenes found, recorded, and passed over, as known or not eligible."""
    radar = Domain(spark, sf_dir).radar.withColumn("orbit_direction", fn.known_orbit(F.col("orbit_direction")))
    mode = F.when(F.col("id") % 2 == 0, "IW").otherwise("EW")
    listing = radar.withColumns({"properties": F.create_map(F.lit("instrumentMode"), mode), "polarisations": F.when(F.col("id") % 3 > 0, F.array(F.lit("VV"))).otherwise(F.array(F.lit("HH")))})
    return scenes.discovered(radar.where("id % 11 = 0"), scenes.eligible_radar(listing), listing)[1]


@query("SELECT id, sensor, acquired_at FROM observation WHERE source_scene_id IN ('scene-7', 'scene-10', 'scene-none')")
def scene_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes by their names."""
    return scenes.by_id(Domain(spark, sf_dir).observation, "scene-7", "scene-10", "scene-none").select("id", "sensor", "acquired_at")


@query("""
    SELECT c_custkey AS id, c_custkey % 3 = 0 AS is_date, CASE WHEN c_custkey % 4 = 0 THEN 'optical' ELSE NULL END AS choice, CASE WHEN c_custkey % 100 BETWEEN 5 AND 90 THEN c_custkey % 100 END AS days FROM customer""")
def setting_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms, choices and ranges of settings given as text; what does not fit is null."""
    key = F.col("c_custkey")
    day = F.when(key % 3 == 0, "2026-01-02").when(key % 3 == 1, "2026-01-02\n").otherwise("x2026-01-02")
    kind = F.when(key % 4 == 0, "optical").otherwise("sonar")
    return Domain(spark, sf_dir).table("customer").select(key.alias("id"), fn.full_match(day, r"\d{4}-\d{2}-\d{2}").alias("is_date"), overrides.chosen(kind, "optical", "radar").alias("choice"), overrides.within((key % 100).cast("string"), 5, 90).alias("days"))


_Q = "(1 - {e2}) * (sin(radians({x})) / (1 - {e2} * power(sin(radians({x})), 2)) - ln((1 - {e} * sin(radians({x}))) / (1 + {e} * sin(radians({x})))) / (2 * {e}))"
_Q_OF = lambda x: _Q.format(x=x, e2=repr(geometry._E2), e=repr(geometry._E))


@query(f"""
    SELECT id, round(abs({_Q_OF('(y1 / 10.0 - 21)')} - {_Q_OF('(y0 / 10.0 - 21)')}) * radians((x1 - x0) / 10.0) * {geometry.A * geometry.A / 2!r} / 1000000, 3) AS area_km2 FROM candidate""")
def candidate_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas on the ellipsoid of boxes whose units are tenths of a degree."""
    lat = lambda c: F.col(c) / 10.0 - 21
    area = geometry.cell_area_m2(lat("y0"), lat("y1"), (F.col("x1") - F.col("x0")) / 10.0)
    return Domain(spark, sf_dir).candidate.select("id", F.round(area / 1000000, 3).alias("area_km2"))


@query("""
    SELECT id, concat('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[', x0, '.0,', y0, '.0],[', x1, '.0,', y0, '.0],[', x1, '.0,', y1, '.0],[', x0, '.0,', y1, '.0],[', x0, '.0,', y0, '.0]]]},"properties":{"id":', id, ',"status":"', status, '"}}') AS feature FROM event""")
def event_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as GeoJSON features."""
    feature = geojson.feature_json(views.box_geometry(), F.struct("id", "status"))
    return Domain(spark, sf_dir).event.select("id", feature.alias("feature"))


@query("""
    SELECT concat('{"type":"FeatureCollection","features":[', string_agg(concat('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[', x0, '.0,', y0, '.0],[', x1, '.0,', y0, '.0],[', x1, '.0,', y1, '.0],[', x0, '.0,', y1, '.0],[', x0, '.0,', y0, '.0]]]},"properties":{"id":"', id, '","kind":"', kind, '","name":"', name, '"}}'), ',' ORDER BY id), ']}') AS collection
    FROM (SELECT f.*, kind FROM context_feature f JOIN context_layer l ON l.id = layer_id WHERE layer_id = 2) q""")
def layer_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One layer's features with their geometry, as a collection."""
    d = Domain(spark, sf_dir)
    layer = d.context_feature.where("layer_id = 2").join(d.context_layer.select(F.col("id").alias("layer_id"), "kind"), "layer_id")
    feature = geojson.feature_json(views.box_geometry(), F.struct(F.col("id").cast("string").alias("id"), "kind", "name"))
    return geojson.feature_collection(layer.select("id", feature.alias("feature")), "feature", "id")


@query("""
    SELECT r.id, r.status, r.started_at, a.name AS area, m.name AS methodology, count(e.id) AS lines, CAST(coalesce(sum(exports) FILTER (WHERE outcome = 'succeeded'), 0) AS BIGINT) AS exported,
           count(*) FILTER (WHERE outcome = 'failed') AS failed, arg_max(exports, e.id) FILTER (WHERE exports IS NOT NULL) AS latest_batch
    FROM run r LEFT JOIN aoi a ON a.id = r.aoi_id LEFT JOIN methodology m ON m.id = r.methodology_id LEFT JOIN run_event e ON e.run_id = r.id GROUP BY ALL""")
def run_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return views.run_detail(d.run, d.run_event, d.aoi, d.methodology).select("id", "status", "started_at", "area", "methodology", "lines", "exported", "failed", "latest_batch")


@query("""
    SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN concat('https://***@host/', CAST(n_nationkey AS VARCHAR)) WHEN n_nationkey % 4 = 1 THEN CAST(n_nationkey * 10 AS VARCHAR) ELSE CAST(n_regionkey AS VARCHAR) END AS value,
           CASE WHEN n_nationkey % 5 = 0 THEN 'override' WHEN n_nationkey % 4 = 1 THEN 'environment' ELSE 'default' END AS source, CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_regionkey + 1 AS VARCHAR) END AS recorded FROM nation""")
def settings_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with their value, the layer it comes from, credentials left out, and what the latest methodology records."""
    rows = Domain(spark, sf_dir).table("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"), F.col("n_regionkey").cast("string").alias("default_value"))
    number = F.col("key").cast("string")
    given = rows.select("name", F.when(F.col("key") % 5 == 0, F.concat(F.lit("https://me:pw@host/"), number)).otherwise(" ").alias("override"))
    known = rows.select("name", "default_value", F.when(F.col("key") % 4 == 1, (F.col("key") * 10).cast("string")).alias("environment"))
    recorded = rows.where("key % 3 = 0").select("name", (F.col("default_value").cast("long") + 1).cast("string").alias("recorded"))
    return overrides.catalogue(known, given, recorded).orderBy("name")


@query("""
    SELECT e.id AS event_id, e.status, (SELECT count(*) FROM event_observation m JOIN candidate c ON c.id = m.candidate_id JOIN change_raster r ON r.id = c.change_raster_id WHERE m.event_id = e.id) AS steps,
           (SELECT string_agg(opinion, ',' ORDER BY id DESC) FROM review r WHERE r.event_id = e.id) AS opinions FROM event e""")
def event_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything about an event in one record; here its lists are shown by their lengths and opinions."""
    from landshift.plans.reports import QUERIES as reports

    d = Domain(spark, sf_dir)
    features = views.event_features(d.event, d.event_observation, d.review, d.assessment, 900.0)
    out = views.event_detail(features, reports["event_context"](spark, sf_dir), views.timeline(d.event_observation, d.candidate, d.change_raster), d.review)
    opinions = F.array_join(F.transform("reviews", lambda r: r["opinion"]), ",")
    return out.select("event_id", "status", F.coalesce(F.size("timeline"), F.lit(0)).cast("long").alias("steps"), opinions.alias("opinions"))


@query("""
    SELECT a.id AS event_id, b.id AS feature_id, round(30 * 3600 * sqrt(power(greatest(0, a.x0 - b.x1, b.x0 - a.x1) * cos(radians((a.y0 + a.y1) / 7200.0)), 2) + power(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2)) / 3600, 3) AS arc_seconds
    FROM event a JOIN context_feature b ON a.aoi_id = b.id % 25 AND greatest(a.x0, b.x0) <= least(a.x1, b.x1) + 10 AND greatest(a.y0, b.y0) <= least(a.y1, b.y1) + 10""".replace("30 * 3600 * ", "30.0E0 * ").replace(" / 3600, 3)", ", 3)"))
def nearby_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites near events of the same area, in arc seconds; longitudes shrink with latitude."""
    from landshift.operators.boxes import near_pairs

    d = Domain(spark, sf_dir)
    box = ("x0", "y0", "x1", "y1")
    events = d.event.select("id", "aoi_id", *box)
    sites = d.context_feature.select("id", (F.col("id") % 25).alias("aoi_id"), *box)
    pairs = near_pairs(events, sites, ("aoi_id",), within=15.0)
    gap = lambda lo, hi: F.greatest(F.lit(0), F.col(f"l_{lo}") - F.col(f"r_{hi}"), F.col(f"r_{lo}") - F.col(f"l_{hi}"))
    dx, dy = gap("x0", "x1"), gap("y0", "y1")
    arc = 30.0 * F.sqrt(F.pow(dx * F.cos(F.radians((F.col("l_y0") + F.col("l_y1")) / 7200.0)), 2) + F.pow(dy.cast("double"), 2))
    return pairs.where((dx <= 10) & (dy <= 10)).select(F.col("l_id").alias("event_id"), F.col("r_id").alias("feature_id"), F.round(arc, 3).alias("arc_seconds"))


_RUN = """
    every AS (SELECT * FROM observation WHERE acquired_at < TIMESTAMP '1998-01-01'),
    ok AS (SELECT * FROM every WHERE id % 50 <> 7),
    wanted AS (SELECT * FROM ok WHERE acquired_at >= TIMESTAMP '1997-01-01'),
    opt AS (SELECT * FROM ok WHERE sensor <> 'S1GRD'), rad AS (SELECT * FROM ok WHERE sensor = 'S1GRD'),
    looked AS (SELECT observation_id, pixel, b_nir, b_swir2, (fmask & 2) = 0 AND (fmask & 8) = 0 AND (fmask & 16) = 0 AND ((fmask >> 6) & 3) <> 3 AS clear FROM raw_pixel JOIN opt ON id = observation_id),
    quality AS (SELECT observation_id, avg(CAST(clear AS INT)) AS fraction FROM looked GROUP BY observation_id),
    nbr AS (SELECT observation_id, pixel, CASE WHEN clear AND b_nir + b_swir2 <> 0 THEN (b_nir - b_swir2) / (b_nir + b_swir2) END AS v FROM looked),
    trail AS (SELECT a.id AS scene_id, b.id AS baseline_id, row_number() OVER (PARTITION BY a.id ORDER BY b.acquired_at DESC, b.id DESC) AS place
              FROM opt a JOIN opt b ON a.aoi_id = b.aoi_id AND b.acquired_at < a.acquired_at WHERE a.acquired_at >= TIMESTAMP '1997-01-01' QUALIFY place <= 5),
    echo AS (SELECT a.id AS scene_id, b.id AS baseline_id, row_number() OVER (PARTITION BY a.id ORDER BY b.acquired_at DESC, b.id DESC) AS place
             FROM rad a JOIN rad b ON a.aoi_id = b.aoi_id AND a.orbit_direction = b.orbit_direction AND b.acquired_at < a.acquired_at WHERE a.acquired_at >= TIMESTAMP '1997-01-01' QUALIFY place <= 5),
    base AS (SELECT scene_id, pixel, median(v) AS v FROM trail JOIN nbr ON observation_id = baseline_id GROUP BY scene_id, pixel),
    rbase AS (SELECT scene_id, pixel, median(vv) AS v FROM echo JOIN raw_pixel ON observation_id = baseline_id GROUP BY scene_id, pixel),
    hit AS MATERIALIZED (
        SELECT 1 AS m, b.scene_id AS scene, (b.pixel - b.pixel % 4) // 4 AS row, b.pixel % 4 AS col FROM base b JOIN nbr n ON n.observation_id = b.scene_id AND n.pixel = b.pixel
        JOIN forest_pixel f ON f.pixel = b.pixel AND treecover2000 >= 30 AND coalesce(lossyear, 0) = 0 WHERE n.v - b.v < -0.1
        UNION ALL SELECT 2, b.scene_id, (b.pixel - b.pixel % 4) // 4, b.pixel % 4 FROM rbase b JOIN raw_pixel p ON p.observation_id = b.scene_id AND p.pixel = b.pixel WHERE p.vv - b.v < -0.45),
    meet AS MATERIALIZED (SELECT a.scene, a.row * 4 + a.col AS u, b.row * 4 + b.col AS v FROM hit a JOIN hit b ON a.scene = b.scene AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
    spread AS (SELECT scene, row * 4 + col AS c, row * 4 + col AS seen FROM hit UNION SELECT w.scene, w.c, e.v FROM spread w JOIN meet e ON e.scene = w.scene AND e.u = w.seen),
    label AS (SELECT scene, c, min(seen) AS patch FROM spread GROUP BY scene, c),
    cand AS MATERIALIZED (SELECT h.scene * 1099511627776 + (patch - patch % 4) // 4 * 1048576 + patch % 4 AS id, m, o.aoi_id, h.scene, o.acquired_at AS seen_at, min(col) AS x0, min(row) AS y0, max(col) + 1 AS x1, max(row) + 1 AS y1
             FROM hit h JOIN label l ON l.scene = h.scene AND l.c = h.row * 4 + h.col JOIN ok o ON o.id = h.scene GROUP BY ALL),
    part AS MATERIALIZED (SELECT h.scene * 1099511627776 + (patch - patch % 4) // 4 * 1048576 + patch % 4 AS id, h.row, h.col FROM hit h JOIN label l ON l.scene = h.scene AND l.c = h.row * 4 + h.col),
    edge AS MATERIALIZED (SELECT DISTINCT a.id AS u, b.id AS v FROM cand a JOIN cand b ON a.aoi_id = b.aoi_id AND a.m = b.m AND (a.seen_at, a.id) > (b.seen_at, b.id) JOIN part p ON p.id = a.id JOIN part q ON q.id = b.id AND abs(p.row - q.row) <= 1 AND abs(p.col - q.col) <= 1),
    walk AS (SELECT id, id AS seen FROM cand UNION SELECT w.id, e.v FROM walk w JOIN edge e ON e.u = w.seen),
    track AS (SELECT w.id, arg_min(c.id, (c.seen_at, c.id)) AS event_id FROM walk w JOIN cand c ON c.id = w.seen GROUP BY w.id),
    ev AS (SELECT event_id AS id, any_value(aoi_id) AS aoi_id, CAST(any_value(m) AS BIGINT) AS methodology_id, count(*) AS members, min(seen_at) AS first_detected_at, max(seen_at) AS last_detected_at, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
           FROM track t JOIN cand c ON c.id = t.id GROUP BY event_id),
    state AS (SELECT *, CASE WHEN members = 1 THEN 'new' WHEN last_detected_at < TIMESTAMP '1998-01-15' - INTERVAL 90 DAY
                AND EXISTS (SELECT 1 FROM opt o JOIN quality q ON q.observation_id = o.id WHERE o.aoi_id = ev.aoi_id AND o.acquired_at > ev.last_detected_at AND fraction >= 0.5) THEN 'resolved' ELSE 'ongoing' END AS status FROM ev)"""


def _whole_run(spark: SparkSession, sf_dir: str):
    """A year of scenes, with what earlier runs left: scenes known, rasters stored; some exports fail."""
    from landshift.plans import run

    d = Domain(spark, sf_dir)
    since, until = datetime.datetime(1997, 1, 1), datetime.datetime(1998, 1, 1)
    at = F.col("acquired_at")
    every = d.observation.select("id", "aoi_id", "sensor", "orbit_direction", "acquired_at", "source_scene_id").where(at < F.lit(until))
    grid = (F.floor(F.col("pixel") / 4).cast("long").alias("row"), (F.col("pixel") % 4).alias("col"))
    pixels = d.raw_pixel.select("observation_id", *grid, F.col("b_red").alias("red"), F.col("b_nir").alias("nir"), F.col("b_swir2").alias("swir2"), "fmask", "vv")
    forest = d.forest_pixel.where("pixel < 8").select(*grid, "treecover2000", "lossyear", "landcover")
    files = d.raster_file.select("path")
    stored = d.index_raster.join(files, "path", "left_semi").select("observation_id", F.col("index_type").alias("product"))
    stored = stored.unionByName(d.change_raster.join(files, "path", "left_semi").select("observation_id", F.lit("delta_nbr").alias("product")))
    stored = stored.unionByName(d.radar.where("id % 3 = 0").select(F.col("id").alias("observation_id"), F.lit("delta_vv_db").alias("product")))
    features = d.context_feature.join(d.context_layer.select(F.col("id").alias("layer"), "kind"), F.col("layer_id") == F.col("layer")).select("id", "kind", "x0", "y0", "x1", "y1")
    given = run.Inputs(every, every.where((at < F.lit(since)) | (F.col("id") % 9 == 0)), pixels, forest, stored, every.where("id % 50 = 7").select(F.col("id").alias("observation_id")), features)
    p = run.Parameters(threshold=-0.1, vv_threshold=-0.45, min_area_m2=900.0, mask="hansen", context_m=600.0)
    return run.run(given, since, until, F.lit(datetime.datetime(1998, 1, 15)), p)


@query(f"""
    WITH RECURSIVE {_RUN}, changed AS (SELECT DISTINCT scene_id FROM trail), echoed AS (SELECT DISTINCT scene_id FROM echo), seen AS (SELECT * FROM every WHERE acquired_at >= TIMESTAMP '1997-01-01'),
    pair AS (SELECT a.id AS event_id, b.id AS feature_id, l.kind, sqrt(power(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + power(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2)) * 30 AS distance FROM ev a JOIN context_feature b ON true JOIN context_layer l ON l.id = b.layer_id)
    SELECT (SELECT count(*) FROM seen) AS observations_discovered, (SELECT count(*) FROM seen WHERE id % 9 > 0) AS observations_recorded, (SELECT count(*) FROM seen WHERE id % 9 = 0) AS observations_skipped,
           (SELECT 2 * count(*) FROM wanted WHERE sensor <> 'S1GRD') AS index_rasters, (SELECT count(*) FROM wanted w JOIN index_raster i ON i.observation_id = w.id JOIN raster_file f ON f.path = i.path) AS index_rasters_reused,
           (SELECT 2 * count(*) FROM changed) AS change_rasters, (SELECT count(*) FROM changed w JOIN change_raster i ON i.observation_id = w.scene_id JOIN raster_file f ON f.path = i.path) AS change_rasters_reused,
           (SELECT count(*) FROM echoed) AS radar_change_rasters, (SELECT count(*) FROM echoed WHERE scene_id % 3 = 0) AS radar_change_rasters_reused,
           (SELECT count(*) FROM cand WHERE m = 1) AS candidates, (SELECT count(*) FROM cand WHERE m = 2) AS radar_candidates, (SELECT count(*) FROM ev) AS events_created, (SELECT count(*) FROM track) AS event_observations,
           (SELECT count(*) FROM seen WHERE id % 50 = 7) AS export_failures, (SELECT count(*) FROM state WHERE status = 'resolved') AS events_resolved, (SELECT count(*) FROM ev) AS confidence_assessments,
           (SELECT count(*) FROM pair WHERE distance = 0) + (SELECT count(*) FROM (SELECT DISTINCT event_id, kind FROM pair WHERE distance > 0 AND distance <= 600) q) AS context_relations""")
def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a whole run."""
    return _whole_run(spark, sf_dir).summary


@query(f"WITH RECURSIVE {_RUN} SELECT id, aoi_id, methodology_id, status, members, first_detected_at, last_detected_at, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1 FROM state")
def full_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a whole run."""
    return _whole_run(spark, sf_dir).events.select("id", "aoi_id", "methodology_id", "status", "members", "first_detected_at", "last_detected_at", "x0", "y0", "x1", "y1")
