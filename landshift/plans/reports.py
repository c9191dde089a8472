"""Queries behind reports and the upkeep of the catalog."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.functions import hashes
from landshift.functions import text as fn
from landshift.operators import catalog, context, views
from landshift.plans.bindings import Domain, oracle

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


@query("""
    SELECT a.id, a.name, (SELECT count(*) FROM event e WHERE e.aoi_id = a.id) AS events, CASE WHEN a.id % 3 > 0 THEN concat('aois/', lower(a.name), '.geojson') END AS file, min_x, min_y, max_x, max_y
    FROM aoi a LEFT JOIN (SELECT aoi_id, min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y FROM candidate GROUP BY aoi_id) b ON b.aoi_id = a.id""")
def area_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    name = fn.sanitized(F.col("name"))
    files = d.aoi.where("id % 3 > 0").select(name.alias("name"), F.concat(F.lit("aois/"), name, F.lit(".geojson")).alias("file"))
    return views.area_listing(d.aoi, d.event, files, d.candidate)


@query("""
    SELECT aoi_id, CAST(acquired_at AS DATE) AS day, round(max(valid_pixel_fraction), 6) AS best_fraction, count(*) AS looks
    FROM observation o JOIN quality_mask q ON q.observation_id = o.id WHERE acquired_at >= TIMESTAMP '2001-08-01' - INTERVAL 366 DAY GROUP BY 1, 2""")
def quality_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    days = F.greatest(F.lit(1), F.least(F.lit(366), F.lit(500)))  # asked for 500
    since = F.lit(datetime.datetime(2001, 8, 1)) - F.make_interval(days=days)
    return views.quality_by_day(d.observation, d.quality_mask, since).withColumn("best_fraction", F.round("best_fraction", 6))


@query("""
    SELECT e.id AS event_id, e.aoi_id, status, (x1 - x0) * (y1 - y0) * 900.0E0 AS area_m2, m.observed_at, m.growth_m2, coalesce(n, 0) AS measurements, opinion, level, score, basis
    FROM event e LEFT JOIN (SELECT event_id, observed_at, growth_m2, count(*) OVER (PARTITION BY event_id) AS n FROM event_observation QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY observed_at DESC, id DESC) = 1) m ON m.event_id = e.id
    LEFT JOIN (SELECT event_id, opinion FROM review QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY id DESC) = 1) r ON r.event_id = e.id
    LEFT JOIN (SELECT event_id, level, score, inputs ->> '$.factors.agreement.basis' AS basis FROM assessment QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY id DESC) = 1) s ON s.event_id = e.id""")
def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return views.event_features(d.event, d.event_observation, d.review, d.assessment, 900.0)


@query("""
    SELECT r.id, r.aoi_id, r.started_at, r.status, r.methodology_id, r.geometry_hash, (SELECT max(occurred_at) FROM run_event e WHERE e.run_id = r.id) AS last_event_at, m.name AS methodology
    FROM run r LEFT JOIN methodology m ON m.id = r.methodology_id ORDER BY started_at DESC, r.id DESC LIMIT 20""")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return views.recent_runs(d.run, d.run_event, d.methodology)


@query("""
    SELECT run_id, CAST(coalesce(sum(exports) FILTER (WHERE outcome = 'succeeded'), 0) AS BIGINT) AS exported, count(*) FILTER (WHERE outcome = 'failed') AS failed,
           arg_max(exports, id) FILTER (WHERE exports IS NOT NULL) AS latest_batch FROM run_event GROUP BY run_id""")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.run_progress(Domain(spark, sf_dir).run_event)


@query("SELECT id, strftime(occurred_at, '%Y-%m-%dT%H:%M:%SZ') AS at, stage, outcome FROM run_event WHERE run_id = 7 ORDER BY id DESC LIMIT 50")
def run_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.run_tail(Domain(spark, sf_dir).run_event, 7)


@query("""
    SELECT id, CASE status WHEN 'running' THEN CASE WHEN lead(id) OVER w IS NOT NULL THEN 'interrupted' ELSE status END ELSE status END AS status_now,
           coalesce(lag(methodology_id) OVER w <> methodology_id, false) AS methodology_changed, coalesce(lag(geometry_hash) OVER w <> geometry_hash, false) AS geometry_changed
    FROM run WINDOW w AS (PARTITION BY aoi_id ORDER BY started_at, id)""")
def run_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_previous(Domain(spark, sf_dir).run).select("id", "status_now", "methodology_changed", "geometry_changed")


@query("""
    SELECT m.id, m.name, m.script, m.detection, (SELECT count(*) FROM run r WHERE r.methodology_id = m.id) AS runs, (SELECT max(started_at) FROM run r WHERE r.methodology_id = m.id) AS last_used_at FROM methodology m""")
def methodology_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return views.methodology_use(d.methodology, d.run)


@query("""
    SELECT id, name, concat('1.', CAST(minor AS VARCHAR), '.', CAST(row_number() OVER (PARTITION BY name, minor ORDER BY id) - 1 AS VARCHAR)) AS display_version
    FROM (SELECT *, sum(bump) OVER (PARTITION BY name ORDER BY id) AS minor FROM (SELECT *, CASE WHEN lag(script) OVER (PARTITION BY name ORDER BY id) <> script THEN 1 ELSE 0 END AS bump FROM methodology) a) b""".replace("CAST(minor AS VARCHAR)", "CAST(CAST(minor AS BIGINT) AS VARCHAR)"))
def method_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.versions(Domain(spark, sf_dir).methodology).select("id", "name", "display_version")


@query("""
    SELECT event_id AS id, concat('auto-', substr(sha256(concat('{"k":', k, ',"u":', CAST(user_id AS VARCHAR), '}')), 1, 10)) AS version, row_number() OVER (PARTITION BY k, user_id ORDER BY event_id) = 1 AS minted
    FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1) AS k FROM events) q""")
def content_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters are named by the hash of their canonical JSON; the first of a kind mints it, the others find it."""
    from pyspark.sql import Window

    rows = Domain(spark, sf_dir).table("events").select("event_id", F.create_map(F.lit("u"), F.col("user_id"), F.lit("k"), F.get_json_object("props", "$.k").cast("long")).alias("parameters"))
    version = F.concat(F.lit("auto-"), hashes.short_hash(hashes.canonical(F.col("parameters")), 10))
    rows = rows.select(F.col("event_id").alias("id"), version.alias("version"))
    return rows.withColumn("minted", F.row_number().over(Window.partitionBy("version").orderBy("id")) == 1)


@query("SELECT l.id, l.name, l.kind, count(f.id) AS features FROM context_layer l LEFT JOIN context_feature f ON f.layer_id = l.id GROUP BY ALL")
def layer_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return views.layer_registry(d.context_layer, d.context_feature)


@query("""
    SELECT f.id, layer_id, concat('{"name":"', f.name, '","id":"', CAST(f.id AS VARCHAR), '","kind":"', kind, '"}') AS properties FROM context_feature f JOIN context_layer l ON l.id = layer_id""")
def layer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return views.layer_features(d.context_feature, d.context_layer).withColumn("properties", F.to_json("properties"))


_RELATED = """
    pair AS (SELECT a.id AS event_id, b.id AS feature_id, l.kind, l.name AS layer, b.name, b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1 AS inside,
            sqrt(power(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + power(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2)) * 30 AS distance
            FROM event a JOIN context_feature b ON true JOIN context_layer l ON l.id = b.layer_id),
    rel AS (SELECT event_id, feature_id, layer, name, CASE WHEN inside THEN 'contains' ELSE 'intersects' END AS relation, CAST(NULL AS DOUBLE) AS distance_m FROM pair WHERE distance = 0
            UNION ALL SELECT event_id, feature_id, layer, name, 'nearby', round(distance, 1) FROM pair WHERE distance > 0 AND distance <= 600 QUALIFY row_number() OVER (PARTITION BY event_id, kind ORDER BY distance, feature_id) = 1)"""


@query(f"WITH {_RELATED} SELECT event_id, feature_id, layer, name, relation, distance_m, row_number() OVER (PARTITION BY event_id ORDER BY distance_m NULLS FIRST, feature_id) AS place FROM rel")
def event_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    features = d.context_feature.join(d.context_layer.select(F.col("id").alias("layer"), "kind"), F.col("layer_id") == F.col("layer")).select("id", "kind", "x0", "y0", "x1", "y1")
    relations = context.relations(d.event.select("id", "x0", "y0", "x1", "y1"), features, 600.0, 30.0)
    return views.event_context(relations, d.context_feature, d.context_layer)


@query("""
    SELECT e.event_id, e.candidate_id, e.observed_at, e.growth_m2, c.area_m2, c.delta_mean, r.path FROM event_observation e JOIN candidate c ON c.id = e.candidate_id JOIN change_raster r ON r.id = c.change_raster_id""")
def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return views.timeline(d.event_observation, d.candidate, d.change_raster)


@query("SELECT event_id, max(id) AS id, arg_max(opinion, id) AS opinion, count(*) AS opinions FROM review GROUP BY event_id")
def latest_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews are only ever added; the newest is the highest id."""
    reviews = Domain(spark, sf_dir).review
    counts = reviews.groupBy("event_id").agg(F.count("*").alias("opinions"))
    return catalog.latest(reviews, "event_id", F.col("id"), "id", "opinion").join(counts, "event_id")


@query("""
    SELECT a.id AS aoi_id, a.name, (SELECT count(*) FROM observation o WHERE o.aoi_id = a.id) AS observations, (SELECT count(*) FROM candidate c WHERE c.aoi_id = a.id) AS candidates,
           (SELECT count(*) FROM event e WHERE e.aoi_id = a.id) AS events, (SELECT count(*) FROM run r WHERE r.aoi_id = a.id) AS runs,
           (SELECT count(*) FROM index_raster i JOIN observation o ON o.id = i.observation_id WHERE o.aoi_id = a.id) AS rasters,
           (SELECT count(*) FROM change_raster i JOIN observation o ON o.id = i.observation_id WHERE o.aoi_id = a.id) AS changes,
           (SELECT count(*) FROM event_observation m JOIN event e ON e.id = m.event_id WHERE e.aoi_id = a.id) AS measurements,
           (SELECT count(*) FROM assessment m JOIN event e ON e.id = m.event_id WHERE e.aoi_id = a.id) AS assessments,
           (SELECT count(*) FROM review m JOIN event e ON e.id = m.event_id WHERE e.aoi_id = a.id) AS reviews FROM aoi a""")
def area_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    place, of = d.observation.select(F.col("id").alias("observation_id"), "aoi_id"), d.event.select(F.col("id").alias("event_id"), "aoi_id")
    rasters, changes = (t.select("observation_id").join(place, "observation_id") for t in (d.index_raster, d.change_raster))
    hanging = {n: t.select("event_id").join(of, "event_id") for n, t in (("measurements", d.event_observation), ("assessments", d.assessment), ("reviews", d.review))}
    return views.inventory(d.aoi, {"observations": d.observation, "candidates": d.candidate, "events": d.event, "runs": d.run, "rasters": rasters, "changes": changes, **hanging})


@query("""
    WITH o AS (SELECT id FROM observation WHERE aoi_id <> 3), c AS (SELECT id FROM candidate WHERE change_raster_id IN (SELECT id FROM o)), e AS (SELECT id FROM event WHERE aoi_id <> 3)
    SELECT 'observation' AS tab, count(*) AS kept FROM o UNION ALL SELECT 'candidate', count(*) FROM c UNION ALL SELECT 'event', count(*) FROM e
    UNION ALL SELECT 'event_observation', count(*) FROM event_observation WHERE candidate_id IN (SELECT id FROM c) UNION ALL SELECT 'assessment', count(*) FROM assessment WHERE event_id IN (SELECT id FROM e)""")
def area_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left per table after an area and all that hangs on it are deleted."""
    d = Domain(spark, sf_dir)
    area = d.aoi.where("id = 3").select("id")
    observations = catalog.without(d.observation, area, "aoi_id")
    events = catalog.without(d.event, area, "aoi_id")
    gone = d.observation.where("aoi_id = 3").select("id")
    candidates = catalog.without(d.candidate, gone, "change_raster_id")
    measured = catalog.without(d.event_observation, d.candidate.join(gone.select(F.col("id").alias("g")), F.col("change_raster_id") == F.col("g"), "left_semi"), "candidate_id")
    assessed = catalog.without(d.assessment, d.event.where("aoi_id = 3"), "event_id")
    tables = {"observation": observations, "candidate": candidates, "event": events, "event_observation": measured, "assessment": assessed}
    parts = [df.agg(F.count("*").alias("kept")).select(F.lit(n).alias("tab"), "kept") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
    SELECT id, observation_id, index_type, path FROM index_raster WHERE observation_id % 3 > 0 UNION ALL SELECT id, observation_id, index_type, concat(path, '.new') FROM index_raster WHERE observation_id % 3 = 0
    UNION ALL SELECT id + 1000000000, observation_id + 1000000000, index_type, path FROM index_raster WHERE observation_id % 6 = 0""")
def rasters_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = Domain(spark, sf_dir).index_raster.select("id", "observation_id", "index_type", "path")
    change = old.where("observation_id % 3 = 0").withColumn("path", F.concat("path", F.lit(".new")))
    fresh = old.where("observation_id % 6 = 0").withColumns({"id": F.col("id") + 1000000000, "observation_id": F.col("observation_id") + 1000000000})
    return catalog.upserted(old, change.unionByName(fresh), "observation_id", "index_type")


@query("""
    SELECT count(*) AS observations, count(DISTINCT aoi_id) AS areas, count(*) FILTER (WHERE sensor = 'S1GRD') AS radar, count(cloud_cover) AS with_cloud, round(avg(cloud_cover), 6) AS mean_cloud,
           (SELECT count(*) FROM candidate) AS candidates, (SELECT count(*) FROM event) AS events, (SELECT count(*) FROM event WHERE status = 'ongoing') AS ongoing,
           (SELECT count(*) FROM run_event WHERE outcome = 'failed') AS failures FROM observation""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    looks = d.observation.agg(F.count("*").alias("observations"), F.countDistinct("aoi_id").alias("areas"), F.count_if(F.col("sensor") == "S1GRD").alias("radar"), F.count("cloud_cover").alias("with_cloud"), F.round(F.avg("cloud_cover"), 6).alias("mean_cloud"))
    others = [d.candidate.agg(F.count("*").alias("candidates")), d.event.agg(F.count("*").alias("events"), F.count_if(F.col("status") == "ongoing").alias("ongoing")), d.run_event.agg(F.count_if(F.col("outcome") == "failed").alias("failures"))]
    for o in others:  # one row each
        looks = looks.crossJoin(o)
    return looks


@query("""
    SELECT c_custkey AS id, trim(regexp_replace(lower(c_name), '[^a-z0-9._-]+', '-', 'g'), '-') AS safe, split_part(c_name, '#', -1) AS last, CASE WHEN c_custkey % 3 > 0 THEN concat('k', CAST(c_custkey % 4 AS VARCHAR)) END AS kind,
           CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS shown, concat('https://***@host/', CAST(c_custkey AS VARCHAR)) AS url, TRY_CAST(CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE) AS number,
           CASE WHEN c_custkey % 6 = 0 OR c_custkey = 0 THEN 7 ELSE c_custkey END AS positive, greatest(0, least(1, c_acctbal / 10000)) AS share FROM customer""")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions over names: keys, segments, kinds, blanks, credentials, numbers."""
    c = Domain(spark, sf_dir).table("customer")
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    stem = F.when(key % 3 > 0, F.concat(F.lit("k"), (key % 4).cast("string"), F.lit("--a--b"))).otherwise(F.lit("nothing"))
    return c.select(
        key.alias("id"), fn.sanitized(F.concat(F.lit(" "), F.col("c_name"), F.lit("! "))).alias("safe"), fn.last_segment(F.regexp_replace("c_name", "#", "/")).alias("last"), fn.kind_and_name(stem)["kind"].alias("kind"),
        fn.blank_to_null(F.when(key % 5 > 0, F.col("c_mktsegment")).otherwise("  ")).alias("shown"), fn.without_credentials(F.concat(F.lit("https://me:pw@host/"), text)).alias("url"),
        fn.number_or_null(F.when(key % 4 == 0, "x").otherwise(F.col("c_acctbal").cast("string"))).alias("number"), fn.positive_or(F.when(key % 6 == 0, "-3").otherwise(text), 7).alias("positive"), fn.clamped(F.col("c_acctbal") / 10000).alias("share"),
    )


@query("""
    SELECT id, epoch_ms(CAST(epoch(acquired_at) AS BIGINT) * 1000) AS moment, strftime(acquired_at, '%Y-%m-%d') AS day, strftime(acquired_at, '%Y-%m-%dT%H:%M:%SZ') AS stamp,
           greatest(0, date_diff('second', acquired_at, TIMESTAMP '2000-01-01') / 86400) AS days, acquired_at + INTERVAL 30 DAY AS later FROM observation""")
def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("acquired_at")
    ms = F.unix_millis(at.cast("timestamp"))
    return Domain(spark, sf_dir).observation.select("id", fn.from_epoch_ms(ms).cast("timestamp_ntz").alias("moment"), fn.utc_date(at).alias("day"), fn.stamp(at).alias("stamp"), fn.days_between(at, F.lit(datetime.datetime(2000, 1, 1))).alias("days"), (at + F.expr("INTERVAL 30 DAYS")).alias("later"))


@query("""
    SELECT e.id, coalesce(o.k, e.k, 50) AS value, CASE WHEN o.k IS NOT NULL THEN 'override' WHEN e.k IS NOT NULL THEN 'environment' ELSE 'default' END AS source
    FROM (SELECT id, CASE WHEN id % 4 > 0 THEN exports END AS k FROM run_event) e LEFT JOIN (SELECT id, exports AS k FROM run_event WHERE id % 5 = 0) o ON o.id = e.id""")
def layered_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Override before environment before default, with the layer that decided."""
    log = Domain(spark, sf_dir).run_event
    override, environment = F.when(F.col("id") % 5 == 0, F.col("exports")), F.when(F.col("id") % 4 > 0, F.col("exports"))
    value = fn.resolved(("override", override), ("environment", environment), ("default", F.lit(50).cast("long")))
    return log.select("id", value["value"].alias("value"), value["source"].alias("source"))


@query("""
    SELECT a.event_id AS id, concat_ws(',', CASE WHEN ka <> kb THEN 'k' END, CASE WHEN a.event_id % 2 = 0 THEN 'u' END, 'v') AS changed
    FROM (SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS ka FROM events) a JOIN (SELECT event_id - 1 AS event_id, regexp_extract(props, '([0-9]+)', 1) AS kb FROM events) b ON a.event_id = b.event_id""")
def parameter_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in which two sets of parameters differ."""
    events = Domain(spark, sf_dir).table("events")
    k = F.get_json_object("props", "$.k").cast("long")
    old = events.select("event_id", F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), k, F.lit("u"), F.lit(1).cast("long"))).otherwise(F.create_map(F.lit("k"), k)).alias("a"))
    new = events.select((F.col("event_id") - 1).alias("event_id"), F.create_map(F.lit("k"), k, F.lit("v"), F.lit(2).cast("long")).alias("b"))
    rows = old.join(new, "event_id")
    return rows.select(F.col("event_id").alias("id"), F.array_join(catalog.parameter_changes(F.col("a"), F.col("b")), ",").alias("changed"))
