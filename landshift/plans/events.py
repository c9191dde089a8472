"""Queries over candidates, events, their confidence, trajectory and context."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.functions import text as fn
from landshift.operators import boxes, catalog, confidence, context, tracking, trajectory
from landshift.plans.bindings import Domain, oracle
from landshift.plans.imagery import _PIX, masked_pixels

QUERIES: dict = {}
ORACLES: dict = {}
NOW = datetime.datetime(2001, 9, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


_MEET = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"


@query(f"""
    SELECT a.id AS left_id, b.id AS right_id FROM candidate a JOIN candidate b ON a.aoi_id = b.aoi_id AND a.methodology_id = b.methodology_id AND a.id < b.id AND {_MEET}""")
def touching_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes that meet; equal boxes are compared once."""
    c = boxes.listed(Domain(spark, sf_dir).candidate, "aoi_id", "methodology_id", "x0", "y0", "x1", "y1")
    pairs = boxes.spelled(boxes.near_pairs(c, c, ("aoi_id", "methodology_id"))).where("l_id < r_id")
    return pairs.select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"))


@query("SELECT c.id, c.detected_at, row_number() OVER (PARTITION BY aoi_id ORDER BY detected_at, c.id) AS place FROM candidate c WHERE NOT EXISTS (SELECT 1 FROM event_observation e WHERE e.candidate_id = c.id)")
def untracked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = Domain(spark, sf_dir)
    order = Window.partitionBy("aoi_id").orderBy("detected_at", "id")
    return tracking.untracked(d.candidate, d.event_observation).select("id", "detected_at", F.row_number().over(order).cast("long").alias("place"))


@query(f"""
    SELECT candidate_id, event_id FROM (
        SELECT a.id AS candidate_id, b.id AS event_id, row_number() OVER (PARTITION BY a.id ORDER BY b.first_detected_at, b.id) AS n
        FROM candidate a JOIN event b ON a.aoi_id = b.aoi_id AND a.methodology_id = b.methodology_id AND {_MEET}) q WHERE n = 1""")
def earliest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return tracking.earliest_touching(d.candidate, d.event)


_TRACK = f"""
    edge AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM candidate a JOIN candidate b ON a.aoi_id = b.aoi_id AND a.methodology_id = b.methodology_id AND (a.detected_at, a.id) > (b.detected_at, b.id) AND {_MEET}),
    walk AS (SELECT id, id AS seen FROM candidate UNION SELECT w.id, e.v FROM walk w JOIN edge e ON e.u = w.seen),
    track AS (SELECT w.id AS candidate_id, arg_min(c.id, (c.detected_at, c.id)) AS event_id FROM walk w JOIN candidate c ON c.id = w.seen GROUP BY w.id)"""


@query(f"WITH RECURSIVE {_TRACK} SELECT candidate_id, event_id, aoi_id, methodology_id FROM track JOIN candidate ON id = candidate_id")
def tracked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy tracking of all candidates; tests also hold it against a plain loop."""
    d = Domain(spark, sf_dir)
    members = tracking.tracked(d.candidate)
    return members.join(d.candidate.select(F.col("id").alias("candidate_id"), "aoi_id", "methodology_id"), "candidate_id")


@query(f"""
    WITH RECURSIVE held AS (SELECT e.event_id, c.*, min(c.detected_at) OVER (PARTITION BY e.event_id) AS first_at FROM event_observation e JOIN candidate c ON c.id = e.candidate_id),
    fresh AS (SELECT * FROM candidate WHERE id % 12 = 0),
    edge AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM fresh a JOIN fresh b ON a.aoi_id = b.aoi_id AND a.methodology_id = b.methodology_id AND (a.detected_at, a.id) > (b.detected_at, b.id) AND {_MEET}
             UNION ALL SELECT a.id, b.id FROM fresh a JOIN held b ON a.aoi_id = b.aoi_id AND a.methodology_id = b.methodology_id AND {_MEET}),
    walk AS (SELECT id, id AS seen FROM fresh UNION SELECT w.id, e.v FROM walk w JOIN edge e ON e.u = w.seen),
    source AS (SELECT id, event_id, first_at AS at FROM held UNION ALL SELECT id, id, detected_at FROM fresh WHERE id NOT IN (SELECT u FROM edge))
    SELECT w.id AS candidate_id, arg_min(s.event_id, (s.at, s.event_id)) AS event_id FROM walk w JOIN source s ON s.id = w.seen GROUP BY w.id""")
def late_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that no event has yet, of any date, beside the events there are."""
    d = Domain(spark, sf_dir)
    return tracking.extended(d.candidate, d.event_observation.select("event_id", "candidate_id"), d.candidate.where("id % 12 = 0"))


@query("""
    WITH cells AS (SELECT c.id AS candidate_id, x AS col, y AS row FROM (SELECT id, y0, y1, unnest(range(x0, x1)) AS x FROM candidate) c, LATERAL (SELECT unnest(range(c.y0, c.y1)) AS y) t),
    m AS (SELECT event_id, candidate_id, row_number() OVER (PARTITION BY event_id ORDER BY observed_at, candidate_id) AS place FROM event_observation),
    f AS (SELECT event_id, place, count(*) AS n FROM (SELECT event_id, row, col, min(place) AS place FROM m JOIN cells USING (candidate_id) GROUP BY event_id, row, col) q GROUP BY event_id, place)
    SELECT m.event_id, m.candidate_id, CASE WHEN m.place > 1 THEN 900.0E0 * coalesce(f.n, 0) END AS growth_m2 FROM m LEFT JOIN f ON f.event_id = m.event_id AND f.place = m.place""")
def footprint_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area each measurement adds to its event's footprint."""
    d = Domain(spark, sf_dir)
    members = d.event_observation.select("event_id", "candidate_id", F.col("observed_at").alias("detected_at"))
    return tracking.growth(members, _cells(d), 900.0)


def _cells(d: Domain) -> DataFrame:
    """(candidate_id, row, col): the cells of each candidate's box."""
    rows = d.candidate.select(F.col("id").alias("candidate_id"), "y0", "y1", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("col"))
    return rows.select("candidate_id", "col", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("row"))


@query("""
    SELECT e.id AS event_id, CASE WHEN status = 'ongoing' AND last_detected_at < TIMESTAMP '2001-09-01' - INTERVAL 90 DAY AND EXISTS (
        SELECT 1 FROM observation o JOIN quality_mask q ON q.observation_id = o.id WHERE o.aoi_id = e.aoi_id AND o.acquired_at > e.last_detected_at AND valid_pixel_fraction >= 0.5)
        THEN 'resolved' ELSE status END AS status FROM event e""")
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return tracking.resolved(d.event, d.observation, d.quality_mask, F.lit(NOW)).select(F.col("id").alias("event_id"), "status")


@query("""
    SELECT event_id, min(delta_min) AS delta_min, round(avg(delta_mean), 6) AS delta_mean, round(avg(valid_pixel_fraction), 6) AS mean_valid_fraction, count(*) AS measurements
    FROM event_observation e JOIN candidate c ON c.id = e.candidate_id GROUP BY event_id""")
def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    out = confidence.event_stats(d.event_observation, d.candidate)
    return out.withColumns({c: F.round(c, 6) for c in ("delta_mean", "mean_valid_fraction")})


@query("""
    SELECT event_id, string_agg(DISTINCT s.kind, ',' ORDER BY s.kind) AS kinds FROM event_observation e JOIN candidate c ON c.id = e.candidate_id
    JOIN observation o ON o.id = c.change_raster_id JOIN sensor_source s ON s.name = o.sensor GROUP BY event_id""")
def sensor_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    kinds = confidence.own_kinds(d.event_observation, d.candidate, d.observation, d.sensor_source)
    return kinds.select("event_id", F.array_join("kinds", ",").alias("kinds"))


_KINDS = """
    kinds AS (SELECT event_id, min(s.kind) AS kind FROM event_observation e JOIN candidate c ON c.id = e.candidate_id JOIN observation o ON o.id = c.change_raster_id
              JOIN sensor_source s ON s.name = o.sensor GROUP BY event_id HAVING count(DISTINCT s.kind) = 1),
    own AS (SELECT a.*, k.kind AS own_kind, CASE k.kind WHEN 'optical' THEN 'radar' WHEN 'radar' THEN 'optical' END AS other FROM event a LEFT JOIN kinds k ON k.event_id = a.id),
    looks AS (SELECT own.id AS event_id, count(*) AS n FROM own JOIN observation o ON o.aoi_id = own.aoi_id JOIN sensor_source s ON s.name = o.sensor AND s.kind = own.other
              WHERE o.acquired_at BETWEEN first_detected_at - INTERVAL 30 DAY AND last_detected_at + INTERVAL 30 DAY GROUP BY own.id),
    met AS (SELECT a.id AS event_id, count(*) AS n FROM own a JOIN candidate b ON a.aoi_id = b.aoi_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1
            JOIN observation o ON o.id = b.change_raster_id JOIN sensor_source s ON s.name = o.sensor AND s.kind = a.other
            WHERE b.detected_at BETWEEN a.first_detected_at - INTERVAL 30 DAY AND a.last_detected_at + INTERVAL 30 DAY GROUP BY a.id),
    agree AS (SELECT own.id AS event_id, coalesce(l.n, 0) AS other_observations, coalesce(m.n, 0) AS matches,
              CASE WHEN own_kind IS NULL THEN NULL WHEN coalesce(m.n, 0) > 0 THEN 1.0E0 WHEN coalesce(l.n, 0) > 0 THEN 0.0E0 END AS agreement,
              CASE WHEN own_kind IS NULL THEN NULL WHEN coalesce(m.n, 0) > 0 THEN 'both' ELSE concat(own_kind, '-only') END AS basis
              FROM own LEFT JOIN looks l ON l.event_id = own.id LEFT JOIN met m ON m.event_id = own.id)"""


def _agreement(d: Domain) -> DataFrame:
    kinds = confidence.own_kinds(d.event_observation, d.candidate, d.observation, d.sensor_source)
    looks = d.observation.join(d.sensor_source, F.col("sensor") == F.col("name"))
    seen = d.candidate.join(looks.select(F.col("id").alias("o_id"), "kind"), F.col("change_raster_id") == F.col("o_id"))
    return confidence.agreement(d.event, kinds, looks, seen)


@query(f"WITH {_KINDS} SELECT * FROM agree")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agreement(Domain(spark, sf_dir))


_TRAJ = f"""{_PIX},
    area AS (SELECT e.id AS event_id, e.aoi_id, strftime(first_detected_at, '%Y-%m-%d') AS detected, (e.id + k) % 8 AS pixel FROM event e, (VALUES (0), (1), (2)) AS v(k)),
    sample AS (SELECT event_id, detected, p.observation_id, strftime(o.acquired_at, '%Y-%m-%d') AS date, avg(nbr) AS mean, count(nbr) AS valid, count(*) AS total
               FROM pix p JOIN optical o ON o.id = p.observation_id JOIN area a ON a.aoi_id = o.aoi_id AND a.pixel = p.pixel GROUP BY ALL),
    point AS (SELECT event_id, detected, date, sum(mean * valid) / sum(valid) AS mean, CAST(sum(valid) AS DOUBLE) / sum(total) AS fraction FROM sample GROUP BY event_id, detected, date HAVING sum(valid) / sum(total) >= 0.3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id, date > detected ORDER BY date DESC) AS n FROM point),
    parts AS (SELECT event_id, avg(CASE WHEN date < detected THEN mean END) AS reference, max(CASE WHEN date = detected THEN mean END) AS detection, avg(CASE WHEN date > detected AND n <= 3 THEN mean END) AS recent FROM ranked GROUP BY event_id),
    state AS (SELECT e.id AS event_id, reference, detection, recent, CASE WHEN reference - detection > 0 AND recent IS NOT NULL THEN
                CASE WHEN (recent - detection) / (reference - detection) >= 0.8 THEN 'transient' WHEN (recent - detection) / (reference - detection) <= 0.3 THEN 'persistent' ELSE 'recovering' END
                ELSE 'insufficient-data' END AS state FROM event e LEFT JOIN parts p ON p.event_id = e.id)"""


def _points(d: Domain) -> DataFrame:
    cells = d.event.select(F.col("id").alias("event_id"), F.explode(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: (F.col("id") + k) % 8)).alias("cell"))
    pixels = masked_pixels(d).select("observation_id", "pixel", "nbr")
    return trajectory.series(trajectory.footprint_samples(d.event, d.optical, pixels, cells))


@query(f"WITH {_TRAJ} SELECT event_id, date, round(mean, 6) AS mean, round(fraction, 6) AS fraction FROM point")
def trajectory_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(Domain(spark, sf_dir)).select("event_id", "date", F.round("mean", 6).alias("mean"), F.round("fraction", 6).alias("fraction"))


@query(f"WITH {_TRAJ} SELECT event_id, round(reference, 6) AS reference, round(detection, 6) AS detection, round(recent, 6) AS recent, state FROM state")
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    out = trajectory.classified(d.event, _points(d))
    return out.withColumns({c: F.round(c, 6) for c in ("reference", "detection", "recent")})


def _assessed(d: Domain) -> DataFrame:
    stats = confidence.event_stats(d.event_observation, d.candidate)
    states = trajectory.classified(d.event, _points(d)).select("event_id", "state")
    rows = d.event.select(F.col("id").alias("event_id"), "last_detected_at").join(stats, "event_id").join(_agreement(d).select("event_id", "agreement"), "event_id").join(states, "event_id")
    days = fn.days_between(F.col("last_detected_at"), F.lit(NOW))
    return confidence.weighted(rows.withColumns({
        "magnitude": confidence.magnitude(F.col("delta_min")), "persistence": confidence.persistence(F.col("measurements")), "coverage": fn.clamped(F.col("mean_valid_fraction")),
        "currency": confidence.currency(days), "stability": confidence.stability(F.col("state")),
    }))


_SCORE = f"""{_KINDS}, {_TRAJ},
    stat AS (SELECT event_id, min(delta_min) AS d, avg(valid_pixel_fraction) AS f, count(*) AS n FROM event_observation e JOIN candidate c ON c.id = e.candidate_id GROUP BY event_id),
    sub AS (SELECT e.id AS event_id, greatest(0, least(1, (abs(d) - 0.1) / 0.4)) AS magnitude, greatest(0, least(1, (n - 1) / 4.0)) AS persistence, CASE WHEN f IS NOT NULL THEN greatest(0, least(1, f)) END AS coverage,
            greatest(0, least(1, 1 - greatest(0, epoch(TIMESTAMP '2001-09-01' - last_detected_at) / 86400) / 180.0)) AS currency, agreement,
            CASE state WHEN 'persistent' THEN 1.0 WHEN 'recovering' THEN 0.5 WHEN 'transient' THEN 0.0 END AS stability
            FROM event e JOIN stat ON stat.event_id = e.id JOIN agree a ON a.event_id = e.id JOIN state t ON t.event_id = e.id),
    mark AS (SELECT event_id, round(round((0.25 * coalesce(magnitude, 0) + 0.2 * coalesce(persistence, 0) + 0.1 * coalesce(coverage, 0) + 0.1 * coalesce(currency, 0) + 0.15 * coalesce(agreement, 0) + 0.2 * coalesce(stability, 0))
              / (CASE WHEN magnitude IS NULL THEN 0 ELSE 0.25 END + CASE WHEN persistence IS NULL THEN 0 ELSE 0.2 END + CASE WHEN coverage IS NULL THEN 0 ELSE 0.1 END + CASE WHEN currency IS NULL THEN 0 ELSE 0.1 END
              + CASE WHEN agreement IS NULL THEN 0 ELSE 0.15 END + CASE WHEN stability IS NULL THEN 0 ELSE 0.2 END), 9), 4) AS score,
              concat_ws(',', CASE WHEN agreement IS NULL THEN 'agreement' END, CASE WHEN coverage IS NULL THEN 'coverage' END, CASE WHEN currency IS NULL THEN 'currency' END,
              CASE WHEN magnitude IS NULL THEN 'magnitude' END, CASE WHEN persistence IS NULL THEN 'persistence' END, CASE WHEN stability IS NULL THEN 'stability' END) AS missing FROM sub),
    new AS (SELECT event_id, score, CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level, missing FROM mark)"""


@query(f"WITH {_SCORE} SELECT * FROM new")
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(Domain(spark, sf_dir)).select("event_id", "score", "level", "missing")


@query(f"""
    WITH {_SCORE}, last AS (SELECT event_id, level, score FROM assessment WHERE rule_version = 'v3' QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY id DESC) = 1)
    SELECT n.event_id, n.level, n.score FROM new n LEFT JOIN last l ON l.event_id = n.event_id WHERE l.event_id IS NULL OR l.level <> n.level OR round(CAST(l.score AS DECIMAL(9, 4)), 2) <> round(CAST(n.score AS DECIMAL(9, 4)), 2)""")
def moved_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessments to append: conclusions that moved since the last one under the same rule."""
    d = Domain(spark, sf_dir)
    return confidence.moved(_assessed(d).select("event_id", "level", "score"), d.assessment, "v3")


@query("""
    WITH pair AS (SELECT a.id AS event_id, b.id AS feature_id, l.kind, b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1 AS inside,
            sqrt(power(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + power(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2)) * 30 AS distance
            FROM event a JOIN context_feature b ON true JOIN context_layer l ON l.id = b.layer_id)
    SELECT event_id, feature_id, kind, CASE WHEN inside THEN 'contains' ELSE 'intersects' END AS relation, CAST(NULL AS DOUBLE) AS distance_m FROM pair WHERE distance = 0
    UNION ALL SELECT event_id, feature_id, kind, 'nearby', round(distance, 1) FROM pair WHERE distance > 0 AND distance <= 600 QUALIFY row_number() OVER (PARTITION BY event_id, kind ORDER BY distance, feature_id) = 1""")
def context_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    features = d.context_feature.join(d.context_layer.select(F.col("id").alias("layer"), "kind"), F.col("layer_id") == F.col("layer"))
    return context.relations(d.event.select("id", "x0", "y0", "x1", "y1"), features.select("id", "kind", "x0", "y0", "x1", "y1"), 600.0, 30.0)


@query("""
    SELECT id, methodology_id, area_m2 FROM candidate WHERE change_raster_id % 5 > 0 OR methodology_id <> 1
    UNION ALL SELECT id + 1000000000, 1, area_m2 + 1 FROM candidate WHERE change_raster_id % 5 = 0 AND change_raster_id % 10 > 0 AND methodology_id = 1""")
def candidates_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of re-extracted rasters give way to the new ones, of which a raster may have none."""
    c = Domain(spark, sf_dir).candidate.select("id", "change_raster_id", "methodology_id", "area_m2")
    scope = c.where("change_raster_id % 5 = 0 AND methodology_id = 1")
    new = scope.where("change_raster_id % 10 > 0").withColumns({"id": F.col("id") + 1000000000, "area_m2": F.col("area_m2") + 1})
    return catalog.replaced(c, new, scope, "change_raster_id", "methodology_id").select("id", "methodology_id", "area_m2")
