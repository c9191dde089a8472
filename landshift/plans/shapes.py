"""Queries over footprints of cells and over polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.functions.geometry import polygon_area_m2
from landshift.operators import components, confidence, context, footprints, polygons, raster, rings, tracking
from landshift.plans.bindings import Domain, oracle
from landshift.plans.events import _KINDS
from landshift.sources.shared import written

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


#: Cells one by one, and the cells around each; closed cells intersect where one is among those around the other.
_CELLS = """
    cell_of AS MATERIALIZED (SELECT candidate_id, row, unnest(range(c0, c1)) AS col FROM footprint),
    around AS (SELECT candidate_id, row + dr AS row, col + dc AS col FROM cell_of, (VALUES (-1), (0), (1)) AS r(dr), (VALUES (-1), (0), (1)) AS c(dc))"""
_EVENT_CELLS = f"""{_CELLS},
    event_cell AS MATERIALIZED (SELECT DISTINCT event_id, row, col FROM event_observation JOIN cell_of USING (candidate_id))"""


def _event_runs(d: Domain) -> DataFrame:
    return tracking.event_footprints(d.event_observation.select("event_id", "candidate_id"), d.footprint)


@query(f"""
    WITH {_CELLS} SELECT DISTINCT a.candidate_id AS left_id, b.candidate_id AS right_id FROM around a JOIN cell_of b ON a.row = b.row AND a.col = b.col
    JOIN candidate x ON x.id = a.candidate_id JOIN candidate y ON y.id = b.candidate_id WHERE a.candidate_id < b.candidate_id AND x.aoi_id = y.aoi_id AND x.methodology_id = y.methodology_id""")
def touching_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one area and methodology whose cells share an edge or a corner."""
    d = Domain(spark, sf_dir)
    same = ("aoi_id", "methodology_id")
    runs = d.footprint.withColumnRenamed("candidate_id", "id").join(d.candidate.select("id", *same), "id")
    pairs = footprints.touching_lists(runs, same).where("l_id < r_id")
    return pairs.select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"))


_LINKS = """
    near AS MATERIALIZED (SELECT DISTINCT a.candidate_id AS u, b.candidate_id AS v FROM around a JOIN cell_of b ON a.row = b.row AND a.col = b.col
        JOIN candidate x ON x.id = a.candidate_id JOIN candidate y ON y.id = b.candidate_id AND x.aoi_id = y.aoi_id AND x.methodology_id = y.methodology_id WHERE x.id <> y.id),
    edge AS MATERIALIZED (SELECT u, v FROM near JOIN candidate a ON a.id = u JOIN candidate b ON b.id = v WHERE (a.detected_at, a.id) > (b.detected_at, b.id))"""


@query(f"""
    WITH RECURSIVE {_CELLS}, {_LINKS}, walk AS (SELECT id, id AS seen FROM candidate UNION SELECT w.id, e.v FROM walk w JOIN edge e ON e.u = w.seen)
    SELECT w.id AS candidate_id, arg_min(c.id, (c.detected_at, c.id)) AS event_id FROM walk w JOIN candidate c ON c.id = w.seen GROUP BY w.id""")
def tracked_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy tracking by cells: shapes that only reach into each other's boxes stay two events."""
    d = Domain(spark, sf_dir)
    return tracking.tracked(d.candidate, d.footprint)


@query(f"""
    WITH RECURSIVE {_CELLS}, {_LINKS},
    held AS (SELECT e.event_id, c.id, min(c.detected_at) OVER (PARTITION BY e.event_id) AS first_at FROM event_observation e JOIN candidate c ON c.id = e.candidate_id),
    fresh AS (SELECT * FROM candidate WHERE id % 12 = 0),
    step AS MATERIALIZED (SELECT u, v FROM edge JOIN fresh a ON a.id = u JOIN fresh b ON b.id = v UNION ALL SELECT u, v FROM near JOIN fresh a ON a.id = u JOIN held b ON b.id = v),
    walk AS (SELECT id, id AS seen FROM fresh UNION SELECT w.id, e.v FROM walk w JOIN step e ON e.u = w.seen),
    source AS (SELECT id, event_id, first_at FROM held UNION ALL SELECT id, id, detected_at FROM fresh WHERE id NOT IN (SELECT u FROM step))
    SELECT w.id AS candidate_id, arg_min(s.event_id, (s.first_at, s.event_id)) AS event_id FROM walk w JOIN source s ON s.id = w.seen GROUP BY w.id""")
def late_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that no event has yet, beside the events there are, by cells."""
    d = Domain(spark, sf_dir)
    return tracking.extended(d.candidate, d.event_observation.select("event_id", "candidate_id"), d.candidate.where("id % 12 = 0"), d.footprint)


@query(f"""
    WITH {_EVENT_CELLS} SELECT candidate_id, event_id FROM (
        SELECT a.candidate_id, b.event_id, row_number() OVER (PARTITION BY a.candidate_id ORDER BY e.first_detected_at, e.id) AS n FROM around a JOIN event_cell b ON a.row = b.row AND a.col = b.col
        JOIN candidate c ON c.id = a.candidate_id JOIN event e ON e.id = b.event_id AND e.aoi_id = c.aoi_id AND e.methodology_id = c.methodology_id) q WHERE n = 1""")
def earliest_event_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest event whose footprint each candidate's cells touch."""
    d = Domain(spark, sf_dir)
    return tracking.earliest_touching(d.candidate, d.event, (d.footprint.withColumnRenamed("candidate_id", "id"), _event_runs(d)))


_BY_CELLS = _KINDS.split("met AS (")[0].rstrip().rstrip(",")


@query(f"""
    WITH {_BY_CELLS}, {_EVENT_CELLS},
    met AS (SELECT event_id, count(DISTINCT candidate_id) AS n FROM (
            SELECT b.event_id, a.candidate_id FROM around a JOIN event_cell b ON a.row = b.row AND a.col = b.col JOIN candidate c ON c.id = a.candidate_id JOIN own ON own.id = b.event_id AND own.aoi_id = c.aoi_id
            JOIN observation o ON o.id = c.change_raster_id JOIN sensor_source s ON s.name = o.sensor AND s.kind = own.other
            WHERE c.detected_at BETWEEN own.first_detected_at - INTERVAL 30 DAY AND own.last_detected_at + INTERVAL 30 DAY) q GROUP BY event_id)
    SELECT own.id AS event_id, coalesce(l.n, 0) AS other_observations, coalesce(m.n, 0) AS matches,
           CASE WHEN own_kind IS NULL THEN NULL WHEN coalesce(m.n, 0) > 0 THEN 1.0E0 WHEN coalesce(l.n, 0) > 0 THEN 0.0E0 END AS agreement,
           CASE WHEN own_kind IS NULL THEN NULL WHEN coalesce(m.n, 0) > 0 THEN 'both' ELSE concat(own_kind, '-only') END AS basis
    FROM own LEFT JOIN looks l ON l.event_id = own.id LEFT JOIN met m ON m.event_id = own.id""")
def footprint_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the other kind of sensor saw on the very cells of an event, or beside them."""
    d = Domain(spark, sf_dir)
    kinds = confidence.own_kinds(d.event_observation, d.candidate, d.observation, d.sensor_source)
    looks = d.observation.join(d.sensor_source, F.col("sensor") == F.col("name"))
    seen = d.candidate.join(looks.select(F.col("id").alias("o_id"), "kind"), F.col("change_raster_id") == F.col("o_id"))
    return confidence.agreement(d.event, kinds, looks, seen, footprints=(_event_runs(d), d.footprint.withColumnRenamed("candidate_id", "id")))


#: The grid of footprints: row 0 begins at 60 degrees north, cells are 0.05 degrees wide, so rows differ in area.
NORTH, STEP = 60.0, 0.05
_Q = "(sin(radians({0})) / (1 - 0.0066943799901413165 * sin(radians({0})) ** 2) - ln((1 - 0.08181919084262149 * sin(radians({0}))) / (1 + 0.08181919084262149 * sin(radians({0})))) / (2 * 0.08181919084262149))"
_AREA = f"(6378137.0 ** 2 / 2 * radians(0.05) * (1 - 0.0066943799901413165) * ({_Q.format('(60.0E0 - row * 0.05E0)')} - {_Q.format('(60.0E0 - (row + 1) * 0.05E0)')}))"


@query(f"""
    WITH {_CELLS},
    m AS (SELECT event_id, candidate_id, row_number() OVER (PARTITION BY event_id ORDER BY observed_at, candidate_id) AS place FROM event_observation),
    f AS (SELECT event_id, place, sum({_AREA}) AS area FROM (SELECT event_id, row, col, min(place) AS place FROM m JOIN cell_of USING (candidate_id) GROUP BY event_id, row, col) q GROUP BY event_id, place)
    SELECT m.event_id, m.candidate_id, CASE WHEN m.place > 1 THEN round(coalesce(f.area, 0), 1) END AS growth_m2 FROM m LEFT JOIN f ON f.event_id = m.event_id AND f.place = m.place""")
def footprint_growth_m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area on the ellipsoid that each measurement adds to its event's footprint."""
    d = Domain(spark, sf_dir)
    members = d.event_observation.select("event_id", "candidate_id", F.col("observed_at").alias("detected_at"))
    grown = tracking.growth(members, d.footprint, footprints.grid_area_m2(F.col("row"), NORTH, STEP, F.lit(1)))
    return grown.withColumn("growth_m2", F.round("growth_m2", 1))


@query(f"WITH {_EVENT_CELLS} SELECT event_id, count(*) AS cells, round(sum({_AREA}), 1) AS area_m2, min(col) AS x0, min(row) AS y0, max(col) + 1 AS x1, max(row) + 1 AS y1 FROM event_cell GROUP BY event_id")
def event_footprint_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of each event's footprints: cells, area on the ellipsoid, bounds."""
    runs = _event_runs(Domain(spark, sf_dir))
    width = F.col("c1") - F.col("c0")
    out = runs.groupBy(F.col("id").alias("event_id")).agg(
        F.sum(width).alias("cells"), F.round(F.sum(footprints.grid_area_m2(F.col("row"), NORTH, STEP, width)), 1).alias("area_m2"), F.min("c0").alias("x0"), F.min("row").alias("y0"), F.max("c1").alias("x1"), (F.max("row") + 1).alias("y1")
    )
    return out


_PATCH = """
    hit AS MATERIALIZED (SELECT scene, row, col, row * 1000 + col AS c FROM cell WHERE delta < -0.2541),
    step AS MATERIALIZED (SELECT a.scene, a.c AS u, b.c AS v FROM hit a JOIN hit b ON a.scene = b.scene AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
    walk AS (SELECT scene, c, c AS seen FROM hit UNION SELECT w.scene, w.c, e.v FROM walk w JOIN step e ON e.scene = w.scene AND e.u = w.seen),
    lab AS MATERIALIZED (SELECT h.scene, row, col, min(seen) AS patch FROM walk w JOIN hit h ON h.scene = w.scene AND h.c = w.c GROUP BY ALL)"""


@query(f"""
    WITH RECURSIVE {_PATCH},
    side AS MATERIALIZED (SELECT l.*, s, ar, ac, xr, xc FROM lab l, (VALUES (0, -1, 0, 0, 1, -1, 1), (1, 0, 1, 1, 0, 1, 1), (2, 1, 0, 0, -1, 1, -1), (3, 0, -1, -1, 0, -1, -1)) AS k(s, br, bc, ar, ac, xr, xc)
        WHERE NOT EXISTS (SELECT 1 FROM lab n WHERE n.scene = l.scene AND n.patch = l.patch AND n.row = l.row + br AND n.col = l.col + bc)),
    bound AS MATERIALIZED (SELECT s.scene, s.patch, (s.row * 1000 + s.col) * 4 + s AS e, a.row IS NULL OR x.row IS NOT NULL AS corner, s.row + CASE WHEN s IN (1, 2) THEN 1 ELSE 0 END AS pr, s.col + CASE WHEN s IN (0, 1) THEN 1 ELSE 0 END AS pc,
        CASE WHEN a.row IS NULL THEN (s.row * 1000 + s.col) * 4 + (s + 1) % 4 WHEN x.row IS NULL THEN (a.row * 1000 + a.col) * 4 + s ELSE (x.row * 1000 + x.col) * 4 + (s + 3) % 4 END AS nxt
        FROM side s LEFT JOIN lab a ON a.scene = s.scene AND a.patch = s.patch AND a.row = s.row + ar AND a.col = s.col + ac LEFT JOIN lab x ON x.scene = s.scene AND x.patch = s.patch AND x.row = s.row + xr AND x.col = s.col + xc),
    round_trip AS (SELECT scene, e AS start, nxt AS here, 1 AS n FROM bound UNION ALL SELECT w.scene, start, b.nxt, n + 1 FROM round_trip w JOIN bound b ON b.scene = w.scene AND b.e = w.here WHERE w.here > w.start),
    begins AS (SELECT scene, start, n AS size FROM round_trip WHERE here = start),
    path AS (SELECT scene, start, size, start AS here, 0 AS n FROM begins UNION ALL SELECT w.scene, start, size, b.nxt, n + 1 FROM path w JOIN bound b ON b.scene = w.scene AND b.e = w.here WHERE b.nxt <> w.start),
    turn AS (SELECT w.scene, b.patch, w.start, w.size, w.n, pr, pc FROM path w JOIN bound b ON b.scene = w.scene AND b.e = w.here WHERE corner),
    topmost AS (SELECT scene, start, arg_min(n, (pr, pc)) AS n0, min((pr, pc)) AS p0 FROM turn GROUP BY scene, start),
    placed AS (SELECT t.*, (t.n - n0 + size) % size AS k, p0 FROM turn t JOIN topmost USING (scene, start)),
    area AS (SELECT scene, start, sum(pc * nr - nc * pr) / 2 AS cells FROM (SELECT *, coalesce(lead(pr) OVER w, first(pr) OVER w) AS nr, coalesce(lead(pc) OVER w, first(pc) OVER w) AS nc FROM placed WINDOW w AS (PARTITION BY scene, start ORDER BY k)) q GROUP BY scene, start),
    ring AS (SELECT p.scene, p.patch, p.start, any_value(p0) AS p0, any_value(a.cells) AS cells, concat('[', string_agg(concat('[', pc, ',', pr, ']'), ',' ORDER BY k), ',', arg_min(concat('[', pc, ',', pr, ']'), k), ']') AS text
             FROM placed p JOIN area a ON a.scene = p.scene AND a.start = p.start GROUP BY p.scene, p.patch, p.start),
    size AS (SELECT scene, patch, sum({_AREA}) AS area_m2 FROM lab GROUP BY scene, patch)
    SELECT r.scene, count(*) FILTER (WHERE cells < 0) AS holes, sum(cells)::BIGINT AS cells, concat('[', string_agg(text, ',' ORDER BY cells < 0, p0), ']') AS coordinates, any_value(round(area_m2, -2)) AS area_m2
    FROM ring r JOIN size z ON z.scene = r.scene AND z.patch = r.patch GROUP BY r.scene, r.patch""")
def patch_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches as polygons with holes, and the area that their rings enclose on the ellipsoid; tiles are small here so
    that rings cross them."""
    hits = raster.hits(Domain(spark, sf_dir).cell, "delta", -0.2541)
    labelled = written(components.patches(hits, tile=16).select("scene", "row", "col", "patch"), "patches")
    closed = written(rings.rings(labelled, tile=16), "rings")
    found = rings.polygons(closed)
    world = closed.withColumn("text", rings.polygon_text("points", lambda p: p["col"] * STEP, lambda p: NORTH - p["row"] * STEP))
    areas = world.groupBy("patch").agg(F.round(F.sum(F.when(F.col("hole"), -1.0).otherwise(1.0) * polygon_area_m2(F.concat(F.lit("["), "text", F.lit("]")))), -2).alias("area_m2"))
    scene = F.floor(F.col("patch") / (1 << 40)).cast("long").alias("scene")
    return found.join(areas, "patch").select(scene, "holes", "cells", "coordinates", "area_m2")


def _plane_edges(corners: DataFrame, *keys: str) -> DataFrame:
    """Edges of shapes given by corners, by way of their GeoJSON texts."""
    point = F.concat(F.lit("["), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"), F.lit("]"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", point.alias("p")))), lambda c: c["p"])
    parts = corners.groupBy("id", *keys, "n", "part").agg(listed.alias("c"))
    closed = F.when(F.col("n") > 2, F.concat("c", F.slice("c", 1, 1))).otherwise(F.col("c"))
    parts = parts.withColumn("text", F.when(F.col("n") == 1, F.get("c", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(closed, ","), F.lit("]"))))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda c: c["text"])
    kind = F.when(F.col("n") == 1, "Point").when(F.col("n") == 2, "LineString").otherwise("Polygon")
    shapes = parts.groupBy("id", *keys, kind.alias("geometry_type")).agg(texts.alias("t"))
    shapes = shapes.withColumn("coordinates", F.when(F.col("geometry_type") == "Polygon", F.concat(F.lit("["), F.array_join("t", ","), F.lit("]"))).otherwise(F.get("t", F.lit(0))))
    return polygons.edges(shapes, "id", "geometry_type", "coordinates", *keys)


def _edges_of(corners: DataFrame, *keys: str) -> DataFrame:
    """``_plane_edges`` in degrees: a thousandth for a unit, from 45 degrees north on."""
    found = _plane_edges(corners, *keys)
    return found.withColumns({c: F.col(c) * 0.001 for c in ("ax", "bx")} | {c: F.lit(45.0) + F.col(c) * 0.001 for c in ("ay", "by")})


#: Edges from corners, whether two of them meet, and points within rings, pair by pair.
_EDGES = """
    e_edge AS MATERIALIZED (SELECT a.id, a.part, a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy, true AS filled FROM event_corner a JOIN event_corner b ON a.id = b.id AND b.k = (a.k + 1) % a.n),
    f_edge AS MATERIALIZED (SELECT a.id, a.part, a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy, a.n > 2 AS filled FROM feature_corner a JOIN feature_corner b ON a.id = b.id AND a.part = b.part AND b.k = (a.k + 1) % a.n WHERE a.n <> 2 OR a.k = 0),
    e_box AS (SELECT id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM event_corner GROUP BY id), f_box AS (SELECT id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM feature_corner GROUP BY id),
    near AS MATERIALIZED (SELECT a.id AS e, b.id AS f FROM e_box a JOIN f_box b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
    sides AS (SELECT e, f, (a.qx - a.ax) * (b.ay - a.ay) - (a.qy - a.ay) * (b.ax - a.ax) AS s1, (a.qx - a.ax) * (b.qy - a.ay) - (a.qy - a.ay) * (b.qx - a.ax) AS s2,
              (b.qx - b.ax) * (a.ay - b.ay) - (b.qy - b.ay) * (a.ax - b.ax) AS s3, (b.qx - b.ax) * (a.qy - b.ay) - (b.qy - b.ay) * (a.qx - b.ax) AS s4, a.ax, a.ay, a.qx, a.qy, b.ax AS cx, b.ay AS cy, b.qx AS dx, b.qy AS dy
              FROM near JOIN e_edge a ON a.id = e JOIN f_edge b ON b.id = f),
    meet AS (SELECT DISTINCT e, f FROM sides WHERE sign(s1) * sign(s2) <= 0 AND sign(s3) * sign(s4) <= 0 AND least(ax, qx) <= greatest(cx, dx) AND least(cx, dx) <= greatest(ax, qx) AND least(ay, qy) <= greatest(cy, dy) AND least(cy, dy) <= greatest(ay, qy)),
    e_in AS (SELECT e, f, k, count(*) FILTER (WHERE (ay > y) <> (qy > y) AND x < ax + (y - ay) * (qx - ax)::DOUBLE / nullif(qy - ay, 0)) % 2 = 1
                OR bool_or((qx - ax) * (y - ay) = (qy - ay) * (x - ax) AND x BETWEEN least(ax, qx) AND greatest(ax, qx) AND y BETWEEN least(ay, qy) AND greatest(ay, qy)) AS held
             FROM near JOIN event_corner c ON c.id = e JOIN f_edge b ON b.id = f AND b.filled GROUP BY e, f, k),
    f_in AS (SELECT e, f, c.part, k, count(*) FILTER (WHERE (ay > y) <> (qy > y) AND x < ax + (y - ay) * (qx - ax)::DOUBLE / nullif(qy - ay, 0)) % 2 = 1 AS held
             FROM near JOIN feature_corner c ON c.id = f JOIN e_edge b ON b.id = e GROUP BY e, f, c.part, k),
    joined AS MATERIALIZED (SELECT e, f FROM meet UNION SELECT e, f FROM e_in WHERE held UNION SELECT e, f FROM f_in WHERE held),
    -- All corners in the outer ring; and a side of the event or of the hole that lies between the two.
    whole AS (SELECT e, f FROM near JOIN event_corner c ON c.id = e JOIN f_edge b ON b.id = f AND b.filled AND b.part = 0 GROUP BY e, f
              HAVING bool_and((b.qx - b.ax) * (c.y - b.ay) - (b.qy - b.ay) * (c.x - b.ax) >= 0)),
    line AS (SELECT e, f, 0 AS of, a.ax, a.ay, a.qx, a.qy FROM near JOIN e_edge a ON a.id = e UNION ALL SELECT e, f, 1, b.ax, b.ay, b.qx, b.qy FROM near JOIN f_edge b ON b.id = f AND b.part = 1),
    hollow AS (SELECT DISTINCT e, f FROM near JOIN feature_corner h ON h.id = f AND h.part = 1),
    parted AS (SELECT DISTINCT e, f FROM (SELECT l.e, l.f, l.of, l.ax, l.ay, l.qx, l.qy FROM line l JOIN hollow USING (e, f) JOIN event_corner c ON c.id = l.e JOIN feature_corner h ON h.id = l.f AND h.part = 1 GROUP BY ALL
               HAVING (bool_and((l.qx - l.ax) * (c.y - l.ay) - (l.qy - l.ay) * (c.x - l.ax) >= 0) AND bool_and((l.qx - l.ax) * (h.y - l.ay) - (l.qy - l.ay) * (h.x - l.ax) <= 0))
                   OR (bool_and((l.qx - l.ax) * (c.y - l.ay) - (l.qy - l.ay) * (c.x - l.ax) <= 0) AND bool_and((l.qx - l.ax) * (h.y - l.ay) - (l.qy - l.ay) * (h.x - l.ax) >= 0))) q),
    held AS (SELECT e, f FROM whole w WHERE NOT EXISTS (SELECT 1 FROM hollow h WHERE h.e = w.e AND h.f = w.f) OR EXISTS (SELECT 1 FROM parted p WHERE p.e = w.e AND p.f = w.f))"""


@query(f"WITH {_EDGES} SELECT e AS event_id, f AS feature_id, EXISTS (SELECT 1 FROM held h WHERE h.e = j.e AND h.f = j.f) AS contains FROM joined j")
def polygon_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles, diamonds and boxes against polygons with holes, lines and points: which meet, which are contained."""
    d = Domain(spark, sf_dir)
    (events, e_ids), (features, f_ids) = (polygons.outlines(_edges_of(c)) for c in (d.event_corner, d.feature_corner))
    found = written(polygons.relations(events, features, 0.05), "shape-relations")
    found = polygons.for_members(polygons.for_members(found, e_ids, "l_id"), f_ids, "r_id")
    return found.select(F.col("l_id").alias("event_id"), F.col("r_id").alias("feature_id"), "contains")


def _vincenty(source: str, rounds: int = 8) -> str:
    """CTEs that add ``metres`` to rows with lon1, lat1, lon2, lat2, the iteration written out round by round."""
    f, a = "(1 / 298.257223563E0)", "6378137.0E0"
    b = f"({a} * (1 - {f}))"
    arc = """sqrt((c2 * sin(w)) ** 2 + (c1 * s2 - s1 * c2 * cos(w)) ** 2) AS ss, s1 * s2 + c1 * c2 * cos(w) AS cs"""
    more = "atan2(ss, cs) AS sg, coalesce(c1 * c2 * sin(w) / nullif(ss, 0), 0) AS sa"
    last = "1 - sa * sa AS ca, coalesce(cs - 2 * s1 * s2 / CASE WHEN 1 - sa * sa > 1e-15 THEN 1 - sa * sa END, 0) AS cm"
    text = f"v0 AS (SELECT *, radians(lon2 - lon1) AS l, radians(lon2 - lon1) AS w, sin(atan((1 - {f}) * tan(radians(lat1)))) AS s1, cos(atan((1 - {f}) * tan(radians(lat1)))) AS c1, sin(atan((1 - {f}) * tan(radians(lat2)))) AS s2, cos(atan((1 - {f}) * tan(radians(lat2)))) AS c2 FROM {source})"
    for k in range(rounds + 1):
        text += f", p{k} AS (SELECT *, {last} FROM (SELECT *, {more} FROM (SELECT *, {arc} FROM v{k}) x) y)"
        if k < rounds:
            cc = f"({f} / 16 * ca * (4 + {f} * (4 - 3 * ca)))"
            text += f", v{k + 1} AS (SELECT * EXCLUDE (ss, cs, sg, sa, ca, cm) REPLACE (l + (1 - {cc}) * {f} * sa * (sg + {cc} * ss * (cm + {cc} * cs * (2 * cm * cm - 1))) AS w) FROM p{k})"
    u = f"(ca * ({a} ** 2 - {b} ** 2) / {b} ** 2)"
    big, small = f"(1 + {u} / 16384 * (4096 + {u} * ({u} * (320 - 175 * {u}) - 768)))", f"({u} / 1024 * (256 + {u} * ({u} * (74 - 47 * {u}) - 128)))"
    return text + f", geo AS (SELECT *, {b} * {big} * (sg - {small} * ss * (cm + {small} / 4 * (cs * (2 * cm * cm - 1) - {small} / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS metres FROM p{rounds})"


_APART = f"""
    wide AS MATERIALIZED (SELECT a.id AS e, b.id AS f FROM e_box a JOIN f_box b ON a.x0 <= b.x1 + 60 AND b.x0 <= a.x1 + 60 AND a.y0 <= b.y1 + 60 AND b.y0 <= a.y1 + 60 ANTI JOIN joined j ON j.e = a.id AND j.f = b.id),
    corner_edge AS (SELECT e, f, c.x * 0.001E0 AS px, 45.0E0 + c.y * 0.001E0 AS py, b.ax * 0.001E0 AS ax, 45.0E0 + b.ay * 0.001E0 AS ay, b.qx * 0.001E0 AS qx, 45.0E0 + b.qy * 0.001E0 AS qy FROM wide JOIN event_corner c ON c.id = e JOIN f_edge b ON b.id = f
        UNION ALL SELECT e, f, c.x * 0.001E0, 45.0E0 + c.y * 0.001E0, b.ax * 0.001E0, 45.0E0 + b.ay * 0.001E0, b.qx * 0.001E0, 45.0E0 + b.qy * 0.001E0 FROM wide JOIN feature_corner c ON c.id = f JOIN e_edge b ON b.id = e),
    scaled AS (SELECT *, radians(6378137.0E0) * cos(radians(py)) / sqrt(1 - 0.0066943799901413165 * sin(radians(py)) ** 2) AS sx, radians(6378137.0E0 * (1 - 0.0066943799901413165)) / sqrt(1 - 0.0066943799901413165 * sin(radians(py)) ** 2) ** 3 AS sy FROM corner_edge),
    foot AS (SELECT *, greatest(0, least(1, coalesce(((px - ax) * sx * (qx - ax) * sx + (py - ay) * sy * (qy - ay) * sy) / nullif(((qx - ax) * sx) ** 2 + ((qy - ay) * sy) ** 2, 0), 0))) AS t FROM scaled),
    closest AS (SELECT e, f, px AS lon1, py AS lat1, ax + t * (qx - ax) AS lon2, ay + t * (qy - ay) AS lat2 FROM foot
        QUALIFY row_number() OVER (PARTITION BY e, f ORDER BY ((px - ax - t * (qx - ax)) * sx) ** 2 + ((py - ay - t * (qy - ay)) * sy) ** 2) = 1),
    {_vincenty("closest")}"""


@query(f"WITH {_EDGES}, {_APART} SELECT e AS event_id, f AS feature_id, round(metres, 2) AS distance_m FROM geo WHERE metres <= 2000")
def polygon_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geodesic metres between shapes that are apart by 2,000 m at most."""
    d = Domain(spark, sf_dir)
    (events, e_ids), (features, f_ids) = (polygons.outlines(_edges_of(c)) for c in (d.event_corner, d.feature_corner))
    near = polygons.nearest(events, features, 2000.0, 0.05).join(polygons.relations(events, features, 0.05), ["l_id", "r_id"], "left_anti")
    near = polygons.for_members(polygons.for_members(written(near, "shape-distances"), e_ids, "l_id"), f_ids, "r_id")
    return near.select(F.col("l_id").alias("event_id"), F.col("r_id").alias("feature_id"), F.round("distance_m", 2).alias("distance_m"))


@query(f"""
    WITH {_EDGES}, {_APART}, kinds AS (SELECT f.id, l.kind FROM context_feature f JOIN context_layer l ON l.id = f.layer_id)
    SELECT e AS event_id, f AS feature_id, kind, CASE WHEN EXISTS (SELECT 1 FROM held h WHERE h.e = j.e AND h.f = j.f) THEN 'contains' ELSE 'intersects' END AS relation, CAST(NULL AS DOUBLE) AS distance_m FROM joined j JOIN kinds ON kinds.id = f
    UNION ALL SELECT e, f, kind, 'nearby', round(metres, 1) FROM geo JOIN kinds ON kinds.id = f WHERE metres <= 2000 QUALIFY row_number() OVER (PARTITION BY e, kind ORDER BY metres, f) = 1""")
def context_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of event polygons to reference polygons, lines and points: contained, touching, or the nearest of a kind."""
    d = Domain(spark, sf_dir)
    kinds = d.context_feature.join(d.context_layer.select(F.col("id").alias("layer"), "kind"), F.col("layer_id") == F.col("layer")).select("id", "kind")
    return context.shape_relations(_edges_of(d.event_corner), _edges_of(d.feature_corner.join(kinds, "id"), "kind"), 2000.0, 0.05)


@query("""
    WITH edge AS (SELECT a.id, a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy FROM area_corner a JOIN area_corner b ON a.id = b.id AND b.k = (a.k + 1) % 3),
    spot AS (SELECT DISTINCT scene, row, col FROM cell),
    held AS (SELECT scene, row, col FROM spot JOIN edge ON edge.id = scene % 25 WHERE (ay > row + 0.5E0) <> (qy > row + 0.5E0) AND ax + (row + 0.5E0 - ay) * (qx - ax) / (qy - ay) <= col + 0.5E0 GROUP BY scene, row, col HAVING count(*) % 2 = 1),
    grid AS (SELECT id, r, c FROM aoi, range(0, 24) t(r), range(0, 130) u(c)),
    whole AS (SELECT id, count(*) AS n FROM (SELECT g.id, r, c FROM grid g JOIN edge ON edge.id = g.id WHERE (ay > r + 0.5E0) <> (qy > r + 0.5E0) AND ax + (r + 0.5E0 - ay) * (qx - ax) / (qy - ay) <= c + 0.5E0 GROUP BY g.id, r, c HAVING count(*) % 2 = 1) q GROUP BY id)
    SELECT s.scene, coalesce(h.n, w.n) AS cells, h.n IS NULL AS whole_area FROM (SELECT DISTINCT scene FROM cell) s JOIN whole w ON w.id = s.scene % 25 LEFT JOIN (SELECT scene, count(*) AS n FROM held GROUP BY scene) h ON h.scene = s.scene""")
def scene_clip_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a scene whose centres lie in its slanted area; where they share none, all cells of the area."""
    d = Domain(spark, sf_dir)
    spans = written(polygons.spans(_plane_edges(d.area_corner)), "area-spans")
    spots = d.cell.select("scene", "row", "col").withColumn("id", F.col("scene") % 25)
    shared = spots.join(spans, ["id", "row"]).where("col >= c0 AND col < c1").groupBy("scene").agg(F.count("*").alias("n"))
    size = spans.groupBy("id").agg(F.sum(F.col("c1") - F.col("c0")).alias("all_cells"))
    scenes = spots.select("scene", "id").distinct().join(size, "id").join(shared, "scene", "left")
    return scenes.select("scene", F.coalesce("n", "all_cells").alias("cells"), F.col("n").isNull().alias("whole_area"))
