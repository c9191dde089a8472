"""The domain's tables as views of the test tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")

VIEWS = {
    "aoi": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation",
    "sensor_source": "SELECT * FROM (VALUES ('HLSL30', 'optical'), ('HLSS30', 'optical'), ('S1GRD', 'radar')) AS t(name, kind)",
    "observation": """
        SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS aoi_id, o_orderdate AS acquired_at,
               CASE WHEN o_orderkey % 5 < 2 THEN 'HLSL30' WHEN o_orderkey % 5 < 4 THEN 'HLSS30' ELSE 'S1GRD' END AS sensor,
               concat('scene-', CAST(o_orderkey AS VARCHAR(20))) AS source_scene_id,
               CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 101 AS DOUBLE) END AS cloud_cover,
               CASE WHEN o_orderkey % 5 = 4 THEN CASE WHEN o_custkey % 2 = 0 THEN 'ASCENDING' ELSE 'DESCENDING' END END AS orbit_direction
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "optical": "SELECT * FROM observation WHERE sensor <> 'S1GRD'",
    "radar": "SELECT * FROM observation WHERE sensor = 'S1GRD'",
    "raw_pixel": """
        SELECT l_orderkey AS observation_id, l_partkey % 8 AS pixel, max(l_extendedprice) / 1000 AS b_nir, max(l_quantity) AS b_swir2,
               10 + max(l_tax) * 100 AS b_red, CAST(min(l_quantity * 5) AS INT) AS fmask, 10 * max(l_discount) - 12 AS vv
        FROM lineitem GROUP BY l_orderkey, l_partkey % 8""",
    "quality_mask": """
        SELECT observation_id, avg(CASE WHEN (fmask & 26) = 0 AND fmask < 192 THEN 1.0E0 ELSE 0.0E0 END) AS valid_pixel_fraction
        FROM raw_pixel JOIN optical ON id = observation_id GROUP BY observation_id""",
    "forest_pixel": """
        SELECT CAST(p_partkey AS BIGINT) AS pixel, CAST(p_size * 2 AS DOUBLE) AS treecover2000, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 4 AS INT) END AS lossyear,
               CAST(p_partkey % 6 * 5 AS INT) AS landcover FROM part""",
    "cell": """
        SELECT l_suppkey AS scene, l_partkey % 24 AS row, l_orderkey % 24 AS col, avg(l_discount) - 0.3 AS delta
        FROM lineitem GROUP BY l_suppkey, l_partkey % 24, l_orderkey % 24""",
    "candidate": """
        SELECT id, aoi_id, 1 + id % 2 AS methodology_id, id AS change_raster_id, acquired_at AS detected_at,
               id * 37 % 400 AS x0, id * 91 % 400 AS y0, id * 37 % 400 + 1 + id % 9 AS x1, id * 91 % 400 + 1 + id * 5 % 11 AS y1,
               900.0E0 * (1 + id % 9) * (1 + id * 5 % 11) AS area_m2, -0.25E0 - (id % 40) / 100.0E0 AS delta_mean, -0.3E0 - (id % 40) / 80.0E0 AS delta_min,
               CASE WHEN id % 11 > 0 THEN (id % 10 + 1) / 10.0E0 END AS valid_pixel_fraction
        FROM observation WHERE id % 3 < 2""",
    # Boxes, L shapes both ways up, and frames, which reach into each other's boxes.
    "footprint": """
        SELECT id AS candidate_id, y0 + k AS row, CASE WHEN id % 4 = 3 AND k > 0 THEN x1 - 1 ELSE x0 END AS c0,
               CASE WHEN id % 4 IN (0, 3) OR (id % 4 = 1 AND k = y1 - y0 - 1) OR (id % 4 = 2 AND (k = 0 OR k = y1 - y0 - 1)) THEN x1 ELSE x0 + 1 END AS c1
        FROM candidate JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) AS v(k) ON k < y1 - y0
        UNION ALL SELECT id, y0 + k, x1 - 1, x1 FROM candidate JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS v(k) ON k < y1 - y0 - 1 WHERE id % 4 = 2 AND x1 - x0 > 1""",
    "event_observation": """
        SELECT id, aoi_id * 1000000 + methodology_id * 100000 + (x0 - x0 % 100) * 10 + (y0 - y0 % 100) + EXTRACT(YEAR FROM detected_at) % 50 AS event_id, id AS candidate_id,
               detected_at AS observed_at, CASE WHEN id % 4 > 0 THEN id % 50 * 10.0E0 END AS growth_m2
        FROM candidate WHERE id % 12 > 0""",
    "event": """
        SELECT event_id AS id, c.aoi_id AS aoi_id, c.methodology_id AS methodology_id, min(observed_at) AS first_detected_at, max(observed_at) AS last_detected_at,
               CASE WHEN count(*) = 1 THEN 'new' ELSE 'ongoing' END AS status, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
        FROM event_observation e JOIN candidate c ON c.id = e.candidate_id GROUP BY event_id, c.aoi_id, c.methodology_id""",
    "review": """
        SELECT conv_id * 100 + turn AS id, e.id AS event_id, CASE role WHEN 'user' THEN 'confirmed' WHEN 'assistant' THEN 'rejected' ELSE 'uncertain' END AS opinion
        FROM conversations JOIN event e ON conv_id % 500 = e.id % 500""",
    "assessment": """
        SELECT e.id * 10 + k AS id, e.id AS event_id, CASE WHEN (e.id + k) % 5 = 0 THEN 'v2' ELSE 'v3' END AS rule_version,
               (e.id * 7 + k * 13) % 101 / 100.0E0 AS score, CASE WHEN (e.id * 7 + k * 13) % 101 >= 65 THEN 'high' WHEN (e.id * 7 + k * 13) % 101 >= 40 THEN 'medium' ELSE 'low' END AS level,
               CASE WHEN e.id % 3 = 0 THEN '{"factors":{"agreement":{"basis":"both"}}}' ELSE '{"factors":{"agreement":{"basis":null}}}' END AS inputs
        FROM event e, (VALUES (0), (1), (2)) AS v(k) WHERE e.id % 7 > k""",
    "context_layer": """
        SELECT * FROM (VALUES (0, 'layer a', 'concession'), (1, 'layer b', 'port'), (2, 'layer c', 'road'), (3, 'layer d', 'river'), (4, 'layer e', 'mill'),
               (5, 'layer f', 'settlement'), (6, 'layer g', 'protected_area'), (7, 'layer h', 'other'), (8, 'empty', 'other')) AS t(id, name, kind)""",
    "context_feature": """
        SELECT s_suppkey AS id, CAST(s_suppkey % 8 AS INT) AS layer_id, s_name AS name, s_suppkey * 53 % 420 AS x0, s_suppkey * 29 % 420 AS y0,
               s_suppkey * 53 % 420 + s_suppkey % 4 * 30 AS x1, s_suppkey * 29 % 420 + s_suppkey % 3 * 45 AS y1 FROM supplier""",
    # Corners of shapes, in twice the unit of the boxes: triangles, diamonds and boxes; features are also rings, lines and points.
    "event_corner": """
        SELECT id, 0 AS part, k, CASE WHEN id % 3 = 0 THEN 3 ELSE 4 END AS n,
               CASE WHEN id % 3 = 0 THEN CASE WHEN k = 1 THEN 2 * x1 ELSE 2 * x0 END WHEN id % 3 = 1 THEN CASE WHEN k = 1 THEN 2 * x1 WHEN k = 3 THEN 2 * x0 ELSE x0 + x1 END WHEN k IN (1, 2) THEN 2 * x1 ELSE 2 * x0 END AS x,
               CASE WHEN id % 3 = 0 THEN CASE WHEN k = 2 THEN 2 * y1 ELSE 2 * y0 END WHEN id % 3 = 1 THEN CASE WHEN k = 0 THEN 2 * y0 WHEN k = 2 THEN 2 * y1 ELSE y0 + y1 END WHEN k IN (2, 3) THEN 2 * y1 ELSE 2 * y0 END AS y
        FROM event JOIN (VALUES (0), (1), (2), (3)) AS v(k) ON k < CASE WHEN id % 3 = 0 THEN 3 ELSE 4 END""",
    "feature_corner": """
        SELECT id, part, k, n, CASE WHEN n < 3 THEN CASE WHEN k = 0 THEN 2 * x0 ELSE 2 * x1 END WHEN n = 3 THEN CASE WHEN k = 1 THEN 2 * x1 ELSE 2 * x0 END WHEN k IN (1, 2) THEN 2 * x1 - 14 * part ELSE 2 * x0 + 14 * part END AS x,
               CASE WHEN n < 3 THEN CASE WHEN k = 0 THEN 2 * y0 ELSE 2 * y1 END WHEN n = 3 THEN CASE WHEN k = 2 THEN 2 * y1 ELSE 2 * y0 END WHEN k IN (2, 3) THEN 2 * y1 - 14 * part ELSE 2 * y0 + 14 * part END AS y
        FROM (SELECT *, CASE WHEN x0 = x1 AND y0 = y1 THEN 1 WHEN x0 = x1 OR y0 = y1 THEN 2 WHEN id % 5 = 1 THEN 3 ELSE 4 END AS n FROM context_feature) AS f
        JOIN (VALUES (0), (1), (2), (3)) AS v(k) ON k < n JOIN (VALUES (0), (1)) AS p(part) ON part = 0 OR (n = 4 AND id % 2 = 0)""",
    # Slanted areas over the cells of a scene; those of every sixth nation lie beside them.
    "area_corner": """
        SELECT id, 0 AS part, k, 3 AS n, CASE k WHEN 0 THEN id % 7 WHEN 1 THEN 20 + id % 4 ELSE 5 + id % 9 END + CASE WHEN id % 6 = 0 THEN 100 ELSE 0 END AS x,
               CASE k WHEN 0 THEN id % 5 WHEN 1 THEN 3 + id % 6 ELSE 22 - id % 3 END AS y
        FROM aoi JOIN (VALUES (0), (1), (2)) AS v(k) ON true""",
    "run_event": """
        SELECT event_id AS id, user_id AS run_id, ts AS occurred_at, event_type AS stage, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'info' END AS outcome,
               CASE WHEN event_id % 3 > 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS exports FROM events""",
    "run": """
        SELECT user_id AS id, user_id % 25 AS aoi_id, min(ts) AS started_at, CASE WHEN user_id % 9 = 0 THEN 'running' WHEN user_id % 9 < 7 THEN 'succeeded' ELSE 'failed' END AS status,
               CASE WHEN user_id % 6 > 0 THEN 1 + user_id % 3 END AS methodology_id, concat('g', CAST(user_id % 2 AS VARCHAR(2))) AS geometry_hash
        FROM events GROUP BY user_id""",
    "methodology": """
        SELECT CAST(n_nationkey + 1 AS INT) AS id, CASE WHEN n_nationkey % 4 IN (1, 3) THEN 'radar-change' ELSE 'optical-change' END AS name,
               concat(CASE WHEN n_nationkey % 4 IN (1, 3) THEN 'r' ELSE 's' END, CAST(n_nationkey % 25 - n_nationkey % 6 AS VARCHAR(5))) AS script, concat('d', CAST(n_regionkey AS VARCHAR(5))) AS detection FROM nation""",
    "index_raster": """
        SELECT id * 2 + k AS id, o.id AS observation_id, CASE k WHEN 0 THEN 'NBR' ELSE 'NDVI' END AS index_type, CAST(1 + o.id % 2 AS BIGINT) AS lineage_id,
               concat(CAST(aoi_id AS VARCHAR(20)), '-area/', CASE k WHEN 0 THEN 'nbr' ELSE 'ndvi' END, '/', CAST(CAST(acquired_at AS DATE) AS VARCHAR(10)), '/', source_scene_id, '.tif') AS path
        FROM optical o, (VALUES (0), (1)) AS v(k) WHERE o.id % 13 > 0""",
    "change_raster": """
        SELECT id, id AS observation_id, CAST(1 + id % 2 AS BIGINT) AS lineage_id,
               concat(CAST(aoi_id AS VARCHAR(20)), '-area/delta_nbr/', CAST(CAST(acquired_at AS DATE) AS VARCHAR(10)), '/', source_scene_id, '.tif') AS path
        FROM optical WHERE id % 4 > 0""",
    "extraction": "SELECT id AS change_raster_id, CAST(1 + id % 2 AS BIGINT) AS methodology_id FROM change_raster WHERE id % 6 > 0",
    "raster_file": "SELECT path, 1000 + observation_id % 977 AS bytes FROM (SELECT path, observation_id FROM index_raster UNION ALL SELECT path, observation_id FROM change_raster) AS u WHERE observation_id % 5 > 0",
}


def _needed(sql: str) -> list[str]:
    """Views that a statement reads, in the order of ``VIEWS``, which is the order of their use of each other."""
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                wanted.add(name)
                todo.append(VIEWS[name])
    return [v for v in VIEWS if v in wanted]


def oracle(sql: str) -> str:
    """A statement over the views, for DuckDB; it may begin with own views after the word WITH."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in _needed(sql)]
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    head = f"WITH {own[1] or ''}" if own else "WITH "
    rest = sql[own.end() :] if own else sql
    return head + ", ".join(parts) + (", " if own and parts else " ") + rest if parts else sql


class Domain:
    """Views as DataFrames: ``Domain(spark, sf_dir).observation``. A table is read when a view first asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        sql = oracle(f"SELECT * FROM {name}")
        used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN|,)\s+{t}\b", sql)]
        if not used:
            return self.spark.sql(sql)
        tables = ", ".join(f"{t} AS (SELECT * FROM {{{t}}})" for t in used)
        rest = sql.removeprefix("WITH ").replace("{", "{{").replace("}", "}}")
        return self.spark.sql(f"WITH {tables}, {rest}", **{t: self.table(t) for t in used})
