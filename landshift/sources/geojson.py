"""GeoJSON as a source and a sink."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.functions.geometry import polygon_problem
from landshift.functions.text import kind_and_name, last_segment

# Fixed values of the format: kinds of context layers, and names of WGS 84.
KINDS = ("concession", "protected_area", "road", "river", "settlement", "mill", "port", "other")
WORLD = ("urn:ogc:def:crs:ogc:1.3:crs84", "urn:ogc:def:crs:epsg::4326", "epsg:4326", "crs84")

_DOCUMENT = "type string, geometry string, properties string, features array<string>, crs string"
_FEATURE = "type string, geometry string, properties string, id string"
_SHAPE = "type string, coordinates string"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each ``*.geojson`` in a folder, subfolders left out."""
    return spark.read.option("pathGlobFilter", "*.geojson").option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def features(docs: DataFrame) -> DataFrame:
    """One row per feature: path, geometry_type, coordinates (JSON), properties (map), problem (null if none); polygons
    are looked over for open rings and crossings."""
    doc = docs.withColumn("doc", F.from_json("text", _DOCUMENT))
    one = F.when(F.col("doc.type") == "Feature", F.array(F.col("text"))).when(F.col("doc.type") == "FeatureCollection", F.col("doc.features"))
    rows = doc.select("path", F.col("doc.crs").alias("crs"), F.col("doc.type").alias("kind"), F.posexplode_outer(one).alias("place", "feature"))
    rows = rows.withColumn("f", F.from_json("feature", _FEATURE)).withColumn("g", F.from_json("f.geometry", _SHAPE))
    name = F.lower(F.get_json_object("crs", "$.properties.name"))
    problem = (
        F.when(F.col("kind").isNull() | ~F.col("kind").isin("Feature", "FeatureCollection"), "not a feature or feature collection")
        .when(F.col("feature").isNull(), "no feature")
        .when(F.col("crs").isNotNull() & ~F.coalesce(name.isin(*WORLD), F.lit(False)), "not in WGS84")
        .when(F.col("g.type").isNull() | F.col("g.coordinates").isNull() | F.regexp_replace("g.coordinates", r"[\[\]\s,]", "").eqNullSafe(""), "no geometry")
    )
    shape = F.when(problem.isNull() & F.col("g.type").isin("Polygon", "MultiPolygon"), F.col("g.coordinates"))
    problem = F.coalesce(problem, F.when(shape.isNotNull(), polygon_problem(shape)))
    return rows.select("path", F.col("place").cast("long").alias("place"), F.col("g.type").alias("geometry_type"), F.col("g.coordinates").alias("coordinates"), F.from_json("f.properties", "map<string,string>").alias("properties"), problem.alias("problem"))


def areas(docs: DataFrame) -> DataFrame:
    """Areas to monitor: exactly one polygon or multipolygon feature with a name; problems are told per file."""
    found = features(docs)
    count = found.groupBy(F.col("path").alias("c_path")).agg(F.count("*").alias("n"))
    rows = found.join(count, found.path == F.col("c_path")).where("place = 0 OR place IS NULL")
    name = F.nullif(F.trim(F.try_element_at("properties", F.lit("name"))), F.lit(""))
    problem = F.coalesce("problem", F.when(F.col("n") > 1, "more than one feature").when(~F.col("geometry_type").isin("Polygon", "MultiPolygon"), "not a polygon").when(name.isNull(), "no name"))
    shape = F.when(F.col("geometry_type") == "Polygon", F.concat(F.lit("["), F.col("coordinates"), F.lit("]"))).otherwise(F.col("coordinates"))
    return rows.select("path", name.alias("name"), shape.alias("multipolygon"), problem.alias("problem"))


def harvested(docs: DataFrame) -> DataFrame:
    """Context layers of a folder: files named ``kind--name.geojson``; others are told as problems."""
    stem = F.regexp_replace(last_segment(F.col("path")), r"\.geojson$", "")
    named = docs.withColumn("layer", kind_and_name(stem))
    ok = F.coalesce(F.col("layer.kind").isin(*KINDS), F.lit(False))
    found = features(named.where(ok)).join(named.where(ok).select(F.col("path").alias("l_path"), "layer"), F.col("path") == F.col("l_path")).drop("l_path")
    bad = named.where(~ok).select("path", F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("geometry_type"), F.lit(None).cast("string").alias("coordinates"), F.lit(None).cast("map<string,string>").alias("properties"), F.lit("file name").alias("problem"), "layer")
    return found.unionByName(bad).select("path", F.col("layer.kind").alias("kind"), F.col("layer.name").alias("name"), "place", "geometry_type", "coordinates", "properties", "problem").orderBy("path", "place")


def points(rows: DataFrame, coordinates: str = "coordinates") -> DataFrame:
    """``rows`` with the bounds of all vertices in a coordinates text: min_x, min_y, max_x, max_y."""
    pair = r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)"
    xs, ys = (F.transform(F.regexp_extract_all(coordinates, F.lit(pair), F.lit(i)), lambda v: v.cast("double")) for i in (1, 2))
    return rows.withColumns({"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)})


def feature_json(geometry, properties):
    """A GeoJSON feature as text, from a struct or JSON geometry column and a map or struct of properties."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def feature_collection(features: DataFrame, feature: str = "feature", *order: str) -> DataFrame:
    """One row: the features (JSON texts) as a collection, in the given order. For what a report shows, not for whole tables."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(*order, feature))), lambda x: x[feature])
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}")).alias("collection"))


def area_from_bounds(west: float, south: float, east: float, north: float, name: str) -> str:
    """A GeoJSON feature of a named box; bounds out of range or the wrong way round are errors."""
    if not name.strip():
        raise ValueError("an area needs a name")
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise ValueError("bounds must be west < east and south < north, in degrees")
    ring = [[west, south], [east, south], [east, north], [west, north], [west, south]]
    return json.dumps({"type": "Feature", "properties": {"name": name.strip()}, "geometry": {"type": "Polygon", "coordinates": [ring]}})
