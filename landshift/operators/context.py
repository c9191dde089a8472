"""Relations of events to reference features: contained in, touching, or near."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.operators import polygons
from landshift.operators.boxes import contains, gap, near_pairs
from landshift.sources.shared import written

BUFFER_M = 5000.0


def relations(events: DataFrame, features: DataFrame, within: float = BUFFER_M, scale_m: float = 1.0) -> DataFrame:
    """(event_id, feature_id, kind, relation, distance_m): all features that touch an event, and of those that
    do not but lie within the distance, the nearest of each kind. ``features`` carry their layer's kind.
    """
    pairs = near_pairs(events, features, within=within / scale_m).select("l_id", "r_id", "r_kind", (gap() * scale_m).alias("distance_m"), contains("r", "l").alias("inside"))
    return _told(pairs.withColumnsRenamed({"l_id": "event_id", "r_id": "feature_id", "r_kind": "kind"}))


def shape_relations(events: DataFrame, features: DataFrame, within: float = BUFFER_M, size: float = 0.01) -> DataFrame:
    """``relations`` of shapes, as edges in degrees (id, part, ax, ay, bx, by, filled); ``features`` carry their layer's
    kind. Whether shapes meet or contain each other is told by their outlines, distances are geodesic metres.
    ``size`` is about the length of an edge, in degrees."""
    (events, e_ids), (features, f_ids) = polygons.outlines(events), polygons.outlines(features, "kind")
    met = written(polygons.relations(events, features, size), "context-met")
    apart = polygons.nearest(events, features, within, size).join(met, ["l_id", "r_id"], "left_anti")
    both = met.withColumn("distance_m", F.lit(0.0)).unionByName(apart.withColumn("contains", F.lit(False)))
    kinds = features.select(F.col("id").alias("feature_id"), "kind").distinct()
    pairs = both.select(F.col("l_id").alias("event_id"), F.col("r_id").alias("feature_id"), "distance_m", F.col("contains").alias("inside"))
    # Of features with one outline and kind the least is the nearest; those that are touched are all told.
    told = polygons.for_members(written(_told(pairs.join(kinds, "feature_id")), "context-told"), e_ids, "event_id")
    near = told.where("relation = 'nearby'")
    return polygons.for_members(told.where("relation != 'nearby'"), f_ids, "feature_id").unionByName(near)


def _told(pairs: DataFrame) -> DataFrame:
    """Relations of pairs (event_id, feature_id, kind, distance_m, inside); a distance of 0 is contact."""
    touching = pairs.where("distance_m = 0").select("event_id", "feature_id", "kind", F.when(F.col("inside"), "contains").otherwise("intersects").alias("relation"), F.lit(None).cast("double").alias("distance_m"))
    best = F.min(F.struct("distance_m", "feature_id")).alias("best")
    near = pairs.where("distance_m > 0").groupBy("event_id", "kind").agg(best)
    near = near.select("event_id", F.col("best.feature_id").alias("feature_id"), "kind", F.lit("nearby").alias("relation"), F.round("best.distance_m", 1).alias("distance_m"))
    return touching.unionByName(near)
