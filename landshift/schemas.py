"""Schemas of the catalog tables; nothing is inferred."""

from __future__ import annotations

BOX = "x0 bigint, y0 bigint, x1 bigint, y1 bigint"

TABLES = {
    "aoi": "id bigint, name string, geometry binary, active boolean",
    "sensor_source": "name string, kind string",
    "observation": "id bigint, aoi_id bigint, sensor string, acquired_at timestamp, source_scene_id string, cloud_cover double, orbit_direction string, relative_orbit int",
    "raster_lineage": "id bigint, name string, version string, parameters string",
    "methodology_version": "id bigint, name string, version string, display_version string, parameters string, raster_lineage_id bigint",
    "index_raster": "id bigint, observation_id bigint, index_type string, raster_lineage_id bigint, path string",
    "change_raster": "id bigint, observation_id bigint, change_type string, raster_lineage_id bigint, path string, baseline_window int, baseline_scene_ids array<string>",
    "change_raster_source": "change_raster_id bigint, index_raster_id bigint",
    "disturbance_candidate": f"id bigint, change_raster_id bigint, methodology_id bigint, aoi_id bigint, detected_at timestamp, {BOX}, area_m2 double, delta_mean double, delta_min double, valid_pixel_fraction double",
    "settings_change": "id bigint, key string, old_value string, new_value string, changed_at timestamp",
    "candidate_extraction": "change_raster_id bigint, methodology_id bigint",
    "quality_mask": "observation_id bigint, valid_pixel_fraction double",
    "disturbance_event": f"id bigint, aoi_id bigint, methodology_id bigint, {BOX}, status string, first_detected_at timestamp, last_detected_at timestamp",
    "manual_review": "id bigint, event_id bigint, opinion string, notes string, reviewer string",
    "event_observation": "id bigint, event_id bigint, candidate_id bigint, observed_at timestamp, growth_m2 double",
    "confidence_assessment": "id bigint, event_id bigint, rule_version string, level string, score double, inputs string",
    "context_layer": "id bigint, name string, kind string",
    "context_feature": f"id bigint, layer_id bigint, {BOX}, properties map<string,string>",
    "event_context": "event_id bigint, feature_id bigint, relation string, distance_m double",
    "pipeline_run": "id bigint, aoi_id bigint, started_at timestamp, status string, since date, until date, methodology_id bigint, geometry_hash string, summary string",
    "pipeline_run_event": "id bigint, run_id bigint, occurred_at timestamp, stage string, outcome string, message string",
}

STATUSES = ("new", "ongoing", "resolved")
RUN_STATUSES = ("running", "succeeded", "partial", "failed", "interrupted")
