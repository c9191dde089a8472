"""One run over a window of scenes, stage by stage: from a listing to scored events in their context."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landshift.functions import text as fn
from landshift.operators import baseline, catalog, components, confidence, context, footprints, raster, tracking, trajectory
from landshift.sources.scenes import discovered, in_window
from landshift.sources.shared import Stages, written

OPTICAL, RADAR = 1, 2
SENSORS = {"HLSL30": "optical", "HLSS30": "optical", "S1GRD": "radar"}


@dataclasses.dataclass(frozen=True)
class Parameters:
    """Methodologies are numbered ``OPTICAL`` and ``RADAR``; forest masks hold for the optical one."""

    threshold: float = raster.THRESHOLD
    vv_threshold: float = raster.VV_THRESHOLD
    min_area_m2: float = raster.MIN_AREA_M2
    cell_area_m2: float = 900.0
    baseline: int = baseline.BASELINE
    mask: str = "none"
    canopy_percent: float = 30.0
    resolve_days: int = tracking.RESOLVE_DAYS
    clear_floor: float = tracking.CLEAR_FLOOR
    context_m: float = context.BUFFER_M
    scale_m: float = raster.SCALE_M
    rule: str = "v3"


@dataclasses.dataclass
class Inputs:
    """What a run reads.

    listing and known: scenes (id, aoi_id, sensor, orbit_direction, acquired_at, source_scene_id), found now and recorded
    before; pixels (observation_id, row, col, red, nir, swir2, fmask, vv); forest (row, col, treecover2000, lossyear,
    landcover); stored (observation_id, product): rasters with row and file; failed (observation_id): scenes whose
    export failed; features (id, kind, x0, y0, x1, y1); history: assessments so far.
    """

    listing: DataFrame
    known: DataFrame
    pixels: DataFrame
    forest: DataFrame | None = None
    stored: DataFrame | None = None
    failed: DataFrame | None = None
    features: DataFrame | None = None
    history: DataFrame | None = None


@dataclasses.dataclass
class Result:
    """Tables a run makes; each is written once and read by the stages after it."""

    quality: DataFrame
    rasters: DataFrame  # observation_id, product, reused
    sources: DataFrame  # change raster's scene and those of its baseline
    markers: DataFrame  # scenes searched, by methodology; also those without candidates
    candidates: DataFrame
    links: DataFrame
    events: DataFrame
    assessments: DataFrame
    context: DataFrame
    summary: DataFrame


_CANDIDATE = "id long, aoi_id long, methodology_id long, change_raster_id long, detected_at timestamp_ntz, x0 long, y0 long, x1 long, y1 long, area_m2 double, delta_mean double, delta_min double, valid_pixel_fraction double"
_SIDE = 1 << 20


def _patched(hits: DataFrame, value: str, scenes: DataFrame, methodology: int, p: Parameters, name: str, keep) -> tuple[DataFrame, DataFrame]:
    """(candidates, cells): patches of hits (scene_id, row, col, value), and the cells that each is made of."""
    cells = hits.select(F.col("scene_id").alias("scene"), "row", "col", F.col(value).alias("delta"))
    labelled = keep(lambda: components.patches(cells), name)
    found = components.patch_stats(labelled, "delta", p.cell_area_m2, p.min_area_m2).join(scenes.withColumnRenamed("id", "scene"), "scene")
    candidates = found.select(
        F.col("patch").alias("id"), "aoi_id", F.lit(methodology).cast("long").alias("methodology_id"), F.col("scene").alias("change_raster_id"), F.col("acquired_at").cast("timestamp_ntz").alias("detected_at"),
        F.col("col_from").cast("long").alias("x0"), F.col("row_from").cast("long").alias("y0"), (F.col("col_to") + 1).cast("long").alias("x1"), (F.col("row_to") + 1).cast("long").alias("y1"),
        "area_m2", "delta_mean", "delta_min", raster.pixel_fraction(F.col("cells"), F.col("area_m2"), p.cell_area_m2**0.5).alias("valid_pixel_fraction"),
    )
    return candidates, labelled.select(F.col("patch").alias("candidate_id"), "row", "col")


def _one_row(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.crossJoin(p)
    return out


def run(given: Inputs, since, until, now: Column, p: Parameters = Parameters(), folder: str | None = None, version: str = "") -> Result:
    """Baselines look further back than the window; only scenes inside it are searched for change.

    With a ``folder`` a run that was cut off goes on after its last finished table when it is started again; without one
    its tables are its own. ``version`` tells inputs apart that are not read from files."""
    spark = given.listing.sparkSession
    keep = Stages(spark, folder, vars(given), (p, str(since), str(until), str(now)), version).table if folder else lambda make, name: written(make() if callable(make) else make, name)
    listed = given.listing.where(in_window(F.col("acquired_at"), since, until))
    new, found = discovered(given.known, listed)
    scenes = keep(given.known.unionByName(new.select(*given.known.columns)), "run-scenes")
    failed = given.failed if given.failed is not None else spark.createDataFrame([], "observation_id long")
    scenes_ok = scenes.join(failed.select(F.col("observation_id").alias("id")), "id", "left_anti")
    wanted = keep(scenes_ok.where(in_window(F.col("acquired_at"), since, until)).select(F.col("id").alias("scene_id"), "sensor"), "run-wanted")
    optical = scenes_ok.where(F.col("sensor").isin(*raster.BANDS)).select("id", "aoi_id", "acquired_at")
    radar = scenes_ok.where(F.col("sensor") == "S1GRD").select("id", "aoi_id", "acquired_at", "orbit_direction")
    pixel = components.cell_id(F.lit(0), F.col("row"), F.col("col")).alias("pixel")

    # Masks and indices.
    seen = given.pixels.join(optical.select(F.col("id").alias("observation_id")), "observation_id", "left_semi")
    clear = raster.clear(F.col("fmask"))
    quality = keep(raster.valid_fraction(seen, clear, "observation_id"), "run-quality")
    index = keep(raster.indices(raster.masked(seen, clear, "red", "nir", "swir2")).select("observation_id", pixel, "nbr"), "run-index")

    # Change against the baseline, of scenes in the window.
    inside = wanted.select("scene_id")
    pairs = baseline.trailing(optical, p.baseline).join(inside, "scene_id", "left_semi")
    sources = keep(pairs.unionByName(baseline.trailing(radar, p.baseline, ("aoi_id", "orbit_direction")).join(inside, "scene_id", "left_semi")), "run-sources")
    changed = sources.select("scene_id").distinct().join(wanted, "scene_id")
    place = lambda df: df.withColumns({"row": F.floor(F.col("pixel") / _SIDE), "col": F.col("pixel") % _SIDE})
    deltas = baseline.deltas(optical, index, "nbr", n=p.baseline).join(inside, "scene_id", "left_semi")
    hits = place(raster.hits(deltas, "delta_nbr", p.threshold))
    if p.mask != "none":
        hits = raster.aligned(hits, given.forest.withColumn("keep", raster.forest(p.mask, p.canopy_percent)), 1)
    echoes = given.pixels.select("observation_id", pixel, "vv")
    vv = baseline.deltas(radar, echoes, "vv", n=p.baseline, same=("aoi_id", "orbit_direction")).join(inside, "scene_id", "left_semi")
    ours, ours_cells = _patched(hits, "delta_nbr", optical, OPTICAL, p, "run-patches", keep)
    theirs, their_cells = _patched(place(raster.hits(vv, "delta_vv", p.vv_threshold)), "delta_vv", radar.drop("orbit_direction"), RADAR, p, "run-echoes", keep)
    candidates = keep(ours.unionByName(theirs), "run-candidates")
    methodology = F.when(F.col("sensor") == "S1GRD", RADAR).otherwise(OPTICAL).cast("long")
    markers = keep(changed.select(F.col("scene_id").alias("change_raster_id"), methodology.alias("methodology_id")), "run-markers")
    products = wanted.where(F.col("sensor") != "S1GRD").select("scene_id", F.explode(F.array(F.lit("NBR"), F.lit("NDVI"))).alias("product"))
    products = products.unionByName(changed.select("scene_id", F.explode(F.when(F.col("sensor") == "S1GRD", F.array(F.lit("delta_vv_db"))).otherwise(F.array(F.lit("delta_nbr"), F.lit("delta_ndvi")))).alias("product")))
    stored = given.stored if given.stored is not None else spark.createDataFrame([], "observation_id long, product string")
    held = stored.select(F.col("observation_id").alias("scene_id"), "product", F.lit(True).alias("is_stored")).distinct()
    rasters = products.join(held, ["scene_id", "product"], "left").select(F.col("scene_id").alias("observation_id"), "product", F.coalesce("is_stored", F.lit(False)).alias("reused"))
    rasters = keep(rasters, "run-rasters")

    # Events.
    cells = ours_cells.unionByName(their_cells)
    runs = keep(footprints.runs(cells, "candidate_id"), "run-footprints")
    links = keep(lambda: tracking.tracked(candidates, runs, ("change_raster_id",)), "run-links")
    area = keep(tracking.event_footprints(links, runs), "run-event-footprints")
    members = links.join(candidates.withColumnRenamed("id", "candidate_id"), "candidate_id")
    bounds = members.groupBy("event_id").agg(F.first("aoi_id").alias("aoi_id"), F.first("methodology_id").alias("methodology_id"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    events = tracking.summarised(members).join(bounds, "event_id").withColumnRenamed("event_id", "id")
    events = keep(events, "run-open")
    after = keep(tracking.resolved(events, optical, quality, now, p.resolve_days, p.clear_floor), "run-events")

    # Confidence: statistics, what the other sensor saw, and what came after.
    sensors = spark.createDataFrame(list(SENSORS.items()), "name string, kind string")
    looks = scenes_ok.join(F.broadcast(sensors), F.col("sensor") == F.col("name")).select("id", "aoi_id", "kind", "sensor", F.col("acquired_at").cast("timestamp_ntz").alias("acquired_at"))
    kinds = confidence.own_kinds(links, candidates, scenes_ok, sensors)
    marked = candidates.join(looks.select(F.col("id").alias("change_raster_id"), "kind"), "change_raster_id")
    agree = confidence.agreement(after, kinds, looks, marked, footprints=(area, runs.withColumnRenamed("candidate_id", "id"))).select(F.col("event_id").alias("id"), "agreement")
    footprint = footprints.cells(area, "id").select(F.col("id").alias("event_id"), components.cell_id(F.lit(0), F.col("row"), F.col("col")).alias("cell"))
    points = trajectory.series(trajectory.footprint_samples(after, optical, index, footprint))
    states = trajectory.classified(after, points).select(F.col("event_id").alias("id"), "state")
    scored = after.join(confidence.event_stats(links, candidates).withColumnRenamed("event_id", "id"), "id").join(agree, "id", "left").join(states, "id", "left")
    days = fn.days_between(F.col("last_detected_at"), now)
    scored = confidence.weighted(scored.withColumns({"magnitude": confidence.magnitude(F.col("delta_min")), "persistence": confidence.persistence(F.col("measurements")), "coverage": fn.clamped(F.col("mean_valid_fraction")), "currency": confidence.currency(days), "stability": confidence.stability(F.col("state"))}))
    after = keep(scored.select("id", "aoi_id", "methodology_id", "status", "first_detected_at", "last_detected_at", "members", "x0", "y0", "x1", "y1", "agreement", "state", "score", "level", "missing"), "run-scored")
    history = given.history if given.history is not None else spark.createDataFrame([], "id long, event_id long, rule_version string, level string, score double")
    assessments = keep(confidence.moved(after.select(F.col("id").alias("event_id"), "level", "score"), history, p.rule), "run-assessments")
    features = given.features if given.features is not None else spark.createDataFrame([], "id long, kind string, x0 long, y0 long, x1 long, y1 long")
    related = keep(context.relations(after.select("id", "x0", "y0", "x1", "y1"), features, p.context_m, p.scale_m), "run-context")

    of = lambda *names: F.col("product").isin(*names)
    n = lambda test, name: F.count_if(test).alias(name)
    index_of, change_of, radar_of = of("NBR", "NDVI"), of("delta_nbr", "delta_ndvi"), of("delta_vv_db")
    summary = _one_row(
        found.select(*[F.col(c).alias(f"observations_{c}") for c in ("discovered", "recorded", "skipped")]),
        rasters.agg(n(index_of, "index_rasters"), n(index_of & F.col("reused"), "index_rasters_reused"), n(change_of, "change_rasters"), n(change_of & F.col("reused"), "change_rasters_reused"), n(radar_of, "radar_change_rasters"), n(radar_of & F.col("reused"), "radar_change_rasters_reused")),
        candidates.agg(n(F.col("methodology_id") == OPTICAL, "candidates"), n(F.col("methodology_id") == RADAR, "radar_candidates")),
        events.agg(F.count("*").alias("events_created")),
        links.agg(F.count("*").alias("event_observations")),
        scenes.where(in_window(F.col("acquired_at"), since, until)).join(failed.select(F.col("observation_id").alias("id")), "id", "left_semi").agg(F.count("*").alias("export_failures")),
        after.agg(n(F.col("status") == "resolved", "events_resolved")),
        assessments.agg(F.count("*").alias("confidence_assessments")),
        related.agg(F.count("*").alias("context_relations")),
    )
    return Result(quality, rasters, sources, markers, candidates, links, after, assessments, related, summary)
