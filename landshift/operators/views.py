"""Views that reports are made of; each takes catalog tables and gives one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landshift.functions.text import blank_to_null, sanitized, stamp
from landshift.operators.catalog import latest
from landshift.sources.shared import written

RECENT_RUNS, TAIL = 20, 50
SHORT_TEXT, TASK_BYTES = 1 << 17, 1 << 25
_LINE = ("aoi_id", "lineage_id")


def area_listing(areas: DataFrame, events: DataFrame, files: DataFrame, cells: DataFrame) -> DataFrame:
    """Areas by name with events, the file that describes each (by the name inside it), and the bounds of its cells."""
    counts = areas.join(events.select(F.col("aoi_id"), F.col("id").alias("event_id")), areas.id == F.col("aoi_id"), "left").groupBy("id", "name").agg(F.count("event_id").alias("events"))
    bounds = cells.groupBy("aoi_id").agg(F.min("x0").alias("min_x"), F.min("y0").alias("min_y"), F.max("x1").alias("max_x"), F.max("y1").alias("max_y"))
    out = counts.join(files.select(F.col("name").alias("file_name"), "file"), sanitized(F.col("name")) == F.col("file_name"), "left").drop("file_name")
    return out.join(bounds, out.id == bounds.aoi_id, "left").drop("aoi_id").orderBy("name")


def quality_by_day(observations: DataFrame, quality: DataFrame, since) -> DataFrame:
    rows = observations.where(F.col("acquired_at") >= since).join(quality, observations.id == quality.observation_id)
    return rows.groupBy("aoi_id", F.to_date("acquired_at").alias("day")).agg(F.max("valid_pixel_fraction").alias("best_fraction"), F.count("*").alias("looks"))


def event_features(events: DataFrame, measurements: DataFrame, reviews: DataFrame, assessments: DataFrame, cell_area_m2: float) -> DataFrame:
    """Events with their latest measurement and its number of measurements, newest opinion and assessment."""
    by_event = Window.partitionBy("event_id")
    recency = by_event.orderBy(F.desc("observed_at"), F.desc("id"))
    last = measurements.select("event_id", "observed_at", "growth_m2", "id", F.count("*").over(by_event).alias("measurements"), F.row_number().over(recency).alias("recency")).where("recency = 1")
    opinion = latest(reviews, "event_id", F.col("id"), "opinion")
    score = latest(assessments, "event_id", F.col("id"), "level", "score", "inputs").withColumn("basis", F.get_json_object("inputs", "$.factors.agreement.basis")).drop("inputs")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * F.lit(cell_area_m2)
    out = events.select(F.col("id").alias("event_id"), "aoi_id", "status", area.alias("area_m2"))
    for table in (last.drop("id", "recency"), opinion, score):
        out = out.join(table, "event_id", "left")
    return out.withColumn("measurements", F.coalesce("measurements", F.lit(0).cast("long"))).orderBy("event_id")


def recent_runs(runs: DataFrame, log: DataFrame, methodologies: DataFrame, n: int = RECENT_RUNS) -> DataFrame:
    """The newest runs, their methodology's name, and when each last said something; only the newest meet the log."""
    top = runs.orderBy(F.desc("started_at"), F.desc("id")).limit(n)
    said = log.groupBy("run_id").agg(F.max("occurred_at").alias("last_event_at"))
    out = top.join(said, top.id == said.run_id, "left").drop("run_id").join(methodologies.select(F.col("id").alias("methodology_id"), F.col("name").alias("methodology")), "methodology_id", "left")
    return out.orderBy(F.desc("started_at"), F.desc("id"))


def run_progress(log: DataFrame) -> DataFrame:
    """Per run: rasters exported, failures, and the number of the latest raster batch."""
    good = F.col("outcome") == "succeeded"
    return log.groupBy("run_id").agg(F.coalesce(F.sum(F.when(good, F.col("exports"))), F.lit(0).cast("long")).alias("exported"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.max_by("exports", F.when(F.col("exports").isNotNull(), F.col("id"))).alias("latest_batch"))


def run_tail(log: DataFrame, run_id: int, n: int = TAIL) -> DataFrame:
    """The last lines of a run's log, oldest first."""
    return log.where(F.col("run_id") == run_id).orderBy(F.desc("id")).limit(n).orderBy("id").select("id", stamp(F.col("occurred_at")).alias("at"), "stage", "outcome")


def methodology_use(methodologies: DataFrame, runs: DataFrame) -> DataFrame:
    used = runs.groupBy("methodology_id").agg(F.count("*").alias("runs"), F.max("started_at").alias("last_used_at"))
    out = methodologies.join(used, methodologies.id == used.methodology_id, "left").drop("methodology_id")
    return out.withColumn("runs", F.coalesce("runs", F.lit(0).cast("long"))).orderBy(F.desc("id"))


def layer_registry(layers: DataFrame, features: DataFrame) -> DataFrame:
    counts = features.groupBy("layer_id").agg(F.count("*").alias("features"))
    out = layers.join(counts, layers.id == counts.layer_id, "left").drop("layer_id")
    return out.withColumn("features", F.coalesce("features", F.lit(0).cast("long"))).orderBy("kind", "name")


def layer_features(features: DataFrame, layers: DataFrame) -> DataFrame:
    """Features with their properties, into which id and kind are merged."""
    rows = features.join(layers.select(F.col("id").alias("l_id"), "kind"), F.col("layer_id") == F.col("l_id"))
    own = F.create_map(F.lit("name"), blank_to_null(F.col("name")))
    merged = F.map_concat(own, F.create_map(F.lit("id"), F.col("id").cast("string"), F.lit("kind"), F.col("kind")))
    return rows.select("id", "layer_id", merged.alias("properties"))


def event_context(relations: DataFrame, features: DataFrame, layers: DataFrame) -> DataFrame:
    """Relations with names, touching ones first, then by distance."""
    rows = relations.join(features.select(F.col("id").alias("feature_id"), "layer_id", "name"), "feature_id").join(layers.select(F.col("id").alias("layer_id"), F.col("name").alias("layer")), "layer_id")
    order = Window.partitionBy("event_id").orderBy(F.asc_nulls_first("distance_m"), "feature_id")
    return rows.select("event_id", "feature_id", "layer", blank_to_null(F.col("name")).alias("name"), "relation", "distance_m", F.row_number().over(order).cast("long").alias("place"))


def timeline(measurements: DataFrame, candidates: DataFrame, rasters: DataFrame) -> DataFrame:
    """Measurements of events with the candidate's statistics and the raster they rest on."""
    rows = measurements.join(candidates.select(F.col("id").alias("candidate_id"), "change_raster_id", "area_m2", "delta_mean"), "candidate_id")
    rows = rows.join(rasters.select(F.col("id").alias("change_raster_id"), "path"), "change_raster_id")
    return rows.select("event_id", "candidate_id", "observed_at", "growth_m2", "area_m2", "delta_mean", "path")


def inventory(areas: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """What hangs on each area, counted per table (with aoi_id) before any join."""
    out = areas.select(F.col("id").alias("aoi_id"), "name")
    for name, table in tables.items():
        out = out.join(table.groupBy("aoi_id").agg(F.count("*").alias(name)), "aoi_id", "left")
    return out.na.fill(0, list(tables))


def box_geometry(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1"):
    """A box as GeoJSON geometry."""
    a, b, c, d = (F.col(x).cast("double") for x in (x0, y0, x1, y1))
    ring = F.array(F.array(a, b), F.array(c, b), F.array(c, d), F.array(a, d), F.array(a, b))
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def run_detail(runs: DataFrame, log: DataFrame, areas: DataFrame, methodologies: DataFrame) -> DataFrame:
    """One row per run: its header with names, and its progress."""
    out = runs.join(areas.select(F.col("id").alias("aoi_id"), F.col("name").alias("area")), "aoi_id", "left")
    out = out.join(methodologies.select(F.col("id").alias("methodology_id"), F.col("name").alias("methodology")), "methodology_id", "left")
    progress = run_progress(log).withColumnRenamed("run_id", "id")
    lines = log.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("lines"))
    return out.join(progress, "id", "left").join(lines, "id", "left").na.fill(0, ["exported", "failed", "lines"])


def event_detail(features: DataFrame, context: DataFrame, lines: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per event: its feature, and its context, timeline and reviews as ordered lists."""
    near = context.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("place", "relation", "layer", "name"))).alias("context"))
    time = lines.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("observed_at", "candidate_id", "path"))).alias("timeline"))
    said = reviews.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("id", "opinion")), asc=False).alias("reviews"))
    out = features
    for table in (near, time, said):
        out = out.join(table, "event_id", "left")
    return out


def lineage_looks(events: DataFrame, observations: DataFrame, rasters: DataFrame, methodologies: DataFrame, index: str = "NBR", as_text: bool = False) -> DataFrame:
    """Per event, the rasters of one index and of its own lineage over its area, in order of time.

    Rasters meet events by area and lineage; ``methodologies`` (id, lineage_id) is a small registry. ``as_text``: the number
    of looks and their observations' ids, joined by commas (looks, ids), null where there are none, instead of the list.
    """
    own = events.select(F.col("id").alias("event_id"), "aoi_id", "methodology_id").join(F.broadcast(methodologies.select(F.col("id").alias("methodology_id"), "lineage_id")), "methodology_id")
    looks = rasters.where(F.col("index_type") == index).select("observation_id", "lineage_id").join(observations.select(F.col("id").alias("observation_id"), "aoi_id", "acquired_at"), "observation_id")
    if as_text:
        return _told(own, _look_texts(looks)).select("event_id", "looks", "ids")
    line = looks.groupBy(*_LINE).agg(F.sort_array(F.collect_list(F.struct("acquired_at", "observation_id"))).alias("looks"))
    return own.join(line, list(_LINE), "left").select("event_id", "looks")


def _look_texts(looks: DataFrame) -> DataFrame:
    """(aoi_id, lineage_id, looks, ids): texts are made a day at a time, so that looks are never all in one list."""
    listed = F.sort_array(F.collect_list(F.struct("acquired_at", "observation_id")))
    days = looks.groupBy(*_LINE, F.to_date("acquired_at").alias("day")).agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda x: x["observation_id"].cast("string")), ",").alias("text"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("day", "text"))), lambda x: x["text"])
    return days.groupBy(*_LINE).agg(F.sum("n").alias("looks"), F.array_join(texts, ",").alias("ids"))


def _told(own: DataFrame, line: DataFrame) -> DataFrame:
    """Events with the text of their area and lineage. Where texts are long, a task has rows of about ``TASK_BYTES`` for a
    text, because what writes them holds a hundred rows before it looks at their size. Texts are not copied for that: they are
    dealt out once, and each task reads its own and some of their events."""
    own, line = written(own, "look-events", tidy=True), written(line.withColumn("size", F.length("ids")), "look-texts", tidy=True)
    events = own.groupBy(*_LINE).agg(F.count("*").alias("events"))
    widest, lines, most = line.join(events, list(_LINE)).agg(F.max("size"), F.count("*"), F.max("events")).first()
    if not widest or widest <= SHORT_TEXT:
        return own.join(line, list(_LINE), "left")
    parts = -(-most // max(1, TASK_BYTES // widest))
    turn = F.row_number().over(Window.partitionBy(*_LINE).orderBy("event_id")) % parts
    left = own.withColumn("turn", turn).repartitionById(parts, F.col("turn")).drop("turn")
    # More partitions than texts, so that few texts share one.
    right = line.select(*[F.col(c).alias(f"l_{c}") for c in _LINE], "looks", "ids").repartition(2 * lines, *[f"l_{c}" for c in _LINE])
    met = left.join(right.hint("shuffle_replicate_nl"), (F.col("aoi_id") == F.col("l_aoi_id")) & (F.col("lineage_id") == F.col("l_lineage_id")))
    none = own.join(line.select(*_LINE), list(_LINE), "left_anti")
    return met.select("event_id", "looks", "ids").unionByName(none.select("event_id"), allowMissingColumns=True)
