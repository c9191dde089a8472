"""Changes of catalog tables as functions from one state to the next, to be written in place of the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inserted(existing: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of ``new`` whose key is not there yet; of repeats, one."""
    return new.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")


def upserted(existing: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """``new`` takes the place of rows with its keys."""
    return existing.join(new.select(*key), list(key), "left_anti").unionByName(new)


def replaced(existing: DataFrame, new: DataFrame, scope: DataFrame, *key: str) -> DataFrame:
    """All rows in ``scope`` (a table of keys) give way to ``new``, which may have none for a key."""
    return existing.join(scope.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def without(existing: DataFrame, gone: DataFrame, on: str, gone_on: str = "id") -> DataFrame:
    """Rows that do not hang on a deleted one."""
    return existing.join(gone.select(F.col(gone_on).alias(on)).distinct(), on, "left_anti")


def latest(df: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """The columns of the row that is last in ``order``, per key; no window, so keys may be large."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("last"))
    return best.select(key, *[F.col("last")[c].alias(c) for c in columns])


def versions(minted: DataFrame, *, name: str = "name", script: str = "script", order: str = "id") -> DataFrame:
    """``minted`` with label X.Y.Z: the first of a name is 1.0.0, another script raises Y, any other change Z."""
    line = Window.partitionBy(name).orderBy(order)
    before, place = F.lag(script).over(line), F.row_number().over(line)
    rows = minted.withColumn("bump", ((place > 1) & ~F.col(script).eqNullSafe(before)).cast("int"))
    rows = rows.withColumn("minor", F.sum("bump").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(name, "minor").orderBy(order)
    label = F.concat(F.lit("1."), F.col("minor").cast("string"), F.lit("."), (F.row_number().over(inside) - 1).cast("string"))
    return rows.withColumn("display_version", label).drop("bump", "minor")


def with_previous(runs: DataFrame) -> DataFrame:
    """Runs with those warnings that the run before of the same area gives rise to; stale ones interrupted."""
    line = Window.partitionBy("aoi_id").orderBy("started_at", "id")
    before = {c: F.lag(c).over(line) for c in ("methodology_id", "geometry_hash")}
    changed = lambda c: (before[c].isNotNull() & F.col(c).isNotNull() & (before[c] != F.col(c)))
    stale = (F.col("status") == "running") & F.lead("id").over(line).isNotNull()
    return runs.withColumns({"methodology_changed": F.coalesce(changed("methodology_id"), F.lit(False)), "geometry_changed": F.coalesce(changed("geometry_hash"), F.lit(False)), "status_now": F.when(stale, "interrupted").otherwise(F.col("status"))})


def parameter_changes(before: Column, after: Column) -> Column:
    """Sorted keys of two maps whose values differ or that only one has."""
    keys = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    return F.filter(keys, lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k)))


def plan_rasters(wanted: DataFrame, frozen: DataFrame, stored: DataFrame) -> DataFrame:
    """``wanted`` (raster_id) with what to do: frozen (evidence of an event), reused (row and file), or computed."""
    f, s = (df.select("raster_id").distinct().withColumn(n, F.lit(True)) for df, n in ((frozen, "is_frozen"), (stored, "is_stored")))
    out = wanted.join(f, "raster_id", "left").join(s, "raster_id", "left")
    return out.select("raster_id", F.when(F.col("is_frozen"), "frozen").when(F.col("is_stored"), "reused").otherwise("computed").alias("action"))


def marked(extractions: DataFrame, scope: DataFrame) -> DataFrame:
    """The markers (change_raster_id, methodology_id) after ``scope`` was extracted; a raster without candidates has one, too."""
    key = ("change_raster_id", "methodology_id")
    return extractions.select(*key).unionByName(scope.select(*key)).distinct()


def extraction_state(rasters: DataFrame, methodologies: DataFrame, markers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per raster and methodology: whether it was extracted, and how many candidates it has."""
    key = ["change_raster_id", "methodology_id"]
    # The methodologies in use are a registry of a few rows.
    pairs = rasters.select(F.col("id").alias("change_raster_id")).join(F.broadcast(methodologies.select(F.col("id").alias("methodology_id"))))
    counts = candidates.groupBy(*key).agg(F.count("*").alias("candidates"))
    out = pairs.join(markers.select(*key, F.lit(True).alias("extracted")), key, "left").join(counts, key, "left")
    return out.select(*key, F.coalesce("extracted", F.lit(False)).alias("extracted"), F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"))


def extraction_plan(state: DataFrame, stored: DataFrame, masks: DataFrame, sources: DataFrame) -> DataFrame:
    """How to have each pair's candidates: counted, from the stored raster under a mask that is there, rebuilt
    from recorded sources, or refused. ``stored`` and ``sources``: change_raster_id; ``masks``: methodology_id."""
    flag = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    out = state.join(flag(stored, "change_raster_id", "is_stored"), "change_raster_id", "left").join(flag(masks, "methodology_id", "has_mask"), "methodology_id", "left")
    out = out.join(flag(sources, "change_raster_id", "has_source"), "change_raster_id", "left")
    way = F.when(F.col("extracted"), "counted").when(F.col("is_stored") & F.col("has_mask"), "local").when(F.col("has_source"), "rebuilt").otherwise("refused")
    return out.select("change_raster_id", "methodology_id", way.alias("way"))


def areas_stored(existing: DataFrame, loaded: DataFrame, first_id: int) -> DataFrame:
    """Next state of areas (id, name, geometry, differs): a stored geometry wins, and it is told if the loaded one is another."""
    theirs = loaded.groupBy("name").agg(F.min("geometry").alias("new_geometry"))
    kept = existing.join(theirs, "name", "left").select("id", "name", "geometry", F.coalesce(F.col("new_geometry") != F.col("geometry"), F.lit(False)).alias("differs"))
    fresh = theirs.join(existing.select("name"), "name", "left_anti")
    numbered = fresh.select((F.row_number().over(Window.orderBy("name")) + (first_id - 1)).cast("long").alias("id"), "name", F.col("new_geometry").alias("geometry"), F.lit(False).alias("differs"))
    return kept.unionByName(numbered)


def run_started(runs: DataFrame, log: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and log after runs (id, aoi_id, started_at, methodology_id, geometry_hash) begin: stale ones of the area
    are interrupted, and a changed methodology or footprint is a warning in the log (run_id, stage, outcome, message)."""
    begun = new.withColumn("status", F.lit("running"))
    every = with_previous(runs.unionByName(begun.select(*runs.columns)))
    headers = every.select(*[F.col("status_now").alias("status") if c == "status" else F.col(c) for c in runs.columns])
    told = every.join(new.select("id"), "id", "left_semi").select("id", F.explode(F.array_compact(F.array(F.when(F.col("methodology_changed"), "methodology changed"), F.when(F.col("geometry_changed"), "area geometry changed")))).alias("message"))
    warned = told.select(F.col("id").alias("run_id"), F.lit("run").alias("stage"), F.lit("warning").alias("outcome"), "message")
    return headers, log.unionByName(warned)


def run_finished(runs: DataFrame, ended: DataFrame) -> DataFrame:
    """Headers after runs (id, status) came to an end."""
    out = runs.join(ended.select("id", F.col("status").alias("end_status")), "id", "left")
    return out.withColumn("status", F.coalesce("end_status", "status")).drop("end_status").select(*runs.columns)


def reproducible(rasters: DataFrame, sources: DataFrame, lineages: DataFrame, script: str, force: bool = False) -> DataFrame:
    """What stands against making each raster (id, path, derived_path, lineage_id) again; null if nothing does."""
    known = sources.select(F.col("change_raster_id").alias("id")).distinct().withColumn("has_source", F.lit(True))
    rows = rasters.join(lineages.select(F.col("id").alias("lineage_id"), "script"), "lineage_id", "left").join(known, "id", "left")
    problem = (
        F.when(F.col("script").isNull(), "no lineage").when((F.col("script") != script) & F.lit(not force), "another script version")
        .when(F.col("has_source").isNull(), "no recorded baseline").when(F.col("derived_path") != F.col("path"), "another path")
    )
    return rows.select("id", "path", problem.alias("problem"))
