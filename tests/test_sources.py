import datetime
import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from landshift.functions import hashes, text
from landshift.operators import catalog
from landshift.sources import exports, geojson, overrides, scenes, shared
from landshift.streaming import ingest


def _square(**more):
    return {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 2], [0, 0]]]}, "properties": {"name": "area"}, **more}


FILES = {
    "good.geojson": _square(),
    "collection.geojson": {"type": "FeatureCollection", "features": [_square()], "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}},
    "two.geojson": {"type": "FeatureCollection", "features": [_square(), _square()]},
    "nameless.geojson": _square(properties={"name": " "}),
    "line.geojson": _square(geometry={"type": "LineString", "coordinates": [[0, 0], [1, 1]]}),
    "metric.geojson": _square(crs={"type": "name", "properties": {"name": "EPSG:32756"}}),
    "empty.geojson": _square(geometry={"type": "Polygon", "coordinates": []}),
    "road--north--1.geojson": {"type": "FeatureCollection", "features": [_square(geometry={"type": "Point", "coordinates": [3, 4]}), _square()]},
}


@pytest.fixture
def folder(tmp_path):
    for name, doc in FILES.items():
        (tmp_path / name).write_text(json.dumps(doc))
    (tmp_path / "broken.geojson").write_text("{")
    (tmp_path / "notes.txt").write_text("no")
    return str(tmp_path)


def test_areas(spark, folder):
    got = {r.path.rpartition("/")[2]: r for r in geojson.areas(geojson.documents(spark, folder)).collect()}
    assert len(got) == len(FILES) + 1
    assert {n for n, r in got.items() if r.problem is None} == {"good.geojson", "collection.geojson"}
    problems = {n: r.problem for n, r in got.items() if r.problem}
    assert problems["two.geojson"] == "more than one feature" and problems["nameless.geojson"] == "no name" and problems["line.geojson"] == "not a polygon"
    assert problems["metric.geojson"] == "not in WGS84" and problems["empty.geojson"] == "no geometry" and problems["broken.geojson"]
    assert got["good.geojson"].multipolygon.replace(" ", "").startswith("[[[[0,0]")
    bounds = geojson.points(geojson.areas(geojson.documents(spark, folder)).where("problem IS NULL"), "multipolygon").first()
    assert (bounds.min_x, bounds.min_y, bounds.max_x, bounds.max_y) == (0, 0, 1, 2)


def test_harvest(spark, folder):
    rows = geojson.harvested(geojson.documents(spark, folder)).collect()
    good = [r for r in rows if r.problem is None]
    assert {(r.kind, r.name, r.place, r.geometry_type) for r in good} == {("road", "north--1", 0, "Point"), ("road", "north--1", 1, "Polygon")}
    assert len([r for r in rows if r.problem == "file name"]) == len(FILES)


def test_feature_sink(spark):
    row = spark.range(1).select(geojson.feature_json(F.struct(F.lit("Point").alias("type"), F.array(F.lit(1.0), F.lit(2.0)).alias("coordinates")), F.create_map(F.lit("a"), F.lit("b")))).first()[0]
    assert json.loads(row) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"a": "b"}}


def test_listings(spark):
    rows = [("a/b/S1", {"system:time_start": "1767225600000", "CLOUD_COVERAGE": "10"}, None), ("x", {"system:index": "S2", "system:time_start": "1767225600000", "CLOUD_COVERAGE": "?"}, None)]
    got = scenes.optical(spark.createDataFrame(rows, scenes.LISTING)).collect()
    assert [(r.source_scene_id, r.cloud_cover) for r in got] == [("S1", 10.0), ("S2", None)]
    with pytest.raises(Exception, match="scene without a time"):
        scenes.optical(spark.createDataFrame([("x", {}, None)], scenes.LISTING)).collect()
    radar = [("a", {"instrumentMode": "IW"}, ["VV", "VH"]), ("b", {"instrumentMode": "EW"}, ["VV"]), ("c", {"instrumentMode": "IW"}, None)]
    assert [r.id for r in scenes.eligible_radar(spark.createDataFrame(radar, scenes.LISTING)).collect()] == ["a"]


def test_discovery_twice_adds_nothing(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a")], "aoi_id long, source_scene_id string")
    new, counts = scenes.discovered(rows.limit(0), rows)
    assert counts.first()[:] == (3, 2, 1)
    assert scenes.discovered(new, rows)[1].first()[:] == (3, 0, 3)


def test_raster_layout_prunes_and_replaces(spark, tmp_path):
    path = str(tmp_path / "rasters")
    rows = [("a", p, d, r, c, 1.0) for p in ("nbr", "ndvi") for d in ("2026-01-01", "2026-01-02") for r in range(4) for c in range(4)]
    df = spark.createDataFrame(rows, "aoi string, product string, date string, row long, col long, value double")
    exports.write_rasters(df, path)
    exports.write_rasters(df.where("product = 'nbr' AND date = '2026-01-01'").withColumn("value", F.lit(2.0)), path)
    got = exports.read_window(spark, path, (1, 3), (0, 2), product="nbr")
    assert got.count() == 8 and got.agg(F.sum("value")).first()[0] == 12
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(product" in plan and "PushedFilters" in plan


def test_prune_and_retention(spark):
    files = spark.createDataFrame([("a/nbr/2026-01-01/x.tif", 10), ("a/nbr/2026-02-01/x.tif", 20), ("a/nbr/soon/x.tif", 30), ("stray.tif", 40)], "path string, bytes long")
    assert exports.prune_report(files, datetime.date(2026, 1, 15)).first()[:] == (1, 10, 1, 1)
    assert exports.kept_days(10, 30) == (44, True) and exports.kept_days(90, 30) == (90, False)
    gone = exports.missing_report(files.select("path"), files.limit(1)).first()
    assert (gone.cataloged, gone.missing, gone.warn) == (4, 3, True)
    assert exports.missing_report(files.limit(0).select("path"), files).first()[:] == (0, 0, 0.0, False)


def test_settings():
    got = overrides.parsed("# c\nA=1\n\nno\nA=2\nB = x=y \n")
    assert got == {"A": "2", "B": "x=y"}
    assert overrides.resolve("A", got, {"A": "9"}, "0") == ("2", "override") and overrides.resolve("C", got, {"C": ""}, "0") == ("0", "default")
    assert overrides.validated("5", "int", 1, 9) == "5"
    for bad in (("x", "int"), ("10", "int", 1, 9), ("nan", "float", 0, 1)):
        with pytest.raises(ValueError):
            overrides.validated(*bad)
    with pytest.raises(ValueError):
        overrides.validated("abc", pattern="[a-b]+")


def test_catalog_states(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(catalog.upserted(old, spark.createDataFrame([(2, "x"), (4, "y")], old.schema), "id")) == [(1, "a"), (2, "x"), (3, "c"), (4, "y")]
    assert rows(catalog.replaced(old, old.limit(0), old.where("id < 3"), "id")) == [(3, "c")]
    assert rows(catalog.without(old.withColumnRenamed("id", "k"), spark.createDataFrame([(1,)], "id long"), "k")) == [(2, "b"), (3, "c")]
    minted = spark.createDataFrame([(1, "m", "s"), (2, "m", "s"), (3, "m", "t"), (4, "m", "t"), (5, "n", "s")], "id long, name string, script string")
    assert [r.display_version for r in catalog.versions(minted).orderBy("id").collect()] == ["1.0.0", "1.0.1", "1.1.0", "1.1.1", "1.0.0"]


def test_hashes(spark):
    assert hashes.parameter_hash({"b": 1, "a": 2}) == hashes.parameter_hash({"a": 2, "b": 1})
    row = spark.range(1).select(hashes.short_hash(hashes.canonical(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))), 10)).first()[0]
    assert row == hashes.parameter_hash({"a": 2, "b": 1})


def test_streamed_scenes_are_recorded_once(spark, tmp_path):
    schema = "aoi_id long, source_scene_id string, acquired_at timestamp"
    at = datetime.datetime(2026, 1, 1)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for batch in ([(1, "a", at), (1, "a", at), (2, "a", at)], [(1, "a", at), (1, "b", at)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.recorded_once(spark.readStream.schema(schema).parquet(source))
        ingest.into_catalog(stream, out, check).awaitTermination()
    assert sorted((r.aoi_id, r.source_scene_id) for r in spark.read.parquet(out).collect()) == [(1, "a"), (1, "b"), (2, "a")]


def test_partitions_are_pruned_by_date(spark, tmp_path):
    path = str(tmp_path / "rasters")
    exports.write_rasters(spark.createDataFrame([("a", "nbr", d, 1.0) for d in ("2026-01-01", "2026-02-01", "soon")], "aoi string, product string, date string, value double"), path)
    assert [p.rsplit("/", 1)[1] for p in exports.pruned(spark, path, datetime.date(2026, 1, 15))] == ["date=2026-01-01"]
    assert sorted(r.date for r in spark.read.option("inferSchema", False).parquet(path).select(F.col("date").cast("string")).collect()) == ["2026-02-01", "soon"]


def test_a_catalog_table_is_read_and_replaced(spark, tmp_path):
    path = str(tmp_path / "table")
    assert shared.current(spark, path) is None
    shared.published(spark.range(3), path)
    for _ in range(3):  # what is written may be what is read
        shared.published(shared.current(spark, path).withColumn("id", F.col("id") + 1), path)
    assert sorted(r.id for r in shared.current(spark, path).collect()) == [3, 4, 5]
    assert len(shared.folders(spark, f"{path}/version=*")) == 2


def test_a_stage_that_was_finished_is_not_made_again(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(2)

    path = str(tmp_path / "stage")
    assert shared.resumed(make, path, spark).count() == shared.resumed(make, path, spark).count() == 2 and len(made) == 1
    (tmp_path / "stage" / "_SUCCESS").unlink()  # cut off while it was written
    assert shared.resumed(make, path, spark).count() == 2 and len(made) == 2


def test_dates_are_utc_in_any_zone(spark):
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Guadalcanal")
        row = spark.sql("SELECT TIMESTAMP '2026-01-02 03:00:00 UTC' AS z, TIMESTAMP_NTZ '2026-01-02 03:00:00' AS n").select(text.utc_date(F.col("z")), text.stamp(F.col("z")), text.stamp(F.col("n"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row[:] == ("2026-01-02", "2026-01-02T03:00:00Z", "2026-01-02T03:00:00Z")


def test_paths_forms_orbits_and_settings(spark):
    rows = [("./a//b/./c", "a/b/c"), ("x/../a/b", "a/b"), ("/a/b", "/a/b"), ("../a", "../a"), ("a/b/../../c", "c"), ("a/../../b/..", ".."), ("/../a/./b//../c/", "/a/c"), ("../../a/../b", "../../b"), (None, None)]
    got = spark.createDataFrame(rows, "path string, want string").select(text.canonical_path(F.col("path")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got
    assert spark.range(1).select(text.known_orbit(F.lit("ASCENDING")), text.known_orbit(F.lit(None).cast("string"))).first()[:] == ("ASCENDING", None)
    with pytest.raises(Exception, match="unknown orbit direction"):
        spark.range(1).select(text.known_orbit(F.concat(F.lit("SIDE"), F.col("id").cast("string")))).collect()
    overrides.in_order({"LOW": "1", "HIGH": "2"}, "LOW", "HIGH")
    with pytest.raises(ValueError, match="LOW must not be above HIGH"):
        overrides.in_order({"LOW": "3", "HIGH": "2"}, "LOW", "HIGH")


def test_geometry_hashes_and_shapes(spark):
    square, turned, other = "[[[0,0],[1,0],[1,1],[0,1],[0,0]]]", "[[[1,1],[1,0],[0,0],[0,1],[1,1]]]", "[[[0,0],[2,0],[2,1],[0,1],[0,0]]]"
    df = spark.createDataFrame([(square,), (f"[{square}]",), (turned,), (other,), (None,)], "c string").coalesce(1)
    rows = df.select(hashes.geometry_hash("c"), hashes.canonical_shape("c")).collect()
    ring = b"".join(struct.pack("<dd", *p) for p in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))
    wkb = struct.pack("<BIIBIII", 1, 6, 1, 1, 3, 1, 5) + ring
    assert rows[0][0] == rows[1][0] == hashlib.sha256(wkb).hexdigest()[:12] != rows[2][0]
    assert rows[0][1] == rows[1][1] == rows[2][1] != rows[3][1] and rows[4][:] == (None, None)


def test_area_from_bounds():
    doc = json.loads(geojson.area_from_bounds(159, -10, 160.5, -9, " north "))
    assert doc["properties"]["name"] == "north" and doc["geometry"]["coordinates"][0][2] == [160.5, -9]
    for bad in ((160, -10, 159, -9, "x"), (159, -10, 160, -10, "x"), (159, -91, 160, -9, "x"), (159, -10, 160, -9, " ")):
        with pytest.raises(ValueError):
            geojson.area_from_bounds(*bad)


def test_crossing_areas_are_told(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "Feature", "properties": {"name": "x"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]]]}}))
    assert geojson.areas(geojson.documents(spark, str(tmp_path))).first().problem == "crosses itself"
