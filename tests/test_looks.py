"""Looks of a lineage as text."""

import datetime

from pyspark.sql import functions as F

from landshift.operators import views


def _tables(spark):
    """Four areas with 60 looks each, three a day, and 40 events each; no look of area 4 is of a lineage that is in use."""
    at = datetime.datetime(2026, 1, 1)
    looks = [(1000 * a + (k * 37) % 60, a, at + datetime.timedelta(days=k // 3, hours=k % 3 if a else 0)) for a in range(5) for k in range(60)]
    observations = spark.createDataFrame(looks, "id long, aoi_id long, acquired_at timestamp_ntz")
    rasters = observations.select(F.col("id").alias("observation_id"), F.when(F.col("aoi_id") < 4, F.col("id") % 2 + 1).otherwise(9).alias("lineage_id"), F.when(F.col("id") % 7 > 0, "NBR").otherwise("NDVI").alias("index_type"))
    events = spark.range(200).select("id", (F.col("id") % 5).alias("aoi_id"), (F.floor(F.col("id") / 5) % 2 + 1).alias("methodology_id"))
    methodologies = spark.createDataFrame([(1, 1), (2, 2)], "id long, lineage_id long")
    return events, observations, rasters, methodologies


def _plain(spark):
    """The same from the lists."""
    return {r.event_id: (len(r.looks), ",".join(str(x.observation_id) for x in r.looks)) if r.looks else (None, None) for r in views.lineage_looks(*_tables(spark)).collect()}


def test_texts_say_what_the_lists_say(spark, monkeypatch):
    want = _plain(spark)
    assert len(want) == 200 and {v[0] for v in want.values()} >= {None, 26}
    for short in (views.SHORT_TEXT, 10):
        monkeypatch.setattr(views, "SHORT_TEXT", short)
        monkeypatch.setattr(views, "TASK_BYTES", 600)
        got = views.lineage_looks(*_tables(spark), as_text=True).collect()
        assert len(got) == 200 and {r.event_id: (r.looks, r.ids) for r in got} == want


def test_few_rows_with_long_texts_are_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(views, "SHORT_TEXT", 10)
    monkeypatch.setattr(views, "TASK_BYTES", 600)
    rows = views.lineage_looks(*_tables(spark), as_text=True).where("looks IS NOT NULL")
    sizes = rows.groupBy(F.spark_partition_id(), F.substring("ids", 1, 5)).agg(F.sum(F.length("ids")).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 600  # of one text in a task, which has 20 events
