"""Footprints and boxes that are seen again and again are worked on once."""

import random

import pytest
from pyspark.sql import functions as F

from landshift.operators import boxes, footprints


def _meet(a, b):
    return any((r + i, c + j) in b for r, c in a for i in (-1, 0, 1) for j in (-1, 0, 1))


@pytest.fixture(scope="module")
def cells():
    rng = random.Random(3)
    kinds = []
    for _ in range(25):
        x, y, w, h = rng.randint(-70, 70), rng.randint(-70, 70), rng.randint(1, 30), rng.randint(1, 30)
        kinds.append({(y + r, x + c) for r in range(h) for c in range(w) if rng.random() < 0.1 or c == 0 or r == h - 1})
    return {i: kinds[rng.randrange(25)] for i in range(90)}


@pytest.fixture(scope="module")
def runs(spark, cells):
    rows = [(i, i % 2, r, c, c + 1) for i, of in cells.items() for r, c in of]
    return spark.createDataFrame(rows + rows[:3], "id long, k long, row long, c0 long, c1 long")


def _above_join(df):
    return df._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]


def test_pairs_of_footprints_by_lists(cells, runs, monkeypatch):
    monkeypatch.setattr(boxes, "LISTED", 3)
    pairs = footprints.touching_lists(runs, ("k",))
    got = [(r.l_id, r.r_id) for r in pairs.collect()]
    want = {(a, b) for a in cells for b in cells if a % 2 == b % 2 and _meet(cells[a], cells[b])}
    assert len(got) == len(set(got)) and set(got) == want
    assert "Aggregate" not in _above_join(pairs)  # pairs are told where they are found


def test_pairs_of_boxes_by_lists(spark, monkeypatch):
    monkeypatch.setattr(boxes, "LISTED", 4)
    rows = [(i, i % 7, i % 5, i % 7 + 1, i % 5 + 70) for i in range(120)]
    listed = boxes.listed(spark.createDataFrame(rows, "id long, x0 long, y0 long, x1 long, y1 long"), "x0", "y0", "x1", "y1")
    assert listed.agg(F.sum(F.size("ids")), F.max(F.size("ids")), F.count("*")).first()[:] == (120, 4, 35)
    got = [(r.l_id, r.r_id) for r in boxes.spelled(boxes.near_pairs(listed, listed)).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    assert len(got) == len(set(got)) and set(got) == want


def test_earliest_events_look_at_equal_boxes_once(spark, monkeypatch):
    from landshift.operators import tracking

    met = []
    monkeypatch.setattr(tracking, "near_pairs", lambda a, b, *more: met.append((a, b)) or boxes.near_pairs(a, b, *more))
    box = "aoi_id long, methodology_id long, x0 long, y0 long, x1 long, y1 long"
    new = [(i, 1, 1, i % 4 * 10, 0, i % 4 * 10 + 5, 5) for i in range(80)]
    held = [(i % 6, 1, 1, i % 3 * 10, 5, i % 3 * 10 + 5, 9) for i in range(90)]
    events = spark.createDataFrame([(e, 1, 1, 50 - e) for e in range(6)], "id long, aoi_id long, methodology_id long, at long")
    found = tracking._earliest_by_boxes(spark.createDataFrame(new, "id long, " + box), spark.createDataFrame(held, "id long, " + box), events)
    assert {(r.id, r.label.id) for r in found.collect()} == {(i, i % 4 + 3) for i in range(80) if i % 4 < 3}
    assert [df.count() for df in met[0]] == [4, 3]


def test_earliest_events_by_cells(cells, runs):
    from landshift.operators import tracking

    rows = runs.withColumnRenamed("k", "aoi_id").withColumn("methodology_id", F.lit(1).cast("long"))
    of = rows.where("id < 30").withColumn("id", F.col("aoi_id") + F.col("id") % 10 * 2)
    at = {e: (7 * e) % 20 for e in range(20)}
    events = of.select("id", "aoi_id", "methodology_id").distinct().withColumn("at", F.col("id") * 7 % 20)
    got = {r.id: r.label.id for r in tracking._earliest_by_cells(rows, of, events).collect()}
    want = {}
    for i in cells:
        met = [i % 2 + j % 10 * 2 for j in range(30) if i % 2 == j % 2 and _meet(cells[i], cells[j])]
        if met:
            want[i] = min(met, key=lambda e: (at[e], e))
    assert got == want
