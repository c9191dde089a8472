"""Steps whose work must not grow faster than their input."""

import datetime

from landshift.operators import trajectory

DAY = datetime.datetime(2026, 1, 5, 10)


def test_scenes_of_a_day_are_summed_before_they_meet_events(spark):
    events = spark.createDataFrame([(1, 7), (2, 7)], "id long, aoi_id long")
    looks = spark.createDataFrame([(k, 7, DAY + datetime.timedelta(minutes=k)) for k in range(40)], "id long, aoi_id long, acquired_at timestamp_ntz")
    pixels = spark.createDataFrame([(k, 0, 0.5 if k % 2 else None) for k in range(40)] + [(k, 1, k / 10) for k in range(20)], "observation_id long, pixel long, nbr double")
    cells = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "event_id long, cell long")
    samples = trajectory.footprint_samples(events, looks, pixels, cells)
    assert samples.count() == 2
    got = {r.event_id: (r.date, round(r.mean, 9), r.fraction) for r in trajectory.series(samples).collect()}
    assert got == {1: ("2026-01-05", round((20 * 0.5 + 19) / 40, 9), 40 / 60), 2: ("2026-01-05", 0.5, 0.5)}


def test_equal_outlines_are_compared_once(spark):
    from landshift.operators import context, polygons

    square = lambda i, x, *more: [(i, 0, a + x, b, c + x, d, True, *more) for a, b, c, d in ((0.0, 0.0, 0.01, 0.0), (0.01, 0.0, 0.01, 0.01), (0.01, 0.01, 0.0, 0.01), (0.0, 0.01, 0.0, 0.0))]
    columns = "id long, part long, ax double, ay double, bx double, by double, filled boolean"
    events = spark.createDataFrame([e for i in range(6) for e in square(i, 0.0)] + square(9, 0.02), columns)
    features = spark.createDataFrame([e for i in range(20, 25) for e in square(i, 0.005, "a")] + square(30, 0.005, "b"), columns + ", kind string")
    shapes, members = polygons.outlines(events)
    assert {r.id for r in shapes.collect()} == {0, 9} and {(r.id, r.of) for r in members.collect()} == {(i, 0) for i in range(6)} | {(9, 9)}
    assert {r.id for r in polygons.outlines(features, "kind")[0].collect()} == {20, 30}
    got = {(r.event_id, r.feature_id, r.kind, r.relation) for r in context.shape_relations(events, features, 2000.0, 0.01).collect()}
    touched = {(i, f, "b" if f == 30 else "a", "intersects") for i in range(6) for f in (*range(20, 25), 30)}
    assert got == touched | {(9, 20, "a", "nearby"), (9, 30, "b", "nearby")}


def test_small_tiles_are_worked_on_together(spark):
    import pandas as pd

    from landshift.operators import components

    rows = spark.createDataFrame([(s, t, 0, s * 100 + t * 10 + k) for s in range(30) for t in range(3) for k in range(1 + s % 4)], "scene long, t_row long, t_col long, cell long").repartition(1)
    whole = lambda pdf: pd.DataFrame({"tiles": [pdf[["scene", "t_row"]].drop_duplicates().shape[0]], "cells": [len(pdf)]})
    calls = components.over_tiles(rows, whole, "tiles long, cells long").collect()
    assert sum(r.tiles for r in calls) == 90 and sum(r.cells for r in calls) == rows.count() and len(calls) <= 4


def test_boxes_are_linked_at_corners_of_what_they_share(spark):
    from landshift.operators import footprints

    rows = [(i, 1, i, i % 7, i % 5, i % 7 + i % 4, i % 5 + i % 3) for i in range(200)]
    boxes = spark.createDataFrame(rows, "id long, k long, at long, x0 long, y0 long, x1 long, y1 long")
    links = {(r.u, r.v) for r in footprints.linked_at(footprints.corner_points(boxes, ("id", "k", "at"), ("k",)), ("at",), ("k",)).collect()}
    meet = lambda a, b: a[3] <= b[5] and b[3] <= a[5] and a[4] <= b[6] and b[4] <= a[6]
    assert all(u > v and meet(rows[u], rows[v]) for u, v in links)
    assert len(links) < sum(meet(a, b) for a in rows for b in rows if a[0] > b[0]) / 4
    least = {}
    for i in range(200):  # what can be reached is the same
        least[i] = min([least[v] for u, v in links if u == i], default=i)
        assert least[i] == min([least[b[0]] for b in rows[:i] if meet(rows[i], b)], default=i)


def test_looks_at_one_place_settle_at_once(spark, monkeypatch):
    from landshift.operators import tracking

    rounds = []
    monkeypatch.setattr(tracking, "written", lambda df, name, own=tracking.written: rounds.append(name) or own(df, name))
    rows = [(i, 1, 1, DAY + datetime.timedelta(days=i), 20 * (i % 2), 0, 20 * (i % 2) + 1 + i % 3, 2) for i in range(90)]
    seen = spark.createDataFrame(rows, "id long, aoi_id long, methodology_id long, detected_at timestamp_ntz, x0 long, y0 long, x1 long, y1 long")
    cells = spark.createDataFrame([(r[0], y, r[4], r[6]) for r in rows for y in (0, 1)], "candidate_id long, row long, c0 long, c1 long")
    for footprints in (cells, None):
        rounds.clear()
        assert {(r.candidate_id, r.event_id) for r in tracking.tracked(seen, footprints).collect()} == {(i, i % 2) for i in range(90)}
        assert rounds.count("tracked") == 3  # at first, and one round that changes nothing


def test_equal_runs_of_an_event_become_cells_once(spark, monkeypatch):
    from landshift.operators import footprints, tracking

    opened = []
    monkeypatch.setattr(tracking, "footprint_cells", lambda runs, *keys: opened.append(runs) or footprints.cells(runs, *keys))
    members = spark.createDataFrame([(1, i, DAY + datetime.timedelta(days=i)) for i in range(40)], "event_id long, candidate_id long, detected_at timestamp_ntz")
    runs = spark.createDataFrame([(i, r, 0, 3 + i % 4) for i in range(40) for r in range(2)], "candidate_id long, row long, c0 long, c1 long")
    got = {r.candidate_id: r.growth_m2 for r in tracking.growth(members, runs, 1.0).collect()}
    assert got == {i: None if i == 0 else 2.0 if i < 4 else 0.0 for i in range(40)}
    assert opened[0].count() == 8
