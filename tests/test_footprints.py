"""Footprints of cells: runs, contact, tracking and union against plain sets of cells."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from landshift.operators import footprints, tracking
from landshift.sources import shared

DAY = lambda n: datetime.datetime(2026, 1, 1) + datetime.timedelta(days=n)
PLACE = "id long, aoi_id long, methodology_id long, detected_at timestamp_ntz"


def _shape(rng, reach):
    """A connected or scattered set of cells; often an L or a frame."""
    x, y, w, h = rng.randint(0, reach), rng.randint(0, reach), rng.randint(1, 9), rng.randint(1, 9)
    box = [(y + r, x + c) for r in range(h) for c in range(w)]
    kind = rng.randint(0, 3)
    if kind == 1:
        return {(r, c) for r, c in box if c == x or r == y + h - 1}
    if kind == 2:
        return {(r, c) for r, c in box if c in (x, x + w - 1) or r in (y, y + h - 1)}
    return set(box) if kind else set(rng.sample(box, rng.randint(1, len(box))))


def _meet(a, b):
    return any((r + i, c + j) in b for r, c in a for i in (-1, 0, 1) for j in (-1, 0, 1))


def _runs(spark, shapes):
    rows = [(i, r, c) for i, cells in shapes.items() for r, c in cells]
    return footprints.runs(spark.createDataFrame(rows + rows[:5], "candidate_id long, row long, col long"), "candidate_id")


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(8)
    return {i: _shape(rng, 90) for i in range(220)} | {900: {(-3, -2), (-2, -1)}, 901: {(-1, 0)}, 902: {(0, c) for c in range(300)}}


def test_runs_are_the_cells(spark, shapes):
    runs = _runs(spark, shapes)
    assert {(r.candidate_id, r.row, r.col) for r in footprints.cells(runs, "candidate_id").collect()} == {(i, *x) for i, cells in shapes.items() for x in cells}
    got = runs.collect()
    assert len(got) == sum((r, c - 1) not in cells for cells in shapes.values() for r, c in cells)
    box = spark.createDataFrame([(1, 2, 3, 5, 5), (2, 0, 0, 0, 4)], "id long, x0 long, y0 long, x1 long, y1 long")
    assert sorted(tuple(r) for r in footprints.box_runs(box, "id").collect()) == [(1, 3, 2, 5), (1, 4, 2, 5)]


def test_contact_is_by_cells_with_edges_and_corners(spark, shapes):
    runs = _runs(spark, shapes).withColumnRenamed("candidate_id", "id").withColumn("k", F.col("id") % 2)
    got = [(r.l_id, r.r_id) for r in footprints.touching(runs, runs, ("k",), F.col("l_id") < F.col("r_id")).collect()]
    want = {(a, b) for a in shapes for b in shapes if a < b and a % 2 == b % 2 and _meet(shapes[a], shapes[b])}
    assert len(got) == len(set(got)) and set(got) == want


def test_union_as_by_sets(spark, shapes):
    links = spark.createDataFrame([(i % 7, i) for i in shapes], "event_id long, candidate_id long")
    runs = tracking.event_footprints(links, _runs(spark, shapes))
    want = {}
    for i, cells in shapes.items():
        want.setdefault(i % 7, set()).update(cells)
    got = footprints.cells(runs, "id").collect()
    assert len(got) == sum(map(len, want.values())) and {(r.id, r.row, r.col) for r in got} == {(e, *x) for e, cells in want.items() for x in cells}
    box = {r.id: (r.x0, r.y0, r.x1, r.y1) for r in footprints.bounds(runs, "id").collect()}
    assert box == {e: (min(c for _, c in s), min(r for r, _ in s), max(c for _, c in s) + 1, max(r for r, _ in s) + 1) for e, s in want.items()}


def _brute(rows, shapes):
    events, out = [], {}
    for c in sorted(rows, key=lambda r: (r[3], r[0])):
        met = [e for e in events if any(c[1:3] == m[1:3] and _meet(shapes[c[0]], shapes[m[0]]) for m in e["members"])]
        e = min(met, key=lambda e: (e["first"], e["id"])) if met else {"id": c[0], "first": c[3], "members": []}
        e["members"].append(c)
        events += [] if met else [e]
        out[c[0]] = e["id"]
    return out


def test_interlocking_shapes_stay_two_events(spark):
    low, high = {(r, 0) for r in range(9)} | {(8, c) for c in range(9)}, {(r, 10) for r in range(7)} | {(0, c) for c in range(2, 11)}
    frame, within = {(r, c) for r in range(20, 29) for c in range(9) if r in (20, 28) or c in (0, 8)}, {(24, 4)}
    shapes = {1: low, 2: high, 3: frame, 4: within, 5: {(9, 9)}, 6: {(25, 5)}}
    rows = [(i, 1, 1, DAY(i)) for i in shapes]
    got = tracking.tracked(spark.createDataFrame(rows, PLACE), _runs(spark, shapes)).collect()
    # 5 meets a corner of 1; 6 a corner of 4; no box test would part 1 from 2 or 3 from 4.
    assert {r.candidate_id: r.event_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 4} == _brute(rows, shapes)


@pytest.mark.parametrize("seed", [1, 2])
def test_tracking_as_by_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    shapes = {i: _shape(rng, 60) for i in range(260)}
    rows = [(i, rng.randint(1, 2), rng.randint(1, 2), DAY(rng.randint(0, 20))) for i in shapes]
    got = tracking.tracked(spark.createDataFrame(rows, PLACE), _runs(spark, shapes)).collect()
    assert {r.candidate_id: r.event_id for r in got} == _brute(rows, shapes)


@pytest.mark.parametrize("seed", [3, 4])
def test_late_candidates_as_by_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    shapes = {i: _shape(rng, 60) for i in range(220)}
    rows = [(i, 1, rng.randint(1, 2), DAY(rng.randint(0, 20))) for i in shapes]
    old, new = rows[:140], rows[140:]
    event = _brute(old, shapes)
    key = {e: (min(r[3] for r in old if event[r[0]] == e), e) for e in set(event.values())}
    held, want = [(r, event[r[0]]) for r in old], {}
    for c in sorted(new, key=lambda r: (r[3], r[0])):
        met = {e for m, e in held if m[1:3] == c[1:3] and _meet(shapes[m[0]], shapes[c[0]])}
        want[c[0]] = min(met, key=key.get) if met else c[0]
        key.setdefault(want[c[0]], (c[3], c[0]))
        held.append((c, want[c[0]]))
    members = spark.createDataFrame([(e, c) for c, e in event.items()], "event_id long, candidate_id long")
    got = tracking.extended(spark.createDataFrame(old, PLACE), members, spark.createDataFrame(new, PLACE), _runs(spark, shapes))
    assert {r.candidate_id: r.event_id for r in got.collect()} == want


def test_late_chains_take_rounds_in_the_logarithm_of_their_length(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(tracking, "written", lambda df, name: steps.append(name) or shared.written(df, name))
    old = spark.createDataFrame([(1000, 1, 1, DAY(-5))], PLACE)
    chain = {i: {(0, 2 * i), (0, 2 * i + 1)} for i in range(70)}
    shapes = {1000: {(1, 40)}, **chain}
    new = spark.createDataFrame([(i, 1, 1, DAY(i)) for i in chain], PLACE)
    members = spark.createDataFrame([(1000, 1000)], "event_id long, candidate_id long")
    got = {r.candidate_id: r.event_id for r in tracking.extended(old, members, new, _runs(spark, shapes)).collect()}
    # Up to where the older event is met, each belongs to the start of the chain.
    assert got == {i: 0 if i < 19 else 1000 for i in chain}
    assert len(steps) <= 2 + 2 * 9


def test_empty_footprints(spark):
    none = spark.createDataFrame([], PLACE)
    runs = _runs(spark, {1: {(0, 0)}}).limit(0)
    assert tracking.tracked(none, runs).count() == 0
    assert tracking.event_footprints(spark.createDataFrame([], "event_id long, candidate_id long"), runs).count() == 0


def test_area_of_rows_shrinks_to_the_pole(spark):
    area = [spark.range(1).select(footprints.grid_area_m2(F.lit(r), 60.0, 0.05, F.lit(3))).first()[0] for r in (0, 1199)]
    assert area[1] == pytest.approx(3 * 5565.97 * 5528.7, rel=1e-3) and area[0] == pytest.approx(area[1] / 2, rel=0.02)
