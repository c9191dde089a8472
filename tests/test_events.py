import datetime
import random

import pytest
from pyspark.sql import functions as F

from landshift.functions import text as fn
from landshift.operators import boxes, confidence, context, tracking, trajectory

DAY = lambda n: datetime.datetime(2026, 1, 1) + datetime.timedelta(days=n)
SCHEMA = "id long, aoi_id long, methodology_id long, detected_at timestamp_ntz, x0 long, y0 long, x1 long, y1 long"


def _tracked(spark, rows):
    return {r.candidate_id: r.event_id for r in tracking.tracked(spark.createDataFrame(rows, SCHEMA)).collect()}


def _touch(a, b):
    return a[1:3] == b[1:3] and a[4] <= b[6] and b[4] <= a[6] and a[5] <= b[7] and b[5] <= a[7]


def _brute(rows):
    events, out = [], {}
    for c in sorted(rows, key=lambda r: (r[3], r[0])):
        met = [e for e in events if any(_touch(c, m) for m in e["members"])]
        if met:
            e = min(met, key=lambda e: (e["first"], e["id"]))
            e["members"].append(c)
        else:
            e = {"id": c[0], "first": c[3], "members": [c]}
            events.append(e)
        out[c[0]] = e["id"]
    return out


def test_growth_and_bridges(spark):
    a, grown, b, bridge = (1, 1, 1, DAY(0), 10, 10, 20, 20), (2, 1, 1, DAY(7), 15, 10, 30, 20), (3, 1, 1, DAY(1), 60, 60, 70, 70), (4, 1, 1, DAY(8), 5, 5, 75, 75)
    assert _tracked(spark, [a, grown]) == {1: 1, 2: 1}
    assert _tracked(spark, [a, b]) == {1: 1, 3: 3}
    assert _tracked(spark, [a, b, bridge]) == {1: 1, 3: 3, 4: 1}
    assert _tracked(spark, [a, (5, 1, 2, DAY(3), 10, 10, 20, 20)]) == {1: 1, 5: 5}  # another methodology
    assert _tracked(spark, [a, (6, 1, 1, DAY(3), 20, 20, 25, 25)]) == {1: 1, 6: 1}  # a corner touches


@pytest.mark.parametrize("seed", [1, 2])
def test_tracking_as_by_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        x, y = rng.randint(0, 300), rng.randint(0, 300)
        rows.append((i, rng.randint(1, 2), rng.randint(1, 2), DAY(rng.randint(0, 30)), x, y, x + rng.randint(1, 25), y + rng.randint(1, 25)))
    assert _tracked(spark, rows) == _brute(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_late_candidates_as_by_a_plain_loop(spark, seed):
    """Existing members stay; new ones come after them in the order of detection, late ones among them."""
    rng = random.Random(seed)
    rows = []
    for i in range(260):
        x, y = rng.randint(0, 250), rng.randint(0, 250)
        rows.append((i, 1, rng.randint(1, 2), DAY(rng.randint(0, 30)), x, y, x + rng.randint(1, 25), y + rng.randint(1, 25)))
    old, new = rows[:200], rows[200:]
    event = _brute(old)
    first = {e: min(r[3] for r in old if event[r[0]] == e) for e in set(event.values())}
    key, held = {e: (at, e) for e, at in first.items()}, [(r, event[r[0]]) for r in old]
    want = {}
    for c in sorted(new, key=lambda r: (r[3], r[0])):
        met = {e for m, e in held if _touch(c, m)}
        want[c[0]] = min(met, key=key.get) if met else c[0]
        key.setdefault(want[c[0]], (c[3], c[0]))
        held.append((c, want[c[0]]))
    members = spark.createDataFrame([(e, c) for c, e in event.items()], "event_id long, candidate_id long")
    got = tracking.extended(spark.createDataFrame(old, SCHEMA), members, spark.createDataFrame(new, SCHEMA))
    assert {r.candidate_id: r.event_id for r in got.collect()} == want


def test_a_long_chain_is_one_event(spark):
    rows = [(i, 1, 1, DAY(i), i * 10, 0, i * 10 + 10, 5) for i in range(60)]
    assert set(_tracked(spark, rows).values()) == {0}


def test_looks_are_counted_to_the_instant(spark):
    at = lambda d, h: DAY(d) + datetime.timedelta(hours=h)
    looks = [(1, "radar", at(d, h)) for d, h in ((3, 1), (3, 9), (3, 9), (8, 0), (20, 12))]
    spans = [(1, at(3, 1), at(3, 9)), (2, at(3, 2), at(8, 0)), (3, at(4, 0), at(7, 23)), (4, at(-9, 0), at(90, 0)), (5, at(30, 0), at(40, 0)), (6, at(-9, 0), at(-8, 0)), (7, at(20, 13), at(21, 0))]
    got = confidence._looks_within(spark.createDataFrame([(i, 1, "radar", a, b) for i, a, b in spans], "id long, aoi_id long, kind string, from_at timestamp_ntz, to_at timestamp_ntz"), spark.createDataFrame(looks, "aoi_id long, kind string, acquired_at timestamp_ntz"))
    assert {r.id: r.other_observations for r in got.collect()} == {i: sum(a <= t <= b for _, _, t in looks) for i, a, b in spans}


def test_box_pairs_as_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 1), x, y, x + rng.randint(0, 200), y + rng.randint(0, 90)) for i, (x, y) in enumerate((rng.randint(-500, 500), rng.randint(-500, 500)) for _ in range(150))]
    df = spark.createDataFrame(rows, "id long, k long, x0 long, y0 long, x1 long, y1 long")
    for within in (0.0, 40.0):
        want = set()
        for a in rows:
            for b in rows:
                dx, dy = max(0, a[2] - b[4], b[2] - a[4]), max(0, a[3] - b[5], b[3] - a[5])
                if a[1] == b[1] and (dx * dx + dy * dy) ** 0.5 <= within:
                    want.add((a[0], b[0]))
        got = [(r.l_id, r.r_id) for r in boxes.near_pairs(df, df, ("k",), within).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_footprint_growth(spark):
    members = spark.createDataFrame([(1, 1, DAY(0)), (1, 2, DAY(1)), (1, 3, DAY(2))], "event_id long, candidate_id long, detected_at timestamp")
    cells = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 0, 1), (2, 0, 2), (3, 0, 0)], "candidate_id long, row long, col long")
    assert {r.candidate_id: r.growth_m2 for r in tracking.growth(members, cells, 900.0).collect()} == {1: None, 2: 900.0, 3: 0.0}


@pytest.mark.parametrize("look,fraction,status,last,want", [(50, 0.5, "ongoing", 10, "resolved"), (50, 0.4, "ongoing", 10, "ongoing"), (5, 0.9, "ongoing", 10, "ongoing"), (150, 0.9, "ongoing", 140, "ongoing"), (50, 0.9, "new", 10, "new")])
def test_lifecycle(spark, look, fraction, status, last, want):
    events = spark.createDataFrame([(1, 1, status, DAY(last))], "id long, aoi_id long, status string, last_detected_at timestamp")
    looks = spark.createDataFrame([(7, 1, DAY(look))], "id long, aoi_id long, acquired_at timestamp")
    quality = spark.createDataFrame([(7, fraction)], "observation_id long, valid_pixel_fraction double")
    assert tracking.resolved(events, looks, quality, F.lit(DAY(200))).first().status == want


def _value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_factors(spark):
    f = lambda x: F.lit(x).cast("double")
    assert [_value(spark, confidence.magnitude(f(x))) for x in (None, -0.05, -0.1, -0.3, -0.5, -0.9)] == [None, 0, 0, pytest.approx(0.5), 1, 1]
    assert [_value(spark, confidence.persistence(F.lit(n))) for n in (1, 3, 5, 9)] == [0, 0.5, 1, 1]
    assert [_value(spark, confidence.currency(f(n))) for n in (0, 90, 180, 400)] == [1, 0.5, 0, 0]
    assert [_value(spark, confidence.level(f(x))) for x in (0.65, 0.64, 0.4, 0.39)] == ["high", "medium", "medium", "low"]


@pytest.mark.parametrize("values,score,missing", [((1, 1, 0.8, 1, 1, 1), 0.98, ""), ((None, 1, None, 1, None, None), 1.0, "agreement,coverage,magnitude,stability"), ((None,) * 6, 0.0, "agreement,coverage,currency,magnitude,persistence,stability")])
def test_weighted_rule(spark, values, score, missing):
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in values)], ", ".join(f"{n} double" for n in confidence.WEIGHTS))
    row = confidence.weighted(df).first()
    assert (row.score, row.missing) == (score, missing)


@pytest.mark.parametrize("after,state", [([(10, 0.12), (15, 0.13)], "persistent"), ([(10, 0.30), (15, 0.35)], "recovering"), ([(10, 0.55), (15, 0.58)], "transient"), ([], "insufficient-data")])
def test_trajectory_states(spark, after, state):
    event = spark.createDataFrame([(1, DAY(4))], "id long, first_detected_at timestamp")
    rows = [(1, f"2026-01-{d:02d}", v, 1.0) for d, v in [(1, 0.6), (3, 0.6), (5, 0.1), *after]]
    got = trajectory.classified(event, spark.createDataFrame(rows, "event_id long, date string, mean double, fraction double")).first()
    assert (got.state, got.reference, got.detection) == (state, pytest.approx(0.6), 0.1)


def test_days_are_weighted_and_poor_ones_go(spark):
    rows = [(1, "2026-01-01", 0.2, 10, 20), (1, "2026-01-01", 0.8, 30, 40), (1, "2026-01-02", 0.5, 1, 10), (1, "2026-01-03", None, 0, 10)]
    got = trajectory.series(spark.createDataFrame(rows, "event_id long, date string, mean double, valid long, total long")).collect()
    assert [(r.date, r.mean, r.fraction) for r in got] == [("2026-01-01", pytest.approx(0.65), pytest.approx(40 / 60))]


def test_context(spark):
    event = spark.createDataFrame([(1, 100, 100, 200, 200)], "id long, x0 long, y0 long, x1 long, y1 long")
    features = [(1, "concession", 0, 0, 300, 300), (2, "road", 0, 150, 300, 150), (3, "river", 220, 0, 220, 300), (4, "river", 240, 0, 240, 300), (5, "mill", 5000, 5000, 5000, 5000)]
    df = spark.createDataFrame(features, "id long, kind string, x0 long, y0 long, x1 long, y1 long")
    got = {r.feature_id: (r.relation, r.distance_m) for r in context.relations(event, df, 5000.0, 100.0).collect()}
    assert got == {1: ("contains", None), 2: ("intersects", None), 3: ("nearby", 2000.0)}
    assert 3 not in {r.feature_id for r in context.relations(event, df, 1000.0, 100.0).collect()}


def test_agreement_is_missing_without_a_look(spark):
    event = spark.createDataFrame([(1, 1, DAY(40), DAY(50), 0, 0, 9, 9), (2, 1, DAY(200), DAY(200), 0, 0, 9, 9), (3, 2, DAY(40), DAY(50), 0, 0, 9, 9)], "id long, aoi_id long, first_detected_at timestamp, last_detected_at timestamp, x0 long, y0 long, x1 long, y1 long")
    kinds = spark.createDataFrame([(1, ["optical"]), (2, ["optical"]), (3, ["optical", "radar"])], "event_id long, kinds array<string>")
    looks = spark.createDataFrame([(1, "radar", DAY(15)), (1, "radar", DAY(90))], "aoi_id long, kind string, acquired_at timestamp")
    none = spark.createDataFrame([], "id long, aoi_id long, kind string, detected_at timestamp, x0 long, y0 long, x1 long, y1 long")
    got = {r.event_id: (r.other_observations, r.agreement, r.basis) for r in confidence.agreement(event, kinds, looks, none).collect()}
    assert got == {1: (1, 0.0, "optical-only"), 2: (0, None, "optical-only"), 3: (0, None, None)}
    seen = spark.createDataFrame([(9, 1, "radar", DAY(60), 9, 9, 12, 12)], none.schema)
    assert {r.event_id: r.basis for r in confidence.agreement(event, kinds, looks, seen).collect()}[1] == "both"


def test_names(spark):
    assert [_value(spark, fn.sanitized(F.lit(x))) for x in (" Kolombangara (West) ", "a__b", "!!", "-x-")] == ["kolombangara-west", "a__b", None, "x"]
    assert _value(spark, fn.kind_and_name(F.lit("road--a--b")))[:] == ("road", "a--b") and _value(spark, fn.kind_and_name(F.lit("road"))) is None
    assert _value(spark, fn.days_between(F.lit(DAY(3)), F.lit(DAY(1)))) == 0
