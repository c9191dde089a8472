"""Polygons, lines and points: contact, containment, distance and cells, on shapes whose answer is plain to see."""

import random

import pytest
from pyspark.sql import functions as F

from landshift.functions import geometry
from landshift.operators import context, polygons

BOX = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
U = [[0, 0], [10, 0], [10, 10], [7, 10], [7, 3], [3, 3], [3, 10], [0, 10], [0, 0]]
RING = [BOX(0, 0, 10, 10), BOX(3, 3, 7, 7)]

CASES = [
    # left, right, whether they meet, whether the right one contains the left one
    ("apart", ("Polygon", [BOX(0, 0, 1, 1)]), ("Polygon", [BOX(2, 0, 3, 1)]), False, False),
    ("a corner", ("Polygon", [BOX(0, 0, 1, 1)]), ("Polygon", [BOX(1, 1, 3, 3)]), True, False),
    ("an edge", ("Polygon", [BOX(0, 0, 1, 1)]), ("Polygon", [BOX(1, -1, 3, 3)]), True, False),
    ("the same", ("Polygon", [BOX(0, 0, 2, 2)]), ("Polygon", [BOX(0, 0, 2, 2)]), True, True),
    ("well inside", ("Polygon", [BOX(4, 4, 5, 5)]), ("Polygon", [BOX(0, 0, 10, 10)]), True, True),
    ("around it", ("Polygon", [BOX(0, 0, 10, 10)]), ("Polygon", [BOX(4, 4, 5, 5)]), True, False),
    ("inside at an edge", ("Polygon", [BOX(0, 4, 5, 5)]), ("Polygon", [BOX(0, 0, 10, 10)]), True, True),
    ("crossing", ("Polygon", [BOX(-1, 4, 5, 5)]), ("Polygon", [BOX(0, 0, 10, 10)]), True, False),
    ("within the hole", ("Polygon", [BOX(4, 4, 6, 6)]), ("Polygon", RING), False, False),
    ("filling the hole", ("Polygon", [BOX(3, 3, 7, 7)]), ("Polygon", RING), True, False),
    ("over the hole", ("Polygon", [BOX(2, 2, 8, 8)]), ("Polygon", RING), True, False),
    ("beside the hole", ("Polygon", [BOX(1, 1, 3, 9)]), ("Polygon", RING), True, True),
    ("a ring in a ring", ("Polygon", [BOX(1, 1, 9, 9), BOX(2, 2, 8, 8)]), ("Polygon", RING), True, True),
    ("a bar over the mouth", ("Polygon", [BOX(1, 8, 9, 9)]), ("Polygon", [U]), True, False),
    ("corners on the outline, middle outside", ("Polygon", [[[3, 10], [7, 10], [5, 3], [3, 10]]]), ("Polygon", [U]), True, False),
    ("a slanted edge along another", ("Polygon", [[[0, 0], [3, 3], [0, 3], [0, 0]]]), ("Polygon", [[[0, 0], [9, 9], [0, 9], [0, 0]]]), True, True),
    ("two parts, one inside", ("MultiPolygon", [[BOX(1, 1, 2, 2)], [BOX(20, 1, 21, 2)]]), ("Polygon", [BOX(0, 0, 10, 10)]), True, False),
    ("two parts in two", ("MultiPolygon", [[BOX(1, 1, 2, 2)], [BOX(21, 1, 22, 2)]]), ("MultiPolygon", [[BOX(0, 0, 10, 10)], [BOX(20, 0, 30, 10)]]), True, True),
    ("a line inside", ("LineString", [[1, 1], [9, 9]]), ("Polygon", [BOX(0, 0, 10, 10)]), True, True),
    ("a line through the hole", ("LineString", [[1, 1], [9, 9]]), ("Polygon", RING), True, False),
    ("a line from edge to edge", ("LineString", [[0, 5], [10, 5]]), ("Polygon", [BOX(0, 0, 10, 10)]), True, True),
    ("a line holds nothing", ("LineString", [[1, 1], [2, 2]]), ("LineString", [[0, 0], [3, 3]]), True, False),
    ("lines that cross", ("LineString", [[0, 0], [4, 4]]), ("MultiLineString", [[[9, 9], [8, 8]], [[0, 4], [4, 0]]]), True, False),
    ("a point inside", ("Point", [5, 5]), ("Polygon", [BOX(0, 0, 10, 10)]), True, True),
    ("a point in the hole", ("Point", [5, 5]), ("Polygon", RING), False, False),
    ("a point on an edge", ("Point", [10, 5]), ("Polygon", [BOX(0, 0, 10, 10)]), True, False),
    ("a line on an edge", ("LineString", [[10, 5], [10, 6]]), ("Polygon", [BOX(0, 0, 10, 10)]), True, False),
    ("points, one outside", ("MultiPoint", [[5, 5], [50, 5]]), ("Polygon", [BOX(0, 0, 10, 10)]), True, False),
    ("a polygon around a point", ("Polygon", [BOX(0, 0, 10, 10)]), ("Point", [5, 5]), True, False),
    ("a long slanted edge", ("LineString", [[-50, -49], [50, 51]]), ("Point", [0, 1]), True, False),
]


def _edges(spark, shapes, *keys):
    df = spark.createDataFrame([(i, kind, str(c)) for i, (kind, c) in shapes], "id long, geometry_type string, coordinates string")
    return polygons.edges(df, "id", "geometry_type", "coordinates", *keys)


@pytest.mark.parametrize("size", [0.7, 4.0, 1000.0])
def test_relations_of_plain_shapes(spark, size):
    left = _edges(spark, [(k, a) for k, (_, a, _, _, _) in enumerate(CASES)]).withColumn("k", F.col("id"))
    right = _edges(spark, [(k, b) for k, (_, _, b, _, _) in enumerate(CASES)]).withColumn("k", F.col("id"))
    got = {r.l_id: r.contains for r in polygons.relations(left, right, size, ("k",)).collect()}
    want = {k: inside for k, (*_, meet, inside) in enumerate(CASES) if meet}
    assert {CASES[k][0]: v for k, v in got.items()} == {CASES[k][0]: v for k, v in want.items()}


def test_null_empty_and_broken_texts(spark):
    rows = [(1, "Polygon", None), (2, "Polygon", "[]"), (3, "Polygon", "{"), (4, "Circle", "[1,2]"), (5, None, "[1,2]"), (6, "Point", "[1,2]"), (7, "LineString", "[[1,2]]")]
    df = spark.createDataFrame(rows, "id long, geometry_type string, coordinates string")
    found = polygons.edges(df)
    assert {(r.id, r.ax, r.by) for r in found.collect()} == {(6, 1.0, 2.0), (7, 1.0, 2.0)}
    none = found.limit(0)
    assert polygons.relations(none, found, 1.0).count() == 0 and polygons.nearest(none, none, 10.0, 1.0).count() == 0 and polygons.spans(none).count() == 0


@pytest.mark.parametrize(
    "a, b, metres",
    [
        ((144 + 25 / 60 + 29.52440 / 3600, -37 - 57 / 60 - 3.72030 / 3600), (143 + 55 / 60 + 35.38390 / 3600, -37 - 39 / 60 - 10.15610 / 3600), 54972.271),  # the published line Flinders Peak - Buninyong
        ((0, 0), (1, 0), 111319.4908), ((5, 0), (5, 1), 110574.3886), ((0, 90), (40, -90), 20003931.4586), ((7, 50), (7, 50), 0.0), ((179.9, 10), (-179.9, 10), 21927.9),
    ],
)
def test_published_geodesics(spark, a, b, metres):
    got = spark.range(1).select(geometry.geodesic_m(F.lit(float(a[0])), F.lit(float(a[1])), F.lit(float(b[0])), F.lit(float(b[1])))).first()[0]
    assert got == pytest.approx(metres, abs=2e-3 if metres < 1e6 and a[0] != 179.9 else 60)


def test_nearest_points_by_brute_force(spark):
    """Against points laid close together along all edges."""
    rng = random.Random(2)
    shape = lambda: ("LineString", [[round(rng.uniform(10, 10.3), 4), round(rng.uniform(55, 55.2), 4)] for _ in range(3)])
    left, right = [(k, shape()) for k in range(12)], [(k, shape()) for k in range(12)]
    a, b = _edges(spark, left), _edges(spark, right)
    met = {(r.l_id, r.r_id) for r in polygons.relations(a, b, 0.05).collect()}
    got = {(r.l_id, r.r_id): r.distance_m for r in polygons.nearest(a, b, 3000.0, 0.05).collect() if (r.l_id, r.r_id) not in met}

    def points(line):
        return [(p[0] + (q[0] - p[0]) * t / 300, p[1] + (q[1] - p[1]) * t / 300) for p, q in zip(line, line[1:], strict=False) for t in range(301)]

    import numpy as np

    lat, flat = np.radians(55.1), 1 / 298.257223563
    e2 = flat * (2 - flat)
    w = np.sqrt(1 - e2 * np.sin(lat) ** 2)
    sx, sy = np.radians(6378137) * np.cos(lat) / w, np.radians(6378137) * (1 - e2) / w**3
    for i, (_, p) in left:
        for j, (_, q) in right:
            u, v = np.array(points(p)) * [sx, sy], np.array(points(q)) * [sx, sy]
            far = np.sqrt(((u[:, None] - v[None]) ** 2).sum(-1)).min()
            if (i, j) not in met and far < 2900:
                assert got[i, j] == pytest.approx(far, rel=0.02, abs=40)
            if far > 3200:
                assert (i, j) not in got


def test_cells_in_polygons(spark):
    rng = random.Random(4)
    shapes = [(k, ("Polygon", [[[rng.uniform(-5, 30), rng.uniform(-5, 30)] for _ in range(3)]])) for k in range(20)]
    for _, (_, rings) in shapes:
        rings[0].append(rings[0][0])
    shapes += [(100, ("Polygon", RING)), (101, ("Polygon", [U]))]
    got = {}
    for r in polygons.spans(_edges(spark, shapes)).collect():
        got.setdefault(r.id, set()).update((r.row, c) for c in range(r.c0, r.c1))
    import numpy as np

    for k, (_, rings) in shapes:
        y, x = (v.ravel() for v in np.mgrid[-10:40, -10:40])
        held = geometry.inside([[np.array(r, float) for r in rings]], x + 0.5, y + 0.5)
        assert got.get(k, set()) == {(int(r), int(c)) for r, c, h in zip(y, x, held, strict=True) if h}


def test_context_of_shapes(spark):
    event = _edges(spark, [(1, ("Polygon", [BOX(10.0, 50.0, 10.01, 50.01)]))])
    features = [(1, "concession", ("Polygon", [BOX(9, 49, 11, 51)])), (2, "road", ("LineString", [[9.9, 50.005], [10.1, 50.006]])), (3, "river", ("LineString", [[10.02, 49], [10.02, 51]])), (4, "river", ("LineString", [[10.03, 49], [10.03, 51]])), (5, "mill", ("Point", [12, 50])), (6, "port", ("Point", [10.0, 50.02]))]
    df = spark.createDataFrame([(i, kind, g[0], str(g[1])) for i, kind, g in features], "id long, kind string, geometry_type string, coordinates string")
    got = {r.feature_id: (r.relation, r.distance_m) for r in context.shape_relations(event, polygons.edges(df, "id", "geometry_type", "coordinates", "kind"), 5000.0).collect()}
    assert got == {1: ("contains", None), 2: ("intersects", None), 3: ("nearby", pytest.approx(716.7, abs=0.4)), 6: ("nearby", pytest.approx(1112.4, abs=0.3))}
