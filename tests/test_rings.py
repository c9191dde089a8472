"""Rings of patches against walking around sets of cells one edge at a time."""

import json
import random
from collections import defaultdict

import pytest

from landshift.functions import geometry
from landshift.operators import components, rings

STEPS = [(0, 1), (1, 0), (0, -1), (-1, 0)]  # east, south, west, north; the patch lies on the right


def _brute(cells):
    """Rings of a set of (row, col) as sets of corner tuples from the topmost, leftmost corner."""
    edges = {}
    for r, c in cells:
        for d, ((dr, dc), start) in enumerate(zip([(-1, 0), (0, 1), (1, 0), (0, -1)], [(r, c), (r, c + 1), (r + 1, c + 1), (r + 1, c)], strict=True)):
            if (r + dr, c + dc) not in cells:
                edges[start, d] = (r, c)
    out, left = [], set(edges)
    while left:
        at = begin = min(left)
        path = []
        while True:
            left.discard(at)
            (r, c), d = at
            end = (r + STEPS[d][0], c + STEPS[d][1])
            # Right if that edge is there and belongs to the same cell, else straight or left.
            turn = next(t for t in (1, 0, 3) if (end, (d + t) % 4) in edges and (t != 1 or edges[end, (d + 1) % 4] == edges[at]))
            if turn:
                path.append(end)
            at = (end, (d + turn) % 4)
            if at == begin:
                break
        k = path.index(min(path))
        out.append(tuple(path[k:] + path[:k] + [path[k]]))
    return sorted(out)


def _area(ring):
    return sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:], strict=False)) // 2


def _got(df):
    return [(r.patch, r.hole, r.cells, tuple((p["row"], p["col"]) for p in r.points)) for r in df.collect()]


def _check(spark, scenes, tile):
    rows = [(s, r, c) for s, cells in scenes.items() for r, c in cells]
    df = spark.createDataFrame(rows, "scene long, row long, col long").repartition(4)
    labelled = components.patches(df, tile).select("scene", "row", "col", "patch").cache()
    got = defaultdict(list)
    for patch, hole, area, ring in _got(rings.rings(labelled, tile)):
        assert area == _area(ring) and hole == (area < 0)
        got[patch].append(ring)
    members = defaultdict(set)
    for x in labelled.collect():
        members[x.patch].add((x.row, x.col))
    assert {p: sorted(v) for p, v in got.items()} == {p: _brute(cells) for p, cells in members.items()}
    for p, v in got.items():
        assert sum(map(_area, v)) == len(members[p]) and sum(_area(x) > 0 for x in v) == 1
    return labelled


@pytest.mark.parametrize("tile", [3, 8, 512])
def test_random_patches_of_any_tile(spark, tile):
    rng = random.Random(tile)
    scenes = {s: {(r, c) for r in range(22) for c in range(22) if rng.random() < share} for s, share in ((0, 0.5), (1, 0.75), (7, 0.93))}
    _check(spark, scenes, tile)


def test_holes_diagonals_and_long_rings(spark):
    frame = {(r, c) for r in range(5) for c in range(5)} - {(2, 2)}
    touching_holes = {(r + 20, c) for r in range(6) for c in range(6)} - {(22, 2), (23, 3)}  # one ring, as holes are 8-connected
    corner = {(40, 0), (41, 1)}  # two patches
    self_touch = {(50, 0), (50, 1), (51, 0), (51, 2), (52, 0), (52, 1), (52, 2), (50, 2)} - {(50, 2)}
    spiral = {(60 + r, c) for r in range(40) for c in range(40) if r % 4 == 0 or (c == 39 and r % 8 < 4) or (c == 0 and r % 8 >= 4)}
    labelled = _check(spark, {0: frame | touching_holes | corner | self_touch | spiral, 3: {(0, 0)}}, 4)
    texts = {r.patch: r for r in rings.polygons(rings.rings(labelled, 4)).collect()}
    first = texts[0]
    assert (first.holes, first.cells) == (1, 24)
    assert json.loads(first.coordinates) == [[[0, 0], [5, 0], [5, 5], [0, 5], [0, 0]], [[2, 2], [2, 3], [3, 3], [3, 2], [2, 2]]]
    df = spark.createDataFrame([(first.coordinates,)], "t string")
    assert df.select(geometry.polygon_problem("t")).first()[0] is None
    assert texts[20 << 20].holes == 1


def test_no_cells(spark):
    none = spark.createDataFrame([], "scene long, row long, col long, patch long")
    assert rings.rings(none).count() == 0 and rings.polygons(rings.rings(none)).count() == 0
